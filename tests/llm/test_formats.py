import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from storyloom.llm import chat_format as C
from storyloom.llm.html_extract import BlockRules, extract_main_text, main_text
from storyloom.llm.tokens import vocabulary_path

from .helpers import prose

T = C.Template()
PIECE = st.sampled_from([*T.controls, "\\", "<", "[", "/s>", " ", "\n", "a", "é", "中", "INST]", "<\\/s>"])
TEXT = st.lists(PIECE, max_size=8).map("".join)
TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[TEXT]"]), TEXT), max_size=5)


@settings(max_examples=300, deadline=None)
@given(TURNS)
def test_round_trip_and_masks(turns):
    import numpy as np

    text, spans = C.render(turns, T)
    assert C.parse(text, T) == turns
    e = C._tokenizer(vocabulary_path("byte_bpe_50k.json"), T).encode(text, add_special_tokens=False)
    offsets = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
    mask = C.loss_mask(offsets, spans, T)
    assert C.masked_text(text, offsets, mask) == "".join(t for r, t in turns if r == "assistant")


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", None), (None, 0, None, "x"), (3, None, "tool", "</s>[INST]")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn int, role string, text string, turns int")
    got = {r.conv_id: r for r in C.digests(C.format_conversations(df, vocabulary_path("byte_bpe_50k.json"))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\na\nassistant\nb\nassistant\nb\n") and got[1].loss_sha256 == sha("bb") and got[1].loss_chars == 2
    assert got[2].turns_sha256 == sha("user\n\n") and got[3].turns_sha256 == sha("tool\n</s>[INST]\n") and got[None].turns_sha256 == sha("\nx\n")
    assert C.format_conversations(df.limit(0), vocabulary_path("byte_bpe_50k.json")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu</a></li></ul></nav>
<header>Site</header><div class="ad">Buy now</div><article><h1>Head &amp; line</h1><p><b>First  para.<br><p>Second&nbsp;one.<aside>side</aside><p>x</p><div class="ad">Buy</div>
<form><p>mail</p></form><p>Last &lt;tag&gt;.</p></article><section class="comments"><p>first!</p></section><div class="cookie-notice">cookies</div><footer>&copy; me</footer>"""


def test_main_text():
    assert main_text(PAGE) == "Head & line\n\nFirst para.\n\nSecond one.\n\nx\n\nLast <tag>."
    assert main_text("<p>only") == "only" and main_text("") == "" and main_text(None) == "" and main_text("<nav><a>m</a></nav>") == ""
    assert main_text("<div id='main'><p>" + "long text " * 30 + "</p></div><ul><li><a href=x>link</a></li></ul>") == ("long text " * 30).strip()
    assert main_text("<p>" + "a" * 500_000 + "</p>") == "a" * 500_000


def test_small_regions_and_link_lines_of_unmarked_pages():
    furniture = "<div class='ad'><p>a</p><p>b</p><p>c</p></div>"
    body, end = "long text " * 30, "The end."
    page = f"<ul><li><a href=x>menu</a></li></ul><div><p>{body}</p>{furniture}<p>{end}</p><p><a href=y>Source of the claim</a></p><p>Corrected.</p></div><ul><li><a href=z>more</a></li></ul>"
    assert main_text(page) == "\n\n".join([body.strip(), end, "Source of the claim", "Corrected."])
    assert main_text(page.replace("<div><p>", "<main><p>").replace("</div><ul>", "</main><ul>")) == main_text(page)


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "old"), (2, None, None, "old"), (2, None, None, "old")], "page_id long, url string, html string, main_text string")
    got = extract_main_text(df).collect()
    assert len(got) == 3 and {r.main_text for r in got if r.page_id == 2} == {""}
    assert extract_main_text(df.limit(0)).columns == ["page_id", "url", "main_text"]


def test_the_distribution_finds_unmarked_articles():
    """Pages without article marks or telling names: windows part the article from menus, notices and footers; single lines would not do."""
    r = random.Random(9)
    for _ in range(40):
        links = lambda n: "".join(f'<div><a href="/{i}">{prose(r, 3)}</a></div>' for i in range(n))
        article = [prose(r, r.choice([1, 4, 30, 60, 90])) for _ in range(r.randint(6, 14))]
        article[0], article[-1] = prose(r, 70), prose(r, 40)
        body = [f"<div>{x}</div>" for x in article]
        body.insert(3, links(1))  # a link of its own line between short and long paragraphs
        page = f"<body>{links(4)}<div>{prose(r, 2)}</div>{links(5)}{''.join(body)}{links(4)}<div>{prose(r, 3)}</div>{links(3)}</body>"
        text = main_text(page)
        got = text.split("\n\n")
        assert [x for x in got if x in article] == article and len(got) == len(article) + 1  # the link inside belongs to its region
    # without windows the link splits the article, and a short first part goes
    page = f"<body>{links(4)}<div>{prose(r, 3)}</div>{links(1)}<div>{prose(r, 90)}</div>{links(4)}</body>"
    assert main_text(page).count("\n\n") == 2 and main_text(page, BlockRules(window=1)).count("\n\n") == 0


def test_short_passages_of_marked_articles_stay():
    page = f"<body><article><p>{'word ' * 200}</p><nav><a href='/'>x</a></nav><div class='ads'>a b c</div><div class='ads'>a b c</div><div class='ads'>a b c</div><p>End.</p></article><p>outside the mark</p></body>"
    assert main_text(page).endswith("word\n\nEnd.")
