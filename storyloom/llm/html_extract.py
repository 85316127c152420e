"""Main text of HTML pages by line-block distribution (operator 8).

Markup is stripped into one line per block element. A line weighs its text length, or nothing if it lies in page furniture (menus, footers, adverts,
forms, comments and the like), is mostly links, or stands outside the article of a page that marks one. Sums over a sliding window of lines
show where the text surges up from nothing and where it dives back, on every page. A region between a surge and a dive is the article's if its
fullest window has ``core_share`` of the page's fullest one, or if it lies in a marked article, of which no passage is too short; all lines from
its first to its last weighing line are kept, furniture aside. So marks and class names only help: without them the distribution parts
the article from menus, notices and footers that links or empty stretches set apart; unmarked passages of a few words that are set apart likewise go.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.DOTALL)
_RAW = ("script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "object", "canvas", "math", "audio", "video", "noframes", "xmp")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.IGNORECASE) for t in _RAW}
_FURNITURE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "fieldset", "head"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "input", "picture", "map", "area"}
#: Words of class and id names that mark page furniture (fixed values).
_NAMES = re.compile(r"(?:^|[^a-z])(?:ads?|adverts?|advertisements?|advertising|sponsors?|sponsored|promos?|promotions?|banners?|cookies?|consent|notices?|newsletters?|subscribe|sidebars?|menus?|nav|navbar|navigation|breadcrumbs?|footers?|comments?|disqus|replies|share|sharing|social|related|recommended|popups?|modals?|paywall|masthead|toolbar|pagination|pager|login|signup|widgets?)(?:$|[^a-z])")
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "alert", "dialog"}


@dataclass(frozen=True)
class BlockRules:
    """Lines summed in one window, the share of link text above which a line outside a marked article weighs nothing, and the share of the page's
    fullest window that a region's fullest one must have."""

    window: int = 3
    link_share: float = 0.5
    core_share: float = 0.05


def _is_furniture(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in _FURNITURE or tag == "header" and not in_article:
        return True
    if not attrs or tag in ("body", "html", "article", "main"):
        return bool(attrs) and tag == "article" and bool(re.search(r"\bcomment", attrs, re.IGNORECASE))
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in _ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
            return True
        if name in ("class", "id") and _NAMES.search(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()):
            return True
    return False


def lines_of(page: str) -> list[tuple[str, bool, bool, int]]:
    """(text, in furniture, in the article, link characters) of every block in page order."""
    out: list[tuple[str, bool, bool, int]] = []
    parts: list[str] = []
    links = 0
    stack: list[tuple[str, bool]] = []  # open elements within furniture, or the furniture itself
    article = in_link = 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                out.append((text, bool(stack), article > 0, links))
            parts.clear()
        links = 0

    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            parts.append(text)
            if in_link:
                links += len(text.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing, attrs = bool(m[1]), m[3]
        if tag in _RAW and not closing:
            end = _RAW_END[tag].search(page, at) if not attrs.rstrip().endswith("/") else None
            at = end.end() if end else at if attrs.rstrip().endswith("/") else len(page)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in _INLINE:
            flush()
        if tag == "a":
            in_link = 0 if closing else 1
        if tag in _VOID or tag in _INLINE and not stack and tag != "span":
            continue
        if closing:
            if stack and any(t == tag for t, _ in stack):
                if tag not in _INLINE or stack[-1][0] == tag:
                    flush() if stack[0][0] in _INLINE else None
                    while stack.pop()[0] != tag:
                        pass
            elif tag in ("article", "main"):
                article = max(0, article - 1)
        elif stack:
            if tag in ("article", "main") and not article and not any(t == "article" for t, _ in stack):
                stack.clear()  # furniture that was never closed
                article += 1
            else:
                stack.append((tag, False))
        elif _is_furniture(tag, attrs, article > 0):
            flush()
            stack.append((tag, True))
        elif tag in ("article", "main"):
            article += 1
    flush()
    return out


def main_text(page: str | None, rules: BlockRules = BlockRules()) -> str:
    """The kept blocks, joined by an empty line; empty if there are none."""
    lines = lines_of(page or "")
    marked = any(inside and not skip for _, skip, inside, _ in lines)
    weight = [0 if skip or (not inside if marked else links > rules.link_share * len(text)) else len(text) for text, skip, inside, links in lines]
    sums = [sum(weight[i : i + rules.window]) for i in range(len(weight))]
    core, kept, begin = rules.core_share * max(sums, default=0), [], None
    for i, s in enumerate([*sums, 0]):
        if begin is None and s > 0:
            begin = i  # surge
        elif begin is not None and s == 0:  # dive
            heavy = [j for j in range(begin, i) if weight[j]]
            if marked or max(sums[begin:i]) >= core:
                kept += [lines[j][0] for j in range(heavy[0], heavy[-1] + 1) if not lines[j][1] and (weight[j] or not marked)]
            begin = None
    return "\n\n".join(kept)


def extract_main_text(pages: DataFrame, html_col: str = "html", text_col: str = "main_text", rules: BlockRules = BlockRules()) -> DataFrame:
    """``pages`` without ``html_col`` and with ``text_col``: the whole page's main text, empty for a null, empty or text-less page.

    Rows and other columns are kept as they are; a column already named ``text_col`` is replaced. No shuffle.
    """
    keep = [c for c in pages.columns if c not in (html_col, text_col)]

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                text = pa.array([main_text(x.as_py(), rules) for x in part.column(len(keep))], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), text], names=[*keep, text_col])

    rows = pages.select(*keep, F.col(html_col).cast("string"))
    schema = rows.drop(html_col).withColumn(text_col, F.lit("")).schema
    return rows.mapInArrow(run, schema)
