import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storyloom.llm import decontaminate as D
from storyloom.llm import line_dedup as L
from storyloom.llm import line_quality as Q
from storyloom.llm import parity_join as P

from .helpers import docs, prose


def repeat_words(text):
    w = text.split()
    n = Counter(zip(w, w[1:], w[2:], strict=False))
    return len({j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)})


def test_line_quality(spark):
    r = random.Random(2)
    clean = "\n".join(prose(r, 30) + "." for _ in range(4))
    rows = [(1, clean), (2, None), (3, ""), (4, "a b c " * 40), (5, "\n".join(["x | y | z | w | v"] * 20) + "\n" + prose(r, 60) + "."), (6, clean + "\nClick here to join.\nno end"), (7, "same line here.\nsame line here.\n \n")]
    got = {x.doc_id: x for x in Q.line_quality(docs(spark, rows).withColumnRenamed("text", "t"), text_col="t").collect()}
    for i, t in rows:
        assert got[i].q_n_words == len((t or "").split()) and got[i].q_n_repeat_words == repeat_words(t or ""), i
    assert got[1].q_kept and got[1].q_clean_text == clean and not any(got[i].q_kept for i in (2, 3, 4, 5))
    assert got[6].q_lost_lines == 2 and got[6].q_clean_text == clean and got[7].q_n_dup_lines == 1
    assert Q.line_quality(docs(spark, [])).count() == 0


def test_repeated_words_of_long_texts(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("abcd") for _ in range(n))) for i, n in enumerate((0, 1, 2, 3, 40, 400))]
    both = []
    for bits in (20, 2):  # two bits of place send all but the smallest through the other sort
        monkeypatch.setattr(Q, "_PLACE_BITS", bits)
        both.append({x.doc_id: x.q_n_repeat_words for x in Q.line_quality(docs(spark, rows)).collect()})
    assert both[0] == both[1] == {i: repeat_words(t) for i, t in rows}


def test_line_dedup(spark):
    r = random.Random(5)
    shared, other = prose(r, 40), prose(r, 40)
    changed = " ".join([*shared.split(" ")[:-1], "Ende,"])
    rows = [(1, f"{prose(r, 12)}\n{shared}"), (2, f"{shared.upper()}!\nshort one\n{other}"), (3, f"{other}\n{prose(r, 15)}\n{shared}\nshort one"), (4, None), (5, ""), (None, shared), (6, changed)]
    df = docs(spark, rows).selectExpr("doc_id", "text", "1 as line", "'k' as key", "doc_id as id")
    got = {x.doc_id: x for x in L.dedup_lines(df).collect()}
    assert got[1].text == rows[0][1] and got[2].text == f"short one\n{other}" and got[3].text.split("\n")[1] == "short one" and got[3].q_removed_lines == 2
    assert got[4].text is None and got[5].text == "" and got[None].text == shared and got[4].q_n_lines == 0
    assert L.dedup_lines(docs(spark, [])).count() == 0
    groups = {(x.id, x.line): x.group for x in L.line_groups(docs(spark, rows)).collect()}
    assert groups[1, 1] == groups[2, 0] == groups[3, 2] and (2, 1) not in groups


def test_line_groups_equal_brute_force(spark):
    """Groups and the lines that stay are those of all pairs of distinct lines with the edit similarity: like lines together, others apart."""
    r = random.Random(9)
    lines = [prose(r, 25) for _ in range(15)]
    for i in range(25):
        w = lines[i % 15].split(" ")
        w[r.randrange(25)] = r.choice(["neu", w[0]])
        lines.append(" ".join(w))
    lines += [lines[3], lines[3].upper()]
    got = {x.id: x for x in L.line_groups(docs(spark, list(enumerate(lines)))).collect()}
    norm = [L.normal_line(t) for t in lines]
    assert norm == [" ".join("".join(c if c.isalnum() else " " for c in t.lower()).split()) for t in lines]
    group = list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            if slow_edits(norm[a], norm[b]) * 100 <= 20 * max(len(norm[a]), len(norm[b])):
                group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    for a in range(len(lines)):
        assert got[a].keep == (group[a] == a)
        assert all((got[a].group == got[b].group) == (group[a] == group[b]) for b in range(a))


def slow_edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def test_edit_distance_and_alike():
    r = random.Random(4)
    for _ in range(300):
        a, b = ("".join(r.choice("ab é") for _ in range(r.randint(0, 90))) for _ in range(2))
        if r.random() < 0.6:
            b = a[: len(a) // 3] + b[: r.randint(0, 6)] + a[len(a) // 3 + r.randint(0, 6) :]
        assert L.edit_distance(a, b) == slow_edits(a, b)
        assert L.alike(a, b, 80) == (slow_edits(a, b) <= max(len(a), len(b)) * 20 // 100)


def test_edit_distances_of_many_pairs(monkeypatch):
    """Texts of none to four words of 64 letters and beyond, some of them alike, in small groups."""
    monkeypatch.setattr(L, "VECTOR_PAIRS", 7)
    monkeypatch.setattr(L, "VECTOR_CHARS", 200)
    monkeypatch.setattr(L, "VECTOR_LEAST", 0)
    r, pairs = random.Random(14), []
    for n in [*range(0, 260, 9), 63, 64, 65, 127, 128, 129]:
        a = [r.choice("abcé漢 ") for _ in range(n)]
        b = [x if r.random() < 0.8 else r.choice("abé") for x in a[: r.randint(0, n)]] + [r.choice("xyz") for _ in range(r.choice([0, 5, 80]))]
        pairs += [("".join(a), "".join(b)), ("".join(b), "".join(a))]
    with np.errstate(over="ignore"):
        want = [slow_edits(a, b) for a, b in pairs]
        assert L.edit_distances(pairs) == want
        most = [max(len(a), len(b)) // 5 for a, b in pairs]
        got = L.edit_distances(pairs, most)
        assert [min(d, k + 1) for d, k in zip(got, most, strict=True)] == [min(d, k + 1) for d, k in zip(want, most, strict=True)]


def test_simhash_of_long_runs():
    r = np.random.default_rng(3)
    h = r.integers(0, 1 << 64, 4000, dtype=np.uint64)
    first = np.array([0, 1, 255, 256, 511, 900, 1700])
    with np.errstate(over="ignore"):
        got = L.simhash(h, first)
        for part, x in zip(got, (h, L.mix64(h ^ L.STEP)), strict=True):
            for i, (a, b) in enumerate(zip(first, [*first[1:], len(h)], strict=True)):
                assert int(part[i]) == sum(1 << k for k in range(64) if 2 * sum(int(v) >> k & 1 for v in x[a:b]) > b - a)


def test_line_dedup_of_odd_tables(spark):
    """Clashing columns, repeated ids, one very long line and a text of many lines."""
    r = random.Random(6)
    line, long_, many = prose(r, 30), prose(r, 30000), "\n".join(prose(r, 8) for _ in range(3000))
    rows = [(1, line), (1, line), (2, f"x\n{line}\n{line}"), (3, long_), (4, long_ + " ende"), (5, many), (6, "\n" + many), (7, "  \n\t")]
    df = docs(spark, rows).selectExpr("doc_id", "text", "1 as id", "2 as _id", "3 as gone", "4 as key", "5 as line", "6 as q_gone", "7 as at", "8 as said", "9 as bucket")
    out = L.dedup_lines(df)
    assert out.columns == [*df.columns, "q_n_lines", "q_removed_lines"]
    got = {x.doc_id: x for x in out.collect()}
    assert out.where("doc_id = 1 and text is not null").count() == 2 and got[1].text == line
    assert got[2].text == "x" and got[2].q_removed_lines == 2 and (got[2]._id, got[2].gone, got[2].q_gone) == (2, 3, 6)
    assert got[3].text == long_ and got[4].text == ""
    assert got[6].text == "" and got[6].q_n_lines == 3001 and got[7].text == "  \n\t"


def test_line_groups_hold_every_pair_of_like_lines(spark, monkeypatch):
    """Lines of 5 to 60 words and copies with changed, added and left out words: edit similarity alone decides, not the SimHash."""
    r = random.Random(12)
    lines = []
    for i in range(60):
        w = prose(r, (5, 7, 10, 14, 20, 30, 60)[i % 7]).split(" ")
        lines.append(" ".join(w))
        for _ in range(1 + len(w) // 12):
            k = r.randrange(len(w))
            w[k : k + 1] = r.choice([["bedeutend"], [], [w[k], "neu"]])
        lines.append(" ".join(w))
    norm = [" ".join("".join(c if c.isalnum() else " " for c in t.lower()).split()) for t in lines]
    ids = spark.createDataFrame(list(enumerate(norm)), "i int, t string")
    pairs = ids.selectExpr("i as a", "t as x").join(ids.selectExpr("i as b", "t as y"), F.expr("a < b"))
    near = pairs.where("levenshtein(x, y) * 100 <= 20 * greatest(length(x), length(y)) and size(split(x, ' ')) >= 5 and size(split(y, ' ')) >= 5").select("a", "b").collect()
    assert len(near) >= 40
    for small in (32, 1):  # the second time every bucket is compared in tiles
        monkeypatch.setattr(L, "SMALL_BUCKET", small)
        monkeypatch.setattr(L, "TILE", 2)
        got = {x.id: x.group for x in L.line_groups(docs(spark, list(enumerate(lines)))).collect()}
        assert not [(a, b) for a, b in near if got[a] != got[b]]
        assert len(set(got.values())) >= 55


def slow_tiles(p, t, least):
    """Greedy string tiling by comparing every pair of places."""
    fp, ft, total = [True] * len(p), [True] * len(t), 0
    while True:
        best, found = least, []
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and fp[i + n] and ft[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best:
                    found.append((i, j))
        if not found:
            return total
        for i, j in found:
            if all(fp[i : i + best]) and all(ft[j : j + best]):
                fp[i : i + best] = ft[j : j + best] = [False] * best
                total += best


def test_tiles_equal_greedy_string_tiling():
    r = random.Random(1)
    for _ in range(150):
        p = [r.randrange(6) for _ in range(r.randint(0, 30))]
        t = [r.randrange(6) for _ in range(r.randint(0, 60))]
        if p and r.random() < 0.7:
            k = r.randrange(len(p))
            t[5:5] = p[k:] + p[:k]
        a, b = (np.array(x, dtype=np.uint64) * np.uint64(0x9E37) + np.uint64(5) for x in (p, t))
        with np.errstate(over="ignore"):
            found = D.tiles(a, b, 3)
        covered = [False] * len(p)
        for i, j, n in found:
            assert n >= 3 and p[i : i + n] == t[j : j + n] and not any(covered[i : i + n])
            covered[i : i + n] = [True] * n
        assert sum(covered) == slow_tiles(p, t, 3)


def test_decontaminate(spark):
    r = random.Random(7)
    items = [(k, prose(r, 40)) for k in range(5)] + [(9, None), (8, "too few")]
    w = items[0][1].split(" ")
    moved = " ".join(w[25:] + w[:25])
    rows = [(1, prose(r, 100)), (2, prose(r, 30) + " " + items[1][1].upper() + " " + prose(r, 9)), (3, moved + " " + prose(r, 50)), (4, " ".join(w[:12]) + " " + prose(r, 50)), (5, None), (6, ""), (None, items[2][1]), (7, "too few")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: x for x in D.decontaminate(docs(spark, rows), bench).collect()}
    assert {i for i, x in got.items() if x.contaminated} == {2, 3} and got[2].item_ids == [1] and got[3].item_ids == [0] and got[3].coverage_percent == 100
    assert 0 < got[4].coverage_percent < 60 or got[4].coverage_percent == 0
    kept = D.drop_contaminated(docs(spark, rows), bench)
    assert {x.doc_id for x in kept.collect()} == {1, 4, 5, 6, 7, None}
    assert not any(x.contaminated for x in D.decontaminate(docs(spark, rows), bench.limit(0)).collect())
    assert D.decontaminate(docs(spark, []), bench).count() == 0


def test_decontaminate_finds_repetitive_items(spark):
    """Ten times one phrase of four words has four distinct seeds, but tiles cover all its words."""
    r = random.Random(8)
    item = " ".join(["row your boat gently"] * 10)
    rows = [(1, f"{prose(r, 20)} {item} {prose(r, 20)}"), (2, prose(r, 80)), (3, f"{prose(r, 20)} row your boat gently row {prose(r, 20)}")]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {x.doc_id: (x.contaminated, x.coverage_percent) for x in D.decontaminate(docs(spark, rows), bench).collect()}
    assert got[1] == (True, 100.0) and not got[2][0] and not got[3][0]


def test_decontaminate_of_odd_tables(spark):
    """Clashing columns, repeated ids, a very long text and repeated items."""
    r = random.Random(10)
    item, long_ = prose(r, 40), prose(r, 40000)
    rows = [(1, item), (1, item), (2, f"{long_} {item}"), (3, long_)]
    df = docs(spark, rows).selectExpr("*", "1 as _gone", "2 as _id", "3 as id", "4 as item", "5 as q_gone", "6 as contaminated")
    bench = spark.createDataFrame([(1, item), (1, item), (2, item), (None, item)], "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as seed")
    kept = D.drop_contaminated(df, bench)
    assert kept.columns == df.columns and [x.doc_id for x in kept.collect()] == [3]
    got = D.decontaminate(df, bench).collect()
    assert sorted((x.doc_id, x.contaminated, tuple(x.item_ids)) for x in got) == [(1, True, (1, 2)), (1, True, (1, 2)), (2, True, (1, 2)), (3, False, ())]


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    r = random.Random(18)
    item, clean, line = prose(r, 40), prose(r, 60), prose(r, 30)
    rows = [(1, item), (1, clean), (2, f"{line}\nshort"), (2, f"other\n{line}"), (2, f"other\n{line}"), (3, line)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {(x.doc_id, x.text == item, x.contaminated) for x in D.decontaminate(docs(spark, rows[:2]), bench).join(docs(spark, rows[:2]), "doc_id").collect()} >= {(1, True, True)}
    assert [x.text for x in D.drop_contaminated(docs(spark, rows[:2]), bench).collect()] == [clean]
    got = sorted(x.text for x in L.dedup_lines(docs(spark, rows[2:])).collect())
    assert sum(line in t for t in got) in (1, 2) and len(set(t for t in got if line in t)) == 1 and len(got) == 4
    kept = P.drop_near_duplicates(docs(spark, [(1, clean), (1, item), (2, clean), (2, clean), (3, item + " ende"), (4, None), (4, ""), (None, clean)]), 5)
    assert sorted((x.doc_id or 0, x.text) for x in kept.where("text is not null").collect()) == sorted([(0, clean), (1, clean), (1, item), (4, "")]) and kept.count() == 5


def test_line_quality_keeps_clashing_columns(spark):
    df = docs(spark, [(1, "a b c.\n" * 30)]).selectExpr("doc_id", "text", "1 as _t", "2 as _w", "3 as _near", "4 as q_t", "5 as q_near", "6 as _low")
    out = Q.line_quality(df)
    row = out.first()
    assert out.columns[: len(df.columns)] == df.columns and (row._t, row._w, row._near, row.q_t, row.q_near, row._low) == (1, 2, 3, 4, 5, 6)
    assert row.q_n_words == 90 and row.q_n_repeat_words == 90


def changed_line(r, w, kind, share):
    w = list(w)
    if kind == "letter":
        return [x[: (k := r.randrange(len(x)))] + r.choice("qvwxyz") + x[k + 1 :] if i % share == 0 else x for i, x in enumerate(w)]
    for _ in range(max(1, len(w) * share // 100)):
        k = r.randrange(len(w))
        w[k : k + 1] = {"replace": ["".join(r.choice("qvwxyz") for _ in range(5))], "insert": [w[k], "neu"], "delete": [] if len(w) > 5 else [w[k]]}[kind]
    return w


@pytest.mark.parametrize(("low", "high"), [(5, 9), (10, 19), (20, 39), (40, 99), (100, 250)])
def test_like_lines_meet(low, high):
    """Of pairs with 80 % edit similarity, nine in ten share a key and lie near enough: one letter changed in every third, fourth or fifth word, and up to
    15 % of the words replaced, added or left out."""
    r, rule = random.Random(low), L.LineRule()
    vocabulary = ["".join(r.choice("aeioulnrst") for _ in range(r.choice([1, 2, 3, 3, 4, 5, 6, 7, 9]))) for _ in range(20_000)]
    for kind, share in (("letter", 3), ("letter", 4), ("letter", 5), ("replace", 10), ("replace", 15), ("insert", 15), ("delete", 15)):
        made = []
        for _ in range(200):
            w = [r.choice(vocabulary) for _ in range(r.randint(low, high))]
            made.append((" ".join(w), " ".join(changed_line(r, w, kind, share))))
        like = L.alike_many(made, rule.similarity_percent)
        pairs = [z for (x, y), yes in zip(made, like, strict=True) if yes and x != y for z in (x, y)]
        assert len(pairs) > 100
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(pairs))), pa.array(pairs), pa.array(range(len(pairs)))], names=["id", "text", "fp"])
        rows = [x for b in L._lines(rule)([batch]) for x in b.to_pylist()]
        met = 0
        for x, y in zip(rows[::2], rows[1::2], strict=True):
            far = sum(((x[c] ^ y[c]) & (1 << 64) - 1).bit_count() for c in ("s1", "s2"))
            met += bool(set(x["anchors"]) & set(y["anchors"])) and far <= rule.far and L.share_words(*(L.bag(pairs[z["id"]]) for z in (x, y)), rule.shared_percent)
        assert met * 10 >= 9 * len(rows) // 2, (kind, share, met, len(rows) // 2)


def test_groups_do_not_depend_on_the_size_of_buckets(spark, monkeypatch):
    """The same lines, paired by a join and in tiles of two members."""
    r = random.Random(21)
    base = [prose(r, 20) for _ in range(6)]
    rows = [(i, " ".join(changed_line(r, base[i % 6].split(" "), r.choice(["letter", "replace"]), 4 if i % 2 else 10))) for i in range(60)]
    found = []
    for small, tile in ((1_000, 2_048), (0, 2)):
        monkeypatch.setattr(L, "SMALL_BUCKET", small)
        monkeypatch.setattr(L, "TILE", tile)
        found.append({x.id: x.group for x in L.line_groups(docs(spark, rows)).collect()})
    assert found[0] == found[1]


def test_shared_words_and_cut_distances_of_many_pairs(monkeypatch):
    r = random.Random(11)
    lines = [" ".join(r.choice(("a", "a", "bb", "ccc", "dé", "e")) for _ in range(r.randrange(1, 14))) for _ in range(50)]
    i, j = (np.array(x) for x in zip(*[(x, y) for x in range(50) for y in range(50)], strict=True))
    assert L.Bags(lines).share(i, j, 50).tolist() == [L.share_words(L.bag(lines[x]), L.bag(lines[y]), 50) for x, y in zip(i, j, strict=True)]
    # long unlike pairs go before their texts end, like ones get their distances
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    pairs = [(text(700), text(760)) for _ in range(40)]
    pairs += [(x, x[: 11 * k] + text(k) + x[13 * k :]) for x, k in ((text(650), k) for k in range(40))]
    most = [max(map(len, p)) // 5 for p in pairs]
    columns, least = [], L._least
    monkeypatch.setattr(L, "_least", lambda *a: (columns.append(a[8]), least(*a))[1])
    monkeypatch.setattr(L, "VECTOR_LEAST", 0)
    got, want = L.edit_distances(pairs, most), [L.edit_distance(*p) for p in pairs]
    assert [d if w <= m else d > m for d, w, m in zip(got, want, most, strict=True)] == [w if w <= m else True for w, m in zip(want, most, strict=True)]
    columns.clear()
    assert min(L.edit_distances(pairs[:40], most[:40])) > 140 and max(columns) < 600
    assert L.TILE <= 512


def test_unlike_lines_of_a_bucket_are_dropped_before_their_texts_are_read(spark, monkeypatch):
    """Lines that have two long words and few others in common share a bucket; their sketches show it, so no text of theirs is read again."""
    r = random.Random(31)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    unlike = ["unmistakable circumstances " + " ".join(word() for _ in range(12)) for _ in range(80)]
    like = prose(r, 30)
    rows = list(enumerate([*unlike, like, like + " ende"]))
    read = []
    real = L.Scratch.put
    monkeypatch.setattr(L.Scratch, "put", lambda self, df, name: (out := real(self, df, name), read.append(out.count()) if name.endswith("-said") else None)[0])
    for small in (1_000, 0):
        monkeypatch.setattr(L, "SMALL_BUCKET", small)
        read.clear()
        got = {x.id: x.group for x in L.line_groups(docs(spark, rows)).collect()}
        assert got[80] == got[81] and len(set(got.values())) == 81 and sum(read) <= 40


def test_parity_of_words_drops_no_pair_that_shares_half_of_them():
    r, rule = random.Random(5), L.LineRule()
    lines = [" ".join(r.choice(("a", "b", "cc", "ddd", "eee", "f", "gg", "hh", "ii")) for _ in range(r.randrange(5, 60))) for _ in range(120)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(120)), pa.array(lines), pa.array(range(120))], names=["id", "text", "fp"])
    rows = [x for b in L._lines(rule)([batch]) for x in b.to_pylist()]
    for x, u in zip(rows, lines, strict=True):
        assert x["words"] == len(u.split())
        for y, v in zip(rows, lines, strict=True):
            if L.share_words(L.bag(u), L.bag(v), rule.shared_percent):
                assert ((x["odd"] ^ y["odd"]) & (1 << 64) - 1).bit_count() <= x["words"] + y["words"] - 2 * -(-max(x["words"], y["words"]) * rule.shared_percent // 100)


def test_keys_texts_and_pairs_go_in_turns(spark, monkeypatch):
    """No table holds the keys of all lines, and texts and pairs that go in turns give the same groups."""
    r = random.Random(41)
    base = [prose(r, 20) for _ in range(5)]
    rows = [(i, " ".join(changed_line(r, base[i % 5].split(" "), "letter", 4))) for i in range(40)] + [(100 + i, prose(r, 8 + i)) for i in range(20)]
    put, real = [], L.Scratch.put
    monkeypatch.setattr(L.Scratch, "put", lambda self, df, name: (out := real(self, df, name), put.append((name, out.count())))[0])
    want = {x.id: x.group for x in L.line_groups(docs(spark, rows)).collect()}
    buckets = [n for name, n in put if name == "buckets"]
    assert len(buckets) == L.PASSES and max(buckets) < 0.6 * sum(buckets)
    monkeypatch.setattr(L, "LIGHT", 0)
    monkeypatch.setattr(L, "TURN_PAIRS", 1)
    for small in (1_000, 0):
        monkeypatch.setattr(L, "SMALL_BUCKET", small)
        put.clear()
        assert {x.id: x.group for x in L.line_groups(docs(spark, rows)).collect()} == want
        assert [name for name, _ in put].count("first-said") == L.PASSES


def test_lines_of_a_large_bucket_meet_only_lines_of_about_their_length(spark, monkeypatch):
    """Each line is copied into the tiles of its class of lengths and the next ones, not into those of all parts of its bucket."""
    monkeypatch.setattr(L, "TILE", 4)
    lines = [(7, 8 * i + j, 3 ** (i + 3) + j, 0, 0, 0, 10) for i in range(6) for j in range(8)]
    large = spark.createDataFrame(lines, "bucket long, key long, chars int, s1 long, s2 long, odd long, words int")
    labels = spark.createDataFrame([], "id long, component long")
    monkeypatch.setattr(L, "_near", lambda rule, x, y: (F.lit(True), F.lit(0).alias("apart")))
    got = {(x.a, x.b) for x in L._tiled(large, labels, L.LineRule()).collect()}
    assert got >= {(a[1], b[1]) for a in lines for b in lines if a[1] < b[1] and min(a[2], b[2]) * 100 >= max(a[2], b[2]) * 80}
    assert len(got) < 400  # 1,128 where every two lines of the bucket meet
