import random
from collections import Counter
from zlib import crc32

import re

from storyloom.llm import spelling

from .helpers import docs

LETTERS = "abcdefgàéß÷"


def counts(rows, spoil, least_chars, least):
    out = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % spoil == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_chars:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= least}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, times):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words}


def test_groups_equal_brute_force(spark, monkeypatch):
    """Words of runs of equal letters, letters beyond ASCII, chains of forms, ties; batches that cut groups."""
    r = random.Random(4)
    base = ["".join(r.choice(LETTERS) for _ in range(r.choice([5, 6, 7, 12]))) for _ in range(25)] + ["aaaaaa", "aaabaa", "hellooo"]
    words = {}
    for w in base:
        words.setdefault(w, r.choice([1, 5, 30, 200]))
        for _ in range(12):
            i, c = r.randrange(len(w) + 1), r.choice(LETTERS)
            v = r.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]])
            words.setdefault(v, r.choice([1, 1, 5, 6, 30]))
    table = spark.createDataFrame([*words.items(), (None, 3), ("abc", None)], "word string, n long")
    monkeypatch.setitem(words, "abc", 0)
    del words["abc"]
    for batch in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = {tuple(x) for x in spelling.variant_groups(table, 5).collect()}
        assert got == brute(words, 5)
    assert any(x[1] and x[2] != x[1] for x in got)
    assert spelling.variant_groups(table.limit(0)).count() == 0


def test_counts_of_whole_texts(spark, monkeypatch):
    """Null, empty and long texts, a null id, repeated rows and a clashing column; pieces and tables far smaller than the texts."""
    monkeypatch.setattr(spelling, "PIECE_BYTES", 50)
    monkeypatch.setattr(spelling, "TABLE_WORDS", 10)
    r = random.Random(2)
    pool = ["".join(r.choice(LETTERS) for _ in range(r.randrange(1, 9))) for _ in range(60)]
    say = lambda n: "".join(r.choice(pool).title() + r.choice([" ", "-", "1", "Ā", "漢", "\n", "’"]) for _ in range(n))
    rows = [(i, say(r.choice([0, 3, 40]))) for i in range(40)] + [(None, say(20)), (50, None), (51, ""), (52, say(2000)), (52, "Déjà déjà DÉJÀ ×÷"), (52, "Déjà déjà DÉJÀ ×÷")]
    for spoil in (2, 199):
        out = spelling.count_words(docs(spark, rows).selectExpr("*", "1 as word", "2 as n"), spoil, 3, 2)
        assert {x.word: x.n for x in out.collect()} == counts(rows, spoil, 3, 2)
