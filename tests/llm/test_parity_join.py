import random

import pytest

from storyloom.llm import parity_join
from storyloom.operators import graph

from .helpers import docs, near_copies, words


def brute(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("k", "num", "small"), [(4, 85, 32), (2, 50, 0)])
def test_components_equal_brute_force(spark, monkeypatch, k, num, small):
    """small=0 sends every bucket through the tiles, here of two members each."""
    monkeypatch.setattr(parity_join, "SMALL_BUCKET", small)
    monkeypatch.setattr(parity_join, "TILE", 2 if small == 0 else 2048)
    rows = near_copies(k, 70)
    out = parity_join.jaccard_components(docs(spark, rows + rows[:3]), k, parity_join.Threshold(num, 100))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute(rows, k, num, 100)


def test_sketch_bounds_the_difference():
    import numpy as np

    r = np.random.default_rng(0)
    for n in (5, 50, 500):
        a = r.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[n // 5 :], r.integers(0, 2**63, n // 4).astype(np.uint64)])
        assert parity_join.hamming(parity_join.folded_sketch(a), parity_join.folded_sketch(b)) <= len(set(a) ^ set(b))


def test_edge_tables(spark):
    assert parity_join.jaccard_components(docs(spark, [])).count() == 0
    rows = spark.createDataFrame([(None, "a b c", 1, "x"), (1, None, 2, "x"), (2, "same words here now ok yes", 3, "x"), (3, "same words here now ok yes", 4, "x")], "doc_id long, text string, id long, key string")
    assert {r.doc_id: r.component_id for r in parity_join.jaccard_components(rows).collect()} == {1: 1, 2: 2, 3: 2}
    kept = parity_join.drop_near_duplicates(rows)
    assert kept.columns == rows.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "None"]


def test_thresholds_below_one_half_are_refused():
    for num, den in ((30, 100), (49, 100), (101, 100), (0, 1)):
        with pytest.raises(ValueError):
            parity_join.Threshold(num, den)


def test_clashing_columns_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = docs(spark, [(1, text), (2, text), (2, text), (3, None), (None, text)]).selectExpr("*", "1 as gone", "2 as q_gone", "3 as _gone", "4 as id", "5 as component_id")
    out = parity_join.drop_near_duplicates(df)
    assert out.columns == df.columns and sorted((r.doc_id or -1) for r in out.collect()) == [-1, 1, 3]


def test_hot_copies_equal_brute_force(spark, monkeypatch):
    """Every set of two or more copies is looked up as a hot one; a very long text is whole."""
    monkeypatch.setattr(graph, "HOT_ROWS", 1)
    rows = near_copies(11, 30)
    rows += [(1000 + i, rows[0][1]) for i in range(25)] + [(2000 + i, " ".join(f"x{j}" for j in range(60_000 + 500 * i))) for i in range(2)]
    out = parity_join.jaccard_components(docs(spark, rows), 4, parity_join.Threshold(85, 100))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute(rows, 4, 85, 100)


def test_a_chain_of_documents_in_any_order_is_one_component(spark):
    """Each of 81 documents is similar to the next only; the least id stands at one end and the others fall towards the other."""
    r = random.Random(3)
    words_, rows = [f"w{r.randrange(10**6)}" for _ in range(60 + 4 * 81)], []
    for i, doc_id in enumerate([0, *range(80, 0, -1)]):
        rows.append((doc_id, " ".join(words_[4 * i : 4 * i + 60])))
    out = parity_join.jaccard_components(docs(spark, rows), 4, parity_join.Threshold(85, 100)).collect()
    assert brute(rows, 4, 85, 100) == {x.doc_id: (x.n_shingles, x.component_id) for x in out}
    assert {x.component_id for x in out} == {0}
