"""Steps that must not grow faster than their input, and texts on which engines differ."""

import itertools
import random

from pyspark.sql import functions as F

import pytest

from storyloom.functions import text as X
from storyloom.operators import brief, cluster, dedup, postings
from storyloom.plans import desk_queries, model, story_queries

HOUR = 3_600_000_000


def test_frequent_words_alone_bring_no_titles_together(spark):
    # one word in every set; only planted neighbours may meet
    rows = [(i, sorted({"everywhere", f"own{i}", f"rare{i}", f"odd{i}"})) for i in range(200)] + [(1000 + i, sorted({"everywhere", f"own{i}", f"rare{i}", f"other{i}"})) for i in range(5)]
    keys = dedup.pair_keys(spark.createDataFrame(rows, "set_id long, tokens array<string>"), 35, guard=True)
    met = keys.alias("x").join(keys.alias("y"), "key").where("x.set_id < y.set_id").select("x.set_id", "y.set_id").distinct()
    assert sorted(map(tuple, met.collect())) == [(i, 1000 + i) for i in range(5)]


def test_pairs_of_token_sets_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["a1", "b2", "c3", "d4", "e5", "f6", "g7", "h8"]
    sets = sorted({tuple(sorted(rng.sample(words, rng.randint(1, 8)))) for _ in range(120)})
    df = spark.createDataFrame([(i, list(s)) for i, s in enumerate(sets)], "set_id long, tokens array<string>").cache()
    for percent, guard in ((35, True), (35, False), (20, False), (85, False)):
        want = set()
        for (i, x), (j, y) in itertools.combinations(enumerate(sets), 2):
            both, either = len(set(x) & set(y)), len(set(x) | set(y))
            if both * 100 >= either * percent and not (guard and both <= 1 and either >= 4):
                want.add((i, j, both, either))
        assert set(map(tuple, dedup.token_set_pairs(df, percent, guard).collect())) == want


def test_old_clusters_are_not_replicated_to_windows_without_articles(spark, monkeypatch):
    day = 24 * HOUR
    clusters = spark.createDataFrame([(i, f"harbour storm warning {i}", "world", 0, 2000 * day) for i in range(20)] + [(99, "flood", "world", 1999 * day, 2000 * day)], "cluster_id long, title string, category string, first_us long, last_us long")
    articles = spark.createDataFrame([(1000, "harbour storm warning 3", "world", 2000 * day), (1001, "flood", None, 2001 * day), (1002, "unlike", "world", 2000 * day)], "id long, title string, category string, published_us long")
    stored, rows = cluster.Scratch.put, {}

    def put(self, df, name):
        out = stored(self, df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(cluster.Scratch, "put", put)
    found = {r["id"]: r["cluster_id"] for r in cluster.best_clusters(articles, clusters).collect()}
    assert found == {1000: 0, 1001: 99}  # a number of one digit is no token
    assert rows["clusters"] <= 2 * 21


def test_lead_keeps_a_full_stop_before_a_line_end(spark):
    articles = spark.createDataFrame([(1, 1, "t", "First one.\n", 0), (2, 1, "u", "Second one.. ", 1)], "id long, source_id long, title string, content string, published_us long")
    members = articles.select(F.col("id").alias("cluster_id"), "id")
    sources = spark.createDataFrame([(1, "src1", "low")], "id long, name string, trust_level string")
    leads = {r["id"]: r["lead"] for r in brief.evidence_articles(members, articles, sources).collect()}
    assert leads == {1: "First one.\n", 2: "Second one"}


def test_a_time_is_cut_into_parts_once(spark):
    parsed = spark.createDataFrame([("Fri, 05 Jan 2024 10:00:00 GMT",)], "raw string").select(X.parse_time(F.col("raw"), F.lit("2024-01-05 00:00:00").cast("timestamp")).alias("t"))
    assert parsed._jdf.queryExecution().analyzed().toString().count("[AaPp](?=") <= 4  # over 20 before


def test_postings_are_rows_for_blocks_of_texts(spark, tmp_path):
    texts = spark.createDataFrame([(i, "harbour", "storm") for i in range(500)], "id long, title string, summary string").coalesce(1)
    postings.add_batch(texts, str(tmp_path / "p"), "0")
    runs = {t[i : i + k] for t in ("harbour", "storm") for k in (0, 1, 2, 3) for i in range(len(t) - k + 1)}
    rows = spark.read.parquet(str(tmp_path / "p")).select("run", F.size("ids").alias("n")).collect()
    assert {r["run"] for r in rows} == runs and len(rows) == len(runs) and {r["n"] for r in rows} == {500}
    counts = spark.read.parquet(str(tmp_path / "p-counts")).select("run", "n").collect()
    assert dict(map(tuple, counts)) == dict.fromkeys(runs, 500)


def test_texts_are_measured_before_the_join(spark):
    plan = model.articles(spark, "/root/testdata/sf0.001").select("id", "content_chars")._jdf.queryExecution().optimizedPlan().toString()
    top, below = plan.split("Join", 1)
    assert "length(text" in below and "text" not in top


@pytest.mark.parametrize("query", [story_queries.state_transitions, desk_queries.package_flags])
def test_shared_steps_are_stored(spark, query):
    assert "Join" not in query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_a_slice_of_the_ordered_pass_reads_its_own_folder(spark, monkeypatch):
    from pyspark.sql.readwriter import DataFrameReader

    from storyloom.operators import cluster

    paths, parquet = [], DataFrameReader.parquet
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, *p, **o: (paths.extend(p), parquet(self, *p, **o))[1])
    rows = [(i, "quake hits harbor town", "world", i * 13 * 3_600_000_000) for i in range(4)]
    got = {r["id"]: r["cluster_id"] for r in cluster.greedy_clusters(spark.createDataFrame(rows, "id long, title string, category string, published_us long")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0}
    of = lambda name: [p.split(f"/clusters-{name}-")[1].partition("/")[2] for p in paths if f"/clusters-{name}-" in p]
    assert of("sliced") == [f"k={k}" for k in range(4)] and sorted(of("reach")) == ["", *(f"k={k}" for k in range(4))]


def test_sets_that_share_only_their_last_tokens_are_no_candidates(spark, monkeypatch):
    """Sets of six tokens of their own and four common ones share keys, but too late in their order to be similar; two similar sets are found."""
    from storyloom.operators import dedup

    rows = [(i, sorted([f"own{i}{x}" for x in "abcdef"] + ["common", "frequent", "ordinary", "usual"])) for i in range(20)]
    rows.append((50, sorted([*(t for t in rows[0][1] if t != "own0a"), "other"])))
    seen, verified = [], dedup.verified
    monkeypatch.setattr(dedup, "verified", lambda pairs, *a: (seen.append(pairs), verified(pairs, *a))[1])
    got = dedup.token_set_pairs(spark.createDataFrame(rows, "set_id long, tokens array<string>"), 35, guard=True).collect()
    assert [(x.a, x.b, x.n_both, x.n_either) for x in got] == [(0, 50, 9, 11)] and seen[0].count() == 1


def test_similar_sets_are_tied_by_slices_that_have_articles(spark):
    """A title that lives in many slices is not multiplied by all titles like it: those that have an article in the slice are looked up."""
    from storyloom.operators import cluster
    from storyloom.operators.graph import Scratch

    hour, scratch, n, seen = cluster.HOUR, Scratch(spark, "reach"), 30, {}
    put = scratch.put
    scratch.put = lambda df, name: seen.setdefault(name, put(df, name))
    cells = spark.createDataFrame([(0, "world", k) for k in range(n)] + [(i, "world", i) for i in range(1, n)], "set_id long, category string, k long")
    near = spark.createDataFrame([(0, i) for i in range(1, n)] + [(i, 0) for i in range(1, n)] + [(i, i) for i in range(n)], "a long, b long")
    out = cluster._reach(cells, cells.limit(0), near, scratch, 12 * hour, 48 * hour)
    assert out.select("k", "component").distinct().count() == n
    # similar sets by the slices of the second one, not (0, b) for each of the thirty slices of 0
    assert seen["met"].count() == (n - 1) + (n - 1) * n + n + (n - 1)
    scratch.close()
