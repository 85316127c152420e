import random
import re

import pytest
from pyspark.sql import functions as F

from storyloom.operators import entities, partials, score
from storyloom.streaming import lifecycle

HOUR = score.HOUR


def _world(spark):
    """Stories over 20 days; the first has a third of all articles."""
    rng = random.Random(3)
    rows = [(i, rng.choice((1, 1, 2, 3, 4)), rng.randrange(1, 6), rng.randrange(0, 480 * 60) * HOUR // 60) for i in range(300)]
    art = spark.createDataFrame(rows, "id long, cluster_id long, source_id long, published_us long")
    sources = spark.createDataFrame([(i, ("low", "medium", "high", "verified")[i % 4]) for i in range(1, 6)], "id long, trust_level string")
    clusters = spark.createDataFrame([(i, "world") for i in range(1, 5)], "cluster_id long, category string")
    return rows, art, sources, clusters


def _tuples(df):
    return sorted(tuple(sorted(r.asDict().items())) for r in df.collect())


def test_rescore_from_partials(spark, tmp_path):
    """Batches in any split, one of them written twice, give the scores of the whole table at a time within an hour, for touched stories only."""
    _, art, sources, clusters = _world(spark)
    store, members = str(tmp_path / "p"), art.select("id", "cluster_id")
    for name in ("0", "1", "1", "2"):
        partials.add_batch(members, art.where(F.col("id") % 3 == int(name)), store, name)
    as_of = 470 * HOUR + 17 * HOUR // 60
    touched = spark.createDataFrame([(1,), (3,), (3,), (None,)], "cluster_id long")
    got = _tuples(partials.rescore(spark, store, touched, clusters, sources, None, as_of))
    assert len(got) == 2 and got == _tuples(score.rescore_clusters(touched, clusters, members, art, sources, None, as_of))
    empty = spark.createDataFrame([(9,)], "cluster_id long")
    assert partials.rescore(spark, store, empty, clusters, sources, None, as_of).count() == 0


def _changes(rows, gap, as_of):
    out, times = set(), {}
    for _, c, _, t in rows:
        times.setdefault(c, []).append(t)
    for c, ts in times.items():
        ts.sort()
        cuts = [0] + [i for i in range(1, len(ts)) if ts[i] - ts[i - 1] > gap] + [len(ts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if ts[a] <= as_of:
                out.add((c, "opened", ts[a], None))
            if ts[b - 1] + gap <= as_of:
                out.add((c, "closed", ts[b - 1] + gap, b - a))
    return out


def test_story_changes_batch_and_stream(spark, tmp_path):
    """Spans of the batch equal brute force; the keyed state with timers gives the same changes for files in shuffled order within the lateness."""
    rows, art, _, _ = _world(spark)
    gap, land = 6 * HOUR, str(tmp_path / "land")
    batch = partials.story_changes(partials.hourly(art.select("id", "cluster_id"), art), gap, 1 << 60)
    got = {tuple(r) for r in batch.collect()}
    assert got == _changes(rows, gap, 1 << 60) and len(got) > 100
    rng = random.Random(5)
    come = [r for r, _ in sorted(((r, r[3] + rng.randrange(0, 20) * HOUR) for r in rows), key=lambda x: x[1])]
    come.append((999, 9, 1, 2000 * HOUR))  # lifts the watermark past everything else
    schema = art.schema
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, lifecycle.PROVIDER)
    try:
        for i, part in enumerate((come[:150], come[150:300], come[300:])):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(land)
            out = lifecycle.story_changes_stream(spark.readStream.schema(schema).parquet(land), gap, "20 hours")
            q = out.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            q.awaitTermination(180)
            assert q.exception() is None
    finally:
        spark.conf.set(key, old)
    streamed = [tuple(r) for r in spark.read.schema(lifecycle.CHANGES).parquet(str(tmp_path / "out")).collect()]
    assert len(streamed) == len(set(streamed)) and set(streamed) == _changes(rows, gap, 1 << 60)


@pytest.mark.parametrize("seed", [1, 2])
def test_nested_terms_equal_brute_force(spark, seed):
    """Terms within, across and beside each other, with signs at their ends, 400 of them."""
    rng = random.Random(seed)
    words = ["new", "york", "city", "c++", ".net", "st.", "o'hare", "été", "日本", "a_b", "7"]
    terms = sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(400)} | {"york", "new york", "++", "new-york"})
    texts = [rng.choice(("", "(", "x")).join(("", rng.choice((" ", "-", "  ", ", ", "s ")).join(rng.choice(words).title() for _ in range(rng.randrange(0, 9))))) for _ in range(40)] + [None, "", "York"]
    art = spark.createDataFrame([(i, t, "New York." if i % 7 == 0 else None) for i, t in enumerate(texts)], "id long, title string, summary string")
    names = spark.createDataFrame([(t,) for t in terms], "term string")
    got = {tuple(r) for r in entities.known_names(art, names).collect()}
    full = {i: f"{t or ''} {'New York.' if i % 7 == 0 else ''}".lower() for i, t in enumerate(texts)}
    want = {(i, t) for i, x in full.items() for t in terms if re.search(rf"(?<!\w){re.escape(t)}(?!\w)", x)}
    assert got == want and len(want) > 100
