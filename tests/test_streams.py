import random

from pyspark.sql import functions as F

from storyloom.operators import cluster
from storyloom.streaming import flow

from .test_feeds import payloads


def test_ingest_equals_batch_and_is_idempotent(spark, tmp_path):
    land, store = str(tmp_path / "land"), str(tmp_path / "store")
    p = payloads(spark)
    p.write.parquet(land)
    for turn in range(2):
        q = flow.ingest(flow.valid_articles(flow.landed_payloads(spark, land)), store, str(tmp_path / "state"))
        q.awaitTermination(120)
        assert q.exception() is None
        p.where("source_id = 1").write.mode("append").parquet(land)  # the same feed is polled again
    got = {r.content_hash for r in spark.read.parquet(store).collect()}
    batch = {r.content_hash for r in flow.valid_articles(p).collect()}
    assert got == batch and spark.read.parquet(store).count() == len(batch) == 5


def test_windows_and_sessions(spark):
    rows = [(1, "world", 0), (1, "world", 5), (1, "world", 60), (2, "world", 7)]
    a = spark.createDataFrame(rows, "cluster_id long, category string, h long").withColumn("published_at", F.timestamp_seconds(F.col("h") * 3600))
    assert {(r.window.start.hour, r.articles) for r in flow.coverage_windows(a).collect()} == {(0, 2), (6, 1), (12, 1)}
    assert sorted((r.cluster_id, r.articles) for r in flow.story_sessions(a).collect()) == [(1, 1), (1, 2), (2, 1)]


def test_incremental_clusters(spark):
    schema = "id long, title string, category string, published_us long"
    old = spark.createDataFrame([(1, "council approves transit plan", "world", 0)], schema)
    new = spark.createDataFrame([(2, "council approves new transit plan", "world", 10), (3, "storm floods coast towns", "world", 20)], schema)
    links = spark.createDataFrame([(1, 1)], "id long, cluster_id long")
    got = {r.id: (r.cluster_id, r.method) for r in flow.assign_batch(new, old, links).collect()}
    assert got == {1: (1, "kept"), 2: (1, "lexical"), 3: (3, "seed")}


def test_cluster_stream_equals_one_pass(spark, tmp_path):
    """Batches in time order give the clusters of one pass over everything, also after a repeated batch; far older stories are not read."""
    schema, day = "id long, title string, category string, published_us long", 86_400_000_000
    rows = [(1, "council approves transit plan", "world", 0), (2, "council approves new transit plan", "world", 10), (3, "storm floods coast towns", "world", day), (4, "storm floods more coast towns", "general", 2 * day), (5, "council approves transit plan", "world", 9 * day)]
    land, store = str(tmp_path / "land"), str(tmp_path / "store")
    for batch in (rows[:1], rows[1:3], rows[1:3], rows[3:]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(land)
        q = flow.cluster_stream(spark.readStream.schema(schema).parquet(land), store, str(tmp_path / "state"))
        q.awaitTermination(120)
        assert q.exception() is None
    got = spark.read.parquet(store)
    assert got.count() == 5 and {r.id: r.cluster_id for r in got.collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    assert {r.id: r.cluster_id for r in cluster.greedy_clusters(spark.createDataFrame(rows, schema)).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    near = flow.open_clusters(cluster.cluster_table(got, got).where("cluster_id < 5"), 9 * day, 9 * day)
    assert near.count() == 0


def test_windows_and_sessions_of_a_stream(spark, tmp_path):
    """What a watermarked stream gives out is what the batch gives, but for spans that the watermark has not passed."""
    rows = [(1, "world", 0), (1, "world", 5), (1, "world", 60), (2, "world", 7), (9, "late", 1000)]
    a = spark.createDataFrame(rows, "cluster_id long, category string, h long").withColumn("published_at", F.timestamp_seconds(F.col("h") * 3600))
    land = str(tmp_path / "land")
    a.coalesce(1).write.parquet(land)
    for name, of in (("w", flow.coverage_windows), ("s", flow.story_sessions)):
        q = of(spark.readStream.schema(a.schema).parquet(land)).writeStream.format("memory").queryName(f"out_{name}").outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        got = {tuple(r) for r in spark.table(f"out_{name}").collect()}
        assert got == {tuple(r) for r in of(a.where("h < 1000")).collect()}


def test_shuffled_batches_equal_one_pass(spark, tmp_path):
    """Batches in any order within the lateness, with a repeated one, give the clusters of one pass; an article behind the watermark is placed late."""
    schema, hour, rng = "id long, title string, category string, published_us long", 3_600_000_000, random.Random(7)
    words = "council storm budget river bridge market school harbor train festival".split()
    rows = [(i, " ".join(rng.sample(words, 4)), rng.choice(("world", "general", "business")), rng.randrange(0, 72) * hour) for i in range(60)]
    rows[5] = (5, "to of", "world", rows[5][3])  # no informative token
    late_by = [(r, r[3] + rng.randrange(0, 18) * hour) for r in rows]
    come = [r for r, _ in sorted(late_by, key=lambda x: x[1])]
    land, store = str(tmp_path / "land"), str(tmp_path / "store")
    run = lambda: flow.cluster_stream(spark.readStream.schema(schema).parquet(land), store, str(tmp_path / "state"), lateness_hours=18)
    for batch in (come[:25], come[:25], come[25:]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(land)
        q = run()
        q.awaitTermination(120)
        assert q.exception() is None
    placed, waiting = spark.read.parquet(store), flow.waiting_clusters(spark, store)
    got = {r.id: r.cluster_id for r in placed.select("id", "cluster_id").unionByName(waiting.select("id", "cluster_id")).collect()}
    one = {r.id: r.cluster_id for r in cluster.greedy_clusters(spark.createDataFrame(rows, schema)).collect()}
    assert placed.count() + waiting.count() == 60 and 0 < waiting.count() < 60
    assert got == one and len(set(one.values())) < 50 and not placed.where("late").count()
    spark.createDataFrame([(100, rows[0][1], rows[0][2], 0)], schema).write.mode("append").parquet(land)
    q = run()
    q.awaitTermination(120)
    assert q.exception() is None
    assert [r.id for r in spark.read.parquet(store).where("late").collect()] == [100]
