"""Partial aggregates per story and hour (T1, T9, T10, R4): counts, bounds and sources that merge, a store of them that grows by batches, scores of
touched stories from the store, and the spans of coverage of every story.

A batch adds rows for its own (story, hour) pairs; rows of one pair merge by sum, min, max and union, so a story of a third of all articles is as
many rows as it has hours, times the batches that touched them. The windows of the scores don't end on full hours, so the articles of the two
hours in which they begin are counted one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .score import HOUR, corroboration_of, signals

BUCKETS = 64
DAY = 24 * HOUR
PARTIAL = "cluster_id long, hour long, n long, first_us long, last_us long, sources array<long>"
_ROW = "cluster_id long, published_us long"


def _bucket() -> Column:
    return F.pmod(F.xxhash64("cluster_id"), F.lit(BUCKETS)).cast("int")


def hourly(members: DataFrame, articles: DataFrame) -> DataFrame:
    """(cluster_id, hour, n, first_us, last_us, sources) of articles (id, published_us, source_id) with a publish time; one shuffle, combined before it."""
    rows = members.join(articles.select("id", "published_us", "source_id"), "id").where("published_us is not null")
    per = rows.groupBy("cluster_id", F.floor(F.col("published_us") / HOUR).alias("hour"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.min("published_us").alias("first_us"), F.max("published_us").alias("last_us"), F.array_sort(F.collect_set("source_id")).alias("sources"))


def merged(partials: DataFrame) -> DataFrame:
    """One row for each story and hour."""
    union = F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources")
    return partials.groupBy("cluster_id", "hour").agg(F.sum("n").alias("n"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), union)


def add_batch(members: DataFrame, articles: DataFrame, store: str, name: str) -> None:
    """Add a batch of articles and their stories to ``store``; the same ``name`` again replaces it. An article is in one batch and keeps its story; a
    full rebuild starts another store. Partial rows lie by story, the articles' times, in ``<store>-rows``, by day."""
    hourly(members, articles).withColumn("bucket", _bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/batch={name}")
    rows = members.join(articles.select("id", "published_us"), "id").where("published_us is not null").select("cluster_id", "published_us")
    rows.withColumn("day", F.floor(F.col("published_us") / DAY).cast("int")).write.mode("overwrite").partitionBy("day").parquet(f"{store}-rows/batch={name}")


def read_partials(spark: SparkSession, store: str, touched: DataFrame | None = None) -> DataFrame:
    """Merged rows of all stories, or of ``touched`` (cluster_id, unique): only their buckets are read."""
    rows = spark.read.schema(f"{PARTIAL}, batch string, bucket int").parquet(store)
    if touched is not None:
        buckets = [r[0] for r in touched.select(_bucket()).distinct().collect()]  # at most BUCKETS numbers
        rows = rows.where(F.col("bucket").isin(buckets)).join(touched, "cluster_id", "left_semi")
    return merged(rows)


def rescore(spark: SparkSession, store: str, touched: DataFrame, clusters: DataFrame, sources: DataFrame, mentions: DataFrame | None, as_of_us: int) -> DataFrame:
    """What ``score_clusters`` gives for the clusters in ``touched``, from the store: reads their buckets and the days of the two hours in which the
    windows of 6 and 12 hours begin, never all members. A cluster without articles in the store has none."""
    ids = touched.select("cluster_id").where("cluster_id is not null").distinct()
    since, before = as_of_us - 6 * HOUR, as_of_us - 12 * HOUR
    h_since, h_before = since // HOUR, before // HOUR
    partials = read_partials(spark, store, ids)
    n_if = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    hour, t = F.col("hour"), F.col("published_us")
    whole = partials.groupBy("cluster_id").agg(
        F.sum("n").alias("article_count"), n_if(hour > h_since).alias("w_recent"), n_if((hour > h_before) & (hour < h_since)).alias("w_previous"),
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
    )
    days = sorted({since // DAY, before // DAY})
    rows = spark.read.schema(f"{_ROW}, batch string, day int").parquet(f"{store}-rows").where(F.col("day").isin(days))
    edge = rows.where(F.floor(t / HOUR).isin([h_since, h_before]) & (t >= before)).join(ids, "cluster_id", "left_semi")
    edge = edge.groupBy("cluster_id").agg(F.sum((t >= since).cast("long")).alias("e_recent"), F.sum((t < since).cast("long")).alias("e_previous"))
    plus = lambda c: (F.col(f"w_{c}") + F.coalesce(f"e_{c}", F.lit(0))).alias(c)
    cover = whole.join(edge, "cluster_id", "left").select("cluster_id", "article_count", plus("recent"), plus("previous"), "first_us", "last_us")
    pairs = partials.select("cluster_id", F.explode("sources").alias("source_id")).distinct()
    only = lambda df: df.join(ids, "cluster_id", "left_semi")
    return signals(only(clusters), cover, corroboration_of(pairs, sources), None if mentions is None else only(mentions), as_of_us)


def spans(partials: DataFrame, gap_us: int) -> DataFrame:
    """(cluster_id, first_us, last_us, articles): the spans of coverage of every story, merged rows of which are given; articles no more than ``gap_us``
    (an hour or more) apart are one span. The window goes over the hours of a story, not over its articles."""
    order = Window.partitionBy("cluster_id").orderBy("hour")
    begins = F.coalesce(F.col("first_us") - F.lag("last_us").over(order) > gap_us, F.lit(True))
    numbered = partials.withColumn("begins", begins).withColumn("span", F.sum(F.col("begins").cast("long")).over(order))
    return numbered.groupBy("cluster_id", "span").agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("n").alias("articles")).drop("span")


def story_changes(partials: DataFrame, gap_us: int, as_of_us: int) -> DataFrame:
    """(cluster_id, change, at_us, articles): a story is opened with the first article of a span and closed ``gap_us`` after its last one, if that is over by
    ``as_of_us``; ``articles`` are those of a closed span."""
    s = spans(partials, gap_us).where(F.col("first_us") <= as_of_us)
    closed = F.when(F.col("last_us") + gap_us <= as_of_us, F.struct(F.lit("closed").alias("change"), (F.col("last_us") + gap_us).alias("at_us"), "articles"))
    opened = F.struct(F.lit("opened").alias("change"), F.col("first_us").alias("at_us"), F.lit(None).cast("long").alias("articles"))
    return s.select("cluster_id", F.explode(F.array_compact(F.array(opened, closed))).alias("c")).select("cluster_id", "c.*")
