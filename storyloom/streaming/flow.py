"""The same operators over streams."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cluster import HOUR, WINDOW_HOURS, greedy_clusters
from ..operators import history
from ..operators.graph import Scratch, stored
from ..operators.normalize import normalize_entries
from ..sources.feeds import parse_feeds

PAYLOAD_SCHEMA = "source_id long, fetched_at timestamp, payload string"
LATENESS = "48 hours"


def landed_payloads(spark, path: str) -> DataFrame:
    """Payload files as they land."""
    return spark.readStream.schema(PAYLOAD_SCHEMA).parquet(path)


def valid_articles(payloads: DataFrame) -> DataFrame:
    """Normalised, valid articles, each content hash once: of a table, or of a stream within the lateness."""
    entries, _ = parse_feeds(payloads)
    articles = normalize_entries(entries).where("reject_reason is null").drop("reject_reason")
    if not articles.isStreaming:
        return articles.dropDuplicates(["content_hash"])
    return articles.withWatermark("fetched_at", LATENESS).dropDuplicatesWithinWatermark(["content_hash"])


def stored_rows(spark, store: str, schema: str | None = None) -> DataFrame | None:
    """The table in ``store``, or none if nothing was written there yet."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(store)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def store_batch(batch: DataFrame, store: str, name: str) -> DataFrame:
    """Resolve a batch of articles against the store and add what is new (D6-D8 for R1, R2); the decisions about its rows are given back.

    ``store`` has a folder of articles for each batch and, in ``<store>-keys``, one of their index (``history``), so writing batch ``name`` again replaces
    what an attempt before left. Within a batch the order is that of the polls and of the entries in a feed. Only the index's partitions
    that the batch has keys for are read, and of the articles only the largest id.
    """
    spark, part, scratch = batch.sparkSession, f"batch={name}", Scratch(batch.sparkSession, "ingest")
    keys = f"{store.rstrip('/')}-keys"
    other = lambda df: None if df is None else df.where(F.col("batch") != name)
    index = other(stored_rows(spark, keys, f"{history.INDEX}, batch string, bucket int"))
    old = other(stored_rows(spark, store, "id long, batch string"))
    top = None if old is None else old.agg(F.max("id")).first()[0]
    order = [c for c in ("fetched_at", "source_id", "position", "content_hash") if c in batch.columns]
    rows = scratch.put(history.numbered(batch, order, 0 if top is None else top + 1), "batch")
    decisions = history.resolve(rows, index)
    new = rows.join(decisions.where("not is_duplicate").select("id"), "id", "left_semi")
    new.write.mode("overwrite").parquet(f"{store}/{part}")
    written = spark.read.schema(new.schema).parquet(f"{store}/{part}")
    history.index_rows(written).repartition("bucket").sortWithinPartitions("bucket", "key").write.mode("overwrite").partitionBy("bucket").parquet(f"{keys}/{part}")
    scratch.close()
    return decisions


def ingest(articles: DataFrame, store: str, checkpoint: str):
    """Add what the store doesn't have yet, batch by batch; a repeated batch or poll adds nothing."""
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    stream = articles.writeStream.foreachBatch(lambda batch, epoch: (store_batch(batch, store, f"{name}-{epoch}"), None)[1])
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_fetched(payloads: DataFrame) -> DataFrame:
    return payloads.groupBy("source_id").agg(F.max("fetched_at").alias("last_fetched_at"))


def _in_time(articles: DataFrame, time_col: str) -> DataFrame:
    return articles.withWatermark(time_col, LATENESS) if articles.isStreaming else articles


def coverage_windows(articles: DataFrame, length: str = "6 hours", slide: str | None = None, time_col: str = "published_at") -> DataFrame:
    """Articles per category in tumbling or sliding windows (R4); of a stream, rows up to the lateness behind the newest count."""
    w = F.window(time_col, length, slide) if slide else F.window(time_col, length)
    return _in_time(articles, time_col).groupBy(w, "category").agg(F.count(F.lit(1)).alias("articles"))


def story_sessions(articles: DataFrame, gap: str = LATENESS, key: str = "cluster_id", time_col: str = "published_at") -> DataFrame:
    """Spans of coverage of a story without a break of ``gap`` (R5); of a stream, a span is given out once it cannot grow any more."""
    return _in_time(articles, time_col).groupBy(F.session_window(time_col, gap), key).agg(F.count(F.lit(1)).alias("articles"))


def assign_batch(articles: DataFrame, history: DataFrame, links: DataFrame) -> DataFrame:
    """Incremental clustering (R6): stored links are fixed, new articles join or seed clusters (C6, C8). ``history`` holds whole clusters."""
    return greedy_clusters(history.unionByName(articles), links)


def open_clusters(bounds: DataFrame, low_us: int, high_us: int, window_hours: int = WINDOW_HOURS) -> DataFrame:
    """Rows of ``bounds`` (first_us, last_us) of clusters that an article between the two times can reach; a cluster seeded within reaches no further."""
    width = window_hours * HOUR
    return bounds.where((F.col("last_us") >= low_us - width) & (F.col("first_us") <= high_us + width))


_ARTICLE = "id long, title string, category string, published_us long"
_STORED = f"{_ARTICLE}, cluster_id long, similarity double, method string, late boolean, epoch int"
_BOUNDS = "cluster_id long, title string, category string, first_us long, last_us long, epoch int, last_day int"
_NAMES = [c.split(" ")[0] for c in _ARTICLE.split(", ")]
DAY = 24 * HOUR


def _reachable(spark, store: str, epoch: int, low_us: int, high_us: int) -> DataFrame | None:
    """Clusters, as they were before ``epoch``, that articles between the times can reach. A cluster's newest row has its last day, so only the days
    from a window before the first article on are read, and no stored article."""
    rows = stored_rows(spark, f"{store}-bounds", _BOUNDS)
    if rows is None:
        return None
    rows = rows.where((F.col("epoch") < epoch) & (F.col("last_day") >= (low_us - WINDOW_HOURS * HOUR) // DAY))
    seed = F.max(F.struct("title", "category")).alias("seed")
    merged = rows.groupBy("cluster_id").agg(seed, F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    return open_clusters(merged.select("cluster_id", "seed.title", "seed.category", "first_us", "last_us"), low_us, high_us)


def _placed(ready: DataFrame, store: str, epoch: int, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """(``ready`` with clusters, the stored clusters that it could reach)."""
    low, high = ready.agg(F.min("published_us"), F.max("published_us")).first()
    old = None if low is None else _reachable(ready.sparkSession, store, epoch, low, high)
    old = None if old is None else scratch.put(old, "open")
    return ready.join(greedy_clusters(ready, clusters=old), "id"), old


def cluster_batch(batch: DataFrame, epoch: int, store: str, lateness_hours: int | None = None) -> None:
    """One batch of ``cluster_stream``. Everything that it writes lies in folders of its epoch, so writing it again replaces what an attempt before left."""
    spark, scratch, store = batch.sparkSession, Scratch(batch.sparkSession, "cluster-batch"), store.rstrip("/")
    progress = stored_rows(spark, f"{store}-progress", "newest_us long, watermark_us long, epoch int")
    last = None if progress is None else progress.where(F.col("epoch") < epoch).orderBy(F.desc("epoch")).first()
    new = batch.groupBy("id").agg(F.min(F.struct("published_us", "title", "category")).alias("a")).select("id", "a.title", "a.category", "a.published_us")
    if last is not None:
        known = stored_rows(spark, store, "id long, epoch int").where(F.col("epoch") < epoch).select("id")
        held = stored_rows(spark, f"{store}-waiting", f"{_ARTICLE}, epoch int").where(F.col("epoch") == last.epoch).select(*_NAMES)
        new = held.unionByName(new.join(known.unionByName(held.select("id")), "id", "left_anti"))
    new = scratch.put(new, "new")
    newest = new.agg(F.max("published_us")).first()[0]
    newest = max((x for x in (newest, last and last.newest_us) if x is not None), default=None)
    before = last.watermark_us if last else None
    watermark = None if lateness_hours is None or newest is None else newest - lateness_hours * HOUR
    late = F.lit(False) if before is None else F.col("published_us") < before
    ready = new.withColumn("late", late)
    ready = scratch.put(ready if watermark is None else ready.where(F.col("published_us") < watermark), "ready")
    waits = new.limit(0) if watermark is None else new.where(F.col("published_us") >= watermark)
    placed, old = _placed(ready, store, epoch, scratch)
    part = f"epoch={epoch}"
    placed.select(*_NAMES, "cluster_id", "similarity", "method", "late").write.mode("overwrite").parquet(f"{store}/{part}")
    placed = stored_rows(spark, store, _STORED).where(F.col("epoch") == epoch)
    bounds = placed.groupBy("cluster_id").agg(F.min("published_us").alias("first_us"), F.max("published_us").alias("last_us"))
    seeds = placed.where("id = cluster_id").select("cluster_id", "title", "category", F.col("published_us").alias("first_us"), F.col("published_us").alias("last_us"))
    seeds = seeds if old is None else seeds.unionByName(old.select(*seeds.columns))
    bounds = bounds.join(seeds.withColumnsRenamed({"first_us": "f", "last_us": "l"}), "cluster_id").select("cluster_id", "title", "category", F.least("first_us", "f").alias("first_us"), F.greatest("last_us", "l").alias("last_us"))
    bounds = bounds.withColumn("last_day", F.floor(F.col("last_us") / DAY).cast("int"))
    bounds.repartition("last_day").write.mode("overwrite").partitionBy("last_day").parquet(f"{store}-bounds/{part}")
    waits.write.mode("overwrite").parquet(f"{store}-waiting/{part}")
    spark.createDataFrame([(newest, watermark)], "newest_us long, watermark_us long").write.mode("overwrite").parquet(f"{store}-progress/{part}")
    scratch.close()


def cluster_stream(articles: DataFrame, store: str, checkpoint: str, lateness_hours: int | None = None):
    """Assign a stream of articles (id, title, category, published_us) batch by batch (R6); ``store`` gets id, title, category, published_us, cluster_id,
    similarity, method and late of every new article, and articles that it has are left out, so a repeated batch adds nothing.

    With ``lateness_hours`` articles wait in ``<store>-waiting`` until the newest one is that much ahead and are then placed in the order of
    publish time, so batches in any order within the lateness give the clusters of one pass over everything. An article behind the watermark is
    late: it is placed at once, before the ones released with it, against the clusters as they are, and marked. Without it nothing waits and
    batches should come in the order of time. A batch reads the bounds of clusters that it can reach (``<store>-bounds``, by the day of a cluster's
    last article), the articles that wait, and of the stored articles their ids only. Publish times are not null.
    """
    run = lambda batch, epoch: cluster_batch(batch.select(*_NAMES), epoch, store, lateness_hours)
    return articles.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def waiting_clusters(spark, store: str) -> DataFrame:
    """What the articles that still wait in ``store`` would get if no other came (R6); nothing is written to the store."""
    store, scratch = store.rstrip("/"), Scratch(spark, "waiting")
    done = stored_rows(spark, f"{store}-progress", "newest_us long, epoch int").agg(F.max("epoch")).first()[0]
    rows = scratch.put(stored_rows(spark, f"{store}-waiting", f"{_ARTICLE}, epoch int").where(F.col("epoch") == done).select(*_NAMES), "rows")
    out = stored(_placed(rows, store, done + 1, scratch)[0], "waiting-clusters")
    scratch.close()
    return out
