"""Tables in the shared folder, and connected components of an edge table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot with more rows than this and than a hundred-thousandth of all rows, so at most 100,000 keys of a table are hot.
HOT_ROWS = 1_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local session (tests) without one gets a temporary folder, a cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="storyloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/storyloom/{name}-{uuid.uuid4().hex[:12]}"


#: Whether Spark deletes a query's shuffle files when it ends, not some time after the driver's garbage collection.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, compression: str = "zstd", path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: survives lost executors and cuts the lineage. What it shuffled is deleted at once."""
    spark, path = df.sparkSession, path or new_path(df.sparkSession, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more; where the session has no handle on the file system it stays."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def hot_rows(total: int) -> int:
    return max(HOT_ROWS, total // 100_000)


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """``rows`` left-joined with ``table``, whose ``keys`` are unique; rows with one of the ``hot`` keys (at most 100,000, see ``HOT_ROWS``) look it up
    in a broadcast part of ``table``, so they stay where they are, and only the others are shuffled."""
    hot = F.broadcast(hot.select(*keys))
    apart = rows.join(hot, keys, "left_semi").join(F.broadcast(table.join(hot, keys, "left_semi")), keys, "left")
    return rows.join(hot, keys, "left_anti").join(table, keys, "left").unionByName(apart)


class Scratch:
    """Stored tables of one operator; ``close`` deletes them once what is given out does not read them any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, []

    def path(self, name: str) -> str:
        self.paths.append(new_path(self.spark, f"{self.name}-{name}"))
        return self.paths[-1]

    def put(self, df: DataFrame, name: str) -> DataFrame:
        return stored(df, name, path=self.path(name))

    def drop(self, *names: str) -> None:
        """Delete the tables put by these names; nothing may read them any more."""
        for path in [p for p in self.paths if any(p.rpartition("-")[0].endswith(f"/{self.name}-{n}") for n in names)]:
            self.paths.remove(path)
            discard(self.spark, path)

    def close(self) -> None:
        while self.paths:
            discard(self.spark, self.paths.pop())


def _look_up(rows: DataFrame, table: DataFrame, key: str, light: bool, scratch: Scratch) -> DataFrame:
    """``rows`` left-joined with ``table`` (unique ``key``), broadcast if ``light``, else with the hot keys of ``rows`` joined apart."""
    if light:
        return rows.join(F.broadcast(table), key, "left")
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hot = scratch.put(counts.where(F.col("n") > hot_rows(rows.count())).select(key), "hot")
    return join_hot(rows, table, [key], hot) if hot.count() else rows.join(table, key, "left")


def components(edges: DataFrame, name: str = "components", broadcast_rows: int = 1_000_000) -> DataFrame:
    """(id, component): for every node of ``edges`` (a, b) the smallest id that it reaches. Loops and edges with a null end count for nothing.

    Randomised contraction: in each round every node is represented by the node within two steps of it whose salted hash is least, ends are
    replaced by their representatives, and loops and repeated edges go. Which nodes are close does not depend on their ids, so a path shrinks
    to about a third in a round however it is numbered, a star to one node, and a component of n nodes takes some log n rounds; the edges
    that are left shrink likewise, so all rounds together read a multiple of the first. At the end the maps of the rounds are composed from the last one
    back, and every component gets its least id. There is no cap on rounds: at least one node of every component goes in each.

    Every round is a table in the shared folder; all but the result are deleted. Rounds with at most ``broadcast_rows`` nodes (16 bytes each)
    broadcast their maps. Larger ones are joined by shuffles with hot nodes and hot components apart (``join_hot``), and the least hash of
    a node is pre-aggregated, so neither the centre of a star nor a component of a third of all nodes meets in one task.
    """
    spark = edges.sparkSession
    scratch, maps, turn = Scratch(spark, name), [], 0
    ends = lambda df, a, b: df.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    left = scratch.put(ends(edges, "a", "b"), "edges-0")
    while n := left.count():
        light = 2 * n <= broadcast_rows
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c, salt=turn: F.xxhash64(F.lit(salt), c)
        near = both.groupBy("a").agg(F.min_by("b", rank("b")).alias("m"))
        near = near.select(F.col("a").alias("b"), F.when(rank("m") < rank("a"), F.col("m")).otherwise(F.col("a")).alias("m"))
        near = near if light else scratch.put(near, f"near-{turn}")
        # a node is a neighbour of its neighbours, so what is least around them covers what is least around itself
        seen = _look_up(both, near, "b", light, scratch)
        maps.append(scratch.put(seen.groupBy(F.col("a").alias("id")).agg(F.min_by("m", rank("m")).alias("up")), f"map-{turn}"))
        for end in ("a", "b"):
            left = _look_up(left, maps[-1].select(F.col("id").alias(end), F.col("up").alias(f"{end}_up")), end, light, scratch)
        left, turn = scratch.put(ends(left, "a_up", "b_up"), f"edges-{turn + 1}"), turn + 1
    tops = maps.pop() if maps else left.select(F.col("a").alias("id"), F.col("b").alias("up"))
    for below in reversed(maps):
        light = tops.count() <= broadcast_rows
        tops = _look_up(below, tops.select(F.col("id").alias("up"), F.col("up").alias("top")), "up", light, scratch).select("id", F.coalesce("top", "up").alias("up"))
        tops = tops if light else scratch.put(tops, "tops")
    tops = scratch.put(tops, "tops")
    least = tops.groupBy("up").agg(F.min("id").alias("component"))
    light = tops.count() <= broadcast_rows
    labels = _look_up(tops, least if light else scratch.put(least, "least"), "up", light, scratch)
    labels = stored(labels.select("id", "component"), name, path=new_path(spark, f"{name}-labels"))
    scratch.close()
    return labels
