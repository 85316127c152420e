"""Read queries over stories, entities, drafts and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import scan


def list_stories(stories: DataFrame, category: str | None = None, status: str | None = None, skip: int = 0, limit: int | None = 50) -> DataFrame:
    """Newest stories first (V1)."""
    return scan(stories, [F.desc("last_us"), "cluster_id"], skip, limit, category=category, state=status)


def list_trending(stories: DataFrame, limit: int = 20, category: str | None = None) -> DataFrame:
    """The stories with the highest score: a top-k, so each task sends ``limit`` rows (V2)."""
    return scan(stories, [F.desc("trending"), "cluster_id"], 0, limit, category=category)


def top_per_category(stories: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("category").orderBy(F.desc("trending"), "cluster_id")
    return stories.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def story_detail(members: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(cluster_id, id, title, publisher, trust_level, published_us): the articles of every story (V3)."""
    named = sources.select(F.col("id").alias("source_id"), F.col("name").alias("publisher"), "trust_level")
    return members.join(articles.select("id", "title", "source_id", "published_us"), "id").join(named, "source_id").select("cluster_id", "id", "title", "publisher", "trust_level", "published_us")


def story_documents(detail: DataFrame) -> DataFrame:
    """One row per story with its articles, newest first."""
    part = F.struct((-F.col("published_us")).alias("k"), "id", "title", "publisher", "trust_level", "published_us")
    return detail.groupBy("cluster_id").agg(F.sort_array(F.collect_list(part)).alias("articles"))


def corroboration_label(stories: DataFrame) -> DataFrame:
    """The label from the metadata document, or one made from the source count (V6)."""
    made = F.concat(F.lit("Reported by "), F.col("source_count").cast("string"), F.lit(" independent source(s)"))
    return stories.withColumn("label", F.coalesce(F.get_json_object("scoring_metadata", "$.corroboration_label"), made))


def search(stories: DataFrame, query: str, category: str | None = None) -> DataFrame:
    """Category match and substring of title or summary, all ignoring case."""
    q = F.lit(query.lower())
    hit = F.contains(F.lower("title"), q) | F.contains(F.lower(F.coalesce("summary", F.lit(""))), q)
    return stories.where(hit if category is None else hit & (F.lower("category") == category.lower()))


def page(df: DataFrame, order_by: list, number: int, size: int) -> DataFrame:
    """One page with the envelope's total and pages in every row (V13); the total is one aggregate, not a window over all rows."""
    total = df.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / size))
    return df.orderBy(*order_by).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total)).withColumn("page", F.lit(number)).withColumn("page_size", F.lit(size))


def write_sorted(df: DataFrame, order: list[tuple[str, bool]], path: str, partitions: int | None = None) -> None:
    """``df`` in ranges of ``order`` (column, descending), each file sorted, so that seeking reads the files from its key on; the number of rows lies in ``<path>-total``."""
    keys = _order(order)
    dealt = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
    df.sparkSession.read.parquet(path).agg(F.count(F.lit(1)).alias("total")).write.mode("overwrite").parquet(f"{path}-total")


def _order(order: list[tuple[str, bool]]) -> list:
    return [F.desc(c) if down else F.asc(c) for c, down in order]


def seek_page(df: DataFrame, order: list[tuple[str, bool]], size: int, after: tuple | None = None) -> DataFrame:
    """The ``size`` rows that follow the key ``after`` (of the last row seen; none: the first page) in ``order`` (column, descending), whose columns
    are not null and name a row (V1, V13). Every page costs the same: a comparison that reaches the scan and a top-k, with no offset and no count.
    """
    if after is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for (c, down), v in zip(order, after, strict=True):
            beyond, equal = beyond | (equal & ((F.col(c) < v) if down else (F.col(c) > v))), equal & (F.col(c) == v)
        first, down = order[0]
        df = df.where((F.col(first) <= after[0]) if down else (F.col(first) >= after[0])).where(beyond)
    return df.orderBy(*_order(order)).limit(size)


def drafts_with_sources(drafts: DataFrame, draft_sources: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Drafts with their cited articles and publishers."""
    cited = draft_sources.join(articles.select(F.col("id").alias("article_id"), "title"), "article_id", "left").join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("publisher")), "source_id", "left")
    grouped = cited.groupBy("draft_id").agg(F.sort_array(F.collect_list(F.struct("article_id", "title", "publisher", "relevance", "citation_role"))).alias("citations"))
    return drafts.join(grouped, drafts["id"] == grouped["draft_id"], "left").drop("draft_id")


def generations_with_drafts(generations: DataFrame, drafts: DataFrame) -> DataFrame:
    """Generation history with the ids of the drafts it made."""
    made = drafts.groupBy(F.col("generation_id").alias("id")).agg(F.sort_array(F.collect_list("id")).alias("draft_ids"))
    return generations.join(made, "id", "left")


def dashboard(stories: DataFrame) -> DataFrame:
    """Story counts by category and state with subtotals."""
    return stories.rollup("category", "state").agg(F.count(F.lit(1)).alias("stories"), F.grouping_id().cast("int").alias("level"))
