"""Stored tables (S4-S9): filtered scans, seed, patch, cascade delete and the article sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scan(df: DataFrame, order_by: list, skip: int = 0, limit: int | None = None, **equal) -> DataFrame:
    """Rows that equal every given value, in order, one page of them; the comparisons reach the scan."""
    for c, v in equal.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    df = df.orderBy(*order_by)
    if skip:
        df = df.offset(skip)
    return df if limit is None else df.limit(limit)


def insert_absent(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet, one for each key."""
    return new.dropDuplicates([key]).join(old.select(key), key, "left_anti").select(*new.columns)


def patch(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``old`` with the non-null values of ``changes``."""
    fields = [c for c in changes.columns if c != key]
    new = changes.select(key, *(F.col(c).alias(f"_{c}") for c in fields))
    return old.join(new, key, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in old.columns))


def delete_cascade(keys: DataFrame, sources: DataFrame, articles: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, articles, links) without the given source ids and all that hangs on them."""
    left_sources = sources.join(keys.select("id"), "id", "left_anti")
    left_articles = articles.join(keys.select(F.col("id").alias("source_id")), "source_id", "left_anti").select(*articles.columns)
    return left_sources, left_articles, links.join(left_articles.select("id"), "id", "left_semi")


def write_articles(articles: DataFrame, path: str) -> None:
    """Append accepted articles, one folder for each publish date, dealt by date so that a date is few files."""
    dated = articles.withColumn("publish_date", F.to_date("published_at"))
    dated.repartition("publish_date").write.mode("append").partitionBy("publish_date").parquet(path)
