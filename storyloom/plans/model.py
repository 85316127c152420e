"""The story model over the given tables: sources, articles and title clusters (the mapping is in SURVEY 7.1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("source").distinct().select(F.expr("cast(substring(source, 4) as bigint)").alias("id"), F.col("source").alias("name"))
    return s.select(
        "id", "name", F.format_string("https://%s.example.org/", "name").alias("url"), F.format_string("https://%s.example.org/feed", "name").alias("feed_url"), F.lit("general").alias("category"),
        F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high"), F.lit("verified")), (F.col("id") % 4 + 1).cast("int")).alias("trust_level"), (F.col("id") % 5 != 0).alias("enabled"),
    )


def first_words(text: str = "text", n: int = 12) -> F.Column:
    return F.substring_index(F.substring_index(text, "\n", 1), " ", n)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    # titles are cut and texts measured before the join, so texts are shuffled only where they are asked for
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text", "lang", first_words().alias("title"), F.length("text").alias("content_chars"))
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "event_type", F.expr("unix_micros(cast(ts as timestamp))").alias("published_us"))
    category = F.expr("case event_type when 'view' then 'world' when 'signup' then 'technology' when 'error' then 'politics' when 'click' then 'business' else 'general' end")
    return d.join(e, "doc_id").select(F.col("doc_id").alias("id"), F.expr("cast(substring(source, 4) as bigint)").alias("source_id"), "title", F.col("text").alias("content"), "content_chars", F.col("lang").alias("language"), category.alias("category"), "published_us")


def memberships(art: DataFrame) -> DataFrame:
    """(cluster_id, id): articles with equal titles; the least id names the cluster. Pre-aggregated, so a common title is one row a task."""
    heads = art.groupBy("title").agg(F.min("id").alias("cluster_id"))
    return art.select("id", "title").join(heads, "title").select("cluster_id", "id")


def as_of(art: DataFrame) -> int:
    """The reference time of the test data: its newest article."""
    return art.agg(F.max("published_us")).first()[0]
