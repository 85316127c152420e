"""Normalisation of feed entries into articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_url, clean_html, content_hash, parse_time

LIMITS = {"title": 512, "url": 1024, "author": 255}


def normalize_entries(entries: DataFrame) -> DataFrame:
    """Canonical articles with a ``reject_reason`` that is null for valid rows.

    ``entries``: source_id, fetched_at, title, link, guid, published, author, summary, content, category, enclosures (array of type, href),
    media_content (array of url, medium, type). A missing or unreadable publish time is ``fetched_at``. Texts longer than the columns' limits
    are rejects (N8), never cut silently; summary and content are shortened to 2,000 and 10,000 characters as the model says (N7). The
    ``position`` of an entry in its feed is kept if there is one.
    """
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    raw_url = F.coalesce(F.nullif(F.col("link"), F.lit("")), F.col("guid"), F.lit(""))
    canonical = canonical_url(raw_url)
    summary, title = clean_html(F.col("summary")), F.trim(F.coalesce("title", F.lit("")))
    content = F.coalesce(F.nullif(clean_html(F.col("content")), F.lit("")), summary)
    image = F.coalesce(
        F.get(F.filter("enclosures", lambda e: e["type"].startswith("image/")), F.lit(0))["href"],
        F.get(F.filter("media_content", lambda m: F.coalesce(m["medium"] == "image", F.lit(False)) | F.coalesce(m["type"].startswith("image/"), F.lit(False))), F.lit(0))["url"],
    )
    out = entries.select(
        "source_id", title.alias("title"), F.trim(raw_url).alias("url"), canonical.alias("canonical_url"), blank("author").alias("author"),
        parse_time(F.col("published"), F.col("fetched_at")).alias("published_at"), F.nullif(F.substring(summary, 1, 2000), F.lit("")).alias("summary"),
        F.nullif(F.substring(content, 1, 10000), F.lit("")).alias("content"), image.alias("image_url"), F.lower(F.trim(F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("general")))).alias("category"),
        content_hash(title, canonical).alias("content_hash"), F.coalesce(F.nullif(F.col("guid"), F.lit("")), canonical).alias("guid"), F.lit("en").alias("language"), "fetched_at", *(c for c in entries.columns if c == "position"),
    )
    reason = F.when(F.col("title") == "", "empty title").when(F.col("url") == "", "no link or guid")
    for c, n in LIMITS.items():
        reason = reason.when(F.length(c) > n, f"{c} too long")
    return out.withColumn("reject_reason", reason)


def run_audit(outcomes: DataFrame) -> DataFrame:
    """(run_id, source_id, found, ingested, skipped, status) from one row per entry with ``outcome`` ingested, skipped or failed."""
    count = lambda o: F.sum((F.col("outcome") == o).cast("long"))
    per = outcomes.groupBy("run_id", "source_id").agg(F.sum((F.col("outcome") != "failed").cast("long")).alias("articles_found"), count("ingested").alias("articles_ingested"), count("skipped").alias("articles_skipped"), count("failed").alias("_f"))
    return per.withColumn("status", F.when(F.col("_f") > 0, "FAILED").otherwise("COMPLETED")).drop("_f")
