"""Generation ledger (L1-L5): reuse by fingerprint, audit rows, provenance and regeneration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import DRAFT_TYPES, PLATFORMS

KEY = ["story_cluster_id", "generation_type", "provider", "model", "prompt_version", "input_context_hash"]


def split_reuse(requests: DataFrame, generations: DataFrame, drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reused, to do): requests whose key has a successful generation take its latest draft (L1)."""
    latest = generations.where("success = 1").groupBy(*KEY).agg(F.max(F.struct("created_at", "id")).alias("g")).select(*KEY, F.col("g.id").alias("generation_id"))
    draft = drafts.where("generation_id is not null").groupBy("generation_id").agg(F.max(F.struct("created_at", "id")).alias("d")).select("generation_id", F.col("d.id").alias("draft_id"))
    have = latest.join(draft, "generation_id")
    return requests.join(have, KEY), requests.join(have.select(*KEY), KEY, "left_anti")


def audit_rows(outcomes: DataFrame) -> DataFrame:
    """Ledger rows of ``outcomes`` (the key columns, payload, latency_ms, error_code, created_at): hashes, token estimates, success (L2)."""
    out = outcomes.withColumn("raw_response", F.when(F.col("error_code").isNull(), F.col("payload"))).withColumn("success", F.col("error_code").isNull().cast("int"))
    out = out.withColumn("output_hash", F.when(F.col("success") == 1, F.sha2(F.col("payload"), 256)))
    tokens = lambda c: F.floor(F.length(c) / 4).cast("int")
    return out.withColumn("output_tokens", tokens("payload")).withColumn("input_tokens", tokens("context") if "context" in outcomes.columns else F.lit(None).cast("int"))


def provenance_rows(drafts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(draft_id, article_id, source_id, relevance, citation_role): one for each draft and evidence article (L3)."""
    j = drafts.select(F.col("id").alias("draft_id"), "cluster_id").join(evidence, "cluster_id")
    return j.select("draft_id", F.col("id").alias("article_id"), "source_id", F.bround(100 * F.col("similarity"), 0).cast("int").alias("relevance"), F.when(F.col("rank") == 1, "primary").otherwise("evidence").alias("citation_role"))


def regenerate(drafts: DataFrame, wanted: DataFrame, renewed: DataFrame) -> DataFrame:
    """``drafts`` with the ``wanted`` ids marked REGENERATE and the ``renewed`` rows appended; the history stays (L4)."""
    marked = drafts.join(wanted.select("id", F.lit(True).alias("_w")), "id", "left").withColumn("status", F.when(F.col("_w"), "REGENERATE").otherwise(F.col("status"))).select(*drafts.columns)
    return marked.unionByName(renewed.select(*drafts.columns))


def _map(key: Column, values: dict, default: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key), default)


def draft_type(generation_type: Column) -> Column:
    return _map(generation_type, DRAFT_TYPES, F.lit("ARTICLE"))


def platform(kind: Column) -> Column:
    return _map(kind, PLATFORMS, F.lit("web"))


def generation_type(kind: Column, target_platform: Column) -> Column:
    back = {v: k for k, v in DRAFT_TYPES.items() if k != "PACKAGE"}
    return F.when(target_platform == "editorial-package", "PACKAGE").otherwise(_map(kind, back, F.lit("ARTICLE")))


def latest_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("created_at"), F.desc("id"))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
