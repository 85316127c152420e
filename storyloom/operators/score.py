"""Story scores (T1-T10): velocity, freshness, corroboration, relevance, trending and the lifecycle state. Times are microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import round2
from ..functions.vocabulary import CATEGORY_WEIGHTS, TRENDING_WEIGHTS, TRUST_WEIGHTS

HOUR = 3_600_000_000


def _lookup(key: Column, values: dict, default) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def _clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def coverage(members: DataFrame, articles: DataFrame, as_of_us: int) -> DataFrame:
    """Counts and bounds of each cluster in one aggregation: all, within 6 hours, 6 to 12 hours ago, first and last."""
    t = F.col("published_us")
    recent, before = t >= as_of_us - 6 * HOUR, (t >= as_of_us - 12 * HOUR) & (t < as_of_us - 6 * HOUR)
    joined = members.join(articles.select("id", "published_us"), "id")
    return joined.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("article_count"), F.sum(recent.cast("long")).alias("recent"), F.sum(before.cast("long")).alias("previous"), F.min("published_us").alias("first_us"), F.max("published_us").alias("last_us"))


def velocity(n: Column, recent: Column, previous: Column, first_us: Column, last_us: Column) -> Column:
    rate = n / F.greatest(F.lit(1.0), (last_us - first_us) / HOUR)
    raw = recent * 15.0 + rate * 10.0 * F.least(F.lit(2.0), (recent + 1) / (previous + 1))
    return F.when(n == 0, 0.0).when(n == 1, 10.0).otherwise(round2(_clamp(raw)))


def freshness(last_us: Column, as_of_us: int) -> Column:
    return round2(100.0 * F.pow(F.lit(0.5), F.greatest(F.lit(0.0), (as_of_us - last_us) / HOUR) / 12.0))


def corroboration(members: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(cluster_id, source_count, corroboration, label). Source and cluster pairs are made distinct before the small source table joins."""
    return corroboration_of(members.join(articles.select("id", "source_id"), "id").select("cluster_id", "source_id").distinct(), sources)


def corroboration_of(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """``corroboration`` from distinct pairs (cluster_id, source_id)."""
    weight = _lookup(F.col("trust_level"), TRUST_WEIGHTS, 1.0)
    joined = pairs.join(sources.select(F.col("id").alias("source_id"), weight.alias("w")), "source_id")
    per = joined.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("source_count"), F.sum("w").alias("w"))
    label = F.concat(F.lit("Reported by "), F.col("source_count").cast("string"), F.when(F.col("source_count") == 1, " independent source").otherwise(" independent sources"))
    return per.select("cluster_id", "source_count", round2(_clamp(F.col("w") / 5.0 * 100.0, 10.0)).alias("corroboration"), label.alias("corroboration_label"))


def relevance(category: Column, n_entities: Column) -> Column:
    return round2(_clamp(_lookup(F.lower(category), CATEGORY_WEIGHTS, 50.0) + F.least(F.lit(15.0), n_entities * 3.0)))


def trending(v: Column, f: Column, c: Column, r: Column) -> Column:
    w = TRENDING_WEIGHTS
    return round2(_clamp(v * w["velocity"] + f * w["freshness"] + c * w["corroboration"] + r * w["relevance"]))


def state(t: Column, v: Column, f: Column, articles: Column, sources: Column) -> Column:
    """The first rule that holds names the state."""
    return (
        F.when(f <= 10, "STALE")
        .when((t >= 80) & (v >= 60) & (sources >= 2), "PEAK")
        .when((t >= 65) & (articles >= 2), "TRENDING")
        .when((f <= 35) & (v <= 20), "COOLING")
        .when((t >= 45) | (v >= 30), "RISING")
        .otherwise("EMERGING")
    )


def score_clusters(clusters: DataFrame, members: DataFrame, articles: DataFrame, sources: DataFrame, mentions: DataFrame | None, as_of_us: int) -> DataFrame:
    """All signals of every cluster. ``clusters`` has cluster_id and category, ``mentions`` (cluster_id, entity) or none."""
    return signals(clusters, coverage(members, articles, as_of_us), corroboration(members, articles, sources), mentions, as_of_us)


def signals(clusters: DataFrame, cover: DataFrame, sourced: DataFrame, mentions: DataFrame | None, as_of_us: int) -> DataFrame:
    """All signals from the counts of ``coverage`` and ``corroboration``."""
    out = clusters.join(cover, "cluster_id", "left").join(sourced, "cluster_id", "left")
    if mentions is not None:
        out = out.join(mentions.distinct().groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_entities")), "cluster_id", "left")
    else:
        out = out.withColumn("n_entities", F.lit(0).cast("long"))
    zero = {"article_count": 0, "recent": 0, "previous": 0, "source_count": 0, "corroboration": 0.0, "corroboration_label": "Reported by 0 sources", "n_entities": 0}
    out = out.fillna(zero)
    out = out.withColumn("velocity", velocity(*(F.col(c) for c in ("article_count", "recent", "previous", "first_us", "last_us"))))
    out = out.withColumn("freshness", freshness(F.col("last_us"), as_of_us)).withColumn("relevance", relevance(F.col("category"), F.col("n_entities")))
    out = out.withColumn("trending", trending(*(F.col(c) for c in ("velocity", "freshness", "corroboration", "relevance"))))
    out = out.withColumn("state", state(*(F.col(c) for c in ("trending", "velocity", "freshness", "article_count", "source_count"))))
    return out.drop("recent", "previous")


def rescore_clusters(touched: DataFrame, clusters: DataFrame, members: DataFrame, articles: DataFrame, sources: DataFrame, mentions: DataFrame | None, as_of_us: int) -> DataFrame:
    """``score_clusters`` of the clusters in ``touched`` (cluster_id, may repeat) only, over all their members (T9). Clusters, members and mentions
    are cut by semi joins before anything is joined or aggregated, so the work follows the clusters that a run touched."""
    ids = touched.select("cluster_id").where("cluster_id is not null").distinct()
    only = lambda df: df.join(ids, "cluster_id", "left_semi")
    return score_clusters(only(clusters), only(members), articles, sources, None if mentions is None else only(mentions), as_of_us)


def explanation(scored: DataFrame) -> DataFrame:
    """``scored`` with the explanation document as a struct and as JSON."""
    w = TRENDING_WEIGHTS
    doc = F.struct(
        F.lit(" + ".join(f"{k} * {v:.2f}" for k, v in w.items())).alias("formula"),
        F.struct(*(F.lit(v).alias(k) for k, v in w.items())).alias("weights"),
        F.struct(*(F.col(k) for k in w)).alias("components"),
        F.col("corroboration_label"),
        F.col("state"),
    )
    return scored.withColumn("explanation", doc).withColumn("scoring_metadata", F.to_json(doc))


def transitions(snapshots: DataFrame) -> DataFrame:
    """State changes between snapshots (cluster_id, as_of_us, state) of a cluster."""
    from pyspark.sql import Window

    w = Window.partitionBy("cluster_id").orderBy("as_of_us")
    return snapshots.withColumn("previous_state", F.lag("state").over(w)).where("previous_state is null or previous_state <> state")
