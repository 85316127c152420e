"""Evidence bundles and extractive briefs (B1-B18), for all clusters at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dates, numbers, trim_words
from ..functions.vocabulary import PAYLOAD_SCHEMAS

MAX_ARTICLES, MAX_CHARS = 8, 1200


def excerpt(content: Column, summary: Column, title: Column, limit: int = MAX_CHARS) -> Column:
    """The first of content, summary and title that is not empty, trimmed and shortened (B2)."""
    empty = F.lit("")
    return F.substring(F.trim(F.coalesce(F.nullif(content, empty), F.nullif(summary, empty), F.nullif(title, empty), empty)), 1, limit)


def evidence_articles(members: DataFrame, articles: DataFrame, sources: DataFrame, most: int = MAX_ARTICLES) -> DataFrame:
    """The newest ``most`` articles of every cluster with excerpt, numbers, dates and lead.

    ``row_number`` under a limit becomes a group limit before the shuffle, so a large cluster sends a few rows from each task. Contents are cut to their
    excerpts before that.
    """
    summary = F.col("summary") if "summary" in articles.columns else F.lit(None).cast("string")
    url = F.col("canonical_url") if "canonical_url" in articles.columns else F.format_string("https://example.org/a/%d", "id")
    short = articles.select("id", "title", "source_id", "published_us", excerpt(F.col("content"), summary, F.col("title")).alias("excerpt"), url.alias("canonical_url"))
    out = members.join(short, "id").withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("published_us"), "id"))).where(F.col("rank") <= most)
    out = out.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("publisher"), F.col("trust_level").alias("publisher_trust")), "source_id")
    said = F.concat_ws(" ", "title", "excerpt")
    lead = F.trim(F.when(F.col("excerpt") == "", F.col("title")).otherwise(F.regexp_replace(F.substring_index("excerpt", ". ", 1), r"\.+\z", "")))
    return out.select("cluster_id", "rank", "id", "title", "excerpt", "source_id", "publisher", "publisher_trust", "published_us", "canonical_url", numbers(said).alias("numbers"), dates(said).alias("dates"), lead.alias("lead"))


def conflicts(evidence: DataFrame) -> DataFrame:
    """(cluster_id, a, b, rank_a, rank_b, detail): evidence pairs whose figures are given but disjoint (B6). At most 28 pairs a cluster."""
    x = evidence.where(F.size("numbers") > 0).select("cluster_id", "rank", "id", "publisher", "numbers")
    y = x.select("cluster_id", *(F.col(c).alias(f"{c}_b") for c in ("rank", "id", "publisher", "numbers")))
    pairs = x.join(y, "cluster_id").where("rank < rank_b").where(~F.arrays_overlap("numbers", "numbers_b"))
    show = lambda c: F.concat(F.lit("['"), F.array_join(c, "', '"), F.lit("']"))
    detail = F.concat("publisher", F.lit(" reports "), show("numbers"), F.lit(" while "), "publisher_b", F.lit(" reports "), show("numbers_b"))
    return pairs.select("cluster_id", F.col("id").alias("a"), F.col("id_b").alias("b"), F.col("rank").alias("rank_a"), F.col("rank_b"), detail.alias("detail"))


def bundles(clusters: DataFrame, evidence: DataFrame, mentions: DataFrame | None = None, evidence_only: bool = False) -> DataFrame:
    """One row for each cluster: story columns, ordered evidence, entities, conflicts, provenance and the fingerprint.

    ``mentions`` (cluster_id, norm, mention_count, and name if there is one) become ``entities`` and ``entity_names``, most mentions first.

    ``evidence_only`` leaves the story's scores and state out of the fingerprint, so that a rescore does not change it.
    """
    part = F.struct("rank", "id", "title", "excerpt", "source_id", "publisher", "publisher_trust", "published_us", "canonical_url", "numbers", "dates", "lead")
    ev = evidence.groupBy("cluster_id").agg(F.sort_array(F.collect_list(part)).alias("articles"))
    cf = conflicts(evidence).groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("rank_a", "rank_b", "a", "b", "detail"))).alias("conflicts"))
    out = clusters.join(ev, "cluster_id").join(cf, "cluster_id", "left")
    if mentions is not None:
        name = F.col("name") if "name" in mentions.columns else F.col("norm").alias("name")
        en = mentions.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("mention_count")).alias("k"), "norm", name))).alias("e"))
        out = out.join(en.select("cluster_id", F.col("e.norm").alias("entities"), F.col("e.name").alias("entity_names")), "cluster_id", "left")
    else:
        out = out.withColumn("entities", F.array().cast("array<string>")).withColumn("entity_names", F.array().cast("array<string>"))
    empty = lambda c: F.coalesce(c, F.from_json(F.lit("[]"), out.schema[c].dataType))
    out = out.withColumn("conflicts", empty("conflicts")).withColumn("entities", empty("entities")).withColumn("entity_names", empty("entity_names"))
    out = out.withColumn("article_ids", F.col("articles.id")).withColumn("source_ids", F.array_sort(F.array_distinct("articles.source_id"))).withColumn("publishers", F.array_sort(F.array_distinct("articles.publisher")))
    out = out.withColumn("urls", F.map_from_entries(F.transform("articles", lambda a: F.struct(a["id"], a["canonical_url"]))))
    parts = ["cluster_id", "title", "articles", "entities"] + ([] if evidence_only else [c for c in ("category", "trending", "state") if c in out.columns])
    return out.withColumn("context_hash", F.sha2(F.to_json(F.struct(*parts)), 256))


def briefs(bundle: DataFrame) -> DataFrame:
    """The four extractive sections of every bundle (B9-B15); needs title, articles, publishers, and first_seen and state if there are."""
    lines = F.filter("articles.lead", lambda x: x != "")
    out = bundle.withColumn("_l", lines).withColumn("_n", F.size("_l"))
    out = out.withColumn("attribution", F.array_join(F.slice("publishers", 1, 3), ", "))
    line = lambda i: F.get("_l", F.lit(i))
    some = lambda a, n: F.nullif(F.array_join(F.slice("_l", a, n), " "), F.lit(""))
    fact = F.coalesce(line(0), F.col("title"))
    facts = lambda n: F.transform(F.slice("_l", 1, n), lambda x: trim_words(x))
    out = out.withColumn("headline", F.col("title"))
    out = out.withColumn("alternate_headlines", F.filter(F.array(F.col("title"), F.when(F.col("_n") > 1, trim_words(line(1), 110)), trim_words(F.concat("title", F.lit(": what "), "attribution", F.lit(" report")), 110)), lambda x: x.isNotNull()))
    out = out.withColumn("reasoning_summary", F.concat(F.lit("Headlines composed strictly from cluster evidence attributed to "), "attribution", F.lit(".")))
    out = out.withColumn("summary_facts", facts(4)).withColumn("summary", F.when(F.col("_n") > 0, F.array_join(F.slice("summary_facts", 1, 2), " ")).otherwise(F.col("title")))
    seen = F.coalesce(F.col("first_seen"), F.lit("an unknown time")) if "first_seen" in bundle.columns else F.lit("an unknown time")
    status = F.col("state") if "state" in bundle.columns else F.lit("EMERGING")
    tracked = F.concat(F.lit("This story was first tracked at "), seen, F.lit(" and is currently marked "), status, F.lit("."))
    out = out.withColumn("body", F.concat_ws("\n\n", fact, some(2, 2), F.concat(F.lit("Reporting from "), "attribution", F.lit(" describes these developments.")), some(4, 2), tracked))
    out = out.withColumn("dek", trim_words(F.coalesce(line(1), fact))).withColumn("article_facts", facts(5))
    lone = F.array(F.lit("Story is reported by a single source; details remain unconfirmed."))
    out = out.withColumn("uncertainties", F.when(F.size("articles") >= 2, F.array().cast("array<string>")).otherwise(lone))
    out = out.withColumn("caption", trim_words(F.concat(fact, F.lit(" (via "), "attribution", F.lit(")")), 280)).withColumn("call_to_action", F.lit("Read the full story coverage for updates."))
    words = F.transform(F.split(F.trim(F.regexp_replace("title", r"\s+", " ")), " "), lambda w: F.lower(F.btrim(w, F.lit(".,;:!?\"'()"))))
    out = out.withColumn("hashtags", F.slice(F.transform(F.filter(words, lambda w: F.length(w) > 4), lambda w: F.concat(F.lit("#"), w)), 1, 3))
    return out.drop("_l", "_n")


def package(sections: DataFrame, most_headlines: int = 5) -> DataFrame:
    """The combined package (B16): headline candidates, merged facts in first order, the copy that guard and quality look at."""
    out = sections.withColumn("headline_candidates", F.slice(F.filter(F.concat(F.array("headline"), "alternate_headlines"), lambda x: x != ""), 1, most_headlines))
    out = out.withColumn("key_facts", F.array_distinct(F.concat("summary_facts", "article_facts")))
    return out.withColumn("copy", F.concat_ws("\n", "headline", "summary", "body", "caption"))


def risk_flags(packages: DataFrame, checked: DataFrame, section_findings: DataFrame | None = None) -> DataFrame:
    """``packages`` with ``risk_flags``: the flags of the package's own check and of its sections' (cluster_id, flag), sorted, each once; a conflict in
    the evidence that no check has named comes last (B16). ``checked`` has cluster_id, flags and conflicts."""
    own = checked.select("cluster_id", F.col("flags").alias("_f"), (F.size("conflicts") > 0).alias("_c"))
    out = packages.join(own, "cluster_id", "left")
    empty = F.array().cast("array<string>")
    merged = F.coalesce("_f", empty)
    if section_findings is not None:
        out = out.join(section_findings.groupBy("cluster_id").agg(F.collect_set("flag").alias("_s")), "cluster_id", "left")
        merged = F.concat(merged, F.coalesce("_s", empty))
    merged = F.array_sort(F.array_distinct(merged))
    last = F.when(F.coalesce("_c", F.lit(False)) & ~F.array_contains(merged, "CONFLICTING_SOURCES"), F.array(F.lit("CONFLICTING_SOURCES"))).otherwise(empty)
    return out.withColumn("risk_flags", F.concat(merged, last)).drop("_f", "_c", "_s")


def payload_text(payload: DataFrame) -> Column:
    """The texts of a payload in their fixed order: six strings, then five that are lists or strings."""
    have = set(payload.columns)
    strings = [F.col(c) for c in ("headline", "dek", "body", "summary", "caption", "reasoning_summary") if c in have]
    lists = [F.array_join(c, "\n") if payload.schema[c].dataType.typeName() == "array" else F.col(c) for c in ("alternate_headlines", "key_facts", "uncertainties", "hashtags", "call_to_action") if c in have]
    return F.concat_ws("\n", *strings, *(F.nullif(x, F.lit("")) for x in lists))


def payload_errors(payloads: DataFrame, schema_col: str = "schema_name", payload_col: str = "payload_json") -> DataFrame:
    """``payloads`` with ``error``: the first missing or wrongly typed field of the named schema, or null."""
    v = F.try_parse_json(payload_col)
    kind = F.schema_of_variant(v)
    error = F.when(~F.col(schema_col).isin(*PAYLOAD_SCHEMAS), F.lit("unknown schema")).when(v.isNull() | ~kind.startswith("OBJECT"), F.lit("not an object"))
    for name, fields in PAYLOAD_SCHEMAS.items():
        for field, is_list in fields.items():
            have = F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))
            good = have.startswith("ARRAY") if is_list else have == "STRING"
            here = F.col(schema_col) == name
            error = error.when(here & have.isNull(), F.lit(f"missing {field}")).when(here & ~good, F.lit(f"type of {field}"))
    return payloads.withColumn("error", error)
