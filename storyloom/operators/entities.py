"""Entity extraction (E1-E9): a gazetteer of known names and runs of capitalised title words."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import entity_key, words_array

EDGE_PUNCTUATION = "\",.:;!?()[]{}"


def gazetteer(spark: SparkSession, extra: Iterable[tuple[str, str, float]] = ()) -> DataFrame:
    """(term, name, entity_type, confidence, norm): the known names and ``extra`` (term, type, confidence) with their display forms."""
    rows = [(t, "organization", 0.95, False) for t in V.ORGANIZATIONS] + [(t, "brand", 0.95, True) for t in V.BRANDS]
    rows += [(t, "country", 0.90, False) for t in V.COUNTRIES] + [(t, "location", 0.90, False) for t in V.CITIES] + [(t, k, c, False) for t, k, c in extra]
    named = [(t, t.title() if brand or len(t) > 3 else t.upper(), k, c) for t, k, c, brand in rows]
    return spark.createDataFrame(named, "term string, name string, entity_type string, confidence double").withColumn("norm", entity_key(F.col("name")))


def known_names(articles: DataFrame, names: DataFrame) -> DataFrame:
    """(id, term): each known term that stands between word boundaries in title and summary (E1), also within and across other terms.

    Texts and terms are cut alike into words and single other characters, so a term is a run of pieces. Runs of the lengths that terms have are
    joined with the terms: Spark broadcasts a short list and shuffles a long one, and terms may be as many as they like. Terms are lower case.
    """
    pieces = lambda c: F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_])"), F.lit(1))
    is_word = lambda c: c.rlike(r"^[\p{L}\p{N}_]")
    terms = names.select("term").where("term <> ''").distinct()
    sizes = sorted(r["n"] for r in terms.select(F.size(pieces(F.col("term"))).alias("n")).distinct().collect())  # one number for each length
    if not sizes:
        return articles.select("id", F.lit(None).cast("string").alias("term")).limit(0)
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))))
    cut = articles.select("id", pieces(text).alias("p")).where(F.size("p") > 0)
    # a word piece has no word before or after it; another piece may, and then no term begins or ends there
    piece = lambda i: F.get("p", i)
    begins = F.filter(F.sequence(F.lit(0), F.size("p") - 1), lambda i: (i == 0) | ~is_word(piece(i - 1)))
    cut = cut.withColumn("begins", begins)

    def found(n: int):
        ends = lambda i: (i + n <= F.size("p")) & ((i + n == F.size("p")) | ~is_word(piece(i + n)))
        return F.transform(F.filter("begins", ends), lambda i: F.array_join(F.slice("p", i + 1, n), ""))

    runs = cut.select("id", F.explode(F.array_distinct(F.flatten(F.array(*(found(n) for n in sizes))))).alias("term"))
    return runs.join(terms, "term").select("id", "term")


def proper_nouns(articles: DataFrame, stop_words: Iterable[str] = V.ENTITY_STOP_WORDS) -> DataFrame:
    """(id, pos, name, entity_type): runs of capitalised title words that are not stop words.

    The words of a title stay in one row: a fold collects the runs, so there is no shuffle. A run begins with a word of more than two
    characters; two words or more make a person, one an organization.
    """
    stops = words_array(stop_words)
    words = F.transform(F.split(F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"\s+", " ")), " "), lambda w: F.btrim(w, F.lit(EDGE_PUNCTUATION)))
    capital = lambda w: w.rlike(r"^\p{Lu}") & ~F.array_contains(stops, F.lower(w))
    start = F.struct(F.array().cast("array<struct<pos:int,words:array<string>>>").alias("runs"), F.lit(False).alias("open"), F.lit(0).alias("i"))

    def step(acc, w):
        runs, ok = acc["runs"], capital(w)
        last = F.element_at(runs, F.size(runs))
        longer = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct(last["pos"].alias("pos"), F.concat(last["words"], F.array(w)).alias("words"))))
        new = F.concat(runs, F.array(F.struct(acc["i"].alias("pos"), F.array(w).alias("words"))))
        begin = ok & ~acc["open"] & (F.length(w) > 2)
        return F.struct(F.when(ok & acc["open"], longer).when(begin, new).otherwise(runs).alias("runs"), (ok & acc["open"] | begin).alias("open"), (acc["i"] + 1).alias("i"))

    runs = articles.select("id", F.explode(F.aggregate(words, start, step)["runs"]).alias("r"))
    return runs.select("id", F.col("r.pos").alias("pos"), F.array_join("r.words", " ").alias("name"), F.when(F.size("r.words") >= 2, "person").otherwise("organization").alias("entity_type"))


def article_entities(articles: DataFrame, names: DataFrame) -> DataFrame:
    """(id, norm, name, entity_type, confidence): one row per article and entity (E1-E6, E8). ``articles``: id, title, summary.

    A dictionary match beats a proper noun of the same key, and the first phrase of a title beats later ones.
    """
    known = known_names(articles, names).join(names, "term").select("id", F.lit(0).alias("rank"), F.lit(0).alias("pos"), "norm", "name", "entity_type", "confidence")
    nouns = proper_nouns(articles).select("id", F.lit(1).alias("rank"), "pos", entity_key(F.col("name")).alias("norm"), "name", "entity_type", F.lit(0.75).alias("confidence")).where("norm <> ''")
    best = known.unionByName(nouns).groupBy("id", "norm").agg(F.min(F.struct("rank", "pos", "name", "entity_type", "confidence")).alias("b"))
    return best.select("id", "norm", "b.name", "b.entity_type", "b.confidence")


def entity_dimension(links: DataFrame, articles: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """(norm, name, entity_type): the first writer by publish time and id fixes name and type (E7); entities of ``history`` stay as they are."""
    seen = links.join(articles.select("id", "published_us"), "id").groupBy("norm").agg(F.min(F.struct("published_us", "id", "name", "entity_type")).alias("f"))
    new = seen.select("norm", "f.name", "f.entity_type")
    return new if history is None else history.select("norm", "name", "entity_type").unionByName(new.join(history, "norm", "left_anti"))


def cluster_mentions(links: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster_id, norm, mention_count): distinct articles of the cluster that mention the entity."""
    return links.select("id", "norm").distinct().join(members, "id").groupBy("cluster_id", "norm").agg(F.count(F.lit(1)).alias("mention_count"))


def rank_mentions(mentions: DataFrame) -> DataFrame:
    """Mentions with their rank in the cluster, most mentions first."""
    return mentions.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("mention_count"), "norm")))
