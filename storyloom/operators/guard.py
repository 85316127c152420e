"""Claim guard (G1-G11): checks of draft text against a cluster's evidence. All checks are array expressions on one joined row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_contained, dates, numbers, plain_name
from ..functions.vocabulary import ATTRIBUTION_MARKERS, DESK_TERMS, GUARD_STOP_WORDS

_WORD = r"[A-Z][a-zA-Z'’\.]+"
#: Of white space only blanks and tabs, so a candidate ends with its line. The capital is looked for first, as it is rarer than a word's bound.
CANDIDATE = rf"(?=[A-Z])\b({_WORD}(?:[ \t]+(?:of|the|and|for|de|van|von)?[ \t]*{_WORD}){{0,3}})\b"
QUOTE = "[\"“']([^\"”']{15,})[\"”']"
URL = r"https?://[^\s\"'<>)\]]+"


def once(value: Column, body) -> Column:
    """``body`` of a value that is computed once for the row, however often the body, or a lambda in it, refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def evidence_corpus(articles: Column, entities: Column, title: Column, names: Column) -> Column:
    """All evidence text in guard form: titles, excerpts, publishers, entities by name and key, and the story's title (G1)."""
    parts = F.flatten(F.transform(articles, lambda a: F.array(a["title"], a["excerpt"], a["publisher"])))
    return plain_name(F.array_join(F.concat(parts, F.flatten(F.zip_with(names, entities, lambda n, e: F.array(n, e))), F.array(title)), " "))


def candidates(text: Column) -> Column:
    """(form, said) of the distinct proper-noun candidates of each line that are more than a stop word or desk term."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(CANDIDATE), 1))
    skip = F.array(*(F.lit(w) for w in (*GUARD_STOP_WORDS, *DESK_TERMS)))
    return F.filter(F.transform(found, lambda c: F.struct(plain_name(c).alias("form"), c.alias("said"))), lambda c: (c["form"] != "") & ~F.array_contains(skip, c["form"]))


def unsupported_entities(found: Column, corpus: Column, names: Column) -> Column:
    """First candidate of each form that is neither in the corpus nor overlaps a known name (G3). An empty known name supports everything.
    ``found`` are candidates."""
    bad = F.filter(F.array_distinct(found["form"]), lambda c: ~F.contains(corpus, c) & ~F.exists(names, lambda n: F.contains(n, c) | F.contains(c, n)))
    return F.transform(bad, lambda b: F.get(found["said"], (F.array_position(found["form"], b) - 1).cast("int")))


def bare_figure(figure: Column) -> Column:
    return F.replace(F.regexp_replace(figure, "%+$", ""), F.lit(","), F.lit(""))


def unsupported_numbers(text: Column, supported: Column, known: Column) -> Column:
    """Figures that are not supported, unless every supported figure contains them or is contained (G4; true when there is none).
    ``known`` are the bare supported figures that are not empty."""
    inside = lambda x: (x != "") & F.forall(known, lambda s: F.contains(s, x) | F.contains(x, s))
    return F.filter(F.array_except(numbers(text), supported), lambda x: ~inside(bare_figure(x)))


def unsupported_dates(text: Column, supported: Column) -> Column:
    return F.array_except(dates(text), supported)


def unsupported_quotes(text: Column, corpus: Column) -> Column:
    """Quoted spans of 15 characters or more that the evidence doesn't have word for word."""
    return F.filter(F.regexp_extract_all(text, F.lit(QUOTE), 1), lambda q: ~F.contains(corpus, plain_name(q)))


def unsupported_urls(text: Column, urls: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(URL), 0), lambda u: ~F.array_contains(urls, u))


def lacks_attribution(text: Column, publishers: Column) -> Column:
    """No attribution marker and no publisher's name."""
    named = lambda low: F.exists(F.filter(publishers, lambda p: p != ""), lambda p: F.contains(low, p))
    return once(F.lower(text), lambda low: ~any_contained(low, ATTRIBUTION_MARKERS) & ~named(low))


def check(drafts: DataFrame, bundle: DataFrame | None = None, text_col: str = "copy") -> DataFrame:
    """``drafts`` (cluster_id and the text) with ``findings`` (array of flag, snippet) and ``flags`` in first-seen order.

    Without ``bundle`` the drafts carry their evidence themselves. ``claims_supported`` is true where nothing was found. Every form of the text and
    of the evidence is computed once for a draft.
    """
    names = {"articles": "_a", "entities": "_e", "entity_names": "_en", "conflicts": "_c", "publishers": "_p", "urls": "_u", "title": "_t"}
    if bundle is None:
        d = drafts.withColumns({to: F.col(c) for c, to in names.items()})
    else:
        d = drafts.join(bundle.select("cluster_id", *(F.col(c).alias(to) for c, to in names.items())), "cluster_id")
    said = F.array_join(F.transform("_a", lambda a: F.concat(a["title"], F.lit(" "), a["excerpt"])), "\n")
    figures = F.array_union(numbers(said), F.array_distinct(F.flatten("_a.numbers")))
    forms = F.struct(
        F.coalesce(F.col(text_col), F.lit("")).alias("text"), evidence_corpus(F.col("_a"), F.col("_e"), F.col("_t"), F.col("_en")).alias("corpus"), F.transform("_p", plain_name).alias("publishers"),
        F.array_union(F.transform("_en", plain_name), F.transform("_p", plain_name)).alias("names"), candidates(F.coalesce(F.col(text_col), F.lit(""))).alias("candidates"), figures.alias("figures"),
        F.array_distinct(F.filter(F.transform(figures, bare_figure), lambda s: s != "")).alias("bare"), F.array_union(dates(said), F.array_distinct(F.flatten("_a.dates"))).alias("dates"), F.map_values("_u").alias("urls"),
        F.transform("_c", lambda c: F.concat_ws(", ", c["a"].cast("string"), c["b"].cast("string"))).alias("conflicts"), F.size("_a").alias("articles"),
    )
    flag = lambda name, values: F.transform(values, lambda v: F.struct(F.lit(name).alias("flag"), v.cast("string").alias("snippet")))
    alone = lambda name, when: F.when(when, F.array(F.struct(F.lit(name).alias("flag"), F.lit("").alias("snippet")))).otherwise(F.array().cast("array<struct<flag:string,snippet:string>>"))

    def found(x: Column) -> Column:
        text = x["text"]
        return F.concat(
            alone("LOW_EVIDENCE", x["articles"] < 2),
            flag("CONFLICTING_SOURCES", x["conflicts"]),
            flag("UNSUPPORTED_ENTITY", unsupported_entities(x["candidates"], x["corpus"], x["names"])),
            flag("UNSUPPORTED_NUMBER", unsupported_numbers(text, x["figures"], x["bare"])),
            flag("UNSUPPORTED_DATE", unsupported_dates(text, x["dates"])),
            flag("UNSUPPORTED_QUOTE", F.transform(unsupported_quotes(text, x["corpus"]), lambda q: F.substring(q, 1, 80))),
            flag("UNSUPPORTED_URL", unsupported_urls(text, x["urls"])),
            alone("MISSING_ATTRIBUTION", lacks_attribution(text, x["publishers"])),
        )

    out = d.withColumn("findings", once(forms, found)).withColumn("flags", F.array_distinct("findings.flag")).withColumn("claims_supported", F.size("findings") == 0)
    return out.drop(*names.values())
