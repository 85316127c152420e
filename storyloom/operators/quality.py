"""Quality components, overall score, confidence and review status (Q1-Q10). Scores are whole numbers from 0 to 100."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import any_contained


def _whole(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), x)).cast("int")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def evidence_coverage(used: Column, evidence: Column, article_count: Column) -> Column:
    """Share of the cluster's articles that were used (Q1)."""
    total = F.greatest(article_count, F.size(evidence))
    share = F.size(F.array_intersect(used, evidence)) / F.greatest(total, F.lit(1))
    return F.when(total <= 0, 0).otherwise(F.bround(F.least(F.lit(1.0), share) * 100, 0).cast("int"))


def factual_support(n_findings: Column, n_words: Column) -> Column:
    """100 minus 25 for each finding per hundred words (Q2)."""
    return F.when(n_words <= 0, 0).otherwise(F.floor(F.greatest(F.lit(0.0), 100.0 - 25.0 * (n_findings / F.greatest(n_words / 100.0, F.lit(0.5))))).cast("int"))


def attribution(text: Column, publishers: Column) -> Column:
    """Share of publishers named in the copy, and 15 for attribution language from one half on (Q3)."""
    low, n = F.lower(text), F.size(publishers)
    base = F.floor(F.size(F.filter(publishers, lambda p: F.contains(low, F.lower(p)))) / F.greatest(n, F.lit(1)) * 100).cast("int")
    return F.when(n == 0, 0).otherwise(F.when(any_contained(low, V.CREDIT_MARKERS) & (base >= 50), F.least(F.lit(100), base + 15)).otherwise(base))


def completeness(sections: dict[str, Column], generation_type: str) -> Column:
    """Percentage of the required sections that are not blank (Q4); a list counts as present even if empty."""
    need = V.REQUIRED_SECTIONS.get(generation_type.lower(), ())
    if not need:
        return F.lit(100)
    return F.bround(sum((F.trim(F.coalesce(sections[k].cast("string"), F.lit(""))) != "").cast("int") if k in sections else F.lit(0) for k in need) / len(need) * 100, 0).cast("int")


def sentence_lengths(text: Column) -> Column:
    """Words of each sentence that is not blank; a sentence ends at white space after a full stop, an exclamation or a question mark."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])\s+", "$1\u0001")
    return F.transform(F.filter(F.split(marked, "\u0001"), lambda s: s.rlike(r"\S")), word_count)


def _mean(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x) / F.greatest(F.size(lengths), F.lit(1))


def _overlong(lengths: Column) -> Column:
    return F.size(F.filter(lengths, lambda x: x > 34))


def clarity(lengths: Column) -> Column:
    """Long sentences cost: three points for each word of the mean over 22, six for each sentence over 34 (Q5)."""
    return F.when(F.size(lengths) == 0, 0).otherwise(_whole(100 - F.greatest(F.lit(0), ((_mean(lengths) - 22) * 3).cast("int")) - 6 * _overlong(lengths)))


def _headline_signs(headline: Column) -> dict[str, Column]:
    h = F.coalesce(headline, F.lit(""))
    low = F.lower(h)
    hits = lambda terms: F.filter(F.array(*(F.lit(t) for t in terms)), lambda t: F.contains(low, t))
    return {"text": h, "words": word_count(h), "clickbait": hits(V.CLICKBAIT_TERMS), "superlatives": hits(V.SUPERLATIVE_TERMS), "empty": low.endswith("?") & ~h.rlike(r"[\p{L}\p{N}]")}


def headline_quality(headline: Column) -> Column:
    """Length, clickbait, superlatives and empty questions (Q6)."""
    x = _headline_signs(headline)
    score = 100 - F.when(x["words"] < 3, 25).when(x["words"] > 14, 20).otherwise(0) - F.when(F.size(x["clickbait"]) > 0, 30).otherwise(0) - F.when(F.size(x["superlatives"]) > 0, 20).otherwise(0) - F.when(x["empty"], 15).otherwise(0)
    return F.when(F.trim(x["text"]) == "", 0).otherwise(_whole(score))


def risk_level(flags: Column) -> Column:
    """100 minus the weight of every finding (Q7); ``flags`` has one entry for each."""
    weight = lambda f: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in V.RISK_WEIGHTS.items() for x in kv)), f), F.lit(10))
    return F.greatest(F.lit(0), 100 - F.aggregate(flags, F.lit(0), lambda a, f: a + weight(f))).cast("int")


def review_status(flags: Column, overall: Column) -> Column:
    """REGENERATE for serious flags or under 55, NEEDS_REVIEW for any flag, else GENERATED (Q10)."""
    serious = F.array(*(F.lit(f) for f in V.SERIOUS_FLAGS))
    return F.when(F.arrays_overlap(flags, serious) | (overall < 55), "REGENERATE").when(F.size(flags) > 0, "NEEDS_REVIEW").otherwise("GENERATED")


def _listed(values: Column) -> Column:
    """A list of texts as the explanations show it."""
    quoted = F.transform(values, lambda v: F.when(F.contains(v, F.lit("'")), F.concat(F.lit('"'), v, F.lit('"'))).otherwise(F.concat(F.lit("'"), v, F.lit("'"))))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def explanations(used: Column, article_count: Column, n_findings: Column, n_words: Column, text: Column, publishers: Column, sections: dict[str, Column], generation_type: str, lengths: Column, headline: Column, flags: Column, penalty: Column) -> Column:
    """One sentence for each component, in their order, and one for a penalty that was applied (Q9)."""
    low = F.lower(text)
    credited = F.size(F.filter(publishers, lambda p: F.contains(low, F.lower(p))))
    spoken = F.when(any_contained(low, V.CREDIT_MARKERS), ", attribution language present").otherwise("")
    need = V.REQUIRED_SECTIONS.get(generation_type.lower(), ())
    there = F.array_compact(F.array(*(F.when(F.trim(F.coalesce(sections[k].cast("string"), F.lit(""))) != "", k) for k in need if k in sections)).cast("array<string>"))
    x = _headline_signs(headline)
    signs = F.array_compact(F.array(
        F.when(x["words"] < 3, "too short").when(x["words"] > 14, "too long"), F.when(F.size(x["clickbait"]) > 0, F.concat(F.lit("clickbait terms "), _listed(x["clickbait"]))),
        F.when(F.size(x["superlatives"]) > 0, F.concat(F.lit("unsupported superlatives "), _listed(x["superlatives"]))), F.when(x["empty"], "empty teaser question"),
    ))
    notes = {
        "evidence_coverage": F.when(article_count <= 0, "No articles in evidence set.").otherwise(F.format_string("%d of %d cluster articles used.", F.size(used), article_count)),
        "factual_support": F.when(n_words <= 0, "No generated text to evaluate.").otherwise(F.format_string("%d guard finding(s) across %d words.", n_findings, n_words)),
        "attribution": F.when(F.size(publishers) == 0, "No publishers in evidence.").otherwise(F.concat(F.format_string("%d/%d publishers credited in copy", credited, F.size(publishers)), spoken)),
        "completeness": F.concat(F.lit("Sections present: "), F.when(F.size(there) == 0, "none").otherwise(_listed(there)), F.lit(".")) if need else F.lit("No structural requirements."),
        "clarity": F.when(F.size(lengths) == 0, "No sentences to evaluate.").otherwise(F.format_string("Average sentence length %.1f words; %d overly long.", _mean(lengths), _overlong(lengths))),
        "headline_quality": F.when(F.trim(x["text"]) == "", "No headline.").when(F.size(signs) == 0, "within editorial style bounds").otherwise(F.array_join(signs, "; ")),
        "risk_level": F.format_string("%d active risk finding(s).", n_findings),
    }
    lost = F.when(penalty > 0, F.concat(F.format_string("Hard penalty -%d applied for unresolved flags ", penalty), _listed(F.array_sort(flags)), F.lit(".")))
    return F.array_compact(F.array(*(F.concat(F.lit(f"{k}: "), v) for k, v in notes.items()), lost))


def assess(checked: DataFrame, generation_type: str, text_col: str = "copy", sections: dict[str, str] | None = None, used_col: str = "article_ids") -> DataFrame:
    """``checked`` drafts (findings, flags, article_ids, article_count, publishers, headline, corroboration) with all components, ``overall``,
    ``confidence``, ``status`` and ``quality_notes`` (Q1-Q10). Package drafts keep the status GENERATED. The words and the sentences of a text are
    counted once."""
    parts = {k: F.col(c) for k, c in (sections or {}).items()}
    n = F.size("findings")
    out = checked.withColumn("_words", word_count(F.col(text_col))).withColumn("_lengths", sentence_lengths(F.col(text_col)))
    out = out.withColumn("evidence_coverage", evidence_coverage(F.col(used_col), F.col("article_ids"), F.col("article_count").cast("int")))
    out = out.withColumn("factual_support", factual_support(n, F.col("_words"))).withColumn("attribution_score", attribution(F.col(text_col), F.col("publishers")))
    out = out.withColumn("completeness", completeness(parts, generation_type)).withColumn("clarity", clarity(F.col("_lengths")))
    out = out.withColumn("headline_quality", headline_quality(F.col("headline"))).withColumn("risk_level", risk_level(F.col("findings.flag")))
    column = {k: F.col("attribution_score" if k == "attribution" else k) for k in V.QUALITY_WEIGHTS}
    raw = sum(column[k] * F.lit(w) for k, w in V.QUALITY_WEIGHTS.items())
    penalty = sum((F.when(F.array_contains("flags", f), p).otherwise(0) for f, p in V.HARD_PENALTIES.items()), F.lit(0))
    out = out.withColumn("overall", _whole(F.bround(F.round(raw - penalty, 6), 0)))
    out = out.withColumn("confidence", _whole(F.bround(F.round(F.col("factual_support") * 0.5 + F.col("corroboration") * 0.5, 6), 0)))
    status = F.lit("GENERATED") if generation_type.upper() == "PACKAGE" else review_status(F.col("flags"), F.col("overall"))
    count = F.greatest(F.col("article_count").cast("int"), F.when(F.col("article_count") > 0, 0).otherwise(F.size("article_ids")))
    notes = explanations(F.col(used_col), count, n, F.col("_words"), F.col(text_col), F.col("publishers"), parts, generation_type, F.col("_lengths"), F.col("headline"), F.col("flags"), penalty)
    return out.withColumn("status", status).withColumn("quality_notes", notes).drop("_words", "_lengths")
