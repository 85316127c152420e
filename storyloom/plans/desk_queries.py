"""Registered queries over pages, tables, briefs, claim guard, quality, ledger and time windows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from ..operators import brief, entities, guard, ledger, normalize, quality, score, views
from ..operators.graph import Scratch, stored
from ..sources import feeds, tables
from ..streaming import flow
from . import model
from .story_queries import BASE, scored

# --- pages as feed entries --------------------------------------------------------------------------------------------------------------


def page_entries(spark, sf_dir):
    p = model.table(spark, sf_dir, "pages")
    none = lambda t: F.lit(None).cast(t)
    return p.select(
        F.col("page_id").alias("source_id"), F.lit("2024-01-05 00:00:00").cast("timestamp").alias("fetched_at"), F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.col("url").alias("link"),
        none("string").alias("guid"), none("string").alias("published"), none("string").alias("author"), F.col("html").alias("summary"), none("string").alias("content"), none("string").alias("category"),
        none(feeds.EMPTY_FILES).alias("enclosures"), none(feeds.EMPTY_MEDIA).alias("media_content"),
    )


def normalized_pages(spark, sf_dir):
    n = normalize.normalize_entries(page_entries(spark, sf_dir))
    return n.select(F.col("source_id").alias("page_id"), "title", "canonical_url", "content_hash", "summary", F.length("content").alias("content_chars"), "category", "language", "reject_reason")


def parsed_times(spark, sf_dir):
    """Event times written in eight spellings of RFC 822, ISO 8601 and prose, one of them broken, and read back."""
    e = model.table(spark, sf_dir, "events").select("event_id", F.expr("cast(ts as timestamp)").alias("t"))
    spellings = ("EEE, dd MMM yyyy HH:mm:ss 'GMT'", "yyyy-MM-dd'T'HH:mm:ss'+01:00'", "yyyy-MM-dd HH:mm:ss", "'soon'", "EEE, d MMM yy HH:mm:ss 'EST'", "MMMM d, yyyy", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "d MMM yyyy h:mm a")
    raw = F.coalesce(*(F.when(F.col("event_id") % 8 == i, F.date_format("t", f)) for i, f in enumerate(spellings)))
    fallback = F.lit("2024-01-05 00:00:00").cast("timestamp")
    return e.select("event_id", F.unix_seconds(X.parse_time(raw, fallback)).alias("epoch_s"))


def rss_payloads(spark, sf_dir):
    """Every page as a one-item RSS payload, parsed again."""
    p = model.table(spark, sf_dir, "pages")
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    xml = F.concat(F.lit('<rss version="2.0"><channel><title>Pages</title><item><title>'), esc(title), F.lit("</title><link>"), esc(F.col("url")), F.lit("</link><description>"), esc(F.col("html")), F.lit("</description></item></channel></rss>"))
    return p.select(F.col("page_id").alias("source_id"), F.lit("2024-01-05 00:00:00").cast("timestamp").alias("fetched_at"), xml.alias("payload"))


def parsed_feeds(spark, sf_dir):
    entries, _ = feeds.parse_feeds(rss_payloads(spark, sf_dir))
    return entries.select("source_id", "link", "guid", F.length("title").alias("title_chars"))


# --- tables -----------------------------------------------------------------------------------------------------------------------------


def enabled_sources(spark, sf_dir):
    return tables.scan(model.sources(spark, sf_dir), ["id"], limit=100, enabled=True).select("id", "name", "trust_level")


def seeded_sources(spark, sf_dir):
    """The sources of the newest day's articles that earlier articles don't have, and a new feed for every language."""
    art = model.articles(spark, sf_dir)
    feed = lambda df: df.select(F.concat("language", F.lit("/"), "category").alias("feed_url"), F.lit(1).alias("n"))
    cut = model.as_of(art) - 24 * score.HOUR
    fresh = feed(art.where(F.col("published_us") > cut)).unionByName(art.select(F.concat(F.lit("new/"), "language").alias("feed_url"), F.lit(1).alias("n")).distinct())
    return tables.insert_absent(fresh, feed(art.where(F.col("published_us") <= cut)).distinct(), "feed_url").select("feed_url")


def patched_sources(spark, sf_dir):
    src = model.sources(spark, sf_dir)
    changes = src.select("id", F.when(F.col("id") % 2 == 0, F.upper("name")).alias("name"), F.when(F.col("id") % 3 == 0, "world").alias("category"))
    return tables.patch(src, changes, "id").select("id", "name", "category", "trust_level")


def cascade_deleted(spark, sf_dir):
    art = model.articles(spark, sf_dir)
    src = model.sources(spark, sf_dir)
    s, a, m = tables.delete_cascade(src.where("not enabled").select("id"), src, art, model.memberships(art))
    count = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    return count(s, "sources").unionByName(count(a, "articles")).unionByName(count(m, "links"))


def _outcomes(spark, sf_dir):
    art = model.articles(spark, sf_dir)
    heads = art.groupBy("title").agg(F.min("id").alias("head"))
    day = F.floor(F.col("published_us") / (24 * score.HOUR))
    outcome = F.when(F.length("content") == 0, "failed").when(F.col("id") == F.col("head"), "ingested").otherwise("skipped")
    return art.join(heads, "title").select(day.alias("run_id"), "source_id", outcome.alias("outcome"))


def run_audit(spark, sf_dir):
    return normalize.run_audit(_outcomes(spark, sf_dir))


def run_history(spark, sf_dir):
    return tables.scan(run_audit(spark, sf_dir), [F.desc("run_id"), "source_id"], limit=30).select("run_id", "source_id", "articles_found")


def article_counts(spark, sf_dir):
    return model.articles(spark, sf_dir).groupBy("source_id", "category").agg(F.count(F.lit(1)).alias("n"))


def article_page(spark, sf_dir):
    return tables.scan(model.articles(spark, sf_dir), [F.desc("published_us"), F.desc("id")], 20, 40, category="world", language="en").select("id", "source_id", "published_us")


def title_lookups(spark, sf_dir):
    """Key-batch lookup: articles whose title is the title of some story with two articles or more."""
    art = model.articles(spark, sf_dir)
    keys = art.groupBy("title").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("title")
    return art.join(keys, "title", "left_semi").select("id")


# --- briefs, guard, quality, ledger -----------------------------------------------------------------------------------------------------


def _bundles(spark, sf_dir, stories=None, evidence_only=False, scratch=None):
    """``scratch`` stores what is read more than once: links of entities, and the evidence with its figures and dates."""
    from .story_queries import _links

    put = (lambda df, name: df) if scratch is None else scratch.put
    art, src = model.articles(spark, sf_dir), model.sources(spark, sf_dir)
    members, links = model.memberships(art), put(_links(spark, art), "links")
    mentions = entities.cluster_mentions(links, members).join(entities.entity_dimension(links, art).select("norm", "name"), "norm")
    stories = scored(spark, sf_dir, links) if stories is None else stories
    return brief.bundles(stories, put(brief.evidence_articles(members, art, src), "evidence"), mentions, evidence_only)


def _finished(spark, name, make):
    """The stored result of ``make(scratch)``, whose working tables are deleted."""
    scratch = Scratch(spark, name)
    out = stored(make(scratch), name)
    scratch.close()
    return out


def _package(spark, sf_dir, scratch=None):
    return brief.package(brief.briefs(_bundles(spark, sf_dir, scratch=scratch)))


def evidence_conflicts(spark, sf_dir):
    art = model.articles(spark, sf_dir)
    return brief.conflicts(brief.evidence_articles(model.memberships(art), art, model.sources(spark, sf_dir))).select("cluster_id", "a", "b", "detail")


def evidence_provenance(spark, sf_dir):
    b = _bundles(spark, sf_dir)
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), "|").alias(c)
    return b.select("cluster_id", joined("article_ids"), joined("source_ids"), joined("publishers"), F.size("urls").alias("n_urls"))


def evidence_fingerprints(spark, sf_dir):
    return _bundles(spark, sf_dir, _titles(spark, sf_dir), evidence_only=True).select("cluster_id", "context_hash")


def _members(spark, sf_dir):
    art = model.articles(spark, sf_dir)
    return model.memberships(art), art, model.sources(spark, sf_dir)


def story_briefs(spark, sf_dir):
    joined = lambda c: F.array_join(c, "|").alias(c)
    return _package(spark, sf_dir).select("cluster_id", "headline", joined("alternate_headlines"), "summary", joined("summary_facts"), "body", "dek", joined("uncertainties"), "caption", joined("hashtags"))


def story_packages(spark, sf_dir):
    p = _package(spark, sf_dir)
    return p.select("cluster_id", F.size("headline_candidates").alias("n_headlines"), F.size("key_facts").alias("n_facts"), F.length("copy").alias("copy_chars"), F.length(brief.payload_text(p.select("headline", "dek", "body", "summary", "caption", "key_facts"))).alias("text_chars"))


def payload_audit(spark, sf_dir):
    """Conversation rows as provider payloads: the text under different names, checked against the summary schema."""
    c = model.table(spark, sf_dir, "conversations")
    good = F.to_json(F.struct(F.col("text").alias("summary"), F.array("role").alias("key_facts"), F.array().cast("array<string>").alias("risk_flags")))
    wrong = F.to_json(F.struct(F.col("text").alias("summary"), F.col("role").alias("key_facts")))
    payload = F.when(F.col("role") == "user", good).when(F.col("role") == "assistant", wrong).otherwise(F.col("text"))
    return brief.payload_errors(c.select("conv_id", "turn", F.lit("summary_result").alias("schema_name"), payload.alias("payload_json"))).select("conv_id", "turn", "error")


def _checked(spark, sf_dir, scratch, stories=None):
    """Each cluster's lead article in full, as a draft, against that cluster's evidence."""
    art = model.articles(spark, sf_dir).select(F.col("id").alias("cluster_id"), F.col("content").alias("copy"))
    return guard.check(_bundles(spark, sf_dir, stories, scratch=scratch).join(art, "cluster_id"))


def _titles(spark, sf_dir):
    return model.articles(spark, sf_dir).select(F.col("id").alias("cluster_id"), "title")


def guard_flags(spark, sf_dir):
    def flags(scratch):
        # the outer form keeps the optimizer from adding a filter that computes the findings a second time
        found = _checked(spark, sf_dir, scratch, _titles(spark, sf_dir)).select("cluster_id", F.explode_outer("findings.flag").alias("flag"))
        return found.where("flag is not null").groupBy("cluster_id", "flag").agg(F.count(F.lit(1)).alias("n"))

    return _finished(spark, "guard-flags", flags)


def guard_findings(spark, sf_dir):
    columns = ("cluster_id", "claims_supported", F.array_join("flags", "|").alias("flags"), F.size("findings").alias("n_findings"))
    return _finished(spark, "guard-findings", lambda scratch: _checked(spark, sf_dir, scratch, _titles(spark, sf_dir)).select(*columns))


def guard_snippets(spark, sf_dir):
    """What each finding points at, in order."""
    said = F.transform("findings", lambda f: F.concat(f["flag"], F.lit("="), f["snippet"]))
    picked = F.filter(said, lambda f: f.startswith("UNSUPPORTED_ENTITY") | f.startswith("UNSUPPORTED_QUOTE") | f.startswith("UNSUPPORTED_DATE"))
    snippets = F.array_join(F.array_sort(picked), "|").alias("snippets")
    return _finished(spark, "guard-snippets", lambda scratch: _checked(spark, sf_dir, scratch, _titles(spark, sf_dir)).select("cluster_id", snippets))


def package_flags(spark, sf_dir):
    """Risk flags of every package: those of the whole copy and those of its summary and body."""
    scratch = Scratch(spark, "packages")
    p = scratch.put(_package(spark, sf_dir, scratch), "packages")  # read by each of the three checks
    checked = guard.check(p)
    sections = [guard.check(p, text_col=c).select("cluster_id", F.explode_outer("flags").alias("flag")).where("flag is not null") for c in ("summary", "body")]
    out = stored(brief.risk_flags(p, checked, sections[0].unionByName(sections[1])).select("cluster_id", F.array_join("risk_flags", "|").alias("risk_flags")), "package-flags")
    scratch.close()
    return out


def copy_quality(spark, sf_dir):
    """The text-only components over whole documents."""
    d = model.table(spark, sf_dir, "documents")
    title = model.first_words()
    d = d.select("doc_id", title.alias("title"), quality.word_count(F.col("text")).alias("n_words"), quality.sentence_lengths(F.col("text")).alias("lengths"))
    return d.select("doc_id", quality.clarity(F.col("lengths")).alias("clarity"), quality.headline_quality(F.col("title")).alias("headline_quality"), "n_words", quality.factual_support(F.col("doc_id") % 4, F.col("n_words")).alias("factual_support"))


def draft_quality(spark, sf_dir):
    columns = ("cluster_id", "evidence_coverage", "attribution_score", "completeness", "clarity", "headline_quality", "risk_level", "factual_support", "overall", "confidence", "status", F.size("quality_notes").alias("n_notes"))

    def assessed(scratch):
        drafts = _checked(spark, sf_dir, scratch).withColumn("headline", F.col("title"))
        return quality.assess(drafts, "ARTICLE", sections={"headline": "title", "dek": "title", "body": "copy"}).select(*columns)

    return _finished(spark, "draft-quality", assessed)


def _generations(spark, sf_dir):
    art = model.articles(spark, sf_dir)
    kind = F.element_at(F.array(*(F.lit(k) for k in V.DRAFT_TYPES)), (F.col("id") % 5 + 1).cast("int"))
    gen = art.select("id", F.col("source_id").alias("story_cluster_id"), kind.alias("generation_type"), F.lit("extractive").alias("provider"), F.col("language").alias("model"), F.lit("v1").alias("prompt_version"), F.col("category").alias("input_context_hash"), (F.col("id") % 3 != 0).cast("int").alias("success"), F.col("published_us").alias("created_at"))
    drafts = gen.where("success = 1 and id % 2 = 0").select((F.col("id") + 1_000_000).alias("id"), F.col("id").alias("generation_id"), F.col("story_cluster_id").alias("cluster_id"), "created_at", "generation_type")
    return gen, drafts


def ledger_reuse(spark, sf_dir):
    gen, drafts = _generations(spark, sf_dir)
    asked = gen.select(*ledger.KEY).distinct()
    reused, to_do = ledger.split_reuse(asked, gen, drafts)
    keep = ["story_cluster_id", "generation_type", "model", "input_context_hash"]
    return reused.select(*keep, "generation_id", "draft_id").unionByName(to_do.select(*keep, F.lit(None).cast("long").alias("generation_id"), F.lit(None).cast("long").alias("draft_id")))


def ledger_history(spark, sf_dir):
    gen, drafts = _generations(spark, sf_dir)
    return views.generations_with_drafts(gen, drafts).select("id", "success", F.array_join(F.col("draft_ids").cast("array<string>"), "|").alias("drafts"))


def ledger_audit(spark, sf_dir):
    c = model.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("payload"), F.when(F.col("role") == "system", "EMPTY").alias("error_code"))
    return ledger.audit_rows(c).select("conv_id", "turn", "success", "output_hash", "output_tokens")


def ledger_types(spark, sf_dir):
    gen, _ = _generations(spark, sf_dir)
    kind = ledger.draft_type(F.col("generation_type"))
    place = F.when(F.col("generation_type") == "PACKAGE", "editorial-package").otherwise(ledger.platform(kind))
    return gen.select("generation_type", kind.alias("draft_type"), place.alias("platform"), ledger.generation_type(kind, place).alias("back")).groupBy("generation_type", "draft_type", "platform", "back").agg(F.count(F.lit(1)).alias("n"))


def draft_provenance(spark, sf_dir):
    ev = brief.evidence_articles(*_members(spark, sf_dir)).withColumn("similarity", 1.0 / F.col("rank"))
    drafts = model.articles(spark, sf_dir).select((F.col("id") + 1_000_000).alias("id"), F.col("id").alias("cluster_id"))
    return ledger.provenance_rows(drafts, ev)


def regenerated_drafts(spark, sf_dir):
    _, drafts = _generations(spark, sf_dir)
    drafts = drafts.select("id", "cluster_id", F.lit("GENERATED").alias("status"))
    wanted = drafts.where("id % 5 = 0")
    return ledger.regenerate(drafts, wanted.select("id"), wanted.select((F.col("id") + 1_000_000).alias("id"), "cluster_id", "status"))


def cited_drafts(spark, sf_dir):
    """Drafts with citations, flattened for comparison."""
    _, drafts = _generations(spark, sf_dir)
    d = views.drafts_with_sources(drafts, draft_provenance(spark, sf_dir), model.articles(spark, sf_dir), model.sources(spark, sf_dir))
    return d.select("id", F.coalesce(F.size("citations"), F.lit(0)).alias("n_citations"), F.array_join("citations.publisher", "|").alias("publishers"))


# --- time windows -----------------------------------------------------------------------------------------------------------------------


def _timed(spark, sf_dir):
    return model.articles(spark, sf_dir).withColumn("published_at", F.timestamp_micros("published_us"))


def coverage_tumbling(spark, sf_dir):
    return flow.coverage_windows(_timed(spark, sf_dir)).select(F.unix_seconds("window.start").alias("start_s"), "category", "articles")


def coverage_sliding(spark, sf_dir):
    return flow.coverage_windows(_timed(spark, sf_dir), "12 hours", "6 hours").select(F.unix_seconds("window.start").alias("start_s"), "category", "articles")


def story_sessions(spark, sf_dir):
    art = _timed(spark, sf_dir)
    s = flow.story_sessions(art.join(model.memberships(art), "id"), "6 hours")
    return s.select("cluster_id", F.unix_micros("session_window.start").alias("start_us"), "articles")


QUERIES = {f.__name__: f for f in (
    normalized_pages, parsed_times, parsed_feeds, enabled_sources, seeded_sources, patched_sources, cascade_deleted, run_audit, run_history, article_counts, article_page, title_lookups,
    evidence_conflicts, evidence_provenance, evidence_fingerprints, story_briefs, story_packages, payload_audit, guard_flags, guard_findings, guard_snippets, package_flags, copy_quality, draft_quality,
    ledger_reuse, ledger_history, ledger_audit, ledger_types, draft_provenance, regenerated_drafts, cited_drafts, coverage_tumbling, coverage_sliding, story_sessions,
)}


def _decode(sql: str) -> str:
    """The references that occur in the pages, written out; the ampersand comes last, also without its semicolon."""
    for ref, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·")):
        sql = f"replace({sql}, '{ref}', '{char}')"
    return f"regexp_replace({sql}, '&amp;?', '&', 'g')"


def _clean(sql: str) -> str:
    for t in ("script", "style", "iframe", "noscript"):
        sql = rf"regexp_replace({sql}, '(?is)<{t}\b.*?</{t}\s*>', ' ', 'g')"
    sql = rf"regexp_replace(regexp_replace({sql}, '(?s)<!--.*?-->', ' ', 'g'), '<[a-zA-Z/!?][^>]*>', ' ', 'g')"
    return rf"trim(regexp_replace({_decode(sql)}, '\s+', ' ', 'g'))"


_TRACK = ", ".join(f"'{p}'" for p in V.TRACKING_PARAMS)
_TRIM = lambda x, n=160: f"(CASE WHEN length(trim({x})) > {n} THEN regexp_replace(substring(trim({x}), 1, {n - 3}), ' [^ ]*$', '') || '...' ELSE trim({x}) END)"
_EV = rf"""bb AS (SELECT cluster_id, art.*, src.name AS publisher, row_number() OVER (PARTITION BY cluster_id ORDER BY published_us DESC, art.id) AS rank FROM mem JOIN art USING (id) JOIN src ON src.id = source_id),
ev AS MATERIALIZED (SELECT *, trim(CASE WHEN excerpt = '' THEN title ELSE regexp_replace(string_split(excerpt, '. ')[1], '\.+$', '') END) AS lead,
  list_sort(list_distinct(regexp_extract_all(title || ' ' || excerpt, '\b\d[\d,\.]*%?\b'))) AS nums
  FROM (SELECT *, substring(trim(CASE WHEN content <> '' THEN content ELSE title END), 1, 1200) AS excerpt FROM bb WHERE rank <= 8))"""


def _story(extra: str) -> str:
    from .story_queries import ENTITIES, SCORES

    return f"WITH {BASE}, {ENTITIES}, {SCORES}, {extra}"


_DAY = "floor(published_us / 86400000000.0)::BIGINT"
_GEN = f"""WITH {BASE}, gen AS (SELECT id, source_id AS story_cluster_id, ['HEADLINES', 'SUMMARY', 'ARTICLE', 'SOCIAL', 'PACKAGE'][id % 5 + 1] AS generation_type, language AS model, category AS input_context_hash,
  (id % 3 <> 0)::INTEGER AS success, published_us AS created_at FROM art),
dra AS (SELECT id + 1000000 AS id, id AS generation_id, story_cluster_id AS cluster_id, created_at FROM gen WHERE success = 1 AND id % 2 = 0)"""
_MARKS = " OR ".join(f"contains(lower(copy), '{m}')" for m in V.ATTRIBUTION_MARKERS)
_CREDIT = " OR ".join(f"contains(lower(copy), '{m}')" for m in V.CREDIT_MARKERS)
_CLICK = " OR ".join("contains(lower(t), '{}')".format(m.replace("'", "''")) for m in V.CLICKBAIT_TERMS)
_SUPER = " OR ".join(f"contains(lower(t), '{m}')" for m in V.SUPERLATIVE_TERMS)

_PLAIN = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9 ]+', '', 'g'))"
_DATE_SQL = r"'(?i)\b(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)\.?\s+\d{1,2}(?:st|nd|rd|th)?,?\s*\d{4}\b|\b\d{4}-\d{2}-\d{2}\b'"
_BRIEFS = _story(_EV) + rf""", g AS (SELECT cluster_id, list(lead ORDER BY rank) FILTER (lead <> '') AS l, list_sort(list_distinct(list(publisher))) AS pub, count(*) AS n FROM ev GROUP BY cluster_id),
b AS (SELECT cluster_id, title, state, coalesce(l, []) AS l, n, array_to_string(pub[1:3], ', ') AS att FROM g JOIN sto USING (cluster_id)),
f AS (SELECT *, coalesce(l[1], title) AS fact, list_transform(l[1:4], lambda x: {_TRIM("x")}) AS sf FROM b),
brf AS MATERIALIZED (SELECT cluster_id, title AS headline, array_to_string(list_filter([title, CASE WHEN len(l) > 1 THEN {_TRIM("l[2]", 110)} END, {_TRIM("(title || ': what ' || att || ' report')", 110)}], lambda x: x IS NOT NULL), '|') AS alternate_headlines,
  least(5, len(list_filter(list_concat([title], [title, CASE WHEN len(l) > 1 THEN {_TRIM("l[2]", 110)} END, {_TRIM("(title || ': what ' || att || ' report')", 110)}]), lambda x: x <> '')))::INTEGER AS n_headlines,
  CASE WHEN len(l) > 0 THEN array_to_string(sf[1:2], ' ') ELSE title END AS summary, array_to_string(sf, '|') AS summary_facts,
  concat_ws(chr(10) || chr(10), fact, nullif(array_to_string(l[2:3], ' '), ''), 'Reporting from ' || att || ' describes these developments.', nullif(array_to_string(l[4:5], ' '), ''),
    'This story was first tracked at an unknown time and is currently marked ' || state || '.') AS body,
  {_TRIM("coalesce(l[2], fact)")} AS dek, CASE WHEN n >= 2 THEN '' ELSE 'Story is reported by a single source; details remain unconfirmed.' END AS uncertainties,
  {_TRIM("(fact || ' (via ' || att || ')')", 280)} AS caption,
  array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(trim(regexp_replace(title, '\s+', ' ', 'g')), ' '), lambda w: lower(trim(w, '.,;:!?"''()'))), lambda w: length(w) > 4), lambda w: '#' || w)[1:3], '|') AS hashtags, len(list_distinct(list_transform(l[1:5], lambda x: {_TRIM("x")})))::INTEGER AS n_facts,
  array_to_string(list_distinct(list_transform(l[1:5], lambda x: {_TRIM("x")})), chr(10)) AS facts FROM f)"""

def _found(prefix: str, drafts: str) -> str:
    """Findings (a: cluster_id, k for the order of the checks, flag, v) of ``drafts`` (cluster_id, copy), with the evidence (s) and the draft (d).

    Letters beyond ASCII become underscores where word boundaries are looked for, as boundaries are those of ASCII here.
    """
    return prefix + rf""", dim AS (SELECT norm, arg_min(lnk.name, (published_us, lnk.id, lnk.name)) AS name FROM lnk JOIN art USING (id) GROUP BY norm),
enn AS (SELECT cluster_id, list(dim.name ORDER BY mention_count DESC, norm) AS en, list(norm ORDER BY mention_count DESC, norm) AS ek FROM men JOIN dim USING (norm) GROUP BY cluster_id),
s AS MATERIALIZED (SELECT cluster_id, n, said, ns, pub, coalesce(en, []) AS en, {_PLAIN("array_to_string(list_concat(parts, flatten(list_transform(list_zip(coalesce(en, []), coalesce(ek, [])), lambda z: [z[1], z[2]])), [t.title]), ' ')")} AS corpus
  FROM (SELECT cluster_id, count(*) AS n, string_agg(title || ' ' || excerpt, chr(10) ORDER BY rank) AS said, list(nums) AS ns, list(publisher) AS pub, flatten(list([title, excerpt, publisher] ORDER BY rank)) AS parts FROM ev GROUP BY cluster_id)
  LEFT JOIN enn USING (cluster_id) JOIN art t ON t.id = cluster_id),
d AS MATERIALIZED (SELECT s.cluster_id, said, pub, en, corpus, copy, list_distinct(list_concat(regexp_extract_all(said, '\b\d[\d,\.]*%?\b'), flatten(ns))) AS sup FROM s JOIN ({drafts}) USING (cluster_id)),
c0 AS (SELECT cluster_id, corpus, list_concat(list_transform(en, lambda x: {_PLAIN("x")}), list_transform(pub, lambda x: {_PLAIN("x")})) AS names,
  flatten(list_transform(regexp_split_to_array(regexp_replace(copy, '[^\x00-\x7F’“”\x{{85}}\x{{2028}}\x{{2029}}]', '_', 'g'), '[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_extract_all(x, '\b([A-Z][a-zA-Z''’\.]+(?:\s+(?:of|the|and|for|de|van|von)?\s*[A-Z][a-zA-Z''’\.]+){{0,3}})\b', 1))) AS cs FROM d),
c1 AS (SELECT cluster_id, corpus, names, unnest(cs) AS v, generate_subscripts(cs, 1) AS i FROM c0),
c2 AS (SELECT cluster_id, arg_min(v, i) AS v, form, any_value(corpus) AS corpus, any_value(names) AS names FROM (SELECT *, {_PLAIN("v")} AS form FROM c1) WHERE form <> '' AND form NOT IN ({", ".join(f"'{w}'" for w in (*V.GUARD_STOP_WORDS, *V.DESK_TERMS))}) GROUP BY cluster_id, form),
x AS (SELECT cluster_id, unnest(list_distinct(regexp_extract_all(copy, '\b\d[\d,\.]*%?\b'))) AS v, sup FROM d),
y AS (SELECT cluster_id, v, replace(regexp_replace(v, '%+$', ''), ',', '') AS bare, list_filter(list_transform(sup, lambda z: replace(regexp_replace(z, '%+$', ''), ',', '')), lambda z: z <> '') AS known FROM x WHERE NOT list_contains(sup, v)),
i AS (SELECT cluster_id, unnest(list_distinct(regexp_extract_all(copy, {_DATE_SQL}))) AS v, said FROM d),
qu AS (SELECT cluster_id, corpus, unnest(regexp_extract_all(copy, '["“'']([^"”'']{{15,}})["”'']', 1)) AS v FROM d),
a AS MATERIALIZED (SELECT cluster_id, 1 AS k, 'LOW_EVIDENCE' AS flag, '' AS v FROM s WHERE n < 2
  UNION ALL SELECT e.cluster_id, 2, 'CONFLICTING_SOURCES', '' FROM ev e JOIN ev f ON e.cluster_id = f.cluster_id AND e.rank < f.rank WHERE len(e.nums) > 0 AND len(f.nums) > 0 AND NOT list_has_any(e.nums, f.nums)
  UNION ALL SELECT cluster_id, 3, 'UNSUPPORTED_ENTITY', v FROM c2 WHERE NOT contains(corpus, form) AND len(list_filter(names, lambda z: contains(z, form) OR contains(form, z))) = 0
  UNION ALL SELECT cluster_id, 4, 'UNSUPPORTED_NUMBER', v FROM y WHERE bare = '' OR len(list_filter(known, lambda z: NOT (contains(z, bare) OR contains(bare, z)))) > 0
  UNION ALL SELECT cluster_id, 5, 'UNSUPPORTED_DATE', v FROM i WHERE NOT list_contains(regexp_extract_all(said, {_DATE_SQL}), v)
  UNION ALL SELECT cluster_id, 6, 'UNSUPPORTED_QUOTE', substring(v, 1, 80) FROM qu WHERE NOT contains(corpus, {_PLAIN("v")})
  UNION ALL SELECT cluster_id, 7, 'UNSUPPORTED_URL', u FROM (SELECT cluster_id, unnest(regexp_extract_all(copy, 'https?://[^\s"''<>)\]]+')) AS u FROM d) WHERE NOT starts_with(u, 'https://example.org/a/')
  UNION ALL SELECT cluster_id, 8, 'MISSING_ATTRIBUTION', '' FROM d WHERE NOT ({_MARKS}) AND len(list_filter(pub, lambda p: contains(lower(copy), p))) = 0)"""


_FOUND = _found(_story(_EV), "SELECT id AS cluster_id, content AS copy FROM art")

ORACLES = {
    "normalized_pages": rf"""WITH p AS (SELECT page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title, trim(url) AS url, {_clean("html")} AS clean FROM pages),
u AS (SELECT *, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)([^?#]*)(?:\?([^#]*))?', ['s', 'h', 'p', 'q']) AS m FROM p),
k AS (SELECT *, array_to_string(list_transform(list_filter(string_split(m.q, '&'), lambda x: x <> '' AND lower(string_split(x, '=')[1]) NOT IN ({_TRACK})), lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END), '&') AS q FROM u),
c AS (SELECT *, CASE WHEN m.h = '' THEN url ELSE lower(m.s) || '://' || lower(m.h) || CASE WHEN length(m.p) > 1 THEN regexp_replace(m.p, '/+$', '') ELSE m.p END || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canonical_url FROM k)
SELECT page_id, title, canonical_url, sha256(lower(title) || '|' || lower(canonical_url)) AS content_hash, nullif(substring(clean, 1, 2000), '') AS summary, length(nullif(substring(clean, 1, 10000), ''))::INTEGER AS content_chars,
  'general' AS category, 'en' AS language, CASE WHEN title = '' THEN 'empty title' WHEN url = '' THEN 'no link or guid' WHEN length(title) > 512 THEN 'title too long' WHEN length(url) > 1024 THEN 'url too long' END AS reject_reason FROM c""",
    "parsed_times": "SELECT event_id, CASE event_id % 8 WHEN 1 THEN epoch(date_trunc('second', ts))::BIGINT - 3600 WHEN 3 THEN 1704412800 WHEN 5 THEN epoch(date_trunc('day', ts))::BIGINT WHEN 7 THEN epoch(date_trunc('minute', ts))::BIGINT ELSE epoch(date_trunc('second', ts))::BIGINT END AS epoch_s FROM events",
    "parsed_feeds": r"SELECT page_id AS source_id, url AS link, url AS guid, length(trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)))::INTEGER AS title_chars FROM pages",
    "enabled_sources": f"WITH {BASE} SELECT id, name, trust_level FROM src WHERE enabled ORDER BY id LIMIT 100",
    "seeded_sources": f"""WITH {BASE}, f AS (SELECT language || '/' || category AS feed_url, published_us > t - 86400000000 AS fresh FROM art, newest)
SELECT DISTINCT feed_url FROM f WHERE fresh AND feed_url NOT IN (SELECT feed_url FROM f WHERE NOT fresh) UNION SELECT DISTINCT 'new/' || language FROM art""",
    "patched_sources": f"WITH {BASE} SELECT id, CASE WHEN id % 2 = 0 THEN upper(name) ELSE name END AS name, CASE WHEN id % 3 = 0 THEN 'world' ELSE 'general' END AS category, trust_level FROM src",
    "cascade_deleted": f"""WITH {BASE}, a AS (SELECT art.* FROM art JOIN src ON src.id = source_id WHERE enabled)
SELECT 'sources' AS what, count(*) AS n FROM src WHERE enabled UNION ALL SELECT 'articles', count(*) FROM a UNION ALL SELECT 'links', count(*) FROM mem JOIN a USING (id)""",
    "run_audit": f"""WITH {BASE}, o AS (SELECT {_DAY} AS run_id, source_id, CASE WHEN length(content) = 0 THEN 'failed' WHEN id = cluster_id THEN 'ingested' ELSE 'skipped' END AS outcome FROM art JOIN mem USING (id))
SELECT run_id, source_id, count(*) FILTER (outcome <> 'failed') AS articles_found, count(*) FILTER (outcome = 'ingested') AS articles_ingested, count(*) FILTER (outcome = 'skipped') AS articles_skipped,
  CASE WHEN count(*) FILTER (outcome = 'failed') > 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM o GROUP BY run_id, source_id""",
    "run_history": f"WITH {BASE} SELECT {_DAY} AS run_id, source_id, count(*) FILTER (length(content) > 0) AS articles_found FROM art GROUP BY ALL ORDER BY run_id DESC, source_id LIMIT 30",
    "article_counts": f"WITH {BASE} SELECT source_id, category, count(*) AS n FROM art GROUP BY ALL",
    "article_page": f"WITH {BASE} SELECT id, source_id, published_us FROM art WHERE category = 'world' AND language = 'en' ORDER BY published_us DESC, id DESC LIMIT 40 OFFSET 20",
    "title_lookups": f"WITH {BASE} SELECT id FROM (SELECT id, count(*) OVER (PARTITION BY title) AS n FROM art) WHERE n >= 2",
    "evidence_conflicts": f"""WITH {BASE}, {_EV} SELECT x.cluster_id, x.id AS a, y.id AS b,
  x.publisher || ' reports [''' || array_to_string(x.nums, ''', ''') || '''] while ' || y.publisher || ' reports [''' || array_to_string(y.nums, ''', ''') || ''']' AS detail
  FROM ev x JOIN ev y ON x.cluster_id = y.cluster_id AND x.rank < y.rank WHERE len(x.nums) > 0 AND len(y.nums) > 0 AND NOT list_has_any(x.nums, y.nums)""",
    "evidence_provenance": f"""WITH {BASE}, {_EV} SELECT cluster_id, string_agg(id::VARCHAR, '|' ORDER BY rank) AS article_ids, array_to_string(list_transform(list_sort(list_distinct(list(source_id))), lambda x: x::VARCHAR), '|') AS source_ids,
  array_to_string(list_sort(list_distinct(list(publisher))), '|') AS publishers, count(*)::INTEGER AS n_urls FROM ev GROUP BY cluster_id""",
    "story_briefs": _BRIEFS + " SELECT * EXCLUDE (n_facts, facts, n_headlines) FROM brf",
    "story_packages": _BRIEFS
    + r""" SELECT cluster_id, n_headlines, n_facts,
  length(concat_ws(chr(10), headline, summary, body, caption))::INTEGER AS copy_chars, length(concat_ws(chr(10), headline, dek, body, summary, caption, nullif(facts, '')))::INTEGER AS text_chars FROM brf""",
    "package_flags": _found(_BRIEFS, "SELECT cluster_id, unnest([concat_ws(chr(10), headline, summary, body, caption), summary, body]) AS copy FROM brf")
    + " SELECT s.cluster_id, coalesce(array_to_string(list_sort(list(DISTINCT flag) FILTER (flag IS NOT NULL)), '|'), '') AS risk_flags FROM s LEFT JOIN a ON s.cluster_id = a.cluster_id GROUP BY s.cluster_id",
    "evidence_fingerprints": _FOUND
    + f""", fin AS (SELECT cluster_id, list({{'rank': rank, 'id': ev.id, 'title': ev.title, 'excerpt': excerpt, 'source_id': source_id, 'publisher': publisher, 'publisher_trust': src.trust_level, 'published_us': published_us,
  'canonical_url': 'https://example.org/a/' || ev.id, 'numbers': nums, 'dates': list_sort(list_distinct(regexp_extract_all(ev.title || ' ' || excerpt, {_DATE_SQL}))), 'lead': lead}} ORDER BY rank) AS articles FROM ev JOIN src ON src.id = source_id GROUP BY cluster_id)
SELECT cluster_id, sha256(to_json({{'cluster_id': cluster_id, 'title': t.title, 'articles': articles, 'entities': coalesce(ek, [])}})::VARCHAR) AS context_hash FROM fin JOIN art t ON t.id = cluster_id LEFT JOIN enn USING (cluster_id)""",
    "payload_audit": "SELECT conv_id, turn, CASE role WHEN 'user' THEN NULL WHEN 'assistant' THEN 'type of key_facts' ELSE 'not an object' END AS error FROM conversations",
    "guard_flags": _FOUND + " SELECT cluster_id, flag, count(*) AS n FROM a GROUP BY ALL",
    "guard_findings": _FOUND
    + """ SELECT s.cluster_id, count(flag) = 0 AS claims_supported, coalesce(array_to_string(list_transform(list_sort(list_distinct(list(k || flag))), lambda x: x[2:]), '|'), '') AS flags, count(flag)::INTEGER AS n_findings
FROM s LEFT JOIN a ON s.cluster_id = a.cluster_id GROUP BY s.cluster_id""",
    "guard_snippets": _FOUND
    + """ SELECT s.cluster_id, coalesce(array_to_string(list_sort(list(flag || '=' || v) FILTER (flag IN ('UNSUPPORTED_ENTITY', 'UNSUPPORTED_QUOTE', 'UNSUPPORTED_DATE'))), '|'), '') AS snippets FROM s LEFT JOIN a ON s.cluster_id = a.cluster_id GROUP BY s.cluster_id""",
    "draft_quality": _FOUND
    + rf""", w AS (SELECT a.cluster_id, count(*) AS nf, list(DISTINCT flag) AS fl, sum(CASE {" ".join(f"WHEN flag = '{f}' THEN {w}" for f, w in V.RISK_WEIGHTS.items())} ELSE 10 END) AS risk FROM a GROUP BY a.cluster_id),
e AS (SELECT s.cluster_id, s.n AS used, copy, title, article_count, corroboration, list_distinct(s.pub) AS pubs, coalesce(nf, 0) AS nf, coalesce(fl, []) AS fl, greatest(0, 100 - coalesce(risk, 0))::INTEGER AS risk_level,
  len(regexp_extract_all(copy, '[^ \t-\r]+')) AS nw, len(regexp_extract_all(title, '[^ \t-\r]+')) AS nt, title AS t,
  list_transform(list_filter(string_split(regexp_replace(copy, '([.!?])[ \t-\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '[^ \t-\r]')), lambda x: len(regexp_extract_all(x, '[^ \t-\r]+'))) AS len_
  FROM s JOIN d USING (cluster_id) JOIN sto USING (cluster_id) LEFT JOIN w ON w.cluster_id = s.cluster_id),
q AS (SELECT *, round_even(100.0::DOUBLE * least(1.0::DOUBLE, used / greatest(article_count, used, 1)::DOUBLE), 0)::INTEGER AS evidence_coverage,
  floor(100.0::DOUBLE * (len(list_filter(pubs, lambda p: contains(lower(copy), lower(p)))) / len(pubs)::DOUBLE))::INTEGER AS base,
  round_even((2 * (trim(title) <> '')::INTEGER + (trim(copy) <> '')::INTEGER) / 3.0::DOUBLE * 100.0::DOUBLE, 0)::INTEGER AS completeness,
  CASE WHEN len(len_) = 0 THEN 0 ELSE greatest(0, least(100, 100 - greatest(0, trunc((list_sum(len_) / len(len_)::DOUBLE - 22) * 3)) - 6 * len(list_filter(len_, lambda x: x > 34)))) END::INTEGER AS clarity,
  CASE WHEN trim(t) = '' THEN 0 ELSE greatest(0, 100 - CASE WHEN nt < 3 THEN 25 WHEN nt > 14 THEN 20 ELSE 0 END - CASE WHEN {_CLICK} THEN 30 ELSE 0 END - CASE WHEN {_SUPER} THEN 20 ELSE 0 END
    - CASE WHEN suffix(lower(t), '?') AND NOT regexp_matches(t, '[\p{{L}}\p{{N}}]') THEN 15 ELSE 0 END) END::INTEGER AS headline_quality,
  CASE WHEN nw <= 0 THEN 0 ELSE floor(greatest(0.0::DOUBLE, 100.0::DOUBLE - 25.0::DOUBLE * (nf / greatest(nw / 100.0::DOUBLE, 0.5::DOUBLE)))) END::INTEGER AS factual_support FROM e),
r AS (SELECT *, CASE WHEN ({_CREDIT}) AND base >= 50 THEN least(100, base + 15) ELSE base END::INTEGER AS attribution_score FROM q),
o AS (SELECT *, CASE WHEN list_contains(fl, 'CONFLICTING_SOURCES') THEN 8 ELSE 0 END AS penalty FROM r),
z AS (SELECT *, greatest(0, least(100, round_even(round(evidence_coverage * 0.25::DOUBLE + factual_support * 0.25::DOUBLE + attribution_score * 0.15::DOUBLE + completeness * 0.10::DOUBLE + clarity * 0.10::DOUBLE + headline_quality * 0.10::DOUBLE
  + risk_level * 0.05::DOUBLE - penalty, 6), 0)))::INTEGER AS overall FROM o)
SELECT cluster_id, evidence_coverage, attribution_score, completeness, clarity, headline_quality, risk_level, factual_support, overall,
  greatest(0, least(100, round_even(round(factual_support * 0.5::DOUBLE + corroboration * 0.5::DOUBLE, 6), 0)))::INTEGER AS confidence,
  CASE WHEN list_has_any(fl, [{", ".join(f"'{f}'" for f in V.SERIOUS_FLAGS)}]) OR overall < 55 THEN 'REGENERATE' WHEN len(fl) > 0 THEN 'NEEDS_REVIEW' ELSE 'GENERATED' END AS status, (7 + (penalty > 0)::INTEGER)::INTEGER AS n_notes FROM z""",
    "copy_quality": rf"""WITH d AS (SELECT doc_id, text, array_to_string(string_split(string_split(text, chr(10))[1], ' ')[1:12], ' ') AS t FROM documents),
s AS (SELECT *, list_transform(list_filter(string_split(regexp_replace(text, '([.!?])[ \t-\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '[^ \t-\r]')), lambda x: len(regexp_extract_all(x, '[^ \t-\r]+'))) AS n FROM d),
q AS (SELECT *, len(regexp_extract_all(t, '[^ \t-\r]+')) AS nt, len(regexp_extract_all(text, '[^ \t-\r]+')) AS nw FROM s)
SELECT doc_id, CASE WHEN len(n) = 0 THEN 0 ELSE greatest(0, least(100, 100 - greatest(0, trunc((list_sum(n) / len(n)::DOUBLE - 22) * 3)) - 6 * len(list_filter(n, lambda x: x > 34)))) END::INTEGER AS clarity,
  CASE WHEN trim(t) = '' THEN 0 ELSE greatest(0, 100 - CASE WHEN nt < 3 THEN 25 WHEN nt > 14 THEN 20 ELSE 0 END - CASE WHEN {_CLICK} THEN 30 ELSE 0 END - CASE WHEN {_SUPER} THEN 20 ELSE 0 END
    - CASE WHEN suffix(lower(t), '?') AND NOT regexp_matches(t, '[\p{{L}}\p{{N}}]') THEN 15 ELSE 0 END) END::INTEGER AS headline_quality, nw::INTEGER AS n_words,
  CASE WHEN nw <= 0 THEN 0 ELSE floor(greatest(0.0::DOUBLE, 100.0::DOUBLE - 25.0::DOUBLE * ((doc_id % 4) / greatest(nw / 100.0::DOUBLE, 0.5::DOUBLE)))) END::INTEGER AS factual_support FROM q""",
    "ledger_reuse": _GEN
    + """, l AS (SELECT story_cluster_id, generation_type, model, input_context_hash, arg_max(id, (created_at, id)) AS generation_id FROM gen WHERE success = 1 GROUP BY ALL),
h AS (SELECT l.*, dra.id AS draft_id FROM l JOIN dra USING (generation_id)), k AS (SELECT DISTINCT story_cluster_id, generation_type, model, input_context_hash FROM gen)
SELECT k.*, generation_id, draft_id FROM k LEFT JOIN h USING (story_cluster_id, generation_type, model, input_context_hash)""",
    "ledger_history": _GEN + " SELECT gen.id, success, dra.id::VARCHAR AS drafts FROM gen LEFT JOIN dra ON generation_id = gen.id",
    "ledger_audit": "SELECT conv_id, turn, (role <> 'system')::INTEGER AS success, CASE WHEN role <> 'system' THEN sha256(text) END AS output_hash, floor(length(text) / 4.0)::INTEGER AS output_tokens FROM conversations",
    "ledger_types": _GEN
    + """ SELECT generation_type, CASE generation_type WHEN 'HEADLINES' THEN 'NEWS_UPDATE' WHEN 'SUMMARY' THEN 'EXPLAINER' WHEN 'SOCIAL' THEN 'SOCIAL_POST' ELSE 'ARTICLE' END AS draft_type,
  CASE generation_type WHEN 'PACKAGE' THEN 'editorial-package' WHEN 'SOCIAL' THEN 'facebook' ELSE 'web' END AS platform, generation_type AS back, count(*) AS n FROM gen GROUP BY ALL""",
    "draft_provenance": f"WITH {BASE}, {_EV} SELECT cluster_id + 1000000 AS draft_id, id AS article_id, source_id, round_even(100.0::DOUBLE * (1.0::DOUBLE / rank), 0)::INTEGER AS relevance, CASE rank WHEN 1 THEN 'primary' ELSE 'evidence' END AS citation_role FROM ev",
    "regenerated_drafts": _GEN + " SELECT id, cluster_id, CASE WHEN id % 5 = 0 THEN 'REGENERATE' ELSE 'GENERATED' END AS status FROM dra UNION ALL SELECT id + 1000000, cluster_id, 'GENERATED' FROM dra WHERE id % 5 = 0",
    "cited_drafts": _GEN + f", {_EV}, c AS (SELECT cluster_id + 1000000 AS draft_id, count(*)::INTEGER AS n, string_agg(publisher, '|' ORDER BY id) AS p FROM ev GROUP BY cluster_id) SELECT dra.id, coalesce(n, 0) AS n_citations, p AS publishers FROM dra LEFT JOIN c ON draft_id = dra.id",
    "coverage_tumbling": f"WITH {BASE} SELECT (floor(published_us / 21600000000.0) * 21600)::BIGINT AS start_s, category, count(*) AS articles FROM art GROUP BY ALL",
    "coverage_sliding": f"WITH {BASE}, w AS (SELECT category, unnest([floor(published_us / 21600000000.0) * 21600, floor(published_us / 21600000000.0) * 21600 - 21600])::BIGINT AS start_s FROM art) SELECT start_s, category, count(*) AS articles FROM w GROUP BY ALL",
    "story_sessions": f"""WITH {BASE}, o AS (SELECT cluster_id, published_us AS p, lag(published_us) OVER (PARTITION BY cluster_id ORDER BY published_us) AS q FROM mem JOIN art USING (id)),
s AS (SELECT *, sum(CASE WHEN q IS NULL OR p - q >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY cluster_id ORDER BY p) AS k FROM o)
SELECT cluster_id, min(p) AS start_us, count(*) AS articles FROM s GROUP BY cluster_id, k""",
}
