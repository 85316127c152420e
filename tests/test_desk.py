import re

from pyspark.sql import Row
from pyspark.sql import functions as F

from storyloom.operators import brief, guard, ledger, quality

ARTICLE = "rank int, id long, title string, excerpt string, source_id long, publisher string, publisher_trust string, published_us long, canonical_url string, numbers array<string>, dates array<string>, lead string"


def bundle(spark, articles, entities=("city council",), title="Council approves transit plan"):
    members = spark.createDataFrame([(1, a[0]) for a in articles], "cluster_id long, id long")
    rows = spark.createDataFrame([(a[0], a[1], a[2], a[3], a[4]) for a in articles], "id long, source_id long, title string, content string, published_us long")
    sources = spark.createDataFrame([(1, "Metro Daily", "high"), (2, "City Post", "low")], "id long, name string, trust_level string")
    stories = spark.createDataFrame([(1, title, "world", "RISING", 50.0, len(articles), 40.0)], "cluster_id long, title string, category string, state string, trending double, article_count int, corroboration double")
    mentions = spark.createDataFrame([(1, e, 1) for e in entities], "cluster_id long, norm string, mention_count long")
    return brief.bundles(stories, brief.evidence_articles(members, rows, sources), mentions)


TWO = [(1, 1, "Council approves transit plan", "The City Council approved 45 million for transit. It starts on March 3, 2024.", 10), (2, 2, "Transit vote passes", "Members voted 45 to 3. Work begins March 3, 2024.", 20)]


def flags(spark, text, articles=TWO):
    b = bundle(spark, articles)
    row = guard.check(spark.createDataFrame([(1, text)], "cluster_id long, copy string"), b).first()
    return [(f.flag, f.snippet) for f in row.findings]


def test_guard_accepts_supported_copy(spark):
    assert flags(spark, "the City Council approved 45 million on March 3, 2024, according to Metro Daily.") == []


def test_guard_finds_each_kind(spark):
    text = "Mayor John Roe pledged 99 million on May 5, 2025, according to notes: \"this was never said by anyone\" at https://x.example/1"
    found = dict(flags(spark, text))
    assert found["UNSUPPORTED_ENTITY"] and found["UNSUPPORTED_DATE"] == "May 5, 2025" and found["UNSUPPORTED_URL"] == "https://x.example/1"
    assert found["UNSUPPORTED_QUOTE"] == "this was never said by anyone" and "UNSUPPORTED_NUMBER" in found
    assert "MISSING_ATTRIBUTION" not in found
    lone = dict(flags(spark, "the plan passed", TWO[:1]))
    assert "LOW_EVIDENCE" in lone and "MISSING_ATTRIBUTION" in lone


def test_conflicts(spark):
    rows = [(1, 1, "A", "Toll is 10", 10), (2, 2, "B", "Toll is 20", 20)]
    b = bundle(spark, rows).first()
    assert [(c.a, c.b) for c in b.conflicts] == [(2, 1)] and "reports ['20']" in b.conflicts[0].detail
    assert b.article_ids == [2, 1] and b.publishers == ["City Post", "Metro Daily"] and len(b.context_hash) == 64


def test_briefs(spark):
    p = brief.package(brief.briefs(bundle(spark, TWO))).first()
    assert p.headline == "Council approves transit plan" and p.summary == "Members voted 45 to 3 The City Council approved 45 million for transit"
    assert p.hashtags == ["#council", "#approves", "#transit"] and p.uncertainties == [] and p.caption.endswith("(via City Post, Metro Daily)")
    assert p.key_facts == ["Members voted 45 to 3", "The City Council approved 45 million for transit"]


def test_payloads(spark):
    rows = [("summary_result", '{"summary":"a","key_facts":[],"risk_flags":[]}'), ("summary_result", '{"summary":"a","key_facts":"x","risk_flags":[]}'), ("summary_result", '{"summary":"a"}'), ("other", "{}"), ("summary_result", "[1]"), ("summary_result", "nope")]
    got = [r.error for r in brief.payload_errors(spark.createDataFrame(rows, "schema_name string, payload_json string")).collect()]
    assert got == [None, "type of key_facts", "missing key_facts", "unknown schema", "not an object", "not an object"]


def test_quality(spark):
    b = bundle(spark, TWO)
    text = "the City Council approved 45 million, according to Metro Daily and City Post. work starts on March 3, 2024."
    checked = guard.check(b.crossJoin(spark.createDataFrame([Row(copy=text, headline="Council approves transit plan")])), b)
    q = quality.assess(checked, "ARTICLE", sections={"headline": "headline", "dek": "headline", "body": "copy"}).first()
    assert (q.evidence_coverage, q.factual_support, q.attribution_score, q.completeness, q.clarity, q.headline_quality, q.risk_level) == (100, 100, 100, 100, 100, 100, 100)
    assert (q.overall, q.confidence, q.status) == (100, 70, "GENERATED")
    rows = spark.createDataFrame([("You won't believe this historic secret plan",), ("Hi",), ("",), ("Why?",), (" ".join(["w"] * 15),)], "h string")
    assert [r[0] for r in rows.select(quality.headline_quality(rows.h)).collect()] == [50, 75, 0, 75, 80]
    s = spark.createDataFrame([(["UNSUPPORTED_ENTITY"], 90), (["UNSUPPORTED_URL"], 90), ([], 90), ([], 40)], "f array<string>, o int")
    assert [r[0] for r in s.select(quality.review_status(s.f, s.o)).collect()] == ["REGENERATE", "NEEDS_REVIEW", "GENERATED", "REGENERATE"]


def test_ledger_reuse_is_idempotent(spark):
    key = (1, "ARTICLE", "p", "m", "v1", "h")
    schema = "story_cluster_id long, generation_type string, provider string, model string, prompt_version string, input_context_hash string"
    asked = spark.createDataFrame([key, (2, *key[1:])], schema)
    none = spark.createDataFrame([], schema + ", id long, success int, created_at long")
    no_drafts = spark.createDataFrame([], "id long, generation_id long, created_at long")
    reused, to_do = ledger.split_reuse(asked, none, no_drafts)
    assert (reused.count(), to_do.count()) == (0, 2)
    gens = spark.createDataFrame([(*key, 10, 1, 5), (*key, 11, 0, 9), (2, *key[1:], 12, 1, 1)], schema + ", id long, success int, created_at long")
    drafts = spark.createDataFrame([(100, 10, 1), (101, 10, 2), (102, 12, 1)], "id long, generation_id long, created_at long")
    reused, to_do = ledger.split_reuse(asked, gens, drafts)
    assert to_do.count() == 0 and {(r.story_cluster_id, r.draft_id) for r in reused.collect()} == {(1, 101), (2, 102)}


def test_guard_knows_entities_by_name_and_key(spark):
    """A candidate is supported by the corpus, or if it overlaps a known name; the first spelling of a form is the one that is shown."""
    told = "Roe Council spoke. Mayor Ann Poe left. mayor. ann poe and MAYOR: Mayor Ann Poe went."
    b = bundle(spark, TWO)
    known = b.withColumn("entities", F.array(F.lit("ann_poe"))).withColumn("entity_names", F.array(F.lit("Ann Poe")))
    drafts = spark.createDataFrame([(1, told)], "cluster_id long, copy string")
    said = lambda x: [f.snippet for f in guard.check(drafts, x).first().findings if f.flag == "UNSUPPORTED_ENTITY"]
    assert "Mayor Ann Poe" in said(b) and "Mayor Ann Poe" not in said(known) and said(known).count("Roe Council") == 1
    nulls = guard.check(spark.createDataFrame([(1, None), (2, "no bundle")], "cluster_id long, copy string"), b).collect()
    assert len(nulls) == 1 and "MISSING_ATTRIBUTION" in nulls[0].flags


def test_risk_flags_of_a_package(spark):
    packages = spark.createDataFrame([(1,), (2,), (3,)], "cluster_id long")
    checked = spark.createDataFrame([(1, ["UNSUPPORTED_URL", "LOW_EVIDENCE"], [1]), (2, [], [])], "cluster_id long, flags array<string>, conflicts array<int>")
    sections = spark.createDataFrame([(1, "MISSING_ATTRIBUTION"), (1, "LOW_EVIDENCE"), (3, "UNSUPPORTED_DATE")], "cluster_id long, flag string")
    got = {r.cluster_id: r.risk_flags for r in brief.risk_flags(packages, checked, sections).collect()}
    assert got == {1: ["LOW_EVIDENCE", "MISSING_ATTRIBUTION", "UNSUPPORTED_URL", "CONFLICTING_SOURCES"], 2: [], 3: ["UNSUPPORTED_DATE"]}
    assert [r.risk_flags for r in brief.risk_flags(packages, checked).orderBy("cluster_id").collect()] == [["LOW_EVIDENCE", "UNSUPPORTED_URL", "CONFLICTING_SOURCES"], [], []]


def test_quality_notes(spark):
    b = bundle(spark, [(1, 1, "A", "Toll is 10", 10), (2, 2, "B", "Toll is 20", 20)])
    draft = spark.createDataFrame([Row(copy="Toll is 10, Metro Daily reports. It rose.", headline="Shocking: you won't believe this historic secret")])
    q = quality.assess(guard.check(b.crossJoin(draft), b), "ARTICLE", sections={"headline": "headline", "body": "copy"}).first()
    assert q.quality_notes == [
        "evidence_coverage: 2 of 2 cluster articles used.",
        f"factual_support: {len(q.findings)} guard finding(s) across 8 words.",
        "attribution: 1/2 publishers credited in copy, attribution language present",
        "completeness: Sections present: ['headline', 'body'].",
        "clarity: Average sentence length 4.0 words; 0 overly long.",
        "headline_quality: clickbait terms [\"you won't believe\", 'shocking', 'secret']; unsupported superlatives ['historic']",
        f"risk_level: {len(q.findings)} active risk finding(s).",
        f"Hard penalty -8 applied for unresolved flags {sorted(q.flags)}.",
    ]
    blank = quality.assess(guard.check(b.crossJoin(spark.createDataFrame([("", "")], "copy string, headline string")), b), "PACKAGE").first()
    assert blank.quality_notes[1:6] == ["factual_support: No generated text to evaluate.", "attribution: 0/2 publishers credited in copy", "completeness: No structural requirements.", "clarity: No sentences to evaluate.", "headline_quality: No headline."]


def test_texts_of_drafts_are_lowered_once_and_candidates_said_once(spark):
    df = spark.createDataFrame([("Ann Lee of Oslo\nBob Ray met Jo.\nAnn Lee of Oslo. the\tAnn\nAnn Lee of Oslo",)], "text string")
    low = df.select(guard.lacks_attribution(F.col("text"), F.array(F.lit("oslo"))).alias("x"))
    assert low._jdf.queryExecution().analyzed().toString().lower().count("lower(") == 1 and low.first().x is False
    # what each line has by itself, and each candidate once
    by_line = [m for line in df.first().text.split("\n") for m in re.findall(rf"\b({guard._WORD}(?:\s+(?:of|the|and|for|de|van|von)?\s*{guard._WORD}){{0,3}})\b", line)]
    said = [c.said for c in df.select(guard.candidates(F.col("text")).alias("c")).first().c]
    assert said == list(dict.fromkeys(by_line)) and len(said) < len(by_line)
