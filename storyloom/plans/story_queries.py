"""Registered queries over the story model, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from ..operators import brief, cluster, dedup, entities, history, partials, postings, score, views
from ..operators.graph import Scratch, discard, new_path, stored
from . import model

#: Names beyond the known ones that the invented prose uses, so that the gazetteer has work to do.
EXTRA_NAMES = (("of", "organization", 0.95), ("with", "organization", 0.95), ("la", "location", 0.90), ("der", "location", 0.90))

BASE = """
src AS (SELECT DISTINCT substring(source, 4)::BIGINT AS id, source AS name,
          CASE substring(source, 4)::BIGINT % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'verified' END AS trust_level,
          substring(source, 4)::BIGINT % 5 <> 0 AS enabled FROM documents),
art AS MATERIALIZED (SELECT doc_id AS id, substring(source, 4)::BIGINT AS source_id,
          array_to_string(string_split(string_split(text, chr(10))[1], ' ')[1:12], ' ') AS title, text AS content, lang AS language,
          CASE event_type WHEN 'view' THEN 'world' WHEN 'signup' THEN 'technology' WHEN 'error' THEN 'politics' WHEN 'click' THEN 'business' ELSE 'general' END AS category,
          epoch_us(ts) AS published_us FROM documents JOIN events ON event_id = doc_id),
mem AS (SELECT min(id) OVER (PARTITION BY title) AS cluster_id, id FROM art),
newest AS (SELECT max(published_us) AS t FROM art)"""

_KNOWN = [(t, "organization", 0.95) for t in V.ORGANIZATIONS] + [(t, "brand", 0.95) for t in V.BRANDS] + [(t, "country", 0.90) for t in V.COUNTRIES] + [(t, "location", 0.90) for t in V.CITIES]


def _names_sql() -> str:
    rows = []
    for term, kind, conf in (*_KNOWN, *EXTRA_NAMES):
        name = term.title() if kind == "brand" or len(term) > 3 else term.upper()
        rows.append(f"('{term}', '{name}', '{kind}', {conf:.2f}::DOUBLE, '{term.replace(' ', '_')}')")
    return "nam AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") v(term, name, entity_type, confidence, norm))"


_WORD = r"[\p{L}\p{N}_]"
_STOPS = ", ".join(f"'{w}'" for w in V.ENTITY_STOP_WORDS)
ENTITIES = (
    _names_sql()
    + rf""",
pad AS (SELECT id, lower(title) AS low, ' ' || array_to_string(regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}_]+'), ' ') || ' ' AS padded FROM art),
kno AS (SELECT id, term FROM pad, nam WHERE contains(low, term) AND contains(padded, ' ' || term || ' ')),
wrd AS (SELECT id, unnest(ws) AS w0, generate_subscripts(ws, 1) AS pos FROM (SELECT id, regexp_split_to_array(trim(regexp_replace(title, '\s+', ' ', 'g')), ' ') AS ws FROM art)),
cap AS (SELECT id, pos, w, regexp_matches(w, '^\p{{Lu}}') AND lower(w) NOT IN ({_STOPS}) AS c FROM (SELECT id, pos, trim(w0, '",.:;!?()[]{{}}') AS w FROM wrd)),
isl AS (SELECT id, pos, w, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS g FROM cap WHERE c),
fst AS (SELECT *, min(CASE WHEN length(w) > 2 THEN pos END) OVER (PARTITION BY id, g) AS f FROM isl),
run AS (SELECT id, f AS pos, string_agg(w, ' ' ORDER BY pos) AS name, count(*) AS n FROM fst WHERE pos >= f GROUP BY id, g, f),
cand AS (SELECT id, 0 AS r, 0 AS pos, norm, name, entity_type, confidence FROM kno JOIN nam USING (term)
  UNION ALL SELECT id, 1, pos, regexp_replace(lower(trim(regexp_replace(name, '[^a-zA-Z0-9\s]', '', 'g'))), '\s+', '_', 'g'), name, CASE WHEN n >= 2 THEN 'person' ELSE 'organization' END, 0.75 FROM run),
lnk AS MATERIALIZED (SELECT id, norm, name, entity_type, confidence FROM (SELECT *, row_number() OVER (PARTITION BY id, norm ORDER BY r, pos) AS k FROM cand WHERE norm <> '') WHERE k = 1),
men AS MATERIALIZED (SELECT cluster_id, norm, count(*) AS mention_count FROM lnk JOIN mem USING (id) GROUP BY ALL)"""
)

SCORES = """
cov AS (SELECT cluster_id, count(*) AS article_count, count(*) FILTER (published_us >= t - 21600000000) AS recent,
    count(*) FILTER (published_us >= t - 43200000000 AND published_us < t - 21600000000) AS previous, min(published_us) AS first_us, max(published_us) AS last_us
    FROM mem JOIN art USING (id), newest GROUP BY cluster_id),
cor AS (SELECT cluster_id, count(*) AS source_count, sum(CASE trust_level WHEN 'low' THEN 0.5 WHEN 'medium' THEN 1.0 WHEN 'high' THEN 1.5 ELSE 2.0 END)::DOUBLE AS w
    FROM (SELECT DISTINCT cluster_id, source_id FROM mem JOIN art USING (id)) JOIN src ON src.id = source_id GROUP BY cluster_id),
ent AS (SELECT cluster_id, count(*) AS n_entities FROM men GROUP BY cluster_id),
sig AS (SELECT cluster_id, a.title, a.category, article_count, first_us, last_us, source_count, coalesce(n_entities, 0) AS n_entities,
    floor(greatest(10.0, least(100.0, w / 5.0 * 100.0)) * 100 + 0.5) / 100 AS corroboration,
    'Reported by ' || source_count || CASE WHEN source_count = 1 THEN ' independent source' ELSE ' independent sources' END AS corroboration_label,
    CASE WHEN article_count = 1 THEN 10.0 ELSE floor(least(100.0, recent * 15.0::DOUBLE + (article_count / greatest(1.0::DOUBLE, (last_us - first_us) / 3600000000.0::DOUBLE)) * 10.0::DOUBLE * least(2.0::DOUBLE, (recent + 1) / (previous + 1)::DOUBLE)) * 100 + 0.5) / 100 END::DOUBLE AS velocity,
    floor(100.0::DOUBLE * pow(0.5::DOUBLE, greatest(0.0::DOUBLE, (t - last_us) / 3600000000.0::DOUBLE) / 12.0::DOUBLE) * 100 + 0.5) / 100 AS freshness,
    floor(least(100.0, (CASE a.category WHEN 'world' THEN 85 WHEN 'politics' THEN 85 WHEN 'business' THEN 80 WHEN 'technology' THEN 80 ELSE 50 END)::DOUBLE + least(15.0::DOUBLE, coalesce(n_entities, 0) * 3.0::DOUBLE)) * 100 + 0.5) / 100 AS relevance
    FROM cov JOIN cor USING (cluster_id) JOIN art a ON a.id = cluster_id LEFT JOIN ent USING (cluster_id), newest),
tre AS (SELECT *, floor(greatest(0.0::DOUBLE, least(100.0::DOUBLE, velocity * 0.30::DOUBLE + freshness * 0.25::DOUBLE + corroboration * 0.25::DOUBLE + relevance * 0.20::DOUBLE)) * 100 + 0.5) / 100 AS trending FROM sig),
sto AS MATERIALIZED (SELECT *, CASE WHEN freshness <= 10 THEN 'STALE' WHEN trending >= 80 AND velocity >= 60 AND source_count >= 2 THEN 'PEAK' WHEN trending >= 65 AND article_count >= 2 THEN 'TRENDING'
    WHEN freshness <= 35 AND velocity <= 20 THEN 'COOLING' WHEN trending >= 45 OR velocity >= 30 THEN 'RISING' ELSE 'EMERGING' END AS state FROM tre)"""

STORY = f"WITH {BASE}, {ENTITIES}, {SCORES} "
STORY_COLUMNS = ["cluster_id", "title", "category", "article_count", "source_count", "n_entities", "first_us", "last_us", "velocity", "freshness", "corroboration", "corroboration_label", "relevance", "trending", "state"]


def _links(spark, art):
    return entities.article_entities(art.withColumn("summary", F.lit(None).cast("string")), entities.gazetteer(spark, EXTRA_NAMES))


def scored(spark, sf_dir, links=None):
    art = model.articles(spark, sf_dir)
    members = model.memberships(art)
    clusters = art.select(F.col("id").alias("cluster_id"), "title", "category").join(members.select("cluster_id").distinct(), "cluster_id", "left_semi")
    mentions = entities.cluster_mentions(_links(spark, art) if links is None else links, members).select("cluster_id", F.col("norm").alias("entity"))
    return score.score_clusters(clusters, members, art, model.sources(spark, sf_dir), mentions, model.as_of(art)).select(*STORY_COLUMNS)


def story_scores(spark, sf_dir):
    return scored(spark, sf_dir)


def rescored_stories(spark, sf_dir):
    """The stories that the articles of the newest day touch, scored again over all their members."""
    art = model.articles(spark, sf_dir)
    members, t = model.memberships(art), model.as_of(art)
    touched = members.join(art.where(F.col("published_us") > t - 86_400_000_000).select("id"), "id", "left_semi")
    clusters = art.select(F.col("id").alias("cluster_id"), "title", "category")
    mentions = entities.cluster_mentions(_links(spark, art), members).select("cluster_id", F.col("norm").alias("entity"))
    return score.rescore_clusters(touched, clusters, members, art, model.sources(spark, sf_dir), mentions, t).select(*STORY_COLUMNS)


def incremental_scores(spark, sf_dir):
    """The same from partial aggregates: the articles before the newest day are one batch of the store, those of the newest day another."""
    art = model.articles(spark, sf_dir)
    members, t = stored(model.memberships(art), "memberships"), model.as_of(art)
    new, store = F.col("published_us") > t - 86_400_000_000, new_path(spark, "partials")
    for name, rows in (("old", art.where(~new)), ("new", art.where(new))):
        partials.add_batch(members, rows, store, name)
    touched = members.join(art.where(new).select("id"), "id", "left_semi")
    clusters = art.select(F.col("id").alias("cluster_id"), "title", "category")
    mentions = entities.cluster_mentions(_links(spark, art), members).select("cluster_id", F.col("norm").alias("entity"))
    out = stored(partials.rescore(spark, store, touched, clusters, model.sources(spark, sf_dir), mentions, t).select(*STORY_COLUMNS), "rescored")
    for path in (store, f"{store}-rows"):
        discard(spark, path)
    return out


def story_changes(spark, sf_dir):
    """Every story's openings, and closings after 48 hours without an article."""
    art = model.articles(spark, sf_dir)
    return partials.story_changes(partials.hourly(model.memberships(art), art), 48 * score.HOUR, model.as_of(art))


def trending_top20(spark, sf_dir):
    return views.list_trending(scored(spark, sf_dir), 20).select("cluster_id", "title", "trending", "state")


def trending_per_category(spark, sf_dir):
    return views.top_per_category(scored(spark, sf_dir), 5).select("category", "rank", "cluster_id", "trending")


def stories_recent(spark, sf_dir):
    return views.list_stories(scored(spark, sf_dir), category="world", limit=50).select("cluster_id", "last_us", "category")


def story_dashboard(spark, sf_dir):
    return views.dashboard(scored(spark, sf_dir))


def story_page(spark, sf_dir):
    return views.page(scored(spark, sf_dir).select("cluster_id", "trending"), [F.desc("trending"), "cluster_id"], 2, 25)


def story_search(spark, sf_dir):
    stories = scored(spark, sf_dir).withColumn("summary", F.lit(None).cast("string"))
    return views.search(stories, "The", "WORLD").select("cluster_id", "title")


#: Queries of the index: short, long, of any case, with signs, and one that nothing holds.
SEARCHES = ("q", "RE", "the", "ung der", "Con", "e, ", "tion", "no such words here")


def indexed_search(spark, sf_dir):
    """Searches of titles and whole texts through stored postings."""
    art, store = model.articles(spark, sf_dir).select("id", "title", F.col("content").alias("summary")), new_path(spark, "postings")
    for name in (0, 1):
        postings.add_batch(art.where(F.col("id") % 2 == name), store, str(name))
    out = postings.search(spark, store, art, spark.createDataFrame([(q,) for q in SEARCHES], "query string"))
    for path in (store, f"{store}-counts"):
        discard(spark, path)
    return out


def story_seek(spark, sf_dir):
    """The third page of stories by score, reached by the last keys of the pages before it."""
    order, path, after = [("trending", True), ("cluster_id", False)], new_path(spark, "pages"), None
    views.write_sorted(scored(spark, sf_dir).select("cluster_id", "trending", "title"), order, path)
    pages = spark.read.parquet(path)
    for _ in range(2):
        last = views.seek_page(pages, order, 25, after).tail(1)  # one row names where the next page begins
        after = (last[0]["trending"], last[0]["cluster_id"])
    return views.seek_page(pages, order, 25, after).crossJoin(F.broadcast(spark.read.parquet(f"{path}-total")))


def story_labels(spark, sf_dir):
    explained = score.explanation(scored(spark, sf_dir))
    kept = explained.withColumn("scoring_metadata", F.when(F.col("article_count") > 1, F.col("scoring_metadata")))
    return views.corroboration_label(kept).select("cluster_id", "label")


def story_explanations(spark, sf_dir):
    e = score.explanation(scored(spark, sf_dir))
    return e.select("cluster_id", F.col("explanation.components.velocity").alias("velocity"), F.col("explanation.weights.velocity").alias("weight"), F.get_json_object("scoring_metadata", "$.state").alias("state"))


def story_detail(spark, sf_dir):
    art = model.articles(spark, sf_dir)
    return views.story_detail(model.memberships(art), art, model.sources(spark, sf_dir))


def state_transitions(spark, sf_dir):
    """Snapshots every 12 hours before the newest article, and the state changes between them."""
    scratch = Scratch(spark, "states")
    art = scratch.put(model.articles(spark, sf_dir).select("id", "source_id", "title", "category", "published_us"), "articles")
    members, src, t = scratch.put(model.memberships(art), "members"), model.sources(spark, sf_dir), model.as_of(art)
    clusters = art.select(F.col("id").alias("cluster_id"), "title", "category").join(members.select("cluster_id").distinct(), "cluster_id", "left_semi")
    snaps = None
    for back in (24, 12, 0):
        at = t - back * score.HOUR
        s = score.score_clusters(clusters, members, art, src, None, at).select("cluster_id", F.lit(at).cast("long").alias("as_of_us"), "state")
        s = scratch.put(s, "snapshot")  # each by itself, so that a task holds the joins of one snapshot
        snaps = s if snaps is None else snaps.unionByName(s)
    out = stored(score.transitions(snaps), "transitions")
    scratch.close()
    return out


def entity_links(spark, sf_dir):
    return _links(spark, model.articles(spark, sf_dir))


def entity_dimension(spark, sf_dir):
    art = model.articles(spark, sf_dir)
    return entities.entity_dimension(_links(spark, art), art)


def entity_mentions(spark, sf_dir):
    art = model.articles(spark, sf_dir)
    return entities.rank_mentions(entities.cluster_mentions(_links(spark, art), model.memberships(art)))


def entity_listing(spark, sf_dir):
    return entity_dimension(spark, sf_dir).where("entity_type = 'person'").select("name", "norm").orderBy("name", "norm")


def title_tokens(spark, sf_dir):
    art = model.articles(spark, sf_dir)
    return art.select("id", F.array_join(F.array_sort(X.title_tokens(F.col("title"))), " ").alias("tokens"), F.array_join(F.array_sort(X.informative_tokens(F.col("title"))), " ").alias("informative"))


def exact_duplicates(spark, sf_dir):
    art = model.articles(spark, sf_dir).withColumn("content_hash", X.content_hash(F.col("title"), F.col("language")))
    return dedup.equal_key_leaders(art, "content_hash")


def near_title_pairs(spark, sf_dir):
    pairs, _ = dedup.near_title_sets(model.articles(spark, sf_dir))
    return pairs


def near_title_members(spark, sf_dir):
    _, members = dedup.near_title_sets(model.articles(spark, sf_dir))
    return members


def similar_title_pairs(spark, sf_dir):
    pairs, _ = cluster.similar_sets(model.articles(spark, sf_dir))
    return pairs


def new_against_history(spark, sf_dir):
    """The newest day's articles, in the order of their ids, after those that the pass over all older ones has stored."""
    scratch = Scratch(spark, "newest")
    url = F.concat("language", F.lit(":"), F.col("content_chars").cast("string"))
    art = scratch.put(model.articles(spark, sf_dir).select("id", "title", X.content_hash(F.col("title"), F.col("language")).alias("content_hash"), url.alias("canonical_url"), "published_us"), "articles")
    cut = model.as_of(art) - 24 * score.HOUR
    old = art.where(F.col("published_us") <= cut)
    kept = old.join(dedup.leader_pass(old).where("not is_duplicate").select("id"), "id", "left_semi")
    index = scratch.put(history.index_rows(kept), "title-index")
    newest = art.where(F.col("published_us") > cut).withColumn("id", F.col("id") + (1 << 40))
    out = history.resolve(newest, index)
    scratch.close()
    return out.select((F.col("id") - (1 << 40)).alias("id"), "is_duplicate", F.when(F.col("duplicate_of_id") >= 1 << 40, F.col("duplicate_of_id") - (1 << 40)).otherwise(F.col("duplicate_of_id")).alias("duplicate_of_id"), "reason")


def leader_pass(spark, sf_dir):
    art = model.articles(spark, sf_dir)
    keyed = art.select("id", "title", X.content_hash(F.col("title"), F.col("language")).alias("content_hash"), F.concat(F.lit("https://example.org/"), F.col("id").cast("string")).alias("canonical_url"))
    return dedup.leader_pass(keyed)


def best_clusters(spark, sf_dir):
    """The newest day's articles against title clusters of the days before."""
    scratch = Scratch(spark, "newest")
    art = scratch.put(model.articles(spark, sf_dir).select("id", "title", "category", "published_us"), "articles")
    cut = model.as_of(art) - 24 * score.HOUR
    old = art.where(F.col("published_us") <= cut)
    clusters = cluster.cluster_table(old, model.memberships(old).select("id", "cluster_id"))
    out = cluster.best_clusters(art.where(F.col("published_us") > cut), clusters)
    scratch.close()
    return out


def cluster_table(spark, sf_dir):
    art = model.articles(spark, sf_dir)
    return cluster.cluster_table(art, model.memberships(art).select("id", "cluster_id"))


def greedy_clusters(spark, sf_dir):
    return cluster.greedy_clusters(model.articles(spark, sf_dir))


def clustering_summary(spark, sf_dir):
    art = model.articles(spark, sf_dir)
    links = cluster.greedy_clusters(art)
    return cluster.run_summary(links, _links(spark, art), links.select("cluster_id").distinct().count())


def evidence_articles(spark, sf_dir):
    art = model.articles(spark, sf_dir)
    ev = brief.evidence_articles(model.memberships(art), art, model.sources(spark, sf_dir))
    joined = lambda c: F.array_join(c, "|").alias(c)
    return ev.select("cluster_id", "rank", "id", F.length("excerpt").alias("excerpt_chars"), "publisher", joined("numbers"), joined("dates"), "lead")


QUERIES = {f.__name__: f for f in (
    story_scores, trending_top20, trending_per_category, stories_recent, story_dashboard, story_page, story_search, story_labels, story_explanations, story_detail, state_transitions,
    indexed_search, story_seek, rescored_stories, incremental_scores, story_changes, entity_links, entity_dimension, entity_mentions, entity_listing, title_tokens, exact_duplicates, near_title_pairs, near_title_members, similar_title_pairs, new_against_history, leader_pass,
    best_clusters, cluster_table, greedy_clusters, clustering_summary, evidence_articles,
)}

_TOK = rf"list_sort(list_distinct(regexp_extract_all(lower(title), '{_WORD}{{3,}}')))"
_CSTOPS = ", ".join(f"'{w}'" for w in V.CLUSTER_STOP_WORDS)
_INF = f"list_sort(list_filter(list_distinct(regexp_extract_all(lower(title), '{_WORD}{{3,}}')), lambda x: regexp_full_match(x, '[a-z0-9]+') AND x NOT IN ({_CSTOPS})))"


def _pairs_sql(tokens: str, percent: int, guard: str = "") -> str:
    return f"""WITH {BASE}, s AS (SELECT min(id) AS id, tok FROM (SELECT id, {tokens} AS tok FROM art) WHERE len(tok) > 0 GROUP BY tok),
t AS (SELECT id, len(tok) AS n, unnest(tok) AS w FROM s),
p AS (SELECT x.id AS a, y.id AS b, count(*) AS n_both, x.n + y.n - count(*) AS n_either FROM t x JOIN t y ON x.w = y.w AND x.id < y.id GROUP BY x.id, y.id, x.n, y.n)
SELECT a, b, n_both, n_either::BIGINT AS n_either FROM p WHERE n_both * 100 >= n_either * {percent} {guard}"""


def _near_sql(tokens: str, percent: int, guard: str = "") -> str:
    """tok, sha: tokens and hash of every article; sim: pairs of different articles (x, y) with similar token sets, equal ones included."""
    return rf"""tok AS MATERIALIZED (SELECT id, {tokens} AS tok FROM art), wds AS (SELECT id, len(tok) AS n, unnest(tok) AS w FROM tok),
sim AS MATERIALIZED (SELECT x.id AS x, y.id AS y, count(*) AS n_both, x.n + y.n - count(*) AS n_either FROM wds x JOIN wds y ON x.w = y.w AND x.id <> y.id GROUP BY x.id, y.id, x.n, y.n
  HAVING count(*) * 100 >= (x.n + y.n - count(*)) * {percent} {guard})"""


#: The ordered passes, one article at each step of a recursion that carries what was accepted (acc) or the open stories (st).
_LEADER = f"""WITH RECURSIVE {BASE}, {_near_sql(_TOK, 85)}, sha AS (SELECT id, sha256(lower(trim(title)) || '|' || lower(trim(language))) AS h FROM art),
bef AS MATERIALIZED (SELECT x AS id, y AS o, 'title' AS why FROM sim WHERE y < x UNION ALL SELECT a.id, b.id, 'hash' FROM sha a JOIN sha b ON a.h = b.h AND b.id < a.id),
row_ AS MATERIALIZED (SELECT row_number() OVER (ORDER BY id) AS i, id, coalesce(nb, []) AS nb FROM art LEFT JOIN (SELECT id, list(DISTINCT o) AS nb FROM bef GROUP BY id) USING (id)),
r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS acc UNION ALL SELECT row_.i, CASE WHEN list_has_any(nb, acc) THEN acc ELSE list_append(acc, id) END FROM r JOIN row_ ON row_.i = r.i + 1),
ok AS MATERIALIZED (SELECT unnest(acc) AS id FROM (SELECT acc FROM r ORDER BY i DESC LIMIT 1)),
hit AS (SELECT bef.id, max(o) FILTER (why = 'hash') AS h, max(o) FILTER (why = 'title') AS t FROM bef JOIN ok ON ok.id = o WHERE bef.id NOT IN (SELECT id FROM ok) GROUP BY bef.id)
SELECT art.id, hit.id IS NOT NULL AS is_duplicate, coalesce(h, t) AS duplicate_of_id, CASE WHEN h IS NOT NULL THEN 'hash' WHEN t IS NOT NULL THEN 'title' END AS reason FROM art LEFT JOIN hit USING (id)"""
#: The same pass over the older articles first and then over the newest day's, whose ids are set behind all others; with addresses.
_HISTORY = f"""WITH RECURSIVE {BASE.replace("art AS MATERIALIZED", "given AS MATERIALIZED").replace("FROM art)", "FROM given)")},
art AS MATERIALIZED (SELECT given.* REPLACE (id + CASE WHEN published_us > t - 86400000000 THEN 1099511627776 ELSE 0 END AS id) FROM given, newest), {_near_sql(_TOK, 85)},
sha AS (SELECT id, sha256(lower(trim(title)) || '|' || lower(trim(language))) AS h, language || ':' || length(content) AS u FROM art),
bef AS MATERIALIZED (SELECT x AS id, y AS o, 'title' AS why FROM sim WHERE y < x UNION ALL SELECT a.id, b.id, 'hash' FROM sha a JOIN sha b ON a.h = b.h AND b.id < a.id
  UNION ALL SELECT a.id, b.id, 'url' FROM sha a JOIN sha b ON a.u = b.u AND b.id < a.id),
row_ AS MATERIALIZED (SELECT row_number() OVER (ORDER BY id) AS i, id, coalesce(nb, []) AS nb FROM art LEFT JOIN (SELECT id, list(DISTINCT o) AS nb FROM bef GROUP BY id) USING (id)),
r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS acc UNION ALL SELECT row_.i, CASE WHEN list_has_any(nb, acc) THEN acc ELSE list_append(acc, id) END FROM r JOIN row_ ON row_.i = r.i + 1),
ok AS MATERIALIZED (SELECT unnest(acc) AS id FROM (SELECT acc FROM r ORDER BY i DESC LIMIT 1)),
hit AS (SELECT bef.id, min(o) FILTER (why = 'hash') AS h, min(o) FILTER (why = 'url') AS u, max(o) FILTER (why = 'title') AS t FROM bef JOIN ok ON ok.id = o WHERE bef.id NOT IN (SELECT id FROM ok) GROUP BY bef.id)
SELECT art.id % 1099511627776 AS id, hit.id IS NOT NULL AS is_duplicate, coalesce(h, u, t) % 1099511627776 AS duplicate_of_id, CASE WHEN h IS NOT NULL THEN 'hash' WHEN u IS NOT NULL THEN 'url' WHEN t IS NOT NULL THEN 'title' END AS reason
FROM art LEFT JOIN hit USING (id) WHERE art.id >= 1099511627776"""
_GREEDY = f"""WITH RECURSIVE {BASE}, {ENTITIES}, {_near_sql(_INF, 35, "AND NOT (count(*) <= 1 AND x.n + y.n - count(*) >= 4)")},
can AS (SELECT x AS id, list({{'s': y, 'q': n_both / n_either::DOUBLE}}) AS c FROM sim JOIN art a ON a.id = x JOIN art b ON b.id = y
  WHERE (b.published_us, b.id) < (a.published_us, a.id) AND (a.category = 'general' OR b.category IN (a.category, 'general')) GROUP BY x),
row_ AS MATERIALIZED (SELECT row_number() OVER (ORDER BY published_us, id) AS i, id, published_us AS p, coalesce(c, []) AS c FROM art LEFT JOIN can USING (id)),
r AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS id, NULL::STRUCT(q DOUBLE, l BIGINT, s BIGINT) AS best, []::STRUCT(s BIGINT, l BIGINT)[] AS st
  UNION ALL SELECT i, id, best, CASE WHEN best IS NULL THEN list_append(st, {{'s': id, 'l': p}}) ELSE list_transform(st, lambda z: CASE WHEN z.s = -best.s THEN {{'s': z.s, 'l': greatest(z.l, p)}} ELSE z END) END
  FROM (SELECT row_.i, row_.id, p, st, list_sort(flatten(list_transform(c, lambda k: list_transform(list_filter(st, lambda z: z.s = k.s AND z.l >= p - 172800000000), lambda z: {{'q': k.q, 'l': z.l, 's': -z.s}}))))[-1] AS best FROM r JOIN row_ ON row_.i = r.i + 1)),
gre AS MATERIALIZED (SELECT id, CASE WHEN best IS NULL THEN id ELSE -best.s END AS cluster_id, CASE WHEN best IS NULL THEN 1.0 ELSE best.q END::DOUBLE AS similarity, CASE WHEN best IS NULL THEN 'seed' ELSE 'lexical' END AS method FROM r WHERE i > 0)"""

_STATE = """CASE WHEN f <= 10 THEN 'STALE' WHEN tr >= 80 AND v >= 60 AND source_count >= 2 THEN 'PEAK' WHEN tr >= 65 AND article_count >= 2 THEN 'TRENDING'
    WHEN f <= 35 AND v <= 20 THEN 'COOLING' WHEN tr >= 45 OR v >= 30 THEN 'RISING' ELSE 'EMERGING' END"""

ORACLES = {
    "leader_pass": _LEADER,
    "greedy_clusters": _GREEDY + " SELECT * FROM gre",
    "clustering_summary": _GREEDY
    + """ SELECT count(*) AS articles_evaluated, count(*) FILTER (method = 'seed') AS clusters_created, count(*) AS articles_assigned, count(DISTINCT cluster_id) FILTER (method = 'lexical') AS clusters_updated,
  (SELECT count(*) FROM lnk) AS entities_linked, count(DISTINCT cluster_id) AS clusters_scored FROM gre""",
    "rescored_stories": STORY + f"SELECT {', '.join(STORY_COLUMNS)} FROM sto WHERE cluster_id IN (SELECT cluster_id FROM mem JOIN art USING (id), newest WHERE published_us > t - 86400000000)",
    "indexed_search": f"WITH {BASE} SELECT query, id FROM art, (VALUES " + ", ".join(f"('{q}')" for q in SEARCHES) + ") v(query) WHERE contains(lower(title), lower(query)) OR contains(lower(content), lower(query))",
    "story_seek": STORY + "SELECT cluster_id, trending, title, (SELECT count(*) FROM sto) AS total FROM sto ORDER BY trending DESC, cluster_id LIMIT 25 OFFSET 50",
    "incremental_scores": STORY + f"SELECT {', '.join(STORY_COLUMNS)} FROM sto WHERE cluster_id IN (SELECT cluster_id FROM mem JOIN art USING (id), newest WHERE published_us > t - 86400000000)",
    "story_changes": f"""WITH {BASE}, s AS (SELECT cluster_id, id, published_us, CASE WHEN published_us - lag(published_us) OVER (PARTITION BY cluster_id ORDER BY published_us, id) <= 172800000000 THEN 0 ELSE 1 END AS b FROM mem JOIN art USING (id)),
g AS (SELECT *, sum(b) OVER (PARTITION BY cluster_id ORDER BY published_us, id ROWS UNBOUNDED PRECEDING) AS k FROM s),
p AS (SELECT cluster_id, k, min(published_us) AS first_us, max(published_us) AS last_us, count(*) AS articles FROM g GROUP BY cluster_id, k)
SELECT cluster_id, 'opened' AS change, first_us AS at_us, NULL::BIGINT AS articles FROM p UNION ALL
SELECT cluster_id, 'closed', last_us + 172800000000, articles FROM p, newest WHERE last_us + 172800000000 <= t""",
    "story_scores": STORY + "SELECT " + ", ".join(STORY_COLUMNS) + " FROM sto",
    "trending_top20": STORY + "SELECT cluster_id, title, trending, state FROM sto ORDER BY trending DESC, cluster_id LIMIT 20",
    "trending_per_category": STORY + "SELECT category, rank, cluster_id, trending FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY trending DESC, cluster_id)::INTEGER AS rank FROM sto) WHERE rank <= 5",
    "stories_recent": STORY + "SELECT cluster_id, last_us, category FROM sto WHERE category = 'world' ORDER BY last_us DESC, cluster_id LIMIT 50",
    "story_dashboard": STORY + "SELECT category, state, count(*) AS stories, grouping_id(category, state)::INTEGER AS level FROM sto GROUP BY ROLLUP (category, state)",
    "story_page": STORY + "SELECT cluster_id, trending, (SELECT count(*) FROM sto) AS total, ceil((SELECT count(*) FROM sto) / 25.0)::BIGINT AS pages, 2 AS page, 25 AS page_size FROM sto ORDER BY trending DESC, cluster_id LIMIT 25 OFFSET 25",
    "story_search": STORY + "SELECT cluster_id, title FROM sto WHERE contains(lower(title), 'the') AND category = 'world'",
    "story_labels": STORY + "SELECT cluster_id, CASE WHEN article_count > 1 THEN corroboration_label ELSE 'Reported by ' || source_count || ' independent source(s)' END AS label FROM sto",
    "story_explanations": STORY + "SELECT cluster_id, velocity, 0.3::DOUBLE AS weight, state FROM sto",
    "story_detail": f"WITH {BASE} SELECT cluster_id, art.id, title, src.name AS publisher, trust_level, published_us FROM mem JOIN art USING (id) JOIN src ON src.id = source_id",
    "state_transitions": f"""WITH {BASE}, tim AS (SELECT t - b * 3600000000 AS t FROM newest, (VALUES (24), (12), (0)) v(b)), men AS (SELECT 0::BIGINT AS cluster_id WHERE false),
{SCORES.split("ent AS")[0].split("cor AS")[1].join(["cor AS", ""])}
c AS (SELECT cluster_id, t, count(*) AS article_count, count(*) FILTER (published_us >= t - 21600000000) AS recent, count(*) FILTER (published_us >= t - 43200000000 AND published_us < t - 21600000000) AS previous,
    min(published_us) AS first_us, max(published_us) AS last_us FROM mem JOIN art USING (id), tim GROUP BY cluster_id, t),
g AS (SELECT c.*, source_count, floor(greatest(10.0, least(100.0, w / 5.0 * 100.0)) * 100 + 0.5) / 100 AS co,
    CASE WHEN article_count = 1 THEN 10.0 ELSE floor(least(100.0, recent * 15.0::DOUBLE + (article_count / greatest(1.0::DOUBLE, (last_us - first_us) / 3600000000.0::DOUBLE)) * 10.0::DOUBLE * least(2.0::DOUBLE, (recent + 1) / (previous + 1)::DOUBLE)) * 100 + 0.5) / 100 END::DOUBLE AS v,
    floor(100.0::DOUBLE * pow(0.5::DOUBLE, greatest(0.0::DOUBLE, (t - last_us) / 3600000000.0::DOUBLE) / 12.0::DOUBLE) * 100 + 0.5) / 100 AS f,
    (CASE category WHEN 'world' THEN 85 WHEN 'politics' THEN 85 WHEN 'business' THEN 80 WHEN 'technology' THEN 80 ELSE 50 END)::DOUBLE AS r FROM c JOIN cor USING (cluster_id) JOIN art ON art.id = cluster_id),
h AS (SELECT *, floor(greatest(0.0::DOUBLE, least(100.0::DOUBLE, v * 0.30::DOUBLE + f * 0.25::DOUBLE + co * 0.25::DOUBLE + r * 0.20::DOUBLE)) * 100 + 0.5) / 100 AS tr FROM g),
s AS (SELECT cluster_id, t AS as_of_us, {_STATE} AS state FROM h),
l AS (SELECT *, lag(state) OVER (PARTITION BY cluster_id ORDER BY as_of_us) AS previous_state FROM s)
SELECT * FROM l WHERE previous_state IS NULL OR previous_state <> state""",
    "entity_links": f"WITH {BASE}, {ENTITIES} SELECT * FROM lnk",
    "entity_dimension": f"WITH {BASE}, {ENTITIES} SELECT norm, name, entity_type FROM (SELECT lnk.*, row_number() OVER (PARTITION BY norm ORDER BY published_us, lnk.id, lnk.name, lnk.entity_type) AS k FROM lnk JOIN art USING (id)) WHERE k = 1",
    "entity_mentions": f"WITH {BASE}, {ENTITIES} SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY mention_count DESC, norm)::INTEGER AS rank FROM men",
    "entity_listing": f"WITH {BASE}, {ENTITIES} SELECT name, norm FROM (SELECT lnk.*, row_number() OVER (PARTITION BY norm ORDER BY published_us, lnk.id, lnk.name, lnk.entity_type) AS k FROM lnk JOIN art USING (id)) WHERE k = 1 AND entity_type = 'person'",
    "title_tokens": f"WITH {BASE} SELECT id, array_to_string({_TOK}, ' ') AS tokens, array_to_string({_INF}, ' ') AS informative FROM art",
    "exact_duplicates": f"WITH {BASE}, h AS (SELECT id, sha256(lower(trim(title)) || '|' || lower(trim(language))) AS h FROM art), m AS (SELECT id, min(id) OVER (PARTITION BY h) AS duplicate_of FROM h) SELECT * FROM m WHERE id <> duplicate_of",
    "near_title_pairs": _pairs_sql(_TOK, 85),
    "near_title_members": f"WITH {BASE}, t AS (SELECT id, {_TOK} AS tok FROM art) SELECT id, min(id) OVER (PARTITION BY tok) AS set_id FROM t WHERE len(tok) > 0",
    "similar_title_pairs": _pairs_sql(_INF, 35, "AND NOT (n_both <= 1 AND n_either >= 4)"),
    "new_against_history": _HISTORY,
    "best_clusters": f"""WITH {BASE}, o AS (SELECT art.* FROM art, newest WHERE published_us <= t - 86400000000), n AS (SELECT art.* FROM art, newest WHERE published_us > t - 86400000000),
m AS (SELECT *, min(id) OVER (PARTITION BY title) AS cluster_id FROM o),
c AS (SELECT cluster_id, min(published_us) AS first_us, max(published_us) AS last_us FROM m GROUP BY cluster_id),
ct AS (SELECT c.*, o.category, {_INF} AS tok FROM c JOIN o ON o.id = cluster_id), nt AS (SELECT id, category, published_us, {_INF} AS tok FROM n),
cw AS (SELECT *, len(tok) AS k, unnest(tok) AS w FROM ct), nw AS (SELECT *, len(tok) AS k, unnest(tok) AS w FROM nt),
j AS (SELECT nw.id, cluster_id, last_us, count(*) AS n_both, nw.k + cw.k - count(*) AS n_either FROM nw JOIN cw USING (w)
  WHERE last_us >= published_us - 172800000000 AND first_us <= published_us + 172800000000 AND (nw.category = 'general' OR cw.category IN (nw.category, 'general')) GROUP BY nw.id, cluster_id, last_us, nw.k, cw.k),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n_both / n_either DESC, last_us DESC, cluster_id) AS rk FROM j WHERE n_both * 100 >= n_either * 35 AND NOT (n_both <= 1 AND n_either >= 4))
SELECT id, cluster_id, n_both, n_either::BIGINT AS n_either FROM r WHERE rk = 1""",
    "cluster_table": f"WITH {BASE} SELECT m.cluster_id, s.title, s.category, min(a.published_us) AS first_us, max(a.published_us) AS last_us, count(*) AS article_count FROM mem m JOIN art a ON a.id = m.id JOIN art s ON s.id = m.cluster_id GROUP BY ALL",
    "evidence_articles": rf"""WITH {BASE}, b AS (SELECT cluster_id, art.*, src.name AS publisher, row_number() OVER (PARTITION BY cluster_id ORDER BY published_us DESC, art.id)::INTEGER AS rank FROM mem JOIN art USING (id) JOIN src ON src.id = source_id),
e AS (SELECT *, substring(trim(CASE WHEN content <> '' THEN content ELSE title END), 1, 1200) AS excerpt FROM b WHERE rank <= 8)
SELECT cluster_id, rank, id, length(excerpt)::INTEGER AS excerpt_chars, publisher,
  array_to_string(list_sort(list_distinct(regexp_extract_all(title || ' ' || excerpt, '\b\d[\d,\.]*%?\b'))), '|') AS numbers,
  array_to_string(list_sort(list_distinct(regexp_extract_all(title || ' ' || excerpt, '(?i)\b(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s*\d{{4}}\b|\b\d{{4}}-\d{{2}}-\d{{2}}\b'))), '|') AS dates,
  trim(CASE WHEN excerpt = '' THEN title ELSE regexp_replace(string_split(excerpt, '. ')[1], '\.+$', '') END) AS lead FROM e""",
}
