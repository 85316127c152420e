import random
import re

from pyspark.sql import functions as F

from storyloom.functions import text as X
from storyloom.functions.vocabulary import CLUSTER_STOP_WORDS
from storyloom.operators import cluster, dedup, entities, score

HOUR = score.HOUR


def test_entities(spark):
    rows = [(1, "Apple and NATO meet in Paris, France", None), (2, "President Jane Doe visits Lagos", "un"), (3, "the cat", ""), (4, None, None), (5, "O Bob Smith says Hi Al", None)]
    articles = spark.createDataFrame(rows, "id long, title string, summary string")
    got = {(r.id, r.norm): (r.name, r.entity_type, r.confidence) for r in entities.article_entities(articles, entities.gazetteer(spark)).collect()}
    assert got[1, "apple"] == ("Apple", "brand", 0.95) and got[1, "nato"] == ("Nato", "organization", 0.95)
    assert got[1, "paris"] == ("Paris", "location", 0.90) and got[1, "france"] == ("France", "country", 0.90)
    assert got[2, "president_jane_doe"] == ("President Jane Doe", "person", 0.75) and got[2, "un"][0] == "UN" and got[2, "lagos"][1] == "location"
    assert got[5, "bob_smith"][1] == "person" and (5, "o_bob_smith") not in got
    assert not any(i in (3, 4) for i, _ in got)


def pair(spark, a, b):
    row = spark.createDataFrame([(a, b)], "a string, b string")
    return row.select(cluster.lexical_similarity(X.informative_tokens(F.col("a")), X.informative_tokens(F.col("b")))).first()[0]


def test_similarity(spark):
    t = "Central bank raises interest rates again"
    assert pair(spark, t, t) == 1.0
    assert pair(spark, t, "Central bank raises interest rates sharply") >= 0.66
    assert pair(spark, t, "Storm floods northern towns") == 0.0
    assert pair(spark, "Apple unveils new phone lineup", "Apple faces antitrust lawsuit today") == 0.0


def test_scores(spark):
    def v(n, recent, previous, hours):
        row = spark.range(1).select(score.velocity(F.lit(n), F.lit(recent), F.lit(previous), F.lit(0), F.lit(hours * HOUR)))
        return row.first()[0]

    assert v(0, 0, 0, 0) == 0 and v(1, 1, 0, 0) == 10 and 50 <= v(4, 4, 0, 2) <= 100
    fresh = lambda h: spark.range(1).select(score.freshness(F.lit(-h * HOUR), 0)).first()[0]
    assert fresh(0) == 100 and fresh(12) == 50 and fresh(24) == 25 and fresh(48) < 10
    rows = [(50, 10, 5, 1, 1, "STALE"), (85, 70, 90, 5, 3, "PEAK"), (70, 30, 60, 3, 1, "TRENDING"), (40, 10, 30, 2, 1, "COOLING"), (50, 10, 60, 1, 1, "RISING"), (30, 10, 60, 1, 1, "EMERGING")]
    df = spark.createDataFrame([(float(a), float(b), float(c), d, e, w) for a, b, c, d, e, w in rows], "t double, v double, f double, a long, s long, want string")
    assert all(r.want == r.got for r in df.withColumn("got", score.state(*(F.col(c) for c in "tvfas"))).collect())
    members = spark.createDataFrame([(1, i) for i in range(1, 6)] + [(2, 6), (2, 7), (3, 8)], "cluster_id long, id long")
    articles = spark.createDataFrame([(i, 1) for i in range(1, 6)] + [(6, 2), (7, 3), (8, 2)], "id long, source_id long")
    sources = spark.createDataFrame([(1, "a", "low"), (2, "b", "high"), (3, "c", "verified")], "id long, name string, trust_level string")
    got = {r.cluster_id: r for r in score.corroboration(members, articles, sources).collect()}
    assert got[1].source_count == 1 and got[2].source_count == 2 and got[2].corroboration >= 60 and 20 <= got[3].corroboration <= 35
    assert got[1].corroboration_label == "Reported by 1 independent source"


WORDS = "bank rates storm floods council transit vote election phone launch robot strike court trial market tax budget school water energy".split()


def random_articles(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(1, n + 1):
        words = r.sample(WORDS, r.choice([0, 2, 3, 3, 4, 5]))
        if rows and r.random() < 0.5:
            words = rows[r.randrange(len(rows))][1].split()
            if words and r.random() < 0.7:
                words[r.randrange(len(words))] = r.choice(WORDS)
        rows.append((i, " ".join(words), r.choice(["world", "general", None, "sports"]), r.randrange(200) * HOUR))
    return rows


def informative(title):
    return {w for w in re.findall(r"[a-z0-9]{3,}", title.lower()) if w not in CLUSTER_STOP_WORDS}


def sequential_clusters(rows):
    clusters, out = [], {}
    for i, title, category, t in sorted(rows, key=lambda r: (r[3], r[0])):
        tokens, best = informative(title), None
        for c in clusters:
            if c["last"] < t - 48 * HOUR or c["first"] > t + 48 * HOUR or category and category != "general" and c["category"] not in (category, "general"):
                continue
            both, either = len(tokens & c["tokens"]), len(tokens | c["tokens"])
            if not tokens or not c["tokens"] or both <= 1 and either >= 4 or 100 * both < 35 * either:
                continue
            key = (both / either, c["last"], -c["id"])
            if best is None or key > best[0]:
                best = (key, c)
        if best:
            out[i] = best[1]["id"]
            best[1]["first"], best[1]["last"] = min(best[1]["first"], t), max(best[1]["last"], t)
        else:
            out[i] = i
            clusters.append({"id": i, "tokens": tokens, "category": category or "general", "first": t, "last": t})
    return out


def test_greedy_equals_the_sequential_pass(spark):
    rows = random_articles(250, 3)
    articles = spark.createDataFrame(rows, "id long, title string, category string, published_us long")
    got = {r.id: r.cluster_id for r in cluster.greedy_clusters(articles).collect()}
    assert got == sequential_clusters(rows)
    links = spark.createDataFrame(sorted(got.items()), "id long, cluster_id long")
    again = {r.id: (r.cluster_id, r.method) for r in cluster.greedy_clusters(articles, links).collect()}
    assert {i: c for i, (c, _) in again.items()} == got and all(m == "kept" for _, m in again.values())


def test_leader_pass_equals_the_sequential_pass(spark):
    r = random.Random(5)
    rows = [(i, t or "x", f"u{r.randrange(150)}") for i, t, _, _ in random_articles(200, 9)]
    df = spark.createDataFrame(rows, "id long, title string, canonical_url string").withColumn("content_hash", X.content_hash(F.col("title"), F.col("canonical_url")))
    got = {x.id: x.is_duplicate for x in dedup.leader_pass(df).collect()}
    stored, want = [], {}
    for i, title, url in rows:
        tokens = set(re.findall(r"\w{3,}", title.lower()))
        hit = any(u == url or tokens and s and 100 * len(tokens & s) >= 85 * len(tokens | s) for s, u in stored)
        want[i] = hit
        if not hit:
            stored.append((tokens, url))
    assert got == want


def test_leader_pass_names_targets_and_loads_no_group(spark):
    """A title that half of the rows share, hashes and URLs that cross it and null keys: every target and reason, without a group in one task."""
    r = random.Random(8)
    hot, rows = "bank rates storm floods council transit vote", []
    for i in range(1, 161):
        w = hot.split()
        if i % 2:
            w = r.sample(WORDS, 7)
        elif i % 3 == 0:
            w.append(r.choice(WORDS))
        rows.append((i, " ".join(w), r.choice(["h1", None, f"h{i}", f"h{i}"]), r.choice([None, f"u{r.randrange(60)}"])))
    out = dedup.leader_pass(spark.createDataFrame(rows, "id long, title string, content_hash string, canonical_url string"))
    assert "Pandas" not in out._jdf.queryExecution().toString()
    got = {x.id: (x.duplicate_of_id, x.reason) for x in out.collect()}
    stored, want = [], {}
    for i, title, h, u in rows:
        t = set(title.split())
        hits = [[j for j, _, g, _ in stored if h and g == h], [j for j, _, _, v in stored if u and v == u], [j for j, s, _, _ in stored if 100 * len(t & s) >= 85 * len(t | s)]]
        want[i] = next(((max(x), n) for x, n in zip(hits, ("hash", "url", "title"), strict=True) if x), (None, None))
        if want[i][0] is None:
            stored.append((i, t, h, u))
    assert got == want and len(got) == 160


def test_prefix_filter_finds_all_pairs(spark):
    r = random.Random(1)
    sets = {i: sorted(r.sample(WORDS, r.randint(1, 8))) for i in range(120)}
    df = spark.createDataFrame([(i, t) for i, t in sets.items()], "set_id long, tokens array<string>")
    got = {(x.a, x.b) for x in dedup.token_set_pairs(df, 50).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(set(sets[a]) & set(sets[b])) >= 50 * len(set(sets[a]) | set(sets[b]))}
    assert got == want


def test_empty_tables(spark):
    articles = spark.createDataFrame([], "id long, title string, category string, published_us long")
    assert cluster.greedy_clusters(articles).count() == 0


def test_rescoring_touches_only_what_it_is_given(spark):
    day = 86_400_000_000
    articles = spark.createDataFrame([(1, 1, "A", 0), (2, 2, "A", day), (3, 1, "B", day)], "id long, source_id long, title string, published_us long")
    sources = spark.createDataFrame([(1, "high"), (2, "low")], "id long, trust_level string")
    clusters = spark.createDataFrame([(1, "world"), (3, "general")], "cluster_id long, category string")
    members = spark.createDataFrame([(1, 1), (1, 2), (3, 3)], "cluster_id long, id long")
    mentions = spark.createDataFrame([(1, "x"), (3, "y")], "cluster_id long, entity string")
    every = score.score_clusters(clusters, members, articles, sources, mentions, day)
    touched = spark.createDataFrame([(1,), (1,), (None,), (77,)], "cluster_id long")
    some = score.rescore_clusters(touched, clusters, members, articles, sources, mentions, day)
    assert [tuple(r) for r in some.collect()] == [tuple(r) for r in every.where("cluster_id = 1").collect()] and some.first().article_count == 2
    assert score.rescore_clusters(touched.limit(0), clusters, members, articles, sources, None, day).count() == 0
