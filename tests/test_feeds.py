from pyspark.sql import functions as F

from storyloom.operators.normalize import normalize_entries, run_audit
from storyloom.sources import feeds, tables

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:media="http://search.yahoo.com/mrss/"><channel><title>Desk</title><link>https://d.example</link><description>All</description>
<item><title>First story</title><link>https://d.example/a/?utm_source=rss&amp;ref=x</link><guid isPermaLink="false">g1</guid><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate>
<description>&lt;p&gt;Hello &lt;b&gt;World&lt;/b&gt;&lt;/p&gt;</description><media:content url="https://d.example/i.jpg" medium="image"/></item>
<item><title>Second story</title><link>https://d.example/b</link><guid>g2</guid><category>World</category></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>Atom</title><link href="https://a.example"/><entry><title>One</title><link href="https://a.example/1"/><id>urn:1</id>
<published>2024-01-01T08:00:00Z</published><updated>2024-01-02T08:00:00Z</updated><category term="tech"/><summary type="html">&lt;i&gt;x&lt;/i&gt;</summary></entry></feed>"""
JSON = '{"version":"https://jsonfeed.org/version/1","title":"J","items":[{"id":"1","url":"https://j.example/1","title":"T","content_text":"c","tags":["health"]}]}'
BROKEN = "<rss><channel><item><title>kept</title><link>https://k.example</link></item><item><title>cut off"


def payloads(spark):
    rows = [(1, RSS), (2, ATOM), (3, JSON), (4, ""), (5, "<html>no</html>"), (6, BROKEN), (7, None), (8, "<rss><channel></channel></rss>")]
    return spark.createDataFrame(rows, "source_id long, payload string").withColumn("fetched_at", F.lit("2024-02-01 00:00:00").cast("timestamp"))


def test_parse_and_reject(spark):
    entries, rejects = feeds.parse_feeds(payloads(spark))
    rows = {(r.source_id, r.guid): r for r in entries.collect()}
    assert set(rows) == {(1, "g1"), (1, "g2"), (2, "urn:1"), (3, "1"), (6, "https://k.example")}
    assert rows[1, "g1"].media_content[0].medium == "image"
    assert rows[2, "urn:1"].published == "2024-01-01T08:00:00Z" and rows[2, "urn:1"].category == "tech"
    assert {(r.source_id, r.reason) for r in rejects.collect()} == {(4, "empty payload"), (5, "not a feed"), (7, "empty payload"), (8, "no complete entry")}


def test_metadata(spark):
    meta = {r.source_id: r for r in feeds.feed_metadata(payloads(spark)).collect()}
    assert (meta[1].title, meta[1].link, meta[1].version) == ("Desk", "https://d.example", "rss20")
    assert (meta[2].title, meta[2].link) == ("Atom", "https://a.example")
    assert meta[3].title == "J"


def test_normalize(spark):
    entries, _ = feeds.parse_feeds(payloads(spark))
    n = {r.guid: r for r in normalize_entries(entries).collect()}
    assert n["g1"].canonical_url == "https://d.example/a" and n["g1"].summary == "Hello World" and n["g1"].image_url == "https://d.example/i.jpg"
    assert n["g1"].published_at.hour == 10 and n["g2"].published_at.month == 2 and n["g2"].category == "world" and n["g1"].category == "general"
    bad = spark.createDataFrame([("", "x"), ("t", None), ("t" * 600, "https://x.y")], "title string, link string")
    full = bad.select(F.lit(1).alias("source_id"), F.current_timestamp().alias("fetched_at"), "title", "link", *(F.lit(None).cast("string").alias(c) for c in ("guid", "published", "author", "summary", "content", "category")), F.lit(None).cast(feeds.EMPTY_FILES).alias("enclosures"), F.lit(None).cast(feeds.EMPTY_MEDIA).alias("media_content"))
    assert [r.reject_reason for r in normalize_entries(full).collect()] == ["empty title", "no link or guid", "title too long"]


def test_tables(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", True), (2, "b", False)], "id long, feed_url string, enabled boolean")
    new = spark.createDataFrame([(3, "b", True), (4, "c", True), (4, "c", True)], "id long, feed_url string, enabled boolean")
    assert [r.feed_url for r in tables.insert_absent(new, old, "feed_url").collect()] == ["c"]
    patched = tables.patch(old, spark.createDataFrame([(1, None, False)], "id long, feed_url string, enabled boolean"), "id")
    assert sorted((r.id, r.feed_url, r.enabled) for r in patched.collect()) == [(1, "a", False), (2, "b", False)]
    articles = spark.createDataFrame([(10, 1), (11, 2)], "id long, source_id long")
    links = spark.createDataFrame([(5, 10), (5, 11)], "cluster_id long, id long")
    s, a, m = tables.delete_cascade(old.where("id = 1").select("id"), old, articles, links)
    assert ([r.id for r in s.collect()], [r.id for r in a.collect()], [r.id for r in m.collect()]) == ([2], [11], [11])
    tables.write_articles(articles.withColumn("published_at", F.lit("2024-01-01 05:00:00").cast("timestamp")), str(tmp_path / "articles"))
    assert spark.read.parquet(str(tmp_path / "articles")).select("publish_date").distinct().count() == 1
    runs = spark.createDataFrame([(1, 1, "ingested"), (1, 1, "skipped"), (2, 1, "failed")], "run_id long, source_id long, outcome string")
    assert {(r.run_id, r.articles_found, r.articles_ingested, r.articles_skipped, r.status) for r in run_audit(runs).collect()} == {(1, 2, 1, 1, "COMPLETED"), (2, 0, 0, 0, "FAILED")}
