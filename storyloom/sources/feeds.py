"""Landed feed payloads (S1-S3, S11): RSS, Atom and JSON Feed to entries, with the rejects and their reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ENCLOSURE = "array<struct<_type:string,_url:string>>"
_MEDIA = "array<struct<_url:string,_medium:string,_type:string>>"
ITEM = f"title string, link string, guid string, pubDate string, author string, description string, category array<string>, enclosure {_ENCLOSURE}, `media:content` {_MEDIA}, `content:encoded` string, `dc:creator` string"
ENTRY = "title string, link array<struct<_href:string,_rel:string,_type:string>>, id string, published string, updated string, author struct<name:string>, summary string, content string, category array<struct<_term:string>>"
JSON_FEED = "struct<title:string,home_page_url:string,description:string,version:string,items:array<struct<id:string,url:string,title:string,summary:string,content_html:string,content_text:string,date_published:string,author:struct<name:string>,tags:array<string>,image:string>>>"
EMPTY_FILES = "array<struct<type:string,href:string>>"
EMPTY_MEDIA = "array<struct<url:string,medium:string,type:string>>"


def _kind():
    p = F.ltrim(F.col("payload"))
    return F.when(p.startswith("{"), "json").when(F.col("payload").rlike(r"(?is)<feed[\s>]"), "atom").when(F.col("payload").rlike(r"(?is)<(rss|rdf|channel)[\s>:]"), "rss")


def parse_feeds(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, rejects) of ``payloads`` (source_id, fetched_at, payload); ``position`` is an entry's place in its feed, from 0.

    Complete ``<item>`` and ``<entry>`` blocks are cut out and parsed one by one, so a feed that breaks off still gives the entries before the
    break; a payload with no entry at all is a reject.
    """
    p = payloads.select("source_id", "fetched_at", F.coalesce("payload", F.lit("")).alias("payload")).withColumn("kind", _kind())
    block = lambda tag: F.posexplode(F.regexp_extract_all("payload", F.lit(rf"(?s)<{tag}[\s>].*?</{tag}\s*>"), 0)).alias("position", "block")
    polled, keys = ["source_id", "fetched_at"], ["source_id", "fetched_at", "position"]
    rss = p.where("kind = 'rss'").select(*polled, block("item")).select(*keys, F.from_xml("block", ITEM).alias("i")).where("i is not null")
    rss = rss.select(
        *keys, "i.title", "i.link", F.coalesce("i.guid", "i.link").alias("guid"), F.col("i.pubDate").alias("published"), F.coalesce("i.author", F.col("i.dc:creator")).alias("author"),
        F.col("i.description").alias("summary"), F.col("i.content:encoded").alias("content"), F.get("i.category", F.lit(0)).alias("category"),
        F.transform("i.enclosure", lambda e: F.struct(e["_type"].alias("type"), e["_url"].alias("href"))).alias("enclosures"),
        F.transform(F.col("i.media:content"), lambda m: F.struct(m["_url"].alias("url"), m["_medium"].alias("medium"), m["_type"].alias("type"))).alias("media_content"),
    )
    atom = p.where("kind = 'atom'").select(*polled, block("entry")).select(*keys, F.from_xml("block", ENTRY).alias("e")).where("e is not null")
    link = F.get(F.filter("e.link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"]
    files = F.transform(F.filter("e.link", lambda x: x["_rel"] == "enclosure"), lambda x: F.struct(x["_type"].alias("type"), x["_href"].alias("href")))
    atom = atom.select(
        *keys, "e.title", link.alias("link"), F.coalesce("e.id", link).alias("guid"), F.coalesce("e.published", "e.updated").alias("published"), F.col("e.author.name").alias("author"), "e.summary", "e.content",
        F.get("e.category", F.lit(0))["_term"].alias("category"), files.alias("enclosures"), F.lit(None).cast(EMPTY_MEDIA).alias("media_content"),
    )
    feed = p.where("kind = 'json'").select(*polled, F.from_json("payload", JSON_FEED).alias("f")).select(*polled, F.posexplode("f.items").alias("position", "j"))
    json = feed.select(
        *keys, "j.title", F.col("j.url").alias("link"), F.coalesce("j.id", "j.url").alias("guid"), F.col("j.date_published").alias("published"), F.col("j.author.name").alias("author"), "j.summary",
        F.coalesce("j.content_html", "j.content_text").alias("content"), F.get("j.tags", F.lit(0)).alias("category"),
        F.when(F.col("j.image").isNotNull(), F.array(F.struct(F.lit("image/*").alias("type"), F.col("j.image").alias("href")))).cast(EMPTY_FILES).alias("enclosures"), F.lit(None).cast(EMPTY_MEDIA).alias("media_content"),
    )
    entries = rss.unionByName(atom).unionByName(json)
    blocks = F.when(F.col("kind") == "json", F.size(F.from_json("payload", JSON_FEED)["items"])).otherwise(F.regexp_count("payload", F.lit(r"(?s)<(item|entry)[\s>].*?</(item|entry)\s*>")))
    rejects = p.withColumn("n", F.coalesce(blocks, F.lit(0))).where("kind is null or n <= 0")
    reason = F.when(F.trim("payload") == "", "empty payload").when(F.col("kind").isNull(), "not a feed").otherwise("no complete entry")
    return entries, rejects.select(*polled, reason.alias("reason"))


def feed_metadata(payloads: DataFrame) -> DataFrame:
    """(source_id, fetched_at, title, link, description, version) of the feed itself."""
    p = payloads.withColumn("kind", _kind())
    head = F.regexp_replace("payload", r"(?s)<(item|entry)[\s>].*", "")
    tag = lambda *names: F.coalesce(*(F.nullif(F.trim(F.regexp_extract(head, rf"(?s)<{n}[^>]*>(.*?)</{n}>", 1)), F.lit("")) for n in names))
    j = F.from_json("payload", JSON_FEED)
    is_json = F.col("kind") == "json"
    version = F.when(F.col("kind") == "rss", F.concat(F.lit("rss"), F.replace(F.regexp_extract(head, r'<rss[^>]*version="([^"]*)"', 1), F.lit("."), F.lit("")))).when(F.col("kind") == "atom", "atom10")
    link = F.coalesce(tag("link"), F.nullif(F.regexp_extract(head, r'<link[^>]*href="([^"]*)"', 1), F.lit("")))
    return p.select(
        "source_id", "fetched_at", F.when(is_json, j["title"]).otherwise(tag("title")).alias("title"), F.when(is_json, j["home_page_url"]).otherwise(link).alias("link"),
        F.when(is_json, j["description"]).otherwise(tag("description", "subtitle")).alias("description"), F.when(is_json, j["version"]).otherwise(version).alias("version"),
    )
