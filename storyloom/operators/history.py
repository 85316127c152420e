"""Resolution of new articles against stored ones (D7, D8): an index of what is stored, and the ordered pass with stored articles as fixed leaders.

The index has one row for each key of a stored article: its content hash, its canonical URL, and keys of its title. Title keys don't depend on how
often words occur, so old entries stay valid as the store grows. Two token sets of similarity ``PERCENT`` % or more differ in at most d
tokens. The tokens of a set are dealt to a few blocks more than d by their hashes; similar sets differ in at most d blocks, so their lists of
blocks, in one order of all possible blocks (those of three tokens and more first), share one of the first d + 1 entries. Titles of up to six tokens
must be equal. A new title looks itself up under every size that a similar one may have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import title_tokens
from .dedup import leader_pass
from .graph import Scratch, stored

PERCENT = 85
#: Partitions of the index by key, so a batch of few articles reads few of them.
BUCKETS = 64
INDEX = "kind string, key long, id long, value string, tokens array<string>"


def _block_keys(hashes: Column, size: Column, percent: int) -> Column:
    """The first d + 1 blocks of a set (sorted token hashes) laid out for sets of ``size`` tokens."""
    d = F.floor((100 - percent) * (size + F.floor(size * 100 / percent)) / (100 + percent)).cast("int")
    n_blocks = F.when(d == 0, F.lit(1)).otherwise(F.floor(d * 115 / 100).cast("int") + 2)
    within = lambda b: F.filter(hashes, lambda h: F.pmod(h, n_blocks) == b)
    entry = lambda b: F.struct((-F.least(F.size(within(b)), F.lit(3))).alias("few"), b.alias("block"), F.xxhash64(size, b, within(b)).alias("key"))
    blocks = F.array_sort(F.transform(F.sequence(F.lit(0), n_blocks - 1), entry))
    return F.transform(F.slice(blocks, 1, d + 1), lambda e: e["key"])


def _token_hashes(tokens: Column) -> Column:
    return F.array_sort(F.transform(tokens, lambda t: F.xxhash64(t)))


def title_keys(tokens: Column, percent: int = PERCENT) -> Column:
    """The keys under which a stored title stands."""
    return _block_keys(_token_hashes(tokens), F.size(tokens), percent)


def title_probes(tokens: Column, percent: int = PERCENT) -> Column:
    """The keys under which a stored title that is similar to this one may stand."""
    n = F.size(tokens)
    sizes = F.sequence(F.ceil(n * percent / 100).cast("int"), F.floor(n * 100 / percent).cast("int"))
    return F.array_distinct(F.flatten(F.transform(sizes, lambda s: _block_keys(_token_hashes(tokens), s, percent))))


def _bucket() -> Column:
    return F.pmod("key", F.lit(BUCKETS)).cast("int").alias("bucket")


def index_rows(articles: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(bucket, kind, key, id, value, tokens) of articles (id, title, content_hash, canonical_url); null hashes and URLs and titles without tokens
    have no rows."""
    none, no_tokens = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    exact = [articles.where(F.col(c).isNotNull()).select(F.lit(c).alias("kind"), F.xxhash64(F.lit(c), c).alias("key"), "id", F.col(c).alias("value"), no_tokens.alias("tokens")) for c in ("content_hash", "canonical_url")]
    titles = articles.select("id", title_tokens(F.col("title")).alias("tokens")).where(F.size("tokens") > 0)
    titles = titles.select(F.lit("title").alias("kind"), F.explode(title_keys(F.col("tokens"), percent)).alias("key"), "id", none.alias("value"), "tokens")
    return exact[0].unionByName(exact[1]).unionByName(titles).select(_bucket(), "kind", "key", "id", "value", "tokens")


def stored_matches(batch: DataFrame, index: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(id, content_hash_of, canonical_url_of, title_of) of the rows of ``batch`` that a stored article makes duplicates: the first stored one with the
    hash and with the URL, and the newest one with a similar title. Equal values and equal token sets of the batch are looked up once."""
    scratch = Scratch(batch.sparkSession, "history")
    rows = scratch.put(batch.select("id", "content_hash", "canonical_url", F.array_sort(title_tokens(F.col("title"))).alias("tokens")), "batch")
    exact = [rows.where(F.col(c).isNotNull()).select(F.lit(c).alias("kind"), F.xxhash64(F.lit(c), c).alias("key"), F.col(c).alias("value"), F.lit(None).cast("array<string>").alias("tokens")).distinct() for c in ("content_hash", "canonical_url")]
    sets = rows.where(F.size("tokens") > 0).select("tokens").distinct()
    titles = sets.select(F.lit("title").alias("kind"), F.explode(title_probes(F.col("tokens"), percent)).alias("key"), F.lit(None).cast("string").alias("value"), "tokens")
    probes = scratch.put(exact[0].unionByName(exact[1]).unionByName(titles).select(_bucket(), "kind", "key", "value", "tokens"), "probes")
    touched = [r["bucket"] for r in probes.select("bucket").distinct().collect()]  # at most BUCKETS numbers
    near = index.where(F.col("bucket").isin(touched)).select("bucket", "kind", "key", "id", F.col("value").alias("s_value"), F.col("tokens").alias("s_tokens"))
    met = probes.join(near, ["bucket", "kind", "key"])
    both = F.size(F.array_intersect("tokens", "s_tokens"))
    alike = both * 100 >= (F.size("tokens") + F.size("s_tokens") - both) * percent
    found = met.where(F.when(F.col("kind") == "title", alike).otherwise(F.col("value") == F.col("s_value")))
    found = scratch.put(found.groupBy("kind", "value", "tokens").agg(F.min("id").alias("first"), F.max("id").alias("last")), "found")
    out = rows
    for c in ("content_hash", "canonical_url"):
        out = out.join(found.where(F.col("kind") == c).select(F.col("value").alias(c), F.col("first").alias(f"{c}_of")), c, "left")
    out = out.join(found.where("kind = 'title'").select("tokens", F.col("last").alias("title_of")), "tokens", "left")
    names = ["content_hash_of", "canonical_url_of", "title_of"]
    out = stored(out.select("id", *names).where(F.coalesce(*names).isNotNull()), "history-matches")
    scratch.close()
    return out


def resolve(batch: DataFrame, index: DataFrame | None, percent: int = PERCENT) -> DataFrame:
    """(id, is_duplicate, duplicate_of_id, reason) of a batch of articles (id, title, content_hash, canonical_url) that come, in the order of their ids,
    after all articles of ``index``: what the pass over all articles one by one decides for them (D6 with D7). Ids are unique and larger
    than stored ones. A second run over articles that are stored accepts none of them (D8)."""
    return leader_pass(batch, percent, None if index is None else stored_matches(batch, index, percent))


def numbered(rows: DataFrame, order: list[str], first: int = 0) -> DataFrame:
    """``rows`` with an ``id`` that ascends in ``order``, from ``first`` on, with gaps; sorted by ranges, so no task sees all rows. Store it before use:
    where the order has ties, a second reading may number them otherwise."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id() + first)
