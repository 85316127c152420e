"""N-gram Jaccard self join by parity sketches (operator 1).

A document is the set of its distinct k-word shingles. Every shingle toggles one bit of a wide bit sketch, so the Hamming distance of two
sketches never exceeds the size of the sets' symmetric difference. Documents of similar size share one sketch layout (a size band): the
sketch is cut into more blocks than two similar sets may differ in, so by the pigeonhole principle similar documents agree on a whole block.

* Exact copies (equal sets) are folded first; one representative stands for a group of any size.
* A document keys the first d+1 blocks in one global order (blocks of three bits or more first), where d bounds the symmetric difference
  with any partner: two lists of blocks that differ in at most d places share one of their first d+1 entries, so no link is lost.
* In a bucket each member is first paired with the bucket's least id only (a star), verified, and joined into components; only members of
  different components are then paired. A group of n near copies thus costs about n pairs, not n * n.
* Pairs pass the size bound, then the Hamming bound on folded sketches, then exact intersection of the shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components as connected_components
from .scratch import Scratch, hot_rows, join_hot, materialize, row_key, semi_join, unused
from .textops import U64, Words, as_long, chunks, distinct_shingles, mix64, runs

BLOCK_BITS = 4096
#: Buckets of at most so many members are joined with themselves; larger ones are compared in tiles.
SMALL_BUCKET = 32
TILE = 2048


@dataclass(frozen=True)
class Threshold:
    """Jaccard similarity of at least num/den, in whole numbers; at least one half, so that similar sets lie in one or two size bands."""

    num: int = 80
    den: int = 100

    def __post_init__(self) -> None:
        if not 0 < self.den <= 2 * self.num <= 2 * self.den:
            raise ValueError(f"the similarity {self.num}/{self.den} is not between one half and one")

    def difference(self, a, b):
        """The largest symmetric difference of similar sets of sizes a and b."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def largest(self, a):
        return a * self.den // self.num

    def smallest(self, b):
        return -(-b * self.num // self.den)


def layout(band, th: Threshold):
    """Blocks of the sketch in the size band [2**band, 2**(band+1))."""
    top = (np.int64(2) << np.asarray(band, dtype=np.int64)) - 1
    return (th.difference(top, th.largest(top)) + 1) * 115 // 100 + 2


def block_keys(text: np.ndarray, shingle: np.ndarray, band: np.ndarray, limit: np.ndarray, th: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of the first ``limit`` + 1 blocks of each text's parity sketch in ``band``, both given by text."""
    n_blocks = layout(band, th)
    m = n_blocks[text].astype(U64)
    bit = mix64(shingle + U64(0x51ED))
    position = (bit % m) * U64(BLOCK_BITS) + (bit >> U64(52))
    wide = int(n_blocks.max(initial=1)) * BLOCK_BITS
    place = np.sort(text.astype(U64) * U64(wide) + position)
    first = runs(place)
    odd = np.diff(np.append(first, len(place))) % 2 == 1  # a bit toggled twice is clear again
    place = place[first[odd]]
    first = runs(place // U64(BLOCK_BITS))
    count = np.diff(np.append(first, len(place)))
    at = place[first]
    of, block = (at // U64(wide)).astype(np.int64), (at % U64(wide)) // U64(BLOCK_BITS)
    content = np.bitwise_xor.reduceat(mix64(place % U64(wide) + U64(1)), first) if len(first) else np.zeros(0, U64)
    key = mix64(content ^ mix64(block * U64(131) + band[of].astype(U64) + U64(7 << 40)))
    order = np.lexsort((block, -np.minimum(count, 3), of))
    of, key = of[order], key[order]
    begin = np.searchsorted(of, np.arange(len(band)))
    keep = np.arange(len(of)) - begin[of] <= limit[of]
    filled = np.bincount(of, minlength=len(band))
    texts, keys = [of[keep]], [key[keep]]
    for i in np.flatnonzero((limit >= 0) & (filled <= limit)):  # very small sets: empty blocks count as well
        have = block[order][begin[i] : begin[i] + filled[i]]
        empty = np.setdiff1d(np.arange(n_blocks[i], dtype=U64), have)[: limit[i] + 1 - filled[i]]
        texts.append(np.full(len(empty), i))
        keys.append(mix64(mix64(empty * U64(131) + U64(band[i]) + U64(7 << 40)) ^ U64(0xE0)))
    return np.concatenate(texts), np.concatenate(keys)


def folded_sketch(shingles: np.ndarray) -> bytes:
    """The sketch folded to a power of two of about as many bits as the set has members (64 at least); folding keeps the bound."""
    bits = 1 << max(6, int(len(shingles)).bit_length())
    at = (mix64(shingles + U64(0x51ED)) & U64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def hamming(x: bytes, y: bytes) -> int:
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _sketches(k: int, th: Threshold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for first, last, data, offsets in chunks(batch.column(1)):
                    yield one(batch.column(0)[first:last], data, offsets)

    def one(ids, data, offsets):
        words = Words(data, offsets)
        text, s = distinct_shingles(words, k)
        n = np.bincount(text, minlength=words.n_texts)
        fp1, fp2 = np.zeros(len(n), U64), np.zeros(len(n), U64)
        np.add.at(fp1, text, mix64(s ^ U64(0x1234567)))
        np.add.at(fp2, text, mix64(s + U64(0x89ABCDEF)))
        band = np.maximum(np.ceil(np.log2(np.maximum(n, 1) + 1)).astype(np.int64) - 1, 0)
        own = np.where(n > 0, th.difference(n, th.largest(n)), 0)
        low = np.int64(1) << band
        lower = np.where((n > 0) & (th.smallest(n) < low), th.difference(n, low - 1), 0)
        own[own == 0] = -1  # only equal sets are similar, and those are folded
        lower[lower == 0] = -1
        parts = [block_keys(text, s, band, own, th)]
        has = lower[text] >= 0
        parts.append(block_keys(text[has], s[has], np.maximum(band - 1, 0), lower, th))
        of, key = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(of, kind="stable")
        sizes = np.bincount(of, minlength=len(n))
        cuts = np.searchsorted(text, np.arange(len(n) + 1))
        sketch = [folded_sketch(s[cuts[i] : cuts[i + 1]]) for i in range(len(n))]
        keys = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(as_long(key[order])))
        return pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), pa.array(as_long(fp1)), pa.array(as_long(fp2)), keys, pa.array(sketch, pa.binary())], names=["id", "n_shingles", "fp1", "fp2", "block_keys", "sketch"])

    return run


def _sets(k: int):
    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                for first, last, data, offsets in chunks(batch.column(1)):
                    words = Words(data, offsets)
                    text, s = distinct_shingles(words, k)
                    cuts = np.searchsorted(text, np.arange(words.n_texts + 1))
                    yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], pa.array([s[cuts[i] : cuts[i + 1]].tobytes() for i in range(words.n_texts)], pa.binary())], names=["id", "shingles"])

    return run


def _near(th: Threshold):
    def run(batches):
        for batch in batches:
            x = batch.to_pydict()
            ok = [hamming(p, q) <= th.difference(m, n) for p, q, m, n in zip(x["sa"], x["sb"], x["na"], x["nb"], strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _verified(th: Threshold):
    def run(batches):
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            both, either = [], []
            for p, q in zip(batch.column("pa"), batch.column("pb"), strict=True):
                x, y = np.frombuffer(p.as_buffer(), U64), np.frombuffer(q.as_buffer(), U64)
                i = len(np.intersect1d(x, y, assume_unique=True))
                both.append(i)
                either.append(len(x) + len(y) - i)
            out = pa.RecordBatch.from_arrays([a, b, pa.array(both, pa.int64()), pa.array(either, pa.int64())], names=["a", "b", "n_both", "n_either"])
            ok = th.den * np.array(both, np.int64) >= th.num * np.array(either, np.int64)
            yield out.filter(pa.array(ok, pa.bool_()))

    return run


def _tile(th: Threshold):
    def run(table: pa.Table) -> pa.Table:
        ids, n, component, side = (table.column(c).to_numpy() for c in ("id", "n", "component", "side"))
        sketches = table.column("sketch").to_pylist()
        same = {}  # sketches by width, for folding a wide one to a narrow one's width
        for i, x in enumerate(sketches):
            same.setdefault(len(x) // 8, []).append(i)
        wide = {w: np.stack([np.frombuffer(sketches[i], U64) for i in rows]) for w, rows in same.items()}
        out = [(np.zeros(0, np.int64),) * 4]
        for w, rows in same.items():
            rows = np.array(rows)
            for v, others in same.items():
                if v > w:
                    continue
                others, mine = np.array(others), wide[w]
                while mine.shape[1] > v:
                    mine = mine[:, : mine.shape[1] // 2] ^ mine[:, mine.shape[1] // 2 :]
                for k, i in enumerate(rows):
                    j = others[(component[others] != component[i]) & ((ids[others] < ids[i]) | (v < w)) & ((side[others] == 3) | (side[others] != side[i]))]
                    lo, hi = np.minimum(n[j], n[i]), np.maximum(n[j], n[i])
                    j = j[lo * th.den >= hi * th.num]
                    at = np.searchsorted(others, j)
                    far = np.bitwise_count(wide[v][at] ^ mine[k]).sum(axis=1)
                    j = j[far <= th.difference(n[j], n[i])]
                    if len(j):
                        first = ids[j] < ids[i]
                        out.append((np.where(first, ids[j], ids[i]), np.where(first, ids[i], ids[j]), np.where(first, n[j], n[i]), np.where(first, n[i], n[j])))
        return pa.table(dict(zip(("a", "b", "na", "nb"), (pa.array(np.concatenate(c)).cast(t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)), strict=True)))

    return run


def _tiled(open_: DataFrame, heads: DataFrame, th: Threshold) -> DataFrame:
    """Pairs of different components in large buckets that pass the size and Hamming bounds, compared in tiles of bounded size.

    A bucket is dealt into T parts of about ``TILE`` members and each pair of parts is one tile, so no task holds more than two parts and
    only the pairs that pass leave it as rows.
    """
    parts = open_.join(heads.select("id", "sketch"), "id").withColumn("t", F.ceil(F.col("members") / TILE).cast("int"))
    parts = parts.withColumn("s", F.pmod(F.xxhash64("id", F.lit(17)), F.col("t")).cast("int"))
    parts = parts.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    # a tile of two parts compares across them (sides 1 and 2); a tile of one part compares all its members (side 3)
    parts = parts.select("key", "id", "n", "component", "sketch", F.least("s", "o").alias("p"), F.greatest("s", "o").alias("q"), F.when(F.col("s") == F.col("o"), 3).when(F.col("s") < F.col("o"), 1).otherwise(2).alias("side"))
    return parts.groupBy("key", "p", "q").applyInArrow(_tile(th), "a long, b long, na int, nb int")


def similarity_links(docs: DataFrame, k: int = 5, threshold: Threshold = Threshold(), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Links between distinct shingle sets, and membership.

    Returns (links, members). ``links`` (a, b, n_both, n_either) connect representatives a < b of unequal sets that are similar; they hold
    every link that is needed to connect each component. ``members`` (id, representative, n_shingles, component) has one row per distinct
    non-null id. Null, empty and word-less texts have no shingles: they are their own representative and component.
    """
    scratch = Scratch(docs.sparkSession, "parity")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    sketched = scratch.put(rows.mapInArrow(_sketches(k, threshold), "id long, n_shingles long, fp1 long, fp2 long, block_keys array<long>, sketch binary"), "sketches")
    equal = ["n_shingles", "fp1", "fp2"]
    groups = sketched.where("n_shingles > 0").groupBy(*equal).agg(F.min("id").alias("representative"), F.count(F.lit(1)).alias("copies"))
    groups = scratch.put(groups.where("copies > 1"), "groups")
    hot = groups.where(F.col("copies") > hot_rows(sketched.count()))
    members = scratch.put(join_hot(sketched.select("id", *equal), groups.drop("copies"), equal, hot).groupBy("id").agg(F.min("n_shingles").alias("n_shingles"), F.min(F.coalesce("representative", "id")).alias("representative")), "members")
    reps = members.where("id = representative and n_shingles > 0").select("id")
    heads = scratch.put(sketched.join(reps, "id", "left_semi").dropDuplicates(["id"]).select("id", "n_shingles", "block_keys", "sketch"), "heads")
    keyed = heads.select("id", F.col("n_shingles").cast("int").alias("n"), F.explode("block_keys").alias("key"))
    leaders = keyed.groupBy("key").agg(F.min("id").alias("leader"), F.min_by("n", "id").alias("nl"), F.max("id").alias("last")).where("leader < last").select("key", "leader", "nl")
    buckets = scratch.put(keyed.join(leaders, "key").select("key", "id", "n", "leader", "nl"), "buckets")
    fits = f"least(na, nb) * {threshold.den} >= greatest(na, nb) * {threshold.num}"

    def verify(pairs: DataFrame, name: str) -> DataFrame:
        side = lambda x: heads.select(F.col("id").alias(x), F.col("sketch").alias(f"s{x}"))
        near = scratch.put(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_near(threshold), "a long, b long"), f"{name}-near")
        wanted = near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id")))
        sets = scratch.put(semi_join(rows, wanted, "id").mapInArrow(_sets(k), "id long, shingles binary").dropDuplicates(["id"]), f"{name}-sets")
        left, right = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"p{x}")) for x in "ab")
        return scratch.put(near.join(left, "a").join(right, "b").mapInArrow(_verified(threshold), "a long, b long, n_both long, n_either long"), f"{name}-links")

    star = buckets.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b"), F.col("nl").alias("na"), F.col("n").alias("nb")).where(fits).distinct()
    links = verify(star, "star")
    labels = connected_components(links, "parity-star")
    open_ = buckets.join(labels, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
    mixed = open_.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("members")).where("lo < hi").select("key", "members")
    open_ = scratch.put(open_.join(mixed, "key"), "open")
    small = open_.where(f"members <= {SMALL_BUCKET}")
    x, y = small.alias("x"), small.alias("y")
    cross = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component")) & F.expr(f"least(x.n, y.n) * {threshold.den} >= greatest(x.n, y.n) * {threshold.num}"))
    cross = cross.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).unionByName(_tiled(open_.where(f"members > {SMALL_BUCKET}"), heads, threshold)).distinct()
    cross = cross.join(links.select("a", "b"), ["a", "b"], "left_anti")
    links = materialize(links.unionByName(verify(cross, "cross")), "parity-links")
    labels = connected_components(links, "parity")
    joined = join_hot(members, labels.withColumnRenamed("id", "representative"), ["representative"], hot)
    joined = materialize(joined.select("id", "representative", "n_shingles", F.coalesce("component", "representative").alias("component")), "parity-components")
    scratch.close()
    return links, joined


def jaccard_components(docs: DataFrame, k: int = 5, threshold: Threshold = Threshold(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, representative_id, n_links): one row per distinct non-null id.

    ``component_id`` is the smallest id that is reachable by links, the id itself included; ``representative_id`` is the smallest id with
    the same shingle set; ``n_links`` counts the verified links of that set that were needed. Other columns of ``docs`` are ignored.
    An empty table gives an empty result.
    """
    links, members = similarity_links(docs, k, threshold, id_col, text_col)
    ends = links.select(F.col("a").alias("representative")).union(links.select(F.col("b").alias("representative"))).groupBy("representative").agg(F.count(F.lit(1)).alias("n_links"))
    out = members.join(ends, "representative", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), F.col("representative").alias("representative_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, threshold: Threshold = Threshold(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are not the first of their component, by id and then by a hash of id and text. Ids may repeat: rows of one id
    with different texts are documents of their own, equal rows stay or go together. Rows with a null id or without words stay and make
    nothing else go. Columns of any names stay as they are; an empty table gives an empty result."""
    row, gone = unused(docs, "row", "gone")
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias(row), F.col(text_col).alias("text"))
    found = jaccard_components(rows.select(row, "text"), k, threshold, row).select(row, "component_id")
    placed = materialize(found.join(rows.select("id", row).distinct(), row), "parity-rows")
    firsts = placed.groupBy("component_id").agg(F.min(F.struct("id", row)).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id", F.col(f"first.{row}").alias("first"))
    lost = placed.join(firsts, "component_id").where(F.col(row) != F.col("first")).select(F.col(row).alias(gone))
    return docs.join(lost, F.when(F.col(id_col).isNotNull(), row_key(id_col, text_col)) == F.col(gone), "left_anti")
