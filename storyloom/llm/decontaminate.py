"""Benchmark decontamination by greedy string tiling (operator 10).

Texts and benchmark items are compared as words (lower case, no punctuation). Runs of ``min_match`` words of an item are its seeds. A fixed-size
bit filter of all seeds lets each text emit only its possible seeds, which are then joined exactly; a text and an item that share too few
seeds to reach the coverage are dropped by a bound. For the rest, running Karp-Rabin matching repeatedly marks the longest match that does not
overlap an earlier one, so passages that were cut up and put in another order still count, and the share of the item's words under the
tiles decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize, semi_join, unused
from .textops import LOWER, U64, Words, as_long, chunks, mix64

#: Bits of the seed filter: 4 MB however many items there are; a full filter only lets more possible seeds through to the exact join.
FILTER_BITS = 25

_PLAIN = LOWER.copy()
for _c in range(33, 127):
    if not chr(_c).isalnum():
        _PLAIN[_c] = 32


@dataclass(frozen=True)
class TilingRule:
    """Least words of a tile, and the percentage of an item's words under tiles from which the text is contaminated."""

    min_match: int = 5
    coverage_percent: int = 60


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``size`` word hashes, from one running sum."""
    if len(h) < size:
        return np.zeros(0, U64)
    base = 0x9E3779B97F4A7C15
    up = np.cumprod(np.append(U64(1), np.full(len(h), base, dtype=U64)), dtype=U64)
    down = np.cumprod(np.append(U64(1), np.full(len(h), pow(base, -1, 1 << 64), dtype=U64)), dtype=U64)
    sums = np.append(U64(0), np.cumsum(h * up[:-1], dtype=U64))
    return mix64((sums[size:] - sums[:-size]) * down[: len(h) - size + 1])


def tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(item position, text position, length) of the greedy tiling of two arrays of word hashes, longest tiles first in each pass."""
    free_i, free_t, out = np.ones(len(item), bool), np.ones(len(text), bool), []
    size = max(least, min(len(item), 20))

    def scan(size: int) -> list[tuple[int, int, int]]:
        hi, ht = window_hashes(item, size), window_hashes(text, size)
        whole = lambda free, n: np.convolve(free, np.ones(size, int), "valid") == size if n else np.zeros(0, bool)
        ok_i = np.flatnonzero(whole(free_i, len(hi)))
        ok_t = np.flatnonzero(whole(free_t, len(ht)) & np.isin(ht, hi[ok_i]))
        places: dict[int, list[int]] = {}
        for t in ok_t.tolist():
            places.setdefault(int(ht[t]), []).append(t)
        found, reached = [], {}
        for i in ok_i.tolist():
            for t in places.get(int(hi[i]), ()):
                if reached.get(t - i, -1) > i:
                    continue  # inside a match on the same diagonal
                n = size
                while i + n < len(item) and t + n < len(text) and free_i[i + n] and free_t[t + n] and item[i + n] == text[t + n]:
                    n += 1
                found.append((n, i, t))
                reached[t - i] = i + n
        return found

    while True:
        found = scan(size)
        longest = max((n for n, _, _ in found), default=0)
        if longest > 2 * size:
            size = longest
            continue
        again = False
        for n, i, t in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if free_i[i : i + n].all() and free_t[t : t + n].all():
                free_i[i : i + n] = free_t[t : t + n] = False
                out.append((i, t, n))
            else:
                again = True  # what is left of it is looked for again
        if again:
            continue
        if size == least:
            return out
        size = max(least, size // 2) if size > 2 * least else least


def _seeds(rule: TilingRule, bits: np.ndarray | None):
    """Distinct (id, fp, seed) of texts and how often the text has it; with ``bits`` only those that the filter lets through."""

    def run(batches):
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column(1)):
                words = Words(_PLAIN[data], offsets, lower=False)
                with np.errstate(over="ignore"):
                    seed = window_hashes(words.hashes(), rule.min_match)
                text = words.text[: len(seed)]
                keep = text == words.text[rule.min_match - 1 :][: len(seed)] if len(seed) else np.zeros(0, bool)
                if bits is not None:
                    at = seed >> U64(64 - FILTER_BITS)
                    keep &= (bits.value[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) == 1
                text, seed = text[keep], seed[keep]
                order = np.lexsort((seed, text))
                text, seed = text[order], seed[order]
                new = np.ones(len(seed), bool)
                new[1:] = (seed[1:] != seed[:-1]) | (text[1:] != text[:-1])
                ids, prints = (batch.column(i)[first:last].take(pa.array(text[new])) for i in (0, 2))
                n = words.n_words[text[new]].astype(np.int64)
                times = np.diff(np.append(np.flatnonzero(new), len(seed)))
                yield pa.RecordBatch.from_arrays([ids, prints, pa.array(as_long(seed[new])), pa.array(n), pa.array(times.astype(np.int64))], names=["id", "fp", "seed", "n_words", "times"])

    return run


def _tiled(rule: TilingRule):
    def hashes(texts):
        _, _, data, offsets = next(chunks(pa.array(texts, pa.string()), 1 << 62))
        with np.errstate(over="ignore"):
            w = Words(_PLAIN[data], offsets, lower=False)
            h = w.hashes()
        cut = np.searchsorted(w.text, np.arange(len(texts) + 1))
        return [h[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def run(batches):
        np.seterr(over="ignore")
        for batch in batches:
            rows = []
            for doc_id, fp, text, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc, *each = hashes([text, *(x["text"] for x in items)])
                for x, item in zip(items, each, strict=True):
                    found = tiles(item, doc, rule.min_match)
                    rows.append((doc_id, fp, x["item"], len(item), sum(n for _, _, n in found), len(found)))
            cols = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=["id", "fp", "item", "item_words", "covered_words", "n_tiles"])

    return run


def tiled_matches(docs: DataFrame, benchmark: DataFrame, rule: TilingRule = TilingRule(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, fp, item, item_words, covered_words, n_tiles) for every text and item that could reach the coverage; ``fp`` is a hash of the text, so
    rows of one id with different texts are told apart."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null").withColumn("fp", F.xxhash64("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("item is not null and text is not null").dropDuplicates(["item"]).withColumn("fp", F.lit(0).cast("long"))
    seeds = materialize(items.mapInArrow(_seeds(rule, None), "id long, fp long, seed long, n_words long, times long").select(F.col("id").alias("item"), "seed", "n_words", "times"), "item-seeds")
    place = F.shiftrightunsigned("seed", 64 - FILTER_BITS)
    words = seeds.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - FILTER_BITS}) & 63 as int))")).alias("b")).collect()
    bits = np.zeros(1 << (FILTER_BITS - 6), dtype=U64)
    for r in words:  # at most 2**19 words
        bits[r["w"]] = np.int64(r["b"]).astype(U64)
    shared = spark.sparkContext.broadcast(bits)
    hits = rows.mapInArrow(_seeds(rule, shared), "id long, fp long, seed long, n_words long, times long").select("id", "fp", "seed")
    # a shared seed counts as often as the item has it: tiles may cover all its places
    enough = f"n_shared * {rule.min_match} * 100 >= {rule.coverage_percent} * n_words"
    pairs = hits.join(seeds, "seed").groupBy("id", "fp", "item").agg(F.sum("times").alias("n_shared"), F.first("n_words").alias("n_words")).where(enough)
    pairs = materialize(pairs.select("id", "fp", "item"), "tiling-pairs")
    listed = pairs.join(items.drop("fp"), "item").groupBy("id", "fp").agg(F.collect_list(F.struct("item", "text")).alias("items"))
    wanted = semi_join(rows, pairs, "id").dropDuplicates(["id", "fp"]).join(listed, ["id", "fp"]).select("id", "fp", "text", "items")
    return wanted.mapInArrow(_tiled(rule), "id long, fp long, item long, item_words long, covered_words long, n_tiles long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, rule: TilingRule = TilingRule(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, contaminated, coverage_percent, item_ids): one row per row of ``docs``.

    ``item_ids`` are the covered items, sorted; ``coverage_percent`` is the largest coverage among the compared items (0 if none). Null and
    empty texts and rows with a null id are clean; items of fewer than ``min_match`` words or with a null id or text are not searched. Ids may
    repeat: each row is judged by its own text. A task holds one text and the items that it shares seeds with.
    """
    found = tiled_matches(docs, benchmark, rule, id_col, text_col, item_col, item_text_col)
    reached = F.col("covered_words") * 100 >= rule.coverage_percent * F.col("item_words")
    key, fp, share, items = unused(docs.select(id_col), "id", "fp", "share", "items")
    ids = docs.select(id_col, F.xxhash64(F.col(text_col).cast("string")).alias(f"{fp}_own"))
    per = found.groupBy(F.col("id").alias(key), F.col("fp").alias(fp)).agg(F.max(100.0 * F.col("covered_words") / F.col("item_words")).alias(share), F.sort_array(F.collect_set(F.when(reached, F.col("item")))).alias(items))
    per = materialize(per, "tiling-found")
    out = ids.join(per, (ids[id_col].cast("long") == F.col(key)) & (F.col(f"{fp}_own") == F.col(fp)), "left")
    return out.select(id_col, F.coalesce(F.size(items) > 0, F.lit(False)).alias("contaminated"), F.coalesce(share, F.lit(0.0)).alias("coverage_percent"), F.coalesce(items, F.array().cast("array<bigint>")).alias("item_ids"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rule: TilingRule = TilingRule(), id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that are contaminated; columns of any names stay as they are. Ids may repeat: each row is judged by its own text."""
    key, fp = unused(docs, "gone", "fp")
    found = tiled_matches(docs, benchmark, rule, id_col).where(F.col("covered_words") * 100 >= rule.coverage_percent * F.col("item_words"))
    gone = materialize(found.select(F.col("id").alias(key), F.col("fp").alias(fp)).distinct(), "contaminated")
    return docs.join(gone, (docs[id_col].cast("long") == F.col(key)) & (F.xxhash64(docs["text"].cast("string")) == F.col(fp)), "left_anti")
