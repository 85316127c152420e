"""Interpolated modified Kneser-Ney bigram model (operator 6): counted in Spark, kept as sorted hash arrays, memory-mapped for scoring.

* Counting: a task turns texts into 64-bit word hashes, folds equal (context, word) pairs and emits one packed block per hash range. Ranges
  are shuffled and merged, so counts move as arrays, a frequent pair is one entry per task, and no task sees more than its range.
* The merged range is written as sorted arrays of pair keys and counts, and of contexts with their totals; every pair also adds one to the
  continuation count of its word, which is merged the same way over ranges of the word.
* Scoring maps the arrays; a chunk of texts looks its distinct keys up in sorted order.

The files lie in a shared folder that every machine sees (a mount where Spark's own shared folder is not a plain path). They are written under
another name and renamed, and hold the same bytes whoever writes them, so a repeated task does no harm. Keys are 64-bit hashes; a pair's key
begins with 20 bits of its context, which keeps the ranges of contexts whole.
"""

from __future__ import annotations

import math
import os
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import local_path, new_path
from .textops import U64, Words, chunks, mix64, runs

BEGIN, END = U64(0x0B0B0B0B12345678), U64(0x9E9E9E9E87654321)
_TOP = U64(((1 << 20) - 1) << 44)
FLUSH_TOKENS = 1_500_000


def pair_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return (context & _TOP) | (mix64(context * U64(0x9FB21C651E98DF25) + word) >> U64(20))


def token_stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, context, word) of every token: the lower-cased words of each text, then one end."""
    words = Words(data, offsets)
    n = words.n_words
    last = np.cumsum(n + 1) - 1
    word = np.empty(int((n + 1).sum()), dtype=U64)
    is_end = np.zeros(len(word), dtype=bool)
    is_end[last] = True
    word[is_end], word[~is_end] = END, words.hashes()
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[last - n] = BEGIN
    return np.repeat(np.arange(len(n)), n + 1), context, word


def _blocks(keys: np.ndarray, bits: int, *columns: np.ndarray):
    """A row for each range that has keys (sorted): the range and the packed columns."""
    of = (keys >> U64(64 - bits)).astype(np.int64)
    first = runs(of)
    ends = np.append(first[1:], len(of))
    packed = [pa.array([c[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()) for c in columns]
    names = ["range", *(f"c{i}" for i in range(len(columns)))]
    return pa.RecordBatch.from_arrays([pa.array(of[first].astype(np.int32)), *packed], names=names)


def _pairs(bits: int):
    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                with np.errstate(over="ignore"):
                    _, context, word = token_stream(data, offsets)
                held.append((context, word))
                size += len(word)
                if size >= FLUSH_TOKENS:
                    yield folded(held)
                    held, size = [], 0
        if held:
            yield folded(held)

    def folded(held):
        context, word = (np.concatenate(x) for x in zip(*held, strict=True))
        with np.errstate(over="ignore"):
            keys, first, count = np.unique(pair_keys(context, word), return_index=True, return_counts=True)
        return _blocks(keys, bits, context[first], word[first], count.astype("<u4"))

    return run


def _merged(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), dtype=dtype) for x in column]) if len(column) else np.zeros(0, dtype)


def _save(folder: str, name: str, **arrays: np.ndarray) -> None:
    for k, v in arrays.items():
        path = f"{folder}/{name}.{k}.npy"
        temp = f"{path}.{uuid.uuid4().hex}"
        with open(temp, "wb") as f:
            np.save(f, v)
        os.replace(temp, path)


def _pair_range(folder: str, bits: int):
    def run(table: pa.Table) -> pa.Table:
        context, word, count = (_merged(table.column(f"c{i}"), t) for i, t in enumerate(("<u8", "<u8", "<u4")))
        with np.errstate(over="ignore"):
            keys = pair_keys(context, word)
        order = np.argsort(keys, kind="stable")
        keys, context, word = keys[order], context[order], word[order]
        first = runs(keys)
        total = np.add.reduceat(count[order].astype("<u8"), first)
        keys, context, word = keys[first], context[first], word[first]
        of = table.column("range")[0].as_py()
        _save(folder, f"pair-{of}", keys=keys, count=total)
        order = np.argsort(context, kind="stable")
        first = runs(context[order])
        t = total[order]
        sums = lambda x: np.add.reduceat(x.astype("<u8"), first)
        _save(folder, f"context-{of}", keys=context[order][first], total=sums(t), n1=sums(t == 1), n2=sums(t == 2), n3=sums(t >= 3))
        order = np.argsort(word, kind="stable")
        first = runs(word[order])
        n = np.add.reduceat(total[order], first)
        return pa.Table.from_batches([_blocks(word[order][first], bits, word[order][first], n.astype("<u8"), np.diff(np.append(first, len(order))).astype("<u4"))])

    return run


def _word_range(folder: str):
    def run(table: pa.Table) -> pa.Table:
        word, count, before = (_merged(table.column(f"c{i}"), t) for i, t in enumerate(("<u8", "<u8", "<u4")))
        order = np.argsort(word, kind="stable")
        first = runs(word[order])
        count, before = np.add.reduceat(count[order], first), np.add.reduceat(before[order].astype("<u8"), first)
        of = table.column("range")[0].as_py()
        _save(folder, f"word-{of}", keys=word[order][first], count=count, before=before)
        freq = [int((before == k).sum()) for k in (1, 2, 3, 4)]
        return pa.table({"types": [len(count)], "tokens": [int(count.sum())], "pairs": [int(before.sum())], **{f"n{k}": [f] for k, f in enumerate(freq, 1)}})

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney; where a count of counts is missing, half the count instead."""
    if not (n1 and n2):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(x, 0.05), k) for k, x in enumerate(d, 1))


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the totals and discounts of both orders."""

    folder: str
    bits: int
    tokens: int
    types: int
    pairs: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_left: float  # share of the continuation mass that the discounts leave to the uniform distribution


def train(docs: DataFrame, text_col: str = "text", path: str | None = None) -> Model:
    """Count all texts of ``docs`` (null: empty) and write the arrays under ``path`` (default: a new folder in the shared one).

    Spark's number of shuffle partitions sets the number of hash ranges, so it follows the size of the data as for any shuffle.
    """
    spark = docs.sparkSession
    folder = local_path(path or new_path(spark, "kneser-ney"))
    os.makedirs(folder, exist_ok=True)
    bits = min(max(math.ceil(math.log2(int(spark.conf.get("spark.sql.shuffle.partitions")))), 3), 14)
    block = "range int, c0 binary, c1 binary, c2 binary"
    pairs = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_pairs(bits), block)
    words = pairs.groupBy("range").applyInArrow(_pair_range(folder, bits), block).groupBy("range")
    totals = words.applyInArrow(_word_range(folder), "types long, tokens long, pairs long, n1 long, n2 long, n3 long, n4 long")
    t = totals.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in totals.columns)).first()

    def frequencies(batches):
        for batch in batches:
            for of in batch.column(0).to_pylist():
                name = f"{folder}/pair-{of}.count.npy"
                count = np.load(name, mmap_mode="r") if os.path.exists(name) else np.zeros(0, "<u8")
                few = np.bincount(count[count < 5].astype(np.int64), minlength=5)
                yield pa.RecordBatch.from_pydict({f"n{k}": [int(few[k])] for k in (1, 2, 3, 4)})

    n = spark.range(1 << bits).mapInArrow(frequencies, "n1 long, n2 long, n3 long, n4 long").groupBy().sum().first()
    d = discounts(t.n1, t.n2, t.n3, t.n4)
    left = (d[0] * t.n1 + d[1] * t.n2 + d[2] * (t.types - t.n1 - t.n2)) / t.pairs if t.pairs else 1.0
    return Model(folder, bits, t.tokens, t.types, t.pairs, discounts(*n), d, left)


class Arrays:
    """The memory-mapped arrays of one table, by range."""

    def __init__(self, model: Model, name: str, columns: tuple[str, ...]):
        self.model, self.name, self.columns, self.open = model, name, columns, {}

    def _range(self, of: int):
        if of not in self.open:
            path = f"{self.model.folder}/{self.name}-{of}"
            have = os.path.exists(f"{path}.keys.npy")
            self.open[of] = [np.asarray(np.load(f"{path}.{c}.npy", mmap_mode="r")) for c in ("keys", *self.columns)] if have else None
        return self.open[of]

    def get(self, keys: np.ndarray) -> list[np.ndarray]:
        """The columns at sorted ``keys``; 0 where a key is not there."""
        out = [np.zeros(len(keys), np.float64) for _ in self.columns]
        of = (keys >> U64(64 - self.model.bits)).astype(np.int64)
        first = runs(of)
        for a, b in zip(first, np.append(first[1:], len(of)), strict=True):
            arrays = self._range(int(of[a]))
            if arrays is None:
                continue
            have, ask = arrays[0], keys[a:b]
            at = np.minimum(np.searchsorted(have, ask), len(have) - 1)
            hit = have[at] == ask
            for o, c in zip(out, arrays[1:], strict=True):
                o[a:b][hit] = c[at[hit]]
        return out


_OPEN: dict[str, tuple[Arrays, Arrays, Arrays]] = {}


def _arrays(m: Model) -> tuple[Arrays, Arrays, Arrays]:
    if m.folder not in _OPEN:
        _OPEN.clear()
        _OPEN[m.folder] = Arrays(m, "pair", ("count",)), Arrays(m, "context", ("total", "n1", "n2", "n3")), Arrays(m, "word", ("count", "before"))
    return _OPEN[m.folder]


def _discount(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(count >= 3, d[2], np.where(count >= 2, d[1], np.where(count >= 1, d[0], 0.0)))


def log_probabilities(m: Model, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10 of p(word | context), count of the word in training) for arrays of hashes."""
    pair, ctx, uni = _arrays(m)
    with np.errstate(over="ignore"):
        key = pair_keys(context, word)
    look = lambda table, keys: (lambda u, back: [x[back] for x in table.get(u)])(*np.unique(keys, return_inverse=True))
    (c,) = look(pair, key)
    total, n1, n2, n3 = look(ctx, context)
    count, before = look(uni, word)
    flat = np.maximum(before - _discount(before, m.word_discounts), 0) / max(m.pairs, 1) + m.word_left / (m.types + 1)
    d = m.pair_discounts
    seen, safe = total > 0, np.maximum(total, 1)
    p = np.where(seen, np.maximum(c - _discount(c, d), 0) / safe + (d[0] * n1 + d[1] * n2 + d[2] * n3) / safe * flat, flat)
    return np.log10(p), count


def _scored(m: Model):
    def run(batches):
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column(1)):
                with np.errstate(over="ignore"):
                    text, context, word = token_stream(data, offsets)
                log_p, count = log_probabilities(m, context, word)
                base = np.log10((count + 1) / (m.tokens + m.types + 1))
                n = last - first
                cols = [np.bincount(text, minlength=n).astype(np.int64), np.bincount(text, weights=count > 0, minlength=n).astype(np.int64), np.bincount(text, weights=base, minlength=n), np.bincount(text, weights=log_p, minlength=n)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], *map(pa.array, cols)], names=["id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, n_known, base_score, score, perplexity) for every row; a null or empty text is its end alone. No shuffle."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_scored(model), "id long, n_tokens long, n_known long, base_score double, score double")
    return out.withColumnRenamed("id", id_col).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(-1))
