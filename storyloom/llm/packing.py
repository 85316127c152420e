"""Best-fit packing planned on the histogram of lengths (operator 5).

Pieces are counted by length; there are at most ``capacity`` lengths, so the histogram is bounded however large the corpus is. Best-fit
decreasing runs over counts: it opens or fills whole classes of equally filled sequences at once and yields runs of slots, "the pieces of
length L with ranks lo to hi-1 go to sequences s, s+1, ... at offset o". Pieces then take their slots by joining on length and rank.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize
from .tokens import encoded

SALTS = 64
_OUT_ROWS = 256


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, lo, hi, first sequence, offset) runs of slots for ``histogram`` (length: count), best fit over counts.

    The open sequences are kept by free space as runs of neighbours with equal content. The tightest fit is a binary search in the free
    spaces; a run moves as a whole, and only the last one of a length is split, so the plan is bounded by the capacity alone.
    """
    spaces: list[int] = []
    open_: dict[int, list[tuple[int, int]]] = {}
    runs, n_seq = [], 0

    def put(space: int, first: int, count: int) -> None:
        if space not in open_:
            bisect.insort(spaces, space)
            open_[space] = []
        open_[space].append((first, count))

    for length in sorted((x for x in histogram if x > 0), reverse=True):
        left, rank = histogram[length], 0
        while left:
            i = bisect.bisect_left(spaces, length)
            if i == len(spaces):
                put(capacity, n_seq, -(-left // (capacity // length)))
                n_seq += -(-left // (capacity // length))
                continue
            space = spaces[i]
            first, count = open_[space].pop()
            take = min(count, left)
            if take < count:
                open_[space].append((first + take, count - take))
            elif not open_[space]:
                del open_[space]
                spaces.pop(i)
            runs.append((length, rank, rank + take, first, capacity - space))
            if space > length:
                put(space - length, first, take)
            left, rank = left - take, rank + take
    return runs


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches):
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for first, texts in encoded(batch.column(1), path):
                rows = []
                for doc_id, ids in zip(batch.column(0)[first : first + len(texts)].to_pylist(), texts, strict=True):
                    ids = np.concatenate([ids, end])
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        rows.append((doc_id, piece, start, len(part), part.tobytes()))
                    if len(rows) >= _OUT_ROWS:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["id", "piece", "start", "length", "ids"])
    return run


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids): each text's ids and the end id, cut at ``capacity`` tokens only where they are more."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_pieces(vocabulary, end_id, capacity), "id long, piece int, start long, length long, ids binary")


def pack(pieces: DataFrame, capacity: int, order: tuple[str, ...] = ("id", "piece")) -> DataFrame:
    """``pieces`` (with a ``length`` of 1 to ``capacity``) and their ``sequence_id`` and ``offset``.

    Ranks within a length are dealt over salts, so a length that a third of all pieces share is numbered in many tasks: one count per
    length and salt, at most capacity * SALTS rows, places the salts. Repeated rows each take a slot of their own. ``pieces`` should be a
    stored table, since it is read twice.
    """
    spark = pieces.sparkSession
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    counts = materialize(counts, "length-histogram")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most ``capacity`` rows
    if any(not 0 < x <= capacity for x in histogram):
        raise ValueError(f"lengths must be 1 to {capacity}")
    slots = spark.createDataFrame(plan(histogram, capacity), "length long, lo long, hi long, first long, offset long")
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    local = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order))
    ranked = salted.withColumn("_local", local).join(F.broadcast(bases), ["length", "_salt"]).withColumn("_rank", F.col("_base") + F.col("_local") - 1)
    # the plan and the bases are bounded by the capacity, not by the corpus
    placed = ranked.join(F.broadcast(slots), "length").where("_rank >= lo and _rank < hi")
    keep = [c for c in pieces.columns]
    return placed.select(*keep, (F.col("first") + F.col("_rank") - F.col("lo")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pieces, places): the stored token pieces with their ids, and for each piece its checksum, sequence and offset.

    Only the narrow columns are shuffled to find the places; null and empty texts are the end id alone.
    """
    pieces = materialize(token_pieces(docs, vocabulary, end_id, capacity, id_col, text_col), "token-pieces")
    return pieces, pack(pieces.select("id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity)


def sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, doc_ids, ids): the packed sequences; a group has at most ``capacity`` tokens. (id, piece) must be unique."""
    part = F.struct("offset", "id", "ids")
    whole = pieces.select("id", "piece", "ids").join(places.select("id", "piece", "length", "sequence_id", "offset"), ["id", "piece"])
    grouped = whole.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(part)).alias("_p"))
    joined = F.aggregate("_p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return grouped.select("sequence_id", "n_tokens", F.col("_p.id").alias("doc_ids"), joined.alias("ids"))
