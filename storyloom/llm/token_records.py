"""Token sequences as length-delimited binary records with masked checksums and an offset index (operator 2).

A shard file is a run of frames, every number little-endian:

    u64 length | u32 mask(crc32(length)) | payload | u32 mask(crc32(payload)) | 0x0A

    payload = i64 id | u8 bytes per token (2 or 4) | token ids        mask(c) = rotate_right(c, 15) + 0xa282ead8

Shards hold ascending ids and follow each other in the order of their part numbers, so a stream of all tokens is read without sorting. The
index, a Parquet table beside the shards, has the file, offset and length of every record for reads in any other order. Spark's own
writers and readers move all bytes, so any file system that Spark can use will do and a lost executor only repeats its task.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import broadcast_if_small
from .tokens import encoded

NULL_ID = -(1 << 63)
_HEAD, _SUM, _ID = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qB")
_OUT_ROWS = 256


def masked(data: bytes) -> int:
    c = crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    payload = _ID.pack(NULL_ID if doc_id is None else doc_id, width) + ids.astype("<u2" if width == 2 else "<u4").tobytes()
    head = _HEAD.pack(len(payload))
    return head + _SUM.pack(masked(head)) + payload + _SUM.pack(masked(payload))


def frames(content: memoryview, name: str = "") -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, length, id, token ids) of every record of a shard; raises where a checksum doesn't hold."""
    at = 0
    while at < len(content):
        head = bytes(content[at : at + 8])
        if len(content) < at + 12 or _SUM.unpack_from(content, at + 8)[0] != masked(head):
            raise ValueError(f"{name}: damaged length at {at}")
        size = _HEAD.unpack(head)[0]
        payload = content[at + 12 : at + 12 + size]
        if len(content) < at + 17 + size or _SUM.unpack_from(content, at + 12 + size)[0] != masked(payload):
            raise ValueError(f"{name}: damaged record at {at}")
        doc_id, width = _ID.unpack_from(payload)
        yield at, size + 17, None if doc_id == NULL_ID else doc_id, np.frombuffer(payload[9:], dtype="<u2" if width == 2 else "<u4")
        at += size + 17


def _framed(path: str, end_id: int, width: int):
    def run(batches):
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for first, texts in encoded(batch.column(1), path):
                ids = batch.column(0)[first : first + len(texts)].to_pylist()
                for i in range(0, len(texts), _OUT_ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array([frame(d, np.concatenate([t, end]), width) for d, t in zip(ids[i : i + _OUT_ROWS], texts[i : i + _OUT_ROWS], strict=True)], pa.binary())], names=["value"])

    return run


def write_records(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text (null: empty), append ``end_id``, and write shards and index under ``path``.

    One range shuffle of the texts orders the ids; rows with a null id come first, equal ids stay together. Spark's partition size sets the
    size of the shards. An empty table gives an empty index.
    """
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(vocabulary).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id")
    rows.mapInArrow(_framed(vocabulary, end_id, width), "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\n").text(f"{path}/shards")
    _scan(docs.sparkSession, path, False).write.parquet(f"{path}/index")


def _scan(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part, more = (int(x) for x in re.search(r"part-(\d+)(?:-.*-c(\d+))?", name).groups(default="0"))
                rows, start = [], 0
                view = memoryview(content.as_buffer()) if content.is_valid else memoryview(b"")
                for n, (at, size, doc_id, ids) in enumerate(frames(view, name)):
                    rows.append((name, part, more, n, doc_id, at, size, start, len(ids), ids.astype("<u4").tobytes() if with_ids else None))
                    start += len(ids)
                    if len(rows) == _OUT_ROWS:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    names = ["file", "part", "part_file", "record", "id", "offset", "length", "start_in_file", "n_tokens", "ids"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/shards").select("path", "content")
    scanned = files.mapInArrow(run, "file string, part long, part_file long, record long, id long, offset long, length long, start_in_file long, n_tokens long, ids binary")
    return scanned if with_ids else scanned.drop("ids")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids): every record in its place in the stream; ids are little-endian unsigned 32-bit integers.

    Only one total per shard meets in the window that places the shards.
    """
    totals = read_index(spark, path).groupBy("file", "part", "part_file").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part", "part_file").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return _scan(spark, path, True).join(broadcast_if_small(bases), "file").select("id", (F.col("base") + F.col("start_in_file")).alias("start"), "n_tokens", "ids")


def read_shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """(id, payload) in a pseudo-random order: records are cut out of their shards by the index, then dealt and sorted by a seeded hash."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/shards").select(F.col("path").alias("file"), "content")
    cut = read_index(spark, path).join(files, "file").selectExpr("id", "record", "file", "substring(content, cast(offset + 13 as int), cast(length - 17 as int)) as payload")
    order = F.xxhash64(F.lit(seed), "file", "record")
    return cut.select("id", "payload", order.alias("_order")).repartitionByRange("_order").sortWithinPartitions("_order").drop("_order")
