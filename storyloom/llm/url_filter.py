"""URL filters by a Bloom filter cascade (operator 11).

A key is a list's name, a host and the beginning of a path. A URL asks for the keys that could name it: each domain that its host lies in with each
beginning of its path that has the length of a listed one. All these questions of a corpus are the key universe, so a cascade can be exact on
it: the first Bloom filter holds the listed keys, the second one the universe's other keys that pass the first, the third one the
listed keys that pass the second, and so on until nothing passes wrongly. The level at which a key first fails says whether it is listed.

Building reads the universe once, through the first filter: sized for 0.7 false positives a listed key, it lets about as many keys through as the list has, and only
those are shuffled. Filters are made of blocks of bits that tasks build. The cascade takes some 1.5 + log2(universe / list) * 1.44 bits a listed key and a few more for the
later levels; it is broadcast if it takes at most ``most_bytes``, otherwise the questions are answered by a shuffled semi-join with the list.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import Scratch
from .scratch import unused
from .textops import U64, mix64

#: Bits of a block of a filter, and bytes of all filters that a task may hold.
BLOCK_BITS = 1 << 19
MOST_BYTES = 256 << 20
HOSTS = "hosts"


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: np.ndarray


def level_shape(n: int, rate: float) -> tuple[int, int]:
    """(bits, hashes) of a Bloom filter of ``n`` keys with that rate of false positives."""
    bits = max(64, math.ceil(n * math.log2(1 / rate) / math.log(2)))
    return bits, max(1, round(math.log2(1 / rate)))


def positions(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    """One row of bit places for each key, from two hashes; every level mixes them anew."""
    with np.errstate(over="ignore"):
        x, y = mix64(h1 + U64(2 * level + 1) * U64(0x9E3779B97F4A7C15)), mix64(h2 ^ U64(level)) | U64(1)
        return (x[:, None] + np.arange(hashes, dtype=U64)[None, :] * y[:, None]) % U64(bits)


def passes(h1: np.ndarray, h2: np.ndarray, number: int, level: Level) -> np.ndarray:
    at = positions(h1, h2, number, level.bits, level.hashes)
    return ((level.words[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1)).all(axis=1)


def listed(h1: np.ndarray, h2: np.ndarray, cascade: list[Level]) -> np.ndarray:
    """Whether each key is listed: the number of levels that it passes before it fails, or of all, is odd."""
    depth, open_ = np.zeros(len(h1), np.int64), np.arange(len(h1))
    for number, level in enumerate(cascade):
        open_ = open_[passes(h1[open_], h2[open_], number, level)]
        depth[open_] += 1
    return depth % 2 == 1


def _hashes(*key: Column) -> list[Column]:
    return [F.xxhash64(*key).alias("h1"), F.xxhash64(F.lit("second"), *reversed(key)).alias("h2")]


def _ones(number: int, bits: int, hashes: int):
    """(block, place) of the bits of keys, each once in a batch."""

    def run(batches):
        for batch in batches:
            h1, h2 = (batch.column(i).to_numpy().view(U64) for i in (0, 1))
            at = np.unique(positions(h1, h2, number, bits, hashes).ravel())
            yield pa.RecordBatch.from_arrays([pa.array((at // U64(BLOCK_BITS)).astype(np.int64)), pa.array((at % U64(BLOCK_BITS)).astype(np.int32))], names=["block", "place"])

    return run


def _block(table: pa.Table) -> pa.Table:
    bits = np.zeros(BLOCK_BITS, np.uint8)
    bits[table.column("place").to_numpy()] = 1
    return pa.table({"block": table.column("block")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def _level(keys: DataFrame, n: int, rate: float, number: int) -> Level:
    """The filter of ``keys`` (h1, h2): tasks make its blocks, the driver puts them together."""
    bits, hashes = level_shape(n, rate)
    blocks = keys.select("h1", "h2").mapInArrow(_ones(number, bits, hashes), "block long, place int").distinct().groupBy("block").applyInArrow(_block, "block long, bits binary")
    words = np.zeros(-(-bits // BLOCK_BITS) * BLOCK_BITS // 64, U64)
    for row in blocks.toLocalIterator():
        words[row["block"] * BLOCK_BITS // 64 :][: BLOCK_BITS // 64] = np.frombuffer(row["bits"], U64)
    return Level(bits, hashes, words)


def _passing(levels, first: int):
    """Keys that pass every level of a broadcast cascade from ``first`` on."""

    def run(batches):
        for batch in batches:
            h1, h2 = (batch.column(i).to_numpy().view(U64) for i in (0, 1))
            ok = np.ones(len(h1), bool)
            for number, level in enumerate(levels.value[first:], first):
                ok[ok] = passes(h1[ok], h2[ok], number, level)
            yield batch.filter(pa.array(ok))

    return run


def build_cascade(keys: DataFrame, universe: DataFrame, most_bytes: int = MOST_BYTES) -> list[Level] | None:
    """The cascade that tells ``keys`` (h1, h2; distinct) from all other rows of ``universe`` (h1, h2; repeated as they may be), or none if its
    filters would take more than ``most_bytes``. No key gives a cascade without levels, which lists nothing. A key is its two hashes, 128 bits."""
    spark, scratch = keys.sparkSession, Scratch(keys.sparkSession, "cascade")
    inside = scratch.put(keys.select("h1", "h2"), "listed")
    n, levels = inside.count(), []
    seen = universe.agg(F.approx_count_distinct("h1")).first()[0] if n else 0
    rate = min(0.5, n * math.sqrt(0.5) / max(seen, 1))
    members, others = inside, None
    while n:
        if sum(x.words.nbytes for x in levels) + level_shape(n, rate)[0] / 8 > most_bytes:
            scratch.close()
            return None
        levels.append(_level(members, n, rate, len(levels)))
        shared = spark.sparkContext.broadcast(levels)
        if others is None:  # the universe is read through the first level only
            others = universe.select("h1", "h2").mapInArrow(_passing(shared, 0), "h1 long, h2 long").distinct().join(inside, ["h1", "h2"], "left_anti")
            wrong = others
        else:
            # of what the level before let through wrongly, this one's own keys, those that pass it wrongly are the next one's
            wrong = others.mapInArrow(_passing(shared, len(levels) - 1), "h1 long, h2 long")
        wrong = scratch.put(wrong, f"wrong-{len(levels)}")
        others, members, rate, n = members, wrong, 0.5, wrong.count()
        shared.unpersist()
    scratch.close()
    return levels


def parsed(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; then up to ``?``, ``#`` or the end. Both are empty
    for null and for URLs without ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def domains(host: Column) -> Column:
    """The host and every domain that it lies in, the longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _asked_of(name: str, sizes: list[int], host: Column, path: Column) -> Column:
    """The keys of one list that a URL asks for."""
    beginnings = F.transform(F.filter(F.array(*(F.lit(x) for x in sizes)), lambda x: x <= F.length(path)), lambda x: F.substring(path, F.lit(1), x))
    size = lambda d, p: (-F.length(d) - F.length(p)).alias("size")
    key = lambda d, p: F.struct(F.lit(int(name == HOSTS)).alias("turn"), size(d, p), F.lit(name).alias("list"), d.alias("host"), p.alias("path"))
    return F.flatten(F.transform(domains(host), lambda d: F.transform(beginnings, lambda p: key(d, p))))


def _asked(lists: list[tuple[str, list[int]]], host: Column, path: Column) -> Column:
    """The keys that a URL asks for, in the order in which they count: rules before hosts, then the longest first."""
    return F.array_sort(F.concat(*(_asked_of(name, sizes, host, path) for name, sizes in lists)))


def _first_listed(cascade):
    """The place, from 1, of the first listed key of each array of keys (h1, h2), or null."""

    @F.arrow_udf("int")
    def first(asked: pa.Array) -> pa.Array:
        keys = asked.flatten()
        hit = listed(*(keys.field(i).to_numpy().view(U64) for i in (0, 1)), cascade.value)
        begin = np.append(0, np.cumsum(asked.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)))
        at = np.append(np.flatnonzero(hit), len(hit))
        found = at[np.searchsorted(at, begin[:-1])]
        return pa.array(found - begin[:-1] + 1, mask=found >= begin[1:]).cast(pa.int32())

    return first


def judge_urls(pages: DataFrame, rules: DataFrame, block_hosts: DataFrame | None = None, default: str = "allow", most_bytes: int = MOST_BYTES, url_col: str = "url") -> DataFrame:
    """``pages`` with q_host, q_path, q_rule (host and path of the rule, or null) and q_verdict, which replace columns of these names.

    ``rules`` (host, path, verdict): a rule fits its host and all hosts within it if the URL's path starts with the rule's. Of those that fit, the
    one with most characters of host and path counts, and of equal ones the one whose verdict comes first in the alphabet. Where none
    fits, a URL whose host is, or lies in, one of ``block_hosts`` (host) is blocked and the others get ``default``. Rules and hosts with nulls go,
    repeated ones count once. All other columns of ``pages`` stay, whatever their names. Null and malformed URLs have an empty host and
    path, which only a rule with an empty host fits.
    """
    lists = rules.where("host is not null and path is not null and verdict is not null").select(F.concat(F.lit("rule "), "verdict").alias("list"), "host", "path")
    if block_hosts is not None:
        lists = lists.unionByName(block_hosts.where("host is not null").select(F.lit(HOSTS).alias("list"), "host", F.lit("").alias("path")))
    scratch = Scratch(pages.sparkSession, "urls")
    keys = scratch.put(lists.distinct().select("list", *_hashes(F.col("list"), F.col("host"), F.col("path")), F.length("path").alias("size")), "keys")
    # one row a list; a list has at most as many lengths as its longest path has characters
    shapes = sorted((r["list"], sorted(r["sizes"])) for r in keys.groupBy("list").agg(F.collect_set("size").alias("sizes")).collect())
    host, path = parsed(F.col(url_col).cast("string"))
    q_host, q_path, asked, hashes, at = unused(pages, "host", "path", "asked", "hashes", "at")
    out = pages.withColumn(q_host, host).withColumn(q_path, path)
    found = F.struct(*(F.lit(None).cast("string").alias(c) for c in ("list", "host", "path")))
    if shapes:
        questions = lambda h, p: _asked(shapes, F.col(h), F.col(p))
        hashed = lambda c: F.transform(F.col(c), lambda q: F.struct(*_hashes(q["list"], q["host"], q["path"])))
        urls = out.select(q_host, q_path)
        universe = urls.select(questions(q_host, q_path).alias(asked)).select(F.explode(hashed(asked)).alias("q")).select("q.*")
        cascade = build_cascade(keys.select("h1", "h2"), universe, most_bytes)
        if cascade is not None:
            first = _first_listed(pages.sparkSession.sparkContext.broadcast(cascade))
            out = out.withColumn(asked, questions(q_host, q_path)).withColumn(at, first(hashed(asked)))
            found = F.get(asked, F.col(at) - 1)
        else:
            each = urls.distinct().select(q_host, q_path, F.explode(questions(q_host, q_path)).alias(asked))
            each = each.select(q_host, q_path, asked, *_hashes(F.col(asked)["list"], F.col(asked)["host"], F.col(asked)["path"])).join(keys.select("h1", "h2"), ["h1", "h2"], "left_semi")
            out = out.join(each.groupBy(q_host, q_path).agg(F.min(asked).alias(asked)), [q_host, q_path], "left")
            found = F.col(asked)
    rule = F.startswith(found["list"], F.lit("rule "))
    verdict = F.when(rule, F.substring(found["list"], 6, 1 << 30)).when(found["list"] == HOSTS, F.lit("block")).otherwise(F.lit(default))
    added = {"q_host": F.col(q_host), "q_path": F.col(q_path), "q_rule": F.when(rule, F.concat(found["host"], found["path"])), "q_verdict": verdict}
    keep = [c for c in pages.columns if c.lower() not in added]
    out = out.select(*(F.col(f"`{c}`") for c in keep), *(v.alias(k) for k, v in added.items()))
    if not shapes or cascade is not None:  # otherwise the result still reads the keys
        scratch.close()
    return out
