"""Spelling variant grouping by permuterm rotations (operator 13).

A word is marked with a terminator ``$`` and turned so that every place comes to the end once. The rotation ``s$pc`` of the word ``pcs`` stands
under its prefix ``s$p``, which skips the character ``c``: all words that differ only by what stands there, the word ``ps`` without it
included, have that prefix and nothing else has. So after sorting by prefix a scan over neighbouring rows finds every replacement and every
insertion or deletion, and a group has one row for each letter of the alphabet at most, however many words there are. Pairs that differ
by one letter of a run of equal letters (``helo``, ``hello``) would meet once for each of them; only the first one counts.

The corpus is only read to count words, with a table of bounded size in each task before the shuffle; everything after that is as large as
the vocabulary. Rotations are range-partitioned and sorted by Spark, and no task holds more than an Arrow batch.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import Scratch, stored

#: Entries of a task's word table before it is given out, and bytes of a piece of text.
TABLE_WORDS = 200_000
PIECE_BYTES = 2_000_000
END = "$"
# bytes of A-Z in lower case and of U+00C0 to U+00FF
_RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
_CUT = re.compile(rb"[\x00-\x60\x7b-\x7f]")


def _pieces(text: bytes):
    """``text`` cut after characters that are in no word."""
    at = 0
    while len(text) - at > PIECE_BYTES and (cut := _CUT.search(text, at + PIECE_BYTES)):
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


def spoiled(run: bytes, h: int) -> bytes:
    """``run`` without its code point number ``h`` modulo its length."""
    letters = run.decode()
    i = h % len(letters)
    return (letters[:i] + letters[i + 1 :]).encode()


def _counted(spoil: int | None, least_chars: int):
    def run(batches):
        table: Counter[bytes] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array([w.decode() for w in table], pa.string()), pa.array(table.values(), pa.int64())], names=["word", "n"])
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                if not text.is_valid:
                    continue
                seed = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for piece in _pieces(text.as_py().lower()):  # bytes: A-Z only
                    for word, n in Counter(_RUN.findall(piece)).items():
                        if spoil and (h := crc32(word, seed)) % spoil == 0:
                            word = spoiled(word, h)
                        if len(word) - word.count(b"\xc3") >= least_chars:
                            table[word] += n
                    if len(table) > TABLE_WORDS:
                        yield out()
                        table.clear()
        yield out()

    return run


def count_words(docs: DataFrame, spoil: int | None = None, least_chars: int = 6, least_count: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of the letters A-Z, a-z and U+00C0 to U+00FF, with only A-Z in lower case, of ``least_chars`` code points or more and with
    ``least_count`` occurrences or more in all texts. With ``spoil`` a run loses one code point where that number divides the crc32 of its
    document's id, a colon and itself (so errors can be planted whose right form is known). Null texts have no words, a null id is written as
    nothing, repeated rows count each time, and a long text is read in pieces.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    counts = rows.mapInArrow(_counted(spoil, least_chars), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, letter, n, first): every rotation of each word under its prefix without its last letter and, with a null letter, under itself.
    ``first`` is false where the letter repeats the one before it."""
    w, i = F.col("word"), F.col("i")
    at = words.select("word", "n", F.length("word").alias("size")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("size"))))
    head, tail = F.substring(w, F.lit(1), i), F.substring(w, i + 1, F.col("size"))
    skip = F.when(i < F.col("size"), F.struct(F.concat(F.substring(w, i + 2, F.col("size")), F.lit(END), head).alias("prefix"), F.substring(w, i + 1, F.lit(1)).alias("letter")))
    whole = F.struct(F.concat(tail, F.lit(END), head).alias("prefix"), F.lit(None).cast("string").alias("letter"))
    both = at.select("word", "i", "n", F.explode(F.array(skip, whole)).alias("r")).where("r is not null")
    first = (i == 0) | F.col("r.letter").isNull() | (F.col("r.letter") != F.substring(w, i, F.lit(1)))
    return both.select("r.prefix", "r.letter", "n", first.alias("first"))


def _neighbours(prefix: str, members: list[tuple[str | None, int, bool]]):
    """(word, near words, (-n, word) of the best one) of each member of a group that has any."""
    tail, head = prefix.split(END)
    named = [(head + (c or "") + tail, c is None, n, first) for c, n, first in members]
    for word, whole, _, first in named:
        near = [(-m, other) for other, bare, m, f in named if other != word and (f if whole else not bare or first)]
        if near:
            yield word, len(near), *min(near)


def _scan(batches):
    """Groups of equal prefixes of a sorted partition; a group may go on in the next batch."""
    open_: list = []
    prefix = None

    def flush(rows):
        if len(open_) > 1:
            rows.extend(_neighbours(prefix, open_))
        open_.clear()

    def out(rows):
        cols = zip(*rows, strict=True) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "near", "minus_n", "other"])

    for batch in batches:
        keys, rows = batch.column(0), []
        if not len(keys):
            continue
        new = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False).nonzero()[0] + 1
        starts = [0, *new.tolist(), len(keys)]
        for a, b in zip(starts, starts[1:], strict=False):
            if a or (name := keys[0].as_py()) != prefix:
                flush(rows)
                prefix = keys[a].as_py() if b - a > 1 or b == len(keys) else None
            if prefix is not None:  # a group of one row inside a batch has no neighbours
                part = batch.slice(a, b - a)
                open_ += zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)
        yield out(rows)
    rows = []
    flush(rows)
    yield out(rows)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of the words that have near words: how many, and the one of largest n, the first in code-point order of equal ones."""
    turned = rotations(words).repartitionByRange("prefix").sortWithinPartitions("prefix")
    found = turned.mapInArrow(_scan, "word string, near long, minus_n long, other string")
    best = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("minus_n", "other")).alias("b"))
    return best.select("word", "n_near", F.col("b.other").alias("best"), (-F.col("b.minus_n")).alias("best_n"))


def variant_groups(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per row of ``words`` (word, n), whose words are distinct and have letters only.

    A word's form is its near word (one code point inserted, deleted or replaced) of largest n, the first in code-point order of equal ones, if
    that n is ``times`` the word's own or more. ``root`` follows the forms to the last; a chain grows by that factor in each step, so it is
    short, and its length halves in each round. Rows with a null word or n go. An empty table gives an empty result.
    """
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.put(words.select("word", "n").where("word is not null and n is not null"), "words")
    near = near_words(words)
    ok = F.col("best_n") >= times * F.col("n")
    joined = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(ok, F.col("best")).alias("form"), F.when(ok, F.col("best_n")).alias("form_n"))
    joined = scratch.put(joined, "forms")
    up = scratch.put(joined.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        step = up.join(up.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        step = scratch.put(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        up = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            break
    out = joined.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    out = stored(out, "spelling-variants")
    scratch.close()
    return out
