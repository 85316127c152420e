"""Chat formatting with offset-aligned loss masks (operator 7).

A conversation's turns are rendered into one string, encoded once with character offsets, and the sorted spans of its turns are intersected
with the token spans by binary search. The template's control strings are added tokens, so no token straddles the edge of a turn. Inside
texts and role names each control string gets an escape after its first character, and the escape itself is doubled, so the output can be
parsed back into exactly the turns that went in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Opening and closing control strings by role; other roles are named between ``[ROLE]`` and ``[TEXT]``."""

    begin: str = "<s>"
    roles: dict = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("[ANS]", "</s>")})
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    loss_roles: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> list[str]:
        return sorted({self.begin, *(c for pair in self.roles.values() for c in pair), *self.other}, key=lambda x: (-len(x), x))


def escape(text: str, controls: list[str]) -> str:
    text = text.replace(ESCAPE, ESCAPE * 2)
    for c in controls:
        if c in text:
            text = text.replace(c, c[0] + ESCAPE + c[1:])
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if ESCAPE in text else text


def render(turns: list[tuple[str | None, str | None]], t: Template) -> tuple[str, list[tuple[int, int, str]]]:
    """The formatted string and, for each turn, the span of its text and its role."""
    controls, parts, spans, at = t.controls, [t.begin], [], len(t.begin)
    for role, text in turns:
        role, text = role or "", escape(text or "", controls)
        opening, closing = t.roles.get(role) or (t.other[0] + escape(role, controls) + t.other[1], t.other[2])
        parts += (opening, text, closing)
        spans.append((at + len(opening), at + len(opening) + len(text), role))
        at += len(opening) + len(text) + len(closing)
    return "".join(parts), spans


def parse(formatted: str, t: Template) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted string; the inverse of ``render`` (null roles and texts come back empty)."""
    if not formatted.startswith(t.begin):
        raise ValueError("not a formatted conversation")
    opening = {a: (role, b) for role, (a, b) in t.roles.items()}
    pieces = re.split("(" + "|".join(map(re.escape, t.controls)) + ")", formatted[len(t.begin) :])
    turns, i = [], 1
    while i < len(pieces):
        if pieces[i] in opening:
            role, closing = opening[pieces[i]]
            step = 4
        else:
            role, closing = unescape(pieces[i + 1]), t.other[2]
            if pieces[i] != t.other[0] or pieces[i + 2] != t.other[1]:
                raise ValueError(f"unexpected {pieces[i]}")
            step = 6
        if pieces[i - 1] or pieces[i + step - 2] != closing:
            raise ValueError(f"unclosed {pieces[i]}")
        turns.append((role, unescape(pieces[i + step - 3])))
        i += step
    if pieces[-1]:
        raise ValueError("text after the last turn")
    return turns


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int, str]], t: Template) -> np.ndarray:
    """Which tokens lie in a span of a loss role. Both lists are sorted, so each span's tokens are a range found by binary search."""
    mask = np.zeros(len(offsets), dtype=bool)
    for lo, hi, role in spans:
        if role in t.loss_roles and hi > lo:
            mask[np.searchsorted(offsets[:, 1], lo, side="right") : np.searchsorted(offsets[:, 0], hi, side="left")] = True
    return mask


def masked_text(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> str:
    """All text under the mask, unescaped: the masked tokens' spans, joined where they touch or share a character."""
    out, lo, hi = [], 0, 0
    for a, b in offsets[mask]:
        if a > hi:
            out.append(unescape(formatted[lo:hi]))
            lo = a
        hi = max(hi, b)
    out.append(unescape(formatted[lo:hi]))
    return "".join(out)


_LOADED: dict = {}


def _tokenizer(path: str, t: Template):
    key = (path, tuple(t.controls))
    if key not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer

        _LOADED[key] = Tokenizer.from_file(path)
        _LOADED[key].add_special_tokens([AddedToken(c, normalized=False) for c in t.controls])
    return _LOADED[key]


def _formatted(path: str, t: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path, t)
        for batch in batches:
            ids = batch.column(0)
            for first in range(0, batch.num_rows, 128):
                turns = batch.column(1)[first : first + 128].to_pylist()
                rendered = [render([(x["role"], x["text"]) for x in conv], t) for conv in turns]
                rows = []
                for (text, spans), e in zip(rendered, tok.encode_batch([r for r, _ in rendered], add_special_tokens=False), strict=True):
                    offsets = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
                    mask = loss_mask(offsets, spans, t)
                    rows.append((text, e.ids, offsets[:, 0], offsets[:, 1], mask))
                cols = list(zip(*rows, strict=True))
                types = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_())]
                yield pa.RecordBatch.from_arrays([ids[first : first + 128], *(pa.array(list(c), ty) for c, ty in zip(cols, types, strict=True))], names=["conv_id", "formatted", "ids", "starts", "ends", "loss"])

    return run


def format_conversations(turns: DataFrame, vocabulary: str, template: Template = Template()) -> DataFrame:
    """(conv_id, formatted, ids, starts, ends, loss): one row per conversation, token arrays aligned; ``loss`` marks the trained tokens.

    Turns are ordered by turn, role and text, nulls first; repeated rows are all kept, null roles and texts are empty, and rows with a null
    conv_id form one conversation. A conversation is one training example and so one row: it must fit in a task, any number of
    conversations need not. Other columns are ignored.
    """
    part = F.struct("turn", "role", "text")
    grouped = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    grouped = grouped.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(part)).alias("turns"))
    return grouped.mapInArrow(_formatted(vocabulary, template), "conv_id long, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>")


def digests(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """What is read back from formatted rows: turn count and digest, and length and digest of the text under the loss mask."""
    import hashlib

    def run(batches):
        for batch in batches:
            rows = []
            for text, starts, ends, loss in zip(batch.column("formatted").to_pylist(), batch.column("starts"), batch.column("ends"), batch.column("loss"), strict=True):
                turns = parse(text, template)
                offsets = np.stack([starts.values.to_numpy(), ends.values.to_numpy()], axis=1)
                trained = masked_text(text, offsets, loss.values.to_numpy(zero_copy_only=False))
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((len(turns), sha(whole), len(trained), sha(trained), len(text)))
            cols = zip(*rows, strict=True) if rows else [[]] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(list(c), ty) for c, ty in zip(cols, types, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "starts", "ends", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
