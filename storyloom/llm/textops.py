"""Vectorised word hashing over Arrow string columns (runs inside Spark tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 2_000_000


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection on 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


class _Powers:
    """Powers of the base and of its inverse, grown on demand and kept per worker."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES + 1024)
            with np.errstate(over="ignore"):
                steps = np.full(size, _BASE, dtype=U64)
                steps[0] = 1
                self.up = np.cumprod(steps, dtype=U64)
                steps[1:] = pow(_BASE, -1, 1 << 64)
                self.down = np.cumprod(steps, dtype=U64)
        return self.up, self.down


POWERS = _Powers()


class Words:
    """The words of several texts: byte spans, the text each word is in, and the running hash of the bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, space: np.ndarray = SPACE):
        n = len(data)
        self.n_texts = len(offsets) - 1
        self.raw = data
        self.data = LOWER[data] if lower else data
        space = space[data]
        before = np.ones(n, dtype=bool)
        before[1:] = space[:-1]
        after = np.ones(n, dtype=bool)
        after[:-1] = space[1:]
        edges = offsets[1:-1]
        before[edges[edges < n]] = True
        after[edges[edges > 0] - 1] = True
        self.start = np.flatnonzero(~space & before)
        self.end = np.flatnonzero(~space & after) + 1
        self.text = np.searchsorted(offsets[1:], self.start, side="right")
        self.n_words = np.bincount(self.text, minlength=self.n_texts)
        self._sums: np.ndarray | None = None

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes in [start, end), equal for equal bytes wherever they stand."""
        up, down = POWERS.upto(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, dtype=U64)
            np.cumsum(_BYTE[self.data] * up[: len(self.data)], dtype=U64, out=self._sums[1:])
        return mix64((self._sums[end] - self._sums[start]) * down[start] + (end - start).astype(U64))

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)


def chunks(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of pieces of at most ``chunk_bytes``, or of one longer text. Null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + chunk_bytes, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last, data[offsets[first] : offsets[last]], (offsets[first : last + 1] - offsets[first]).astype(np.int64)
        first = last


def distinct_shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct k-word shingles, sorted by both; a text of 1 to k-1 words gives its whole sequence."""
    h = words.hashes()
    n = len(h)
    odd = mix64(np.arange(1, k + 1, dtype=U64)) | U64(1)
    if n >= k:
        s = np.zeros(n - k + 1, dtype=U64)
        for i in range(k):
            s += h[i : n - k + 1 + i] * odd[i]
        inside = words.text[: n - k + 1] == words.text[k - 1 :]
        text, s = words.text[: n - k + 1][inside], mix64(s[inside])
    else:
        text, s = np.zeros(0, np.int64), np.zeros(0, U64)
    few = np.flatnonzero((words.n_words > 0) & (words.n_words < k))
    if len(few):
        at = np.searchsorted(words.text, few)
        whole = np.zeros(len(few), dtype=U64)
        for i in range(k - 1):
            has = words.n_words[few] > i
            whole[has] += h[at[has] + i] * odd[i]
        text = np.concatenate([text, few])
        s = np.concatenate([s, mix64(whole ^ (U64(0xA5A5) + words.n_words[few].astype(U64)))])
    order = np.lexsort((s, text))
    text, s = text[order], s[order]
    if len(s):
        new = np.ones(len(s), dtype=bool)
        new[1:] = (s[1:] != s[:-1]) | (text[1:] != text[:-1])
        text, s = text[new], s[new]
    return text, s


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    new = np.ones(len(sorted_keys), dtype=bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.flatnonzero(new)


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
