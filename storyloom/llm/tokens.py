"""Token ids by the tokenizers library, with a bounded per-worker cache of the ids of the texts' pieces.

A byte-pair encoder works on each pre-token alone, and both supported kinds of vocabulary always cut before a space that follows or
precedes a word. So texts are cut at their spaces, every distinct piece of a chunk is looked up by a 64-bit hash of its bytes, and each new
piece goes through the library once. Texts where a cut depends on its neighbours (runs of spaces, rare white space, names of special
tokens) go to the library whole. The ids are the same either way (see the tests).
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np

from .textops import SPACE, Words, chunks

CACHE_PIECES = 1_500_000
RECENT_PIECES = 120_000
_LOADED: dict[str, TextEncoder] = {}

_ONLY_SPACE = np.zeros(256, dtype=bool)
_ONLY_SPACE[32] = True
#: Bytes that can begin or end a white-space character.
_MAY_BEGIN, _MAY_END = SPACE.copy(), SPACE.copy()
_MAY_BEGIN[[28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_MAY_END[[28, 29, 30, 31]] = True
_MAY_END[128:] = True


class TextEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, normal = spec["pre_tokenizer"] or {}, [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        plain = spec["post_processor"] is None and all(x["content"].startswith("<|") for x in spec["added_tokens"])
        self.spaced = plain and spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
        self.unspaced = plain and normal == ["NFC", "Replace", "Lowercase"] and spec["model"].get("end_of_word_suffix") == "</w>"
        self.clear()

    def clear(self) -> None:
        self.index: dict[int, int] = {}  # the newest pieces; older ones are in two sorted arrays
        self.keys, self.places, self.known = np.zeros(0, np.uint64), np.zeros(0, np.int32), 0
        self.flat, self.used = np.zeros(1 << 16, dtype="<u4"), 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, hashes: list[int], pieces: list[str]) -> None:
        for h, e in zip(hashes, self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False), strict=True):
            ids, at = e.ids, self.known
            self.known += 1
            if at == len(self.start):
                self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + len(ids)] = ids
            self.start[at], self.length[at] = self.used, len(ids)
            self.used += len(ids)
            self.index[h] = at

    def _places(self, unique: np.ndarray, piece) -> np.ndarray:
        """Where the ids of the pieces with the sorted hashes ``unique`` are; ``piece(i)`` is the i-th one's text."""
        if self.known > CACHE_PIECES:
            self.clear()
        if len(self.index) > RECENT_PIECES:
            new = np.array(list(self.index.items()), dtype=object)
            keys = np.concatenate([self.keys, np.array(new[:, 0], dtype=np.uint64)])
            order = np.argsort(keys)
            self.keys, self.places = keys[order], np.concatenate([self.places, new[:, 1].astype(np.int32)])[order]
            self.index = {}
        at = np.full(len(unique), -1, dtype=np.int64)
        if len(self.keys):
            i = np.minimum(np.searchsorted(self.keys, unique), len(self.keys) - 1)
            at = np.where(self.keys[i] == unique, self.places[i], at)
        rest = np.flatnonzero(at < 0)
        keys = unique[rest].tolist()
        found = list(map(self.index.get, keys))
        missing = [j for j, x in enumerate(found) if x is None]
        for k in range(0, len(missing), 10_000):
            part = missing[k : k + 10_000]
            self._learn([keys[j] for j in part], [piece(rest[j]) for j in part])
        if len(rest):
            at[rest] = list(map(self.index.__getitem__, keys))
        return at

    def _hard(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts that are encoded whole."""
        hard = np.zeros(len(offsets) - 1, dtype=bool)
        if not (self.spaced or self.unspaced):
            return ~hard
        of = lambda at: np.searchsorted(offsets[1:], at, side="right")
        hard[of(np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)))] = True
        if self.spaced:
            at = np.flatnonzero(data == 32)
            text = of(at)
            first, last = at == offsets[text], at == offsets[text + 1] - 1
            after, before = data[np.minimum(at + 1, len(data) - 1)], data[np.maximum(at - 1, 0)]
            hard[text[last | (~last & (after == 32)) | (~first & ~last & _MAY_END[before] & _MAY_BEGIN[after]) | (first & _MAY_BEGIN[after])]] = True
        return hard

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text of a chunk, given as UTF-8 bytes and offsets."""
        hard = self._hard(data, offsets)
        text_of = lambda i: data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8")
        if hard.all():
            return [self.whole(text_of(i)) for i in range(len(hard))]
        words = Words(data, offsets, lower=self.unspaced, space=SPACE if self.unspaced else _ONLY_SPACE)
        easy = ~hard[words.text]
        start, end, text = words.start[easy], words.end[easy], words.text[easy]
        if self.spaced and len(start):
            led = (start > offsets[text]) & (data[np.maximum(start - 1, 0)] == 32)
            start = start - led
        unique, first, which = np.unique(words.span_hash(start, end), return_index=True, return_inverse=True)
        at = self._places(unique, lambda i: words.raw[start[first[i]] : end[first[i]]].tobytes().decode("utf-8"))[which]
        length = self.length[at]
        total = np.cumsum(length)
        ids = self.flat[np.repeat(self.start[at] - total + length, length) + np.arange(total[-1] if len(total) else 0)]
        cut = np.append(0, total)[np.searchsorted(text, np.arange(len(hard) + 1))]
        return [self.whole(text_of(i)) if hard[i] else ids[cut[i] : cut[i + 1]] for i in range(len(hard))]


def encoder(path: str) -> TextEncoder:
    if path not in _LOADED:
        _LOADED[path] = TextEncoder(path)
    return _LOADED[path]


def vocabulary_path(name: str) -> str:
    """Where the public vocabulary file is; called on the driver and handed to the tasks."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encoded(column, path: str) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, the ids of the rows from there) for an Arrow column of texts, chunk by chunk; a null text is empty."""
    enc = encoder(path)
    for first, _, data, offsets in chunks(column, 1_500_000):
        yield first, enc.encode(data, offsets)
