"""Toxic spans and document scores by a linear-chain conditional random field (operator 3).

Documents are labelled, tokens are not, so the tokens of the training sample are labelled first: a word or a word beginning that occurs in
toxic documents far more often than chance allows marks its tokens. A two-label chain over each sentence is then fitted to these labels with
hashed word, prefix and suffix features. Forward-backward marginals give every token its probability; the tokens above one half form the
offending spans, and sums and maxima of the marginals go through a logistic curve, fitted to the document labels, to the document score.

The sample is bounded by ``Fit.toxic_docs``, ``clean_docs`` and ``doc_chars`` and fitted on the driver; everything else runs over all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import unused
from .textops import U64, Words, chunks, mix64, runs

PREFIXES = (3, 4, 5, 6)
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?"]] = True


@dataclass(frozen=True)
class Fit:
    """Bounds and settings of the fit: documents taken from each class, the longest text taken, hashed features, passes, smoothing."""

    toxic_docs: int = 800
    clean_docs: int = 2000
    doc_chars: int = 6_000
    feature_bits: int = 18
    passes: int = 40
    l2: float = 1e-6
    chance_features: float = 1.0


@dataclass
class Chain:
    weights: np.ndarray
    bias: float
    trans: np.ndarray  # exp of the transition scores, [from, to] over (clean, toxic)
    start: float
    curve: np.ndarray

    @property
    def bits(self) -> int:
        return int(len(self.weights) - 1).bit_length()


class Tokens:
    """Words without outer punctuation, their feature hashes (0: no such feature), and the sentence each is in."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        w = Words(data, offsets)
        self.words = w
        start, end = w.start.copy(), w.end.copy()
        for _ in range(3):
            start += (end - start > 1) & _PUNCT[data[start]] if len(start) else 0
            end -= (end - start > 1) & _PUNCT[data[end - 1]] if len(end) else 0
        self.start, self.end, self.text = start, end, w.text
        n = len(start)
        new = np.ones(n, dtype=bool)
        if n:
            line = np.cumsum(data == 10)[w.start]
            new[1:] = (line[1:] != line[:-1]) | (w.text[1:] != w.text[:-1]) | _STOP[data[w.end[:-1] - 1]]
        self.first = np.flatnonzero(new)
        self.length = np.diff(np.append(self.first, n))
        with np.errstate(over="ignore"):
            size = end - start
            kinds = [mix64(w.span_hash(start, end) + U64(1))]
            for k in PREFIXES:
                kinds.append(np.where(size >= k, mix64(w.span_hash(start, np.minimum(start + k, end)) + U64(10 + k)), U64(0)))
            kinds.append(np.where(size >= 5, mix64(w.span_hash(np.maximum(end - 4, start), end) + U64(2)), U64(0)))
        self.kinds = kinds

    def features(self, bits: int) -> np.ndarray:
        """Indices into the weights, one row per kind; index 0 is kept at weight 0 for missing features."""
        return np.stack([_indices(k, bits) for k in self.kinds])


def _odds(e: np.ndarray, first: np.ndarray, length: np.ndarray, a: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forward odds, backward odds, exp emissions) of the toxic label; all sentences step together, the longest first."""
    x = np.exp(np.clip(e, -30, 30))
    fw, bw = np.empty_like(x), np.ones_like(x)
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), side="left") if steps else []
    if steps:
        fw[first] = x[first] * start
    for t in range(1, steps):
        i = first[: active[t]] + t
        r = fw[i - 1]
        fw[i] = np.clip(x[i] * (a[0, 1] + r * a[1, 1]) / (a[0, 0] + r * a[1, 0]), 1e-30, 1e30)
    for t in range(steps - 2, -1, -1):
        i = first[: active[t + 1]] + t
        q = bw[i + 1] * x[i + 1]
        bw[i] = np.clip((a[1, 0] + q * a[1, 1]) / (a[0, 0] + q * a[0, 1]), 1e-30, 1e30)
    return fw, bw, x


def marginals(chain: Chain, tokens: Tokens) -> np.ndarray:
    e = sum(chain.weights[_indices(k, chain.bits)].astype(np.float64) for k in tokens.kinds) + chain.bias
    fw, bw, _ = _odds(e, tokens.first, tokens.length, chain.trans, chain.start)
    odds = fw * bw
    return odds / (1 + odds)


def summaries(p: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """What the curve sees of each document: 1, log of the expected toxic tokens, the largest marginal, log of the share."""
    total, count = np.bincount(text, weights=p, minlength=n), np.bincount(text, minlength=n)
    top = np.zeros(n)
    if len(text):
        at = runs(text)
        top[text[at]] = np.maximum.reduceat(p, at)
    return np.stack([np.ones(n), np.log1p(total), top, np.log1p(1000 * total / np.maximum(count, 1))], axis=1)


def _marked(tokens: Sample, toxic: np.ndarray, fit: Fit) -> np.ndarray:
    """Which tokens of toxic documents have a word or prefix that chance alone would not put into so many toxic documents."""
    marked = np.zeros(len(tokens.text), dtype=bool)
    n_toxic, n_clean = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    share = n_toxic / (n_toxic + n_clean)
    for kind in tokens.kinds[: 1 + len(PREFIXES)]:
        order = np.lexsort((tokens.text, kind))
        k, t = kind[order], tokens.text[order]
        new = np.ones(len(k), dtype=bool)
        new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
        k, t = k[new], t[new]
        at = runs(k)
        if not len(at):
            continue
        bad = np.add.reduceat(toxic[t].astype(np.int64), at)
        good = np.diff(np.append(at, len(k))) - bad
        least = max(3.0, np.log(max(len(at), 2) / fit.chance_features) / -np.log(share)) if share < 1 else np.inf
        strong = k[at[(bad >= least) & (good / n_clean <= 0.02 * bad / n_toxic) & (k[at] != 0)]]
        marked |= np.isin(kind, strong)
    return marked & toxic[tokens.text]


class _Part:
    """What is kept of a chunk's tokens; the text and its running hash are let go."""

    def __init__(self, t: Tokens):
        self.n_texts, self.text, self.first, self.length, self.kinds = t.words.n_texts, t.text, t.first, t.length, t.kinds


#: Tokens of the training texts that a pass of the fit goes through together, so the driver holds few numbers for each of the others.
PART = 1 << 16


class Sample:
    """The tokens of all training texts, gathered chunk by chunk."""

    def __init__(self, texts: list[str]):
        parts = [_Part(Tokens(data, offsets)) for _, _, data, offsets in chunks(pa.array(texts, pa.string()), 100_000)]
        rows = np.cumsum([0, *(p.n_texts for p in parts)])
        size = np.cumsum([0, *(len(p.text) for p in parts)])
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        self.text = join([p.text + a for p, a in zip(parts, rows, strict=False)])
        self.first = join([p.first + a for p, a in zip(parts, size, strict=False)])
        self.length = join([p.length for p in parts])
        self.kinds = []
        for _ in range(len(PREFIXES) + 2):  # one kind after the other, so none is held twice for long
            self.kinds.append(join([p.kinds.pop(0) for p in parts]).astype(U64, copy=False))

    def features(self, bits: int) -> np.ndarray:
        out = np.empty((len(self.kinds), len(self.text)), np.int32)
        for row, kind in zip(out, self.kinds, strict=True):
            row[:] = _indices(kind, bits)
        return out

    def cuts(self) -> list[tuple[slice, slice]]:
        """Runs of whole sentences of about ``PART`` tokens: their tokens and their sentences."""
        n = len(self.text)
        if not n:
            return []
        heads = np.unique(np.searchsorted(self.first, np.arange(0, n, PART)))
        heads = heads[heads < len(self.first)]
        ends, tokens = np.append(heads[1:], len(self.first)), np.append(self.first[heads], n)
        return [(slice(*t), slice(*h)) for t, h in zip(zip(tokens[:-1], tokens[1:], strict=True), zip(heads, ends, strict=True), strict=True)]


def _indices(kind: np.ndarray, bits: int) -> np.ndarray:
    return np.where(kind == 0, 0, 1 + (kind % U64((1 << bits) - 1)).astype(np.int32)).astype(np.int32)


def fit_chain(texts: list[str], toxic: np.ndarray, prior: float, fit: Fit = Fit()) -> Chain:
    """Fit chain and curve to whole texts with document labels; ``prior`` is the share of toxic rows among all labelled ones."""
    tokens = Sample(texts)
    toxic = np.asarray(toxic, dtype=bool)
    y = _marked(tokens, toxic, fit).astype(np.float64)
    size = 1 << fit.feature_bits
    f = tokens.features(fit.feature_bits)
    tokens.kinds.clear()
    w, bias, log_a, start = np.zeros(size), -4.0, np.zeros((2, 2)), 0.0
    emissions = lambda w, bias, at: sum(w[row[at]].astype(np.float64) for row in f) + bias
    seq_start = np.zeros(len(y), dtype=bool)
    seq_start[tokens.first] = True
    parts = tokens.cuts()
    m, v = np.zeros(size + 6), np.zeros(size + 6)
    for step in range(1, fit.passes + 1 if y.any() else 1):
        a, g, sums, trans = np.exp(log_a), np.zeros(size), np.zeros(2), np.zeros(4)
        for at, sentences in parts:
            first, inner = tokens.first[sentences] - at.start, np.flatnonzero(~seq_start[at])
            fw, bw, x = _odds(emissions(w, bias, at), first, tokens.length[sentences], a, np.exp(start))
            gap = y[at] - fw * bw / (1 + fw * bw)
            r, q = fw[inner - 1], x[inner] * bw[inner]
            cells = np.stack([np.full(len(r), a[0, 0]), a[0, 1] * q, r * a[1, 0], r * a[1, 1] * q])
            have = np.bincount(2 * y[at][inner - 1].astype(int) + y[at][inner].astype(int), minlength=4)
            trans += have - (cells / cells.sum(axis=0)).sum(axis=1)
            for row in f:
                g += np.bincount(row[at], weights=gap, minlength=size)
            sums += gap.sum(), gap[first].sum()
        g -= fit.l2 * len(y) * w
        g[0] = 0
        grad = np.concatenate([g, sums[:1], trans, sums[1:]])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w += move[:size]
        bias += move[size]
        log_a += move[size + 1 : size + 5].reshape(2, 2)
        log_a -= log_a[0, 0]
        start += move[size + 5]
    chain = Chain(w.astype(np.float32), float(bias), np.exp(log_a), float(np.exp(start)), np.array([np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)), 0, 0, 0]))
    if y.any() and toxic.any() and not toxic.all():
        p = np.empty(len(y))
        for at, sentences in parts:
            e = emissions(chain.weights, chain.bias, at)
            fw, bw, _ = _odds(e, tokens.first[sentences] - at.start, tokens.length[sentences], chain.trans, chain.start)
            p[at] = fw * bw / (1 + fw * bw)
        s = summaries(p, tokens.text, len(texts))
        weight = np.where(toxic, prior / toxic.mean(), (1 - prior) / (1 - toxic.mean()))
        chain.curve = _logistic(s, toxic, weight, chain.curve)
    return chain


def _logistic(s: np.ndarray, y: np.ndarray, weight: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a quadratic penalty, by Newton steps that are halved until the loss falls."""
    penalty = np.array([1e-3, 0.3, 0.3, 0.3])

    def loss(b):
        z = s @ b
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (penalty * b * b).sum()

    at = loss(b)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(s @ b, -30, 30)))
        h = (s * (weight * q * (1 - q))[:, None]).T @ s + np.diag(penalty)
        step = np.linalg.solve(h, s.T @ (weight * (y - q)) - penalty * b)
        while (new := loss(b + step)) > at and np.abs(step).max() > 1e-9:
            step = step / 2
        if at - new < 1e-9:
            break
        b, at = b + step, new
    return b


def train(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Chain:
    """Fit on at most ``fit.toxic_docs`` and ``fit.clean_docs`` labelled rows, chosen by a hash of the id. Rows without a label, an id or a
    text are not used; without labels of both kinds every text gets the prior."""
    marks = labels.where(f"{id_col} is not null and {label_col} is not null").groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    counts = {r["_y"]: r["n"] for r in marks.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    text = F.col(text_col).cast("string")
    short = docs.select(id_col, F.length(text).alias("_n")).where(f"_n <= {fit.doc_chars}").select(id_col).distinct().join(marks, id_col)
    some = lambda y, n: short.where(F.col("_y") == y).orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(n)
    picked = some(1, fit.toxic_docs).unionByName(some(0, fit.clean_docs)).collect()
    # only ids are shuffled; the picked ones are bounded by the fit, so their texts are found by a broadcast join
    ids = docs.sparkSession.createDataFrame([(r[id_col], r["_y"]) for r in picked], T.StructType([docs.schema[id_col], T.StructField("_y", T.IntegerType())]))
    sample = docs.select(id_col, text.alias("_text")).join(F.broadcast(ids), id_col).where(f"length(_text) <= {fit.doc_chars}").dropDuplicates([id_col]).orderBy(id_col).select("_text", "_y").collect()
    total = sum(counts.values())
    return fit_chain([r["_text"] for r in sample], np.array([r["_y"] for r in sample], dtype=bool), counts.get(1, 0) / total if total else 0.01, fit)


def _tagged(chain, with_spans: bool):
    def run(batches):
        c = chain.value
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column(1)):
                tokens, n = Tokens(data, offsets), last - first
                p = marginals(c, tokens)
                z = summaries(p, tokens.text, n) @ c.curve
                hit = np.flatnonzero(p >= 0.5)
                of = np.searchsorted(tokens.text[hit], np.arange(n + 1))
                chars = np.append(0, np.cumsum((data & 0xC0) != 0x80)) if with_spans else None
                spans = []
                for i in range(n if with_spans else 0):
                    own: list[dict] = []
                    base = chars[offsets[i]]
                    for j in hit[of[i] : of[i + 1]]:
                        a, b = int(chars[tokens.start[j]] - base), int(chars[tokens.end[j]] - base)
                        if own and j == back + 1:
                            own[-1].update(end=b, score=max(own[-1]["score"], float(p[j])))
                        else:
                            own.append({"start": a, "end": b, "score": float(p[j])})
                        back = j
                    spans.append(own)
                cols = [batch.column(0)[first:last], pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))), pa.array(np.diff(of).astype(np.int64))]
                names = ["id", "score", "n_toxic_tokens"]
                if with_spans:
                    cols.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = True) -> DataFrame:
    """(id_col, score, n_toxic_tokens, spans) for every row; spans are code-point offsets of runs of toxic tokens.

    Null and empty texts have no tokens and get the curve's value for that. Rows may repeat; other columns are ignored. No shuffle; the
    broadcast chain has a fixed size (4 bytes for each of 2**feature_bits weights).
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, score double, n_toxic_tokens long" + (", spans array<struct<start:int,end:int,score:double>>" if with_spans else "")
    return rows.mapInArrow(_tagged(shared, with_spans), schema).withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, chain: Chain, least: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores under ``least``, each judged where it is read: neither rows nor texts are shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    # a text is sent once: a column of another type is cast beside the others, and what stays leaves piece by piece
    plain = docs.schema[text_col].dataType.simpleString() == "string"
    (said,) = [text_col] if plain else unused(docs, "said")
    rows = docs if plain else docs.withColumn(said, F.col(text_col).cast("string"))
    at = rows.columns.index(said)

    def kept(batches):
        tagged = _tagged(shared, False)
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at)], names=["id", "text"])
            few, first = batch if plain else batch.select(range(at)), 0
            for x in tagged([texts]):
                yield few.slice(first, x.num_rows).filter(pa.array(x.column(1).to_numpy() < least))
                first += x.num_rows

    return rows.mapInArrow(kept, docs.schema)
