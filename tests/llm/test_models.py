import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from storyloom.llm import kneser_ney, toxicity

from .helpers import docs, near_copies, prose, words


def test_kneser_ney_equals_brute_force(spark):
    rows = near_copies(3, 80)
    train = [(i, t) for i, t in rows if i % 4]
    model = kneser_ney.train(docs(spark, train))
    got = {r.doc_id: r for r in kneser_ney.score(docs(spark, rows), model).collect()}
    tokens = lambda t: [*words(t), None]
    uni, pair = Counter(), Counter()
    for _, t in train:
        uni.update(tokens(t))
        pair.update(zip(["<s>", *words(t)], tokens(t), strict=True))
    before, ctx, freq = Counter(w for _, w in pair), defaultdict(lambda: [0, 0, 0, 0]), Counter(pair.values())
    for (u, _), n in pair.items():
        ctx[u][0] += n
        ctx[u][min(n, 3)] += 1
    d = kneser_ney.discounts(*(freq[k] for k in (1, 2, 3, 4)))
    f2 = Counter(before.values())
    e = kneser_ney.discounts(*(f2[k] for k in (1, 2, 3, 4)))
    assert model.tokens == sum(uni.values()) and model.types == len(uni)
    left = (e[0] * f2[1] + e[1] * f2[2] + e[2] * (len(before) - f2[1] - f2[2])) / len(pair)
    cut = lambda n, x: x[min(n, 3) - 1] if n else 0

    def p(u, w):
        flat = max(before[w] - cut(before[w], e), 0) / len(pair) + left / (len(uni) + 1)
        if u not in ctx:
            return flat
        t = ctx[u]
        return max(pair[u, w] - cut(pair[u, w], d), 0) / t[0] + (d[0] * t[1] + d[1] * t[2] + d[2] * t[3]) / t[0] * flat

    assert abs(sum(p("kaban", w) for w in before) + p("kaban", "unseen") - 1) < 1e-9
    for i, t in rows:
        base = sum(math.log10((uni[w] + 1) / (model.tokens + model.types + 1)) for w in tokens(t))
        want = sum(math.log10(p(u, w)) for u, w in zip(["<s>", *words(t)], tokens(t), strict=True))
        assert abs(got[i].base_score - base) < 1e-6 and abs(got[i].score - want) < 1e-6
        assert (got[i].n_tokens, got[i].n_known) == (len(tokens(t)), sum(w in uni for w in tokens(t)))


def test_kneser_ney_without_training_texts(spark):
    model = kneser_ney.train(docs(spark, []))
    r = kneser_ney.score(docs(spark, [(1, "a b"), (None, None)]), model).collect()
    assert [x.n_tokens for x in r] == [3, 1] and all(x.score == 0 for x in r)


def labelled(spark, n=500):
    r, rows, labels = random.Random(8), [], []
    for i in range(n):
        toxic = r.random() < 0.2
        w = prose(r, r.choice([10, 40, 90])).split(" ")
        if toxic:
            for _ in range(r.choice([1, 2, 5])):
                w.insert(r.randrange(len(w)), "grob" + r.choice(["ian", "st", "el", "ung", "xa"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels), dict(rows)


def test_toxicity_on_held_out_documents(spark):
    d, labels, truth, texts = labelled(spark)
    learn = kneser_ney.fold_of("doc_id", 3) != 1
    chain = toxicity.train(d.where(learn), labels.where(learn))
    out = {r.doc_id: r for r in toxicity.score(d, chain).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((out[i].score >= 0.7) == bool(truth[i]) for i in held) >= 0.97 * len(held)
    for i in held:
        for s in out[i].spans:
            assert "grob" in texts[i][s.start : s.end]
        assert all(0 <= x <= 1 for x in (out[i].score, *(s.score for s in out[i].spans)))


def test_toxicity_edge_cases(spark):
    d, labels, _, _ = labelled(spark, 60)
    chain = toxicity.train(d, labels.where("toxic = 0"))  # one class only: every text gets the prior
    odd = spark.createDataFrame([(1, None, 1.0), (1, "", 2.0), (None, "\n é grobian!\n", 3.0)], "doc_id long, text string, score double")
    assert len({round(r.score, 6) for r in toxicity.score(odd, chain).collect()}) == 1
    assert toxicity.score(odd.limit(0), chain).count() == 0
    assert toxicity.train(d.limit(0), labels.limit(0)).curve[0] < 0


def test_marginals_equal_enumerated_chains():
    from itertools import product

    import numpy as np

    r = np.random.default_rng(4)
    length = np.array([1, 5, 3, 8])
    first = np.cumsum(length) - length
    e, a, start = r.normal(size=length.sum()), r.uniform(0.2, 3, (2, 2)), 0.3
    fw, bw, _ = toxicity._odds(e, first, length, a, start)
    got = fw * bw / (1 + fw * bw)
    for at, n in zip(first, length, strict=True):
        total, toxic = 0.0, np.zeros(n)
        for y in product((0, 1), repeat=int(n)):
            w = start ** y[0] * np.exp(sum(e[at + i] for i in range(n) if y[i])) * np.prod([a[y[i], y[i + 1]] for i in range(n - 1)])
            total += w
            toxic += w * np.array(y)
        assert np.allclose(got[at : at + n], toxic / total, atol=1e-12)


def test_scores_of_repeated_ids_long_texts_and_clashing_columns(spark):
    long_ = " ".join(f"w{i % 977}" for i in range(120_000))
    rows = docs(spark, [(1, "a b c"), (1, "a b c"), (2, long_), (3, None), (3, "")]).selectExpr("*", "1 as key", "2 as id", "3 as score", "4 as n_tokens")
    out = kneser_ney.score(rows.select("doc_id", "text"), kneser_ney.train(rows)).collect()
    got = sorted((r.doc_id, r.n_tokens) for r in out)
    assert got == [(1, 4), (1, 4), (2, 120_001), (3, 1), (3, 1)]
    assert len({r.score for r in out if r.doc_id == 1}) == 1 and len({r.score for r in out if r.doc_id == 3}) == 1


def test_fit_in_runs_of_sentences(monkeypatch):
    r = random.Random(8)
    texts = ["", *(prose(r, r.choice([1, 30, 200])) + " vileword here. vileword" * (i % 3 == 0) for i in range(60))]
    toxic = [False, *(i % 3 == 0 for i in range(60))]
    fit = toxicity.Fit(passes=8)
    want = toxicity.fit_chain(texts, toxic, 0.3, fit)
    sizes, odds = [], toxicity._odds
    monkeypatch.setattr(toxicity, "PART", 100)
    monkeypatch.setattr(toxicity, "_odds", lambda e, *a: (sizes.append(len(e)), odds(e, *a))[1])
    got = toxicity.fit_chain(texts, toxic, 0.3, fit)
    assert max(sizes) < 500 and sum(sizes) > 9 * 1000
    for x in ("weights", "bias", "trans", "start", "curve"):
        assert np.abs(np.subtract(getattr(got, x), getattr(want, x))).max() < 1e-5
