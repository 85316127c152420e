import random
import re

from pyspark.sql import functions as F

from storyloom.operators import dedup, history
from storyloom.operators.graph import stored
from storyloom.streaming import flow

from .test_stories import WORDS

SCHEMA = "id long, title string, content_hash string, canonical_url string"


def random_rows(r, n):
    rows, titles = [], []
    for i in range(1, n + 1):
        w = r.choice(titles).split() if titles and r.random() < 0.5 else [r.choice(WORDS) + r.choice("abc") for _ in range(r.choice([1, 3, 7, 8, 14, 20, 40]))]
        w = list(w)
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            w[r.randrange(len(w))] = r.choice(WORDS) + r.choice("abc")
        title = " ".join(w) if r.random() > 0.05 else r.choice(["", None, "a b"])
        titles.append(title or "x")
        rows.append((i, title, r.choice([None, f"h{r.randrange(n)}", f"h{i}"]), r.choice([None, f"u{r.randrange(n)}", f"u{i}"])))
    return rows


def sequential(rows):
    kept, out = [], {}
    for i, title, h, u in rows:
        t = set(re.findall(r"\w{3,}", (title or "").lower()))
        hits = [[j for j, _, g, _ in kept if h and g == h], [j for j, _, _, v in kept if u and v == u], [j for j, s, _, _ in kept if t and s and 100 * len(t & s) >= 85 * len(t | s)]]
        out[i] = next(((max(x), n) for x, n in zip(hits, ("hash", "url", "title"), strict=True) if x), (None, None))
        if out[i][0] is None:
            kept.append((i, t, h, u))
    return out


def test_any_split_into_batches_equals_the_sequential_pass(spark):
    """Targets and reasons of all articles, resolved in one batch and in four against the growing index; a repeated batch accepts nothing."""
    r = random.Random(13)
    rows = random_rows(r, 150)
    want = sequential(rows)
    for cuts in ([], sorted(r.sample(range(1, 150), 3))):
        got, index = {}, None
        for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            batch = spark.createDataFrame(rows[a:b], SCHEMA)
            out = history.resolve(batch, index)
            got |= {x.id: (x.duplicate_of_id, x.reason) for x in out.collect()}
            new = history.index_rows(batch.join(out.where("not is_duplicate").select("id"), "id", "left_semi"))
            index = stored(new if index is None else index.unionByName(new), "test-index")
        assert got == want
    again = history.resolve(batch.withColumn("id", F.col("id") + 1000).where("title <> '' or content_hash is not null or canonical_url is not null"), index)
    assert again.where("not is_duplicate").join(batch.where(F.size(history.title_tokens(F.col("title"))) > 0).select((F.col("id") + 1000).alias("id")), "id").count() == 0


def test_title_keys_find_every_similar_set(spark):
    """Sets of one to ninety tokens and all sizes that can be 85 % similar to them, with every difference that the bound allows."""
    r, rows, i = random.Random(2), [], 0
    for n in [*range(1, 30), 45, 60, 90]:
        for _ in range(12):
            a = [f"w{r.randrange(10**6)}" for _ in range(n)]
            drop = r.randrange(n * 15 // 100 + 1)
            add = r.randrange((n - drop) * 100 // 85 - n + 1) if (n - drop) * 100 // 85 >= n else 0
            b = a[drop:] + [f"v{r.randrange(10**6)}" for _ in range(add)]
            rows.append((i, sorted(set(a)), sorted(set(b))))
            i += 1
    df = spark.createDataFrame(rows, "i long, a array<string>, b array<string>")
    both = F.size(F.array_intersect("a", "b"))
    df = df.where(both * 100 >= 85 * (F.size("a") + F.size("b") - both))
    assert df.count() > 300
    assert df.where(~F.arrays_overlap(history.title_keys(F.col("a")), history.title_probes(F.col("b")))).count() == 0
    assert df.where(~F.arrays_overlap(history.title_keys(F.col("b")), history.title_probes(F.col("a")))).count() == 0


def test_store_keeps_one_of_similar_articles(spark, tmp_path):
    """One title under two URLs, another one under the first URL, a later poll under a fourth URL, and a batch that is written twice."""
    store = str(tmp_path / "store")
    title, poll = "Council approves new transit plan for the northern river district", "source_id long, fetched_at timestamp, position int, title string, canonical_url string, content_hash string"
    first = [(1, None, 0, title, "u1", "h1"), (1, None, 1, title, "u2", "h2"), (1, None, 2, "Storm floods coast", "u1", "h3")]
    for name, rows in (("a", first), ("a", first), ("b", [(2, None, 0, title + " today", "u4", "h4")]), ("c", first), ("d", [(3, None, 0, "Bank rates rise", "u9", "h9")])):
        flow.store_batch(spark.createDataFrame(rows, poll), store, name)
    got = spark.read.parquet(store).collect()
    assert {(x.canonical_url, x.batch) for x in got} == {("u1", "a"), ("u9", "d")} and len({x.id for x in got}) == 2


def test_leader_pass_of_an_empty_batch(spark):
    assert history.resolve(spark.createDataFrame([], SCHEMA), None).count() == 0
    assert dedup.leader_pass(spark.createDataFrame([], SCHEMA)).count() == 0
