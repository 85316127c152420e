import random

from storyloom.operators import postings, views


def test_search_equals_a_scan(spark, tmp_path):
    """Queries of any length over two batches, one written twice, with empty, null, long and astral texts."""
    rng, letters = random.Random(2), "abAÄ 日😀%_"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    rows = [(i, word(rng.randrange(0, 12)), word(rng.randrange(0, 20))) for i in range(80)] + [(80, None, None), (81, "", ""), (82, "x" * 20_000 + "yz", None)]
    texts = spark.createDataFrame(rows, "id long, title string, summary string")
    asked = [word(n) for n in (0, 1, 1, 2, 2, 3, 3, 4, 5)] + ["xyz", "B", "zz", "ä", "%", None, "B"]
    store = str(tmp_path / "p")
    for name in ("0", "1", "1"):
        postings.add_batch(texts.where(f"id % 2 = {name}"), store, name)
    got = [tuple(r) for r in postings.search(spark, store, texts, spark.createDataFrame([(q,) for q in asked], "query string")).collect()]
    want = {(q, i) for q in asked if q is not None for i, t, s in rows if q.lower() in (t or "").lower() or q.lower() in (s or "").lower()}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_seek_pages_are_the_order(spark, tmp_path):
    """Pages by last key are the whole order, with ties in the first column and whatever the partitions; the comparison reaches the scan."""
    rows = [(i, float(i % 4)) for i in range(53)]
    path, order = str(tmp_path / "s"), [("score", True), ("id", False)]
    views.write_sorted(spark.createDataFrame(rows, "id long, score double"), order, path, 5)
    df, after, seen = spark.read.parquet(path), None, []
    while part := views.seek_page(df, order, 10, after).collect():
        seen += [(r.id, r.score) for r in part]
        after = (part[-1].score, part[-1].id)
    assert seen == sorted(rows, key=lambda r: (-r[1], r[0])) and spark.read.parquet(f"{path}-total").first().total == 53
    assert views.seek_page(df.limit(0), order, 10).count() == 0
    plan = views.seek_page(df, order, 10, (2.0, 7))._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(score,2.0)" in plan
