import os
import random

from storyloom.operators import graph


def union_find(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for a, b in edges if a != b for x in (a, b)}


def path_of(ids):
    return list(zip(ids, ids[1:], strict=False))


def shapes():
    r = random.Random(5)
    mixed = r.sample(range(10**9), 10_000)
    return {
        "random path": path_of(mixed),
        "path that begins with its least id and then falls": path_of([0, *range(10_000, 0, -1)]),
        "ascending path": path_of(list(range(10_000))),
        "star with its centre in the middle of the ids": [(5_000, i) for i in range(10_001)],
        "comb": path_of(mixed[:3_000]) + [(mixed[i], 2 * 10**9 + 10 * i + j) for i in range(3_000) for j in range(i % 5)],
        "tree of random parents": [(i, r.randrange(i)) for i in range(1, 8_000)],
        "cliques on a chain": [(10 * k + i, 10 * k + j) for k in range(300) for i in range(10) for j in range(i)] + [(10 * k + 9, 10 * k + 10) for k in range(299)],
    }


def test_components_settle_in_few_rounds(spark, monkeypatch):
    """Paths of 10,000 nodes in any numbering, a star, a comb, a tree and chained cliques: equal to union-find after at most 20 rounds."""
    rounds, put = [], graph.Scratch.put
    monkeypatch.setattr(graph.Scratch, "put", lambda self, df, name: (rounds.append(name) if name.startswith("map-") else None, put(self, df, name))[1])
    edges = [(a + (k << 40), b + (k << 40)) for k, shape in enumerate(shapes().values()) for a, b in shape]
    out = graph.components(spark.createDataFrame(edges, "a long, b long"), "shape")
    assert {x.id: x.component for x in out.collect()} == union_find(edges)
    assert len(rounds) <= 20


def test_components_equal_union_find(spark, monkeypatch):
    """Chains, a star and random edges, null ends and loops; maps broadcast, and joined with hot nodes and components apart."""
    monkeypatch.setattr(graph, "HOT_ROWS", 20)
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(90)] + [(1000, 1000 + i) for i in range(1, 60)] + [(3000 + i, 3001 + i) for i in range(30)]
    want = union_find(edges)
    df = spark.createDataFrame([*edges, (7, None), (None, None), (9999, 9999)], "a long, b long")
    for rows in (1_000_000, 0):
        out = graph.components(df, f"test-{rows}", broadcast_rows=rows)
        assert {x.id: x.component for x in out.collect()} == want
        kept = [f for f in os.listdir(f"{graph.shared_dir(spark).removeprefix('file:')}/storyloom") if f.startswith(f"test-{rows}-")]
        assert len(kept) == 1  # only the result's labels are left
    assert graph.components(df.limit(0)).count() == 0


def test_join_hot_equals_a_left_join(spark):
    rows = spark.createDataFrame([(i, 7 if i % 3 == 0 else i) for i in range(60)] + [(99, None)], "id long, k long")
    table = spark.createDataFrame([(k, f"v{k}") for k in (1, 7, 8)], "k long, v string")
    want = sorted(map(str, rows.join(table, ["k"], "left").collect()))
    for hot in (7, 55):
        assert sorted(map(str, graph.join_hot(rows, table, ["k"], spark.createDataFrame([(hot,)], "k long")).collect())) == want


def test_a_stored_table_leaves_no_shuffle_files(spark):
    """What was shuffled goes when the table is written, not with the driver's next garbage collection; the session's setting stays as it was."""
    import time

    from storyloom.operators import graph

    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in (blocks.getAllFiles().apply(i).getName() for i in range(blocks.getAllFiles().size())) if f.startswith("shuffle_")}
    before = files()
    out = graph.stored(spark.range(10_000).repartition(7).groupBy((graph.F.col("id") % 97).alias("k")).count(), "shuffled")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and out.count() == 97 and spark.conf.get(graph.SHUFFLE_CLEANUP) == "false"
