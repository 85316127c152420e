import random

import corpus_pipeline
from storyloom.llm.queries import ORACLES, QUERIES

from .helpers import docs, prose


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram jaccard join", "benchmark decontamination", "best-fit packing"]


def test_pipeline_on_planted_documents(spark, tmp_path):
    r = random.Random(11)
    rows, labels = [], []
    for i in range(120):
        w = prose(r, 60).split(" ")
        toxic = i % 4 == 0
        if toxic:
            w[5], w[20], w[40] = "grobian", "grobst", "grobel"
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    item = prose(r, 40)
    rows += [(200, rows[1][1]), (201, rows[2][1] + " extra"), (202, prose(r, 20) + " " + item), (203, ""), (204, rows[3][1] + "\n" + prose(r, 30))]
    table = docs(spark, rows).selectExpr("doc_id", "text", "'en' as lang", "'src1' as source", "cast(length(text) as long) as n_chars")
    d = str(tmp_path)
    table.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    stage = spark.read.parquet(f"{d}/documents.parquet")
    left = []
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, d)
        assert stage.columns == table.columns
        left.append({x.doc_id for x in stage.select("doc_id").collect()})
    clean = {i for i in range(120) if i % 4}
    assert left[0] == clean | {200, 201, 202, 203, 204}
    assert left[1] == left[0] and clean <= left[2] and left[3] == left[2] - {202}
    packed = corpus_pipeline.run(spark, d)
    assert {x.doc_id for x in packed.select("doc_id").distinct().collect()} == left[3]


def test_stages_of_odd_tables(spark, tmp_path):
    """An empty table; null ids and texts, empty and long texts, repeated rows and ids, and columns whose names the stages use themselves."""
    r = random.Random(15)
    item, long_ = prose(r, 40), prose(r, 20_000)
    rows = [(1, prose(r, 60)), (1, item), (None, item), (None, None), (2, None), (3, ""), (4, long_), (5, long_ + "\nende"), (6, " \n\t")]
    rows += [(7, prose(r, 30))] * 3
    extra = "'en' as lang", "'s' as source", "cast(length(text) as long) as n_chars", "1 as id", "2 as fp", "3 as q_gone", "4 as key", "5 as component_id", "6 as row"
    d = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, item), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for some in (rows, []):
        stage = docs(spark, some).selectExpr("*", *extra)
        columns = stage.columns
        for _, f in corpus_pipeline.STAGES[:-1]:
            stage = corpus_pipeline.materialize(f(spark, stage, d), "odd")
            assert stage.columns == columns
        left = [(x.doc_id, x.text) for x in stage.collect()]
        packed = corpus_pipeline.STAGES[-1][1](spark, stage, d)
        assert packed.count() >= len(left)
        if some:
            assert (1, item) not in left and {x[0] for x in left} == {None, 1, 2, 3, 4, 5, 6, 7} and left.count(rows[-1]) == 3 and (None, item) in left
        else:
            assert not left
