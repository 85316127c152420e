import numpy as np
import pyarrow as pa

from storyloom.llm import toxicity
from storyloom.llm.textops import chunks


def test_rows_are_judged_where_they_are_read(spark):
    """Toxic rows go without a join or a shuffle; repeated ids, nulls and other columns stay as they are."""
    bad, good = "you vile grobnak scum. ", "a quiet day by the river. "
    rows = [(i, (bad if i % 2 else good) * 3 + f"w{i}", [i]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, said array<long>")
    chain = toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int"))
    odd = docs.unionByName(spark.createDataFrame([(1, good, [7]), (None, good, None), (5, None, None), (6, "", [])], docs.schema))
    kept = toxicity.drop_toxic(odd, chain)
    scores = toxicity.score(odd, chain, with_spans=False).collect()
    want = [r for r, s in zip(odd.collect(), scores, strict=True) if s["score"] < 0.7]
    assert kept.collect() == want and 20 <= len(want) < 44 and kept.schema == odd.schema
    assert toxicity.drop_toxic(docs.limit(0), chain).count() == 0
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_a_text_is_sent_to_python_once(spark, monkeypatch):
    """Only a text of another type needs a column of its own, and what stays leaves in pieces, not as a second whole batch."""
    chain = toxicity.fit_chain(["good words", "bad words"], np.array([False, True]), 0.5)
    sent, frame = [], type(spark.range(0))
    real = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, schema, *a: (sent.append((f, self.columns)), real(self, f, schema, *a))[1])
    rows = spark.createDataFrame([(i, "good words here") for i in range(50)], "doc_id long, text string")
    assert toxicity.drop_toxic(rows, chain).count() in (0, 50) and sent[0][1] == ["doc_id", "text"]
    assert toxicity.drop_toxic(rows.selectExpr("doc_id", "doc_id as text"), chain).columns == ["doc_id", "text"] and len(sent[1][1]) == 3
    monkeypatch.setattr("storyloom.llm.toxicity.chunks", lambda column: chunks(column, 100))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(50)), "text": ["good words here"] * 50})
    toxicity.drop_toxic(rows, chain, 2.0)
    out = list(sent[-1][0](iter([batch])))
    assert len(out) > 5 and [i for b in out for i in b.column(0).to_pylist()] == list(range(50))
