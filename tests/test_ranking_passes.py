"""A ranking makes a text's terms once: for all phrases of a scan, and for all uses of postings and lengths."""

import pytest
from pyspark.sql import functions as F

from leafquarry.operators import retrieval as rt

PHRASES = (("a",), ("a", "a"), ("nandu",), ("of", "the", "sea"), ("º",), ("none",))


@pytest.fixture
def docs(spark):
    rows = [(1, "a a a", "A"), (2, "Ñandú, of", "the sea; of the\nsea of-the-sea"), (3, None, ""), (4, "xa ax a_a", "º 5º"), (5, ".", "a\ta")]
    return spark.createDataFrame(rows, "id bigint, x string, y string")


def rows(frame):
    return sorted((r.doc_id, round(r.rank, 9)) for r in frame.collect())


def test_scan(spark, docs, monkeypatch):
    made = []
    monkeypatch.setattr(rt, "kept", lambda frame, tag, f=rt.kept: made.append(frame) or f(frame, tag))
    got = rows(rt.Scan(docs, ("x", "y")).scores(PHRASES))
    counts = {r.doc_id: (r.dl, *(r[f"tf{k}"] for k in range(len(PHRASES)))) for r in made[0].collect()}
    assert counts == {1: (4, 4, 2, 0, 0, 0, 0), 2: (10, 0, 0, 1, 2, 0, 0), 3: (0,) + (0,) * 6, 4: (6, 2, 1, 0, 0, 1, 0), 5: (2, 2, 1, 0, 0, 0, 0)}
    plan = made[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("translate(") == 2 and plan.lower().count("regexp") <= 4
    monkeypatch.undo()
    assert got == rows(rt.Stored(rt.postings(docs, ["x", "y"]), rt.lengths(docs, ["x", "y"])).scores(PHRASES))


def test_stored(spark, docs):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    counting = docs.select("id", counted.asNondeterministic()("x").alias("x"))
    rt.Stored(rt.postings(counting, ["x"]), rt.lengths(counting, ["x"])).scores(PHRASES).collect()
    assert seen.value == 2 * 5
