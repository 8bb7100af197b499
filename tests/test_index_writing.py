"""An index's postings are made within a document's row: nothing is shuffled until they are sorted for the files."""

from pyspark.sql import functions as F

from leafquarry.operators.segments import SegmentedIndex


def test_tokens(spark, tmp_path):
    docs = spark.createDataFrame([(1, "b a b", "A c"), (2, None, "")], "doc_id bigint, x string, y string")
    rows = SegmentedIndex(spark, str(tmp_path / "ix"), ["x", "y"])._tokens(docs)
    got = sorted((r.term, r.doc_id, r.field, r.positions, r.dl, r.tf) for r in rows.collect())
    assert got == [("a", 1, "x", [1], 5, 2), ("a", 1, "y", [0], 5, None), ("b", 1, "x", [0, 2], 5, 2), ("c", 1, "y", [1], 5, 1)]
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.agg(F.sum("tf")).first()[0] == 5
