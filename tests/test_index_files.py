"""An index's documents are shuffled whole, so a file holds all postings of its ranges; bounds stand beside them."""

from pyspark.sql import functions as F

from leafquarry.operators.segments import SegmentedIndex


def test_ranges_lie_in_one_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("leafquarry.operators.segments.LEAST_TOKENS", 1 << 8, raising=False)
    docs = spark.range(400).select("id", F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.col("id") % 40 + 1), lambda i: F.concat(F.lit("w"), i))).alias("x"), F.lit("w1 Ñandú, w2").alias("y"))
    index = SegmentedIndex(spark, str(tmp_path / "ix"), ["x", "y"], range_size=16)
    index.commit(docs.where("id < 300")).commit(docs.where("id >= 250")).merge()
    rows = index.live("postings")
    files = [r.range for r in rows.select("range", F.input_file_name().alias("file")).distinct().collect()]
    assert sorted(files) == list(range(25))
    assert rows.select(F.input_file_name()).distinct().count() > 1
    bounds = rows.groupBy("term", "range").agg(F.max("tf").alias("a"), F.min("dl").alias("b"), F.min("most").alias("c"), F.max("most").alias("d"), F.min("least").alias("e"), F.max("least").alias("f"))
    assert bounds.where("a <> c OR a <> d OR b <> e OR b <> f").isEmpty()
    got = {r.term: r.docs for r in index.part("dfs").collect()}
    assert got == {"nandu": 400} | {f"w{i}": 400 if i < 3 else 10 * (41 - i) for i in range(1, 41)}
