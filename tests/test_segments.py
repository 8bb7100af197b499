"""The index in segments against postings of the same documents, rebuilt; skipping against scoring everything."""

import pytest
from pyspark.sql import functions as F

from leafquarry.operators import retrieval as rt
from leafquarry.operators.segments import SegmentedIndex

FIELDS = ["titulo", "contenido"]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return d.select(F.col("doc_id").alias("id"), F.substring("text", 1, 40).alias("titulo"), F.col("text").alias("contenido")).cache()


def rows(frame):
    return sorted((r.doc_id, round(r.rank, 6)) for r in frame.collect())


def same(spark, index, docs, phrases):
    rebuilt = rt.postings(docs, FIELDS)
    assert rows(index.scores(phrases)) == rows(rt.bm25(rebuilt, rt.lengths(docs, FIELDS), phrases))
    mine = index.live("postings").groupBy("term", "doc_id", "field").agg(F.sum(F.size("positions")).alias("n"))
    theirs = rebuilt.groupBy("term", "doc_id", "field").agg(F.count(F.lit(1)).alias("n"))
    assert mine.exceptAll(theirs.select(*mine.columns)).isEmpty() and mine.count() == theirs.count()
    df = {r.term: r.docs for r in index.part("dfs").groupBy("term").agg(F.sum("docs").alias("docs")).where("docs <> 0").collect()}
    assert df == {r.term: r.docs for r in rebuilt.groupBy("term").agg(F.countDistinct("doc_id").alias("docs")).collect()}


PHRASES = (("and",), ("thing",), ("of", "the"), ("nosuchword",))


def test_commits_and_merge(spark, docs, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path / "ix"), FIELDS, range_size=8)
    assert index.best(PHRASES, 5).count() == 0 and index.scores(PHRASES).count() == 0
    index.commit(docs.where("id % 10 <> 3"))
    first = index.segments[0]["folder"]
    before = sorted(p.name for p in (tmp_path / "ix" / first / "postings").iterdir())
    same(spark, index, docs.where("id % 10 <> 3"), PHRASES)
    changed = docs.where("id % 10 = 2").withColumn("titulo", F.concat(F.lit("changed and thing "), "titulo"))
    index.commit(docs.where("id % 10 = 3").unionByName(changed), removed=docs.where("id % 10 = 1").unionByName(docs.limit(1).withColumn("id", F.lit(10**9))))
    now = docs.where("id % 10 NOT IN (1, 2)").unionByName(changed)
    same(spark, index, now, PHRASES)
    index.commit(docs.where("id < 0"), removed=docs.where("id % 10 = 4"))
    index.commit(docs.where("id = 14"))  # removed before, back again
    now = now.where("id % 10 <> 4 OR id = 14").unionByName(docs.where("id = 14 AND false"))
    same(spark, index, now, PHRASES)
    assert sorted(p.name for p in (tmp_path / "ix" / first / "postings").iterdir()) == before and len(index.segments) == 4
    old = SegmentedIndex(spark, str(tmp_path / "ix"), FIELDS, range_size=8)
    index.merge()
    assert len(index.segments) == 1 and len(old.segments) == 4 and len(old.open().segments) == 1
    same(spark, index, now, PHRASES)
    same(spark, old, now, PHRASES)


def test_best_is_exact(spark, docs, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path / "ix"), FIELDS, range_size=4).commit(docs.where("id % 2 = 0")).commit(docs.where("id % 2 = 1"))
    rebuilt, lengths = rt.postings(docs, FIELDS).cache(), rt.lengths(docs, FIELDS).cache()
    for phrases in (PHRASES, (("nosuchword",),), (("of", "the"), ("and", "the")), (("pathetic",), ("and",))):
        wanted = rt.bm25(rebuilt, lengths, phrases).orderBy(F.round("rank", 9), "doc_id").collect()
        for most in (1, 7, 1000):
            assert rows(index.best(phrases, most, looked_at=3)) == sorted((r.doc_id, round(r.rank, 6)) for r in wanted[:most])
    index.best(phrases, 1, looked_at=3)
    assert index.read["read"] < index.read["ranges"] / 2  # a rare word: most ranges can't hold the best document
