"""A question builds no index; with one that stands and without, it gets the same rows."""

import pytest
from pyspark.sql import functions as F

from leafquarry.operators import catalog
from leafquarry.operators import retrieval as rt
from leafquarry.operators.segments import SegmentedIndex
from leafquarry.plans import retrieval
from leafquarry.plans.catalogue import QUERIES
from leafquarry.plans.domain import Tables

NAMES = ("o07_best500", "r02_search_page", "r05_context", "r06_answer", "r09_search_rows", "r09_search_response")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("asked"))
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id % 3 = 0").write.parquet(f"{at}/documents.parquet")
    return at


def test_questions_build_nothing(spark, folder, monkeypatch):
    def refused(*_args, **_more):
        raise AssertionError("a question built an index")

    with monkeypatch.context() as m:
        m.setattr(SegmentedIndex, "commit", refused)
        alone = {name: QUERIES[name](spark, folder).collect() for name in NAMES}
    t = Tables(spark, folder)
    index = retrieval.built(t)
    assert retrieval.asked(t) is index
    for name in NAMES:
        assert alone[name] and sorted(map(str, QUERIES[name](spark, folder).collect())) == sorted(map(str, alone[name])), name


@pytest.mark.parametrize("name", ["r05_context", "r06_answer"])
def test_contexts_do_not_depend_on_an_index(spark, folder, monkeypatch, name):
    read = []
    monkeypatch.setattr(SegmentedIndex, "scores", lambda self, phrases, f=SegmentedIndex.scores: read.append(name) or f(self, phrases))
    assert QUERIES[name](spark, folder).count() and not read


def test_filters_meet_only_the_best(spark):
    docs = spark.range(400).select("id", F.concat(F.lit("word w"), "id").alias("contenido"), *[F.lit("").alias(f) for f in ("titulo", "palabras_clave", "resumen")])
    index = docs.where("id % 2 = 0").select(F.col("id").alias("doc_id"), F.lit("LIR").alias("ley"))
    best = rt.candidates(docs, rt.Scan(docs, ("contenido",)), "word", 20)
    found = catalog.filtered(best, index, None, None, catalog.Search(ley="LIR"))
    assert sorted(r.id for r in found.collect()) == list(range(0, 20, 2))
    semi = found._jdf.queryExecution().optimizedPlan().toString().split("LeftSemi")[1]
    assert semi.count("INSET") >= 2  # both sides of the semi join, which stands below the join with the best
