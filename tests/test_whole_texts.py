"""Queries read whole texts: references after the first full stop count. The expected ones are written out by hand."""

import pytest

from leafquarry.plans.catalogue import QUERIES

TEXTS = ["Primero. Luego el artículo 31 de la LIR, procede. Fin.", "Nada. Ni aquí.", "Uno. Dos. El artículo 2 del Código Tributario."]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("texts"))
    rows = [(i, t, "es", "s", len(t)) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    return path


def test_references(spark, folder):
    got = sorted((r.id, r.clave) for r in QUERIES["e03_references"](spark, folder).collect())
    assert got == [(0, "LIR:1"), (0, "LIR:31"), (1, "LIVS:2"), (2, "CT:2"), (2, "CT:3")]


def test_article_index(spark, folder):
    got = {(r.doc_id, r.ley, r.articulo) for r in QUERIES["k02_article_index"](spark, folder).collect()}
    assert {(0, "LIR", "31"), (2, "CT", "2")} <= got


def test_mentions(spark, folder):
    assert sorted((r.id, r.n) for r in QUERIES["e02_mentions"](spark, folder).collect()) == [(0, 2), (1, 1), (2, 2)]


def test_reindexed(spark, folder):
    assert [r.n for r in QUERIES["k28_reindexed"](spark, folder).collect()] == [1]  # counts texts with one reference
