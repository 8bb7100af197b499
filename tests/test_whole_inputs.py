"""Queries that take every document, and j18's real titles."""

import pytest

from leafquarry.plans.catalogue import QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, rows", [("k14_manual", 1000), ("s22_s23_common_columns", 1000), ("u01_union", 1000), ("j15_overlay", 500)])
def test_every_document(spark, name, rows):
    assert QUERIES[name](spark, FOLDER).count() == rows


def test_titles_meet_files(spark, tmp_path):
    rows = [(1, "circu4 algo", "es", "s", 11), (4, "nada", "es", "s", 4), (5, "nada", "es", "s", 4)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.id: r.html for r in QUERIES["j18_auxiliary"](spark, str(tmp_path)).collect()}
    assert got == {1: True, 4: True, 5: False}
