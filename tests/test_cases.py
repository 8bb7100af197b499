"""Scalar functions on stated arguments."""

import html

import pytest
from pyspark.sql import functions as F

from leafquarry.functions.text import unescaped
from leafquarry.plans import catalogue  # noqa: F401  (registers the cases)
from leafquarry.plans.registry import CASES, QUERIES


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    rows, f = CASES[name]
    width = len(rows[0]) - 1
    names = [f"a{k}" for k in range(width)]
    kinds = ["bigint" if any(isinstance(r[k], int) for r in rows) else "string" for k in range(width)]
    frame = spark.createDataFrame([(n, *r[:width]) for n, r in enumerate(rows)], "n bigint, " + ", ".join(f"{a} {t}" for a, t in zip(names, kinds, strict=True)))
    got = frame.select("n", f(*map(F.col, names)).cast("string").alias("result")).collect()
    assert [r.result for r in sorted(got)] == [r[-1] for r in rows]


def test_every_case_has_a_query():
    covered = {"f01_cases": "f01_text_date", "f04_cases": "f04_api_date"}
    assert {covered.get(n, n) for n in CASES} <= set(QUERIES)


def test_references(spark):
    """Against the standard library, for references that end with a semicolon."""
    texts = ["resoluci&#243;n &Oacute;RGANO ping&uuml;ino &ldquo;x&rdquo; A&Ntilde;O", "&amp;lt; &#x1F600; &#150; & &foo; &#0; &#1114112; &#xD800;", "a&nbsp;b", "no reference", "", "&", "&lt;&gt;", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", unescaped(F.col("t")).alias("u")).collect()
    assert [r.u for r in sorted(got)] == [t if t is None else html.unescape(t) for t in texts]
