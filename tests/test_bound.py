"""Values that expressions over lines and items share are computed once: plans name each costly step a bounded number of times."""

import re

import pytest
from pyspark.sql import functions as F

from leafquarry.functions import text


def steps(frame, name):
    """How often the plan of a frame calls a function."""
    return len(re.findall(rf"\b{name}\(", frame._jdf.queryExecution().analyzed().toString()))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "HOME\n" * 300 + "texto\n\n\n\nuno  dos \nHOME", "Titulo", "Ref"), (2, None, None, None), (3, "Ley  sombre x\nRESOLUCIÓNES\tEx. y", "ley sobre x", "")]
    return spark.createDataFrame(rows, "id int, contenido string, titulo string, referencia string")


def test_preview(docs):
    frame = docs.select("id", text.preview(F.col("contenido"), F.col("titulo"), F.col("referencia")).alias("x"))
    assert [r.x for r in sorted(frame.collect())] == ["texto\n\nuno dos\nHOME", "", "Resoluciones Ex. y"]
    assert steps(frame, "split") == 1  # the lines were split anew at each use


def test_summary(docs):
    frame = docs.select("id", text.display_summary(F.lit(None).cast("string"), F.col("contenido"), F.col("titulo"), F.col("referencia")).alias("x"))
    assert [r.x for r in sorted(frame.collect())] == ["texto uno dos", "", "Resoluciones Ex. y"]
    assert steps(frame, "split") == 2


def test_blanks(spark):
    """What strip, collapse and lines_joined leave, against the plain patterns."""
    spaces = [chr(x) for x in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]
    rows = [(f"{s}a{s}b{s}{s}c \t{s}",) for s in spaces] + [("",), (" ",), ("\t",), ("a \n\t b\t\n \nc  d \n\n \n\n",), (None,)]
    x = F.col("x")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r" *\n *", "\n"), r"\n{3,}", "\n\n")
    got = spark.createDataFrame(rows, "x string").select(
        text.strip(x).eqNullSafe(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")).alias("strip"),
        text.collapse(x).eqNullSafe(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))).alias("collapse"),
        text.lines_joined(x).eqNullSafe(plain).alias("lines"),
    )
    assert all(all(r) for r in got.collect())


def test_evidence(docs):
    frame = docs.select(text.evidence(F.col("contenido")).alias("x"))
    assert steps(frame, "split") == 1  # paragraphs were cut and tidied twice


def test_page_lines(spark):
    html = "<title>Circular N° 5</title><p>Uno</p> \t\n<p>Uno</p><p>CIRCULAR Circular N 5</p>Dos &amp; tres"
    frame = spark.createDataFrame([(html,)], "html string").select(text.html_body(F.col("html"), text.html_title(F.col("html")), F.lit("")).alias("x"))
    assert frame.first().x == "Uno\nCIRCULAR Circular N 5\nDos & tres"
    assert frame._jdf.queryExecution().analyzed().toString().count("Home |") == 1  # a page's lines were made and judged twice


def test_tokens(spark):
    from leafquarry.functions import refs

    x = F.col("x")
    rows = [("Nº° 12ab Ñandú_güe  áéíó,ú abcd №№№№ ÁRBOL efgh",), (None,), ("",), (" abc__abcd ",)]
    plain = F.slice(F.filter(F.split(text.folded(x), "_"), lambda t: F.length(t) >= 4), 1, 5)
    frame = spark.createDataFrame(rows, "x string").select(refs.title_tokens(x).alias("got"), plain.alias("wanted"))
    assert all(r.got == r.wanted for r in frame.collect())
    assert steps(frame.select("got"), "split") <= 1


def test_references_once(spark):
    from leafquarry.operators import resolver

    docs = spark.createDataFrame([(1, "El artículo 31 de la LIR; art. 2 del CT"), (1, "El artículo 31 de la LIR"), (2, "nada"), (3, None)], "id int, t string")
    rows = resolver.index_rows(docs.select("id", resolver.references(F.col("t")).alias("refs"), F.array(F.lit("LIR"), F.lit("CI"), F.lit("")).alias("laws")), "id", "laws", "refs")
    got = sorted((r.doc_id, r.ley, r.articulo or "") for r in rows.collect())
    assert got == [(1, "CI", ""), (1, "CI", ""), (1, "CT", "2"), (1, "LIR", "31"), (2, "CI", ""), (2, "LIR", ""), (3, "CI", ""), (3, "LIR", "")]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[;:]") == 1  # texts were cut, and their references found, for each of four uses
