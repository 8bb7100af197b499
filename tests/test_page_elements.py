"""The walk over a page's tags: what a lenient tree gives for missing end tags, nested tables and odd attributes."""

import time

import pytest
from pyspark.sql import functions as F

from leafquarry.sources import page_elements as pe

MODERN = """<table><tr><td><table><tr><td><h5><a title="5 > 3" href='circu5.pdf'>Circular N&deg; 5 <b>del 3 de</b> marzo de 2015</a></h5>
<p>Sobre <i>algo</i> &amp; m&aacute;s<h5 class=x><a href=x/y.htm>Circular N° 6</a></h5><!-- <p>no --><div>no</div></table></td><td><h5>sin enlace</h5><h5><a>Circular N° 7</a></h5></table>"""
LEGACY = """<div>Antes <a href="circu07.htm">CIRCULAR N&#176; 07 del 1 de abril del 1999</a> trata de <b>algo</b><script>var a = "<a>";</script> y m&aacute;s <a href=o.htm>otro</a>
<p><a href="circu8.pdf">Circular N° 8</a><p>sigue</div><ul><li>Circular vieja: <b><a href="c9.htm">Circular N° 9</a></b> del fondo</ul>"""


def rows(page, tag):
    return [dict(zip([c.split()[0] for c in pe.ROW.split(", ")], r, strict=True)) for r in pe.told(page) if r[1] == tag]


def test_told():
    h = rows(MODERN, "h5")
    assert [(x["first_href"], x["first_text"]) for x in h] == [("circu5.pdf", "Circular N° 5 del 3 de marzo de 2015"), ("x/y.htm", "Circular N° 6"), (None, None), (None, "Circular N° 7")]
    assert h[0]["paragraph"].startswith("Sobrealgo& más") and h[1]["paragraph"] == ""  # an unclosed <p> holds what follows
    a = rows(LEGACY, "a")
    assert [x["after"] for x in a] == ["trata de algo y más", "Circular N° 8 sigue", "sigue", ""]
    assert a[3]["block"] == "Circular vieja: Circular N° 9 del fondo"
    assert rows('<p><a href="reso12.PDF">R 12</a> del <b>mes</b>', "a")[0]["item"] == "R 12delmes"
    assert rows(None, "a") == rows("", "a") == [] and rows("</p></a><img width=5 src=x>", "img")[0]["src"] == "x"
    assert rows("<a href=1>x<a href=2>y</a>", "a")[0]["text"] == "x y"


def test_lateral_join(spark):
    pages = spark.createDataFrame([(1, MODERN, 2015), (2, LEGACY, 1999), (3, None, 2000), (4, "", 2000)], "id int, html string, anio int")
    found = pe.elements(pages)
    base = F.lit("http://h/a/i.htm")
    new = {r.numero: r for r in pe.modern_rows(found, base, F.col("anio")).collect()}
    assert (new["5"].fecha, new["5"].url_pdf, new["6"].url_detalle, new["6"].fecha) == ("2015-03-03", "http://h/a/circu5.pdf", "http://h/a/x/y.htm", "2015-01-01") and len(new) == 3
    old = {r.numero: r for r in pe.legacy_rows(found.where("id = 2"), base, F.col("anio")).collect()}
    assert set(old) == {"7", "8", "9"} and old["7"].descripcion == "trata de algo y más" and old["7"].fecha == "1999-04-01"
    assert [r.url_pdf for r in pe.detail_pdfs(found, base, ["id"]).orderBy("id").collect()] == ["http://h/a/circu5.pdf", "http://h/a/circu8.pdf"]


@pytest.mark.parametrize("piece", ["<p>", "<a href=x>", "<div><a href='y'>z</a>", "<b", "<h5>", "</p>x", "<li>Circular <a href=q>N° 5</a>"])
def test_walk_takes_linear_time(piece):
    def took(n):
        began = time.process_time()
        for _ in pe.told(piece * (n // len(piece))):
            pass
        return time.process_time() - began

    # four times the page; a square would take sixteen times as long
    small, large = (min(took(n) for _ in range(3)) for n in (20_000, 80_000))
    assert large < 11 * small + 1
