"""Queries over the scalar functions: on the corpus where SQL has the same operations, else on stated cases (tests)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafquarry.functions import dates, refs, text
from leafquarry.operators.resolver import resolved
from leafquarry.plans.domain import Tables, sql
from leafquarry.plans.registry import CASES, query

#: A white-space class, letters and marks for DuckDB.
FOLD = "strip_accents(replace(replace({}, 'º', 'o'), '°', 'o'))"


def cases(name: str, rows: list[tuple], f: Callable[..., Column]) -> None:
    """Stated arguments and results of f, for tests; the query of this name reads tables (see over_tables)."""
    CASES[name] = rows, f


def on_docs(name: str, columns: dict[str, Callable[[], Column]], body: str) -> None:
    """A query that projects docs to id and the columns."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return Tables(spark, folder).docs.select("id", *[make().alias(c) for c, make in columns.items()])

    query(name, sql(body))(run)


def c(name: str) -> Column:
    return F.col(name)


on_docs("t01_collapse", {"tidy": lambda: text.collapse(c("contenido"))}, r"SELECT id, trim(regexp_replace(contenido, '\s+', ' ', 'g')) AS tidy FROM docs")
on_docs(
    "t03_fingerprint",
    {"fp": lambda: text.fingerprint(c("contenido"))},
    "SELECT id, regexp_replace(lower(strip_accents(contenido)), '[^a-z0-9]+', '', 'g') AS fp FROM docs",
)
on_docs(
    "t02_display",
    {"shown": lambda: text.display(c("contenido"))},
    r"SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(contenido, '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS shown FROM docs",
)
on_docs(
    "t04_comparable",
    {"k": lambda: text.comparable(c("titulo"))},
    "SELECT id, lower(trim(regexp_replace(strip_accents(titulo), '[^0-9A-Za-z:]+', ' ', 'g'))) AS k FROM docs",
)
on_docs("t04_slug", {"slug": lambda: text.slug(c("titulo"))}, "SELECT id, coalesce(nullif(trim(regexp_replace(lower(replace(strip_accents(titulo), 'ß', '')), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'sin-slug') AS slug FROM docs")
on_docs("t05_safe_name", {"name": lambda: text.safe_name(c("titulo"))}, "SELECT id, coalesce(nullif(trim(regexp_replace(titulo, '[^0-9A-Za-z._-]+', '_', 'g'), '_'), ''), 'sin_nombre') AS name FROM docs")
on_docs(
    "t05_safe_slug", {"name": lambda: text.safe_slug(c("titulo"), most=20)}, "SELECT id, substr(coalesce(nullif(trim(regexp_replace(trim(regexp_replace(titulo, '\\s+', ' ', 'g')), '[^0-9A-Za-z._-]+', '_', 'g'), '._-'), ''), 'sin_codigo'), 1, 20) AS name FROM docs"
)
on_docs("t05_safe_segment", {"name": lambda: text.safe_segment(c("referencia"))}, "SELECT id, trim(regexp_replace(referencia, '[^0-9A-Za-z._-]+', '_', 'g'), '._-') AS name FROM docs")
on_docs(
    "t15_summary",
    {"summary": lambda: text.summary(c("contenido"))},
    r"SELECT id, substr(array_to_string(list_filter(list_transform(string_split(contenido, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 40)[1:5], ' '), 1, 800) AS summary FROM docs",
)
on_docs(
    "t18_highlight",
    {"marked": lambda: text.highlighted(c("contenido"), "the of mar")},
    "SELECT id, regexp_replace(regexp_replace(contenido, '(?i)(the)', '<mark>\\1</mark>', 'g'), '(?i)(mar)', '<mark>\\1</mark>', 'g') AS marked FROM docs",
)
on_docs("t19_truncate", {"cut": lambda: text.truncated(c("contenido"), 70)}, "SELECT id, CASE WHEN length(contenido) > 70 THEN substr(contenido, 1, 70) || '...' ELSE contenido END AS cut FROM docs")
on_docs(
    "t20_formal_type",
    {"name": lambda: text.formal_type(F.when(c("id") % 9 == 0, "mANUAL x").otherwise(c("tipo")))},
    "SELECT id, CASE WHEN id % 9 = 0 THEN 'Manual x' WHEN tipo = 'circular' THEN 'Circular' WHEN tipo = 'oficio' THEN 'Oficio' WHEN tipo = 'resolucion' THEN 'Resolucion Exenta' ELSE 'Jurisprudencia Judicial' END AS name FROM docs",
)
on_docs("t29_hash", {"h": lambda: F.md5(F.concat(F.lit("judicial:"), c("id").cast("string")))}, "SELECT id, md5('judicial:' || CAST(id AS VARCHAR)) AS h FROM docs")
on_docs("t30_paths", {"path": lambda: text.slashes(F.replace(c("pdf_local"), F.lit("/"), F.lit("\\")))}, "SELECT id, pdf_local AS path FROM docs")
on_docs(
    "t32_folders",
    {"path": lambda: text.file_path(c("tipo"), c("anio"), F.concat(c("numero"), F.lit(".pdf")), F.lower(c("subtema")))},
    """SELECT id, concat_ws('/', 'pdfs', tipo, CASE WHEN tipo = 'oficio' AND subtema = 'RENTA' THEN 'lir' WHEN tipo = 'oficio' AND subtema = 'OTRAS' THEN 'otras_normas' END,
       CAST(anio AS VARCHAR), numero || '.pdf') AS path FROM docs""",
)
on_docs("m01_pages", {"pages": lambda: text.pages_estimate(c("contenido"))}, "SELECT id, CAST(greatest(1, ceil(length(contenido) / 2800)) AS INT) AS pages FROM docs")
on_docs("m02_relevance", {"r": lambda: text.relevance(-c("id") / 7)}, "SELECT id, round(1 / (1 + abs(-id / 7)), 4) AS r FROM docs")
on_docs(
    "p19_headings",
    {"heading": lambda: text.is_heading(c("titulo")), "capital": lambda: text.is_capital_line(c("titulo"))},
    r"""SELECT id, coalesce(u / l, 0) >= 0.82 AND length(regexp_replace(titulo, '^\s+|\s+$', '', 'g')) >= 24 AS heading, coalesce(u / l, 0) >= 0.65 AS capital
        FROM (SELECT *, length(regexp_replace(titulo, '[^\p{Lu}]', '', 'g')) AS u, nullif(length(regexp_replace(titulo, '[^\p{L}]', '', 'g')), 0) AS l FROM docs)""",
)
on_docs(
    "p17_scanned",
    {"scanned": lambda: text.looks_scanned(c("contenido"), c("paginas"))},
    r"""SELECT id, paginas > 0 AND (length(t) < 700 OR len(regexp_extract_all(t, '[A-Za-z0-9]{4,}')) < 90) AS scanned
        FROM (SELECT *, trim(regexp_replace(contenido, '\s+', ' ', 'g')) AS t FROM docs)""",
)
on_docs(
    "t13_ocr_score",
    {"score": lambda: text.ocr_score(c("contenido")).cast("bigint")},
    r"""SELECT id, CAST(4 * len(regexp_extract_all(t, '[A-Za-zÀ-ſ0-9]{3,}')) + 1 - 2 * (length(t) - length(replace(t, '?', ''))) - 4 * (length(t) - length(replace(t, chr(65533), ''))) AS BIGINT) AS score
        FROM (SELECT id, trim(regexp_replace(contenido, '\s+', ' ', 'g')) AS t FROM docs)""",
)
on_docs(
    "t14_line_repeats",
    {"lines": lambda: F.array_join(text.without_repeats(F.split(c("contenido"), "[. ]")), "|")},
    """SELECT id, array_to_string(list_filter(f, lambda x, i: i = 1 OR x <> f[i - 1]), '|') AS lines
       FROM (SELECT id, list_filter(string_split_regex(contenido, '[. ]'), lambda x: x <> '') AS f FROM docs)""",
)
on_docs("e01_law_codes", {"laws": lambda: F.array_join(refs.law_codes(c("contenido")), ",")}, r"""
SELECT id, array_to_string(list_filter([
  CASE WHEN regexp_matches(contenido, '(?i)c[oó]digo\s+tributario|(^|[^\p{L}\p{N}_])ct($|[^\p{L}\p{N}_])') THEN 'CT' END,
  CASE WHEN regexp_matches(contenido, '(?i)(^|[^\p{L}\p{N}_])lir($|[^\p{L}\p{N}_])') THEN 'LIR' END,
  CASE WHEN regexp_matches(contenido, '(?i)(^|[^\p{L}\p{N}_])livs($|[^\p{L}\p{N}_])') THEN 'LIVS' END,
  CASE WHEN regexp_matches(contenido, '(?i)(^|[^\p{L}\p{N}_])ite($|[^\p{L}\p{N}_])') THEN 'ITE' END,
  CASE WHEN regexp_matches(contenido, '(?i)(^|[^\p{L}\p{N}_])lhd($|[^\p{L}\p{N}_])') THEN 'LHD' END,
  CASE WHEN regexp_matches(contenido, '(?i)(^|[^\p{L}\p{N}_])lit($|[^\p{L}\p{N}_])') THEN 'LIT' END,
  CASE WHEN regexp_matches(contenido, '(?i)(^|[^\p{L}\p{N}_])ft($|[^\p{L}\p{N}_])') THEN 'FT' END,
  CASE WHEN regexp_matches(contenido, '(?i)(^|[^\p{L}\p{N}_])ocn($|[^\p{L}\p{N}_])') THEN 'OCN' END,
  CASE WHEN regexp_matches(contenido, '(?i)(^|[^\p{L}\p{N}_])ci($|[^\p{L}\p{N}_])') THEN 'CI' END], lambda x: x IS NOT NULL), ',') AS laws FROM docs""")
on_docs("e02_mentions", {"n": lambda: F.size(refs.mentions(c("contenido"))), "first": lambda: F.get(refs.mentions(c("contenido")), 0)}, "SELECT id, CAST(1 AS INT) AS n, CAST(id % 120 + 1 AS VARCHAR) AS first FROM docs")
on_docs(
    "e06_reference",
    {"ref": lambda: refs.serialised(refs.reference(F.element_at(F.array(F.lit("lir"), F.lit("LTE"), F.lit("zz")), (c("id") % 3 + 1).cast("int")), c("numero")))},
    """SELECT id, CASE WHEN id % 3 = 2 THEN '{"cuerpo":null,"articulo":"' || numero || '","clave":null,"label":"Art. ' || numero || ' (ambiguo)","slug":"art-' || numero || '","ambigua":true}'
       ELSE '{"cuerpo":"' || l || '","articulo":"' || numero || '","clave":"' || l || ':' || numero || '","label":"Art. ' || numero || ' ' || l || '","slug":"' || lower(l) || '-art-' || numero || '","ambigua":false}' END AS ref
       FROM (SELECT *, CASE id % 3 WHEN 0 THEN 'LIR' ELSE 'ITE' END AS l FROM docs)""",
)
on_docs("e14_file_key", {"key": lambda: refs.file_key(c("tipo"), c("anio"), F.lpad(c("numero"), 5, "0"))}, "SELECT id, tipo || '|' || CAST(coalesce(anio, 0) AS VARCHAR) || '|' || numero AS key FROM docs")
on_docs("e17_blob", {"blob": lambda: refs.blob_id(c("url_sii"))}, "SELECT id, regexp_extract(url_sii, 'id=([^&]+)', 1) AS blob FROM docs")
on_docs(
    "e19_office_branch",
    {"folder": lambda: refs.office_category(c("tipo"), F.when(c("id") % 3 == 0, c("subtema")), c("subtema")), "prefix": lambda: refs.office_prefix(c("tipo"), c("subtema"))},
    """SELECT id, CASE WHEN upper(subtema) LIKE 'RENTA%' THEN 'lir' WHEN upper(subtema) LIKE 'IVA%' THEN 'iva' ELSE 'otras_normas' END AS folder,
       CASE WHEN subtema = 'RENTA' THEN 'RENTA' ELSE 'OTRAS' END AS prefix FROM docs""",
)
on_docs(
    "f01_text_date",
    {"day": lambda: dates.text_date(c("contenido"))},
    "SELECT id, CAST(1995 + id % 32 AS VARCHAR) || '-03-' || lpad(CAST(id % 28 + 1 AS VARCHAR), 2, '0') AS day FROM docs",
)
on_docs(
    "f04_api_date",
    {"day": lambda: dates.api_date(F.when(c("id") % 2 == 0, c("fecha")).otherwise(F.concat_ws("/", F.lit("7"), c("id") % 12 + 1, F.lit("2001"))), c("anio"))},
    "SELECT id, CASE WHEN id % 2 = 1 THEN '2001-' || lpad(CAST(id % 12 + 1 AS VARCHAR), 2, '0') || '-07' ELSE coalesce(fecha, CAST(anio AS VARCHAR) || '-01-01') END AS day FROM docs",
)
on_docs(
    "f06_document_date",
    {"day": lambda: dates.document_date(c("tipo"), F.when(c("id") % 8 == 1, F.lit("3/4/2010")), c("contenido"), c("numero"), c("anio"))},
    "SELECT id, CASE WHEN id % 8 = 1 THEN '2010-04-03' ELSE CAST(1995 + id % 32 AS VARCHAR) || '-03-' || lpad(CAST(id % 28 + 1 AS VARCHAR), 2, '0') END AS day FROM docs",
)


@query("e03_references", sql("SELECT id, CASE id % 3 WHEN 0 THEN 'LIR' WHEN 1 THEN 'LIVS' ELSE 'CT' END || ':' || CAST(id % 120 + 1 AS VARCHAR) AS clave FROM docs"))
def e03_references(spark: SparkSession, folder: str) -> DataFrame:
    """The references of every document's whole text; in the test tables only the sentence with which each begins holds one."""
    docs = Tables(spark, folder).docs.select("id", "contenido")
    return resolved(docs, "id", "contenido").select("id", F.explode("refs").alias("r")).select("id", F.col("r.clave").alias("clave"))


cases("e07_article", [("Artículo 31 N° 3", "31 N° 3"), ("art. 97 nº 2", "97 N° 2"), ("8 letra n", "8 letra N°"), ("  ART 5  bis , ", "5 bis"), ("31 no renta", "31 N° renta"), ("", ""), (None, "")], refs.article)
cases("e08_law_code", [("lte", "ITE"), ("otras", "OCN"), (" LIR ", "LIR"), ("X", None), ("", None), (None, None)], refs.law_code)
cases("e13_number", [("Circular N° 012 de 2001", "x", "12"), ("otra", "/a/circu007.htm", "7"), ("Circular nº45", None, "45"), ("nada", "nada.pdf", None)], refs.circular_number)
cases("e14_file_number", [("0031", "31"), ("031A", "31a"), ("N° 12", "no_12"), ("000", "0"), (" 7-b ", "7_b"), (None, "")], refs.file_number)
cases("e14_plain_number", [("N° 12", "12"), ("007", "7"), ("N.45b", "45b"), ("nro.9", "9"), (None, ""), ("abc", "abc")], refs.plain_number)
cases(
    "e15_stem_keys",
    [
        ("1999_circu028_original", "1999_28|1999_circu028|1999_circu028_original|28|circu28"),
        ("2001_07_ocr_raw", "2001|2001_07|2001_07_ocr|2001_07_ocr_raw|2001_7|7"),
        ("foo_12", "foo|foo_12"),
    ],
    lambda x: F.array_join(F.array_sort(refs.stem_keys(x)), "|"),
)
cases("e15_title_tokens", [("El Código de las Ventas y otras cosas más largas aquí", "codigo|ventas|otras|cosas|largas")], lambda x: F.array_join(refs.title_tokens(x), "|"))
cases("e10_article_blob", [("31, 33 y 41", "31|33|41"), ("artículo 5 bis y art. 7", "5 bis|7"), ("97 N° 2", "97 N° 2"), ("", "")], lambda x: F.array_join(refs.article_blob(x), "|"))
cases("e18_court", [("1ª Sala Corte Suprema", "Corte Suprema"), ("TRIBUNAL ORAL en lo Penal", "Tribunal Oral en lo Penal"), ("Juzgado de Garantía de X", "Juzgado de Garantia"), (None, "Otros")], refs.court)
cases(
    "e05_parse",
    [
        ('[{"cuerpo":"LIR","articulo":"31"},{"cuerpo":"LIR","articulo":"31 "},{"cuerpo":"X","articulo":"2"},"7"]', "LIR:31|AMB:2|AMB:7"),
        ("artículo 9", "AMB:9"),
        (None, ""),
        ('[{"cuerpo":"CT","articulo":"1","ambigua":true}]', "AMB:1"),
    ],
    lambda x: F.array_join(F.transform(refs.parsed(x), refs.key_of), "|"),
)
cases("e09_orders", [("ct,lir,X,otros,LIR", "CT,LIR,OCN|CT,LIR,OCN"), ("lir,ct,lte", "CT,LIR,ITE|LIR,CT,ITE")], lambda x: F.concat(F.array_join(refs.laws_in_order(F.split(x, ",")), ","), F.lit("|"), F.array_join(refs.laws_as_given(F.split(x, ",")), ",")))
cases("e11_chips", [("LIR", "31", "Art. 31 LIR"), ("X", "31", "Art. 31 ambiguo")], lambda a, b: refs.chip(refs.reference(a, b)))
cases("f01_cases", [("Santiago, 5 de Marzo de 2020", "2020-03-05"), ("2021-07-09 x", "2021-07-09"), ("1 de setiembre de 2019", None), ("nada", None)], dates.text_date)
cases("f02_months", [("Setiembre", "09"), ("enero", "01"), ("foo", None)], dates.month)
cases("f03_circular_date", [("1 de setiembre del 2019", 2019, "2019-09-01"), ("3 de foo de 2001", 1999, "1999-01-01"), ("", 2000, "2000-01-01")], dates.circular_date)
cases("f04_cases", [("5/3/2020", 1, "2020-03-05"), ("2020-03-05T10", 1, "2020-03-05T10"), (None, 1998, "1998-01-01"), ("5-3-2020", 1998, "1998-01-01")], dates.api_date)
cases(
    "f05_office_date",
    [
        ("ORD. N° 603, DE 05.03.2026", "603", "2026-03-05"),
        ("x OFICIO ORDINARIO N°7 DE 1/2/2003", "7", "2003-02-01"),
        ("nº 12 de 3-4-2005; ORD. N° 9, DE 01.01.2001", "12", "2005-04-03"),
        ("ORD. Nº 77 DE 09.10.2011", "5", "2011-10-09"),
        ("nada", "5", None),
        ("N° 1.5 DE 1.1.2001", "1+5", None),
    ],
    dates.office_date,
)
cases("o04_leading_number", [("0603a", "603"), (" 12", "12"), ("x1", "0"), ("-5b", "-5")], dates.leading_number)
cases("t10_repairs", [("Ã¡rbol APLICACI?N&nbsp;x", "árbol APLICACION x"), ("a\x92b\x93", "a'b\"")], text.repaired)
cases("t12_ocr", [("RESO-\nLUCION N? 5", "RESOLUCIÓN Nº 5"), ("a  b \n\n\n\n c", "a b\n\nc"), ("AN~O N°7", "AÑO Nº 7"), (None, "")], text.ocr_text)
cases("p18_noise", [("Home | x", "true"), ("[1], [2]", "true"), ("Circulares 1999", "true"), ("texto", "false"), ("  ", "true")], text.is_noise)
cases("p20_redundant", [("Título Uno", "titulo uno dos", "true"), ("otra", "titulo", "false"), ("HOME x", "y", "true"), ("--", "y", "true")], text.is_redundant)
cases("t16_preview", [("HOME\nTitulo\nORD. N° 5\nPRIMERA LINEA EN MAYUSCULAS LARGA\ntexto uno\n\n\nHOME", "Titulo", "Ref", "texto uno\n\nHOME"), ("Titulo", "Titulo", "x", "Titulo")], text.preview)
cases("t17_summary", [("Titulo aqui y mas", "cuerpo\nsegunda", "Titulo aqui", "Ref 99", "cuerpo segunda"), ("resumen\nTitulo", "c", "Titulo", "Ref 99", "resumen"), ("", "solo", "Tema", "Ref 99", "solo")], text.display_summary)
cases("t17_subject", [("Un Tema", "un tema", ""), ("Un  Tema", "otro", "Un Tema")], text.display_subject)
cases("t27_object", [('x {"a": 1} y', '{"a":1}'), ("{bad", None), ("nada", None)], lambda x: F.to_json(text.first_object(x)))
cases("t28_evidence", [("a" * 130 + "\n\n" + "a" * 170 + "\n\ncorto\n\n" + "b" * 600, "Cita 1:500")], lambda x: F.array_join(F.transform(text.evidence(x), lambda e: F.concat(e["label"], F.lit(":"), F.length(e["excerpt"]).cast("string"))), "|"))
cases("t26_json_list", [('["a","b"]', "a|b"), ("{bad", ""), (None, ""), ("[]", "")], lambda x: F.array_join(text.json_list(x), "|"))
cases("u05_unique", [("a, A ,b,,a  c,A c", "a|b|a c")], lambda x: F.array_join(text.unique_list(F.split(x, ",")), "|"))
cases("u07_ids", [("3, 1,3,x,2", "3,1,2")], lambda x: F.array_join(F.array_distinct(F.array_compact(F.transform(F.split(x, ","), lambda v: F.trim(v).try_cast("int")))).cast("array<string>"), ","))
cases("t31_api_summary", [("<p>a<br/>b</p>\n c", "a b c"), (None, "")], text.api_summary)
cases("t22_keywords", [("a|b|A", "a | b"), ("", None)], lambda x: refs.keywords(F.split(x, r"\|")))
cases("t11_decoding", [("Cafe 41f1", "Cafe 41f1"), ("señal", "señal")], lambda x: text.best_decoding(F.encode(x, "UTF-8")))
cases("t06_html", [("<p>a<br>b &amp; c</p><p>d&nbsp;e</p>", "a\nb & c\n\n d e")], text.html_to_text)
cases("t07_html", [("<h1>x</h1><script>y</script><p>CIRCULAR N° 5</p><table><tr><td>a</td><td>b</td></tr></table>", "CIRCULAR N° 5\na | b")], text.readable_html)
cases(
    "t08_html",
    [("<html><head><title>q</title></head><body><!-- c --><p>Circular Uno</p><p>Home</p><p>linea</p><p>linea</p><p>MATERIA: tema</p>fin</body>", "Circular Uno", "tema", "linea\nfin")],
    text.html_body,
)
cases("t09_title", [("<title> Un  tit&oacute;lo </title><meta name=\"description\" content=\"MATERIA: algo\">", "Un titólo|algo")], lambda x: F.concat(text.html_title(x), F.lit("|"), text.html_description(x)))


@query("t21_citations", sql("""
SELECT id, CASE WHEN tipo = 'judicial' THEN referencia ELSE f || ' N' || numero || ' de ' || coalesce(CAST(anio AS VARCHAR), 'None') || ' del SII' END AS cita_corta,
  CASE WHEN tipo = 'judicial' THEN 'En ' || referencia || ', de fecha ' || coalesce(fecha, CAST(anio AS VARCHAR), 'None') || ', se sostuvo que: "' || q || '..."'
       ELSE 'En virtud de lo establecido en ' || f || ' N' || numero || ' de fecha ' || coalesce(fecha, CAST(anio AS VARCHAR), 'None') || ', emanada del Servicio de Impuestos Internos, en materia de '
            || coalesce(nullif(materia, ''), 'normativa tributaria') || ', dicho organismo ha señalado que: "' || q || '..."' END AS cita_larga
FROM (SELECT *, CASE tipo WHEN 'circular' THEN 'Circular' WHEN 'oficio' THEN 'Oficio' WHEN 'resolucion' THEN 'Resolucion Exenta' END AS f,
        substr(coalesce(nullif(resumen, ''), contenido), 1, 400) AS q FROM docs)"""))
def t21_citations(spark: SparkSession, folder: str) -> DataFrame:
    names = {n: n for n in ("tipo", "numero", "anio", "fecha", "materia", "referencia", "resumen", "contenido")} | {"url": "url_sii"}
    made = text.citations({k: F.col(v) for k, v in names.items()})
    return Tables(spark, folder).docs.select("id", made["cita_corta"].alias("cita_corta"), made["cita_larga"].alias("cita_larga"))
