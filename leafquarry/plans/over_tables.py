"""Scalar operators over every row of a table: with SQL where the arguments are made from ids, whole texts else."""

from __future__ import annotations

import functools

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafquarry.functions import dates, records, refs, text
from leafquarry.operators import audit
from leafquarry.operators.resolver import references
from leafquarry.plans.ingest import HTML_TEXT, shown, unescaped_sql
from leafquarry.plans.relational import q
from leafquarry.plans.scalars import on_docs
from leafquarry.sources import html_index, page_elements, pdf

c = F.col


def s(*parts):
    """A string of literals (str) and columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def pick(*values):
    """One of the values, by id."""
    return F.element_at(F.array(*[F.lit(v).cast("string") if v is None or isinstance(v, str) else v for v in values]), (c("id") % len(values) + 1).cast("int"))


def bars(x):
    return F.array_join(x, "|")


def padded(x, width):
    return F.lpad(x.cast("string"), width, "0")


N, X, M, D, YEAR = "CAST(id % 120 + 1 AS VARCHAR)", "CAST(id % 120 + 201 AS VARCHAR)", "CAST(id % 12 + 1 AS VARCHAR)", "CAST(id % 28 + 1 AS VARCHAR)", "CAST(1995 + id % 32 AS VARCHAR)"


class Number:
    """A number made from the id; its column is made when a query is."""

    def __init__(self, modulus, first):
        self.modulus, self.first = modulus, first

    def column(self):
        return c("id") % self.modulus + self.first

    def cast(self, kind):
        return self.column().cast(kind)


n, x, m, d, year = Number(120, 1), Number(120, 201), Number(12, 1), Number(28, 1), Number(32, 1995)
DAY = f"{YEAR} || '-' || lpad({M}, 2, '0') || '-' || lpad({D}, 2, '0')"
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")


def made(name, make, body):
    """id, result of an expression over docs, against SQL for the result."""
    on_docs(name, {"result": lambda: make().cast("string")}, f"SELECT id, {body} AS result FROM docs")


def words():
    """The words of the title."""
    return F.regexp_extract_all("titulo", F.lit(r"(\S+)"), 1)


def in_the_middle(x, column="contenido"):
    """The column's text with x in its middle."""
    t = F.coalesce(F.col(column), F.lit(""))
    half = F.floor(F.length(t) / 2).cast("int")
    return s(F.substr(t, F.lit(1), half), x, F.substr(t, half + 1))


def whole(name, table, key, make):
    """An operator over whole texts that SQL doesn't restate; tests hold it against stated cases."""
    q(name)(lambda t: (t.docs if table == "docs" else t.raw(table)).select(key, make().alias("result")))


# references and codes
made("e07_article", lambda: refs.article(pick(s("Artículo ", n, " nº ", m), s("art. ", n), s(" ART ", n, "  bis , "))), f"CASE id % 3 WHEN 0 THEN {N} || ' N° ' || {M} WHEN 1 THEN {N} ELSE {N} || ' bis' END")
made("e08_law_code", lambda: refs.law_code(pick("lte", "otras", " LIR ", "X", "", "ct", None)), "CASE id % 7 WHEN 0 THEN 'ITE' WHEN 1 THEN 'OCN' WHEN 2 THEN 'LIR' WHEN 5 THEN 'CT' END")
made("e13_number", lambda: refs.circular_number(pick(s("Circular N° 0", n, " de 2001"), "otra"), s("/a/circu0", n, ".htm")), N)
made("e14_file_number", lambda: refs.file_number(pick(padded(n, 6), s(padded(n, 6), "A"), s("N° ", n))), f"CASE id % 3 WHEN 0 THEN {N} WHEN 1 THEN {N} || 'a' ELSE 'no_' || {N} END")
made("e14_plain_number", lambda: refs.plain_number(pick(s("N° ", n), padded(n, 6), s("N.", n, "b"))), f"CASE id % 3 WHEN 2 THEN {N} || 'b' ELSE {N} END")
made(
    "e15_stem_keys",
    lambda: bars(F.array_sort(refs.stem_keys(s(year, "_circu0", x, "_original")))),
    f"array_to_string(list_sort([{YEAR} || '_' || {X}, {YEAR} || '_circu0' || {X}, {YEAR} || '_circu0' || {X} || '_original', {X}, 'circu' || {X}]), '|')",
)
FOLDED = "trim(regexp_replace(translate(lower(trim(contenido)), 'áéíóúüñº°№', 'aeiouunoon'), '[^a-z0-9]+', '_', 'g'), '_')"
made("e15_title_tokens", lambda: bars(refs.title_tokens(c("contenido"))), f"array_to_string(list_filter(string_split({FOLDED}, '_'), lambda x: length(x) >= 4)[1:5], '|')")
made(
    "e10_article_blob",
    lambda: bars(refs.article_blob(pick(s(n, ", ", x, " y ", Number(120, 401)), s("artículo ", n, " bis y art. ", x), ""))),
    f"CASE id % 3 WHEN 0 THEN {N} || '|' || {X} || '|' || CAST(id % 120 + 401 AS VARCHAR) WHEN 1 THEN {N} || ' bis|' || {X} ELSE '' END",
)
made(
    "e18_court",
    lambda: refs.court(in_the_middle(pick("1ª Sala  CORTE\nSuprema", "TRIBUNAL ORAL en lo Penal", s("Juzgado de Garantía de X", n), ""))),
    "CASE id % 4 WHEN 0 THEN 'Corte Suprema' WHEN 1 THEN 'Tribunal Oral en lo Penal' WHEN 2 THEN 'Juzgado de Garantia' ELSE 'Otros' END",
)
made(
    "e05_parse",
    lambda: bars(
        F.transform(
            refs.parsed(
                pick(
                    s('[{"cuerpo":"LIR","articulo":"', n, '"},{"cuerpo":"LIR","articulo":"', n, ' "},"', n, '"]'),
                    s("artículo ", n),
                    s('[{"cuerpo":"CT","articulo":"', n, '","ambigua":true}]'),
                    None,
                )
            ),
            refs.key_of,
        )
    ),
    f"CASE id % 4 WHEN 0 THEN 'LIR:' || {N} || '|AMB:' || {N} WHEN 3 THEN '' ELSE 'AMB:' || {N} END",
)


def both_orders():
    laws = F.split(pick("ct,lir,X,otros,LIR", "lir,ct,lte"), ",")
    return s(F.array_join(refs.laws_in_order(laws), ","), "|", F.array_join(refs.laws_as_given(laws), ","))


made("e09_orders", both_orders, "CASE id % 2 WHEN 0 THEN 'CT,LIR,OCN|CT,LIR,OCN' ELSE 'CT,LIR,ITE|LIR,CT,ITE' END")
made("e11_chips", lambda: refs.chip(refs.reference(pick("LIR", "X"), n.cast("string"))), f"'Art. ' || {N} || CASE id % 2 WHEN 0 THEN ' LIR' ELSE ' ambiguo' END")
made("e04_exact_refs", lambda: bars(F.transform(F.slice(refs.exact(references(c("contenido"))), 1, 30), refs.key_of)), f"CASE id % 3 WHEN 0 THEN 'LIR' WHEN 1 THEN 'LIVS' ELSE 'CT' END || ':' || {N}")

# dates and numbers
made("f02_months", lambda: dates.month(F.initcap(pick(*MONTHS))), f"lpad({M}, 2, '0')")
made("f03_circular_date", lambda: dates.circular_date(F.concat(c("titulo"), in_the_middle(pick(s(" ", d, " de ", pick(*MONTHS), "\n del ", year), s(d, " de foo de ", year), ""), "resumen")), year.column()), f"CASE id % 3 WHEN 0 THEN {DAY} ELSE {YEAR} || '-01-01' END")
made(
    "f05_office_date",
    lambda: dates.office_date(pick(s("ORD. N° ", n, ", DE ", padded(d, 2), ".", padded(m, 2), ".", year), s("x OFICIO ORDINARIO N°", n, " DE ", d, "/", m, "/", year), "nada"), n.cast("string")),
    f"CASE id % 3 WHEN 2 THEN NULL ELSE {DAY} END",
)
NUMBER_FIRST = "CAST(CAST(regexp_extract(contenido, '[0-9]+') AS BIGINT) AS VARCHAR)"


def leading_numbers():
    """Of the text from its first digit on, and of the whole text after a number with zeros, a blank or a sign, or after no number."""
    t = F.coalesce(c("contenido"), F.lit(""))
    told = dates.leading_number(pick(s("0", n, "a", t), s(" ", n, " ", t), s("x", n, t), s("-", n, "b", t)))
    return s(dates.leading_number(F.regexp_extract(t, r"(?s)\d.*", 0)), "|", told)


made("o04_leading_number", leading_numbers, f"coalesce({NUMBER_FIRST}, '0') || '|' || CASE id % 4 WHEN 2 THEN '0' WHEN 3 THEN '-' || {N} ELSE {N} END")

# texts
MANGLED = (("á", "Ã¡"), ("é", "Ã©"), ("ó", "Ã³"), ("ñ", "Ã±"), ("  ", "&nbsp; "))
made(
    "t10_repairs",
    lambda: text.repaired(s(functools.reduce(lambda x, m: F.replace(x, F.lit(m[0]), F.lit(m[1])), MANGLED, c("contenido")), " APLICACI?N")),
    "contenido || ' APLICACION'",
)
whole("t12_ocr", "docs", "id", lambda: text.ocr_text(c("contenido")))
NOISY = r"x IN ('', 'Home', '|', 'Inicio') OR starts_with(x, 'Home |') OR regexp_matches(x, '^([[][0-9]+[]],?\s*)+$') OR regexp_matches(x, '(?i)^circulares\s+[0-9]{4}$')"
made(
    "p18_noise",
    lambda: F.size(F.filter(F.split(s(c("contenido"), "\nHome | x\n\t[", n, "],  [2]\nCirculares  ", year, "\nInicio\n"), "\n", -1), text.is_noise)),
    rf"""len(list_filter(list_transform(string_split(contenido || chr(10) || 'Home | x' || chr(10) || chr(9) || '[1],  [2]' || chr(10) || 'Circulares  2000' || chr(10) || 'Inicio' || chr(10), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: {NOISY}))""",
)
whole("p20_redundant", "docs", "id", lambda: text.is_redundant(c("titulo"), c("contenido")))
whole("t16_preview", "docs", "id", lambda: text.preview(c("contenido"), c("titulo"), c("referencia")))
whole("t17_summary", "docs", "id", lambda: text.display_summary(c("resumen"), c("contenido"), c("titulo"), c("referencia")))
whole("t17_subject", "docs", "id", lambda: text.display_subject(c("contenido"), c("titulo")))
q("t27_object", "SELECT event_id, replace(replace(props, ': ', ':'), ', ', ',') AS result FROM events")(lambda t: t.raw("events").select("event_id", F.to_json(text.first_object(s("x ", c("props"), " y"))).alias("result")))
made(
    "t28_evidence",
    lambda: bars(F.transform(text.evidence(F.replace(c("contenido"), F.lit("\n"), F.lit(" \n\n"))), lambda x: s(x["label"], ":", x["excerpt"]))),
    r"""CASE WHEN length(trim(regexp_replace(contenido, '\s+', ' ', 'g'))) >= 120 THEN 'Cita 1:' || substr(trim(regexp_replace(contenido, '\s+', ' ', 'g')), 1, 500) ELSE '' END""",
)
WORDS = r"regexp_extract_all(titulo, '\S+')"
made("t26_json_list", lambda: bars(text.json_list(pick(F.to_json(words()), F.substring(F.to_json(words()), 1, 5), None, "[]"))), f"CASE id % 4 WHEN 0 THEN array_to_string({WORDS}, '|') ELSE '' END")
UNIQUE = f"""(SELECT coalesce(string_agg(w, '%s' ORDER BY i), '') FROM (SELECT w, i, row_number() OVER (PARTITION BY lower(w) ORDER BY i) AS k FROM (SELECT unnest({WORDS}) AS w, generate_subscripts({WORDS}, 1) AS i)) WHERE k = 1)"""
made("u05_unique", lambda: bars(text.unique_list(words())), UNIQUE % "|")
made("u07_ids", lambda: F.array_join(F.array_distinct(F.array_compact(F.transform(F.split(s(n, ", 500,", n, ",x,501"), ","), lambda v: F.trim(v).try_cast("int")))).cast("array<string>"), ","), f"{N} || ',500,501'")
q("t31_api_summary", r"SELECT page_id, substr(trim(regexp_replace(regexp_replace(html, '<br ?/?>|</?p>', ' ', 'g'), '\s+', ' ', 'g')), 1, 180) AS result FROM pages")(lambda t: t.raw("pages").select("page_id", text.api_summary(c("html")).alias("result")))
made("t22_keywords", lambda: refs.keywords(words()), f"nullif({UNIQUE % ' | '}, '')")
made("t11_decoding", lambda: text.best_decoding(F.encode(c("contenido"), "UTF-8")), "contenido")

# pages
q("t06_html", HTML_TEXT.format("page_id", "result"))(lambda t: t.raw("pages").select("page_id", text.html_to_text(c("html")).alias("result")))
READABLE = r"regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g')"
READABLE = rf"regexp_replace(regexp_replace({READABLE}, '(?i)</t[dh]\s*>\s*<t[dh][^>]*>', ' | ', 'g'), '(?i)<br[^>]*>|</(p|div|li|tr|h[1-6])\s*>', chr(10), 'g')"
READABLE = unescaped_sql(f"regexp_replace({READABLE}, '<[^>]+>', ' ', 'g')")
READABLE = rf"regexp_replace(regexp_replace(regexp_replace({READABLE}, '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
READABLE = rf"SELECT page_id, regexp_replace(CASE WHEN regexp_matches(x, '(?i)circular\s+n') THEN substr(x, length(regexp_extract(x, '(?is)^(.*?)circular\s+n', 1)) + 1) ELSE x END, '^\s+|\s+$', '', 'g') AS {{}} FROM (SELECT page_id, {READABLE.replace('{', '{{').replace('}', '}}')} AS x FROM pages)"
q("t07_html", READABLE.format("result"))(lambda t: t.raw("pages").select("page_id", text.readable_html(c("html")).alias("result")))
whole("t08_html", "pages", "page_id", lambda: text.html_body(c("html"), text.html_title(c("html")), F.lit("")))
q("s28_detail_text", f"SELECT * FROM ({READABLE.format('texto')}) WHERE length(texto) >= 80")(lambda t: t.raw("pages").select("page_id", text.readable_html(c("html")).alias("texto")).filter(F.length("texto") >= 80))
TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
for reference, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    TITLE = f"replace({TITLE}, '{reference}', '{letter}')"
q("t09_title", rf"SELECT page_id, trim(regexp_replace({TITLE}, '\s+', ' ', 'g')) AS result FROM pages")(lambda t: t.raw("pages").select("page_id", text.html_title(c("html")).alias("result")))

# index pages and files
made(
    "s21_file_keys",
    lambda: audit.file_keys(pick(s("circular_", year, "_", padded(n, 4), ".pdf"), s("circular_historica_", year, "_circu", n, "_scan.pdf"), s("judicial_", year, "_ROL_1-2_id", n, ".PDF"), s("x", n, ".pdf"))),
    f"CASE id % 4 WHEN 2 THEN 'judicial_sii|' || {YEAR} || '|' || {N} WHEN 3 THEN NULL ELSE 'circular|' || {YEAR} || '|' || {N} END",
)
LONG_URL, SHORT_URL = f"'http://h/' || {YEAR} || '/indcir' || {YEAR} || '.htm'", f"'http://h/' || {YEAR} || '/indcir' || substr({YEAR}, 3) || '.htm'"
made("s04_index_urls", lambda: bars(html_index.index_urls(F.lit("http://h"), year.column())), f"{LONG_URL} || '|' || {LONG_URL} || 'l' || CASE WHEN 1995 + id % 32 < 2000 THEN '|' || {SHORT_URL} || '|' || {SHORT_URL} || 'l' ELSE '' END")


def index_page():
    first = s('<h5><a href="circu', n, '.pdf">Circular N° ', n, " del ", d, " de ", pick(*MONTHS), " de ", year, "</a></h5><p>Sobre ", c("referencia"), "</p>")
    return s(first, '<h5><a href="x/', n, '.htm">Circular N°', x, "</a></h5>")


made(
    "s13_index_rows",
    lambda: shown(html_index.index_rows(index_page(), F.lit("http://h/a/i.htm"), F.lit(2015).cast("bigint"))),
    f"{N} || ',Sobre ' || referencia || ',' || {DAY} || ',http://h/a/circu' || {N} || '.pdf|' || {X} || ',,2015-01-01,http://h/a/x/' || {N} || '.htm'",
)


def index_pages(t, item):
    """Index pages of 200 documents' items each, in the order of ids, with what such pages have besides."""
    rows = t.docs.where("anio IS NOT NULL").select((F.floor(c("id") / 200)).alias("page"), "id", s(*item).alias("item"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "item"))), lambda x: x["item"]), "\n")
    return rows.groupBy("page").agg(s("<html><head><style>h5 > a</style></head><body><table><tr><td><!-- <a href=no>Circular N 0</a> -->", body, "<script>var x = '<a>';</script></table>").alias("html"))


def head():
    return s("Circular N° ", c("id"), " del ", c("id") % 28 + 1, " de marzo de ", c("anio"))


def escaped(x):
    return F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


PAGE_BASE = "http://h/a/i.htm"
SQUEEZED = r"trim(regexp_replace(coalesce(titulo, ''), '\s+', ' ', 'g'))"
DATED = "anio || '-03-' || lpad(CAST(id % 28 + 1 AS VARCHAR), 2, '0')"
COLUMNS = ("page", "numero", "titulo", "descripcion", "fecha", "url_pdf", "url_detalle")
q("s11_modern_pages", f"""SELECT id // 200 AS page, CAST(id AS VARCHAR) AS numero, 'Circular N° ' || id || ' del ' || (id % 28 + 1) || ' de marzo de ' || anio AS titulo, {SQUEEZED} AS descripcion, {DATED} AS fecha,
   CASE WHEN id % 2 = 0 THEN 'http://h/a/c' || id || '.pdf' END AS url_pdf, CASE WHEN id % 2 = 1 THEN 'http://h/a/c' || id || '.htm' END AS url_detalle FROM docs WHERE anio IS NOT NULL""")(
    lambda t: page_elements.modern_rows(
        page_elements.elements(index_pages(t, ('<h5 title="a > b"><b><a class=x href=\'c', c("id"), pick(".pdf", ".htm"), "'>", head(), "</a></b></h5> <p>", escaped(c("titulo")), "</p><p>more</p>"))), F.lit(PAGE_BASE), F.lit(1990)
    ).select(*COLUMNS)
)
q("s12_legacy_pages", f"""SELECT id // 200 AS page, CAST(id AS VARCHAR) AS numero, 'Circular N° ' || id || ' del ' || (id % 28 + 1) || ' de marzo de ' || anio AS titulo, trim('sobre ' || {SQUEEZED}) AS descripcion, {DATED} AS fecha,
   CASE WHEN id % 2 = 0 THEN 'http://h/a/c' || id || '.pdf' END AS url_pdf, CASE WHEN id % 2 = 1 THEN 'http://h/a/c' || id || '.htm' END AS url_detalle FROM docs WHERE anio IS NOT NULL""")(
    lambda t: page_elements.legacy_rows(
        page_elements.elements(index_pages(t, ("<a href=o.htm>otro</a><a name=y>Circular N° 5</a><a href=c", c("id"), pick(".pdf", ".htm"), ">", head(), "</a> <i>sobre</i> ", escaped(c("titulo")), "<br>"))), F.lit(PAGE_BASE), F.lit(1990)
    ).select(*COLUMNS)
)
q("s14_resolutions", f"""SELECT id // 200 AS page, CAST(id AS VARCHAR) AS numero, 'Res. ' || id AS titulo, trim('Res. ' || id || regexp_replace(coalesce(titulo, ''), '^\\s+|\\s+$', '', 'g')) AS descripcion, '1990-01-01' AS fecha FROM docs WHERE anio IS NOT NULL""")(
    lambda t: page_elements.resolution_rows(page_elements.elements(index_pages(t, ('<ul><li><a href="/r/reso', c("id"), '.PDF">Res. ', c("id"), "</a>", escaped(c("titulo")), "</ul><a href=x.pdf>x</a>"))), F.lit(1990)).select(
        "page", "numero", "titulo", "descripcion", "fecha"
    )
)
q("s16_detail_pdf", "SELECT id // 200 AS page, 'http://h/a/' || min_by(id, id) || '.pdf?x=1' AS url_pdf FROM docs WHERE anio IS NOT NULL AND id % 7 = 3 GROUP BY 1")(
    lambda t: page_elements.detail_pdfs(
        page_elements.elements(index_pages(t, ("<a href=x.htm>", escaped(c("titulo")), "</a><iframe title='a.pdf > b' src=", c("id"), F.when(c("id") % 7 == 3, ".pdf?x=1").otherwise(".html"), "></iframe>"))), F.lit(PAGE_BASE), ["page"]
    )
)
q("s15_links_of_pages", r"""SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS place, h AS href, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text
   FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS h, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS x, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>'), 1) AS i FROM pages)""")(
    lambda t: page_elements.elements(t.raw("pages")).where("tag = 'a'").select("page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("n")) - 1).cast("bigint").alias("place"), "href", text.collapse(c("text")).alias("text"))
)
made("s17_prefixes", lambda: bars(html_index.prefixes(s("circu0", x, "a"))), f"'0' || {X} || '|' || {X} || '|circu0' || {X}")
made(
    "s17_pages",
    lambda: bars(F.array_sort(html_index.scanned_pages(s('<a href="circu', x, 'b.htm">b</a><a href="', x, 'a.html">a</a><a href="otro.htm">o</a>'), s("http://h/circu", x, ".htm")))),
    f"'http://h/' || {X} || 'a.html|http://h/circu' || {X} || '.htm|http://h/circu' || {X} || 'b.htm'",
)
made("s18_images", lambda: bars(html_index.page_images(s('<img src="', x, '_1.gif"><img width=600 src="x.jpg">'), s("http://h/circu", x, ".htm"))), f"'http://h/' || {X} || '_1.gif'")

# records and reports
made("k31_report_lines", lambda: records.report_line(year.column(), F.split(s("b", n, ",a", n), ","), F.array().cast("array<string>")), f"{YEAR} || ': faltan a' || {N} || ', b' || {N} || '; sobran -'")
made("t25_resolution_title", lambda: records.resolution_title(pick(s("x\nRESOLUCION EXENTA SOBRE ALGO\ny ", n), "corta"), n.cast("string")), f"CASE id % 2 WHEN 0 THEN 'RESOLUCION EXENTA SOBRE ALGO' ELSE 'Resolucion Exenta N' || {N} END")


def modern():
    none = F.lit(None).cast("string")
    r = records.modern_record({"tipo": F.lit("circular"), "numero": n.cast("string"), "anio": year.column(), "titulo": none, "prefijo": F.lit(""), "fecha": none, "texto": c("contenido")})
    return F.concat_ws("|", r["titulo"], r["referencia"], r["subtema"])


def historical():
    r = records.historical_record({"anio": year.column(), "numero": n.cast("string"), "titulo": F.lit(""), "materia": F.lit("tema"), "texto": F.lit("corto"), "escaneado": c("id") % 2 == 1})
    return F.concat_ws("|", r["titulo"], r["palabras_clave"])


made("t25_record", modern, f"'Circular N' || {N} || '|Circular N' || {N} || ' de ' || {YEAR} || '|'")
made("t24_record", historical, f"'Circular N' || {N} || ' de ' || {YEAR} || '|tema | circular historica' || CASE id % 2 WHEN 1 THEN ' | ocr' ELSE '' END")


def document_files(t):
    """Each document as a PDF file of one page that holds its whole text, in a composite font whose map to Unicode is the identity."""
    map_ = "1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange"
    before = (
        "%PDF-1.5\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 >> endobj\n"
        "3 0 obj << /Type /Page /Parent 2 0 R /Contents 6 0 R /Resources << /Font << /F1 4 0 R >> >> >> endobj\n"
        "4 0 obj << /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 5 0 R >> endobj\n"
        f"5 0 obj << >> stream\n{map_}\nendstream endobj\n6 0 obj << >> stream\nBT /F1 9 Tf 9 9 Td <"
    )
    return t.docs.select("id", s(before, F.hex(F.encode("contenido", "UTF-16BE")), "> Tj ET\nendstream endobj\n%%EOF").cast("binary").alias("content"))


q("m04_pdf_text", r"SELECT id, CAST(1 AS INT) AS pages, trim(regexp_replace(contenido, '\n{2,}', chr(10), 'g'), chr(10)) AS text FROM docs")(lambda t: pdf.texts(document_files(t), "id").select("id", "pages", "text"))
