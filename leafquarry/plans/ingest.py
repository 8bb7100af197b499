"""Queries over ingest, audits, index pages and incremental steps (K, R08, J17-J19, E16, S11-S18, W02)."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafquarry.functions import dates, refs
from leafquarry.functions.text import html_to_text
from leafquarry.operators import audit, ingest
from leafquarry.operators.resolver import index_rows, references
from leafquarry.plans.domain import LAST_YEAR, Tables
from leafquarry.plans.relational import q
from leafquarry.plans.scalars import cases
from leafquarry.sources import external, html_index
from leafquarry.sources.tables import ensure_columns, shared_folder
from leafquarry.streaming.incremental import classify_new, latest_progress, start_ingest

c = F.col


def base(t: Tables):
    """Two thirds of the documents; with batch every document, a third of them on both sides."""
    return t.docs.filter("id % 3 < 2").select("id", "hash_md5", "tipo", "numero", "anio", "contenido", "pdf_local", "paginas", "fuente")


def batch(t: Tables):
    """Records of other documents under the same identities, some unchanged, some not valid, some twice."""
    return t.docs.filter("id % 3 > 0").select(
        "hash_md5", "tipo", (c("numero").cast("int") % 100).cast("string").alias("numero"), "anio", F.when(c("id") % 13 > 0, c("contenido")).alias("contenido"), "pdf_local", "paginas", "fuente", c("id").alias("seq")
    )


CURRENT = ", cur AS (SELECT hash_md5, tipo, numero, anio, contenido, pdf_local, paginas, fuente FROM docs WHERE id % 3 < 2)"
BATCH = CURRENT + """, b AS (SELECT hash_md5, tipo, CAST(CAST(numero AS INT) % 100 AS VARCHAR) AS numero, anio, CASE WHEN id % 13 > 0 THEN contenido END AS contenido, pdf_local, paginas, fuente, id AS seq FROM docs WHERE id % 3 > 0),
 r AS (SELECT *, CASE WHEN trim(coalesce(contenido, '')) = '' THEN 'sin_contenido' WHEN coalesce(hash_md5, '') = '' THEN 'sin_hash' WHEN trim(coalesce(pdf_local, '')) = '' THEN 'sin_pdf' WHEN coalesce(paginas, 0) <= 0 THEN 'sin_paginas' END AS motivo FROM b),
 good AS (SELECT * FROM r WHERE motivo IS NULL)"""
UPSERT = BATCH + """, named AS (SELECT *, row_number() OVER (PARTITION BY tipo, numero, anio ORDER BY seq DESC) AS n FROM good WHERE tipo NOT IN ('oficio', 'judicial') AND anio IS NOT NULL),
 k AS (SELECT DISTINCT tipo, numero, anio FROM cur WHERE tipo NOT IN ('oficio', 'judicial') AND anio IS NOT NULL),
 changed AS (SELECT * FROM named WHERE n = 1 AND (tipo, numero, anio) IN (SELECT (tipo, numero, anio) FROM k)),
 fresh AS (SELECT hash_md5, tipo, numero, anio, seq FROM named WHERE n = 1 AND (tipo, numero, anio) NOT IN (SELECT (tipo, numero, anio) FROM k) UNION ALL SELECT hash_md5, tipo, numero, anio, seq FROM good WHERE tipo IN ('oficio', 'judicial') OR anio IS NULL),
 fresh1 AS (SELECT *, row_number() OVER (PARTITION BY hash_md5 ORDER BY seq) AS n FROM fresh WHERE hash_md5 NOT IN (SELECT hash_md5 FROM cur))
 SELECT hash_md5, tipo, numero, anio FROM cur c WHERE NOT EXISTS (SELECT 1 FROM changed x WHERE x.tipo = c.tipo AND x.numero = c.numero AND x.anio = c.anio)
 UNION ALL SELECT hash_md5, tipo, numero, anio FROM changed UNION ALL SELECT hash_md5, tipo, numero, anio FROM fresh1 WHERE n = 1"""
q("k01_reject_reasons", BATCH + " SELECT motivo, count(*) AS cnt FROM r GROUP BY motivo")(lambda t: batch(t).groupBy(ingest.reject_reason().alias("motivo")).agg(F.count(F.lit(1)).alias("cnt")))
q("k01_upsert", UPSERT)(lambda t: ingest.upserted(base(t), batch(t)).select("hash_md5", "tipo", "numero", "anio"))
q("k02_article_index", "SELECT id AS doc_id, CASE id % 3 WHEN 0 THEN 'LIR' WHEN 1 THEN 'LIVS' ELSE 'CT' END AS ley, CAST(id % 120 + 1 AS VARCHAR) AS articulo FROM docs UNION ALL SELECT id, 'FT', NULL FROM docs")(
    lambda t: index_rows(
        t.docs.select("id", references(c("contenido")).alias("refs"), F.array(F.lit("FT"), F.element_at(F.array(F.lit("LIR"), F.lit("LIVS"), F.lit("CT")), (c("id") % 3 + 1).cast("int"))).alias("leyes")), "id", "leyes", "refs"
    )
)


def planted(t: Tables):
    """Documents with references in the middle of their text: by a law's name, across a line end, without a law, and one twice."""
    body = F.coalesce(c("contenido"), F.lit(""))
    half = F.floor(F.length(body) / 2).cast("int")
    article = (c("id") % 150 + 1).cast("string")
    said = F.concat(
        F.lit(". Conforme al artículo "), article, F.lit(" letra b de la Ley sobre Impuesto  a la Renta, y al ART. "), (c("id") % 90 + 1).cast("string"),
        F.lit(" bis del Código\nTributario; véase el artículo 7; LIR: arts. "), article, F.lit(" letra B de la LIR;"),
    )
    return t.docs.select("id", F.concat(F.substr(body, F.lit(1), half), said, F.substr(body, half + 1)).alias("contenido"), c("contenido").alias("original"))


# the text's own first sentence cites an article of its own
OWN = "CASE id % 3 WHEN 0 THEN 'LIR' WHEN 1 THEN 'LIVS' ELSE 'CT' END || ':' || (id % 120 + 1)"
q("e03_planted", f"SELECT id, array_to_string([{OWN}, 'LIR:' || (id % 150 + 1) || ' letra b', 'CT:' || (id % 90 + 1) || ' bis', 'AMB:7'], '|') AS claves FROM docs")(
    lambda t: planted(t).select("id", F.array_join(F.transform(references(c("contenido")), refs.key_of), "|").alias("claves"))
)
q("k02_planted", f"""SELECT id AS doc_id, CASE id % 3 WHEN 0 THEN 'LIR' WHEN 1 THEN 'LIVS' ELSE 'CT' END AS ley, CAST(id % 120 + 1 AS VARCHAR) AS articulo FROM docs
   UNION SELECT id, 'LIR', (id % 150 + 1) || ' letra b' FROM docs UNION SELECT id, 'CT', (id % 90 + 1) || ' bis' FROM docs
   UNION SELECT id, 'LIVS', NULL FROM docs WHERE false""")(
    lambda t: index_rows(planted(t).select("id", references(c("contenido")).alias("refs"), F.array().cast("array<string>").alias("leyes")), "id", "leyes", "refs")
)
q("k04_last_write", "SELECT blob, max(id) AS doc_id FROM (SELECT regexp_extract(url_sii, 'id=([^&]+)', 1) AS blob, id FROM docs) GROUP BY blob")(
    lambda t: ingest.last_write(
        t.docs.groupBy(refs.blob_id(c("url_sii")).alias("blob")).agg(F.min("id").alias("doc_id")), t.docs.select(refs.blob_id(c("url_sii")).alias("blob"), c("id").alias("doc_id"), c("id").alias("seq")), ["blob"]
    )
)
q("k05_court_targets", "SELECT d.id, coalesce(j.doc_id, h.m) AS target, coalesce(j.doc_id, h.m) IS NOT NULL AS existed FROM docs d LEFT JOIN judicial_docs j ON j.sii_id = d.id + 99900 LEFT JOIN (SELECT hash_md5, min(id) AS m FROM docs GROUP BY 1) h USING (hash_md5) WHERE d.tipo = 'judicial'")(
    lambda t: ingest.court_targets(t.docs.filter("tipo = 'judicial'").select("id", "hash_md5", (c("id") + 99900).alias("sii_id")), t.judicial_docs, t.docs).select("id", "target", "existed")
)
q("k10_search_record", """SELECT conv_id, turn, '{"tipo":"oficio","anio":"' || CAST(turn AS VARCHAR) || '"}' AS filtros FROM historial""")(
    lambda t: t.historial.select("conv_id", "turn", ingest.search_record(c("termino"), {"tipo": F.lit("oficio"), "anio": c("turn").cast("string")}, c("resultados"))["filtros"].alias("filtros"))
)
q("k12_touched_cases", "SELECT c.id, max(n.fecha) AS fecha_modificacion FROM casos c LEFT JOIN caso_notas n ON n.caso_id = c.id GROUP BY c.id")(lambda t: ingest.touched(t.casos, t.caso_notas).select("id", "fecha_modificacion"))
q("k13_question_notes", "SELECT conv_id, 'FUENTES' || chr(10) || string_agg('- ' || role || ': ' || coalesce(nullif(substr(text, 1, 80), ''), 'Sin texto'), chr(10) ORDER BY turn, role, text) AS contenido FROM conversations GROUP BY conv_id")(
    lambda t: ingest.question_notes(t.raw("conversations"))
)
q("k16_deleted", "SELECT id FROM docs WHERE id % 9 <> 4")(lambda t: ingest.without(t.docs, t.docs.filter("id % 9 = 4")).select("id"))
q("k17_targets", "SELECT tipo, count(*) AS cnt FROM docs WHERE anio BETWEEN 2020 AND 2026 AND tipo <> 'judicial' GROUP BY tipo")(lambda t: t.docs.filter("anio BETWEEN 2020 AND 2026 AND tipo <> 'judicial'").groupBy("tipo").agg(F.count(F.lit(1)).alias("cnt")))
q("k18_kept_outside", "SELECT doc_id, articulo FROM articulos_idx WHERE doc_id IN (SELECT id FROM docs WHERE NOT (anio BETWEEN 2000 AND 2010 AND tipo IN ('circular', 'oficio')))")(
    lambda t: ingest.children(t.articulos_idx, ingest.kept_outside(t.docs, 2000, 2010, ["circular", "oficio"])).select("doc_id", "articulo")
)
q("k19_paths_filled", "SELECT d.id, coalesce(nullif(d.pdf_local, ''), j.pdf_local) AS pdf_local FROM docs d LEFT JOIN judicial_docs j ON j.doc_id = d.id")(lambda t: ingest.paths_filled(t.docs, t.judicial_docs).select("id", "pdf_local"))
q("k20_columns_added", "SELECT id, CAST(NULL AS VARCHAR) AS organo_emisor, fuente FROM docs")(lambda t: ensure_columns(ensure_columns(t.docs.select("id", "fuente"), {"organo_emisor": "string", "fuente": "string"}), {"organo_emisor": "string"}))
q("k29_dates_repaired", f"SELECT id, fecha, CAST(1995 + id % 32 AS VARCHAR) || '-03-' || lpad(CAST(id % 28 + 1 AS VARCHAR), 2, '0') AS nueva FROM docs WHERE tipo = 'oficio' AND (substr(fecha, 1, 4) > CAST(anio - 1 AS VARCHAR) OR substr(fecha, 1, 4) > '{LAST_YEAR}') AND fecha <> CAST(1995 + id % 32 AS VARCHAR) || '-03-' || lpad(CAST(id % 28 + 1 AS VARCHAR), 2, '0')")(
    lambda t: ingest.dates_repaired(t.docs.withColumn("anio", c("anio") - 1), dates.text_date(c("contenido")), LAST_YEAR).select("id", "fecha", "nueva")
)
q("r08_analysis", r"""SELECT id AS doc_id, CASE WHEN id % 4 = 0 THEN 'ready' WHEN length(trim(regexp_replace(contenido, '\s+\n', chr(10), 'g'))) < 400 THEN 'insufficient' ELSE 'fallback' END AS status, CASE WHEN id % 4 = 0 THEN 'guardado' END AS guardado FROM docs""")(
    lambda t: ingest.analysed(t.docs, t.docs.filter("id % 4 = 0").select(c("id").alias("doc_id"), F.lit("ready").alias("status"), F.md5("contenido").alias("source_hash"), F.lit("guardado").alias("summary_short"))).select(
        "doc_id", "status", F.when(c("summary_short") == "guardado", c("summary_short")).alias("guardado")
    )
)
q("w02_outcomes", """, k AS (SELECT * FROM docs WHERE id % 3 < 2), b AS (SELECT * FROM docs WHERE id % 3 > 0)
   SELECT id, CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.tipo = b.tipo AND k.numero = b.numero AND k.anio = b.anio) THEN 'identidad' WHEN url_sii IN (SELECT url_sii FROM k) THEN 'url'
     WHEN hash_md5 IN (SELECT hash_md5 FROM k) THEN 'hash' WHEN id <> min(id) OVER (PARTITION BY hash_md5) THEN 'repetido' ELSE 'nuevo' END AS outcome FROM b""")(
    lambda t: classify_new(t.docs.filter("id % 3 > 0").withColumn("seq", c("id")), t.docs.filter("id % 3 < 2")).select("id", "outcome")
)
LANDED = "seq bigint, hash_md5 string, tipo string, numero string, anio int, url_sii string"


def streamed(t: Tables):
    """The outcomes of all documents, landed in three parts between which the ingest stream runs."""
    root = shared_folder(t.spark, "ingest")
    for part in range(3):
        rows = t.docs.filter(c("id") % 3 == part).select(c("id").alias("seq"), "hash_md5", "tipo", "numero", "anio", "url_sii")
        rows.write.json(f"{root}/landing/{part}")
        run = start_ingest(t.spark, f"{root}/landing/*", LANDED, f"{root}/docs", f"{root}/checkpoint", f"{root}/log", name=root)
        run.awaitTermination()
    return t.spark.read.parquet(f"{root}/log").select(c("seq").alias("id"), "outcome")


def _landing_sql(part: int, known: str) -> str:
    return f"""b{part} AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM {known} k WHERE k.tipo = d.tipo AND k.numero = d.numero AND k.anio = d.anio) THEN 'identidad' WHEN url_sii IN (SELECT url_sii FROM {known}) THEN 'url'
     WHEN hash_md5 IN (SELECT hash_md5 FROM {known}) THEN 'hash' WHEN id <> min(id) OVER (PARTITION BY hash_md5) THEN 'repetido' ELSE 'nuevo' END AS outcome FROM d WHERE id % 3 = {part}),
   k{part + 1} AS (SELECT tipo, numero, anio, url_sii, hash_md5 FROM {known} UNION ALL SELECT tipo, numero, anio, url_sii, hash_md5 FROM b{part} WHERE outcome = 'nuevo')"""


q("w02_stream", f""", d AS (SELECT id, hash_md5, tipo, numero, anio, url_sii FROM docs), k0 AS (SELECT tipo, numero, anio, url_sii, hash_md5 FROM docs WHERE false),
   {_landing_sql(0, 'k0')}, {_landing_sql(1, 'k1')}, {_landing_sql(2, 'k2')}
   SELECT id, outcome FROM b0 UNION ALL SELECT id, outcome FROM b1 UNION ALL SELECT id, outcome FROM b2""")(streamed)
q("w05_messages", "SELECT event_id AS seq, CASE WHEN estado = 'error_bd' THEN 'WARN' ELSE 'OK' END AS level FROM scraper_log ORDER BY event_id DESC LIMIT 300")(
    lambda t: latest_progress(t.scraper_log.select(c("event_id").alias("seq"), c("estado").alias("message"))).select("seq", "level")
)


def files(t: Tables):
    """A tree of files: most documents' own, some twice, some damaged, some of no document."""
    d = t.docs.join(t.judicial_docs.select(c("doc_id").alias("id"), "sii_id", c("pdf_local").alias("jd_pdf")), "id", "left")
    year = F.coalesce(c("anio"), F.lit(0)).cast("string")
    name = F.when(c("tipo") == "judicial", F.concat(F.lit("judicial_"), year, F.lit("_x_id"), c("sii_id").cast("string"), F.lit(".pdf"))).otherwise(F.concat(c("tipo"), F.lit("_"), year, F.lit("_"), F.lpad("numero", 4, "0"), F.lit(".pdf")))
    state = F.when(c("id") % 17 == 0, "header_invalido").otherwise("ok")
    own = d.filter("id % 5 > 0 AND jd_pdf IS NULL").select(F.concat(F.lit("pdfs/"), c("id").cast("string"), F.lit("/"), name).alias("path"), name.alias("name"), state.alias("state"))
    court = d.filter("jd_pdf IS NOT NULL").select(F.upper("jd_pdf").alias("path"), F.lit("x.pdf").alias("name"), F.lit("ok").alias("state"))
    return d, own.unionByName(court)


PARITY = r""", f AS (SELECT tipo || '|' || CAST(coalesce(anio, 0) AS VARCHAR) || '|' || numero AS key, id % 17 = 0 AS bad, id FROM docs d LEFT JOIN judicial_docs j ON j.doc_id = d.id WHERE id % 5 > 0 AND tipo <> 'judicial' AND anio IS NOT NULL),
   g AS (SELECT key, count(*) AS n, min_by(bad, CAST(id AS VARCHAR)) AS bad FROM f GROUP BY key)
   SELECT d.id, CASE WHEN d.tipo = 'judicial' THEN CASE WHEN j.pdf_local IS NOT NULL THEN 'OK_PDF' WHEN d.id % 5 > 0 AND d.anio IS NOT NULL THEN CASE WHEN d.id % 17 = 0 THEN 'INCONSISTENCIA_IDENTIFICADOR' ELSE 'OK_PDF' END ELSE 'FALTA_PDF_TOTAL' END
     WHEN g.n > 1 THEN 'DUPLICADO_PDF' WHEN g.n = 1 THEN CASE WHEN g.bad THEN 'INCONSISTENCIA_IDENTIFICADOR' ELSE 'OK_PDF' END
     ELSE 'FALTA_PDF_TOTAL' END AS estado
   FROM docs d LEFT JOIN judicial_docs j ON j.doc_id = d.id LEFT JOIN g ON g.key = d.tipo || '|' || CAST(coalesce(d.anio, 0) AS VARCHAR) || '|' || d.numero"""
q("j17_e16_parity", PARITY)(lambda t: parity(t).select("id", "estado"))


def parity(t: Tables):
    d, f = files(t)
    rows = audit.matched(d, f)
    none = F.lit(False)
    return audit.classified(rows.withColumns({"html": none, "image": none, "ocr": none, "doc": none}))


q("a19_parity_histogram", PARITY.replace("SELECT d.id, CASE", ", p AS (SELECT d.id, CASE", 1) + ") SELECT estado, count(*) AS cnt, round(count(*) * 100 / (SELECT count(*) FROM p), 2) AS pct FROM p GROUP BY estado")(lambda t: audit.histogram(parity(t)))
q("j18_auxiliary", "SELECT id, anio IS NOT NULL AND CAST(numero AS INT) % 4 = 0 AS html FROM docs")(
    lambda t: audit.auxiliary(t.docs, t.docs.filter("anio IS NOT NULL AND cast(numero as int) % 4 = 0").select(F.concat(c("anio").cast("string"), F.lit("_circu"), F.lpad("numero", 3, "0"), F.lit("_limpio")).alias("stem")), "html").select("id", "html")
)
q("j19_orphans", "SELECT 'x/' || CAST(doc_id AS VARCHAR) AS path FROM documents WHERE doc_id % 3 > 0")(
    lambda t: audit.orphans(t.docs.select(F.concat(F.lit("x/"), c("id").cast("string")).alias("path")), t.docs.filter("id % 3 = 0").select(F.struct(F.concat(F.lit("x/"), c("id").cast("string")).alias("path")).alias("file"))).select("path")
)
q("p21_file_state", "SELECT id, CASE WHEN length(contenido) < 512 THEN 'demasiado_pequeno' WHEN id % 2 = 0 THEN 'header_invalido' ELSE 'ok' END AS state FROM docs")(
    lambda t: t.docs.select("id", audit.file_state(F.length("contenido"), F.when(c("id") % 2 == 0, c("contenido")).otherwise(F.lit("%PDF-1.4")).cast("binary")).alias("state"))
)
q("s09_tree", "SELECT id, CAST(id % 7 AS VARCHAR) AS grupo FROM docs WHERE id % 2 = 0")(
    lambda t: external.tree_ids(t.docs.select(F.array(F.struct("id", F.lit("x").alias("nombre"), F.create_map((c("id") % 7).cast("string"), (1 - c("id") % 2).cast("int")).alias("cells"))).alias("body")))
)
q("s16_page_links", r"SELECT page_id, CAST(len(regexp_extract_all(html, '<a [^>]*href=')) AS INT) AS n FROM pages")(lambda t: t.raw("pages").select("page_id", F.size(html_index.links(c("html"), c("url"))).alias("n")))
BREAKS = r"regexp_replace(regexp_replace(regexp_replace(html, '<br ?/?>', chr(10), 'g'), '</p\s*>', chr(10) || chr(10), 'gi'), '<[^>]+>', ' ', 'g')"


def unescaped_sql(body: str) -> str:
    """The character references that the pages have, in DuckDB."""
    for reference, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", chr(160)), ("&amp;", "&")):
        body = f"replace({body}, '{reference}', '{letter}')"
    return body


BREAKS = f"replace({unescaped_sql(BREAKS)}, chr(160), ' ')"
HTML_TEXT = r"SELECT {} , regexp_replace(regexp_replace(regexp_replace(" + BREAKS.replace("{", "{{").replace("}", "}}") + r", '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS {} FROM pages"
q("t06_pages_to_text", HTML_TEXT.format("page_id", "text"))(lambda t: t.raw("pages").select("page_id", html_to_text(c("html")).alias("text")))
cases("s21_file_keys", [("circular_2001_007.pdf", "circular|2001|7"), ("circular_historica_1999_circu28_scan.pdf", "circular|1999|28"), ("judicial_2020_ROL_1-2_id55.PDF", "judicial_sii|2020|55"), ("x.pdf", None)], audit.file_keys)
cases("s04_index_urls", [("http://h", 1998, "http://h/1998/indcir1998.htm|http://h/1998/indcir1998.html|http://h/1998/indcir98.htm|http://h/1998/indcir98.html"), ("http://h", 2003, "http://h/2003/indcir2003.htm|http://h/2003/indcir2003.html")], lambda b, y: F.array_join(html_index.index_urls(b, y), "|"))
MODERN = '<h5><a href="circu5.pdf">Circular N° 5 del 3 de marzo de 2015</a></h5><p>Sobre algo</p><h5><a href="x/y.htm">Circular N°6</a></h5>'
LEGACY = '<a href="circu07.htm">CIRCULAR N°07 del 1 de abril del 1999</a> trata de <b>algo</b><a href="o.htm">otro</a>'


def shown(rows):
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(",", x["numero"], x["descripcion"], x["fecha"], F.coalesce(x["url_pdf"], x["url_detalle"]))), "|")


cases(
    "s13_index_rows",
    [
        (MODERN, "http://h/a/i.htm", 2015, "5,Sobre algo,2015-03-03,http://h/a/circu5.pdf|6,,2015-01-01,http://h/a/x/y.htm"),
        (LEGACY, "http://h/a/i.htm", 1999, "07,trata de algo,1999-04-01,http://h/a/circu07.htm".replace("07,", "7,", 1)),
        (MODERN, "http://h/a/i.htm", 2001, "5,,2015-03-03,http://h/a/circu5.pdf|6,,2001-01-01,http://h/a/x/y.htm".replace("5,,", "5,Sobre algo,")),
        ("<p>nada</p>", "http://h/", 2015, ""),
    ],
    lambda p, b, y: shown(html_index.index_rows(p, b, y)),
)
cases("s14_resolutions", [('<a href="/r/reso12.pdf">x</a><a href="reso7.PDF">', "12|7")], lambda p: F.array_join(html_index.resolution_numbers(p), "|"))
cases("s16_detail_pdf", [('<iframe src="../d.pdf?x=1">', "http://h/a/b.htm", "http://h/a/../d.pdf?x=1"), ("var u='/z.pdf';", "http://h/a/b.htm", "http://h/z.pdf"), ("no", "http://h/", None)], html_index.detail_pdf)
cases("s17_prefixes", [("circu028a", "028|28|circu028"), ("abc", "abc")], lambda b: F.array_join(html_index.prefixes(b), "|"))
cases("s17_pages", [('<a href="circu28b.htm">b</a><a href="28a.html">a</a><a href="otro.htm">o</a>', "http://h/circu28.htm", "http://h/28a.html|http://h/circu28.htm|http://h/circu28b.htm")], lambda p, u: F.array_join(F.array_sort(html_index.scanned_pages(p, u)), "|"))
cases("s18_images", [('<img src="28_1.gif"><img width=600 src="x.jpg">', "http://h/circu28.htm", "http://h/28_1.gif"), ('<img width="600" src="x.jpg"><img src="y.png">', "http://h/circu28.htm", "http://h/x.jpg")], lambda p, u: F.array_join(html_index.page_images(p, u), "|"))
