"""Queries over retrieval, and the composed pages (R)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from leafquarry.engine import Engine
from leafquarry.functions.text import formal_type
from leafquarry.operators import catalog as op
from leafquarry.operators import retrieval as rt
from leafquarry.operators.segments import SegmentedIndex
from leafquarry.plans.domain import Tables
from leafquarry.plans.relational import q
from leafquarry.sources.tables import shared_folder

FIELDS = ["titulo", "materia", "subtema", "contenido", "resumen", "palabras_clave", "leyes_citadas", "articulos_clave"]
QUESTION = "thing LIR of-the pathetic and"

TERMS = "regexp_extract_all(strip_accents(lower(coalesce({}, ''))), '[\\p{{L}}\\p{{N}}]+')"
LAW = "CASE id % 3 WHEN 0 THEN 'LIR' WHEN 1 THEN 'LIVS' ELSE 'CT' END"
FULL = f""", full_docs AS (SELECT *, '["' || {LAW} || '"]' AS leyes_citadas, '[{{"cuerpo":"' || {LAW} || '","articulo":"' || CAST(id % 120 + 1 AS VARCHAR) || '"}}]' AS articulos_clave FROM docs)"""
POSTINGS = (
    FULL + ", toks AS ("
    + " UNION ALL ".join(f"SELECT id AS doc_id, '{f}' AS field, t.term, CAST(t.pos - 1 AS INT) AS pos FROM full_docs, unnest({TERMS.format(f)}) WITH ORDINALITY AS t(term, pos)" for f in FIELDS)
    + "), stats AS (SELECT id AS doc_id, " + " + ".join(f"len({TERMS.format(f)})" for f in FIELDS) + " AS dl FROM full_docs)"
)
HITS = """, hits AS (SELECT doc_id, CASE term WHEN 'thing' THEN 0 WHEN 'lir' THEN 1 WHEN 'pathetic' THEN 3 ELSE 4 END AS phrase, count(*) AS tf FROM toks WHERE term IN ('thing', 'lir', 'pathetic', 'and') GROUP BY 1, 2
   UNION ALL SELECT a.doc_id, 2, count(*) FROM toks a JOIN toks b ON a.doc_id = b.doc_id AND a.field = b.field AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY 1),
 w AS (SELECT phrase, greatest(ln(((SELECT count(*) FROM stats) - count(*) + 0.5e0) / (count(*) + 0.5e0)), 1e-6) AS idf FROM hits GROUP BY phrase),
 scored AS (SELECT doc_id, -sum(idf * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / (SELECT avg(dl) FROM stats)))) AS rank FROM hits JOIN w USING (phrase) JOIN stats USING (doc_id) GROUP BY doc_id)"""


def full(t: Tables):
    """Documents with the laws and articles that their first sentence cites."""
    law = F.element_at(F.array(F.lit("LIR"), F.lit("LIVS"), F.lit("CT")), (c("id") % 3 + 1).cast("int"))
    article = (c("id") % 120 + 1).cast("string")
    return t.docs.withColumns({"leyes_citadas": F.concat(F.lit('["'), law, F.lit('"]')), "articulos_clave": F.concat(F.lit('[{"cuerpo":"'), law, F.lit('","articulo":"'), article, F.lit('"}]'))})


def postings(t: Tables):
    return rt.postings(full(t), FIELDS)


def scan(t: Tables):
    return rt.Scan(full(t), tuple(FIELDS))


_INDEXES: dict[tuple, SegmentedIndex] = {}


def built(t: Tables) -> SegmentedIndex:
    """The documents' index in segments, written anew: two thirds, then the rest with a tenth of stale documents, which the
    third commit corrects and of which it removes some that don't exist."""
    index, docs = SegmentedIndex(t.spark, shared_folder(t.spark, "index"), FIELDS), full(t)
    index.commit(docs.filter("id % 3 < 2"))
    index.commit(docs.filter("id % 3 = 2 OR id % 10 = 2").withColumn("titulo", F.when(c("id") % 10 == 2, "stale and wrong").otherwise(c("titulo"))))
    index.commit(docs.filter("id % 10 = 2"), removed=docs.select((-1 - c("id")).alias("id")))
    _INDEXES[_files(t)] = index
    return index


def _files(t: Tables) -> tuple:
    return (t.spark.sparkContext.applicationId, *sorted(t.raw("documents").inputFiles()))


def asked(t: Tables) -> SegmentedIndex | rt.Scan:
    """What ranks a question: the index of these files where one stands in this application, or else one pass over the texts, so that a
    question never builds what only many questions repay."""
    index = _INDEXES.get(_files(t))
    return index if index is not None and index.open().segments else scan(t)


c = F.col
q("k15_segments", POSTINGS + " SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS n FROM toks GROUP BY term")(
    lambda t: (i := built(t)).part("dfs").groupBy("term").agg(F.sum("docs").alias("docs")).where("docs <> 0").join(i.live("postings").groupBy("term").agg(F.sum(F.size("positions")).alias("n")), "term")
)
q("k15_merged", POSTINGS + " SELECT term, count(DISTINCT doc_id) AS docs FROM toks GROUP BY term")(lambda t: built(t).merge().part("dfs").select("term", "docs"))
q("k15_postings", POSTINGS + " SELECT term, field, count(*) AS n, count(DISTINCT doc_id) AS docs FROM toks GROUP BY ALL")(
    lambda t: postings(t).groupBy("term", "field").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))
)
q("k15_refresh", POSTINGS + " SELECT count(*) AS n, count(DISTINCT doc_id) AS docs FROM toks WHERE doc_id % 10 <> 1")(
    lambda t: rt.refreshed(postings(t), full(t).filter("id % 10 = 2"), FIELDS, t.docs.filter("id % 10 = 1")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))
)
q("r01_match_query", "SELECT 'IVA OR \"servicios\" OR \"digitales\"' AS q")(lambda t: t.spark.range(1).select(F.lit(rt.match_query("IVA servicios digitales")).alias("q")))
q("r03_stored", POSTINGS + HITS + " SELECT doc_id, round(rank, 6) AS rank FROM scored")(
    lambda t: rt.Stored(postings(t), rt.lengths(full(t), FIELDS)).scores(rt.parse(QUESTION).phrases).select("doc_id", F.round("rank", 6).alias("rank"))
)
q("r03_bm25", POSTINGS + HITS + " SELECT doc_id, round(rank, 6) AS rank FROM scored")(lambda t: scan(t).scores(rt.parse(QUESTION).phrases).select("doc_id", F.round("rank", 6).alias("rank")))
q("o07_best500", POSTINGS + HITS + " SELECT doc_id, round(rank, 6) AS rank FROM scored ORDER BY round(scored.rank, 9), doc_id LIMIT 100")(
    lambda t: rt.ranked(asked(t), QUESTION, 100).select("doc_id", F.round("rank", 6).alias("rank"))
)
q("r02_search_page", POSTINGS + HITS + """, best AS (SELECT doc_id, rank FROM scored ORDER BY round(rank, 9), doc_id LIMIT 500)
   SELECT d.id, d.fecha, round(b.rank, 6) AS rank FROM docs d JOIN best b ON b.doc_id = d.id WHERE d.tipo = 'oficio' ORDER BY coalesce(d.fecha, '') DESC, d.id DESC LIMIT 15""")(
    lambda t: op.page(rt.candidates(t.docs, asked(t), QUESTION).filter("tipo = 'oficio'")).select("id", "fecha", F.round("rank", 6).alias("rank"))
)
q("r02_fallback", "SELECT id FROM docs WHERE titulo ILIKE '%a OR e%' OR contenido ILIKE '%a OR e%' OR palabras_clave ILIKE '%a OR e%' OR resumen ILIKE '%a OR e%'")(
    lambda t: rt.candidates(t.docs, scan(t), "a OR e").select("id")
)
q("r04_fragment", """SELECT id, CASE WHEN p = 0 THEN substr(s, 1, 100) ELSE trim(substr(s, CAST(greatest(0, p - 1 - 33) AS BIGINT) + 1, 100), ' ' || chr(10)) END AS f
   FROM (SELECT id, s, coalesce(nullif(strpos(lower(s), 'pathetic'), 0), strpos(lower(s), 'oficio')) AS p FROM (SELECT id, trim(contenido, ' ' || chr(10)) AS s FROM docs))""")(
    lambda t: t.docs.select("id", rt.fragment(c("contenido"), "pathetic oficio de", 100).alias("f"))
)
PACK = POSTINGS + HITS + """, b AS (SELECT d.*, s.rank, row_number() OVER (ORDER BY round(s.rank, 9), id) AS place FROM full_docs d JOIN scored s ON s.doc_id = d.id WHERE d.tipo = 'circular' ORDER BY place LIMIT 8),
   f AS (SELECT *, CASE WHEN p = 0 THEN substr(s, 1, 900) ELSE trim(substr(s, CAST(greatest(0, p - 1 - 300) AS BIGINT) + 1, 900), ' ' || chr(10)) END AS extracto
     FROM (SELECT *, coalesce(nullif(strpos(lower(s), 'thing'), 0), nullif(strpos(lower(s), 'pathetic'), 0), 0) AS p FROM (SELECT *, trim(coalesce(nullif(resumen, ''), contenido), ' ' || chr(10)) AS s FROM b))),
   k AS (SELECT *, sum(length('--- DOCUMENTO ' || place || ' ---' || chr(10) || 'Tipo: ' || tipo || ' | Numero: ' || numero || ' | Anio: ' || coalesce(CAST(anio AS VARCHAR), '-') || ' | Fecha: ' || coalesce(fecha, '-') || chr(10)
     || 'Referencia: ' || referencia || chr(10) || 'Leyes citadas: ' || leyes_citadas || chr(10) || 'Articulos: ' || articulos_clave || chr(10) || 'Extracto relevante:' || chr(10) || extracto || chr(10))) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS upto FROM f)"""


def sources(t: Tables):
    # a context scores every hit, so an index would skip nothing
    return rt.context(full(t).filter("tipo = 'circular'"), scan(t), QUESTION, most_chars=2000)


q("r05_context", PACK + " SELECT CAST(place AS INT) AS place, id, extracto, round(1 / (1 + abs(rank)), 4) AS relevancia, CAST(upto AS BIGINT) AS upto FROM k WHERE upto <= 2000")(
    lambda t: sources(t).select("place", "id", "extracto", "relevancia", "upto")
)
q("r06_answer", PACK + " SELECT 'media' AS confianza, count(*) AS fuentes, 'Se devolvieron solo las fuentes encontradas.' AS nota, CAST(max(upto) + count(*) - 1 AS INT) AS n FROM k WHERE upto <= 2000")(lambda t: rt.answer(sources(t), QUESTION).select("confianza", "fuentes", "nota", F.length("contexto").alias("n")))
q("r07_filtered_question", "SELECT id, CAST(0.001 AS DOUBLE) AS relevancia FROM (SELECT * FROM docs WHERE tipo = 'judicial' AND (titulo ILIKE '%a OR b%' OR resumen ILIKE '%a OR b%' OR contenido ILIKE '%a OR b%') ORDER BY fecha DESC NULLS LAST, id DESC LIMIT 3)")(
    lambda t: rt.context(t.docs.filter("tipo = 'judicial'").withColumns({"leyes_citadas": F.lit("[]"), "articulos_clave": F.lit("[]")}), scan(t), "a OR b", 3).select("id", "relevancia")
)
q("r09_search_response", None)(
    lambda t: op.decorated(op.page(op.with_side_tables(op.filtered(rt.candidates(t.docs, asked(t), QUESTION), t.articulos_idx, t.judicial_docs, t.judicial_relaciones, op.Search(text=QUESTION, ley="LIR")), t.judicial_docs, t.judicial_relaciones)), QUESTION).select(
        "id", "tipo", "numero", "anio", "fecha", "tema", "extracto", "corte", "cuerpos", "pdf", formal_type(c("tipo")).alias("nombre")
    )
)
q("r09_search_rows", POSTINGS + HITS + """, best AS (SELECT doc_id FROM scored ORDER BY round(rank, 9), doc_id LIMIT 500),
   p AS (SELECT * FROM docs WHERE id IN (SELECT doc_id FROM best) AND id IN (SELECT doc_id FROM articulos_idx WHERE ley = 'LIR') ORDER BY coalesce(fecha, '') DESC, id DESC LIMIT 15)
   SELECT p.id, p.tipo, p.numero, p.anio, p.fecha, j.corte, (SELECT string_agg(DISTINCT r.cuerpo_normativo, ',' ORDER BY r.cuerpo_normativo) FROM judicial_relaciones r WHERE r.doc_id = p.id) AS cuerpos, coalesce(p.pdf_local, j.pdf_local) AS pdf
   FROM p LEFT JOIN judicial_docs j ON j.doc_id = p.id""")(
    lambda t: op.with_side_tables(
        op.page(op.filtered(rt.candidates(t.docs, asked(t), QUESTION), t.articulos_idx, t.judicial_docs, t.judicial_relaciones, op.Search(text=QUESTION, ley="LIR"))), t.judicial_docs, t.judicial_relaciones
    ).select("id", "tipo", "numero", "anio", "fecha", "corte", "cuerpos", "pdf")
)


def engine(t: Tables):
    return Engine(t.spark, t.docs, t.articulos_idx, t.judicial_docs, t.judicial_relaciones, log=t.scraper_log, cases=t.casos, notes=t.caso_notas)


def rows_of(parts, keys):
    """parte, clave: the rows of each part by one text; keys: what makes it."""
    out = [parts[p].select(F.lit(p).alias("parte"), make().cast("string").alias("clave")) for p, make in keys.items()]
    return reduce(lambda x, y: x.unionByName(y), out)


q("r10_page_parts", """, own AS (SELECT DISTINCT ley, articulo FROM articulos_idx WHERE doc_id = 7 AND articulo IS NOT NULL ORDER BY ley, articulo LIMIT 4)
   SELECT 'doc' AS parte, '7|' || coalesce(pdf_local, '') AS clave FROM (SELECT coalesce(d.pdf_local, j.pdf_local) AS pdf_local FROM docs d LEFT JOIN judicial_docs j ON j.doc_id = d.id WHERE d.id = 7)
   UNION ALL SELECT 'related', CAST(id AS VARCHAR) FROM (SELECT id FROM docs WHERE id <> 7 AND id IN (SELECT doc_id FROM articulos_idx a JOIN own USING (ley, articulo)) ORDER BY anio DESC NULLS LAST, id DESC LIMIT 8)
   UNION ALL SELECT 'history', CAST(v.id AS VARCHAR) FROM docs v JOIN docs d ON d.id = 7 AND v.tipo = d.tipo AND v.numero = d.numero AND v.id <> 7
   UNION ALL SELECT 'relations', cuerpo_normativo || '|' || articulo FROM judicial_relaciones WHERE doc_id = 7""")(
    lambda t: rows_of(
        engine(t).document(7),
        {"doc": lambda: F.concat_ws("|", c("id"), F.coalesce("pdf", F.lit(""))), "related": lambda: c("id"), "history": lambda: c("id"), "relations": lambda: F.concat_ws("|", "cuerpo_normativo", "articulo")},
    )
)
q("r11_dashboard_parts", """, a AS (SELECT ley, articulo, count(*) AS cnt FROM articulos_idx WHERE ley IS NOT NULL AND articulo IS NOT NULL GROUP BY ALL ORDER BY cnt DESC, ley, articulo LIMIT 15)
   SELECT 'totals' AS parte, count(*) || '|' || max(fecha_carga) AS clave FROM docs
   UNION ALL SELECT 'by_type', tipo || '|' || count(*) FROM docs GROUP BY tipo
   UNION ALL SELECT 'by_year', anio || '|' || cnt FROM (SELECT anio, count(*) AS cnt FROM docs WHERE anio IS NOT NULL GROUP BY anio ORDER BY anio DESC LIMIT 15)
   UNION ALL SELECT 'recent', CAST(id AS VARCHAR) FROM (SELECT id FROM docs ORDER BY coalesce(fecha_carga, fecha) DESC, id DESC LIMIT 6)
   UNION ALL SELECT 'articles', ley || '|' || articulo || '|' || cnt FROM a
   UNION ALL SELECT DISTINCT 'subjects', materia FROM docs WHERE trim(coalesce(materia, '')) <> ''
   UNION ALL SELECT DISTINCT 'courts', corte FROM judicial_docs UNION ALL SELECT DISTINCT 'bodies', cuerpo_normativo FROM judicial_relaciones UNION ALL SELECT DISTINCT 'sources', fuente FROM docs
   UNION ALL SELECT 'log', tipo || '|' || anio || '|' || count(*) || '|' || count(*) FILTER (estado = 'ok') FROM scraper_log GROUP BY tipo, anio
   UNION ALL SELECT 'new_today', CAST(count(*) AS VARCHAR) FROM scraper_log WHERE estado = 'ok' AND CAST(fecha AS DATE) = DATE '2024-01-15'
   UNION ALL SELECT 'cases', c.id || '|' || count(n.id) || '|' || count(n.doc_id) FROM casos c LEFT JOIN caso_notas n ON n.caso_id = c.id GROUP BY c.id""")(
    lambda t: rows_of(
        engine(t).dashboard("2024-01-15"),
        {
            "totals": lambda: F.concat_ws("|", "total", "ultima"),
            "by_type": lambda: F.concat_ws("|", "tipo", "cnt"),
            "by_year": lambda: F.concat_ws("|", "anio", "cnt"),
            "recent": lambda: c("id"),
            "articles": lambda: F.concat_ws("|", "ley", "articulo", "cnt"),
            "subjects": lambda: c("materia"),
            "courts": lambda: c("corte"),
            "bodies": lambda: c("cuerpo_normativo"),
            "sources": lambda: c("fuente"),
            "log": lambda: F.concat_ws("|", "tipo", "anio", "cnt", "ok"),
            "new_today": lambda: c("n"),
            "cases": lambda: F.concat_ws("|", "id", "notas", "documentos"),
        },
    )
)
q("r10_document_page", """SELECT d.id, d.titulo, j.corte, (SELECT count(*) FROM docs v WHERE v.tipo = d.tipo AND v.numero = d.numero AND v.id <> d.id) AS versiones FROM docs d LEFT JOIN judicial_docs j ON j.doc_id = d.id WHERE d.id = 7""")(
    lambda t: t.docs.filter("id = 7").join(t.judicial_docs.select(c("doc_id").alias("id"), "corte"), "id", "left").join(op.versions(t.docs, 7).agg(F.count(F.lit(1)).alias("versiones")), F.lit(True)).select("id", "titulo", "corte", "versiones")
)
q("r11_dashboard", """SELECT count(*) AS total, count(*) FILTER (WHERE tipo = 'circular') AS circulares, count(*) FILTER (WHERE tipo = 'judicial') AS judiciales, max(fecha_carga) AS ultima, count(DISTINCT materia) AS materias,
   (SELECT count(*) FROM casos) AS casos, (SELECT count(*) FROM scraper_log WHERE estado = 'ok' AND CAST(fecha AS DATE) = DATE '2024-01-15') AS nuevos_hoy FROM docs""")(
    lambda t: t.docs.agg(F.count(F.lit(1)).alias("total"), F.count_if(c("tipo") == "circular").alias("circulares"), F.count_if(c("tipo") == "judicial").alias("judiciales"), F.max("fecha_carga").alias("ultima"), F.countDistinct("materia").alias("materias"))
    .join(t.casos.agg(F.count(F.lit(1)).alias("casos")), F.lit(True))
    .join(t.scraper_log.filter((c("estado") == "ok") & (c("fecha").cast("date") == F.lit("2024-01-15").cast("date"))).agg(F.count(F.lit(1)).alias("nuevos_hoy")), F.lit(True))
)
q("r12_preview", "SELECT id, substr(contenido, 1, 300) AS inicio FROM docs WHERE id = 11")(lambda t: t.docs.filter("id = 11").select("id", F.substring("contenido", 1, 300).alias("inicio")))
