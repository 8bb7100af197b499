"""Queries over assembled records."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafquarry.functions import records, refs
from leafquarry.functions.text import best_variant, json_list
from leafquarry.operators import ingest
from leafquarry.operators.resolver import references
from leafquarry.plans.domain import Tables
from leafquarry.plans.relational import q
from leafquarry.plans.scalars import cases
from leafquarry.sources import api_source
from leafquarry.sources import tables as src

c = F.col


def decision(t):
    """Court decisions from the judicial documents."""
    rows = t.docs.filter("tipo = 'judicial'").join(t.judicial_docs.select(c("doc_id").alias("id"), "corte", "tipo_codigo"), "id")
    return rows.select(
        "id", "anio", "fecha", "tipo_codigo", F.when(c("id") % 3 > 0, F.concat(c("numero"), F.lit("-"), c("id").cast("string"))).alias("codigo"), F.when(c("id") % 8 == 3, F.concat(F.lit("A con  B "), c("id").cast("string"))).alias("partes"),
        c("corte").alias("instancia"), F.lit("Sentencia").alias("tipo_pronunciamiento"), "resumen", "titulo", "url_sii",
    )


DECISION = """, x AS (SELECT d.id, d.anio, d.fecha, j.tipo_codigo, CASE WHEN d.id % 3 > 0 THEN d.numero || '-' || CAST(d.id AS VARCHAR) END AS codigo, CASE WHEN d.id % 8 = 3 THEN 'A con B ' || CAST(d.id AS VARCHAR) END AS partes, j.corte AS instancia
   FROM docs d JOIN judicial_docs j ON j.doc_id = d.id WHERE d.tipo = 'judicial')"""


def parts():
    return {k: c(k) for k in ("id", "tipo_codigo", "codigo", "partes", "instancia", "fecha", "tipo_pronunciamiento")} | {"resumen": F.lit("uno\ndos"), "extracto": F.lit("")}


q("t22_titles", DECISION + """ SELECT id, CASE WHEN tipo_codigo IS NOT NULL AND codigo IS NOT NULL AND partes IS NOT NULL THEN tipo_codigo || ' ' || codigo || ' - ' || partes
   WHEN tipo_codigo IS NOT NULL AND codigo IS NOT NULL THEN tipo_codigo || ' ' || codigo WHEN codigo IS NOT NULL THEN 'Rol ' || codigo || ' - ' || instancia ELSE 'uno' END AS titulo,
   concat_ws(' | ', 'Jurisprudencia Judicial SII', instancia, 'Sentencia', CASE WHEN codigo IS NOT NULL THEN coalesce(tipo_codigo, 'Rol') || ' ' || codigo END, fecha, partes) AS referencia FROM x""")(
    lambda t: decision(t).select("id", records.court_title(parts()).alias("titulo"), records.court_reference(parts()).alias("referencia"))
)
q("t33_stems", DECISION + " SELECT id, 'judicial_' || CAST(anio AS VARCHAR) || '_' || coalesce(tipo_codigo, 'DOC') || '_' || coalesce(codigo, CAST(id AS VARCHAR)) || '_id' || CAST(id AS VARCHAR) AS stem FROM x")(
    lambda t: decision(t).select("id", records.court_stem(parts(), c("anio")).alias("stem"))
)
q("t23_content", DECISION + """ SELECT id, 'JURISPRUDENCIA JUDICIAL SII' || repeat(chr(10), 2) || 'ID SII: ' || CAST(id AS VARCHAR) || chr(10) || 'Tipo Codigo: ' || coalesce(tipo_codigo, 'Sin dato') || chr(10) || 'Codigo/Rol: ' || coalesce(codigo, 'Sin dato')
   || chr(10) || 'Fecha: ' || coalesce(fecha, 'Sin dato') || chr(10) || 'Instancia: ' || instancia || chr(10) || 'Tipo de pronunciamiento: Sentencia' || chr(10) || 'Partes: ' || coalesce(partes, 'Sin dato') || chr(10) || 'RUC: Sin dato' || chr(10)
   || 'Resultado: Sin dato' || chr(10) || 'Decision: Sin dato' || chr(10) || 'Fuente SII: http://x/' || CAST(id AS VARCHAR) || repeat(chr(10), 2) || 'LEYES CITADAS' || chr(10) || 'CT, LIR' || repeat(chr(10), 2) || 'ARTICULOS' || chr(10) || '- Sin articulos asociados'
   || repeat(chr(10), 2) || 'EXTRACTO' || chr(10) || 'Sin dato' || repeat(chr(10), 2) || 'DESCRIPTORES' || chr(10) || 'uno' || chr(10) || 'dos' || repeat(chr(10), 2) || 'PRONUNCIAMIENTO COMPLETO' || chr(10) || 'uno' || chr(10) || 'dos' AS contenido FROM x""")(
    lambda t: decision(t).select(
        "id",
        records.court_content(
            parts()
            | {k: F.lit(None).cast("string") for k in ("ruc", "resultado", "decision", "sentencia")}
            | {"url": F.concat(F.lit("http://x/"), c("id").cast("string")), "leyes": F.array(F.lit("CT"), F.lit("LIR")), "articulos": F.array().cast("array<string>")}
        ).alias("contenido"),
    )
)
q("e12_relations", "SELECT id, 'Ley ' || CAST(id % 5 AS VARCHAR) AS cuerpo_normativo, 'Art 1' AS articulo, '' AS nota FROM docs UNION ALL SELECT id, '', 'Art 2', 'n' FROM docs")(
    lambda t: records.court_relations(
        t.docs.select(
            "id",
            F.array(
                *[
                    F.struct(F.lit(nota).cast("string").alias("nota"), F.struct(F.lit(art).cast("string").alias("nombre"), F.struct(F.struct(law.alias("nombre")).alias("cuerpoNormativo")).alias("tituloBO")).alias("articulo"))
                    for nota, art, law in (
                        (None, "Art  1", F.concat(F.lit("Ley "), (c("id") % 5).cast("string"))),
                        ("", "ART 1", F.concat(F.lit("LEY "), (c("id") % 5).cast("string"))),
                        ("n", "Art 2", F.lit(None).cast("string")),
                        (None, None, F.lit("")),
                    )
                ]
            ).alias("items"),
        ),
        "id",
        "items",
    )
)


def answers(t: Tables):
    """Each conversation as a service's answer: a list, an envelope, one with errors, one that is broken off, or none."""
    turn = F.to_json(F.struct("turn", "role", "text"))
    rows = t.raw("conversations").select("conv_id", "turn", turn.alias("item"), c("role"))
    data = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "item"))), lambda x: x["item"]), ",")
    listed = F.concat(F.lit("["), data, F.lit("]"))
    form = c("conv_id") % 5
    errors = F.concat(F.lit('{"metaData":{"errors":[{"codigo":"'), c("conv_id").cast("string"), F.lit('"},"otro"]},"data":'), listed, F.lit("}"))
    body = F.when(form == 0, errors).when(form == 1, listed).when(form == 2, F.substr(listed, F.lit(1), F.length(listed) - 1)).when(form == 3, F.concat(F.lit(' {"metaData":{"errors":null},"data":'), listed, F.lit("}")))
    return rows.groupBy("conv_id").agg(body.alias("body"))


q("s07_answers", """SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS n, turn, role, text, CAST(NULL AS VARCHAR) AS error FROM conversations WHERE conv_id % 5 IN (1, 3)
   UNION ALL SELECT DISTINCT conv_id, NULL, NULL, NULL, NULL, unnest(['{"codigo":"' || conv_id || '"}', 'otro']) FROM conversations WHERE conv_id % 5 = 0
   UNION ALL SELECT DISTINCT conv_id, NULL, NULL, NULL, NULL, 'no es JSON' FROM conversations WHERE conv_id % 5 = 2""")(
    lambda t: api_source.landed(answers(t), "body", "conv_id").withColumn("i", F.from_json("item", "turn bigint, role string, text string")).select("conv_id", "n", "i.turn", "i.role", "i.text", "error")
)
SCORE = r"""CASE WHEN s = '' THEN 0 ELSE 4 * len(regexp_extract_all(s, '[A-Za-zÀ-ſ0-9]{3,}')) + 1 - 2 * (length(s) - length(replace(s, '?', ''))) - 4 * (length(s) - length(replace(s, chr(65533), ''))) END"""
q("t13_best_variant", rf""", v AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM conversations),
   w AS (SELECT *, {SCORE} AS score FROM v),
   o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN score >= 250 THEN 0 ELSE 1 END, CASE WHEN score >= 250 THEN n ELSE -score END, n) AS k FROM w)
   SELECT conv_id, CAST(n AS INT) AS variante, CAST(score AS INT) AS puntaje, text AS texto FROM o WHERE k = 1""")(
    lambda t: t.raw("conversations").groupBy("conv_id").agg(best_variant(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), 250).alias("b")).select("conv_id", "b.*")
)
q("s15_discovered", "SELECT anio, CAST(id % 40 AS VARCHAR) AS base, string_agg(DISTINCT CASE id % 3 WHEN 0 THEN 'htm' WHEN 1 THEN 'pdf' ELSE 'doc' END, ',' ORDER BY CASE id % 3 WHEN 0 THEN 'htm' WHEN 1 THEN 'pdf' ELSE 'doc' END) AS extensiones, (list(titulo ORDER BY length(titulo) DESC, id))[1] AS titulo FROM docs GROUP BY anio, id % 40")(
    lambda t: records.discovered(
        t.docs.select("anio", c("id").alias("seq"), F.concat(F.lit("/a/b/"), (c("id") % 40).cast("string"), F.element_at(F.array(F.lit(".HTM"), F.lit(".pdf"), F.lit(".doc")), (c("id") % 3 + 1).cast("int")), F.lit("?x=1")).alias("href"), "titulo", F.lit("d").alias("descripcion"))
    ).select("anio", "base", "extensiones", "titulo")
)
q("s24_catalogue", "SELECT 'docs' AS tabla, TRUE AS fuente, FALSE AS organo")(lambda t: t.spark.range(1).select(F.lit("docs").alias("tabla"), *[F.lit(v).alias(k) for k, v in zip(("fuente", "organo"), src.has_columns(t.docs, ["fuente", "organo_emisor"]).values(), strict=True)]))
q("s27_marker", "SELECT page_id, contains(lower(substr(html, 1, 5000)), 'reso') AS hit FROM pages")(lambda t: t.raw("pages").select("page_id", records.has_marker(c("html")).alias("hit")))
q("k03_json_lists", "SELECT id, CASE WHEN id % 3 = 0 THEN 'a' || ',' || CAST(id AS VARCHAR) ELSE '' END AS items FROM docs")(
    lambda t: t.docs.select("id", F.array_join(json_list(F.when(c("id") % 3 == 0, F.to_json(F.array(F.lit("a"), c("id").cast("string")))).when(c("id") % 3 == 1, "{mal")), ",").alias("items"))
)
q("k07_technical_update", "SELECT doc_id, coalesce(pdf_local, 'pdfs/judicial/sin.pdf') AS pdf_local FROM judicial_docs")(lambda t: t.judicial_docs.select("doc_id", F.coalesce("pdf_local", F.lit("pdfs/judicial/sin.pdf")).alias("pdf_local")))
q("k08_analysis_upsert", "SELECT id AS doc_id, CASE WHEN id % 2 = 0 THEN 'ready' ELSE 'pending' END AS status FROM docs")(
    lambda t: ingest.last_write(t.docs.select(c("id").alias("doc_id"), F.lit("pending").alias("status")), t.docs.filter("id % 2 = 0").select(c("id").alias("doc_id"), F.lit("ready").alias("status"), c("id").alias("seq")), ["doc_id"])
)
q("k11_settings", "SELECT k AS key, v AS value FROM (VALUES ('hora', '09:00'), ('activo', '1')) s(k, v)")(
    lambda t: ingest.last_write(t.spark.createDataFrame([("hora", "08:00"), ("activo", "1")], "key string, value string"), t.spark.createDataFrame([("hora", "08:30", 1), ("hora", "09:00", 2)], "key string, value string, seq int"), ["key"])
)
q("k14_manual", "SELECT id, coalesce(nullif(CASE WHEN id % 2 = 0 THEN referencia END, ''), 'Manual - ' || titulo) AS referencia, CAST(greatest(1, ceil(length(contenido) / 2800)) AS INT) AS paginas, CASE WHEN id % 2 = 0 THEN 'CT,LIR' ELSE 'FT' END AS leyes FROM docs")(
    lambda t: (
        lambda m: t.docs.select("id", m["referencia"].alias("referencia"), m["paginas"].alias("paginas"), F.array_join(m["leyes"], ",").alias("leyes"))
    )(records.manual_record({"titulo": c("titulo"), "contenido": c("contenido"), "referencia": F.when(c("id") % 2 == 0, c("referencia")), "leyes": F.when(c("id") % 2 == 0, '["lir","ct"]').otherwise('["FT"]')}))
)
q("k25_folders", "SELECT id, 'pdfs/' || tipo || '/' || CAST(anio AS VARCHAR) AS folder FROM docs WHERE anio IS NOT NULL")(lambda t: t.docs.filter("anio IS NOT NULL").select("id", records.file_folder(F.concat_ws("_", "tipo", c("anio").cast("string"), F.concat("numero", F.lit(".pdf")))).alias("folder")))
q("k26_quarantine", "SELECT id FROM docs WHERE pdf_local LIKE 'pdfs/1%'")(lambda t: t.docs.filter(c("pdf_local").startswith("pdfs/1")).select("id"))
q("k28_reindexed", "SELECT count(*) AS n FROM docs WHERE trim(coalesce(contenido, '')) <> ''")(lambda t: ingest.reindexed(t.docs).filter(F.size("refs") == 1).agg(F.count(F.lit(1)).alias("n")))
q("k30_tables", "SELECT CAST(0 AS BIGINT) AS n")(lambda t: src.empty_tables(t.spark, {"casos": "id bigint, nombre string"})["casos"].agg(F.count(F.lit(1)).alias("n")))
q("w03_item_states", """SELECT id, CASE WHEN id % 10 = 0 THEN 'no_encontrado' WHEN id % 3 = 0 AND n < 250 THEN 'ocr_pendiente' WHEN id % 3 > 0 AND id % 2 = 0 AND n < 120 THEN 'doc_pendiente' WHEN n < 120 THEN 'procesamiento_fallido'
   WHEN id % 13 = 0 THEN 'error_bd' WHEN id % 3 = 0 THEN 'ok_scan_' || f ELSE 'ok_' || f END AS estado FROM (SELECT id, length(contenido) - 60 AS n, CASE WHEN id % 2 = 0 THEN 'doc' ELSE 'html' END AS f FROM docs)""")(
    lambda t: t.docs.select(
        "id",
        records.item_state({"encontrado": c("id") % 10 > 0, "texto": F.substr("contenido", F.lit(61)), "formato": F.when(c("id") % 2 == 0, "doc").otherwise("html"), "escaneado": c("id") % 3 == 0, "guardado": c("id") % 13 > 0}).alias("estado"),
    )
)
cases("k31_report_lines", [(2001, "b,a", "", "2001: faltan a, b; sobran -")], lambda y, m, e: records.report_line(y, F.split(m, ","), F.filter(F.split(e, ","), lambda x: x != "")))
cases("t25_resolution_title", [("x\nRESOLUCION EXENTA SOBRE ALGO\ny", "5", "RESOLUCION EXENTA SOBRE ALGO"), ("corta", "5", "Resolucion Exenta N5")], records.resolution_title)
cases("t25_record", [("oficio_iva", "7", 2001, " Un  tema ", "IVA", "Un tema|Oficio N7 de 2001|IVA - Un tema"), ("circular", "3", 2002, None, "", "Circular N3|Circular N3 de 2002|")],
      lambda k, n, y, ti, p: (lambda r: F.concat_ws("|", r["titulo"], r["referencia"], r["subtema"]))(records.modern_record({"tipo": k, "numero": n, "anio": y, "titulo": ti, "prefijo": p, "fecha": F.lit(None).cast("string"), "texto": F.lit("")})))
cases("t24_record", [(1999, "28", "", "tema", "1", "Circular N28 de 1999|tema | circular historica | ocr|tema"), (1999, "28", "T", None, "0", "T|circular historica")],
      lambda y, n, ti, m, s: (lambda r: F.concat_ws("|", r["titulo"], r["palabras_clave"], r["resumen"]))(records.historical_record({"anio": y, "numero": n, "titulo": ti, "materia": m, "texto": F.lit("corto"), "escaneado": s == "1"})))
cases("e04_exact_refs", [("artículo 31 de la LIR; artículo 8; artículo 2 del código tributario", "LIR:31|CT:2"), ("nada", "")], lambda x: F.array_join(F.transform(F.slice(refs.exact(references(x)), 1, 30), refs.key_of), "|"))
