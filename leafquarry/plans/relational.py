"""Queries over the relational operators (S, P, J, A, O, U)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafquarry.functions import dates, refs
from leafquarry.operators import catalog as op
from leafquarry.plans.domain import LAST_YEAR, TODAY, Tables, sql
from leafquarry.plans.registry import query
from leafquarry.sources import tables as src
from leafquarry.streaming import windows


def q(name: str, body: str | None = None):
    """Registers f(tables) with its SQL over the domain's tables."""

    def add(f):
        query(name, sql(body) if body else None)(lambda spark, folder: f(Tables(spark, folder)))
        return f

    return add


c = F.col

q("s01_scan", "SELECT id, hash_md5, tipo, anio FROM docs")(lambda t: t.docs.select("id", "hash_md5", "tipo", "anio"))
q("s02_lookup", "SELECT id, hash_md5 FROM docs WHERE hash_md5 = (SELECT hash_md5 FROM docs WHERE id = 7) ORDER BY id LIMIT 1")(
    lambda t: src.lookup(t.docs.join(t.docs.filter("id = 7").select("hash_md5"), "hash_md5", "left_semi").withColumn("one", F.lit(1)), "one", 1).select("id", "hash_md5")
)
q("s02_known_hashes", "SELECT DISTINCT md5(text) AS hash_md5, FALSE AS nuevo FROM documents WHERE md5(text) IN (SELECT hash_md5 FROM docs WHERE id % 2 = 0)")(
    lambda t: src.known(t.docs.filter("id % 2 = 0"), t.docs.select("hash_md5").distinct(), ["hash_md5"]).withColumn("nuevo", F.lit(False))
)
q("s02_unknown_urls", "SELECT url_sii FROM docs WHERE url_sii NOT IN (SELECT url_sii FROM docs WHERE id % 2 = 0)")(
    lambda t: src.known(t.docs.filter("id % 2 = 0"), t.docs.select("url_sii"), ["url_sii"], wanted=False)
)
q("s03_identity", "SELECT event_id FROM scraper_log l WHERE EXISTS (SELECT 1 FROM docs d WHERE d.tipo = split_part(l.tipo, '_', 1) AND d.numero = l.numero AND d.anio = l.anio)")(
    lambda t: src.known(t.docs, t.scraper_log.withColumn("tipo", src.base_type(c("tipo"))), ["tipo", "numero", "anio"]).select("event_id")
)
q("s22_s23_common_columns", "SELECT id, tipo FROM docs")(lambda t: src.common_columns(t.docs, t.docs.select("tipo", "id", F.lit(1).alias("otra"))))
q("s25_documents_with_side_table", "SELECT d.id, d.tipo, d.anio, d.numero, j.sii_id, j.pdf_local AS pdf FROM docs d LEFT JOIN judicial_docs j ON j.doc_id = d.id")(
    lambda t: t.docs.join(t.judicial_docs.select(c("doc_id").alias("id"), "sii_id", c("pdf_local").alias("pdf")), "id", "left").select("id", "tipo", "anio", "numero", "sii_id", "pdf").orderBy("tipo", "anio", "numero", "id")
)
q("s26_error_listing", "SELECT event_id, anio, estado FROM scraper_log WHERE tipo = 'resolucion' AND estado <> 'ok'")(
    lambda t: t.scraper_log.filter("tipo = 'resolucion' AND estado <> 'ok'").select("event_id", "anio", "estado").orderBy(c("anio").desc(), "event_id")
)
q("s10_number_gaps", """, have AS (SELECT DISTINCT CAST(numero AS BIGINT) AS n FROM docs WHERE anio = 2001 AND tipo = 'oficio'),
   m AS (SELECT r.n, h.n IS NOT NULL AS hit, count(h.n) OVER (ORDER BY r.n) AS island FROM (SELECT unnest(range(1, 301)) AS n) r LEFT JOIN have h ON h.n = r.n),
   k AS (SELECT n, hit, row_number() OVER (PARTITION BY island ORDER BY n) - CASE WHEN island > 0 THEN 1 ELSE 0 END AS misses FROM m)
   SELECT n, CAST(misses AS INT) AS misses FROM k WHERE NOT hit AND n <= coalesce((SELECT min(n) FROM k WHERE misses >= 30), 1000)""")(
    lambda t: op.gaps(t.docs.filter("anio = 2001 AND tipo = 'oficio'"), "numero", 300)
)

q("p01_equal", "SELECT id FROM docs WHERE tipo = 'oficio' AND anio = 2005 AND fuente = 'src8' AND vigente = 1")(lambda t: t.docs.filter("tipo = 'oficio' AND anio = 2005 AND fuente = 'src8' AND vigente = 1").select("id"))
q("p02_contains4", "SELECT id FROM docs WHERE titulo ILIKE '%tion%' OR contenido ILIKE '%idiot%' OR palabras_clave ILIKE '%tion%' OR resumen ILIKE '%tion%'")(
    lambda t: t.docs.filter(op.any_contains("tion", "titulo", "palabras_clave", "resumen") | op.any_contains("idiot", "contenido")).select("id")
)
q("p03_contains3", "SELECT id, CAST(1000.0 AS DOUBLE) AS rank FROM docs WHERE titulo ILIKE '%ering%' OR resumen ILIKE '%ering%' OR contenido ILIKE '%ering%' ORDER BY fecha DESC NULLS LAST, id DESC LIMIT 8")(
    lambda t: t.docs.filter(op.any_contains("ering", "titulo", "resumen", "contenido")).orderBy(c("fecha").desc_nulls_last(), c("id").desc()).limit(8).select("id", F.lit(1000.0).alias("rank"))
)
q("p04_subject", "SELECT id FROM docs WHERE coalesce(materia, '') LIKE '%ria 3%'")(lambda t: t.docs.filter(op.any_contains("ria 3", "materia")).select("id"))
q("p05_array_member", "SELECT doc_id AS id FROM (SELECT doc_id, list(ley) AS leyes FROM articulos_idx GROUP BY doc_id) WHERE list_contains(leyes, 'ITE')")(
    lambda t: t.articulos_idx.groupBy("doc_id").agg(F.collect_list("ley").alias("leyes")).filter(F.array_contains("leyes", "ITE")).select(c("doc_id").alias("id"))
)
q("p06_article_text", "SELECT id FROM docs WHERE contenido LIKE '%artículo 77 %'")(lambda t: t.docs.filter(F.contains("contenido", F.lit("artículo 77 "))).select("id"))
q("p07_range", "SELECT id FROM docs WHERE anio BETWEEN 2001 AND 2004")(lambda t: t.docs.filter(c("anio").between(2001, 2004)).select("id"))
q("p08_open_range", "SELECT id FROM docs WHERE anio >= 2010 AND tipo = 'circular' ORDER BY anio DESC, id DESC LIMIT 20")(
    lambda t: t.docs.filter("anio >= 2010 AND tipo = 'circular'").orderBy(c("anio").desc(), c("id").desc()).limit(20).select("id")
)
q("p09_blank", "SELECT id FROM docs WHERE (materia IS NULL OR trim(materia) = '') AND coalesce(chars_texto, 0) = 0")(lambda t: t.docs.filter(op.blank(c("materia")) & (F.coalesce("chars_texto", F.lit(0)) == 0)).select("id"))
q("p10_truncated", "SELECT id FROM docs WHERE length(contenido) BETWEEN 1450 AND 1500")(lambda t: t.docs.filter(F.length("contenido").between(1450, 1500)).select("id"))
q("p11_short", "SELECT id, length(trim(coalesce(contenido, ''))) AS n FROM docs WHERE length(trim(coalesce(contenido, ''))) < 1500 ORDER BY n, id LIMIT 500")(
    lambda t: t.docs.select("id", F.length(F.trim(F.coalesce("contenido", F.lit("")))).cast("bigint").alias("n")).filter("n < 1500").orderBy("n", "id").limit(500)
)
q("p12_negated", "SELECT id FROM docs WHERE NOT (anio BETWEEN 2000 AND 2010 AND tipo IN ('circular', 'oficio'))")(lambda t: t.docs.filter(~(c("anio").between(2000, 2010) & c("tipo").isin("circular", "oficio"))).select("id"))
q("p13_text_year", "SELECT id FROM docs WHERE substr(fecha, 1, 4) > lpad(CAST(anio - id % 2 AS VARCHAR), 4, '0')")(lambda t: t.docs.filter(F.substring("fecha", 1, 4) > F.lpad((c("anio") - c("id") % 2).cast("string"), 4, "0")).select("id"))
q("p14_today", f"SELECT event_id FROM scraper_log WHERE estado = 'ok' AND CAST(fecha AS DATE) = DATE '{TODAY}'")(
    lambda t: t.scraper_log.filter((c("estado") == "ok") & (c("fecha") >= F.lit(TODAY).cast("timestamp_ntz")) & (c("fecha") < F.date_add(F.lit(TODAY).cast("date"), 1).cast("timestamp_ntz"))).select("event_id")
)
q("p15_in_list", "SELECT id FROM docs WHERE tipo IN ('circular', 'judicial') AND id IN (3, 4, 8, 12, 999999)")(lambda t: t.docs.filter(c("tipo").isin("circular", "judicial") & c("id").isin(3, 4, 8, 12, 999999)).select("id"))
q("p16_kind", "SELECT id, CASE WHEN pdf_local LIKE '%.pdf' THEN 'pdf' WHEN id % 4 = 0 THEN 'doc' WHEN length(contenido) < 700 THEN 'scan' ELSE 'html' END AS kind FROM docs")(
    lambda t: t.docs.select("id", F.when(c("pdf_local").endswith(".pdf"), "pdf").when(c("id") % 4 == 0, "doc").when(F.length("contenido") < 700, "scan").otherwise("html").alias("kind"))
)
q("p22_year_filter", "SELECT id FROM docs WHERE regexp_matches(fecha, '^\\d{4}-') AND CAST(substr(fecha, 1, 4) AS INT) BETWEEN 1999 AND 2003")(
    lambda t: t.docs.filter(c("fecha").rlike(r"^\d{4}-") & F.substring("fecha", 1, 4).try_cast("int").between(1999, 2003)).select("id")
)
q("p23_year_of", "SELECT id, coalesce(try_cast(substr(fecha, 1, 4) AS INT), 0) AS y FROM docs")(lambda t: t.docs.select("id", F.coalesce(F.substring("fecha", 1, 4).try_cast("int"), F.lit(0)).alias("y")))
q("p24_least_text", "SELECT id, CASE WHEN length(contenido) < 50 THEN 'rechazado' WHEN length(contenido) < 400 THEN 'insuficiente' ELSE 'ok' END AS gate FROM docs")(
    lambda t: t.docs.select("id", F.when(F.length("contenido") < 50, "rechazado").when(F.length("contenido") < 400, "insuficiente").otherwise("ok").alias("gate"))
)

q("j02_side_tables", """SELECT d.id, any_value(j.corte) AS corte, coalesce(any_value(d.pdf_local), any_value(j.pdf_local)) AS pdf,
   array_to_string(list_sort(list(DISTINCT r.cuerpo_normativo) FILTER (r.cuerpo_normativo IS NOT NULL)), ',') AS cuerpos
   FROM docs d LEFT JOIN judicial_docs j ON j.doc_id = d.id LEFT JOIN judicial_relaciones r ON r.doc_id = d.id GROUP BY d.id""")(
    lambda t: op.with_side_tables(t.docs, t.judicial_docs, t.judicial_relaciones).select("id", "corte", "pdf", "cuerpos")
)
q("j04_by_article", "SELECT DISTINCT d.id, d.anio FROM articulos_idx a JOIN docs d ON d.id = a.doc_id WHERE a.ley = 'LIR' AND a.articulo = '13' ORDER BY d.anio DESC NULLS LAST, d.id DESC LIMIT 100")(
    lambda t: t.docs.join(t.articulos_idx.filter("ley = 'LIR' AND articulo = '13'"), c("id") == c("doc_id"), "left_semi").select("id", "anio").orderBy(c("anio").desc_nulls_last(), c("id").desc()).limit(100)
)
q("j05_j06_search_filters", """SELECT id FROM docs d WHERE EXISTS (SELECT 1 FROM articulos_idx a WHERE a.doc_id = d.id AND a.ley = 'LIR')
   AND EXISTS (SELECT 1 FROM articulos_idx a WHERE a.doc_id = d.id AND a.ley = 'LIR' AND a.articulo = '28')""")(
    lambda t: op.filtered(t.docs, t.articulos_idx, t.judicial_docs, t.judicial_relaciones, op.Search(ley="lir", articulo="Art. 28")).select("id")
)
q("j02_court_and_body", "SELECT DISTINCT d.id FROM docs d JOIN judicial_docs j ON j.doc_id = d.id JOIN judicial_relaciones r ON r.doc_id = d.id WHERE j.corte = 'Otros' AND r.cuerpo_normativo = 'Ley de Timbres'")(
    lambda t: op.filtered(t.docs, t.articulos_idx, t.judicial_docs, t.judicial_relaciones, op.Search(corte="Otros", cuerpo="Ley de Timbres")).select("id")
)
q("j07_related", """, cited AS (SELECT DISTINCT doc_id, ley, articulo FROM articulos_idx WHERE ley IS NOT NULL AND articulo IS NOT NULL),
   own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ley, articulo) AS n FROM cited) WHERE n <= 4),
   f AS (SELECT DISTINCT o.doc_id, c.doc_id AS other_id, d.anio FROM own o JOIN cited c USING (ley, articulo) JOIN docs d ON d.id = c.doc_id WHERE c.doc_id <> o.doc_id)
   SELECT doc_id, other_id, anio, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY anio DESC NULLS LAST, other_id DESC) AS place FROM f) WHERE place <= 8""")(
    lambda t: op.related(t.docs, t.articulos_idx)
)
q("j08_versions", "SELECT b.id, b.anio FROM docs a JOIN docs b ON a.tipo = b.tipo AND a.numero = b.numero WHERE a.id = 5 AND b.id <> 5")(lambda t: op.versions(t.docs, 5).select("id", "anio"))
q("j09_a07_cases", "SELECT c.id, c.nombre, c.estado, count(n.id) AS notas, CAST(sum(CASE WHEN n.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS documentos FROM casos c LEFT JOIN caso_notas n ON n.caso_id = c.id GROUP BY ALL")(
    lambda t: op.case_totals(t.casos, t.caso_notas)
)
q("j10_case_detail", "SELECT n.id, n.contenido, d.titulo FROM caso_notas n LEFT JOIN docs d ON d.id = n.doc_id WHERE n.caso_id = 7")(
    lambda t: t.caso_notas.filter("caso_id = 7").join(t.docs.select(c("id").alias("d"), "titulo"), c("doc_id") == c("d"), "left").select("id", "contenido", "titulo")
)
q("j12_scalar_subquery", "SELECT id, (SELECT max(pdf_local) FROM judicial_docs j WHERE j.doc_id = d.id) AS jd_pdf FROM docs d")(
    lambda t: t.docs.join(t.judicial_docs.groupBy(c("doc_id").alias("id")).agg(F.max("pdf_local").alias("jd_pdf")), "id", "left").select("id", "jd_pdf")
)
q("j13_semi", "SELECT id FROM caso_notas WHERE doc_id IS NULL OR doc_id IN (SELECT id FROM docs WHERE tipo = 'oficio')")(
    lambda t: t.caso_notas.join(t.docs.filter("tipo = 'oficio'").select(c("id").alias("d")), c("doc_id") == c("d"), "left").filter("doc_id IS NULL OR d IS NOT NULL").select("id")
)
q("j14_judicial", "SELECT j.sii_id, d.anio, j.corte FROM judicial_docs j JOIN docs d ON d.id = j.doc_id WHERE d.anio >= 2015")(
    lambda t: t.docs.filter("anio >= 2015").join(t.judicial_docs, c("id") == c("doc_id")).select("sii_id", "anio", "corte")
)
q("j15_overlay", """SELECT blob, max_by(id, (pr, id)) AS id FROM (SELECT regexp_extract(url_sii, 'id=([^&]+)', 1) AS blob, id, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS pr FROM docs) GROUP BY blob""")(
    lambda t: op.latest_by(t.docs.select(refs.blob_id(c("url_sii")).alias("blob"), "id", (c("id") % 2 == 0).alias("pr")), ["blob"], [c("pr").desc(), c("id").desc()]).select("blob", "id")
)
q("j16_missing_blobs", """SELECT regexp_extract(url_sii, 'id=([^&]+)', 1) AS blob, min(id) AS id, array_to_string(list_sort(list(DISTINCT tipo)), ' / ') AS tipos FROM docs
   WHERE regexp_extract(url_sii, 'id=([^&]+)', 1) NOT IN (SELECT regexp_extract(url_sii, 'id=([^&]+)', 1) FROM docs WHERE id % 3 = 0) GROUP BY 1""")(
    lambda t: t.docs.withColumn("blob", refs.blob_id(c("url_sii")))
    .join(t.docs.filter("id % 3 = 0").select(refs.blob_id(c("url_sii")).alias("blob")), "blob", "left_anti")
    .groupBy("blob")
    .agg(F.min("id").alias("id"), F.array_join(F.array_sort(F.collect_set("tipo")), " / ").alias("tipos"))
)
q("j20_existing", "SELECT l.doc_id, j.sii_id IS NOT NULL AS existe FROM labels l LEFT JOIN judicial_docs j ON j.doc_id = l.doc_id")(
    lambda t: t.raw("labels").join(t.judicial_docs.select("doc_id", "sii_id"), "doc_id", "left").select("doc_id", c("sii_id").isNotNull().alias("existe"))
)

q("a01_count", "SELECT count(*) AS n FROM docs")(lambda t: t.docs.agg(F.count(F.lit(1)).alias("n")))
q("a02_by_type", "SELECT tipo, count(*) AS cnt FROM docs GROUP BY tipo")(lambda t: op.top(t.docs, ["tipo"]))
q("a03_by_year", "SELECT anio, count(*) AS cnt FROM docs WHERE anio IS NOT NULL GROUP BY anio ORDER BY anio DESC LIMIT 15")(
    lambda t: t.docs.filter("anio IS NOT NULL").groupBy("anio").agg(F.count(F.lit(1)).alias("cnt")).orderBy(c("anio").desc()).limit(15)
)
q("a03_by_year_with_null", "SELECT anio, count(*) AS cnt FROM docs GROUP BY anio ORDER BY anio DESC NULLS LAST LIMIT 10")(
    lambda t: t.docs.groupBy("anio").agg(F.count(F.lit(1)).alias("cnt")).orderBy(c("anio").desc_nulls_last()).limit(10)
)
q("a04_top_articles", "SELECT ley, articulo, count(*) AS cnt, 'Art. ' || articulo || ' ' || ley AS label FROM articulos_idx WHERE ley IS NOT NULL AND articulo IS NOT NULL GROUP BY ley, articulo ORDER BY cnt DESC, ley, articulo LIMIT 15")(
    lambda t: op.top(t.articulos_idx.filter("ley IS NOT NULL AND articulo IS NOT NULL"), ["ley", "articulo"], 15).withColumn("label", refs.reference(c("ley"), c("articulo"))["label"])
)
q("a05_latest", "SELECT max(fecha_carga) AS latest FROM docs")(lambda t: t.docs.agg(F.max("fecha_carga").alias("latest")))
q("a06_log_totals", "SELECT tipo, anio, CAST(sum(CASE WHEN estado = 'ok' THEN 1 ELSE 0 END) AS BIGINT) AS ok, count(*) AS total FROM scraper_log GROUP BY tipo, anio ORDER BY anio DESC, tipo LIMIT 30")(
    lambda t: t.scraper_log.groupBy("tipo", "anio").agg(F.count_if(c("estado") == "ok").alias("ok"), F.count(F.lit(1)).alias("total")).orderBy(c("anio").desc(), "tipo").limit(30)
)
q("a09_distinct_groups", "SELECT count(*) AS n FROM (SELECT d.id FROM docs d JOIN judicial_relaciones r ON r.doc_id = d.id GROUP BY d.id)")(
    lambda t: t.docs.join(t.judicial_relaciones, c("id") == c("doc_id"), "left_semi").agg(F.count(F.lit(1)).alias("n"))
)
q("a10_facets", "SELECT DISTINCT materia FROM docs WHERE materia IS NOT NULL AND trim(materia) <> ''")(lambda t: op.facet(t.docs, "materia"))
q("a10_courts", "SELECT DISTINCT corte FROM judicial_docs")(lambda t: op.facet(t.judicial_docs, "corte"))
q("a11_laws", "SELECT ley FROM (SELECT DISTINCT ley FROM articulos_idx UNION SELECT 'FT') WHERE ley IS NOT NULL")(
    lambda t: t.articulos_idx.select("ley").union(t.docs.select(F.explode(F.array(F.lit("FT"))).alias("ley"))).filter("ley IS NOT NULL").distinct().orderBy(F.array_position(F.array(*map(F.lit, refs.CODES)), c("ley")))
)
q("a12_profile", """SELECT tipo, anio, count(*) AS docs, count(*) FILTER (WHERE length(coalesce(contenido, '')) BETWEEN 49950 AND 50000) AS sospechosos_truncados, count(*) FILTER (WHERE coalesce(chars_texto, 0) = 0) AS sin_chars,
   count(*) FILTER (WHERE coalesce(paginas, 0) = 0) AS sin_paginas, CAST(min(length(contenido)) AS INT) AS min_len, round(avg(length(contenido)), 1) AS avg_len, CAST(max(length(contenido)) AS INT) AS max_len
   FROM docs WHERE anio BETWEEN 1995 AND 2026 GROUP BY tipo, anio""")(lambda t: op.profile(t.docs, 1995, LAST_YEAR))
q("a13_integrity", """SELECT count(*) AS total, count(*) FILTER (WHERE trim(coalesce(contenido, '')) = '') AS sin_contenido, count(*) FILTER (WHERE coalesce(chars_texto, 0) = 0) AS sin_chars, count(*) FILTER (WHERE coalesce(paginas, 0) = 0) AS sin_paginas,
   count(*) FILTER (WHERE trim(coalesce(pdf_local, '')) = '') AS sin_pdf, count(*) FILTER (WHERE length(trim(coalesce(contenido, ''))) < 1500) AS cortos FROM docs WHERE anio BETWEEN 1995 AND 2020""")(lambda t: op.integrity(t.docs, 1995, 2020))
BRANCH = """CASE WHEN tipo = 'oficio' AND upper(coalesce(subtema, '')) LIKE 'RENTA%' THEN 'oficio / LIR' WHEN tipo = 'oficio' AND upper(coalesce(subtema, '')) LIKE 'IVA%' THEN 'oficio / IVA'
   WHEN tipo = 'oficio' AND upper(coalesce(subtema, '')) LIKE 'OTRAS%' THEN 'oficio / OTRAS NORMAS' WHEN tipo = 'oficio' THEN 'oficio / SIN SUBCLASIFICAR' ELSE tipo END"""
q("a14_branches", f"SELECT {BRANCH} AS rama, anio, count(*) AS cnt FROM docs GROUP BY 1, 2")(lambda t: t.docs.groupBy(op.office_branch(c("tipo"), c("subtema")).alias("rama"), "anio").agg(F.count(F.lit(1)).alias("cnt")))
q("a15_states", "SELECT tipo, estado, count(*) AS cnt FROM scraper_log WHERE anio = 2021 GROUP BY tipo, estado")(lambda t: t.scraper_log.filter("anio = 2021").groupBy("tipo", "estado").agg(F.count(F.lit(1)).alias("cnt")))
PARITY = """, a AS (SELECT {k}, count(*) AS n FROM {x} GROUP BY ALL), b AS (SELECT {k}, count(*) AS m FROM {y} GROUP BY ALL)
   SELECT {k}, coalesce(n, 0) AS api, coalesce(m, 0) AS db, CASE WHEN coalesce(n, 0) = coalesce(m, 0) THEN 'OK' ELSE 'DIF' END AS estado,
   CASE WHEN coalesce(n, 0) = 0 THEN 100.0 ELSE round(coalesce(m, 0) * 100 / n, 2) END AS pct FROM a FULL JOIN b USING ({k})"""
q("a16_a17_court_parity", PARITY.format(k="corte", x="(SELECT corte FROM judicial_docs WHERE corte <> 'Otros')", y="(SELECT corte FROM judicial_docs WHERE doc_id % 5 > 0)"))(
    lambda t: op.compared(t.judicial_docs.filter("corte <> 'Otros'"), t.judicial_docs.filter("doc_id % 5 > 0"), ["corte"])
)
q("a18_branch_parity", PARITY.format(k="anio, tipo", x="(SELECT anio, tipo FROM docs WHERE anio > 2010)", y="(SELECT anio, tipo FROM docs WHERE anio > 2010 AND id % 7 > 0)"))(
    lambda t: op.compared(t.docs.filter("anio > 2010"), t.docs.filter("anio > 2010 AND id % 7 > 0"), ["anio", "tipo"])
)
q("a20_duplicates", "SELECT anio, numero, count(*) AS cnt FROM docs WHERE anio IS NOT NULL GROUP BY anio, numero HAVING count(*) > 1")(lambda t: op.repeated_values(t.docs.filter("anio IS NOT NULL"), ["anio", "numero"]))
q("a21_year_difference", """, a AS (SELECT DISTINCT numero FROM docs WHERE anio = 2003), b AS (SELECT DISTINCT numero FROM docs WHERE anio = 2004)
   SELECT (SELECT string_agg(numero, ',' ORDER BY numero) FROM a WHERE numero NOT IN (SELECT numero FROM b)) AS faltan, (SELECT string_agg(numero, ',' ORDER BY numero) FROM b WHERE numero NOT IN (SELECT numero FROM a)) AS sobran""")(
    lambda t: (
        lambda a, b: a.join(b, "numero", "left_anti").agg(F.array_join(F.array_sort(F.collect_list("numero")), ",").alias("faltan")).join(
            b.join(a, "numero", "left_anti").agg(F.array_join(F.array_sort(F.collect_list("numero")), ",").alias("sobran")), F.lit(True)
        )
    )(*(t.docs.filter(c("anio") == y).select("numero").distinct() for y in (2003, 2004)))
)
q("a22_merged_by_number", """SELECT numero, (list(titulo ORDER BY id) FILTER (coalesce(titulo, '') <> ''))[1] AS titulo, (list(resumen ORDER BY length(resumen) DESC, id))[1] AS resumen FROM docs GROUP BY numero""")(
    lambda t: t.docs.groupBy("numero").agg(
        F.min_by("titulo", F.when(c("titulo") != "", c("id"))).alias("titulo"), F.max_by("resumen", F.struct(F.length("resumen"), -c("id"))).alias("resumen")
    )
)
q("a23_relations_by_law", """SELECT doc_id, cuerpo_normativo, string_agg(articulo || CASE WHEN nota IS NOT NULL THEN ' (' || nota || ')' ELSE '' END, ' | ' ORDER BY articulo, nota NULLS FIRST) AS articulos FROM judicial_relaciones GROUP BY ALL""")(
    lambda t: t.judicial_relaciones.groupBy("doc_id", "cuerpo_normativo").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("articulo", F.coalesce("nota", F.lit("")).alias("nota")))), lambda r: F.concat(r["articulo"], F.when(r["nota"] != "", F.concat(F.lit(" ("), r["nota"], F.lit(")"))).otherwise(""))), " | ").alias("articulos")
    )
)
q("a24_run_totals", "SELECT split_part(tipo, '_', 1) AS paso, count(*) FILTER (WHERE estado = 'ok') AS nuevos, count(*) FILTER (WHERE estado <> 'ok') AS errores FROM scraper_log GROUP BY 1")(
    lambda t: t.scraper_log.groupBy(src.base_type(c("tipo")).alias("paso")).agg(F.count_if(c("estado") == "ok").alias("nuevos"), F.count_if(c("estado") != "ok").alias("errores"))
)
q("a25_hash_of_parts", "SELECT conv_id, md5(string_agg(text, '' ORDER BY turn, role)) AS h FROM conversations GROUP BY conv_id")(
    lambda t: t.raw("conversations").groupBy("conv_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda r: r["text"]), "")).alias("h"))
)

q("o01_page", "SELECT id, fecha FROM docs ORDER BY coalesce(fecha, '') DESC, id DESC LIMIT 15 OFFSET 15")(lambda t: op.page(t.docs, 2).select("id", "fecha"))
q("o02_recent", "SELECT id FROM docs ORDER BY coalesce(fecha_carga, fecha) DESC, id DESC LIMIT 6")(lambda t: t.docs.orderBy(F.coalesce("fecha_carga", "fecha").desc(), c("id").desc()).limit(6).select("id"))
q("o03_searches", "SELECT conv_id, turn, termino FROM historial ORDER BY conv_id DESC, turn DESC LIMIT 8")(lambda t: t.historial.orderBy(c("conv_id").desc(), c("turn").desc()).limit(8).select("conv_id", "turn", "termino"))
q("o04_largest_number", "SELECT tipo, max_by(id, CAST(numero AS BIGINT) * 1000000 - id) AS id FROM docs GROUP BY tipo")(
    lambda t: op.latest_by(t.docs.withColumn("k", dates.leading_number(c("numero"))), ["tipo"], [c("k").desc(), c("id")]).select("tipo", "id")
)
q("o05_longest", "SELECT id, length(contenido) AS n FROM docs ORDER BY n DESC, id LIMIT 50")(lambda t: t.docs.select("id", F.length("contenido").cast("bigint").alias("n")).orderBy(c("n").desc(), "id").limit(50))
q("o06_sample", "SELECT id FROM docs ORDER BY md5(CAST(id AS VARCHAR) || ':7'), id LIMIT 20")(lambda t: op.sample(t.docs, 20, 7).select("id"))
q("o09_cases", "SELECT id FROM casos ORDER BY id DESC LIMIT 10")(lambda t: t.casos.orderBy(c("id").desc()).limit(10).select("id"))
q("o10_law_order", "SELECT doc_id, array_to_string(list_filter(['CT', 'LIR', 'LIVS', 'ITE'], lambda x: list_contains(l, x)), ',') AS leyes FROM (SELECT doc_id, list(ley) AS l FROM articulos_idx GROUP BY doc_id)")(
    lambda t: t.articulos_idx.groupBy("doc_id").agg(F.array_join(refs.laws_in_order(F.collect_set("ley")), ",").alias("leyes"))
)
q("o11_newest_ids", "SELECT id FROM docs WHERE tipo = 'judicial' ORDER BY anio DESC NULLS LAST, id LIMIT 25")(lambda t: t.docs.filter("tipo = 'judicial'").orderBy(c("anio").desc_nulls_last(), "id").limit(25).select("id"))

q("u01_union", "SELECT id FROM docs UNION SELECT doc_id FROM labels")(lambda t: t.docs.select("id").union(t.raw("labels").select("doc_id")).distinct())
q("u02_difference", "SELECT id FROM docs EXCEPT SELECT doc_id FROM labels")(lambda t: t.docs.select("id").join(t.raw("labels").select(c("doc_id").alias("id")), "id", "left_anti"))
q("u03_either", "SELECT id FROM docs WHERE id IN (SELECT doc_id FROM labels) OR anio BETWEEN 2000 AND 2001")(
    lambda t: t.docs.join(t.raw("labels").select(c("doc_id").alias("l")).distinct(), c("id") == c("l"), "left").filter("l IS NOT NULL OR anio BETWEEN 2000 AND 2001").select("id")
)
q("u04_bag_union", "SELECT id, 'doc' AS kind FROM docs UNION ALL SELECT doc_id, 'label' FROM labels")(lambda t: t.docs.select("id", F.lit("doc").alias("kind")).unionByName(t.raw("labels").select(c("doc_id").alias("id"), F.lit("label").alias("kind"))))
q("u08_targets", "SELECT id FROM docs WHERE id IN (5, 9, 13) ")(lambda t: t.docs.filter(c("id").isin(5, 9, 13)).select("id"))
q("w07_daily_counts", "SELECT CAST(fecha AS DATE) AS day, estado, count(*) AS cnt FROM scraper_log GROUP BY 1, 2")(lambda t: t.scraper_log.groupBy(c("fecha").cast("date").alias("day"), "estado").agg(F.count(F.lit(1)).alias("cnt")))
q("w05_progress_buffer", "SELECT event_id, CASE WHEN estado = 'ok' THEN 'OK' ELSE 'WARN' END AS level FROM scraper_log ORDER BY event_id DESC LIMIT 300")(
    lambda t: t.scraper_log.orderBy(c("event_id").desc()).limit(300).select("event_id", F.when(c("estado") == "ok", "OK").otherwise("WARN").alias("level"))
)
q("w06_running_totals", "SELECT event_id, count(*) FILTER (estado = 'ok') OVER (PARTITION BY tipo ORDER BY fecha, event_id ROWS UNBOUNDED PRECEDING) AS ok_so_far FROM scraper_log")(
    lambda t: t.scraper_log.select("event_id", F.count(F.when(c("estado") == "ok", 1)).over(Window.partitionBy("tipo").orderBy("fecha", "event_id").rowsBetween(Window.unboundedPreceding, 0)).alias("ok_so_far"))
)

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
q("w07_sessions", """, e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
   g AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
   SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS last_before, count(*) AS n FROM g GROUP BY user_id, g""")(
    lambda t: windows.sessions(t.raw("events"), "ts", ["user_id"], "30 minutes").withColumns({k: F.date_format(k, STAMP) for k in ("start", "last_before")})
)
q("w07_sliding", """, e AS (SELECT event_type, unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS start FROM events)
   SELECT event_type, CAST(start AS DATE) AS start, count(*) AS n FROM e GROUP BY ALL""")(
    lambda t: windows.sliding(t.raw("events"), "ts", ["event_type"], "7 days", "1 day").withColumn("start", c("start").cast("date"))
)
