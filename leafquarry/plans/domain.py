"""The domain's tables (documents of four kinds, their side tables, logs, cases) as views of the driver's tables.

``Tables`` builds them as DataFrames, ``SQL`` as the same common table expressions for DuckDB; both are derived from
ids by the same arithmetic, so results can be compared.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession

from leafquarry.sources.tables import read_table

TYPES = ("circular", "oficio", "resolucion", "judicial")
COURTS = ("Corte Suprema", "Corte de Apelaciones", "Tribunal Tributario y Aduanero", "Tribunal Constitucional", "Juzgado de Garantia", "Otros")
LAWS = ("LIR", "LIVS", "CT")
BODIES = ("Codigo Tributario", "Ley sobre Impuesto a la Renta", "Ley de Timbres")
#: The latest year of the corpus, and the day that stands for today.
LAST_YEAR, TODAY = 2026, "2024-01-15"

# Written for both dialects: %, ||, lpad, substr and CASE mean the same in Spark and DuckDB.
DOCS = """
SELECT doc_id AS id, md5(coalesce(text, '')) AS hash_md5,
  CASE doc_id % 4 WHEN 0 THEN 'circular' WHEN 1 THEN 'oficio' WHEN 2 THEN 'resolucion' ELSE 'judicial' END AS tipo,
  CAST(doc_id % 200 AS {string}) AS numero,
  CAST(CASE WHEN doc_id % 97 = 0 THEN NULL ELSE 1995 + doc_id % 32 END AS INT) AS anio,
  CASE WHEN doc_id % 50 = 49 THEN NULL
       ELSE CAST(1995 + doc_id % 32 AS {string}) || '-' || lpad(CAST(doc_id % 12 + 1 AS {string}), 2, '0') || '-' || lpad(CAST(doc_id % 28 + 1 AS {string}), 2, '0') END AS fecha,
  substr(text, 1, 60) AS titulo,
  CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE 'materia ' || CAST(doc_id % 7 AS {string}) END AS materia,
  CASE doc_id % 4 WHEN 1 THEN CASE (doc_id // 4) % 4 WHEN 0 THEN 'RENTA' WHEN 1 THEN 'Iva - x' WHEN 2 THEN 'OTRAS' ELSE NULL END ELSE NULL END AS subtema,
  'Según el artículo ' || CAST(doc_id % 120 + 1 AS {string}) || ' de la ' || CASE doc_id % 3 WHEN 0 THEN 'LIR' WHEN 1 THEN 'LIVS' ELSE 'CT' END
    || '; ver oficio de ' || CAST(doc_id % 28 + 1 AS {string}) || ' de marzo de ' || CAST(1995 + doc_id % 32 AS {string}) || '. ' || text AS contenido,
  CASE WHEN doc_id % 9 = 0 THEN '' ELSE substr(text, 1, 200) END AS resumen,
  'http://host.example/' || CAST(doc_id AS {string}) || '?id=' || CAST(doc_id % 500 AS {string}) || '&v=1' AS url_sii,
  'Ref ' || CAST(doc_id % 300 AS {string}) AS referencia,
  source || ' ' || lang AS palabras_clave, lang, source AS fuente,
  CAST(doc_id % 40 AS INT) AS paginas, CAST(CASE WHEN doc_id % 33 = 0 THEN NULL ELSE n_chars END AS BIGINT) AS chars_texto,
  CASE WHEN doc_id % 6 = 0 THEN '' WHEN doc_id % 6 = 1 THEN NULL ELSE 'pdfs/' || CAST(doc_id % 200 AS {string}) || '.pdf' END AS pdf_local,
  CAST(CASE WHEN doc_id % 11 = 0 THEN 0 ELSE 1 END AS INT) AS vigente,
  '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS {string}), 2, '0') || ' 10:00:00' AS fecha_carga
FROM documents
"""
JUDICIAL_DOCS = """
SELECT doc_id, doc_id + 100000 AS sii_id, CASE WHEN doc_id % 2 = 1 THEN 'ROL' ELSE NULL END AS tipo_codigo,
  CASE (doc_id // 4) % 6 WHEN 0 THEN 'Corte Suprema' WHEN 1 THEN 'Corte de Apelaciones' WHEN 2 THEN 'Tribunal Tributario y Aduanero'
    WHEN 3 THEN 'Tribunal Constitucional' WHEN 4 THEN 'Juzgado de Garantia' ELSE 'Otros' END AS corte,
  'Sala ' || CAST(doc_id % 3 AS {string}) AS tribunal, CASE WHEN doc_id % 8 = 3 THEN 'pdfs/judicial/' || CAST(doc_id AS {string}) || '.pdf' ELSE NULL END AS pdf_local
FROM documents WHERE doc_id % 4 = 3
"""
RELATIONS = """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Codigo Tributario' WHEN 1 THEN 'Ley sobre Impuesto a la Renta' ELSE 'Ley de Timbres' END AS cuerpo_normativo,
  CAST(doc_id % 60 AS {string}) AS articulo, CASE WHEN doc_id % 5 = 0 THEN 'nota ' || CAST(doc_id % 4 AS {string}) ELSE NULL END AS nota FROM documents WHERE doc_id % 4 = 3
UNION ALL
SELECT doc_id, 'Ley de Timbres', CAST(doc_id % 30 AS {string}), NULL FROM documents WHERE doc_id % 8 = 3
"""
ARTICLES = """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'LIR' WHEN 1 THEN 'LIVS' ELSE 'CT' END AS ley, CAST(doc_id % 120 + 1 AS {string}) AS articulo FROM documents
UNION ALL
SELECT doc_id, 'ITE', CAST(NULL AS {string}) FROM documents WHERE doc_id % 10 = 0
UNION ALL
SELECT doc_id, 'LIR', CAST(doc_id % 40 + 1 AS {string}) FROM documents WHERE doc_id % 7 = 0 AND doc_id % 3 <> 0
"""
LOG = """
SELECT event_id, CASE event_type WHEN 'click' THEN 'oficio_iva' WHEN 'view' THEN 'circular' WHEN 'purchase' THEN 'resolucion' ELSE event_type END AS tipo,
  CAST(2020 + user_id % 5 AS INT) AS anio, CAST(user_id AS {string}) AS numero,
  CASE WHEN event_id % 7 = 0 THEN 'error_bd' WHEN event_id % 11 = 0 THEN 'extraccion_fallida' ELSE 'ok' END AS estado, ts AS fecha
FROM events
"""
CASES = "SELECT c_custkey AS id, c_name AS nombre, CASE WHEN c_acctbal < 0 THEN 'cerrado' ELSE 'activo' END AS estado FROM customer"
NOTES = """
SELECT o_orderkey AS id, o_custkey AS caso_id, o_orderpriority AS contenido, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderkey % 1000 END AS doc_id,
  CASE o_orderstatus WHEN 'F' THEN 'nota' WHEN 'O' THEN 'consulta_ia' ELSE 'documento' END AS tipo, o_orderdate AS fecha FROM orders
"""
SEARCHES = "SELECT conv_id, turn, substr(text, 1, 40) AS termino, CAST(length(text) % 50 AS INT) AS resultados FROM conversations WHERE role = 'user'"

VIEWS = {
    "docs": (DOCS, "documents"),
    "judicial_docs": (JUDICIAL_DOCS, "documents"),
    "judicial_relaciones": (RELATIONS, "documents"),
    "articulos_idx": (ARTICLES, "documents"),
    "scraper_log": (LOG, "events"),
    "casos": (CASES, "customer"),
    "caso_notas": (NOTES, "orders"),
    "historial": (SEARCHES, "conversations"),
}

PRELUDE = "WITH " + ",\n".join(f"{name} AS ({text.format(string='VARCHAR')})" for name, (text, _) in VIEWS.items())


def sql(body: str) -> str:
    """A statement for DuckDB over the domain's tables; body may start with further expressions (", x AS (...) SELECT ...")."""
    return PRELUDE + "\n" + body


class Tables:
    """The domain's tables for one folder of driver tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        text, source = VIEWS[name]
        text = text.format(string="STRING").replace("(doc_id // 4)", "(doc_id div 4)")
        frame = self.spark.sql(text.replace(f"FROM {source}", "FROM {source}"), source=self.raw(source))
        setattr(self, name, frame)
        return frame
