"""The loop over landed court decisions (W04, K05-K07): one stream, four sinks, each made idempotent by the batch's number.

A batch writes documents, side rows, relations and a report, each to lote=n of its folder by overwriting. A batch that failed between two
sinks is run again from the start and replaces what it had written, so nothing is doubled; readers take of each decision the
newest batch's rows (``latest``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafquarry.functions.records import court_relations
from leafquarry.functions.text import html_to_text, strip

NAMED = "struct<nombre:string>"
# The service's details; fixed names.
DETAIL = (
    f"id bigint, fecha string, codigoPronunciamiento string, tipoPronunciamiento {NAMED}, instancia {NAMED},"
    " contenido struct<sentenciaInternet:string,sentenciaRaw:string,sentenciaIntranet:string,extractoInternet:string,extractoRaw:string,extractoIntranet:string,"
    "resumenInternet:string,resumenRaw:string,resumenIntranet:string>,"
    f" articulos array<struct<nota:string,articulo:struct<nombre:string,tituloBO:struct<cuerpoNormativo:{NAMED}>>>>"
)
SINKS = ("documentos", "judicial_docs", "judicial_relaciones", "informe")


def first_text(*names: str):
    """The first of the fields that holds anything, as text."""
    return html_to_text(F.coalesce(*[F.nullif(F.col(f"contenido.{n}"), F.lit("")) for n in names], F.lit("")))


def decisions(details: DataFrame) -> DataFrame:
    """details with sii_id, what a document of each has, and estado: ok, or sin_contenido where no field has text. Of a decision that landed twice in
    a batch the one with the larger content hash counts, so that a rerun takes the same."""
    texts = {kind: first_text(*(f"{kind}{v}" for v in ("Internet", "Raw", "Intranet"))) for kind in ("sentencia", "extracto", "resumen")}
    once = details.where("id IS NOT NULL").withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("contenido", "fecha", "codigoPronunciamiento").desc()))).where("_n = 1").drop("_n")
    rows = once.withColumns(texts).withColumn("texto", F.coalesce(*[F.nullif(strip(F.col(k)), F.lit("")) for k in texts]))
    day = F.substring(F.trim(F.coalesce("fecha", F.lit(""))), 1, 10)
    dated = day.rlike(r"^\d{4}-\d{2}-\d{2}$")
    named = {c: F.coalesce(F.nullif(F.trim(F.col(f"{c}.nombre")), F.lit("")), F.lit(d)) for c, d in (("tipoPronunciamiento", "Jurisprudencia Judicial"), ("instancia", "SII Judicial"))}
    return rows.select(
        F.col("id").alias("sii_id"),
        F.md5(F.concat(F.lit("judicial:"), F.col("id").cast("string"))).alias("hash_md5"),
        F.substring(F.coalesce(F.nullif(F.trim("codigoPronunciamiento"), F.lit("")), F.col("id").cast("string")), 1, 100).alias("numero"),
        F.when(dated, F.substring(day, 1, 4).cast("int")).otherwise(1900).alias("anio"),
        F.when(day == "", "1900-01-01").otherwise(day).alias("fecha"),
        F.substring(named["tipoPronunciamiento"], 1, 200).alias("materia"),
        F.substring(named["instancia"], 1, 200).alias("subtema"),
        F.col("texto").alias("contenido"),
        F.coalesce(*[F.nullif(strip(F.col(k)), F.lit("")) for k in ("extracto", "resumen")], F.substring("texto", 1, 3000)).alias("resumen"),
        F.when(F.col("texto").isNull(), "sin_contenido").otherwise("ok").alias("estado"),
        "articulos",
    )


def latest(spark: SparkSession, root: str, sink: str) -> DataFrame:
    """A sink's rows, of each decision those of the newest batch that has it."""
    rows = spark.read.option("basePath", f"{root}/{sink}").parquet(f"{root}/{sink}/lote=*")
    newest = rows.groupBy("sii_id").agg(F.max("lote").alias("lote"))
    return rows.join(newest, ["sii_id", "lote"], "left_semi").drop("lote")


def start_judicial(spark: SparkSession, landing: str, root: str, checkpoint: str, name: str = "judicial", fail_after: str | None = None) -> StreamingQuery:
    """Takes what landed since the last run. fail_after: a sink after which the batch fails, for tests of recovery."""

    def step(batch: DataFrame, number: int) -> None:
        rows = decisions(batch).persist()
        good = rows.where("estado = 'ok'")
        made = {
            "documentos": good.select("sii_id", F.lit("judicial").alias("tipo"), *[c for c in rows.columns if c not in ("sii_id", "estado", "articulos")], F.length("contenido").cast("bigint").alias("chars_texto")),
            "judicial_docs": good.select("sii_id", F.col("subtema").alias("corte"), "hash_md5"),
            "judicial_relaciones": court_relations(good, "sii_id", "articulos"),
            "informe": rows.select("sii_id", "estado", "anio"),
        }
        for sink in SINKS:
            made[sink].write.mode("overwrite").parquet(f"{root}/{sink}/lote={number}")
            if sink == fail_after:
                raise RuntimeError(f"after {sink}")
        rows.unpersist()

    stream = spark.readStream.schema(DETAIL).json(landing).writeStream.queryName(name).foreachBatch(step)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def report(spark: SparkSession, root: str) -> DataFrame:
    """anio, leidos, guardados, sin_contenido over the newest state of each decision."""
    rows = latest(spark, root, "informe")
    return rows.groupBy("anio").agg(F.count(F.lit(1)).alias("leidos"), F.count_if(F.col("estado") == "ok").alias("guardados"), F.count_if(F.col("estado") != "ok").alias("sin_contenido"))
