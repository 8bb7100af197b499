"""Audits of stored files against documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafquarry.functions import refs

# The states of a document's file.
OK, HTML, IMAGE, OCR, DOC = "OK_PDF", "FALTA_PDF_PERO_HAY_HTML", "FALTA_PDF_PERO_HAY_IMAGEN", "FALTA_PDF_PERO_HAY_OCR", "FALTA_PDF_PERO_HAY_DOC"
NONE, REPEATED, BAD, ORPHAN = "FALTA_PDF_TOTAL", "DUPLICADO_PDF", "INCONSISTENCIA_IDENTIFICADOR", "PDF_HUERFANO"


def file_keys(name: Column) -> Column:
    """The key of a file's name, by one of three patterns; null for others."""

    def part(pattern: str, n: int) -> Column:
        return F.regexp_extract(name, pattern, n)

    # fixed values: how stored files are named
    modern, old, court = r"(?i)^(circular|oficio|resolucion)_(\d{4})_(.+)\.pdf$", r"(?i)^circular_historica_(\d{4})_(.+?)(?:_(scan|html))?\.pdf$", r"(?i)^judicial_(\d{4})_.+_id(\d+)\.pdf$"
    stem = part(old, 2)
    number = F.coalesce(F.nullif(F.regexp_extract(stem, r"(?i)circu(.+)$", 1), F.lit("")), stem)
    return (
        F.when(name.rlike(modern), refs.file_key(F.lower(part(modern, 1)), part(modern, 2).try_cast("int"), part(modern, 3)))
        .when(name.rlike(old), refs.file_key(F.lit("circular"), part(old, 1).try_cast("int"), number))
        .when(name.rlike(court), F.concat(F.lit("judicial_sii|"), part(court, 1), F.lit("|"), part(court, 2)))
    )


def file_state(length: Column, head: Column) -> Column:
    """Why a file is no valid PDF; "ok" for good ones. Page counts need a PDF library and aren't looked at."""
    return F.when(length < 512, "demasiado_pequeno").when(F.substring(head, 1, 5).cast("string") != "%PDF-", "header_invalido").otherwise("ok")


def matched(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Documents with the number of their files, one of them, and how they were found: by a court's own path,
    by kind, year and number, or by the court's id; the first way that finds any counts.

    docs: id, tipo, anio, numero, sii_id, jd_pdf; files: path, name, state."""
    keyed = files.withColumn("key", file_keys(F.col("name")))
    by_path = keyed.groupBy(F.lower(F.replace("path", F.lit("\\"), F.lit("/"))).alias("p")).agg(F.count(F.lit(1)).alias("n1"), F.min(F.struct("path", "state")).alias("f1"))
    by_key = keyed.filter("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("path", "state")).alias("f"))
    court_path = (F.col("tipo") == "judicial") & (F.trim(F.coalesce("jd_pdf", F.lit(""))) != "")
    rows = docs.withColumns(
        {
            "own": F.when(court_path, F.lower(F.replace("jd_pdf", F.lit("\\"), F.lit("/")))),
            "k2": F.when(~court_path, refs.file_key(F.col("tipo"), F.col("anio"), F.col("numero"))),
            "k3": F.when(~court_path & (F.col("tipo") == "judicial"), F.concat_ws("|", F.lit("judicial_sii"), F.coalesce("anio", F.lit(0)).cast("string"), F.col("sii_id").cast("string"))),
        }
    )
    k2 = by_key.select(F.col("key").alias("k2"), F.col("n").alias("n2"), F.col("f").alias("f2"))
    k3 = by_key.select(F.col("key").alias("k3"), F.col("n").alias("n3"), F.col("f").alias("f3"))
    rows = rows.join(by_path, rows["own"] == by_path["p"], "left").join(k2, "k2", "left").join(k3, "k3", "left")
    kind = (
        F.when(F.col("n1").isNotNull(), "pdf_local_judicial")
        .when(court_path, "pdf_local_judicial_no_encontrado")
        .when(F.col("n2").isNotNull(), "clave_tipo_anio_numero")
        .when(F.col("n3").isNotNull(), "judicial_sii_id")
        .otherwise("sin_match_pdf")
    )
    # a court's own path is one file, even if letters of other case make it several
    count = F.when(F.col("n1").isNotNull(), 1).otherwise(F.coalesce("n2", "n3", F.lit(0)))
    return rows.withColumns({"match": kind, "files": count.cast("int"), "file": F.coalesce("f1", "f2", "f3")}).drop("own", "k2", "k3", "p", "n1", "f1", "n2", "f2", "n3", "f3")


def auxiliary(docs: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: whether an auxiliary file answers to a document's year and number or a token of its title.

    files: stem. Keys are exploded on both sides and met in one equi-join; the keys of files are made distinct first."""
    keys = files.select(F.explode(refs.stem_keys(F.col("stem"))).alias("key")).distinct()
    number = refs.file_number(F.col("numero"))
    year = F.coalesce(F.col("anio").cast("string"), F.lit("None"))
    padded = F.when(number.rlike(r"^\d$"), F.lpad(number, 2, "0")).otherwise(number)
    own = F.array_distinct(F.concat(F.when(number != "", F.array(F.concat(year, F.lit("_"), number), F.concat(year, F.lit("_"), padded))).otherwise(F.array().cast("array<string>")), refs.title_tokens(F.col("titulo"))))
    hits = docs.select("id", F.explode(own).alias("key")).join(keys, "key", "left_semi").select("id").distinct().withColumn(name, F.lit(True))
    return docs.join(hits, "id", "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def classified(rows: DataFrame) -> DataFrame:
    """The state of a document's file and a note. rows: files, file, match, html, image, ocr, doc."""
    valid = F.col("file.state") == "ok"
    state = (
        F.when(F.col("files") > 1, REPEATED)
        .when(F.col("files") == 1, F.when(valid, OK).otherwise(BAD))
        .when(F.col("html"), HTML)
        .when(F.col("image"), IMAGE)
        .when(F.col("ocr"), OCR)
        .when(F.col("doc"), DOC)
        .otherwise(NONE)
    )
    note = F.when(F.col("files") > 1, "mas_de_un_pdf_posible").when((F.col("files") == 1) & ~valid, F.concat(F.lit("pdf_invalido:"), F.col("file.state"))).otherwise("")
    return rows.withColumns({"estado": state, "nota": note})


def orphans(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Files that are no document's."""
    return files.join(rows.select(F.col("file.path").alias("path")).filter("path IS NOT NULL"), "path", "left_anti").withColumn("estado", F.lit(ORPHAN))


def histogram(rows: DataFrame) -> DataFrame:
    """Counts of states and their percent."""
    counted = rows.groupBy("estado").agg(F.count(F.lit(1)).alias("cnt"))
    return counted.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))), F.lit(True)).select("estado", "cnt", F.round(F.col("cnt") * 100 / F.col("total"), 2).alias("pct"))
