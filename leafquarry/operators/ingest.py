"""Validated upserts, provenance, cases and analyses as pure steps from current tables and a batch to the next (K, R08).

Plain Parquet has no MERGE: a step returns the next state, to be written to a new folder and swapped in; one writer at a time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafquarry.functions import refs
from leafquarry.functions.text import clean_paragraphs, evidence, strip
from leafquarry.operators.catalog import latest_by
from leafquarry.operators.resolver import references
from leafquarry.sources.tables import kept

#: Kinds whose documents are only known by hash, not by kind, number and year.
BY_HASH_ONLY = ("oficio", "judicial")


def reject_reason() -> Column:
    """Why a record can't be kept; null for good ones."""
    return (
        F.when(strip(F.coalesce("contenido", F.lit(""))) == "", "sin_contenido")
        .when(F.coalesce("hash_md5", F.lit("")) == "", "sin_hash")
        .when(strip(F.coalesce("pdf_local", F.lit(""))) == "", "sin_pdf")
        .when(F.coalesce("paginas", F.lit(0)) <= 0, "sin_paginas")
    )


def with_defaults(batch: DataFrame) -> DataFrame:
    """K01."""
    defaults = {"paginas": F.lit(0), "chars_texto": F.length(F.coalesce("contenido", F.lit(""))).cast("bigint"), "fuente": F.lit("scraper")}
    return reduce(lambda d, x: d.withColumn(x[0], F.coalesce(F.col(x[0]), x[1]) if x[0] in d.columns else x[1]), defaults.items(), batch)


def upsert_plan(current: DataFrame, good: DataFrame) -> DataFrame:
    """seq, hash_md5, tipo, numero, anio, what: the records that count, as changed or new ones. Ranked and met as thin rows, without texts."""
    identity = ["tipo", "numero", "anio"]
    named = ~F.col("tipo").isin(*BY_HASH_ONLY) & F.col("numero").isNotNull() & F.col("anio").isNotNull()
    ids = good.select("seq", "hash_md5", *identity)
    last = latest_by(ids.filter(named), identity, [F.col("seq").desc()])
    last = last.join(current.filter(named).select(*identity, F.lit(True).alias("known")).distinct(), identity, "left")
    changed = last.filter("known").drop("known").withColumn("what", F.lit("changed"))
    fresh = last.filter("known IS NULL").drop("known").unionByName(ids.filter(F.coalesce(~named, F.lit(True))))
    fresh = latest_by(fresh.join(current.select("hash_md5"), "hash_md5", "left_anti"), ["hash_md5"], [F.col("seq")])
    return changed.unionByName(fresh.withColumn("what", F.lit("new")))


def upserted(current: DataFrame, batch: DataFrame) -> DataFrame:
    """The next documents. A record replaces the one with its kind, number and year where the hash differs (but for
    kinds known by hash only); others are added unless their hash is known. Of several in a batch the last (seq, which numbers
    the batch's rows) counts. Which records count is found on thin rows and kept; whole rows are then met with it once.

    Columns of both: hash_md5, tipo, numero, anio, contenido, paginas, pdf_local, ...; batch has seq too."""
    good = with_defaults(batch).filter(reject_reason().isNull())
    plan = kept(upsert_plan(current, good), "upsert-plan")
    columns = [c for c in current.columns if c != "id"]
    stay = current.join(plan.filter("what = 'changed'").select("tipo", "numero", "anio"), ["tipo", "numero", "anio"], "left_anti")
    return stay.select(*columns).unionByName(good.join(plan.select("seq"), "seq", "left_semi").select(*columns))


def upsert_into(spark: SparkSession, path: str, batch: DataFrame) -> dict[str, int]:
    """K01, K05, K18 on a stored table that is partitioned by tipo and anio: ``upserted``, but only partitions in which
    something changes are rewritten, by dynamic overwrite; the files of all others keep their names.

    Of the whole table the batch is met with keys and hashes alone; whole rows are read of the touched partitions only. Returns
    the numbers of changed and new rows and of touched partitions. A batch without good rows touches nothing; repeating a batch
    changes nothing but file names of its partitions. One writer at a time."""
    identity = ["tipo", "numero", "anio"]
    good = with_defaults(batch).filter(reject_reason().isNull())
    current = spark.read.parquet(path)
    plan = kept(upsert_plan(current, good), "upsert-plan")
    counts = {r.what: r.n for r in plan.groupBy("what").agg(F.count(F.lit(1)).alias("n")).collect()}
    touched = plan.select("tipo", "anio").distinct()
    there = touched.collect()  # no more than the table has partitions
    if there:
        columns = [c for c in current.columns if c != "id"]
        known = [r for r in there if r.anio is not None]
        here = F.struct("tipo", "anio").isin(*[F.struct(F.lit(r.tipo), F.lit(r.anio)) for r in known]) if known else F.lit(False)
        old = current.filter(F.coalesce(here, F.lit(False)))  # the filter prunes partitions
        if loose := [r.tipo for r in there if r.anio is None]:
            old = old.unionByName(current.filter(F.col("anio").isNull() & F.col("tipo").isin(*loose)))
        old = old.select(*columns).join(plan.filter("what = 'changed'").select(*identity), identity, "left_anti")
        new = good.join(plan.select("seq"), "seq", "left_semi").select(*columns)
        rows = kept(old.unionByName(new), "upsert-rows")  # what is overwritten can't be read meanwhile
        rows.repartition("tipo", "anio").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tipo", "anio").parquet(path)
    return {"changed": counts.get("changed", 0), "new": counts.get("new", 0), "partitions": len(there)}


def last_write(current: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the batch's last row (by seq), else the current one."""
    new = latest_by(batch, keys, [F.col("seq").desc()]).select(*current.columns)
    return current.join(new.select(*keys), keys, "left_anti").unionByName(new)


def court_targets(batch: DataFrame, courts: DataFrame, docs: DataFrame) -> DataFrame:
    """The document each record belongs to: by the court's id, else by hash; null for new ones."""
    by_id = courts.select("sii_id", F.col("doc_id").alias("id1"))
    by_hash = docs.groupBy("hash_md5").agg(F.min("id").alias("id2"))
    found = batch.join(by_id, "sii_id", "left").join(by_hash, "hash_md5", "left")
    return found.withColumn("target", F.coalesce("id1", "id2")).withColumn("existed", F.col("target").isNotNull()).drop("id1", "id2")


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """K16."""
    return docs.join(ids.select("id"), "id", "left_anti")


def kept_outside(docs: DataFrame, first: int, last: int, kinds: list[str]) -> DataFrame:
    """Rows outside the target; as in SQL a row without a year stays only where its kind rules it out."""
    return docs.filter(~(F.col("anio").between(first, last) & F.col("tipo").isin(*kinds)))


def children(side: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """A side table's rows whose document is there."""
    return side.join(docs.select(F.col("id").alias(key)), key, "left_semi")


def paths_filled(docs: DataFrame, judicial: DataFrame) -> DataFrame:
    """Missing paths from the side table."""
    side = judicial.groupBy(F.col("doc_id").alias("id")).agg(F.max("pdf_local").alias("jd_pdf"))
    return docs.join(side, "id", "left").withColumn("pdf_local", F.coalesce(F.nullif(F.col("pdf_local"), F.lit("")), "jd_pdf")).drop("jd_pdf")


def reindexed(docs: DataFrame) -> DataFrame:
    """Laws and references of every document with text, in one pass without a shuffle."""
    return docs.filter(strip(F.coalesce("contenido", F.lit(""))) != "").withColumns({"leyes": refs.law_codes(F.col("contenido")), "refs": references(F.col("contenido"))})


def touched(cases: DataFrame, notes: DataFrame) -> DataFrame:
    """Cases with the time of their last note."""
    last = notes.groupBy(F.col("caso_id").alias("c")).agg(F.max("fecha").alias("fecha_modificacion"))
    return cases.join(last, cases["id"] == last["c"], "left").drop("c")


def question_notes(turns: DataFrame) -> DataFrame:
    """One note a conversation: its turns in order, under headings, with a default line for an empty one."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    lines = F.transform(ordered, lambda r: F.concat(F.lit("- "), r["role"], F.lit(": "), F.coalesce(F.nullif(F.substring(r["text"], 1, 80), F.lit("")), F.lit("Sin texto"))))
    return turns.groupBy("conv_id").agg(F.concat(F.lit("FUENTES\n"), F.array_join(lines, "\n")).alias("contenido"))


def search_record(question: Column, filters: dict[str, Column], results: Column) -> Column:
    """K10."""
    return F.struct(question.alias("termino"), F.to_json(F.struct(*[v.alias(k) for k, v in filters.items()])).alias("filtros"), results.alias("resultados"))


def dates_repaired(docs: DataFrame, found: Column, last_year: int) -> DataFrame:
    """Offices whose date lies beyond their year or the last one, with the date found in their text."""
    year = F.substring("fecha", 1, 4)
    wrong = (F.col("tipo") == "oficio") & ((year > F.lpad(F.col("anio").cast("string"), 4, "0")) | (year > str(last_year)))
    return docs.filter(wrong).withColumn("nueva", found).filter(F.col("nueva").isNotNull() & (F.col("nueva") != F.col("fecha")))


def analysed(docs: DataFrame, known: DataFrame, least: int = 400) -> DataFrame:
    """Each document's analysis: the known one while the text is the same, else a local one, or "insufficient"."""
    same = known.filter(F.col("status").isin("ready", "fallback")).select(F.col("doc_id").alias("k"), F.col("source_hash").alias("k_hash"), F.col("summary_short").alias("k_short"), F.col("status").alias("k_status"))
    text = clean_paragraphs(F.col("contenido"))
    summary = clean_paragraphs(F.col("resumen"))
    source = F.md5(F.coalesce("contenido", F.lit("")))
    reused = F.col("k_hash") == F.col("source_hash")
    rows = docs.withColumn("source_hash", source).join(same, F.col("id") == F.col("k"), "left")
    short = F.coalesce(F.nullif(summary, F.lit("")), F.substring(text, 1, 700))
    return rows.select(
        F.col("id").alias("doc_id"),
        "source_hash",
        F.when(reused, F.col("k_status")).when(F.length(text) < least, "insufficient").otherwise("fallback").alias("status"),
        F.when(reused, F.col("k_short")).when(F.length(text) >= least, strip(short)).alias("summary_short"),
        F.when(~F.coalesce(reused, F.lit(False)) & (F.length(text) >= least), evidence(F.col("contenido"))).alias("evidence"),
    )


def merged_index(rows: DataFrame) -> DataFrame:
    """Index rows by number: the first title, date and address that aren't empty, the longest description."""
    first = {c: F.min_by(c, F.when(F.coalesce(c, F.lit("")) != "", F.col("seq"))).alias(c) for c in ("titulo", "fecha", "url_pdf", "url_detalle") if c in rows.columns}
    longest = F.max_by("descripcion", F.struct(F.length(F.coalesce("descripcion", F.lit(""))), -F.col("seq"))).alias("descripcion")
    return rows.filter(F.coalesce("numero", F.lit("")) != "").groupBy("numero").agg(*first.values(), longest)


