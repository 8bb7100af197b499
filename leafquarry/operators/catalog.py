"""Faceted search conditions, joins, counts and pages over documents and their side tables (P, J, A, O, U).

Every function takes and returns DataFrames and stays declarative, so filters and columns reach the scans and joins are
Spark's to choose. Nothing is collected."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafquarry.functions import refs
from leafquarry.functions.text import display_subject, display_summary, highlighted, truncated

PAGE = 15


def any_contains(needle: str, *columns: str) -> Column:
    """The text somewhere in one of the columns, regardless of case."""
    escaped = needle.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
    out = F.lit(False)
    for name in columns:
        out = out | F.coalesce(F.col(name).ilike(f"%{escaped}%"), F.lit(False))
    return out


def blank(c: Column) -> Column:
    """P09."""
    return F.trim(F.coalesce(c, F.lit(""))) == ""


@dataclass(frozen=True)
class Search:
    """What a search asks for; empty fields ask nothing."""

    text: str = ""
    tipo: str = ""
    anio: int | None = None
    ley: str = ""
    materia: str = ""
    articulo: str = ""
    corte: str = ""
    cuerpo: str = ""
    fuente: str = ""
    vigente: str = ""

    def recorded(self) -> bool:
        """Whether the history keeps it; the source alone doesn't count."""
        return any((self.text, self.tipo, self.anio, self.ley, self.materia, self.articulo, self.corte, self.cuerpo, self.vigente))


def filtered(docs: DataFrame, index: DataFrame, judicial: DataFrame, relations: DataFrame, s: Search) -> DataFrame:
    """The documents that meet all the conditions; side tables by semi joins, so no fan-out."""
    for name in ("tipo", "anio", "fuente"):
        if getattr(s, name):
            docs = docs.filter(F.col(name) == getattr(s, name))
    if s.vigente in ("0", "1"):
        docs = docs.filter(F.col("vigente") == int(s.vigente))
    if s.materia:
        docs = docs.filter(any_contains(s.materia, "materia"))
    law = s.ley
    if law:
        law = next((x for x in refs.CODES if x == refs.ALIASES.get(law.strip().upper(), law.strip().upper())), law)
        docs = docs.join(index.filter(F.col("ley") == law), F.col("id") == F.col("doc_id"), "left_semi")
    if s.articulo:
        number = refs.article(F.lit(s.articulo))
        if law:
            docs = docs.join(index.filter((F.col("ley") == law) & (F.col("articulo") == number)), F.col("id") == F.col("doc_id"), "left_semi")
        else:
            docs = docs.filter(F.contains(F.lower("contenido"), F.lower(number)))
    if s.corte:
        docs = docs.join(judicial.filter(F.col("corte") == s.corte), F.col("id") == F.col("doc_id"), "left_semi")
    if s.cuerpo:
        docs = docs.join(relations.filter(F.col("cuerpo_normativo") == s.cuerpo), F.col("id") == F.col("doc_id"), "left_semi")
    return docs


def with_side_tables(docs: DataFrame, judicial: DataFrame, relations: DataFrame) -> DataFrame:
    """Each document once, with its court, file and the laws of its relations (summed up before the join)."""
    side = judicial.select(F.col("doc_id").alias("jd"), "corte", "tribunal", "tipo_codigo", F.col("pdf_local").alias("jd_pdf"))
    bodies = relations.groupBy(F.col("doc_id").alias("jr")).agg(F.array_join(F.array_sort(F.collect_set("cuerpo_normativo")), ",").alias("cuerpos"))
    joined = docs.join(side, docs["id"] == side["jd"], "left").join(bodies, docs["id"] == bodies["jr"], "left")
    return joined.withColumn("pdf", F.coalesce("pdf_local", "jd_pdf")).drop("jd", "jr", "jd_pdf")


def page(docs: DataFrame, number: int = 1, size: int = PAGE) -> DataFrame:
    """Newest first; a bounded sort, not a full one."""
    return docs.orderBy(F.coalesce("fecha", F.lit("")).desc(), F.col("id").desc()).offset((number - 1) * size).limit(size)


def decorated(rows: DataFrame, question: str = "") -> DataFrame:
    """The shown subject and extract of a page's rows."""
    extract = display_summary(F.col("resumen"), F.substring("contenido", 1, 2500), F.col("titulo"), F.col("referencia"))
    return rows.withColumns({"tema": display_subject(F.col("titulo"), F.col("referencia")), "extracto": truncated(highlighted(extract, question))})


def related(docs: DataFrame, index: DataFrame, most: int = 8, pairs: int = 4) -> DataFrame:
    """J07 for all documents: others that cite one of a document's first four articles, newest first, eight each.

    A pair that many documents cite would join each to each; only its newest ``most`` + 1 documents can be among anyone's
    newest, so the other side is cut to those first and the join grows with the documents alone."""
    cited = index.filter(F.col("ley").isNotNull() & F.col("articulo").isNotNull()).select("doc_id", "ley", "articulo").distinct()
    mine = Window.partitionBy("doc_id").orderBy("ley", "articulo")
    own = cited.withColumn("n", F.row_number().over(mine)).filter(F.col("n") <= pairs).drop("n")
    years = docs.select(F.col("id").alias("other_id"), "anio")
    newest = Window.partitionBy("ley", "articulo").orderBy(F.col("anio").desc_nulls_last(), F.col("other_id").desc())
    others = cited.withColumnRenamed("doc_id", "other_id").join(years, "other_id").withColumn("k", F.row_number().over(newest)).filter(F.col("k") <= most + 1).drop("k")
    found = own.join(others, ["ley", "articulo"]).filter(F.col("doc_id") != F.col("other_id")).select("doc_id", "other_id", "anio").distinct()
    place = Window.partitionBy("doc_id").orderBy(F.col("anio").desc_nulls_last(), F.col("other_id").desc())
    return found.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= most)


def versions(docs: DataFrame, doc_id: int) -> DataFrame:
    """Other documents of a document's kind and number."""
    one = docs.filter(F.col("id") == doc_id).select("tipo", "numero")
    return docs.join(one, ["tipo", "numero"], "left_semi").filter(F.col("id") != doc_id)


def case_totals(cases: DataFrame, notes: DataFrame) -> DataFrame:
    """Cases with their numbers of notes and of notes with a document; 0 without notes."""
    counted = notes.groupBy(F.col("caso_id").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("d"))
    return cases.join(counted, cases["id"] == counted["c"], "left").select(
        "id", "nombre", "estado", F.coalesce("n", F.lit(0)).alias("notas"), F.coalesce("d", F.lit(0)).alias("documentos")
    )


def top(df: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """Counts by keys, the largest first, then by key."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.col("cnt").desc(), *keys)
    return counted if most is None else counted.limit(most)


def facet(df: DataFrame, column: str) -> DataFrame:
    """A10: the distinct values that aren't blank."""
    return df.filter(~blank(F.col(column))).select(column).distinct().orderBy(column)


def sample(df: DataFrame, most: int, seed: int = 0, key: str = "id") -> DataFrame:
    """A random choice of rows that a seed repeats on any partitioning: the first by hash of key and seed."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(most)


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of each key the last row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def compared(left: DataFrame, right: DataFrame, keys: list[str], names: tuple[str, str] = ("api", "db")) -> DataFrame:
    """Two counts by keys side by side, with their difference's state and percent."""
    a, b = (d.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for d, n in zip((left, right), names, strict=True))
    n, m = (F.coalesce(F.col(x), F.lit(0)) for x in names)
    return a.join(b, keys, "full_outer").select(*keys, n.alias(names[0]), m.alias(names[1])).withColumns(
        {
            "estado": F.when(F.col(names[0]) == F.col(names[1]), "OK").otherwise("DIF"),
            "pct": F.when(F.col(names[0]) == 0, 100.0).otherwise(F.round(F.col(names[1]) * 100 / F.col(names[0]), 2)),
        }
    )


def repeated_values(df: DataFrame, keys: list[str]) -> DataFrame:
    """A20."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt")).filter("cnt > 1")


OFFICE_BRANCHES = ("oficio / LIR", "oficio / IVA", "oficio / OTRAS NORMAS", "oficio / SIN SUBCLASIFICAR")


def office_branch(tipo: Column, subject: Column) -> Column:
    """A14."""
    s = F.upper(F.coalesce(subject, F.lit("")))
    return F.when(
        tipo == "oficio",
        F.when(s.startswith("RENTA"), OFFICE_BRANCHES[0])
        .when(s.startswith("IVA"), OFFICE_BRANCHES[1])
        .when(s.startswith("OTRAS") | s.startswith("OTROS"), OFFICE_BRANCHES[2])
        .otherwise(OFFICE_BRANCHES[3]),
    ).otherwise(tipo)


def profile(docs: DataFrame, first: int, last: int) -> DataFrame:
    """By kind and year: counts, suspicious ones, lengths."""
    n = F.length(F.coalesce("contenido", F.lit("")))
    return (
        docs.filter(F.col("anio").between(first, last))
        .groupBy("tipo", "anio")
        .agg(
            F.count(F.lit(1)).alias("docs"),
            F.count_if(n.between(49950, 50000)).alias("sospechosos_truncados"),
            F.count_if(F.coalesce("chars_texto", F.lit(0)) == 0).alias("sin_chars"),
            F.count_if(F.coalesce("paginas", F.lit(0)) == 0).alias("sin_paginas"),
            F.min(n).alias("min_len"),
            F.round(F.avg(n), 1).alias("avg_len"),
            F.max(n).alias("max_len"),
        )
    )


def integrity(docs: DataFrame, first: int, last: int) -> DataFrame:
    """All counters of a range in one pass."""
    n = F.length(F.trim(F.coalesce("contenido", F.lit(""))))
    return docs.filter(F.col("anio").between(first, last)).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(blank(F.col("contenido"))).alias("sin_contenido"),
        F.count_if(F.coalesce("chars_texto", F.lit(0)) == 0).alias("sin_chars"),
        F.count_if(F.coalesce("paginas", F.lit(0)) == 0).alias("sin_paginas"),
        F.count_if(blank(F.col("pdf_local"))).alias("sin_pdf"),
        F.count_if(n < 1500).alias("cortos"),
    )


def gaps(existing: DataFrame, column: str, last: int, streak: int = 30) -> DataFrame:
    """The numbers from 1 on that are missing, up to where ``streak`` in a row are. A window over the numbers of one
    year, which are few."""
    numbers = existing.sparkSession.range(1, last + 1).select(F.col("id").alias("n"))
    have = existing.select(F.col(column).cast("bigint").alias("n")).distinct().withColumn("hit", F.lit(True))
    marked = numbers.join(have, "n", "left").withColumn("island", F.count("hit").over(Window.orderBy("n")))
    run = F.row_number().over(Window.partitionBy("island").orderBy("n")) - F.when(F.col("island") > 0, 1).otherwise(0)
    stop = F.min(F.when(F.col("misses") >= streak, F.col("n"))).over(Window.partitionBy())
    return marked.withColumn("misses", run).withColumn("stop", stop).filter("hit IS NULL AND (stop IS NULL OR n <= stop)").select("n", "misses")
