"""The engine's surface (R06, R09-R13, J04, T21, K10): what pages and services ask, as DataFrames over a corpus's tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafquarry.functions import refs, text
from leafquarry.operators import catalog, ingest, retrieval
from leafquarry.operators.catalog import Search
from leafquarry.operators.segments import SegmentedIndex

FIELDS = ("titulo", "materia", "subtema", "contenido", "resumen", "palabras_clave", "leyes_citadas", "articulos_clave")


class Engine:
    """docs, index (doc_id, ley, articulo), judicial, relations, and where they exist log, cases, notes, history."""

    def __init__(self, spark: SparkSession, docs: DataFrame, index: DataFrame, judicial: DataFrame, relations: DataFrame, **others: DataFrame):
        self.spark, self.docs, self.index, self.judicial, self.relations = spark, docs, index, judicial, relations
        self.log, self.cases, self.notes, self.history = (others.get(k) for k in ("log", "cases", "notes", "history"))
        self.fields = [f for f in FIELDS if f in docs.columns]

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str) -> Engine:
        """Over the Parquet tables that ``save`` or an ingest wrote."""
        return cls(spark, *[spark.read.parquet(f"{folder}/{n}") for n in ("docs", "articulos_idx", "judicial_docs", "judicial_relaciones")])

    @cached_property
    def scorer(self) -> retrieval.Scan | SegmentedIndex:
        """One pass over the texts for each question, until there is an index (``use_postings``)."""
        return retrieval.Scan(self.docs, tuple(self.fields))

    def use_postings(self, path: str, rebuild: bool = False) -> Engine:
        """Ranks by the index in segments at path (``segments.SegmentedIndex``), whose ``commit`` and ``merge`` keep it up."""
        self.scorer = SegmentedIndex(self.spark, path, self.fields)
        if rebuild:
            self.scorer.cleared().commit(self.docs)
        return self

    def matches(self, s: Search) -> DataFrame:
        """All documents of a search, in no order."""
        docs = retrieval.candidates(self.docs, self.scorer, s.text) if s.text else self.docs.withColumn("rank", F.lit(None).cast("double"))
        return catalog.filtered(docs, self.index, self.judicial, self.relations, s)

    def search(self, s: Search, page: int = 1) -> DataFrame:
        """A page of decorated rows."""
        rows = catalog.page(self.matches(s), page)
        return catalog.decorated(catalog.with_side_tables(rows, self.judicial, self.relations), s.text)

    def total(self, s: Search) -> DataFrame:
        """One row: hits and pages."""
        n = self.matches(s).agg(F.count(F.lit(1)).alias("total"))
        return n.withColumn("paginas", F.greatest(F.lit(1), F.ceil(F.col("total") / catalog.PAGE)))

    def record(self, s: Search) -> DataFrame | None:
        """The history's row of a search; none for those that aren't kept."""
        if not s.recorded():
            return None
        asked = {k: F.lit("" if v is None else str(v)) for k, v in asdict(s).items() if k != "text"}
        return self.total(s).select(ingest.search_record(F.lit(s.text), asked, F.col("total")).alias("r")).select("r.*")

    def document(self, doc_id: int) -> dict[str, DataFrame]:
        """A document with what its page shows."""
        one = self.docs.filter(F.col("id") == doc_id)
        own = self.index.filter((F.col("doc_id") == doc_id) & F.col("articulo").isNotNull()).select("ley", "articulo").distinct().orderBy("ley", "articulo").limit(4)
        others = self.index.join(own, ["ley", "articulo"], "left_semi").filter(F.col("doc_id") != doc_id)
        related = self.docs.join(others, F.col("id") == F.col("doc_id"), "left_semi").orderBy(F.col("anio").desc_nulls_last(), F.col("id").desc()).limit(8)
        shown = catalog.decorated(catalog.with_side_tables(one, self.judicial, self.relations))
        preview = text.preview(F.col("contenido"), F.col("titulo"), F.col("referencia"))
        return {
            "doc": shown.withColumn("preview", preview),
            "related": related,
            "history": catalog.versions(self.docs, doc_id),
            "relations": self.relations.filter(F.col("doc_id") == doc_id),
        }

    def by_article(self, law: str, article: str, most: int = 100) -> DataFrame:
        """J04."""
        wanted = self.index.filter((F.col("ley") == refs.law_code(F.lit(law))) & (F.col("articulo") == refs.article(F.lit(article))))
        return self.docs.join(wanted, F.col("id") == F.col("doc_id"), "left_semi").orderBy(F.col("anio").desc_nulls_last(), F.col("id").desc()).limit(most)

    def cite(self, doc_id: int) -> DataFrame:
        """T21."""
        names = {n: F.col(n) for n in ("tipo", "numero", "anio", "fecha", "materia", "referencia", "resumen", "contenido")} | {"url": F.col("url_sii")}
        return self.docs.filter(F.col("id") == doc_id).select("id", *[v.alias(k) for k, v in text.citations(names).items()])

    def context(self, question: str, s: Search | None = None) -> DataFrame:
        """Ranked sources within the budget, filtered before the ranking."""
        docs = catalog.filtered(self.docs, self.index, self.judicial, self.relations, s) if s else self.docs
        for name in ("leyes_citadas", "articulos_clave"):
            if name not in docs.columns:
                docs = docs.withColumn(name, F.lit("[]"))
        return retrieval.context(docs, self.scorer, question)

    def ask(self, question: str, s: Search | None = None, model: Callable[[str, str], str] | None = None) -> DataFrame:
        """R06; the caller's model, if any, gets the question and the packed context."""
        return retrieval.answer(self.context(question, s), question, model)

    def analyse(self, known: DataFrame, ids: DataFrame | None = None) -> DataFrame:
        """R08."""
        return ingest.analysed(self.docs.join(ids, "id", "left_semi") if ids is not None else self.docs, known)

    def dashboard(self, today: str) -> dict[str, DataFrame]:
        """Counts in one pass over the documents, and the lists beside them."""
        out = {
            "totals": self.docs.agg(F.count(F.lit(1)).alias("total"), F.max("fecha_carga").alias("ultima")),
            "by_type": catalog.top(self.docs, ["tipo"]),
            "by_year": self.docs.filter("anio IS NOT NULL").groupBy("anio").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.col("anio").desc()).limit(15),
            "recent": self.docs.orderBy(F.coalesce("fecha_carga", "fecha").desc(), F.col("id").desc()).limit(6),
            "articles": catalog.top(self.index.filter("ley IS NOT NULL AND articulo IS NOT NULL"), ["ley", "articulo"], 15),
            "subjects": catalog.facet(self.docs, "materia"),
            "courts": catalog.facet(self.judicial, "corte"),
            "bodies": catalog.facet(self.relations, "cuerpo_normativo"),
            "sources": catalog.facet(self.docs, "fuente"),
        }
        if self.log is not None:
            out["log"] = self.log.groupBy("tipo", "anio").agg(F.count(F.lit(1)).alias("cnt"), F.count_if(F.col("estado") == "ok").alias("ok"))
            out["new_today"] = self.log.filter((F.col("estado") == "ok") & (F.col("fecha").cast("date") == F.lit(today).cast("date"))).agg(F.count(F.lit(1)).alias("n"))
        if self.cases is not None and self.notes is not None:
            out["cases"] = catalog.case_totals(self.cases, self.notes)
        return out
