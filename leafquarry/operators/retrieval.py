"""Full-text retrieval (R01-R08): BM25 over stored postings or in one pass over the texts, filters, fragments, packed contexts.

Postings are (doc_id, field, pos, term) rows; a ranking reads only the question's few terms from them, which reach the scan as
a filter, so store them partitioned or sorted by term. Document statistics are one row a document. ``Stored`` ranks by
these; ``Scan`` counts a question's phrases in the texts themselves, which shuffles nothing. A ranking is computed once and
kept; whole texts are fetched for the few documents that it chose."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafquarry.functions.text import relevance, strip, unmarked
from leafquarry.operators.catalog import any_contains
from leafquarry.sources.tables import kept

K1, B = 1.2, 0.75
#: Hits that a search looks at, documents and characters of a context, characters of a fragment.
CANDIDATES, MOST_DOCS, MOST_CHARS, FRAGMENT = 500, 8, 9000, 900
OPERATORS = ("AND", "OR", "NOT", "NEAR")


def plain(c: Column) -> Column:
    """Lower case without marks; null as empty."""
    return unmarked(F.lower(F.coalesce(c, F.lit(""))))


def terms_of(c: Column) -> Column:
    """Letters and digits in runs, lower case without marks."""
    return F.regexp_extract_all(plain(c), F.lit(r"[\p{L}\p{N}]+"), 0)


def listed(fields: list[str]) -> Column:
    """The fields' terms in order as one text, a blank before each and a line a field: terms hold no such signs."""
    return F.concat_ws("\n", *[F.rtrim(F.regexp_replace(F.concat(F.lit(" "), plain(F.col(f))), r"[^\p{L}\p{N}]+", " ")) for f in fields])


def blanks(column: str) -> Column:
    """Blanks in a text: the number of terms that are ``listed``."""
    return F.octet_length(column) - F.octet_length(F.replace(column, F.lit(" "), F.lit("")))


def postings(docs: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """doc_id, field, pos, term of every token of the fields."""
    parts = [docs.select(F.col(key).alias("doc_id"), F.lit(f).alias("field"), F.posexplode(terms_of(F.col(f))).alias("pos", "term")) for f in fields]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def refreshed(index: DataFrame, changed: DataFrame, fields: list[str], removed: DataFrame | None = None) -> DataFrame:
    """The postings after some documents changed or went."""
    gone = changed.select(F.col("id").alias("doc_id"))
    if removed is not None:
        gone = gone.unionByName(removed.select(F.col("id").alias("doc_id")))
    return index.join(gone, "doc_id", "left_anti").unionByName(postings(changed, fields))


def lengths(docs: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """doc_id, dl: tokens over all fields, without exploding them."""
    return docs.select(F.col(key).alias("doc_id"), listed(fields).alias("tokens")).select("doc_id", blanks("tokens").alias("dl"))


def match_query(question: str) -> str:
    """Words of over three letters quoted, joined by OR."""
    return " OR ".join(f'"{w}"' if len(w) > 3 else w for w in question.split()) or question


@dataclass(frozen=True)
class Parsed:
    """Phrases (tuples of terms) any of which may match; not valid where the text breaks the syntax of a match."""

    phrases: tuple[tuple[str, ...], ...]
    valid: bool


def parse(question: str) -> Parsed:
    """Short words stand bare, so operators and punctuation among them are syntax errors; longer ones are phrases."""
    phrases, valid = [], bool(question.split())
    marks = str.maketrans("ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy")
    for word in question.split():
        if len(word) <= 3:
            valid &= word not in OPERATORS and not re.search(r"[^\w°º]", word)
        else:
            valid &= word.count('"') == 0
        terms = tuple(re.findall(r"[^\W_]+", word.lower().translate(marks)))
        if terms:
            phrases.append(terms)
    return Parsed(tuple(dict.fromkeys(phrases)), valid)


def phrase_hits(index: DataFrame, phrases: tuple[tuple[str, ...], ...]) -> DataFrame:
    """doc_id, phrase, tf. Terms of a phrase stand at following places of one field; one-term phrases need no join."""
    wanted = sorted({t for p in phrases for t in p})
    rows = index.filter(F.col("term").isin(*wanted))
    out = None
    for n, phrase in enumerate(phrases):
        hits = rows.filter(F.col("term") == phrase[0]).select("doc_id", "field", "pos")
        for k, term in enumerate(phrase[1:], 1):
            after = rows.filter(F.col("term") == term).select("doc_id", "field", (F.col("pos") - k).alias("pos"))
            hits = hits.join(after, ["doc_id", "field", "pos"], "left_semi")
        one = hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tf")).withColumn("phrase", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


def bm25(index: DataFrame, stats: DataFrame, phrases: tuple[tuple[str, ...], ...]) -> DataFrame:
    """doc_id, rank (negative: the lower, the better). Postings and lengths are read once: the question's own rows are kept."""
    index = kept(index.filter(F.col("term").isin(*sorted({t for p in phrases for t in p}))).select("doc_id", "field", "pos", "term"), "asked")
    hits, stats = kept(phrase_hits(index, phrases), "hits"), kept(stats.select("doc_id", "dl"), "stats")
    found = hits.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))  # one row a phrase
    whole = stats.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))  # one row
    idf = F.greatest(F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weights = found.join(F.broadcast(whole), F.lit(True)).select("phrase", idf.alias("idf"), "avgdl")
    scored = hits.join(F.broadcast(weights), "phrase").join(stats, "doc_id")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return scored.groupBy("doc_id").agg((-F.sum(part)).alias("rank"))


@dataclass(frozen=True)
class Stored:
    """Ranks by postings and lengths that exist as tables."""

    index: DataFrame
    stats: DataFrame

    def scores(self, phrases: tuple[tuple[str, ...], ...]) -> DataFrame:
        return bm25(self.index, self.stats, phrases)


def occurrences(spaced: str, phrase: tuple[str, ...]) -> Column:
    """How often a phrase stands in a text in which each term has a blank of its own on both sides. The terms after its first are
    looked at only, so matches may overlap."""
    first, *others = phrase
    if others:
        return F.regexp_count(spaced, F.lit(f" {first} (?= {'  '.join(others)} )"))
    word = f" {first} "
    return ((F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(word), F.lit("")))) / len(word.encode())).cast("int")


@dataclass(frozen=True)
class Scan:
    """Ranks in one pass over the fields of docs: counts of the phrases and of all terms, as thin rows that are kept."""

    docs: DataFrame
    fields: tuple[str, ...]

    def scores(self, phrases: tuple[tuple[str, ...], ...]) -> DataFrame:
        text = self.docs.select(F.col("id").alias("doc_id"), listed(list(self.fields)).alias("tokens"))
        spaced = F.concat(F.replace(F.replace("tokens", F.lit(" "), F.lit("  ")), F.lit("\n"), F.lit(" \n")), F.lit(" "))
        text = text.select("doc_id", blanks("tokens").alias("dl"), spaced.alias("spaced"))
        thin = text.select("doc_id", "dl", *[occurrences("spaced", p).alias(f"tf{k}") for k, p in enumerate(phrases)])
        thin = kept(thin, "hits")
        n, mean, *df = thin.agg(F.count(F.lit(1)), F.avg("dl"), *[F.count_if(F.col(f"tf{k}") > 0) for k in range(len(phrases))]).first()
        part = F.lit(0.0)
        for k, found in enumerate(df):
            tf = F.col(f"tf{k}")
            idf = max(math.log((n - found + 0.5) / (found + 0.5)), 1e-6)
            part = part + F.when(tf > 0, F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(mean or 1.0)))).otherwise(0.0)
        any_hit = reduce(lambda x, y: x | y, [F.col(f"tf{k}") > 0 for k in range(len(df))])
        return thin.where(any_hit).select("doc_id", (-part).alias("rank"))


def ranked(scorer: Stored | Scan, question: str, most: int = CANDIDATES) -> DataFrame:
    """The best documents of a question, kept. An index in segments skips what can't be among them."""
    if hasattr(scorer, "best"):
        return scorer.best(parse(question).phrases, most)
    return kept(scorer.scores(parse(question).phrases).orderBy(F.round("rank", 9), "doc_id").limit(most), "ranking")


def candidates(docs: DataFrame, scorer: Stored | Scan, question: str, most: int = CANDIDATES) -> DataFrame:
    """The documents of the best hits (at most ``most``, so they are broadcast); of a text that is no valid match or
    has no hits, those that contain it."""
    parsed = parse(question)
    if parsed.valid and parsed.phrases:
        best = ranked(scorer, question, most)
        ids = [r["doc_id"] for r in best.select("doc_id").collect()]
        if ids:  # a filter too: Spark moves later semi joins below this join, where they would shuffle all texts
            return docs.where(F.col("id").isin(ids)).join(F.broadcast(best.select(F.col("doc_id").alias("id"), "rank")), "id")
    return docs.filter(any_contains(question, "titulo", "contenido", "palabras_clave", "resumen")).withColumn("rank", F.lit(None).cast("double"))


def fragment(text: Column, question: str, most: int = FRAGMENT) -> Column:
    """From a third before the question's first word (of over three letters) that occurs."""
    t = strip(F.coalesce(text, F.lit("")))
    words = [w for w in re.split(r"\W+", question.lower()) if len(w) > 3]
    at = F.coalesce(*[F.nullif(F.locate(w, F.lower(t)), F.lit(0)) for w in words], F.lit(0)) if words else F.lit(0)
    start = F.greatest(F.lit(0), at - 1 - most // 3)
    return F.when(at == 0, F.substring(t, 1, most)).otherwise(strip(F.substr(t, start + 1, F.lit(most))))


def packed(best: DataFrame, question: str, most_chars: int = MOST_CHARS) -> DataFrame:
    """The blocks of the ranked documents (few rows, by place) up to the first that the budget doesn't hold.

    Lengths aren't negative, so stopping at the first overflow keeps the rows whose running sum fits."""
    none = F.lit("-")
    cut = fragment(F.coalesce(F.nullif(F.col("resumen"), F.lit("")), F.col("contenido")), question)
    ref = F.coalesce(F.nullif(F.col("referencia"), F.lit("")), F.col("titulo"))
    block = F.concat(
        F.lit("--- DOCUMENTO "), F.col("place").cast("string"), F.lit(" ---\nTipo: "), F.col("tipo"), F.lit(" | Numero: "), F.coalesce(F.nullif(F.col("numero"), F.lit("")), none),
        F.lit(" | Anio: "), F.coalesce(F.col("anio").cast("string"), none), F.lit(" | Fecha: "), F.coalesce(F.nullif(F.col("fecha"), F.lit("")), none),
        F.lit("\nReferencia: "), ref, F.lit("\nLeyes citadas: "), F.coalesce(F.col("leyes_citadas"), F.lit("[]")),
        F.lit("\nArticulos: "), F.coalesce(F.col("articulos_clave"), F.lit("[]")), F.lit("\nExtracto relevante:\n"), cut, F.lit("\n"),
    )
    upto = F.sum(F.length("bloque")).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    rows = best.withColumns({"bloque": block, "extracto": cut, "ref": ref}).withColumn("upto", upto).filter(F.col("upto") <= most_chars)
    return rows.select("place", "id", "tipo", F.col("ref").alias("referencia"), "extracto", relevance(F.col("rank")).alias("relevancia"), "bloque", "upto")


def context(docs: DataFrame, scorer: Stored | Scan, question: str, most: int = MOST_DOCS, most_chars: int = MOST_CHARS) -> DataFrame:
    """Docs are filtered before the ranking; a text that is no valid match falls back to containment. Ids are
    ranked first, and texts fetched for ``most`` of them."""
    parsed = parse(question)
    if parsed.valid and parsed.phrases:
        own = scorer.scores(parsed.phrases).withColumnRenamed("doc_id", "id")
        ids = kept(docs.select("id").join(own, "id").orderBy(F.round("rank", 9), "id").limit(most), "ranking")
        best, order = docs.join(F.broadcast(ids), "id"), [F.round("rank", 9), F.col("id")]
    else:
        best = docs.filter(any_contains(question.strip(), "titulo", "resumen", "contenido")).withColumn("rank", F.lit(1000.0))
        order = [F.col("fecha").desc_nulls_last(), F.col("id").desc()]
        best = best.orderBy(*order).limit(most)
    return packed(best.withColumn("place", F.row_number().over(Window.orderBy(*order))), question, most_chars)


def answer(sources: DataFrame, question: str, model: Callable[[str, str], str] | None = None) -> DataFrame:
    """One row: the answer, with its sources' context and confidence.

    ``model`` takes the question and the context (a budget's worth of text) and returns the answer; it is called at most
    once, on the driver. Without it, or where it fails, the answer says so and the sources stay."""
    asked = bool((question or "").strip())
    got = sources.agg(F.count(F.lit(1)).alias("fuentes"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "bloque"))), lambda r: r["bloque"]), "\n").alias("contexto"))
    said, note = "Encontré documentos relevantes, pero no tengo salida del modelo disponible en este entorno.", "Se devolvieron solo las fuentes encontradas."
    sure = "media"
    if model is not None and asked:
        got = kept(got, "context")
        row = got.first()
        if row.fuentes:
            try:
                said, note, sure = model(question, row.contexto), "", "alta"
            except Exception as e:
                note = f"El modelo no respondió ({type(e).__name__}). {note}"
    n = F.col("fuentes")
    return got.select(
        F.when(n == 0, "No encontré base suficiente en el corpus para afirmar esto.").otherwise(said).alias("respuesta"),
        F.when(n == 0, "baja").otherwise(sure).alias("confianza"),
        F.when(F.lit(not asked), "Debes ingresar una pregunta.").when(n == 0, "No encontré documentos relevantes para construir evidencia.").otherwise(note).alias("nota"),
        "fuentes",
        "contexto",
    )
