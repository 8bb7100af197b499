"""A full-text index in segments (K15, O07): kept up by small commits, and ranked without reading what cannot reach the best.

A segment holds a commit's documents: ``docs`` (length, and the terms of each field in order, as one text), ``postings`` (a row a term,
document and field, with positions and the document's length; on the first row of a term in a document also how often it occurs over
all fields) and ``dfs``. Documents are dealt to ranges of similar length; each row of a term in a range has the largest frequency and
the least length of the term there, which bound what it adds to a score. Rows are shuffled as documents, never as postings: a task gets
the documents of whole ranges, so few that it sorts their postings in memory, and writes one file, sorted by term and range; a
question's terms and the ranges that it needs prune files and row groups. A merge makes the postings again from ``docs``.

A commit writes a new segment, the ids whose older versions are dead (``gone``) and by how much each term's number of documents changed;
older segments stay as they are. ``merge`` rewrites all live rows as one segment. The manifest lists the segments of each
version with their numbers of documents and terms, so statistics need no scan. One writer at a time; readers keep the
version that they opened.

Defined cases: null and empty fields have no terms; a document without any counts for the statistics; committing a known id replaces it;
removing an unknown one does nothing; an empty index ranks nothing; of repeated ids in a commit the postings add up, so ids must be unique.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafquarry.functions.text import bound
from leafquarry.operators.retrieval import B, K1, blanks, listed
from leafquarry.sources.tables import kept

#: Documents in a range; ranges that the first look reads; ranges that a filter may list.
RANGE, FIRST, LISTED = 1024, 64, 1000
#: Tokens of a task's documents, besides its last range: at most, and at least where the machines would take more tasks. Ids that are broadcast.
TOKENS, LEAST_TOKENS, BROADCAST = 4 << 20, 1 << 16, 1 << 20
MANIFEST = "v bigint, ord bigint, folder string, n_docs bigint, n_terms bigint"
PARTS = {
    "postings": "term string, range bigint, doc_id bigint, field string, positions array<int>, dl bigint, tf bigint, most bigint, least bigint",
    "docs": "doc_id bigint, dl bigint, tokens string",
    "dfs": "term string, docs bigint",
    "gone": "doc_id bigint",
}


def impact(tf: Column, dl: Column, mean: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(mean or 1.0)))


def _few(ids: DataFrame) -> DataFrame:
    """ids, broadcast where they are few, so that the rows which they meet stay where they are."""
    return F.broadcast(ids) if ids.count() <= BROADCAST else ids


def _written(rows: DataFrame, path: str) -> None:
    rows.write.option("compression", "zstd").option("parquet.block.size", 4 << 20).parquet(path)


def _moved(positions: str, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


class SegmentedIndex:
    def __init__(self, spark: SparkSession, path: str, fields: list[str], range_size: int = RANGE):
        self.spark, self.path, self.fields, self.range_size = spark, path.rstrip("/"), fields, range_size
        self.read: dict[str, int] = {}
        self._known: tuple = (None, None)
        self.open()

    def open(self) -> SegmentedIndex:
        """The newest version; the next one's number is one more."""
        try:
            rows = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest")
            self.version = rows.agg(F.max("v")).first()[0] or 0
            self.segments = [r.asDict() for r in rows.where(F.col("v") == self.version).orderBy("ord").collect() if r.folder]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            self.version, self.segments = 0, []
        return self

    def cleared(self) -> SegmentedIndex:
        """Without any segment, as from the next commit on; files of older versions stay for their readers."""
        self.segments = []
        return self

    def _publish(self, segments: list[dict]) -> None:
        rows = [(self.version + 1, s["ord"], s["folder"], s["n_docs"], s["n_terms"]) for s in segments]
        self.spark.createDataFrame(rows or [(self.version + 1, 0, None, 0, 0)], MANIFEST).coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        self.version, self.segments = self.version + 1, segments

    def part(self, name: str) -> DataFrame:
        """The rows of all segments, with the segment's place in the order."""
        frames = [self.spark.read.schema(PARTS[name]).parquet(f"{self.path}/{s['folder']}/{name}").withColumn("ord", F.lit(s["ord"])) for s in self.segments]
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], PARTS[name] + ", ord int")

    def live(self, name: str) -> DataFrame:
        """The rows whose document no later commit replaced or removed."""
        rows = self.part(name)
        if len(self.segments) < 2:
            return rows
        return rows.join(self._dead(), ["doc_id", "ord"], "left_anti")

    def _dead(self) -> DataFrame:
        """doc_id, ord of the rows that a later commit replaced or removed, found by ids alone and kept for this version. Up to a million
        are broadcast; beyond, they meet the rows by a shuffle until a merge."""
        if self._known[0] != self.version:
            last = self.part("gone").groupBy("doc_id").agg(F.max("ord").alias("dead_until"))
            self._known = self.version, _few(kept(self.part("docs").select("doc_id", "ord").join(last, "doc_id").where("ord < dead_until").drop("dead_until"), "dead"))
        return self._known[1]

    # -- writing

    def _forward(self, docs: DataFrame) -> DataFrame:
        """doc_id, dl, tokens (the fields' terms, ``listed``)."""
        return docs.select("doc_id", listed(self.fields).alias("tokens")).select("doc_id", blanks("tokens").cast("bigint").alias("dl"), "tokens")

    def _dealt(self, docs: DataFrame) -> DataFrame:
        """docs with range and chunk. Ranges hold consecutive documents by length, and those of one length are dealt by a hash of the id; a
        chunk, which one task gets, holds the ranges that begin within so many tokens. There is one row a length, so lengths are summed
        up in one task; they and the ranges are broadcast."""
        lengths = docs.groupBy("dl").agg(F.count(F.lit(1)).alias("n"))
        shorter = Window.orderBy("dl").rowsBetween(Window.unboundedPreceding, -1)
        places = lengths.withColumns({"before": F.coalesce(F.sum("n").over(shorter), F.lit(0)), "tokens_before": F.coalesce(F.sum(F.col("n") * F.col("dl")).over(shorter), F.lit(0))})
        places = kept(places, "lengths")
        total = places.agg(F.coalesce(F.sum(F.col("n") * F.col("dl")), F.lit(0))).first()[0]
        a_task = min(TOKENS, max(LEAST_TOKENS, total // (2 * self.spark.sparkContext.defaultParallelism)))
        begins = places.select("*", F.explode(F.sequence(F.floor(F.col("before") / self.range_size), F.floor((F.col("before") + F.col("n") - 1) / self.range_size))).alias("range"))
        begins = begins.withColumn("start", F.col("range") * self.range_size).where("start >= before")
        ranges = kept(begins.select("range", F.floor((F.col("tokens_before") + (F.col("start") - F.col("before")) * F.col("dl")) / a_task).cast("int").alias("chunk")), "ranges")
        chunks = 1 + (ranges.agg(F.max("chunk")).first()[0] or 0)
        place = F.col("before") + F.pmod(F.xxhash64("doc_id"), F.col("n"))
        rows = docs.join(F.broadcast(places.drop("tokens_before")), "dl").withColumn("range", F.floor(place / self.range_size)).drop("before", "n")
        return rows.join(F.broadcast(ranges), "range").repartitionById(chunks, "chunk")

    def _tokens(self, docs: DataFrame) -> DataFrame:
        """term, doc_id, field, positions, dl, tf of docs (doc_id and the fields)."""
        return self._listed(self._forward(docs), []).withColumn("field", self._name("field")).select("term", "doc_id", "field", "positions", "dl", "tf")

    def _name(self, field: str) -> Column:
        return F.element_at(F.array(*map(F.lit, self.fields)), F.col(field) + 1)

    def _listed(self, docs: DataFrame, others: list[str]) -> DataFrame:
        """term, doc_id, field (its number), positions, dl, tf and the others of forward rows. A row's tokens are sorted and strung together
        within the row, a line a term and a part a field, and cut at these, so no token is shuffled alone."""

        def placed(tokens: Column, k: Column) -> Column:
            return F.transform(F.filter(F.split(tokens, " "), lambda t: t != ""), lambda t, i: F.struct(t.alias("term"), k.alias("field"), i.alias("pos")))

        def pos(x: Column) -> Column:
            return F.concat(F.lit(" "), x["pos"].cast("string"))

        def field(x: Column) -> Column:
            return F.concat(F.lit("\t"), x["field"].cast("string"), pos(x))

        def piece(x: Column, before: Column) -> Column:
            begins = F.concat(F.lit("\n"), x["term"], field(x))
            return F.when(x.isNull(), "").when(~x["term"].eqNullSafe(before["term"]), begins).when(x["field"] != before["field"], field(x)).otherwise(pos(x))

        def strung(tokens: Column) -> Column:
            none = F.lit(None).cast("struct<term:string,field:int,pos:int>")
            return F.array_join(F.zip_with(tokens, F.concat(F.array(none), tokens), piece), "")

        own = ["doc_id", "dl", *others]
        each = F.flatten(F.transform(F.split("tokens", "\n"), placed))
        rows = docs.select(*own, bound(F.sort_array(each), strung).alias("strung"))
        # outer, as Spark would otherwise infer a filter that makes the string once more
        lines = rows.select(*own, F.explode_outer(F.split("strung", "\n")).alias("line")).where("line <> ''")
        tf = (F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit("")))).cast("bigint")
        parts = lines.select(*own, F.substring_index("line", "\t", 1).alias("term"), tf.alias("tf"), F.posexplode_outer(F.split("line", "\t")).alias("k", "part")).where("k > 0")
        parts = parts.withColumn("numbers", F.split("part", " ").cast("array<int>"))
        tf = F.when(F.col("k") == 1, F.col("tf"))
        return parts.select("term", *own, F.get("numbers", F.lit(0)).alias("field"), F.slice("numbers", 2, F.size("numbers") - 1).alias("positions"), tf.alias("tf"))

    def _write(self, folder: str, docs: DataFrame, gone: DataFrame, lost: DataFrame) -> tuple[int, int]:
        """docs: doc_id, dl, tokens; lost: term, docs (documents that the term no longer has)."""
        at = f"{self.path}/{folder}"
        _written(docs, f"{at}/docs")
        docs = self.spark.read.schema(PARTS["docs"]).parquet(f"{at}/docs")
        # a chunk's rows are in one task: what follows needs no other shuffle, and one sort
        rows = self._listed(self._dealt(docs), ["range", "chunk"]).sortWithinPartitions("chunk", "term", "range", "doc_id", "field")
        there = Window.partitionBy("chunk", "term", "range")
        rows = rows.withColumns({"most": F.max("tf").over(there), "least": F.min("dl").over(there), "field": self._name("field")})
        _written(rows.select("term", "range", "doc_id", "field", "positions", "dl", "tf", "most", "least"), f"{at}/postings")
        added = self.spark.read.schema(PARTS["postings"]).parquet(f"{at}/postings").where("tf IS NOT NULL").select("term", F.lit(1).alias("docs"))
        dfs = added.unionByName(lost.select("term", (-F.col("docs")).alias("docs"))).groupBy("term").agg(F.sum("docs").alias("docs")).where("docs <> 0")
        _written(dfs.repartitionByRange("term").sortWithinPartitions("term"), f"{at}/dfs")
        _written(gone.select("doc_id"), f"{at}/gone")
        return tuple(docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first())

    def commit(self, docs: DataFrame, removed: DataFrame | None = None) -> SegmentedIndex:
        """Adds or replaces docs (id and the fields), and removes ids; writes one segment, reads the forward rows of what dies."""
        own = docs.select(F.col("id").cast("bigint").alias("doc_id"), *self.fields)
        gone = own.select("doc_id") if removed is None else own.select("doc_id").unionByName(removed.select(F.col("id").cast("bigint").alias("doc_id"))).distinct()
        dead = self.part("docs")
        if self.segments:  # ids first, so that only the rows of what dies move
            ids = _few(kept(self.live("docs").select("doc_id").join(gone, "doc_id", "left_semi").distinct(), "dying"))
            dead = self.live("docs").join(ids, "doc_id", "left_semi")
        dead = kept(dead.select("dl", F.array_distinct(F.split(F.ltrim(F.replace("tokens", F.lit("\n"), F.lit(""))), " ")).alias("terms")), "dead")
        lost = dead.select(F.explode("terms").alias("term")).where("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("docs"))
        order = 1 + max((s["ord"] for s in self.segments), default=0)
        folder = f"segment-{order}-{uuid.uuid4().hex}"
        n_docs, n_terms = self._write(folder, self._forward(own), gone, lost)
        old_docs, old_terms = dead.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        self._publish([*self.segments, {"ord": order, "folder": folder, "n_docs": n_docs - old_docs, "n_terms": n_terms - old_terms}])
        return self

    def merge(self) -> SegmentedIndex:
        """All live rows as one segment."""
        if not self.segments:
            return self
        order = self.segments[-1]["ord"]
        folder = f"segment-{order}-{uuid.uuid4().hex}"
        none = self.spark.createDataFrame([], "doc_id bigint")
        lost = self.spark.createDataFrame([], "term string, docs bigint")
        n_docs, n_terms = self._write(folder, self.live("docs").select("doc_id", "dl", "tokens"), none, lost)
        self._publish([{"ord": order, "folder": folder, "n_docs": n_docs, "n_terms": n_terms}])
        return self

    # -- reading

    def _idf(self, df: Column, n: int) -> Column:
        return F.greatest(F.ln((n - df + 0.5) / (df + 0.5)), F.lit(1e-6))

    def _hits(self, rows: DataFrame, phrase: tuple[str, ...]) -> DataFrame:
        """ord, range, doc_id, dl, tf of a phrase: positions at which its terms follow each other in one field."""
        keys = ["ord", "range", "doc_id", "field"]
        found = rows.where(F.col("term") == phrase[0]).select(*keys, "dl", "positions")
        for k, term in enumerate(phrase[1:], 1):
            after = rows.where(F.col("term") == term).select(*keys, _moved("positions", k).alias("after"))
            found = found.join(after, keys).select(*keys, "dl", F.array_intersect("positions", "after").alias("positions"))
        return found.where(F.size("positions") > 0).groupBy("ord", "range", "doc_id").agg(F.first("dl").alias("dl"), F.sum(F.size("positions")).alias("tf"))

    def best(self, phrases: tuple[tuple[str, ...], ...], most: int, looked_at: int = FIRST) -> DataFrame:
        """doc_id, rank of the ``most`` best documents, as ``bm25`` ranks them (negative, the lower the better; ties by doc_id).

        The ranges with the highest bounds are scored first; then those whose bound isn't below the last of the best so far. All
        others hold no document that could be among the best. Terms are bounded by their statistics; phrases of several
        terms are matched whole first, as their number of documents isn't stored. ``self.read`` has the numbers of ranges."""
        n = sum(s["n_docs"] for s in self.segments)
        if not n or not phrases:
            return self.spark.createDataFrame([], "doc_id bigint, rank double")
        mean = sum(s["n_terms"] for s in self.segments) / n
        terms = sorted({p[0] for p in phrases if len(p) == 1})
        live = self.live("postings")
        dfs = {r.term: r.docs for r in self.part("dfs").where(F.col("term").isin(terms)).groupBy("term").agg(F.sum("docs").alias("docs")).collect()}
        of_term = F.coalesce(*[F.when(F.col("term") == t, self._idf(F.lit(float(d)), n)) for t, d in dfs.items()], F.lit(0.0))
        bounds = self.part("postings").where(F.col("term").isin(terms)).groupBy("term", "ord", "range").agg(F.first("most").alias("most"), F.first("least").alias("least"))
        bounds = bounds.select("ord", "range", (of_term * impact(F.col("most"), F.col("least"), mean)).alias("bound"))
        whole = []
        for phrase in (p for p in phrases if len(p) > 1):
            hits = kept(self._hits(live.where(F.col("term").isin(*set(phrase))), phrase), "phrase")
            df = hits.count()
            whole.append(hits.select("ord", "range", "doc_id", (self._idf(F.lit(float(df)), n) * impact(F.col("tf"), F.col("dl"), mean)).alias("part")))
            bounds = bounds.unionByName(whole[-1].groupBy("ord", "range").agg(F.max("part").alias("bound")))
        # a bound is a little more than the sum, as sums in another order may differ in the last digits
        bounds = kept(bounds.groupBy("ord", "range").agg((F.sum("bound") * (1 + 1e-9)).alias("bound")), "bounds")

        def scored(chosen: DataFrame) -> DataFrame:
            rows = live.where(F.col("term").isin(terms))
            listed = chosen.limit(LISTED + 1).collect()
            if len(listed) <= LISTED:
                rows = rows.where(F.col("range").isin(sorted({r["range"] for r in listed})))
            rows = rows.join(chosen, ["ord", "range"], "left_semi")
            each = rows.groupBy("doc_id", "term").agg(F.sum(F.size("positions")).alias("tf"), F.first("dl").alias("dl"))
            parts = each.select("doc_id", (of_term * impact(F.col("tf"), F.col("dl"), mean)).alias("part"))
            for w in whole:
                parts = parts.unionByName(w.join(chosen, ["ord", "range"], "left_semi").select("doc_id", "part"))
            return kept(parts.groupBy("doc_id").agg((-F.sum("part")).alias("rank")), "scores")

        order = [F.round("rank", 9), "doc_id"]
        first = kept(bounds.orderBy(F.col("bound").desc()).limit(looked_at).select("ord", "range"), "first")
        scores = scored(first)
        last = scores.orderBy(*order).limit(most).agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("rank")).first()
        least = -last["rank"] - 2e-9 if last["n"] == most else -1.0
        more = kept(bounds.where(F.col("bound") >= least).select("ord", "range").join(first, ["ord", "range"], "left_anti"), "more")
        self.read = {"ranges": bounds.count(), "read": first.count() + more.count()}
        if self.read["read"] > looked_at:
            scores = scores.unionByName(scored(more))
        return kept(scores.orderBy(*order).limit(most), "ranking")

    def scores(self, phrases: tuple[tuple[str, ...], ...]) -> DataFrame:
        """doc_id, rank of all documents with a hit."""
        n = sum(s["n_docs"] for s in self.segments)
        mean = sum(s["n_terms"] for s in self.segments) / max(1, n)
        rows = self.live("postings").where(F.col("term").isin(*{t for p in phrases for t in p}))
        parts = []
        for phrase in phrases:
            hits = kept(self._hits(rows, phrase), "phrase")
            df = hits.count()
            parts.append(hits.select("doc_id", (self._idf(F.lit(float(df)), n) * impact(F.col("tf"), F.col("dl"), mean)).alias("part")))
        if not n or not parts:
            return self.spark.createDataFrame([], "doc_id bigint, rank double")
        return reduce(DataFrame.unionByName, parts).groupBy("doc_id").agg((-F.sum("part")).alias("rank"))
