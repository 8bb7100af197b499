"""Exact de-duplication over a persistent digest index (native DataFrame operations only).

The index is a Parquet table bucketed and sorted by digest in a folder of its own, so it outlives sessions and catalogs:
a later batch is anti-joined to it by sort-merge (the index side needs no shuffle) and what is new is appended. The
number of buckets is written beside the data when the index is first made, and every later session takes it from there.

Defined cases: a null text counts as empty; texts are equal when identical without the characters
[\\x20\\x09-\\x0D]; of equal texts the longest original stays, then the smallest doc_id (null ids last).
Rows that agree in doc_id and text tie: one of them stays. An empty table gives an empty result. Columns
beyond doc_id and text are ignored by ``classify`` and passed through by ``keep_first``. Very long texts are read whole.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafquarry.llm.common import met, new_folder, parts, pick, written

WHITE = " \t\n\u000b\f\r"
#: Copies of a row that one array may number.
BLOCK = 10_000


def normalised(text):
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n_points, n_tied: one row for each distinct (doc_id, text length, digest).

    Grouped by all three, so that a large group of copies is spread over all tasks."""
    thin = pick(docs, doc_id="doc_id", text="text").select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"),
        F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_points"),
    )
    return thin.groupBy("doc_id", "digest", "n_points").agg(F.count(F.lit(1)).alias("n_tied"))


class DigestIndex:
    """The persistent index at ``path``. ``n_buckets`` is chosen when it is first made; asking for another number later
    raises ValueError, since rows in other buckets would not be found again."""

    COLUMNS = "digest BINARY, keep_id BIGINT, keep_points BIGINT, keep_tied BIGINT, batch STRING"

    def __init__(self, spark: SparkSession, path: str, n_buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        made = self._layout()
        if made is None:
            made = n_buckets or parts(spark)
            spark.range(1).select(F.lit(made).alias("n_buckets")).coalesce(1).write.json(f"{self.path}.layout")
        if n_buckets not in (None, made):
            raise ValueError(f"the index has {made} buckets, not {n_buckets}")
        self.n_buckets = made
        self.table = "digest_index_" + hashlib.md5(self.path.encode()).hexdigest()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({self.COLUMNS}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {made} BUCKETS LOCATION '{self.path}'"
        )

    def _layout(self) -> int | None:
        try:
            return int(self.spark.read.schema("n_buckets INT").json(f"{self.path}.layout").first().n_buckets)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def rows(self) -> DataFrame:
        """The index without its bucket layout."""
        return self.spark.read.schema(self.COLUMNS).parquet(self.path)

    def add(self, thin: DataFrame) -> str:
        """Appends the digests that the index lacks; returns the name under which this batch's rows stand."""
        batch = uuid.uuid4().hex
        best = F.max(
            F.struct(
                F.col("n_points"),
                F.col("doc_id").isNotNull().alias("named"),
                (-F.col("doc_id")).alias("low"),
                F.col("n_tied"),
            )
        )
        # written, as Spark would else join before it groups, and a large group of copies would meet in one task
        groups = written(thin.groupBy("digest").agg(best.alias("b")), "digest-groups", thin=True)
        fresh = groups.join(self.spark.table(self.table).select("digest").hint("merge"), "digest", "left_anti")
        fresh.select(
            "digest",
            (-F.col("b.low")).alias("keep_id"),
            F.col("b.n_points").alias("keep_points"),
            F.col("b.n_tied").alias("keep_tied"),
            F.lit(batch).alias("batch"),
        ).repartition(self.n_buckets, "digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)
        return batch

    def drop(self) -> None:
        """Forgets the catalog's entry; the data stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def labelled(thin: DataFrame, index: DigestIndex, batches: list[str]) -> DataFrame:
    """One row per document of thin: doc_id, keep_id, group_size, kept, text_sha256. A digest with a large group is
    met by broadcast (see ``met``), so no task gets a whole group."""
    groups = thin.groupBy("digest").agg(F.sum("n_tied").cast("bigint").alias("group_size"), F.count(F.lit(1)).alias("weight"))
    groups = written(groups.join(index.rows(), "digest"), "digest-groups", thin=True)
    chosen = met(thin, groups, ["digest"], "weight")
    is_keeper = (
        F.col("batch").isin(batches) & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))
    )
    blocks = chosen.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n_tied - 1) div {BLOCK}"))))
    copies = blocks.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(BLOCK), F.col("n_tied") - F.col("block") * BLOCK))))
    return copies.select(
        "doc_id",
        "keep_id",
        "group_size",
        (is_keeper & (F.col("block") == 0) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def classify(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    group_size counts the rows of docs with that text. A text that an earlier batch brought into the index keeps
    that batch's document, and all of this batch's rows with it are dropped."""
    thin = written(digests(docs), "digests", thin=True)
    return labelled(thin, index, [index.add(thin)])


def classify_whole(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """As ``classify``, but docs enter the index in two batches, the longer texts first: of equal texts the
    longest is then in the first batch that has any, so the second batch needs no look back."""
    thin = written(digests(docs), "digests", thin=True)
    cut = thin.agg(F.avg("n_points")).first()[0] or 0.0
    return labelled(thin, index, [index.add(thin.where(F.col("n_points") >= cut)), index.add(thin.where(F.col("n_points") < cut))])


def keep_first(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    The semi join is on document, length and digest, so a hot group of copies is spread. Only where a
    keeper is itself repeated (same doc_id and text) are those rows reduced to one by a second branch."""
    thin = written(digests(docs), "digests", thin=True)
    batch = index.add(thin)
    mine = index.rows().where(F.col("batch") == batch)
    names = docs.columns
    placed = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = (F.col(f"c{names.index(n)}") for n in ("doc_id", "text"))
    keyed = placed.withColumns(
        {
            "k_id": doc_id.cast("bigint"),
            "k_digest": F.unhex(F.sha2(normalised(text), 256)),
            "k_points": F.length(F.coalesce(text, F.lit(""))).cast("bigint"),
        }
    )

    def staying(keepers: DataFrame) -> DataFrame:
        on = (
            F.col("k_id").eqNullSafe(F.col("keep_id"))
            & (F.col("k_digest") == F.col("digest"))
            & (F.col("k_points") == F.col("keep_points"))
        )
        return keyed.join(keepers, on, "left_semi")

    kept = staying(mine.where("keep_tied = 1"))
    tied = mine.where("keep_tied > 1")
    if not tied.isEmpty():
        kept = kept.unionByName(staying(tied).dropDuplicates(["k_digest"]))
    return kept.drop("k_id", "k_digest", "k_points").toDF(*names)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against an index that the table itself fills in two batches."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify_whole(docs, DigestIndex(spark, new_folder(spark, "digest-index")))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ASC NULLS LAST) AS rn,
         count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ASC NULLS LAST) AS keep_id
  FROM d)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM r
"""
