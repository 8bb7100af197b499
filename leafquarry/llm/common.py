"""Helpers that the text operators share.

Ids are integers: a doc_id of another type is cast to bigint, and one that isn't a number raises Spark's cast error.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that one Arrow batch may hold, so that a Python worker's memory doesn't depend on text lengths.
BATCH_BYTES = 1 << 20
#: A key is hot from this share of all rows on, so at most 1 / HOT_SHARE keys are; and from so many rows on.
HOT_SHARE, HOT_ROWS = 1 / 2000, 100


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """The wanted columns (alias=name) and no others. Columns are addressed by place, so others whose
    names clash (also in another case) do no harm. A missing column raises ValueError."""
    names = df.columns
    for name in wanted.values():
        if name not in names:
            raise ValueError(f"column {name!r} is missing; there are {names}")
    placed = df.toDF(*[f"c{i}" for i in range(len(names))])
    return placed.select(*[F.col(f"c{names.index(n)}").alias(a) for a, n in wanted.items()])


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="leafquarry-")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and
    everything runs on this machine (tests). On a cluster without the setting it raises ValueError."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + _own_folder()
    return root.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, thin: bool = False) -> DataFrame:
    """df, written to the shared folder and read back: cuts the lineage so that a lost executor costs no recomputation.
    What a shuffle left as thin rows goes to a few files for each core, not one for each shuffle partition."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    if thin:
        df = df.coalesce(max(16, 4 * spark.sparkContext.defaultParallelism))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Limits Arrow batches by bytes; called by every operator that runs Python over whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with each row's place in the order (0, 1, ...) in column ``name``; written to the shared folder. Rows are sorted in ranges;
    what is numbered across ranges is their sizes, one row for each. Rows that agree in the whole order are placed anyhow."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    placed = written(placed, "numbered")
    sizes = placed.groupBy(F.shiftright(name, 33).alias("range")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    found = placed.join(F.broadcast(starts), F.shiftright(name, 33) == F.col("range"))
    return found.withColumn(name, F.col(name).bitwiseAND(F.lit((1 << 33) - 1)) + F.col("start")).drop("range", "start")


def _hot(table: DataFrame, weight: str) -> int:
    return max(HOT_ROWS, int((table.agg(F.sum(weight)).first()[0] or 0) * HOT_SHARE))


def met(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """rows joined with table, which has one row for each combination of keys (never null) and in ``weight`` how many of
    rows have it. Both must be written ones, as they are read twice. What is hot (see HOT_SHARE: a few thousand rows at
    most, whatever the size) is broadcast; the rest meets by a join on the keys in which no key is large."""
    least = _hot(table, weight)
    hot = F.broadcast(table.where(F.col(weight) >= least))
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.where(F.col(weight) < least), keys)
    return rows.join(hot, keys).unionByName(rest)


def unmet(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """The rows that ``met`` would not join: what is hot goes by broadcast first."""
    least = _hot(table, weight)
    rest = rows.join(F.broadcast(table.where(F.col(weight) >= least).select(*keys)), keys, "left_anti")
    return rest.join(table.where(F.col(weight) < least).select(*keys), keys, "left_anti")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(doc_id, modulus: int):
    """crc32 of doc_id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(modulus))
