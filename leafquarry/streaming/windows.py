"""Windows over time (W07): sessions and sliding windows of any table, and the same over a stream with late rows counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sessions(rows: DataFrame, time: str, keys: list[str], gap: str) -> DataFrame:
    """keys, start, last_before (the end of the window: the last row's time and the gap), n: rows of a key less than the gap apart. Rows without a time are left out."""
    counted = rows.where(F.col(time).isNotNull()).groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("last_before"), "n")


def sliding(rows: DataFrame, time: str, keys: list[str], length: str, step: str) -> DataFrame:
    """keys, start, n: rows in each window; a row is in length / step of them. Rows without a time are left out."""
    counted = rows.where(F.col(time).isNotNull()).groupBy(*keys, F.window(time, length, step).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*keys, F.col("w.start").alias("start"), "n")


def start_sessions(spark: SparkSession, landing: str, schema: str, target: str, checkpoint: str, time: str, keys: list[str], gap: str, late: str, files: int = 1) -> StreamingQuery:
    """Sessions over landed rows, each appended once no row in time can join it any more. Rows later than ``late`` behind the
    latest seen are dropped and counted (``late_rows``). files: landed files in a batch; the watermark moves between batches."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(landing).withWatermark(time, late)
    out = sessions(rows, time, keys, gap).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return out.outputMode("append").trigger(availableNow=True).start()


def late_rows(query: StreamingQuery) -> int:
    """How many rows a stream has dropped as too late, in the batches that it still remembers."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
