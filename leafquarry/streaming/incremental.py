"""Incremental ingest and the progress buffer as Structured Streaming."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def classify_new(batch: DataFrame, known: DataFrame) -> DataFrame:
    """``outcome`` of each row of a batch: known by identity, address or hash, a repeat within the batch, or new."""
    return outcomes(batch, keys_of(known, True).select("kind", "key").distinct())


#: How a record is known, strongest first: name and the columns that make its key.
KEYS = {"identidad": ("tipo", "numero", "anio"), "url": ("url_sii",), "hash": ("hash_md5",)}
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def key(columns: tuple[str, ...]) -> Column:
    """One text of several columns; null where one of them is."""
    parts = [F.col(c).cast("string") for c in columns]
    return F.when(reduce(lambda x, y: x & y, [p.isNotNull() for p in parts]), F.concat_ws("\x01", *parts))


def keys_of(rows: DataFrame, stored: bool, *others: Column) -> DataFrame:
    """kind, key, stored: a row for each key that a record has."""
    made = [F.struct(F.lit(kind).alias("kind"), key(columns).alias("key")) for kind, columns in KEYS.items()]
    each = rows.select(F.explode(F.array(*made, *others)).alias("k"))
    return each.where("k.key IS NOT NULL").select("k.kind", "k.key", F.lit(stored).alias("stored"))


def outcomes(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows with ``outcome``; known: kind, key of what is stored already, among the keys of rows at least."""
    for kind, columns in KEYS.items():
        mine = known.where(F.col("kind") == kind).select(F.col("key").alias(f"_{kind}"))
        rows = rows.withColumn(f"_k_{kind}", key(columns)).join(mine, F.col(f"_k_{kind}") == F.col(f"_{kind}"), "left").drop(f"_k_{kind}")
    first = rows.groupBy(F.col("hash_md5").alias("_h")).agg(F.min("seq").alias("_first"))
    rows = rows.join(first, F.col("hash_md5") == F.col("_h"), "left")
    outcome = F.lit(None).cast("string")
    for kind in reversed(KEYS):
        outcome = F.when(F.col(f"_{kind}").isNotNull(), kind).otherwise(outcome)
    outcome = F.coalesce(outcome, F.when(F.col("seq") != F.col("_first"), "repetido").otherwise("nuevo"))
    return rows.withColumn("outcome", outcome).drop(*(f"_{kind}" for kind in KEYS), "_h", "_first")


def start_ingest(spark: SparkSession, landing: str, schema: str, target: str, checkpoint: str, log: str | None = None, name: str = "ingest") -> StreamingQuery:
    """Takes what landed since the last run and appends what is new to target; started by a scheduler. While a run of
    this name is active, that one is returned and no other starts.

    What is stored is kept as keyed state (RocksDB, by key): the stream reads the landing and, once, each file that target has or gets, and
    an aggregation by key says for the keys of a batch whether a stored record has them. So a batch reads what
    landed and what the run before stored, never the whole target, and a record that was turned away leaves no trace. A run is
    one batch. It writes target/lote=n (and log/lote=n: seq, outcome) by overwriting, so a batch that is run again after a
    failure adds nothing twice.

    Defined cases: a record lacking a part of a key isn't known by that key; of equal hashes in a batch the smallest seq is new, the others
    are repeats; an empty landing stores nothing."""
    for running in spark.streams.active:
        if running.name == name:
            return running
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    if not _exists(session, target):
        session.createDataFrame([], schema).write.parquet(f"{target}/lote=-1")

    def step(touched: DataFrame, batch: int) -> None:
        touched.persist()
        try:
            files = [r.key for r in touched.where("kind = 'archivo'").select("key").collect()]  # what landed, by file
            if files:
                rows = outcomes(session.read.schema(schema).json(files), touched.where("stored").select("kind", "key")).persist()
                if log:
                    rows.select("seq", "outcome").write.mode("overwrite").parquet(f"{log}/lote={batch}")
                rows.where("outcome = 'nuevo'").drop("outcome").write.mode("overwrite").parquet(f"{target}/lote={batch}")
                rows.unpersist()
        finally:
            touched.unpersist()

    landed = session.readStream.schema(schema).json(landing)
    stored = session.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(target)
    file = F.struct(F.lit("archivo").alias("kind"), F.col("_metadata.file_path").alias("key"))
    keys = keys_of(stored, True).unionByName(keys_of(landed, False, file))
    known = keys.groupBy("kind", "key").agg(F.max("stored").alias("stored"))
    stream = known.writeStream.queryName(name).outputMode("update").foreachBatch(step)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(path).limit(0).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def start_daily_counts(spark: SparkSession, landing: str, schema: str, target: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Counts of log rows by day and state, final once their day is ``late`` past."""
    rows = spark.readStream.schema(schema).parquet(landing).withColumn("fecha", F.col("fecha").cast("timestamp")).withWatermark("fecha", late)
    counted = rows.groupBy(F.window("fecha", "1 day"), "estado").agg(F.count(F.lit(1)).alias("cnt"))
    out = counted.select(F.col("window.start").cast("date").alias("day"), "estado", "cnt")
    return out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def progress_level(message):
    """By how a message begins."""
    return F.when(message.rlike(r"(?i)^\s*(error|warn|fallo)"), "WARN").otherwise("OK")


def latest_progress(log: DataFrame, most: int = 300) -> DataFrame:
    """The last messages, a bounded sort."""
    return log.orderBy(F.col("seq").desc()).limit(most).withColumn("level", progress_level(F.col("message")))


def status(query: StreamingQuery) -> dict:
    """What a page shows of a running job; stop it with query.stop()."""
    return {"active": query.isActive, "message": query.status["message"], "rows": (query.lastProgress or {}).get("numInputRows", 0)}
