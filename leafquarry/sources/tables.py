"""Scans, look-ups and catalogue questions over columnar tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafquarry.functions.text import from_1252


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; filters and columns reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="leafquarry-tables-")


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir; a temporary one only where everything runs on
    this machine)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(root or _own_folder()).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def kept(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder and read back, so that what follows reads it instead of computing it again."""
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup(df: DataFrame, column: str, value: object) -> DataFrame:
    """At most one row with the value, the one with the smallest id."""
    return df.filter(F.col(column) == F.lit(value)).orderBy("id").limit(1)


def known(df: DataFrame, keys: DataFrame, on: list[str], wanted: bool = True) -> DataFrame:
    """The keys that the table has (or lacks), in bulk."""
    return keys.join(df.select(*on).distinct(), on, "left_semi" if wanted else "left_anti")


def base_type(tipo: Column) -> Column:
    """The kind before an ingestion key's first underscore."""
    return F.element_at(F.split(tipo, "_"), 1)


def common_columns(target: DataFrame, source: DataFrame) -> DataFrame:
    """The source's rows with the columns that both have, in the target's order."""
    return source.select(*[c for c in target.columns if c in source.columns])


def has_columns(df: DataFrame, names: list[str]) -> dict[str, bool]:
    """S24."""
    return {n: n in df.columns for n in names}


def ensure_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Adds the missing columns as nulls of the given types; running it again changes nothing."""
    return reduce(lambda d, x: d if x[0] in d.columns else d.withColumn(x[0], F.lit(None).cast(x[1])), wanted.items(), df)


def empty_tables(spark: SparkSession, schemas: dict[str, str], existing: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """A table for each schema; those that exist stay as they are."""
    existing = existing or {}
    return {name: existing.get(name, spark.createDataFrame([], schema)) for name, schema in schemas.items()}


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and maybe a byte order mark."""
    df = spark.read.csv(path, header=True, encoding="UTF-8")
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """Path, name, stem, extension, length of each file below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).drop("content")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        "path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("extension"), "length"
    )


def decoded_text(content: Column) -> Column:
    """The first of UTF-8 (with or without mark) and Windows-1252 that can decode the bytes."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    return F.regexp_replace(F.coalesce(utf8, from_1252(content)), "^﻿", "")
