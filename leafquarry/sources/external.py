"""Sources outside the engine, and their offline forms.

Downloads are a caller's function from an address to bytes, run once for each row by Arrow batches with retries; the queries
themselves work on what was landed (JSON, binary files)."""

from __future__ import annotations

import io
import time
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The service's items; fixed values.
OFFICE_ITEM = "pubNumOficio string, idBlobArchPublica string, extensionArchPublica string, mTypeArchPublica string, pubFechaPubli string, pubLegal string, pubResumen string"
TREE = "body array<struct<id:bigint,nombre:string,cells:map<string,int>>>"


def fetched(urls: DataFrame, get: Callable[[str], tuple[int, bytes]], least: int = 0, retries: int = 3, delay: float = 1.5) -> DataFrame:
    """Url, status, content. A missing page (404) isn't asked for again; content under ``least`` bytes is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url in batch.column(0).to_pylist():
                status, content = 0, None
                for attempt in range(retries):
                    try:
                        status, content = get(url)
                    except Exception:  # a network's errors have many types; the row keeps status 0
                        status, content = 0, None
                    if status == 200 and content is not None and len(content) >= least or status == 404:
                        break
                    if attempt + 1 < retries:
                        time.sleep(delay)
                good = content if status == 200 and content is not None and len(content) >= least else None
                yield pa.RecordBatch.from_arrays([pa.array([url]), pa.array([status], pa.int32()), pa.array([good], pa.binary())], ["url", "status", "content"])

    return urls.select("url").mapInArrow(run, "url string, status int, content binary")


def office_items(spark: SparkSession, path: str) -> DataFrame:
    """Landed items of the offices' service."""
    return spark.read.schema(OFFICE_ITEM).json(path)


def tree_ids(laws: DataFrame) -> DataFrame:
    """The cells of a landed tree of laws that aren't empty: law and court group, each once."""
    return laws.select(F.explode("body").alias("b")).select("b.id", F.explode("b.cells").alias("grupo", "n")).filter("n > 0").select("id", "grupo").distinct()


def zip_members(files: DataFrame) -> DataFrame:
    """Path, name, content of each archive's best member: PDF before DOC before HTML, then by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = {"pdf": 0, "doc": 1, "docx": 1, "htm": 2, "html": 2}
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                        ranked = sorted((order[n.rsplit(".", 1)[-1].lower()], n) for n in z.namelist() if n.rsplit(".", 1)[-1].lower() in order)
                        name, data = (ranked[0][1], z.read(ranked[0][1])) if ranked else (None, None)
                except zipfile.BadZipFile:
                    name, data = None, None
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([name], pa.string()), pa.array([data], pa.binary())], ["path", "name", "content"])

    return files.select("path", "content").mapInArrow(run, "path string, name string, content binary")


def write_csv(df: DataFrame, path: str) -> None:
    """With a header, also where there are no rows. Reports are small; others should keep their partitions."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_report(df: DataFrame, path: str) -> None:
    """JSON lines with null fields kept."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """K09, K10."""
    df.write.mode("append").parquet(path)
