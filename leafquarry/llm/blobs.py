"""Sorted arrays that all workers map into memory: written by Spark as raw files in the shared folder.

A blob is a header (a magic number, bucket, kind, length) and bytes; a file holds any number of blobs, each followed by
one separator byte. Where the shared folder is a mounted one, workers map the files in place; elsewhere Spark fetches
each file once to every executor and workers map that copy.
"""

from __future__ import annotations

import mmap
import os
import struct
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafquarry.llm.common import new_folder

HEADER = struct.Struct("<4sIIQ")
MAGIC = b"LQB1"


def packed(bucket: int, kind: int, *arrays: np.ndarray) -> bytes:
    """A blob of arrays; each is preceded by its length in bytes and starts at a multiple of 8 within the blob."""
    body = []
    for a in arrays:
        raw = a.tobytes()
        body += [struct.pack("<Q", len(raw)), raw, b"\0" * (-len(raw) % 8)]
    content = b"".join(body)
    return HEADER.pack(MAGIC, bucket, kind, len(content)) + content


def unpacked(view: memoryview, kinds: tuple) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        (n,) = struct.unpack_from("<Q", view, at)
        out.append(np.frombuffer(view, np.uint8, n, at + 8).view(kind))
        at += 8 + n + (-n % 8)
    return out


def blobs_in(view: memoryview) -> Iterator[tuple[int, int, memoryview]]:
    """bucket, kind, content."""
    at = 0
    while at + HEADER.size <= len(view):
        magic, bucket, kind, n = HEADER.unpack_from(view, at)
        if magic != MAGIC:
            raise ValueError("not a file of blobs")
        yield bucket, kind, view[at + HEADER.size : at + HEADER.size + n]
        at += HEADER.size + n + 1


def write(df: DataFrame, tag: str, by_kind: bool = False) -> str:
    """Writes the column ``blob`` (with ``kind`` in folders of their own where asked for); returns the folder.
    Spark's text writer writes a string's bytes as they are."""
    path = new_folder(df.sparkSession, tag)
    raw = df.select(F.col("blob").cast("string").alias("value"), *(["kind"] if by_kind else []))
    writer = raw.write.option("compression", "none")
    (writer.partitionBy("kind") if by_kind else writer).text(path)
    return path


def files(spark: SparkSession, path: str) -> list[str]:
    """The files under a folder, as ``opened`` takes them. Their number is that of the writing tasks."""
    found = [r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path").collect()]
    if all(urlparse(f).scheme in ("", "file") for f in found):
        return [unquote(urlparse(f).path) for f in found]
    names = []
    for f in found:
        spark.sparkContext.addFile(f)
        names.append("spark-file:" + os.path.basename(f))
    return names


_maps: dict[tuple, dict] = {}


def by_number(names: list[str]) -> dict[int, memoryview]:
    """Content by number (the header's bucket) of all blobs in the files, mapped; a worker that serves many tasks does it once."""
    key = tuple(names)
    if key not in _maps:
        _maps.clear()
        _maps[key] = {number: view for number, _, view in opened(names)}
    return _maps[key]


def opened(names: list[str]) -> Iterator[tuple[int, int, memoryview]]:
    for name in names:
        local = SparkFiles.get(name.removeprefix("spark-file:")) if name.startswith("spark-file:") else name
        with open(local, "rb") as f:
            yield from blobs_in(memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)))


def texts_of(column: pa.Array) -> list[str]:
    """The column's texts, null as empty; bytes that aren't UTF-8 become replacement characters."""
    try:
        return [x or "" for x in column.to_pylist()]
    except UnicodeDecodeError:
        return [(x or b"").decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]
