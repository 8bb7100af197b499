"""Services that answer by key and year (S06, S07): a Python data source that asks, and landed answers as tables.

An answer is a list of items, or an envelope with ``data`` and, in its ``metaData``, a list of errors: an envelope with errors
has no items. Both forms give the same rows: key, year, n (place among the items), item (JSON) or error (JSON or text).

Defined cases: empty and null data have no rows; data that isn't a list is one item; what isn't JSON is one error row, as is a call that
failed (the other calls' rows stay); errors that aren't a list are one error.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from importlib import import_module

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

ROW = "key string, year int, n int, item string, error string"


def unpacked(body: str | bytes | None) -> Iterator[tuple[int | None, str | None, str | None]]:
    """n, item, error of one answer."""
    if isinstance(body, bytes):
        body = body.decode("utf-8", "replace")
    if not (body or "").strip():
        return
    try:
        told = json.loads(body)
    except ValueError:
        yield None, None, "no es JSON"
        return

    def text(x: object) -> str:
        return x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, separators=(",", ":"))

    if isinstance(told, dict) and ("data" in told or "metaData" in told):
        errors = (told.get("metaData") or {}).get("errors") or []
        if errors:
            yield from ((None, None, text(e)) for e in (errors if isinstance(errors, list) else [errors]))
            return
        told = told.get("data")
    items = told if isinstance(told, list) else [] if told is None else [told]
    yield from ((n, text(x), None) for n, x in enumerate(items))


class Call(InputPartition):
    def __init__(self, key: str, year: int):
        self.key, self.year = key, year


class ApiReader(DataSourceReader):
    def __init__(self, keys: Sequence[str], years: Sequence[int], transport: str):
        self.keys, self.years, self.transport = keys, years, transport

    def partitions(self) -> list[Call]:
        return [Call(k, y) for k in self.keys for y in self.years]

    def read(self, partition: Call) -> Iterator[tuple]:
        module, _, name = self.transport.partition(":")
        ask: Callable[[str, int], str | bytes | None] = getattr(import_module(module), name)
        try:
            body = ask(partition.key, partition.year)
        except Exception as e:  # a transport's errors have many types; the call's row tells which
            yield partition.key, partition.year, None, None, f"{type(e).__name__}: {e}"
            return
        for n, item, error in unpacked(body):
            yield partition.key, partition.year, n, item, error


class ApiSource(DataSource):
    """``spark.dataSource.register(ApiSource)``, then ``spark.read.format("office_api")`` with the options keys (a,b), years (first-last) and
    transport (module:function of key and year that returns the answer). One partition a key and year, so a lost one is asked again alone."""

    @classmethod
    def name(cls) -> str:
        return "office_api"

    def schema(self) -> str:
        return ROW

    def reader(self, schema: StructType) -> ApiReader:
        first, _, last = self.options["years"].partition("-")
        keys = [k.strip() for k in self.options["keys"].split(",") if k.strip()]
        return ApiReader(keys, range(int(first), int(last or first) + 1), self.options["transport"])


def landed(answers: DataFrame, body: str, *keys: str) -> DataFrame:
    """keys, n, item, error of landed answers, by built-in functions only."""
    text = F.trim(F.coalesce(F.col(body), F.lit("")))
    told = answers.select(*keys, text.alias("_text")).where("_text <> ''").withColumn("_json", F.try_parse_json("_text"))
    listed = F.col("_text").startswith("[")
    # an envelope is known by its keys, which may hold null
    envelope = ~listed & (F.try_variant_get("_json", "$.data", "variant").isNotNull() | F.try_variant_get("_json", "$.metaData", "variant").isNotNull())
    wrapped = F.when(envelope, F.get_json_object("_text", "$.metaData.errors"))
    data = F.when(envelope, F.get_json_object("_text", "$.data")).otherwise(F.col("_text"))

    def items(json_text):
        return F.when(json_text.startswith("["), F.from_json(json_text, "array<string>")).otherwise(F.array(json_text))

    errors = F.filter(items(F.coalesce(wrapped, F.lit("[]"))), lambda e: e.isNotNull())
    rows = F.when(F.col("_json").isNull(), F.array(F.struct(F.lit(None).cast("int").alias("n"), F.lit(None).cast("string").alias("item"), F.lit("no es JSON").alias("error"))))
    rows = rows.when(F.size(errors) > 0, F.transform(errors, lambda e: F.struct(F.lit(None).cast("int").alias("n"), F.lit(None).cast("string").alias("item"), e.alias("error"))))
    rows = rows.when(data.isNotNull(), F.transform(items(data), lambda x, n: F.struct(n.alias("n"), x.alias("item"), F.lit(None).cast("string").alias("error"))))
    return told.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.n", "_r.item", "_r.error")
