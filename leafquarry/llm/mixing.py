"""Mixing sources to target weights by nested hash thresholds (native DataFrame operations only).

Each document gets a 60-bit hash of its id and text, repeated rows one each by their number among the equal ones. Sizes are summed by source and hash bucket; a budget's
boundary bucket is refined on the next bits, and twice is enough to leave some hundred hashes for each
source even of 10^10 documents. A document is then taken by comparing its hash with its source's threshold: documents are
never sorted. A source whose budget exceeds its size is taken whole once or twice and the rest by threshold,
so the thresholds of its passes are nested.

Defined cases: a null text has size 0 and is never taken; null is a source of its own, the last; of rows
that agree in id, text and source as many are taken as their hashes ask, whichever those are; a source without words has target 0; an
empty table gives an empty result. Sources are assumed to be few enough for one task to rank (10^7 or so).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafquarry.llm.common import met, numbered, pick, unmet, written

WEIGHTS = (1, 2, 3)
MOST = 3
#: Bits of the three levels of buckets; they add up to the hash's 60.
LEVELS = (12, 12, 36)
#: Equal rows that one array may number; sources whose plan is broadcast whole.
BLOCK, FEW = 10_000, 50_000


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def spread_hash(doc_id, text):
    """The first 60 bits of md5(id:text)."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")


def nth_hash(h, n):
    """The hash of the n-th of equal rows, from 0: that of the row for the first, else from both."""
    return F.when(n == 0, h).otherwise(F.conv(F.substring(F.md5(F.concat(h.cast("string"), F.lit(":"), n.cast("string"))), 1, 15), 16, 10).cast("bigint"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, h: one row per row of docs. Equal rows are counted before they are numbered, so many of them meet nowhere."""
    d = pick(docs, doc_id="doc_id", text="text", source="source")
    thin = d.select("doc_id", "source", n_words(F.col("text")).alias("size"), spread_hash(F.col("doc_id"), F.col("text")).alias("h"))
    counted = thin.groupBy("doc_id", "source", "size", "h").agg(F.count(F.lit(1)).alias("rows"))
    blocks = counted.withColumn("first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1, F.lit(BLOCK).cast("bigint"))))
    each = blocks.withColumn("nth", F.explode(F.sequence(F.col("first"), F.least(F.col("rows"), F.col("first") + BLOCK) - 1)))
    return each.select("doc_id", "source", "size", nth_hash(F.col("h"), F.col("nth")).alias("h"))


def hashed(placed: DataFrame, doc_id, text, source) -> DataFrame:
    """placed with each row's hash in h. Only rows that others equal are numbered, in ranges of one order over all of them."""
    h = spread_hash(doc_id, text)
    keyed = placed.withColumns({"h": h, "same": F.xxhash64(doc_id, h, source)})
    repeated = written(keyed.groupBy("same").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "mix-repeated", thin=True)
    if repeated.isEmpty():
        return keyed.drop("same")
    rows = numbered(met(keyed.withColumn("any", F.monotonically_increasing_id()), repeated, ["same"], "rows"), ["same", "any"], "nth")
    starts = written(rows.groupBy("same").agg(F.min("nth").alias("start"), F.count(F.lit(1)).alias("rows")), "mix-repeated", thin=True)
    each = met(rows.drop("rows"), starts, ["same"], "rows").withColumn("h", nth_hash(F.col("h"), F.col("nth") - F.col("start")))
    return unmet(keyed, repeated, ["same"], "rows").drop("same").unionByName(each.drop("same", "any", "nth", "start", "rows"))


def planned(rows: DataFrame, plan: DataFrame, source) -> DataFrame:
    """rows with their source's row of the plan. Up to FEW sources are broadcast; of more, those with many rows (``met``)."""
    plan = plan.withColumnRenamed("source", "planned_source")
    if plan.count() <= FEW:
        return rows.join(F.broadcast(plan), source.eqNullSafe(F.col("planned_source"))).drop("planned_source", "rows")
    key = lambda s: F.coalesce(F.concat(F.lit("s"), s), F.lit("n"))
    return met(rows.withColumn("planned_key", key(source)), plan.withColumn("planned_key", key(F.col("planned_source"))), ["planned_key"], "rows").drop(
        "planned_key", "planned_source", "rows"
    )


def targets(thin: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, rows, target: weights repeat over the sources by code point, null last; a target stops
    at ``most`` times its source's size and the excess is reshared by weight.

    Sources are filled in the order of the level at which they stop: a source stops if its limit lies below
    the level that is left for it and all later ones."""
    by_source = thin.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    named = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    w = by_source.withColumn("place", F.row_number().over(named)).withColumn("weight", weight)
    w = w.withColumn("limit", F.col("source_size").cast("double") * most)
    everything = Window.partitionBy()
    stop = Window.orderBy(F.col("limit") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumns(
        {
            "level": (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(stop), F.lit(0.0)))
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(stop), F.lit(0.0))),
        }
    )
    open_ = F.col("limit") > F.col("weight") * F.col("level")
    w = w.withColumn("final", F.min_by(F.when(open_, F.col("level")), F.when(open_, F.col("limit") / F.col("weight"))).over(everything))
    target = F.least(F.col("limit"), F.coalesce(F.col("weight") * F.col("final"), F.col("limit")))
    return w.select("source", "source_size", "rows", target.alias("target"))


def _boundary(thin: DataFrame, plan: DataFrame, level: int) -> DataFrame:
    """plan with ``low`` (first hash of the boundary bucket at this level) and ``before`` (size below it)."""
    shift = sum(LEVELS[level + 1 :])
    bucket = F.shiftright("h", shift)
    rows = thin
    if level:
        up = sum(LEVELS[level:])
        edge = plan.where("rest > 0").select(F.col("source").alias("s"), F.shiftright("low", up).alias("edge"))
        rows = thin.join(edge, thin["source"].eqNullSafe(edge["s"]) & (F.shiftright("h", up) == F.col("edge")), "left_semi")
    hist = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n")).where("n > 0")
    back = plan.select(F.col("source").alias("s"), "rest", *(["before"] if level else []))
    hist = hist.join(back, hist["source"].eqNullSafe(back["s"])).drop("s")
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    base = F.col("before") if level else F.lit(0)
    hist = hist.withColumn("upto", upto + base).where("upto > rest")
    found = hist.groupBy("source").agg(F.min(F.struct("bucket", "upto", "n")).alias("f"))
    found = found.select(
        F.col("source").alias("s"), F.shiftleft("f.bucket", shift).alias("low_"), (F.col("f.upto") - F.col("f.n")).alias("before_"), F.col("f.n").alias("n_")
    )
    kept = plan.drop("low", "before", "n")
    return (
        kept.join(found, kept["source"].eqNullSafe(found["s"]), "left")
        .drop("s")
        .withColumnsRenamed({"low_": "low", "before_": "before", "n_": "n"})
    )


def thresholds(thin: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, rows, target, passes, threshold: a document is taken passes times, and once more if its
    hash is below the threshold. One small row a source, written to the shared folder."""
    plan = targets(thin, weights, most)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0)
    plan = plan.withColumn("passes", whole.cast("int"))
    plan = plan.withColumn("rest", F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0)))
    plan = plan.withColumn("rest", F.when(F.col("passes") < most, F.col("rest")).otherwise(F.lit(0.0)))
    plan = written(plan, "mix-plan")
    for level in range(len(LEVELS)):
        plan = written(_boundary(thin, plan, level), "mix-plan")
    nearer = F.col("before") + F.col("n") - F.col("rest") <= F.col("rest") - F.col("before")
    threshold = F.when(F.col("rest") > 0, F.coalesce(F.col("low") + F.when(nearer, 1).otherwise(0), F.lit(0))).otherwise(0)
    return written(plan.select("source", "source_size", "rows", "target", "passes", threshold.cast("bigint").alias("threshold")), "mix-plan")


def copies_of(h):
    return F.col("passes") + F.when(h < F.col("threshold"), 1).otherwise(0)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mixed table: each row of docs as often as the mix takes it, with all its columns."""
    plan = thresholds(written(sized(docs), "mix-sizes"), weights, most)
    names = docs.columns
    placed = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text, source = (F.col(f"c{names.index(n)}") for n in ("doc_id", "text", "source"))
    joined = planned(hashed(placed, doc_id, text, source), plan, source)
    times = F.coalesce(F.when(n_words(text) > 0, copies_of(F.col("h"))), F.lit(0)).cast("int")
    repeated = joined.withColumn("times", times).where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return repeated.select(*[f"c{i}" for i in range(len(names))]).toDF(*names)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    thin = written(sized(docs), "mix-sizes")
    return planned(thin, thresholds(thin), F.col("source")).select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * copies_of(F.col("h"))).cast("bigint").alias("taken")
    )


OP2_SQL = r"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h,
         row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) - 1 AS nth
  FROM documents),
thin AS (
  SELECT doc_id, source, size, CASE WHEN nth = 0 THEN h ELSE ('0x' || substr(md5(h || ':' || nth), 1, 15))::BIGINT END AS h FROM rows_),
src AS (
  SELECT source, sum(size)::DOUBLE AS s, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
  FROM thin GROUP BY source),
fill AS (
  SELECT 0 AS step, source, s, w, false AS capped, (SELECT sum(s) FROM src) * w / (SELECT sum(w) FROM src) AS t FROM src
  UNION ALL
  SELECT step + 1, source, s, w, capped OR t > 3 * s,
         CASE WHEN capped OR t > 3 * s THEN 3 * s
              ELSE (sum(s) OVER () - sum(CASE WHEN capped OR t > 3 * s THEN 3 * s ELSE 0 END) OVER ()) * w
                   / nullif(sum(CASE WHEN capped OR t > 3 * s THEN 0 ELSE w END) OVER (), 0) END
  FROM fill WHERE step < 60),
goal AS (
  SELECT source, s, t, CASE WHEN s > 0 THEN least(floor(t / s), 3) ELSE 0 END AS passes FROM fill WHERE step = 60),
hashes AS (
  SELECT thin.source, h, sum(size) AS n FROM thin GROUP BY ALL),
cum AS (
  SELECT h.source, h.h, h.n, sum(h.n) OVER (PARTITION BY h.source ORDER BY h.h) AS upto FROM hashes h WHERE h.n > 0),
cut AS (
  SELECT g.source, min(CASE WHEN c.upto > g.t - g.passes * g.s THEN
           c.h + CASE WHEN c.upto - (g.t - g.passes * g.s) <= (g.t - g.passes * g.s) - (c.upto - c.n) THEN 1 ELSE 0 END END) AS thr
  FROM goal g JOIN cum c ON g.source IS NOT DISTINCT FROM c.source
  WHERE g.passes < 3 AND g.t - g.passes * g.s > 0 GROUP BY g.source)
SELECT t.doc_id, t.size::BIGINT AS size, g.s::BIGINT AS source_size, round(g.t, 6) AS target,
       (t.size * (g.passes + CASE WHEN t.h < coalesce(c.thr, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM thin t JOIN goal g ON t.source IS NOT DISTINCT FROM g.source
LEFT JOIN cut c ON t.source IS NOT DISTINCT FROM c.source
"""
