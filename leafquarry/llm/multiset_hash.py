"""Homomorphic fingerprints of documents (native DataFrame operations only).

A document is a multiset of units: its paragraphs (between line ends, empty ones too) and their sentences. Each unit hashes
to a wide vector of 80 digits of three bits, taken from its SHA-256 sum; a document's fingerprint is the sum of its
units' vectors, lane by lane modulo 2^14, and their number modulo 2^32. So the order of paragraphs doesn't matter, and a
fingerprint follows an edit by subtracting what went and adding what came (``plus``, ``minus``). Four lanes share a
long, 15 bits apart: the spare bit takes the carry, which the mask drops.

Digits have mean 3.5. What a lane differs from its mean behaves like a random walk over the units, so the squared
difference of two fingerprints estimates in how many units the documents differ: ``likeness`` is one minus that,
over both documents' own squares (0.11 of standard error between unrelated texts, less between similar ones). The modulus
disturbs it only where some 10^5 units differ, and never disturbs equality.

Defined cases: a null text counts as empty, and an empty text has one empty paragraph; equal texts have equal fingerprints;
null ids come last among documents, rows with equal ids by the MD5 sum of their texts; of rows that agree in both, each
is followed by the next and the last by another document; a table's only document is followed by itself; an empty table gives
an empty result; other columns are ignored; very long texts are read whole, in time linear in their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafquarry.llm.common import numbered, pick, written

#: Ends of sentences.
STOPS = "[.!?;|\n]"
#: Bits between lanes and in a lane; lanes in a long; longs of 15 hexadecimal digits in a unit's hash; shifts that bring each digit to a lane.
APART, BITS, LANES = 15, 14, 4
WORDS, SHIFTS = 4, (0, 3, 6, 9, 12)


def spaced(value: int) -> int:
    return sum(value << (APART * k) for k in range(LANES))


DIGIT, FULL, CARRY = spaced(7), spaced((1 << BITS) - 1), spaced(1 << BITS)
#: Copies of a row that one array may number.
BLOCK = 10_000


def units(text):
    """p and each paragraph, s and each sentence that isn't blank."""
    paragraphs = F.transform(F.split(text, "\n", -1), lambda p: F.concat(F.lit("p"), p))
    sentences = F.filter(F.split(text, STOPS, -1), lambda s: F.trim(s) != "")
    return F.concat(paragraphs, F.transform(sentences, lambda s: F.concat(F.lit("s"), s)))


def unit_vector(unit):
    """20 longs of four digits each."""
    starts = F.array(*[F.lit(1 + 15 * k) for k in range(WORDS)])
    longs = F.flatten(F.transform(F.array(F.sha2(unit, 256)), lambda x: F.transform(starts, lambda at: F.conv(x.substr(at, F.lit(15)), 16, 10).cast("bigint"))))
    return F.flatten(F.transform(longs, lambda w: F.array(*[F.shiftright(w, s).bitwiseAND(F.lit(DIGIT)) for s in SHIFTS])))


def nothing():
    return F.array_repeat(F.lit(0).cast("bigint"), WORDS * len(SHIFTS))


def plus(a, b):
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(FULL)))


def minus(a, b):
    return F.zip_with(a, b, lambda x, y: (x + F.lit(CARRY) - y).bitwiseAND(F.lit(FULL)))


def vector(text):
    """The sum over a text's units: struct n (their number), v (20 longs)."""
    summed = F.transform(F.array(units(text)), lambda u: F.struct(F.size(u).cast("bigint").alias("n"), F.aggregate(u, nothing(), lambda acc, x: plus(acc, unit_vector(x))).alias("v")))
    return F.element_at(summed, 1)


def written_out(f):
    """The fingerprint as text: eight hexadecimal digits of the number of units, 15 for each four lanes."""
    lanes = F.transform(f["v"], lambda x: F.lpad(F.lower(F.hex(x)), 15, "0"))
    return F.concat(F.lpad(F.lower(F.hex(f["n"].bitwiseAND(F.lit((1 << 32) - 1)))), 8, "0"), F.array_join(lanes, ""))


def lanes_of(v):
    low = F.lit((1 << BITS) - 1)
    return F.flatten(F.transform(v, lambda x: F.array(*[F.shiftright(x, APART * k).bitwiseAND(low) for k in range(LANES)])))


def off_mean(lane, n):
    """Twice what a sum of n digits differs from its mean, brought back from the modulus."""
    half = 1 << BITS
    return F.pmod(2 * lane - 7 * n + F.lit(half), F.lit(2 * half)) - F.lit(half)


def squares(f):
    return F.aggregate(lanes_of(f["v"]), F.lit(0).cast("bigint"), lambda acc, x: acc + off_mean(x, f["n"]) * off_mean(x, f["n"]))


def likeness(a, b, own_a, own_b):
    """0 to 1: the share of units that two fingerprints have in common; own_a and own_b are their ``squares``."""
    apart = F.aggregate(
        F.zip_with(lanes_of(a["v"]), lanes_of(b["v"]), lambda x, y: off_mean(x - y, a["n"] - b["n"])), F.lit(0).cast("bigint"), lambda acc, d: acc + d * d
    )
    both = own_a + own_b
    share = F.when(both > 0, 1 - apart.cast("double") / both.cast("double")).otherwise(F.lit(0.0))
    return F.when((a["n"] == b["n"]) & (a["v"] == b["v"]), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row of docs."""
    d = pick(docs, doc_id="doc_id", text="text")
    return d.select(F.col("doc_id").cast("bigint").alias("doc_id"), written_out(vector(F.coalesce("text", F.lit("")))).alias("fingerprint"))


def followed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct documents (named, id, key, text) and for each (named, id, key) the one before it (b_named, b_id, b_key, b_n its
    length, b_copies its number of rows), in the order of ids. Documents are ranked by thin rows alone."""
    d = pick(docs, doc_id="doc_id", text="text")
    d = d.select(
        F.col("doc_id").isNotNull().alias("named"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("key", F.unhex(F.md5("text")))
    thin = d.groupBy("named", "id", "key").agg(F.count(F.lit(1)).alias("copies"), F.max(F.length("text")).cast("bigint").alias("n"))
    thin = numbered(thin, [F.col("named").desc(), "id", "key"], "place")
    total, most = thin.agg(F.count(F.lit(1)), F.max("copies")).first()
    if most and most > 1:
        d = d.groupBy("named", "id", "key").agg(F.min("text").alias("text"))
    before = thin.select(
        F.when(F.col("place") == total - 1, 0).otherwise(F.col("place") + 1).alias("place"), *[F.col(c).alias(f"b_{c}") for c in ("named", "id", "key", "n", "copies")]
    )
    return d, written(thin.select("place", "named", "id", "key").join(before, "place").drop("place"), "order", thin=True)


def edited(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A document's vector is summed where it is read, and travels with the text in one shuffle; to the document before go
    the vector and as much of the text as that needs. The edited text's fingerprint comes from the document's own by
    taking out the paragraphs from the cut on and adding those that the edit put there."""
    keys = ["named", "id", "key"]
    d, before = followed(docs)
    own = d.withColumn("f", vector(F.col("text"))).repartition(*keys)
    lead = own.join(before, keys).select(
        *[F.col(f"b_{c}").alias(c) for c in keys],
        F.col("b_copies").alias("copies"),
        F.col("text").substr(F.lit(1), F.floor(F.col("b_n") / 4).cast("int")).alias("lead"),
        F.col("f").alias("f_next"),
    )
    met = own.join(lead, keys).withColumn("n", F.length("text")).withColumn("cut", F.floor(F.col("n") / 4).cast("int"))
    self_next = F.struct((F.col("copies") - 1).alias("rows"), F.col("text").substr(F.lit(1), F.col("cut")).alias("lead"), F.col("f").alias("f_next"))
    other = F.struct(F.lit(1).cast("bigint").alias("rows"), "lead", "f_next")
    each = met.select(
        "named", "id", "text", "f", "n", "cut", F.explode(F.when(F.col("copies") > 1, F.array(other, self_next)).otherwise(F.array(other))).alias("e")
    ).select("named", "id", "text", "f", "n", F.col("e.rows").alias("rows"), F.col("e.lead").alias("lead"), F.col("e.f_next").alias("f_next"), F.col("text").substr(F.lit(1), F.col("n") - F.col("cut")).alias("head"))
    start = F.length("head") - F.length(F.substring_index("head", "\n", -1)) + 1
    each = each.withColumns(
        {
            "gone": vector(F.col("text").substr(start, F.col("n") - start + 1)),
            "come": vector(F.concat(F.substring_index("head", "\n", -1), "lead")),
            "sha": F.sha2(F.concat("head", "lead"), 256),
        }
    ).drop("text", "head", "lead")
    each = each.withColumn("f_edited", F.struct((F.col("f.n") - F.col("gone.n") + F.col("come.n")).alias("n"), plus(minus(F.col("f.v"), F.col("gone.v")), F.col("come.v")).alias("v")))
    each = each.withColumns({"own": squares(F.col("f")), "own_edited": squares(F.col("f_edited")), "own_next": squares(F.col("f_next"))})
    found = each.select(
        F.when(F.col("named"), F.col("id")).alias("doc_id"),
        F.col("n").cast("bigint").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        written_out(F.col("f")).alias("fingerprint"),
        written_out(F.col("f_edited")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("f_edited"), F.col("own"), F.col("own_edited")).alias("near_edited"),
        likeness(F.col("f"), F.col("f_next"), F.col("own"), F.col("own_next")).alias("near_next"),
        "rows",
    )
    blocks = found.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(rows - 1) div {BLOCK}"))))
    rows = blocks.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(BLOCK), F.col("rows") - F.col("block") * BLOCK))))
    return rows.drop("rows", "block", "copy")


def op12_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Lane j is the digit that shift j // 4 % 5 brings to place j % 4 of long j // 20 of a unit's hash.
OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
o AS (
  SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS nxt
  FROM d WINDOW w AS (ORDER BY doc_id NULLS LAST, md5(text) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (
  SELECT row_number() OVER () AS row, *, substr(text, 1, n - n // 4) || substr(nxt, 1, n // 4) AS edited FROM o),
texts AS (
  SELECT x, row_number() OVER () AS t FROM (SELECT DISTINCT unnest([text, edited, nxt]) AS x FROM e)),
units AS (
  SELECT t, 'p' || unnest(string_split(x, chr(10))) AS u FROM texts
  UNION ALL
  SELECT t, 's' || u FROM (SELECT t, unnest(string_split_regex(x, '[.!?;|\n]')) AS u FROM texts) WHERE trim(u, ' ') <> ''),
longs AS (
  SELECT t, list_transform(range(4), lambda w: ('0x' || substr(sha256(u), (15 * w + 1)::INT, 15))::BIGINT) AS h FROM units),
digits AS (
  SELECT t, j, h[j // 20 + 1] >> (3 * (j // 4 % 5) + 15 * (j % 4))::INT & 7 AS digit FROM longs CROSS JOIN range(80) r(j)),
lanes AS (
  SELECT t, j, count(*) AS n, sum(digit) % 16384 AS v FROM digits GROUP BY t, j),
prints AS (
  SELECT t, any_value(n) AS n, list(v::BIGINT ORDER BY j) AS v FROM lanes GROUP BY t),
made AS (
  SELECT x, n, v, lpad(lower(to_hex((n % 4294967296)::BIGINT)), 8, '0')
         || list_aggregate([lpad(lower(to_hex(v[4 * i + 1] + (v[4 * i + 2] << 15) + (v[4 * i + 3] << 30) + (v[4 * i + 4] << 45))), 15, '0') FOR i IN range(20)], 'string_agg', '') AS f
  FROM prints JOIN texts USING (t)),
three AS (
  SELECT e.row, e.doc_id, e.n AS n_chars, sha256(e.edited) AS edited_sha256, a.f AS fa, b.f AS fb, c.f AS fc,
         a.n AS na, b.n AS nb, c.n AS nc, a.v AS va, b.v AS vb, c.v AS vc
  FROM e JOIN made a ON a.x = e.text JOIN made b ON b.x = e.edited JOIN made c ON c.x = e.nxt),
squares AS (
  SELECT *,
    list_sum([(((2 * x - 7 * na + 16384) % 32768 + 32768) % 32768 - 16384) ** 2 FOR x IN va]) AS qa,
    list_sum([(((2 * x - 7 * nb + 16384) % 32768 + 32768) % 32768 - 16384) ** 2 FOR x IN vb]) AS qb,
    list_sum([(((2 * x - 7 * nc + 16384) % 32768 + 32768) % 32768 - 16384) ** 2 FOR x IN vc]) AS qc,
    list_sum([(((2 * (va[i] - vb[i]) - 7 * (na - nb) + 16384) % 32768 + 32768) % 32768 - 16384) ** 2 FOR i IN range(1, 81)]) AS qab,
    list_sum([(((2 * (va[i] - vc[i]) - 7 * (na - nc) + 16384) % 32768 + 32768) % 32768 - 16384) ** 2 FOR i IN range(1, 81)]) AS qac
  FROM three)
SELECT doc_id, n_chars::BIGINT AS n_chars, edited_sha256, fa AS fingerprint, fb AS edited_fingerprint,
       CASE WHEN fa = fb THEN 1.0::DOUBLE WHEN qa + qb > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - qab::DOUBLE / (qa + qb)::DOUBLE)) ELSE 0.0::DOUBLE END AS near_edited,
       CASE WHEN fa = fc THEN 1.0::DOUBLE WHEN qa + qc > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - qac::DOUBLE / (qa + qc)::DOUBLE)) ELSE 0.0::DOUBLE END AS near_next
FROM squares
"""
