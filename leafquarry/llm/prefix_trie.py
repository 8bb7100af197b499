"""The trie of conversations' prefixes, by the Cartesian tree over the sorted conversations' common prefixes.

Conversations are sorted by their turns; the common prefix of each with the one before it makes an array, and the nodes of
the trie that branch or end are the intervals between nearest smaller values of that array. Nearest smaller values are
found in blocks: each block by a stack of its own, and what looks beyond its block by the blocks' minima, which
name the one block that has the answer. Equal values in one interval are one node; the nodes in between, which have the
same members as the next branching below, are added by depth; counts and sums of an interval are differences of running
sums over the sorted conversations, smallest members come from minima of blocks.

No step needs a whole conversation, a whole group of equal ones or a node's whole subtree in one place: turns are numbered by ranges,
sequences are sorted by ranks of pieces of at most ``PIECE`` turns, blocks hold about the square root of the number
of conversations (and so does what the driver and every task know of blocks: three numbers each). Only the hash over the ids that end
at a node must read them in one task, as a stream.

Defined cases: a null role or text is empty; turns with null come first, turns that agree in conversation and turn are
ordered by the MD5 sum of role and text, equal ones stay as many as they are; rows without a conv_id belong to no
conversation; a conversation without turns ends at the root; an empty table has no nodes; other columns are ignored. For negative
ids the remainder has the sign of the id.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafquarry.llm.common import met, numbered, pick, written
from leafquarry.llm.mixing import n_words

#: Turns in a piece of a sequence; depths that one array may list; conversations in a block at least.
PIECE, STEP, BLOCK = 512, 1000, 1024
SHARED, PREFIXES = 20, 4
NODES = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def own_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (over all turns in order), sym (what a turn says, 16 bytes), words."""
    d = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text").where("conv_id IS NOT NULL")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    thin = d.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", said.alias("sym"), n_words(text).alias("words"))
    return numbered(thin, ["conv_id", F.col("turn").asc_nulls_first(), "sym"], "place").drop("turn")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id, n: their turns) and their turns (conv_id, pos from 1, sym, words) after the first h turns of each were replaced
    by those of the conversation that it shares them with."""
    lengths = own.groupBy("conv_id").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("own"))
    lengths = written(
        lengths.withColumns({"base": F.col("conv_id") - F.col("conv_id") % SHARED, "h": F.crc32(F.col("conv_id").cast("string")) % PREFIXES}), "conversations", thin=True
    )
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"), F.col("start").alias("base_start"))
    plan = lengths.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("base_own", F.lit(0))))
    plan = written(plan.withColumn("n", F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "conversations", thin=True)
    placed = met(own, plan.select("conv_id", "start", "own", "h", "head"), ["conv_id"], "own").withColumn("p", F.col("place") - F.col("start") + 1)
    tails = placed.where("p > h").select("conv_id", (F.col("p") - F.col("h") + F.col("head")).alias("pos"), "sym", "words")
    first = placed.where(f"p < {PREFIXES}").select(F.col("conv_id").alias("base"), F.col("p").alias("pos"), "sym", "words")
    heads = first.join(plan.select("conv_id", "base", "h"), "base").where("pos <= h").select("conv_id", "pos", "sym", "words")
    return plan.select("conv_id", "n"), written(tails.unionByName(heads), "turns")


def sequences(turns: DataFrame, longest: int, piece: int) -> DataFrame:
    """conv_id, key: arrays that sort as the sequences of turns do. A sequence longer than a piece becomes that of its pieces' ranks
    among all distinct pieces, and so on until one piece is left."""

    def gathered(rows: DataFrame, at, name: str) -> DataFrame:
        listed = F.sort_array(F.collect_list(F.struct("at", name)))
        return rows.withColumns({"at": at, "part": F.floor(at / piece)}).groupBy("conv_id", "part").agg(F.transform(listed, lambda x: x[name]).alias("key"))

    parts = gathered(turns, F.col("pos") - 1, "sym")
    while longest > piece:
        parts = written(parts, "pieces", thin=True)
        ranks = written(numbered(parts.groupBy("key").agg(F.count(F.lit(1)).alias("weight")), ["key"], "rank"), "ranks", thin=True)
        parts = gathered(met(parts, ranks, ["key"], "weight").select("conv_id", "part", "rank"), F.col("part"), "rank")
        longest = -(-longest // piece)
    return parts.select("conv_id", "key")


def nearest_smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value the places of the nearest smaller ones before and after it; -1 and the number of values where there is none."""
    n = len(values)
    left, right, stack = np.full(n, -1, np.int64), np.full(n, n, np.int64), []
    for k, v in enumerate(values.tolist()):
        while stack and stack[-1][1] > v:
            right[stack.pop()[0]] = k
        # equal values have the same nearest smaller one on the left
        left[k] = -1 if not stack else stack[-1][0] if stack[-1][1] < v else left[stack[-1][0]]
        stack.append((k, v))
    return left, right


class Minima:
    """Range minima of an array by doubling."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 * (half := 1 << (len(self.rows) - 1)) <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The minima from start to end, both included."""
        level = np.frexp((end - start + 1).astype(float))[1] - 1
        out = np.empty(len(start), self.rows[0].dtype)
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(self.rows[k][start[at]], self.rows[k][end[at] - (1 << k) + 1])
        return out


class Blocks:
    """What every task knows: of each block the smallest common prefix, the first one and the smallest conv_id."""

    def __init__(self, least: np.ndarray, first: np.ndarray, low: np.ndarray, size: int, total: int):
        self.least, self.first, self.low, self.size, self.total = least, first, low, size, total
        self.left, self.right = nearest_smaller(least)

    def before(self, block: int, value: int) -> int:
        """The nearest block before this one with a value below the given one; there always is one, as the first value is -1."""
        block -= 1
        while self.least[block] >= value:
            block = int(self.left[block])
        return block

    def after(self, block: int, value: int) -> int:
        """The nearest block after this one with a value below the given one, or the number of blocks."""
        block += 1
        while block < len(self.least) and self.least[block] >= value:
            block = int(self.right[block])
        return block


def common_prefixes(ordered: DataFrame, turns: DataFrame) -> DataFrame:
    """i, conv_id, n, lcp: of each conversation the number of turns that it begins with as the one before it does; -1 for the first."""
    before = turns.select((F.col("i") + 1).alias("i"), "pos", F.col("sym").alias("before"))
    differ = turns.join(before, ["i", "pos"]).where("sym <> before").groupBy("i").agg((F.min("pos") - 1).alias("agree"))
    last = ordered.select((F.col("i") + 1).alias("i"), F.col("n").alias("n_before"))
    found = ordered.join(last, "i", "left").join(differ, "i", "left")
    return found.select("i", "conv_id", "n", F.when(F.col("i") == 0, -1).otherwise(F.coalesce("agree", F.least("n", "n_before"))).alias("lcp"))


def with_intervals(elements: DataFrame, blocks: Blocks) -> DataFrame:
    """elements (i, conv_id, n, lcp, block) with nxt (the next one's lcp), left and right (places of the nearest smaller lcps), pre and suf (smallest conv_id
    of the block up to and from here), low (the same over what of the interval lies in the block)."""
    size, count, total = blocks.size, len(blocks.least), blocks.total

    def questions(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        values, block = rows["lcp"].to_numpy(), int(rows["block"].iloc[0])
        left, right = nearest_smaller(values)
        asked = [(block, 0, blocks.before(block, v), v) for v in np.unique(values[left < 0]).tolist() if v >= 0]
        asked += [(block, 1, t, v) for v in np.unique(values[right == len(values)]).tolist() if (t := blocks.after(block, v)) < count]
        return pd.DataFrame(asked, columns=["block", "side", "target", "lcp"])

    def answers(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        values, first = rows["lcp"].to_numpy(), int(rows["i"].iloc[0]) if len(rows) else 0
        ends = (np.minimum.accumulate(values[::-1]), np.minimum.accumulate(values))
        found = []
        for side, target, v in zip(asked["side"].tolist(), asked["target"].tolist(), asked["lcp"].tolist(), strict=True):
            k = int(np.searchsorted(-ends[side], -v, side="right"))  # the first from that side that is smaller
            found.append((side, target, v, first + (len(values) - 1 - k if side == 0 else k)))
        return pd.DataFrame(found, columns=["side", "target", "lcp", "found"])

    def resolved(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        values, low = rows["lcp"].to_numpy(), rows["conv_id"].to_numpy()
        first, block = int(rows["i"].iloc[0]), int(rows["block"].iloc[0])
        left, right = nearest_smaller(values)
        lows = Minima(low).of(np.maximum(left, 0), np.minimum(right, len(values)) - 1)
        by = {(s, v): f for s, v, f in zip(known["side"].tolist(), known["lcp"].tolist(), known["found"].tolist(), strict=True)}
        lefts = [first + k if k >= 0 else by.get((0, v), -1) for k, v in zip(left.tolist(), values.tolist(), strict=True)]
        rights = [first + k if k < len(values) else by.get((1, v), total) for k, v in zip(right.tolist(), values.tolist(), strict=True)]
        after = blocks.first[block + 1] if block + 1 < count else -1
        return pd.DataFrame(
            {
                "i": rows["i"], "conv_id": low, "n": rows["n"], "lcp": values, "block": block, "nxt": np.append(values[1:], after), "left": lefts, "right": rights,
                "pre": np.minimum.accumulate(low), "suf": np.minimum.accumulate(low[::-1])[::-1], "low": lows,
            }
        )

    thin = elements.select("i", "lcp", "block")
    asked = written(thin.groupBy("block").applyInPandas(questions, "block bigint, side int, target bigint, lcp bigint"), "questions", thin=True)
    where = asked.select("side", "target", "lcp").distinct()
    found = where.groupBy("target").cogroup(thin.groupBy("block")).applyInPandas(answers, "side int, target bigint, lcp bigint, found bigint")
    known = asked.join(found, ["side", "target", "lcp"]).select("block", "side", "lcp", "found")
    columns = ("i", "conv_id", "n", "lcp", "block", "nxt", "left", "right", "pre", "suf", "low")
    return elements.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(resolved, ", ".join(f"{c} bigint" for c in columns))


def running(rows: DataFrame, value: str, name: str) -> DataFrame:
    """rows (i, block, ...) with the sum of value up to and with i: within blocks, and over the blocks before."""
    sums = rows.groupBy("block").agg(F.sum(value).alias("s"))
    before = sums.select("block", F.coalesce(F.sum("s").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s_before"))
    inside = F.sum(value).over(Window.partitionBy("block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("inside", inside).join(F.broadcast(before), "block").withColumn(name, F.col("inside") + F.col("s_before")).drop("inside", "s_before")


def branching(places: DataFrame, blocks: Blocks) -> DataFrame:
    """The nodes where members end or part, but for the root: l, r (first and last member in order), v (depth), u (depth of the next such node above), l_up (its
    first member), conv_id, leaves."""
    lows, size = blocks.low, blocks.size

    @F.pandas_udf("bigint")
    def between(a: pd.Series, b: pd.Series) -> pd.Series:
        """The smallest conv_id in the blocks strictly between two."""
        start, end = a.to_numpy() + 1, b.to_numpy() - 1
        out = np.full(len(start), np.iinfo(np.int64).max)
        some = start <= end
        if some.any():
            out[some] = Minima(lows).of(start[some], end[some])
        return pd.Series(out)

    inner = places.where("lcp > 0").groupBy(F.col("left").alias("l"), (F.col("right") - 1).alias("r"), F.col("lcp").alias("v")).agg(F.min("low").alias("low"))
    at_l = places.select(F.col("i").alias("l"), F.col("lcp").alias("lcp_l"), F.col("left").alias("left_l"), "suf", (F.col("upto") - F.col("leaf")).alias("leaves_before"))
    at_r = places.select(F.col("i").alias("r"), F.col("nxt").alias("nxt_r"), "pre", "upto")
    block_l, block_r = F.floor(F.col("l") / size), F.floor(F.col("r") / size)
    low = F.when(block_l == block_r, F.col("low")).otherwise(F.least("suf", "pre", between(block_l, block_r)))
    inner = inner.join(at_l, "l").join(at_r, "r").select(
        "l", "r", "v", F.greatest("lcp_l", "nxt_r").alias("u"), F.when(F.col("lcp_l") >= F.col("nxt_r"), F.col("left_l")).otherwise(F.col("l")).alias("l_up"),
        low.alias("conv_id"), (F.col("upto") - F.col("leaves_before")).alias("leaves"),
    )
    single = places.where("n > 0 AND n > lcp AND n > nxt").select(
        F.col("i").alias("l"), F.col("i").alias("r"), F.col("n").alias("v"), F.greatest("lcp", "nxt").alias("u"),
        F.when(F.col("lcp") >= F.col("nxt"), F.col("left")).otherwise(F.col("i")).alias("l_up"), "conv_id", F.lit(1).cast("bigint").alias("leaves"),
    )
    both = inner.unionByName(single)
    return both.withColumns({"l_up": F.when(F.col("u") > 0, F.col("l_up")).otherwise(0), "u": F.greatest("u", F.lit(0))})


def ends(places: DataFrame) -> DataFrame:
    """l, v, ends: of each node at which members end, the SHA-256 sum of their ids. Ids are joined by block, then hashed as a stream."""

    def run(batches):
        now, total = None, None
        for batch in batches:
            out = []
            for l, v, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (l, v) == now:
                    total.update(b"," + text.encode())
                else:
                    if now:
                        out.append((*now, total.hexdigest()))
                    now, total = (l, v), hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(("l", "v", "ends"), x, strict=True)) for x in out], pa.schema([("l", pa.int64()), ("v", pa.int64()), ("ends", pa.string())]))
        if now:
            yield pa.RecordBatch.from_pydict({"l": [now[0]], "v": [now[1]], "ends": [total.hexdigest()]})

    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    keyed = places.select(F.when(F.col("lcp") == F.col("n"), F.col("left")).otherwise(F.col("i")).alias("l"), F.col("n").alias("v"), "block", "conv_id")
    texts = keyed.groupBy("l", "v", "block").agg(ids.alias("ids"))
    dealt = texts.repartition("l", "v").sortWithinPartitions("l", "v", "block").select("l", "v", "ids")
    return dealt.mapInArrow(run, "l bigint, v bigint, ends string")


def expanded(nodes: DataFrame) -> DataFrame:
    """nodes with depth d: one row for each depth from above u to v. Long stretches are spread before their depths are listed."""
    pieces = nodes.withColumn("from", F.explode(F.sequence(F.col("u") + 1, F.col("v"), F.lit(STEP).cast("bigint")))).repartition("l", "from")
    return pieces.withColumn("d", F.explode(F.sequence(F.col("from"), F.least(F.col("v"), F.col("from") + (STEP - 1))))).drop("from")


def trie(conversations: DataFrame, piece: int = PIECE, block: int = BLOCK) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    convs, turns = rebuilt(own_turns(conversations))
    total, longest = convs.agg(F.count(F.lit(1)), F.max("n")).first()
    if not total:
        return spark.createDataFrame([], NODES)
    size = max(block, math.isqrt(total))

    keys = sequences(turns, longest, piece)
    ordered = convs.join(keys, "conv_id", "left")
    ordered = ordered.withColumn("key", F.coalesce("key", F.array().cast(ordered.schema["key"].dataType)))
    ordered = written(numbered(ordered, ["key", "conv_id"], "i").select("i", "conv_id", "n"), "ordered", thin=True)
    turns = written(met(turns, ordered, ["conv_id"], "n").select("i", "pos", "sym", "words"), "turns")

    elements = written(common_prefixes(ordered, turns).withColumn("block", F.floor(F.col("i") / size)), "elements", thin=True)
    known = elements.groupBy("block").agg(F.min("lcp").alias("least"), F.min_by("lcp", "i").alias("first"), F.min("conv_id").alias("low")).orderBy("block").collect()
    blocks = Blocks(*(np.array([r[c] for r in known], np.int64) for c in ("least", "first", "low")), size, total)
    places = with_intervals(elements, blocks).withColumn("leaf", (F.col("nxt") < F.col("n")).cast("bigint"))
    places = written(running(written(places, "places", thin=True), "leaf", "upto"), "places", thin=True)

    nodes = written(branching(places, blocks), "branching", thin=True)
    kids = nodes.groupBy(F.col("l_up").alias("l"), F.col("u").alias("v")).agg(F.count(F.lit(1)).alias("children"))
    root = spark.createDataFrame([(0, total - 1, 0, int(blocks.low.min()))], "l bigint, r bigint, v bigint, conv_id bigint")
    root = root.crossJoin(F.broadcast(places.agg(F.sum("leaf").alias("leaves")))).withColumns({"u": F.lit(-1).cast("bigint"), "l_up": F.lit(None).cast("bigint")})
    nodes = nodes.unionByName(root).join(kids, ["l", "v"], "left").join(ends(places), ["l", "v"], "left")
    nodes = written(nodes.withColumn("children", F.coalesce("children", F.lit(0))), "branching", thin=True)
    above = nodes.where("children > 0").select(F.col("l").alias("l_up"), F.col("v").alias("u"), F.col("conv_id").alias("up"), F.col("children").alias("weight"))
    below = met(nodes.where("l_up IS NOT NULL"), above, ["l_up", "u"], "weight").drop("weight")
    nodes = written(below.unionByName(nodes.where("l_up IS NULL").withColumn("up", F.lit(None).cast("bigint"))), "branching", thin=True)

    # what each node saves, in the order of the trie: by conversation and depth
    said = turns.select(F.col("i").alias("l"), F.col("pos").alias("d"), "words")
    saved = expanded(nodes.select("l", "r", "u", "v")).join(said, ["l", "d"], "left")
    saved = saved.select("l", "d", ((F.col("r") - F.col("l")) * F.coalesce("words", F.lit(0))).alias("own"), F.floor(F.col("d") / STEP).alias("stretch"))
    saved = written(saved, "saved", thin=True)
    stretches = saved.groupBy("l", "stretch").agg(F.sum("own").alias("s"))
    deeper = Window.partitionBy("l").orderBy(F.col("stretch").desc()).rowsBetween(Window.unboundedPreceding, -1)
    stretches = written(stretches.select("l", "stretch", "s", F.coalesce(F.sum("s").over(deeper), F.lit(0)).alias("s_deeper")), "stretches", thin=True)
    from_here = F.sum("own").over(Window.partitionBy("l", "stretch").orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, 0))
    below_here = saved.withColumn("own", from_here).join(stretches.drop("s"), ["l", "stretch"]).select("l", "d", (F.col("own") + F.col("s_deeper")).alias("below"))
    sums = places.select("i", "block").join(stretches.groupBy(F.col("l").alias("i")).agg(F.sum("s").alias("s")), "i", "left").withColumn("s", F.coalesce("s", F.lit(0)))
    sums = written(running(written(sums, "sums", thin=True), "s", "upto").select("i", "upto"), "sums", thin=True)
    nodes = nodes.join(sums.select(F.col("i").alias("l"), F.col("upto").alias("to_l")), "l").join(sums.select(F.col("i").alias("r"), F.col("upto").alias("to_r")), "r")

    none = hashlib.sha256(b"").hexdigest()
    return expanded(nodes).join(below_here, ["l", "d"]).select(
        "conv_id",
        F.col("d").alias("depth"),
        F.when(F.col("d") == F.col("u") + 1, F.col("up")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        (F.col("r") - F.col("l") + 1).alias("n_convs"),
        F.when(F.col("d") == F.col("v"), F.col("children")).otherwise(1).cast("bigint").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("below") + F.col("to_r") - F.col("to_l")).alias("saved_tokens"),
        F.when(F.col("d") == F.col("v"), F.coalesce("ends", F.lit(none))).otherwise(F.lit(none)).alias("ends_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP11_SQL = r"""
WITH crc AS (
  SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n)),
own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, c - c % 20 AS b,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                         lambda h, x: xor(h >> 8, t[(xor(h, x) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM own) CROSS JOIN crc),
turns AS (
  SELECT v.c, 0 AS own, o.p, o.role, o.text FROM convs v JOIN own o ON o.c = v.b AND o.p <= v.h
  UNION ALL
  SELECT v.c, 1, o.p, o.role, o.text FROM convs v JOIN own o ON o.c = v.c AND o.p > v.h),
placed AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, p) AS d, md5(length(role) || ':' || role || text) AS s,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM turns),
lists AS (
  SELECT v.c, coalesce(list(s ORDER BY d) FILTER (s IS NOT NULL), []) AS seq, coalesce(list(words ORDER BY d) FILTER (s IS NOT NULL), []) AS words FROM convs v LEFT JOIN placed USING (c) GROUP BY v.c),
members AS (
  SELECT c, d, array_to_string(seq[1:d], ',') AS k, array_to_string(seq[1:d - 1], ',') AS up, len(seq) = d AS last, coalesce(words[d], 0) AS words
  FROM lists, unnest(range(len(seq) + 1)) u(d)),
nodes AS (
  SELECT k, d, any_value(up) AS up, min(c) AS conv_id, count(*) AS n, any_value(words) AS words, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends FROM members GROUP BY k, d),
kids AS (
  SELECT up, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY up, d),
full_ AS (
  SELECT x.*, coalesce(kids.n, 0) AS children FROM nodes x LEFT JOIN kids ON kids.up = x.k AND kids.d = x.d),
under AS (
  SELECT a.k, a.d, sum((b.n - 1) * b.words) AS saved, count(*) FILTER (b.children = 0) AS leaves
  FROM full_ a JOIN full_ b ON b.d >= a.d AND (a.d = 0 OR starts_with(b.k, a.k)) GROUP BY a.k, a.d)
SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n AS n_convs, x.children AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, x.ends AS ends_sha256
FROM full_ x JOIN under USING (k, d) LEFT JOIN full_ p ON x.d > 0 AND p.k = x.up AND p.d = x.d - 1
"""
