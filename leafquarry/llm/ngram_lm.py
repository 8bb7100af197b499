"""Language-model scores by an interpolated modified Kneser-Ney model of word pairs (Chen and Goodman 1999).

Counting runs in Spark over all training texts: tasks sum the pairs of their texts, pairs are dealt by hash of
their first word (by both words where the first one is hot, see HOT_SHARE), and each bucket is stored as an array of
sorted pair hashes with counts. Words have arrays of counts, continuation counts and context statistics. Workers map
these files into memory and look up a batch's pairs at once. The number of buckets follows the number of tokens, so a
bucket's size doesn't grow with the corpus. Counts are 64-bit (of pairs 32 bits, and a list of those beyond; a word with 2^32
different contexts raises OverflowError). Nothing is pruned or sampled, and the driver holds only totals. The files
take about 12 bytes for each distinct pair and 40 for each distinct word.

Defined cases: null and empty texts are one end token; very long texts are read whole; null ids count as the empty text for the hold-out; without
training texts every token's probability is 1; repeated rows stay (and count in training as often); columns
beyond doc_id and text are ignored.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafquarry.llm import blobs
from leafquarry.llm.common import bound_batches, crc_mod, parts, pick, written

SEED = 42
#: Hashes of the end token and of the context of a text's first token; no word holds a line end.
END, START = (np.uint64(xxhash.xxh64_intdigest(x, SEED)) for x in (b"\n", b"\n\n"))
#: A word with more than this share of all tokens, and more than so many, is hot: at most 1 / HOT_SHARE words are.
HOT_SHARE, LEAST_HOT = 1 / 65536, 500_000
#: Tokens whose pairs a task sums before it passes them on; words it remembers.
HELD, MEMORY = 2_000_000, 400_000
PAIRS, STATS = 0, 1
#: Tokens whose pairs share a bucket, on average at most; the largest count that 32 bits hold for a pair.
PER_BUCKET, TOP = 1_000_000, (1 << 32) - 1


class Words(dict):
    """Word to number, given as words first occur; ``hashes`` has the hash of each number."""

    def __init__(self):
        super().__init__()
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.update({b"\n": 0, b"\n\n": 1})
        self.known, self.new = np.array([END, START], np.uint64), []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(xxhash.xxh64_intdigest(word, SEED))
        return n

    def of(self, text: bytes | None) -> np.ndarray:
        """Numbers of a text's tokens, the end (0) last."""
        words = text.lower().split() if text else []
        out = np.zeros(len(words) + 1, np.int64)
        out[:-1] = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return out

    def hashes(self) -> np.ndarray:
        if self.new:
            self.known = np.concatenate((self.known, np.array(self.new, np.uint64)))
            self.new.clear()
        return self.known


def contexts(texts: list[np.ndarray]) -> np.ndarray:
    """The number before each token, START (1) before the first of a text."""
    w = np.concatenate(texts)
    u = np.empty_like(w)
    u[1:] = w[:-1]
    u[np.cumsum([0, *map(len, texts[:-1])])] = 1
    return u


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, as they first occur, and the place of each key among them."""
    place, own = pd.factorize(keys)
    return own, place


def mixed(u: np.ndarray, w: np.ndarray | np.uint64) -> np.ndarray:
    h = u * np.uint64(0x9E3779B97F4A7C15) + (w ^ np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x165667B19E3779F9)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def buckets(u: np.ndarray, pair: np.ndarray, hot: np.ndarray, bits: int) -> np.ndarray:
    return (np.where(np.isin(u, hot), pair, mixed(u, np.uint64(1))) >> np.uint64(64 - bits)).astype(np.int64)


def summed(keys: tuple[np.ndarray, ...], values: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Sorted distinct keys, and the sums of their values."""
    if not len(values):
        return keys, values
    order = np.lexsort(keys[::-1])
    keys = tuple(k[order] for k in keys)
    first = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))))
    return tuple(k[first] for k in keys), np.add.reduceat(values[order], first)


def pair_blob(bucket: int, pair: np.ndarray, c: np.ndarray) -> bytes:
    """Sorted pair hashes with counts of 32 bits; those of TOP and more follow with 64."""
    order = np.argsort(pair)
    pair, c = pair[order], c[order].astype(np.uint64)
    over = c >= TOP
    return blobs.packed(bucket, PAIRS, pair, np.minimum(c, TOP).astype(np.uint32), pair[over], c[over])


PAIR_KINDS = (np.uint64, np.uint32, np.uint64, np.uint64)


def unigrams(texts: DataFrame) -> DataFrame:
    """w, c: every token and its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, n = Words(), [], 0

        def out() -> pa.RecordBatch:
            c = np.bincount(np.concatenate(held), minlength=len(words))
            w = words.hashes()[c > 0]
            held.clear()
            words.forget()
            return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c[c > 0])], ["w", "c"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(words.of(text))
                n += len(held[-1])
                if n >= HELD or len(words) > MEMORY:
                    yield out()
                    n = 0
        if held:
            yield out()

    return texts.mapInArrow(run, "w bigint, c bigint").groupBy("w").agg(F.sum("c").alias("c"))


def pair_files(texts: DataFrame, hot: np.ndarray, bits: int) -> str:
    """The folder with pair arrays (kind 0) and statistics (kind 1) of every bucket."""
    spark = texts.sparkSession

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, n = Words(), [], 0

        def out() -> Iterator[pa.RecordBatch]:
            names, many = words.hashes(), len(words)
            key, place = distinct(contexts(held) * many + np.concatenate(held))
            c = np.bincount(place)
            held.clear()
            words.forget()
            own, u, w = key // many, names[key // many], names[key % many]
            bucket = buckets(u, mixed(u, w), hot, bits)
            order = np.argsort(bucket * many + own)  # by bucket, within one by context
            own, u, w, c, bucket = own[order], u[order], w[order], c[order], bucket[order]
            edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=1 << 40))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                first = np.flatnonzero(np.diff(own[a:b], prepend=-1))
                runs = np.diff(first, append=b - a).astype(np.uint32)
                blob = blobs.packed(0, 0, u[a:b][first], runs, w[a:b], c[a:b].astype(np.uint32))
                yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a])], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "blob"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(words.of(text))
                n += len(held[-1])
                if n >= HELD or len(words) > MEMORY:
                    yield from out()
                    n = 0
        if held:
            yield from out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def out() -> pa.RecordBatch:
            u, w, c = (np.concatenate([x[k] for x in held]) for k in range(3))
            held.clear()
            (u, w), c = summed((u, w), c)
            first = np.flatnonzero(np.diff(u, prepend=~u[0]))
            few = [np.add.reduceat(x, first, dtype=np.int64).astype(np.uint32) for x in (c == 1, c == 2, c >= 3)]
            after, continued = np.unique(w, return_counts=True)
            stats = blobs.packed(
                at, STATS, u[first], np.add.reduceat(c, first).astype(np.uint64), *few, after, continued.astype(np.uint32), np.array([(c == k).sum() for k in (1, 2, 3, 4)], np.uint64)
            )
            return pa.RecordBatch.from_arrays([pa.array([PAIRS, STATS], pa.int32()), pa.array([pair_blob(at, mixed(u, w), c), stats], pa.binary())], ["kind", "blob"])

        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if at is not None and bucket != at:
                    yield out()
                at = bucket
                for _, _, view in blobs.blobs_in(memoryview(blob.as_buffer())):
                    u, runs, w, c = blobs.unpacked(view, (np.uint64, np.uint32, np.uint64, np.uint32))
                    held.append((np.repeat(u, runs), w.copy(), c.astype(np.int64)))
        if held:
            yield out()

    dealt = texts.mapInArrow(collect, "bucket int, blob binary").repartition(parts(spark), "bucket").sortWithinPartitions("bucket")
    return blobs.write(dealt.mapInArrow(merge, "kind int, blob binary"), "pairs", by_kind=True)


STAT_KINDS = (np.uint64, np.uint64, np.uint32, np.uint32, np.uint32, np.uint64, np.uint32, np.uint64)
WORD_KINDS = (np.uint64, np.uint64, np.uint32, np.uint32, np.uint32, np.uint32)
WORD_COLUMNS = ("c", "total", "n1", "n2", "n3", "continued")


def word_rows(spark: SparkSession, folder: str, counted: DataFrame) -> tuple[DataFrame, list[int]]:
    """w with its count, its statistics as a context and its continuation count; and how many pairs have counts 1 to 4."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for _, _, view in blobs.blobs_in(memoryview(content.as_buffer())):
                    u, total, n1, n2, n3, after, continued, of_counts = blobs.unpacked(view, STAT_KINDS)
                    no_u, no_w, no_n = (np.zeros(n, np.int64) for n in (len(u), len(after), 4))
                    # the counts of counts travel as four rows with a negative c
                    for columns in (
                        (u, no_u, total, n1, n2, n3, no_u),
                        (after, no_w, no_w, no_w, no_w, no_w, continued),
                        (no_n, np.arange(4) - 4, of_counts, no_n, no_n, no_n, no_n),
                    ):
                        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)) for x in columns], ["w", *WORD_COLUMNS])

    stats = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/kind={STATS}").where("length > 0").select("content")
    schema = "w bigint, " + ", ".join(f"{x} bigint" for x in WORD_COLUMNS)
    rows = stats.mapInArrow(run, schema)
    zero = F.lit(0).cast("bigint")
    both = rows.where("c >= 0").unionByName(counted.select("w", "c", *[zero.alias(x) for x in WORD_COLUMNS[1:]]))
    words = both.groupBy("w").agg(*[F.sum(x).alias(x) for x in WORD_COLUMNS])
    totals = {r.c + 4: r.total for r in rows.where("c < 0").groupBy("c").agg(F.sum("total").alias("total")).collect()}
    return words, [totals.get(k, 0) for k in range(4)]


def discounts(n: list[int]) -> np.ndarray:
    """What is taken from counts 0, 1, 2 and from 3 on; n: how many have the counts 1 to 4."""
    n1, n2, n3, n4 = n
    usual = [0.0, 0.5, 1.0, 1.5]
    if not n1 or not n2:
        return np.array(usual)
    y = n1 / (n1 + 2 * n2)
    found = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else usual[3]]
    return np.array([f if 0 < f < k else usual[k] for k, f in enumerate(found)])


@dataclass
class Model:
    """What all workers get: names of the files and totals."""

    pairs: list[str]
    words: list[str]
    bits: int
    hot: np.ndarray
    tokens: int
    distinct: int
    taken: np.ndarray
    taken_below: np.ndarray
    distinct_pairs: int
    rest_below: float


def word_files(words: DataFrame, bits: int) -> list[str]:
    """Files of sorted word hashes with their columns, by the hash's leading bits."""
    spark = words.sparkSession

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def out() -> pa.RecordBatch:
            columns = [np.concatenate([x[k] for x in held]) for k in range(1 + len(WORD_COLUMNS))]
            held.clear()
            keys = columns[0].view(np.uint64)
            order = np.argsort(keys)
            if max(int(c.max()) for c in columns[3:]) >= 1 << 32:
                raise OverflowError("a word has more contexts than 32 bits hold")
            blob = blobs.packed(at, 0, keys[order], *(c[order].astype(t) for c, t in zip(columns[1:], WORD_KINDS, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["blob"])

        for batch in batches:
            bucket = batch.column(0).to_numpy()
            for b in np.unique(bucket):
                if at is not None and b != at:
                    yield out()
                at = int(b)
                held.append([c.to_numpy() for c in batch.filter(pa.array(bucket == b)).columns[1:]])
        if held:
            yield out()

    bucketed = words.select(F.shiftrightunsigned("w", 64 - bits).cast("int").alias("bucket"), "w", *WORD_COLUMNS)
    tidy = bucketed.repartition(parts(spark), "bucket").sortWithinPartitions("bucket")
    return blobs.files(spark, blobs.write(tidy.mapInArrow(gather, "blob binary"), "words"))


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of passes whose results are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def train(texts: DataFrame) -> Model:
    """texts: one binary column. Two passes over it, then sums of what they wrote."""
    spark = texts.sparkSession
    bound_batches(spark, 4 << 20)
    counted = written(unigrams(texts), "unigrams", thin=True)
    tokens, distinct = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    bits = max(4, (tokens // PER_BUCKET).bit_length())
    if not tokens:
        return Model([], [], bits, np.zeros(0, np.uint64), 0, 0, discounts([0] * 4), discounts([0] * 4), 0, 1.0)
    hot = np.array([r.w for r in counted.where(F.col("c") > max(tokens * HOT_SHARE, LEAST_HOT)).select("w").collect()], np.int64).view(np.uint64)
    folder = pair_files(texts, hot, bits)
    release(spark)
    words, of_pairs = word_rows(spark, folder, counted)
    words = written(words, "word-statistics", thin=True)
    release(spark)
    named = [F.count_if(F.col("continued") == k) for k in (1, 2, 3, 4)]
    *below, more, distinct_pairs = words.agg(*named, F.count_if(F.col("continued") >= 3), F.coalesce(F.sum("continued"), F.lit(0))).first()
    taken_below = discounts(below)
    rest = (taken_below[1] * below[0] + taken_below[2] * below[1] + taken_below[3] * more) / distinct_pairs if distinct_pairs else 1.0
    pairs = blobs.files(spark, f"{folder}/kind={PAIRS}")
    return Model(pairs, word_files(words, bits), bits, hot, tokens, distinct, discounts(of_pairs), taken_below, distinct_pairs, rest)


class Scorer:
    def __init__(self, model: Model):
        self.m = model
        self.pairs = {b: blobs.unpacked(v, PAIR_KINDS) for b, _, v in blobs.opened(model.pairs)}
        self.words = {b: blobs.unpacked(v, (np.uint64, *WORD_KINDS)) for b, _, v in blobs.opened(model.words)}
        self.columns = np.zeros((len(WORD_COLUMNS), 0))
        self.numbers = Words()

    def _found(self, tables: dict, bucket: np.ndarray, keys: np.ndarray, columns: int) -> np.ndarray:
        """Columns of the sorted keys, zero where they are missing."""
        out = np.zeros((columns, len(keys)))
        order = np.argsort(bucket.astype(np.uint16) if self.m.bits <= 16 else bucket, kind="stable")
        keys, bucket = keys[order], bucket[order]
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=1 << 40))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            table = tables.get(int(bucket[a]))
            if table is None or not len(table[0]):
                continue
            at = np.minimum(np.searchsorted(table[0], keys[a:b]), len(table[0]) - 1)
            hit = table[0][at] == keys[a:b]
            for k in range(columns):
                out[k, order[a:b]] = np.where(hit, table[k + 1][at], 0)
        return out

    def counts(self, bucket: np.ndarray, pair: np.ndarray) -> np.ndarray:
        (seen,) = self._found(self.pairs, bucket, pair, 1)
        for k in np.flatnonzero(seen == TOP).tolist():
            _, _, over, c = self.pairs[int(bucket[k])]
            seen[k] = c[np.searchsorted(over, pair[k])]
        return seen

    def learn(self, words: Words) -> np.ndarray:
        """The columns of all numbers; what is new since the last batch is looked up."""
        names = words.hashes()
        new = names[self.columns.shape[1] :]
        if len(new):
            found = self._found(self.words, (new >> np.uint64(64 - self.m.bits)).astype(np.int64), new, len(WORD_COLUMNS))
            self.columns = np.concatenate((self.columns, found), axis=1)
        return names

    def score(self, texts: list[np.ndarray], words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, base score and score of each text (numbers of its tokens)."""
        m, names, many = self.m, self.learn(words), len(words)
        c, total, n1, n2, n3, continued = self.columns
        w = np.concatenate(texts)
        key, back = distinct(contexts(texts) * many + w)
        start = np.concatenate(([0], np.cumsum([len(x) for x in texts])[:-1]))
        u, v = key // many, key % many
        pair = mixed(names[u], names[v])
        seen = self.counts(buckets(names[u], pair, m.hot, m.bits), pair)
        below = (continued[v] - m.taken_below[np.minimum(continued[v], 3).astype(int)]) / max(1, m.distinct_pairs) + m.rest_below / (m.distinct + 1)
        whole = np.maximum(total[u], 1)
        rest = np.where(total[u] > 0, (m.taken[1] * n1[u] + m.taken[2] * n2[u] + m.taken[3] * n3[u]) / whole, 1.0)
        p = (seen - m.taken[np.minimum(seen, 3).astype(int)]) / whole + rest * below
        base = np.log10((c + 1) / (m.tokens + m.distinct + 1))
        sums = np.add.reduceat
        out = sums((c > 0).astype(np.int64)[w], start), sums(base[w], start), sums(np.log10(p)[back], start)
        if many > MEMORY:
            words.forget()
            self.columns = self.columns[:, :0]
        return out


_held: list[Scorer] = []


def scorer_of(model: Model) -> Scorer:
    """The worker's scorer of this model; a worker that serves many tasks maps the files once."""
    if not _held or _held[0].m is not model:
        _held[:] = [Scorer(model)]
    return _held[0]


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score: one row per row of docs."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)  # names and totals only
    bound_batches(spark, 4 << 20)
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(shipped.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [scorer.numbers.of(x) for x in batch.column(1).to_pylist()]
            known, base, score = scorer.score(texts, scorer.numbers)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (np.array([len(x) for x in texts], np.int64), known, base, score))], names)

    thin = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return thin.mapInArrow(run, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = crc_mod(F.col("doc_id"), 7) == 2
    model = train(docs.where(~held_out).select(F.col("text").cast("binary").alias("text")))
    return scored(docs, model).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score"
    )
