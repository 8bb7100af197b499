"""Toxicity by a convolutional text classifier trained in numpy.

A word's embedding is the sum of the hashed vectors of the word and of its first four and five letters (so
unseen endings keep their stem). Filters of widths 1, 2 and 3 slide over the words of the whole text, each
filter's maximum is kept, and a linear layer gives the logit. Thresholds are calibrated for each language,
which is guessed from function words in the text; the score is shifted so that its threshold lies at 0.5.

Training takes at most ``most_rows`` labelled rows, chosen by hash (a bounded sample); buckets seen in fewer
than MIN_ROWS of them have the zero vector. Scoring reads every whole text.

Defined cases: null and empty texts have no words and score what the linear layer's constant gives; very long texts
are scored in blocks that overlap by the widest filter, which gives what the whole would; null ids count as the empty
text for the hold-out; an id labelled twice is toxic if one label says so; without labels of both kinds (or without
labels) every score is 0. Rows stay one to one, repeated or not, an empty table gives an empty result, and columns
beyond those named are ignored by ``score`` and passed through by ``keep_clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafquarry.llm.blobs import texts_of
from leafquarry.llm.common import bound_batches, crc_mod, pick
from leafquarry.llm.languages import LANGUAGES, STOPWORDS

BUCKETS = 1 << 18
LAST = BUCKETS - 1
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
MIN_ROWS = 3
#: Labelled rows that training takes at most.
MOST_ROWS = 6000
#: Distinct words a worker remembers before it starts afresh; more than a block of a text can hold.
MEMORY = 60_000
#: Rows of a language needed for a threshold of its own, and of each kind.
OWN_THRESHOLD = 40
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def buckets_of(word: str) -> tuple[int, int, int]:
    """Of the word, its first four and its first five letters."""
    x = word.encode()
    return crc32(x) & LAST, crc32(x if len(word) <= 4 else word[:4].encode() + b"*") & LAST, crc32(x if len(word) <= 5 else word[:5].encode() + b"**") & LAST


@dataclass
class Model:
    """rows: bucket to row of vectors (row 0 is zero); the rest as trained. thresholds: logits, by language, then for all."""

    seen: np.ndarray
    vectors: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    thresholds: np.ndarray

    def table(self) -> np.ndarray:
        """What each row adds to each (filter, offset)."""
        return np.concatenate([self.vectors @ self.filters[:, k] for k in range(self.filters.shape[1])], axis=1).astype(np.float32)


#: (filter block, offset) of each block of the table.
BLOCKS = [(w, o) for w in range(len(WIDTHS)) for o in range(WIDTHS[w])]


def pooled(parts: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Maximum of each filter over the positions; parts: words x (blocks * FILTERS)."""
    n, out = len(parts), []
    for w, width in enumerate(WIDTHS):
        total = np.zeros((n + width - 1, FILTERS), np.float32)
        for k, (block, offset) in enumerate(BLOCKS):
            if block == w:  # padded with zero vectors on the left
                total[width - 1 - offset : width - 1 - offset + n] += parts[:, k * FILTERS : (k + 1) * FILTERS]
        out.append(total.max(axis=0))
    return np.maximum(np.concatenate(out) + bias, 0)


class Scorer:
    """Scores texts in one worker, remembering what each word contributes."""

    def __init__(self, model: Model):
        self.model, self.parts = model, model.table()
        self.row = np.zeros(BUCKETS, np.int32)
        self.row[model.seen] = np.arange(1, len(model.seen) + 1)
        self.lang = {}
        for k, lang in enumerate(LANGUAGES):
            for w in STOPWORDS[lang]:
                self.lang.setdefault(w, np.zeros(len(LANGUAGES), np.float32))[k] = 1
        self.known: dict[str, int] = {}
        self.memory = np.zeros((MEMORY, self.parts.shape[1]), np.float32)  # pages are taken as they are first used
        self.votes = np.zeros((MEMORY, len(LANGUAGES)), np.float32)

    def ids(self, words: list[str]) -> np.ndarray:
        """Places of the words in memory; what is new is looked up at once for all."""
        known = self.known
        new = list(set(words).difference(known))
        if new:
            if len(known) + len(new) > MEMORY:
                known.clear()
                new = list(set(words))
            n = len(known)
            self.votes[n : n + len(new)] = 0
            rows = self.row[np.array([buckets_of(w) for w in new], np.int64)]
            self.memory[n : n + len(new)] = self.parts[rows[:, 0]] + self.parts[rows[:, 1]] + self.parts[rows[:, 2]]
            for k, w in enumerate(new, n):
                known[w] = k
                if w in self.lang:
                    self.votes[k] = self.lang[w]
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def logit(self, text: str | None) -> tuple[float, int]:
        """The logit and the guessed language's place, or that of none."""
        words, m = words_of(text), self.model
        if not words:
            return float(m.out[-1]), len(LANGUAGES)
        best, votes = None, np.zeros(len(LANGUAGES))
        for at in range(0, len(words), 1 << 15):  # very long texts in blocks that overlap by the widest filter
            ids = self.ids(words[max(0, at - max(WIDTHS) + 1) : at + (1 << 15)])
            p = pooled(self.memory[ids], m.bias)
            best = p if best is None else np.maximum(best, p)
            votes += self.votes[ids].sum(axis=0)
        return float(best @ m.out[:-1] + m.out[-1]), int(votes.argmax()) if votes.max() > 0 else len(LANGUAGES)

    def score(self, text: str | None) -> float:
        z, lang = self.logit(text)
        return float(1 / (1 + np.exp(-np.clip(z - self.model.thresholds[lang], -30, 30))))


def train(texts: list[str | None], labels: list[int], seed: int = 1) -> Model | None:
    """None without labels of both kinds."""
    y = np.array(labels, np.float32)
    if not 0 < y.sum() < len(y):
        return None
    rng = np.random.default_rng(seed)
    known: dict[str, int] = {}
    docs = [np.fromiter((known.setdefault(w, len(known)) for w in words_of(t)), np.int64) for t in texts]
    if not known:
        return None
    triples = np.array([buckets_of(w) for w in known], np.int64).reshape(-1, 3)
    counts, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for d, label in zip(docs, y, strict=True):
        own = np.unique(triples[np.unique(d)])
        counts[own] += 1
        toxic[own] += label
    seen = np.flatnonzero(counts >= MIN_ROWS)
    row = np.zeros(BUCKETS, np.int64)
    row[seen] = np.arange(1, len(seen) + 1)
    rows = row[triples]
    E = rng.normal(0, 0.05, (len(seen) + 1, DIM))
    # the first dimension starts from the smoothed log-odds of the bucket, which the classes already give
    prior = y.mean()
    E[1:, 0] = np.clip(np.log((toxic[seen] + 2 * prior) / (counts[seen] - toxic[seen] + 2 * (1 - prior)) * (1 - prior) / prior), -2, 4) / 2
    E[0] = 0
    W = rng.normal(0, 0.3, (DIM, len(BLOCKS), FILTERS))
    W[0] = np.abs(W[0]) + 0.3
    b, out = np.zeros(len(WIDTHS) * FILTERS), np.append(rng.uniform(0.1, 0.3, len(WIDTHS) * FILTERS), np.log(prior / (1 - prior)))
    sq = {k: np.full_like(v, 1e-3) for k, v in (("E", E), ("W", W), ("b", b), ("o", out))}
    order = rng.permutation(len(docs))
    n_check = len(docs) // 5
    fit, rest = order[n_check:], order[:n_check]

    def forward(d: np.ndarray):
        emb = E[rows[d]].sum(axis=1)
        n, pools, places = len(d), [], []
        for w, width in enumerate(WIDTHS):
            total = np.zeros((n + width - 1, FILTERS))
            for k, (block, offset) in enumerate(BLOCKS):
                if block == w:
                    total[width - 1 - offset : width - 1 - offset + n] += emb @ W[:, k]
            at = total.argmax(axis=0)
            pools.append(total[at, np.arange(FILTERS)])
            places.append(at - (width - 1))
        h = np.concatenate(pools) + b
        return emb, h, places

    steps = int(np.clip(30_000 // max(1, len(fit)), 4, 40))
    for epoch in range(steps):
        rate = 0.08 / (1 + epoch / 4)
        for i in rng.permutation(fit):
            d = docs[i]
            if not len(d):
                continue
            emb, h, places = forward(d)
            a = np.maximum(h, 0)
            z = a @ out[:-1] + out[-1]
            g = 1 / (1 + np.exp(-z)) - y[i]
            if abs(g) < 0.01:
                continue
            grad_out = np.append(g * a, g) + 1e-4 * out
            gh = g * out[:-1] * (h > 0)
            gW, gE = np.zeros_like(W), {}
            for k, (w, offset) in enumerate(BLOCKS):
                at = places[w] + offset
                gw = gh[w * FILTERS : (w + 1) * FILTERS]
                for f in np.flatnonzero((at >= 0) & (at < len(d)) & (gw != 0)):
                    gW[:, k, f] += gw[f] * emb[at[f]]
                    step = gw[f] * W[:, k, f]
                    for r in rows[d[at[f]]]:
                        if r:
                            gE[r] = gE.get(r, 0) + step
            for name, v, grad in (("W", W, gW), ("b", b, gh), ("o", out, grad_out)):
                sq[name] += grad * grad
                v -= rate * grad / np.sqrt(sq[name])
            for r, grad in gE.items():
                sq["E"][r] += grad * grad
                E[r] -= rate * grad / np.sqrt(sq["E"][r])
    model = Model(seen, E.astype(np.float32), W.astype(np.float32), b.astype(np.float32), out.astype(np.float32), np.zeros(len(LANGUAGES) + 1, np.float32))
    scorer = Scorer(model)
    got = [(*scorer.logit(texts[i]), y[i]) for i in rest]
    z, lang, truth = (np.array(x) for x in zip(*got, strict=True)) if got else (np.zeros(0), np.zeros(0), np.zeros(0))
    model.thresholds[:] = best = _threshold(z, truth, 0.0)
    for k in range(len(LANGUAGES)):
        own = lang == k
        if own.sum() >= OWN_THRESHOLD and 5 <= truth[own].sum():
            model.thresholds[k] = _threshold(z[own], truth[own], best)
    return model


def _threshold(z: np.ndarray, truth: np.ndarray, default: float) -> float:
    """The logit with the fewest errors on the calibration rows; of equal ones the middle of the widest gap."""
    if not len(z) or not 0 < truth.sum() < len(z):
        return default
    edges = np.concatenate(([z.min() - 1], np.sort(z), [z.max() + 1]))
    cuts, gaps = (edges[1:] + edges[:-1]) / 2, edges[1:] - edges[:-1]
    errors = np.array([((z >= c) != truth).sum() for c in cuts])
    best = np.flatnonzero(errors == errors.min())
    return float(cuts[best[gaps[best].argmax()]])


def sample(docs: DataFrame, labels: DataFrame, label: str, held_out, most_rows: int) -> list:
    """At most most_rows labelled (text, label), none of them held out; chosen by hash of the id and text.
    The labels are bounded first, so the documents need no shuffle."""
    marks = pick(labels, label_id="doc_id", label=label)
    ids = F.col("label_id")
    marks = marks.where(ids.isNotNull() & F.col("label").isNotNull() & ~held_out(ids)).groupBy("label_id").agg(F.max("label").alias("label"))
    chosen = marks.orderBy(F.xxhash64("label_id"), "label_id").limit(most_rows)
    texts = pick(docs, doc_id="doc_id", text="text")
    found = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    return found.select("text", "label", F.xxhash64("doc_id", "text").alias("h")).orderBy("h").limit(most_rows).select("text", "label").collect()


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model | None:
    rows = sample(docs, labels, "toxic", lambda i: crc_mod(i, 5) == 0, most_rows)
    return train([r.text for r in rows], [int(r.label == 1) for r in rows])


_held: list[Scorer] = []


def scorer_of(model: Model) -> Scorer:
    """The worker's scorer of this model; a worker that serves many tasks makes it once."""
    if not _held or _held[0].model is not model:
        _held[:] = [Scorer(model)]
    return _held[0]


def scores_of(model: Model | None, texts: pa.Array) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    scorer = scorer_of(model)
    return np.array([scorer.score(t) for t in texts_of(texts)], np.float64)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score for every row."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)
    bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores_of(shipped.value, batch.column(1)))], ["doc_id", "score"])

    thin = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return thin.mapInArrow(run, "doc_id bigint, score double")


def keep_clean(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """The rows of docs that score below 0.5, with all their columns."""
    spark, names = docs.sparkSession, docs.columns
    shipped = spark.sparkContext.broadcast(fit(docs, labels, most_rows))
    bound_batches(spark)
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores_of(shipped.value, batch.column(text)) < 0.5, pa.bool_()))

    placed = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return placed.mapInArrow(run, placed.schema).toDF(*names)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select(
        "doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
