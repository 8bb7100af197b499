"""Quality by naive Bayes support vectors.

Features are indicators of n-grams: words, pairs and triples of word shapes (letter case, digits, symbols) with
the band of their share of the text, repeated words and repeated lines, and the words themselves. Indicators are
scaled by the log-count ratio of the classes and a linear hinge-loss model is fitted by dual coordinate descent.
The score is a logistic curve of the margin, fitted on rows that the model didn't see.

Training takes at most ``most_rows`` labelled rows, chosen by hash (a bounded sample). Scoring reads every whole text.

Defined cases: null and empty texts have no features and score what the constant gives; very long texts are read
whole; null ids count as the empty text for the hold-out; an id labelled twice is good if one label says so; without
labels of both kinds every score is the share of label 1 (0.5 without labels). Repeated rows stay, an empty table
gives an empty result, and columns beyond those named are ignored.
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
from leafquarry.llm.toxicity import sample

BUCKETS = 1 << 18
LAST = BUCKETS - 1
#: Labelled rows that training takes at most.
MOST_ROWS = 8000
MIN_ROWS = 3
MEMORY = 150_000
RUNS = re.compile(r"(.)\1+")
SMOOTH, PENALTY, ROUNDS = 1.0, 1.0, 12


def shape_of(word: str) -> str:
    """Runs of lower letters, capitals and digits as a, A and 9; other characters as they are, the first six such runs of the whole word."""
    kinds = "".join("a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else c for c in word)
    return RUNS.sub(r"\1", kinds)[:6]


class Features:
    """Ids of a text's features; remembers each word's."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, 2), np.int64)

    def places(self, words: list[str]) -> np.ndarray:
        known = self.known
        new = list(set(words).difference(known))
        if new:
            if len(known) + len(new) > MEMORY and known:
                self.forget()
                return self.places(words)
            n = len(known)
            while n + len(new) > len(self.table):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            for k, w in enumerate(new, n):
                known[w] = k
                self.table[k] = crc32(w.encode()), crc32(shape_of(w).encode())
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def of(self, text: str | None) -> np.ndarray:
        words = text.split() if text else []
        if not words:
            return np.zeros(0, np.int64)
        at = self.places(words)
        word, shape = self.table[at, 0], self.table[at, 1]
        out = [word]
        grams = [shape, shape[:-1] * 3 + shape[1:] * 7 + 1, shape[:-2] * 3 + shape[1:-1] * 7 + shape[2:] * 11 + 2]
        for k, gram in enumerate(grams):
            ids, counts = np.unique(gram, return_counts=True)
            band = np.floor(np.log2(counts / len(words) * 512)).astype(np.int64)
            out.append(ids * 31 + k * 101 + 17 * band)
        same = word[1:] == word[:-1]
        lines = [x for x in text.split("\n") if x.strip()]
        for k, share in enumerate((same.mean() if len(same) else 0.0, 1 - len(set(lines)) / max(1, len(lines)))):
            out.append(np.array([7_000_003 * (k + 1) + int(np.ceil(share * 16))]))
        found = np.concatenate(out) * np.int64(0x9E3779B1)
        return np.unique((found ^ (found >> 17)) & LAST)


@dataclass
class Model:
    weights: np.ndarray
    constant: float
    slope: float
    shift: float

    def margin(self, ids: np.ndarray) -> float:
        return float(self.weights[ids].sum() / np.sqrt(max(1, len(ids))) + self.constant)

    def probability(self, ids: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(ids) + self.shift, -30, 30))))


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, rng) -> tuple[np.ndarray, float]:
    """Weights (with the ratios multiplied in) and constant of the L2-regularised hinge loss, by dual coordinate
    descent (Hsieh et al. 2008). A row's values are its features' ratios over the root of its number of features."""
    w, constant = np.zeros(BUCKETS), 0.0
    values = [ratio[r] / np.sqrt(max(1, len(r))) for r in rows]
    square = np.array([v @ v + 1 for v in values])
    alpha = np.zeros(len(rows))
    weight = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum())) * PENALTY
    for _ in range(ROUNDS):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (values[i] @ w[rows[i]] + constant) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), weight[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                constant += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w * ratio, constant


def train(texts: list[str | None], labels: list[int], seed: int = 1) -> Model:
    y = np.where(np.array(labels) == 1, 1, -1)
    share = float((y > 0).mean()) if len(y) else 0.5
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(BUCKETS), 0.0, 0.0, float(np.log(np.clip(share, 1e-9, 1 - 1e-9) / np.clip(1 - share, 1e-9, 1))))
    features = Features()
    rows = [features.of(t) for t in texts]
    counts = np.bincount(np.concatenate(rows), minlength=BUCKETS)
    usual = counts >= MIN_ROWS
    rows = [r[usual[r]] for r in rows]
    rng = np.random.default_rng(seed)

    def fitted(which: np.ndarray) -> tuple[np.ndarray, float]:
        good, bad = (np.bincount(np.concatenate([rows[i] for i in which if y[i] == s] or [np.zeros(0, np.int64)]), minlength=BUCKETS) + SMOOTH for s in (1, -1))
        ratio = np.where(usual, np.log(good / good.sum() / (bad / bad.sum())), 0.0)
        return descend([rows[i] for i in which], y[which], ratio, rng)

    order = rng.permutation(len(rows))
    check, rest = order[: len(order) // 5], order[len(order) // 5 :]
    slope, shift = 2.0, 0.0
    if len({*y[check].tolist()}) == 2 and len({*y[rest].tolist()}) == 2:
        m = Model(*fitted(rest), 1.0, 0.0)
        slope, shift = logistic(np.array([m.margin(rows[i]) for i in check]), y[check] > 0)
    w, constant = fitted(order)
    return Model(w, constant, slope, shift)


def logistic(z: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve with the highest penalised likelihood, by Newton steps."""
    a, b = 2.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        r, v = p - truth, np.maximum(p * (1 - p), 1e-6)
        g = np.array([(r * z).sum() + 0.05 * (a - 2), r.sum() + 0.05 * b])
        h = np.array([[(v * z * z).sum() + 0.05, (v * z).sum()], [(v * z).sum(), v.sum() + 0.05]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 0.1)), float(b)


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    rows = sample(docs, labels, "quality", lambda i: crc_mod(i, 3) == 1, most_rows)
    return train([r.text for r in rows], [int(r.label == 1) for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for every row."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)
    bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, model = Features(), shipped.value
        for batch in batches:
            found = np.array([model.probability(features.of(t)) for t in texts_of(batch.column(1))], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "score"])

    thin = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return thin.mapInArrow(run, "doc_id bigint, score double")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select(
        "doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
