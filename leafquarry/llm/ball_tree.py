"""Centroid clustering of integer vectors by filtering partition-local ball trees.

Every task cuts its vectors into chunks of at most ``CHUNK`` and grows a metric tree over each: a ball holds its centre, radius, count
and integer sum. The trees are written once. A round walks each tree from its root with the centroids that can still be
nearest: where the triangle inequality leaves one, the whole ball goes to it with its count and sum; else both halves are
walked, and in leaves integer distances decide exactly (ties: the smaller number). Only counts and sums by centroid leave a task.

Bounds are computed in floating point and centroids dropped only beyond a slack far above its error, so results are exact.

Defined cases: rows whose vector is null, of another length or has a null or non-finite component are left out; repeated
rows count each; components are floor(256 x), held within +-2^27 so that squared distances fit a long; a null id
hashes as the empty text; of rows with equal hashes (equal ids) the smaller vector starts a lower centroid; fewer rows than
centroids give as many centroids; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafquarry.llm.common import pick, written

DIMS, SCALE, LIMIT = 64, 256, 1 << 27
#: Vectors in one tree, and in a leaf: a task holds one tree at a time.
CHUNK, LEAF = 4096, 32
#: Centroids dropped by a bound are farther by this share at least.
SLACK = 1e-9
TREE = "ids array<bigint>, points array<int>, bounds array<int>, centers array<double>, radii array<double>, sums array<bigint>"


def quantised(vectors: DataFrame, dims: int = DIMS) -> DataFrame:
    """vec_id, q: the rows whose vectors have exactly dims finite components, as integers."""
    d = pick(vectors, vec_id="vec_id", v="embedding").withColumn("v", F.col("v").cast("array<double>"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform("v", lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int"))
    return d.where((F.size("v") == dims) & finite).select(F.col("vec_id").cast("bigint").alias("vec_id"), whole.alias("q"))


def first_centroids(kept: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of seed:vec_id, in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(h.alias("h"), "q").orderBy("h", "q").limit(k).collect()
    return np.array([r.q for r in rows], np.int64).reshape(len(rows), len(rows[0].q) if rows else 0)


class BallTree:
    """A tree over points (int64, in the order of its leaves). bounds: first and one past the last point of each ball, and its left
    child (-1: a leaf; the right one follows the left)."""

    def __init__(self, points, bounds, centers, radii, sums):
        self.points, self.bounds, self.centers, self.radii, self.sums = points, bounds, centers, radii, sums

    @classmethod
    def grown(cls, points: np.ndarray) -> tuple[BallTree, np.ndarray]:
        """The tree and the order in which it holds the points."""
        order = np.arange(len(points))
        bounds, centers, radii, sums = [[0, len(points), -1]], [], [], []
        todo = deque([0])
        while todo:
            ball = todo.popleft()
            start, end, _ = bounds[ball]
            own = points[order[start:end]]
            total = own.sum(axis=0)
            center = total / (end - start)
            off = np.square(own - center).sum(axis=1)
            radius = float(np.sqrt(off.max()))
            centers.append(center)
            radii.append(radius * (1 + SLACK))
            sums.append(total)
            if end - start > LEAF and radius > 0:
                far = own[int(off.argmax())].astype(float)
                other = own[int(np.square(own - far).sum(axis=1).argmax())]
                half = (end - start) // 2
                order[start:end] = order[start:end][np.argpartition(own @ (other - far), half)]
                bounds[ball][2] = len(bounds)
                todo += (len(bounds), len(bounds) + 1)
                bounds += [[start, start + half, -1], [start + half, end, -1]]
        return cls(points[order], np.array(bounds, np.int32), np.array(centers), np.array(radii), np.array(sums)), order

    def walked(self, centroids: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """ball, start, end, cluster of each point from start to end: a whole ball with one cluster, or a leaf with its own."""
        balls, open_ = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
        floats = centroids.astype(float)
        while len(balls):
            away = np.sqrt(np.square(self.centers[balls][:, None, :] - floats[None]).sum(axis=2))
            away[~open_] = np.inf
            nearest = away.min(axis=1) + self.radii[balls]
            open_ = away - self.radii[balls][:, None] <= (nearest * (1 + SLACK) + SLACK)[:, None]
            left = self.bounds[balls, 2]
            decided = open_.sum(axis=1) == 1
            for at in np.flatnonzero(decided | (left < 0)).tolist():
                ball = int(balls[at])
                start, end = self.bounds[ball, :2].tolist()
                among = np.flatnonzero(open_[at])
                yield ball, start, end, among if decided[at] else among[squared(self.points[start:end], centroids[among]).argmin(axis=1)]
            split = ~decided & (left >= 0)
            balls, open_ = np.repeat(left[split], 2).astype(np.int64), np.repeat(open_[split], 2, axis=0)
            balls[1::2] += 1

    def totals(self, centroids: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
        """Adds the tree's points to the counts and sums of their nearest centroids."""
        for ball, start, end, cluster in self.walked(centroids):
            if len(cluster) == 1:
                counts[cluster[0]] += end - start
                sums[cluster[0]] += self.sums[ball]
            else:
                np.add.at(counts, cluster, 1)
                np.add.at(sums, cluster, self.points[start:end])

    def labels(self, centroids: np.ndarray) -> np.ndarray:
        found = np.empty(len(self.points), np.int64)
        for _, start, end, cluster in self.walked(centroids):
            found[start:end] = cluster
        return found


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all points from all centroids, exact: by float products where these are below 2^53, else by integers."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if most * most * points.shape[1] < 1 << 53:
        dots = (points.astype(float) @ centroids.T.astype(float)).astype(np.int64)
        return np.square(points).sum(axis=1)[:, None] - 2 * dots + np.square(centroids).sum(axis=1)[None]
    return np.stack([np.square(points - c).sum(axis=1) for c in centroids], axis=1)


def _listed(rows: np.ndarray, width: int) -> pa.Array:
    flat = np.ascontiguousarray(rows).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.array([0, width], np.int32)), pa.array(flat))


def trees(kept: DataFrame) -> DataFrame:
    """One row a tree."""

    def tree_of(ids: list[pa.Array], points: list[np.ndarray]) -> pa.RecordBatch:
        tree, order = BallTree.grown(np.concatenate(points).astype(np.int64))
        names = pa.concat_arrays(ids).take(pa.array(order))
        arrays = (tree.points.astype(np.int32), tree.bounds, tree.centers, tree.radii, tree.sums)
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array(np.array([0, len(names)], np.int32)), names), *(_listed(a, a.size) for a in arrays)],
            ["ids", "points", "bounds", "centers", "radii", "sums"],
        )

    def run(batches):
        ids, points, n = [], [], 0
        for batch in batches:
            q = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            for at in range(0, batch.num_rows, CHUNK):
                done = 0
                part = q[at : at + CHUNK]
                while done < len(part):
                    take = min(CHUNK - n, len(part) - done)
                    ids.append(batch.column(0).slice(at + done, take))
                    points.append(part[done : done + take].copy())
                    n, done = n + take, done + take
                    if n == CHUNK:
                        yield tree_of(ids, points)
                        ids, points, n = [], [], 0
        if n:
            yield tree_of(ids, points)

    return kept.mapInArrow(run, TREE)


def _trees_in(batches) -> Iterator[tuple[pa.Array, BallTree]]:
    for batch in batches:
        for k in range(batch.num_rows):
            ids, points, bounds, centers, radii, sums = (batch.column(c)[k].values for c in range(6))
            n = len(ids)
            yield (
                ids,
                BallTree(
                    points.to_numpy().reshape(n, -1).astype(np.int64),
                    bounds.to_numpy().reshape(-1, 3),
                    centers.to_numpy().reshape(len(radii), -1),
                    radii.to_numpy(),
                    sums.to_numpy().reshape(len(radii), -1),
                ),
            )


def moved(forest: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of the mean of each one's vectors; those without any stay."""
    k, dims = centroids.shape

    def run(batches):
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, tree in _trees_in(batches):
            tree.totals(centroids, counts, sums)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(counts[some]), *(pa.array(sums[some, j]) for j in range(dims))], ["cluster", "n", *(f"s{j}" for j in range(dims))]
        )

    columns = ["n", *(f"s{j}" for j in range(dims))]
    found = forest.mapInArrow(run, "cluster bigint, " + ", ".join(f"{c} bigint" for c in columns))
    new = centroids.copy()
    for r in found.groupBy("cluster").agg(*[F.sum(c).alias(c) for c in columns]).collect():  # at most one row a centroid
        new[r.cluster] = np.array(r[2:], np.int64) // r.n
    return new


def assigned(forest: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance (squared)."""

    def run(batches):
        for ids, tree in _trees_in(batches):
            labels = tree.labels(centroids)
            away = np.square(tree.points - centroids[labels]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(labels.astype(np.int32)), pa.array(away)], ["vec_id", "cluster", "distance"])

    return forest.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2", dims: int = DIMS) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    kept = quantised(vectors, dims)
    centroids = first_centroids(kept, k, seed)
    forest = written(trees(kept), "ball-trees")
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(forest, centroids)
    rows = written(assigned(forest, centroids), "clusters")
    named = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    shas = spark.createDataFrame(named, "cluster int, centroid_sha256 string")
    by_cluster = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = by_cluster.agg(F.sum("cluster_inertia").alias("inertia"))
    return rows.join(F.broadcast(by_cluster), "cluster").join(F.broadcast(shas), "cluster").crossJoin(F.broadcast(whole)).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def op13_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _rounds_sql(rounds: int) -> str:
    steps = []
    for t in range(rounds + 1):
        steps.append(f"""
a{t} AS MATERIALIZED (
  SELECT r, min({{'d': list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'k': k}}) AS m FROM kept CROSS JOIN c{t} GROUP BY r)""")
        if t < rounds:
            steps.append(f"""
n{t} AS (
  SELECT k, j, sum(x) AS s, count(*) AS n FROM (SELECT m.k AS k, unnest(q) AS x, unnest(range(64)) AS j FROM a{t} JOIN kept USING (r)) GROUP BY k, j),
c{t + 1} AS MATERIALIZED (
  SELECT k, coalesce(new, c) AS c FROM c{t} LEFT JOIN (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS new FROM n{t} GROUP BY k) USING (k))""")
    return ",".join(steps)


OP13_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [greatest(least(floor(256 * x::DOUBLE), {LIMIT}), -{LIMIT})::BIGINT FOR x IN embedding] AS q
  FROM embeddings WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, q) - 1 AS k, q AS c
  FROM (SELECT sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h, q FROM kept ORDER BY h, q LIMIT 40)),{_rounds_sql(5)},
sized AS (
  SELECT m.k AS k, sum(m.d) AS w FROM a5 GROUP BY m.k)
SELECT vec_id, m.k::INT AS cluster, m.d::BIGINT AS distance, w::BIGINT AS cluster_inertia, (SELECT sum(w) FROM sized)::BIGINT AS inertia,
       sha256(list_aggregate([x::VARCHAR FOR x IN c], 'string_agg', ',')) AS centroid_sha256
FROM a5 JOIN kept USING (r) JOIN sized ON sized.k = m.k JOIN c5 ON c5.k = m.k
"""
