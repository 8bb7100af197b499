"""SimHash near-duplicates by tiled exact comparison.

Fingerprints of whole texts are grouped by value; the distinct ones are dealt to tiles by band (of the population
count or, in ``keep_one``, of the number of shingles) and, within a band, by hash, so no tile outgrows TILE by much.
Two fingerprints that differ in at most ``radius`` bits have population counts at most ``radius`` apart, so pairs of tiles
whose counts lie further apart are skipped; each remaining pair is compared by exclusive-or and bit counts in numpy.
Tiles are raw files in the shared folder that workers map, so only the numbers of tile pairs are dealt to tasks, and
a tile pair returns a spanning forest of its links, never all of them, which is enough for the components.
Components are found by large-star and small-star rounds on those links, each written to the shared folder.

The number of tile pairs, and with it the work, grows with the square of the number of distinct fingerprints, divided
among all tasks; of them the skipping leaves a few hundredths for 64 bits and radius 2.

``keep_one`` links texts by the exact Jaccard similarity of their distinct shingles (32 bits of each shingle's hash, in the
tiles): fingerprints within a radius that true pairs practically never exceed only choose the pairs to verify, nearest
first, and a pair whose texts the task has linked already is not verified again. Texts whose numbers of shingles
rule the similarity out are never compared.

Defined cases: a null or empty text has fingerprint zero, linked like any other; very long texts are read whole; null
doc_ids take part and are named by the smallest other doc_id of their component (null if there is none); repeated rows
share a fingerprint and each stays in the result (``keep_one`` keeps the rows that agree in doc_id and text with the one
that stays); an empty table gives an empty result; columns beyond doc_id and text are ignored or, by ``keep_one``, passed through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafquarry.llm import blobs
from leafquarry.llm.common import bound_batches, met, parts, pick, written

SEED = 42
#: Fingerprints in a tile, and bytes of their shingles, on average at most.
TILE, TILE_BYTES = 2048, 8 << 20
#: Rows of one tile compared at once with all of another.
STRIP = 32
#: Pairs looked at before those that have been linked meanwhile are left out.
HEAD = 512
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included. bytes.lower and bytes.split touch A-Z and [\\x20\\x09-\\x0D] only."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - size + 1)
    last = ends[min(size, len(words)) - 1 :][:n] - 1
    first = np.concatenate(([0], ends[: n - 1]))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit number of the bits that are set in over half the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        block = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = 3, words: int = 1) -> list[int]:
    """``words`` numbers of 64 bits; those after the first come from remixed hashes."""
    return mixed_majorities(shingle_hashes(text, shingle), words)


def mixed_majorities(h: np.ndarray, words: int) -> list[int]:
    out = [majority(h)]
    for k in range(1, words):
        x = h ^ (h >> np.uint64(29 + k))
        x = x * MIX[k - 1]
        out.append(majority(x ^ (x >> np.uint64(32))))
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1) -> DataFrame:
    """doc_id, t (hash of the text), f0, f1, ...: one row per document, written to the shared folder."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            found = np.array([fingerprint(x or b"", shingle, words) for x in texts], np.uint64).reshape(-1, words).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(found[:, k]) for k in range(words))], ["doc_id", "t", *(f"f{k}" for k in range(words))]
            )

    thin = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), "text")
    schema = "doc_id bigint, t bigint, " + ", ".join(f"f{k} bigint" for k in range(words))
    return written(thin.mapInArrow(run, schema), "fingerprints")


def _roots(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The smallest node reachable from each of n nodes over the links."""
    root = np.arange(n)
    while True:
        new = root.copy()
        low = np.minimum(root[left], root[right])
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _links(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a and b (words x items) that differ in at most radius bits. Two words are compared
    first: where they alone exceed the radius, the others can't mend it."""
    found = []
    for at in range(0, a.shape[1], STRIP):
        strip = a[:, at : at + STRIP]
        bits = np.bitwise_count(strip[0][:, None] ^ b[0][None, :])
        if len(a) > 1:
            bits = bits + np.bitwise_count(strip[1][:, None] ^ b[1][None, :])
        near = bits <= radius
        if not near.any():
            continue
        i, j = np.nonzero(near)
        if len(a) > 2:
            rest = sum(np.bitwise_count(strip[k][i] ^ b[k][j]).astype(np.int64) for k in range(2, len(a)))
            ok = bits[i, j] + rest <= radius
            i, j = i[ok], j[ok]
        if len(i):
            root = _roots(i, j + len(strip[0]), len(strip[0]) + b.shape[1])  # a forest of the strip's links, so that a dense tile stays small
            member = np.flatnonzero(root != np.arange(len(root)))
            found.append((member, root[member], at, len(strip[0])))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def whole(x, at, n):
        return np.where(x < n, x + at, x - n + a.shape[1])

    left, right = (np.concatenate([whole(f[k], f[2], f[3]) for f in found]) for k in (0, 1))
    return left, right


def tiled(nodes: DataFrame, band, span: int, radius: int, words: int, sets: bool = False) -> tuple[DataFrame, list[str]]:
    """tile_a, tile_b of all tile pairs to compare (bands up to ``span`` apart), and the files that hold the tiles:
    of nid, f0, f1, ... and, with sets, h (sorted numbers of 32 bits). nodes must be a written one."""
    spark = nodes.sparkSession
    total = sum((F.bit_count(f"f{k}") for k in range(1, words)), F.bit_count("f0"))
    counted = nodes.withColumn("band", band.cast("int"))
    weight = F.greatest(F.count(F.lit(1)) / TILE, F.sum("n") * 4 / TILE_BYTES) if sets else F.count(F.lit(1)) / TILE
    # one row a band: at most 64 * words + 1 by population count, some 600 by number of shingles
    found = counted.groupBy("band").agg(F.ceil(weight).cast("int").alias("chunks"), F.min(total).alias("low"), F.max(total).alias("high")).orderBy("band").collect()
    first = np.concatenate(([0], np.cumsum([r.chunks for r in found]))).tolist()
    sizes = spark.createDataFrame([(*r, f) for r, f in zip(found, first, strict=False)], "band int, chunks int, low int, high int, first int")
    tile = F.col("first") + F.pmod(F.xxhash64("nid", F.lit(7)), F.col("chunks")).cast("int")
    fields = ["nid", *[f"f{k}" for k in range(words)], *(["h"] if sets else [])]
    dealt = counted.join(F.broadcast(sizes), "band").select(tile.alias("tile"), *fields)

    def gather(batches):
        held, at = [], None

        def out():
            numbers = [np.concatenate([x[k] for x in held]) for k in range(1 + words)]
            more = []
            if sets:
                raw = [v for x in held for v in x[1 + words]]
                more = [np.concatenate(([0], np.cumsum([len(v) // 4 for v in raw]))).astype(np.int64), np.frombuffer(b"".join(raw), np.uint32)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([blobs.packed(at, 0, *numbers, *more)], pa.binary())], ["blob"])

        for batch in batches:
            number = batch.column(0).to_numpy()
            for b in np.unique(number):
                if at is not None and b != at:
                    yield out()
                at = int(b)
                rows = batch.filter(pa.array(number == b))
                held.append([rows.column(1 + k).to_numpy().copy() for k in range(1 + words)] + ([rows.column(2 + words).to_pylist()] if sets else []))
        if held:
            yield out()

    bound_batches(spark)
    tidy = dealt.repartition(parts(spark), "tile").sortWithinPartitions("tile")
    names = blobs.files(spark, blobs.write(tidy.mapInArrow(gather, "blob binary"), "tiles"))
    other = sizes.toDF("band_b", "chunks_b", "low_b", "high_b", "first_b")
    pairs = (
        sizes.withColumn("band_b", F.explode(F.sequence(F.col("band"), F.col("band") + span)))
        .join(other, "band_b")
        .where(F.col("low_b") <= F.col("high") + radius)
        .where(F.col("low") <= F.col("high_b") + radius)
        .withColumn("tile_a", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("chunks") - 1)))
        .withColumn("tile_b", F.explode(F.sequence(F.greatest("first_b", "tile_a"), F.col("first_b") + F.col("chunks_b") - 1)))
        .where("tile_b >= tile_a")
        .select("tile_a", "tile_b")
    )
    return pairs.repartition(4 * parts(spark), "tile_a", "tile_b"), names


class Tile:
    """A mapped tile: nids, prints (words x items) and, where it has them, sets."""

    def __init__(self, view: memoryview, words: int, sets: bool = False):
        found = blobs.unpacked(view, (np.int64, *[np.uint64] * words, *((np.int64, np.uint32) if sets else ())))
        self.nids, self.prints = found[0], np.stack(found[1 : 1 + words])
        if sets:
            self.start, self.sets = found[1 + words :]
            self.n = np.diff(self.start)

    def set_of(self, k: int) -> np.ndarray:
        return self.sets[self.start[k] : self.start[k + 1]]


def compared(pairs: DataFrame, names: list[str], words: int, sets: bool, forest) -> DataFrame:
    """a, b: what ``forest(tile, tile or None for the same)`` finds for every pair of tiles, as nids."""

    def run(batches):
        last: dict[int, Tile] = {}

        def tile(number: int) -> Tile:
            if number not in last:
                while len(last) > 3:
                    del last[next(iter(last))]
                last[number] = Tile(blobs.by_number(names)[number], words, sets)
            return last[number]

        for batch in batches:
            for x, y in sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                a, b = tile(x), tile(y) if x != y else None
                left, right = forest(a, b)
                if len(left):
                    ids = np.concatenate((a.nids, b.nids)) if b else a.nids
                    yield pa.RecordBatch.from_arrays([pa.array(ids[left]), pa.array(ids[right])], ["a", "b"])

    return pairs.mapInArrow(run, "a bigint, b bigint")


def links(nodes: DataFrame, radius: int, words: int) -> DataFrame:
    """a, b: a spanning forest of the links among nodes (nid, f0, f1, ...)."""
    width = max(1, radius // 2)
    total = sum((F.bit_count(f"f{k}") for k in range(1, words)), F.bit_count("f0"))
    pairs, names = tiled(nodes, F.floor(total / width), -(-radius // width), radius, words)

    def forest(a: Tile, b: Tile | None) -> tuple[np.ndarray, np.ndarray]:
        i, j = _links(a.prints, (b or a).prints, radius)
        n = len(a.nids)
        if b is None:
            i, j = i % n, j % n
        if not len(i):
            return i, j
        root = _roots(i, j, n + len(b.nids) if b else n)
        member = np.flatnonzero(root != np.arange(len(root)))
        return member, root[member]

    return compared(pairs, names, words, False, forest)


def similar(x: np.ndarray, y: np.ndarray, least: tuple[int, int]) -> bool:
    """Whether two sorted sets have a Jaccard similarity of at least least[0] / least[1]."""
    if not len(x) or not len(y):
        return len(x) == len(y)
    if len(x) < len(y):
        x, y = y, x
    at = np.searchsorted(x, y)
    common = int((x[np.minimum(at, len(x) - 1)] == y).sum())
    return least[1] * common >= least[0] * (len(x) + len(y) - common)


def verified_forest(a: Tile, b: Tile | None, radius: int, least: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of texts within the radius whose sets are similar."""
    n, other = len(a.nids), b or a
    root = np.arange(n + len(b.nids) if b else n)
    left, right = [], []

    def holds(p: int, q: int) -> bool:
        return similar(a.set_of(p), other.set_of(q - n) if b else a.set_of(q), least)

    for at in range(0, n, STRIP):
        strip, skip = a.prints[:, at : at + STRIP], 0 if b else at
        rest = other.prints[:, skip:]
        # all 256 bits differing would count as none, but no such pair is similar
        bits = sum(np.bitwise_count(strip[k][:, None] ^ rest[k][None, :]) for k in range(len(strip)))
        i, j = np.nonzero(bits <= radius)
        size_a, size_b = a.n[i + at], other.n[j + skip]
        ok = least[1] * np.minimum(size_a, size_b) >= least[0] * np.maximum(size_a, size_b)
        if b is None:
            ok &= j > i
        i, j = i[ok], j[ok]
        order = np.argsort(bits[i, j], kind="stable")
        p, q = i[order] + at, j[order] + skip + (n if b else 0)
        while len(p):
            live = root[p] != root[q]
            p, q = p[live], q[live]
            for x, y in zip(p[:HEAD].tolist(), q[:HEAD].tolist(), strict=True):
                if root[x] != root[y] and holds(x, y):
                    left.append(x)
                    right.append(y)
                    low, high = sorted((root[x], root[y]))
                    root[root == high] = low
            p, q = p[HEAD:], q[HEAD:]
    return np.array(left, np.int64), np.array(right, np.int64)


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each node's component, for the nodes of the edges. Large-star and
    small-star rounds (Kiveris et al. 2014) until nothing changes; nodes with many links are met by broadcast (``met``)."""
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges", thin=True)
    state = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("d")), "lowest", thin=True)
        large = written(met(both, low, ["a"], "d").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large", thin=True)
        low = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("d")), "lowest", thin=True)
        small = met(large, low, ["a"], "d").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        edges = written(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "edges", thin=True)
        new = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if new == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = new


def grouped(prints: DataFrame, radius: int, words: int) -> tuple[DataFrame, list[str]]:
    """nodes with their component's root: f0, f1, ..., best (smallest (unnamed, doc_id, t) among the rows), copies, root."""
    keys = [f"f{k}" for k in range(words)]
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "t"))
    nodes = prints.groupBy(*keys).agg(best.alias("best"), F.count(F.lit(1)).alias("copies"))
    nodes = written(nodes.withColumn("nid", F.col("f0") if words == 1 else F.xxhash64(*keys)), "nodes", thin=True)
    found = components(links(nodes.select("nid", *keys), radius, words))
    return nodes.join(found, nodes["nid"] == found["node"], "left").select(*keys, "best", "copies", F.coalesce("root", "nid").alias("root")), keys


def set_prints(docs: DataFrame, shingle: int, words: int) -> DataFrame:
    """row, doc_id, t (hash of the text), nid (hash of its set of shingles), n (their number), f0, f1, ... of distinct
    shingles, and h, their hashes' upper 32 bits, sorted."""
    bound_batches(docs.sparkSession)
    names = ["doc_id", "t", "nid", "n", *(f"f{k}" for k in range(words)), "h"]

    def run(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(x or b"", shingle)) for x in batch.column(2).cast(pa.binary()).to_pylist()]
            nids = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], np.uint64).view(np.int64)
            found = np.array([mixed_majorities(h, words) for h in sets], np.uint64).reshape(-1, words).view(np.int64)
            short = [np.unique((h >> np.uint64(32)).astype(np.uint32)) for h in sets]
            sizes = pa.array(np.array([len(x) for x in short], np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nids), sizes, *(pa.array(found[:, k]) for k in range(words)), pa.array([x.tobytes() for x in short], pa.binary())], names
            )

    thin = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), "text")
    schema = "doc_id bigint, t bigint, nid bigint, n bigint, " + ", ".join(f"f{k} bigint" for k in range(words)) + ", h binary"
    return written(thin.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "fingerprints")


def keep_one(docs: DataFrame, shingle: int = 5, words: int = 4, radius: int = 72, least: tuple[int, int] = (4, 5)) -> DataFrame:
    """The rows of docs that stay: of each component the row with the smallest doc_id (null ids last; of equal
    ids the text with the smaller hash; rows that agree in both stay together). All columns pass through.

    Texts are linked where the Jaccard similarity of their distinct shingles is at least least[0] / least[1], checked
    exactly but for shingles whose hashes share 32 bits (some 10^-5 of a shingle's chances in a text of 20,000 words).
    The radius only chooses what is checked: of 256 bits, pairs at 0.8 differ in 39 on average with a
    deviation of 6 (at worst 48, for texts of four and five shingles), unrelated ones in 128."""
    prints = set_prints(docs, shingle, words)
    keys = [f"f{k}" for k in range(words)]
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "t"))
    nodes = written(prints.groupBy("nid").agg(best.alias("best"), F.min("row").alias("row")), "nodes", thin=True)
    others = written(prints.select("row").join(nodes.select("row"), "row", "left_anti"), "repeated", thin=True)
    single = prints.select("row", "nid", "n", *keys, "h").join(others, "row", "left_anti")
    step = np.log(1.08)
    span = int(np.log(least[1] / least[0]) / step) + 1
    band = F.when(F.col("n") > 0, F.floor(F.log(F.col("n").cast("double")) / F.lit(float(step)))).otherwise(F.lit(-span - 1))
    pairs, names = tiled(single, band, span, radius, words, sets=True)
    found = compared(pairs, names, words, True, lambda a, b: verified_forest(a, b, radius, least))
    roots = components(found)
    nodes = nodes.join(roots, nodes["nid"] == roots["node"], "left").select("best", F.coalesce("root", "nid").alias("root"))
    keepers = nodes.groupBy("root").agg(F.min("best").alias("k")).select(F.col("k.doc_id").alias("keep_id"), F.col("k.t").alias("keep_t"))
    names = docs.columns
    placed = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = (F.col(f"c{names.index(n)}") for n in ("doc_id", "text"))
    keyed = placed.withColumn("t", F.xxhash64(F.coalesce(text, F.lit(""))))
    on = doc_id.cast("bigint").eqNullSafe(F.col("keep_id")) & (F.col("t") == F.col("keep_t"))
    return keyed.join(keepers, on, "left_semi").drop("t").toDF(*names)


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of docs, by 64-bit fingerprints."""
    prints = fingerprints(docs, shingle, 1)
    nodes, keys = grouped(prints, radius, 1)
    nodes = written(nodes, "components", thin=True)
    names = nodes.groupBy("root").agg(F.min("best").alias("k"), F.count(F.lit(1)).alias("size")).select("root", F.col("k.doc_id").alias("component_id"), "size")
    classes = written(met(nodes, written(names, "component-names", thin=True), ["root"], "size").select("f0", "component_id", "copies"), "classes", thin=True)
    return met(prints, classes, ["f0"], "copies").select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
