"""The prefix trie, the multiset hash and the ball trees against brute force, on odd rows and small pieces."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from leafquarry.llm import ball_tree, multiset_hash, prefix_trie

TURNS = "conv_id bigint, turn bigint, role string, text string, n bigint, i string"


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    for turns in own.values():
        turns.sort(key=lambda t: t[:3])
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        whole[c] = tuple(t[3:] for t in own.get(base, [])[:h]) + tuple(t[3:] for t in turns[h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = Counter(k[:-1] for k in members if k)
    saved, leaves = Counter(), Counter()
    for k, cs in members.items():
        worth = (len(cs) - 1) * (len(k[-1][1].split()) if k else 0)
        for d in range(len(k) + 1):
            saved[k[:d]] += worth
            leaves[k[:d]] += not kids[k]
    return sorted(
        (min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), kids[k], leaves[k], saved[k], hashlib.sha256(",".join(str(c) for c in sorted(cs) if whole[c] == k).encode()).hexdigest())
        for k, cs in members.items()
    )


def random_turns(seed, n, most, words):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-50, 200), n):
        for t in range(rng.randint(0 if seed % 2 else 1, most)):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(("user", "bot", None)), rng.choice(words), 1, "x"))
    return rows


ODD_TURNS = [(None, 1, "a", "no conversation", 0, ""), (3, 1, None, None, 0, ""), (3, 1, None, None, 0, ""), (3, 1, "", "", 0, ""), (23, None, "a", "b " * 5000, 0, ""), (40, 2, "user", "x", 0, ""), (41, 2, "user", "x", 0, "")]


@pytest.mark.parametrize("rows", [random_turns(1, 60, 9, ("a b", "c", "")), random_turns(2, 120, 4, ("same",)), random_turns(3, 20, 40, ("a",)), ODD_TURNS, ODD_TURNS[:1], []], ids=range(6))
def test_trie(spark, rows):
    rows = rows + [(c + 1000, *r) for c, *r in rows if c is not None and c % 3 == 0]  # long and equal sequences
    got = prefix_trie.trie(spark.createDataFrame(rows, TURNS), piece=3, block=4)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute_trie(rows), key=repr)


@pytest.mark.parametrize("values", [[-1], [-1, 3, 3, 3], [-1, 5, 4, 3, 2, 1, 0], [-1, 0, 1, 2, 3, 0, 0, 2, 1, 2]])
def test_nearest_smaller(values):
    left, right = prefix_trie.nearest_smaller(np.array(values))
    for k, v in enumerate(values):
        assert left[k] == max((j for j in range(k) if values[j] < v), default=-1)
        assert right[k] == min((j for j in range(k + 1, len(values)) if values[j] < v), default=len(values))


def brute_vector(text):
    units = ["p" + p for p in text.split("\n")]
    piece = ""
    for ch in text + "\n":
        if ch in ".!?;|\n":
            units += ["s" + piece] if piece.strip(" ") else []
            piece = ""
        else:
            piece += ch
    lanes = [0] * 80
    for u in units:
        h = hashlib.sha256(u.encode()).hexdigest()
        for w in range(4):
            long = int(h[15 * w : 15 * w + 15], 16)
            for s in range(5):
                for k in range(4):
                    lanes[(5 * w + s) * 4 + k] += long >> (3 * s + 15 * k) & 7
    lanes = [x % 2**14 for x in lanes]
    packed = [sum(lanes[4 * i + k] << (15 * k) for k in range(4)) for i in range(20)]
    return len(units), f"{len(units):08x}" + "".join(f"{x:015x}" for x in packed), lanes


def brute_likeness(a, b):
    if a[1] == b[1]:
        return 1.0
    wrap = lambda x: (x + 2**14) % 2**15 - 2**14
    own = sum(wrap(2 * x - 7 * n) ** 2 for n, _, v in (a, b) for x in v)
    apart = sum(wrap(2 * (x - y) - 7 * (a[0] - b[0])) ** 2 for x, y in zip(a[2], b[2], strict=True))
    return max(0.0, min(1.0, 1 - apart / own)) if own else 0.0


DOCS = "doc_id bigint, text string, n bigint, f string, copies bigint"
ODD_DOCS = [
    (5, "One. Two!\nThree? é😀 four; five | six.\n\n  \nlast", 0, "", 0), (1, None, 0, "", 0), (2, "", 0, "", 0), (None, "no id. at all", 0, "", 0), (9, "same row.", 0, "", 0), (9, "same row.", 0, "", 0),
    (9, "same row.", 0, "", 0), (9, "other row.", 0, "", 0), (12, "\n".join(f"line {k}. more of it" for k in range(3000)), 0, "", 0), (13, "\n".join(f"line {k}. more of it" for k in reversed(range(3000))), 0, "", 0),
    (14, "word " * 30_000, 0, "", 0),
]


@pytest.mark.parametrize("rows", [ODD_DOCS, ODD_DOCS[:1], ODD_DOCS[4:7], []], ids=["odd", "one", "repeated", "none"])
def test_multiset_hash(spark, rows):
    got = multiset_hash.edited(spark.createDataFrame(rows, DOCS))
    order = sorted(((d is None, d or 0, hashlib.md5((t or "").encode()).digest(), t or "") for d, t, *_ in rows))
    wanted = []
    for k, (unnamed, d, _, text) in enumerate(order):
        after = order[(k + 1) % len(order)][3]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        own, new, nxt = map(brute_vector, (text, edited, after))
        wanted.append((None if unnamed else d, len(text), hashlib.sha256(edited.encode()).hexdigest(), own[1], new[1], brute_likeness(own, new), brute_likeness(own, nxt)))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(wanted, key=repr)


def test_order_of_paragraphs_does_not_matter(spark):
    prints = {r.doc_id: r.fingerprint for r in multiset_hash.fingerprints(spark.createDataFrame(ODD_DOCS, DOCS)).collect()}
    assert prints[12] == prints[13] and prints[1] == prints[2] and len(set(prints.values())) == len(prints) - 2


VECTORS = "vec_id bigint, embedding array<float>, label int, cluster string"


def brute_clusters(rows, k, rounds, dims):
    kept = []
    for vec_id, v, *_ in rows:
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v):
            kept.append((vec_id, [int(np.floor(max(-(2.0**27), min(2.0**27, 256 * float(np.float32(x)))))) for x in v]))
    first = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), q) for i, q in kept)
    centroids = [q for _, q in first[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, q in kept:
            groups[near(q)[1]].append(q)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centroids)]
    found = [(i, *near(q)) for i, q in kept]
    inertia = Counter()
    for _, d, j in found:
        inertia[j] += d
    return [(i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in found]


def vectors(kind):
    rng = np.random.default_rng(5)
    if kind == "blobs":
        centers = rng.normal(0, 3, (6, 3))
        points = (centers[rng.integers(0, 6, 900)] + rng.normal(0, 0.2, (900, 3))).tolist()
        return [(k, p, 0, "") for k, p in enumerate(points)]
    if kind == "grid":  # many ties
        return [(int(k % 40), rng.integers(-2, 3, 3).astype(float).tolist(), 0, "") for k in range(500)]
    if kind == "odd":
        inf, nan = float("inf"), float("nan")
        return [
            (1, None, 0, ""), (2, [1.0, 2.0], 0, ""), (3, [1.0, None, 2.0], 0, ""), (4, [inf, 0.0, 0.0], 0, ""), (5, [nan, 0.0, 0.0], 0, ""), (None, [0.0, -0.001, 0.5], 0, ""),
            (7, [3e38, -3e38, 0.0], 0, ""), (8, [1.0, 1.0, 1.0], 0, ""), (8, [1.0, 1.0, 1.0], 0, ""), (8, [1.0, 1.0, 0.5], 0, ""),
        ]
    return [(k, [1.0, 2.0, 3.0], 0, "") for k in range(300)] if kind == "equal" else []


@pytest.mark.parametrize("kind", ["blobs", "grid", "odd", "equal", "none"])
def test_clusters(spark, kind):
    rows = vectors(kind)
    got = ball_tree.clustered(spark.createDataFrame(rows, VECTORS), k=7, rounds=3, dims=3)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute_clusters(rows, 7, 3, 3), key=repr)


def test_whole_balls_are_assigned():
    """Of well separated groups the walk decides most points by balls, without looking at them."""
    rng = np.random.default_rng(1)
    centroids = (rng.normal(0, 1, (10, 8)) * 5000).astype(np.int64)
    points = np.repeat(centroids, 400, axis=0) + rng.integers(-50, 50, (4000, 8))
    tree, order = ball_tree.BallTree.grown(points)
    whole = sum(end - start for _, start, end, cluster in tree.walked(centroids) if len(cluster) == 1)
    assert whole > 2000
    assert (tree.labels(centroids) == np.repeat(np.arange(10), 400)[order]).all()
