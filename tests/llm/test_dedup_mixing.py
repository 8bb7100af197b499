import hashlib
import itertools

import numpy as np
import pytest

from leafquarry.llm import exact_dedup, mixing, simhash
from leafquarry.llm.common import new_folder

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, label string, `c0` string"


def table(spark, rows):
    """rows of (doc_id, text, source), with a column whose name clashes with internal ones."""
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), "x", "y") for d, t, s in rows], SCHEMA)


ODD = [(1, "a b", "s1"), (2, "ab ", "s1"), (3, None, None), (4, "", "s2"), (None, "a b", "s2"), (5, "a  b", "s1"), (5, "a  b", "s1"), (7, "w " * 5000, None)]


@pytest.fixture
def index(spark):
    return exact_dedup.DigestIndex(spark, new_folder(spark, "index"), 3)


def test_exact_groups(spark, index):
    rows = {(r.doc_id, r.kept): r for r in exact_dedup.classify(table(spark, ODD), index).collect()}
    assert rows[5, True].group_size == 5 and rows[5, False].keep_id == 5
    assert rows[1, False].keep_id == 5 and rows[None, False].keep_id == 5
    assert rows[3, True].keep_id == 3 and rows[4, False].keep_id == 3
    assert rows[7, True].group_size == 1


def test_exact_keep_first(spark, index):
    kept = exact_dedup.keep_first(table(spark, ODD), index)
    assert kept.columns == table(spark, ODD).columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 5, 7]
    later = exact_dedup.keep_first(table(spark, [(8, "ab", "s"), (9, "new", "s")]), index)
    assert [r.doc_id for r in later.collect()] == [9]


def test_exact_index_reopened(spark):
    """Another session with other settings and an empty catalog finds every known text again."""
    path = new_folder(spark, "index")
    known = table(spark, [(i, f"text {i}", "s") for i in range(200)])
    first = exact_dedup.DigestIndex(spark, path, 8)
    assert exact_dedup.keep_first(known, first).count() == 200
    first.drop()
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        with pytest.raises(ValueError, match="8 buckets"):
            exact_dedup.DigestIndex(spark, path, 3)
        again = exact_dedup.DigestIndex(spark, path)
        assert again.n_buckets == 8 and exact_dedup.keep_first(known, again).count() == 0
        rows = exact_dedup.classify(known.union(table(spark, [(300, "new", "s"), (301, "text  7", "s")])), again).collect()
        assert [r.doc_id for r in rows if r.kept] == [300]
        assert {r.doc_id: (r.keep_id, r.group_size) for r in rows}[301] == (7, 2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_exact_in_batches_against_brute_force(spark, index):
    """Hot groups, repeated keepers, and longer texts among equal ones."""
    rng = np.random.default_rng(7)
    rows = [(int(rng.integers(0, 900)), "a b" if k < 700 else " " * int(rng.integers(0, 4)) + f"t{k % 90}", "s") for k in range(1500)]
    rows += [(1, "a b  ", "s")] * 30
    groups = {}
    for d, t, _ in rows:
        groups.setdefault("".join((t or "").split()), []).append((-len(t), d))
    want = sorted((d, min(g)[1], len(g)) for g in groups.values() for _, d in g)
    got = exact_dedup.classify_whole(table(spark, rows), index).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    assert sorted((r.doc_id, r.text_sha256) for r in got if r.kept) == sorted((min(g)[1], hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items())
    assert exact_dedup.classify_whole(table(spark, []), exact_dedup.DigestIndex(spark, new_folder(spark, "index"), 3)).count() == 0


def test_exact_many_copies_of_a_row(spark, index, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BLOCK", 7)
    got = exact_dedup.classify(table(spark, [(1, "x", "s")] * 50 + [(2, "x", "s")]), index).collect()
    assert len(got) == 51 and sum(r.kept for r in got) == 1 and {r.group_size for r in got} == {51}


def test_exact_empty(spark, index):
    assert exact_dedup.classify(table(spark, []), index).count() == 0
    assert exact_dedup.keep_first(table(spark, []), index).count() == 0


def brute_targets(sizes, weights):
    total, live, out = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    for i in live:
        out[i] = total * weights[i] / sum(weights)
    while over := [i for i in live if out[i] > 3 * sizes[i] + 1e-9]:
        for i in over:
            out[i] = 3 * sizes[i]
            live.remove(i)
        for i in live:
            out[i] = (total - sum(3 * sizes[k] for k in range(len(sizes)) if k not in live)) * weights[i] / sum(weights[k] for k in live)
    return out


def test_mixing(spark):
    rng = np.random.default_rng(3)
    counts = {"a": 400, "b": 3, "c": 40, None: 5, "d": 300}
    rows = [(i, "w " * int(rng.integers(0, 30)), s) for i, s in enumerate(itertools.chain.from_iterable([s] * n for s, n in counts.items()))]
    docs = table(spark, rows)
    thin = mixing.sized(docs)
    plan = {r.source: r for r in mixing.thresholds(thin).collect()}
    order = ["a", "b", "c", "d", None]
    sizes = [sum(len(t.split()) for _, t, s in rows if s == k) for k in order]
    wanted = brute_targets(sizes, [1, 2, 3, 1, 2])
    assert [plan[k].target for k in order] == pytest.approx(wanted)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    taken = {k: 0 for k in order}
    for r in mixed.collect():
        taken[r.source] += len(r.text.split())
    for k, goal in zip(order, wanted, strict=True):
        assert abs(taken[k] - goal) <= 15
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, mixed.collect()))


def test_mixing_odd(spark):
    assert mixing.mix(table(spark, [])).count() == 0
    assert mixing.mix(table(spark, [(1, None, None), (2, "", "s")])).count() == 0
    assert mixing.thresholds(mixing.sized(table(spark, ODD))).count() == 3


def brute_components(prints, radius):
    root = {i: i for i in range(len(prints))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if sum((a ^ b).bit_count() for a, b in zip(prints[i], prints[j], strict=True)) <= radius:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize(("words", "radius"), [(1, 2), (1, 0), (4, 44)])
def test_simhash_components(spark, words, radius, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 20)
    rng = np.random.default_rng(5)
    base = [[int(x) for x in rng.integers(0, 2**63, words)] for _ in range(40)]
    prints = []
    for b in base:
        for _ in range(4):
            p = list(b)
            for bit in rng.integers(0, 64 * words, rng.integers(0, max(2, radius))):
                p[bit // 64] ^= 1 << int(bit % 64)
            prints.append([x & (2**64 - 1) for x in p])
    signed = [[x - 2**64 if x >= 2**63 else x for x in p] for p in prints]
    df = spark.createDataFrame([(i, i, *p) for i, p in enumerate(signed)], "doc_id bigint, t bigint, " + ", ".join(f"f{k} bigint" for k in range(words)))
    nodes, keys = simhash.grouped(df, radius, words)
    root = {tuple(r[k] for k in keys): r.root for r in nodes.collect()}
    names, got = {}, []
    for i, p in enumerate(signed):
        got.append(names.setdefault(root[tuple(p)], i))
    assert got == brute_components(prints, radius)


def test_simhash_texts(spark):
    long = " ".join(f"w{i}" for i in range(900))
    rows = [(4, long, "s"), (2, long + " Extra", "s"), (3, None, "s"), (9, " ", "s"), (None, "lone words", "s"), (8, "A B", "s"), (8, "a b", "s")]
    docs = table(spark, rows)
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert {(3, 3), (9, 3), (None, None), (8, 8)} <= got
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 3, 8]
    assert simhash.near_duplicates(table(spark, [])).count() == simhash.keep_one(table(spark, [])).count() == 0


def test_shingles():
    assert simhash.fingerprint(b"") == [0]
    assert simhash.fingerprint("Éa B c".encode()) == simhash.fingerprint("Éa b C".encode())
    assert len(simhash.shingle_hashes(b"a b c d", 3)) == 2


def jaccard_kept(texts, least=0.8):
    """Brute force: of each component of texts with that five-word Jaccard similarity the first."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return [i for i, r in enumerate(root) if r == i]


@pytest.mark.parametrize("tile", [16, 8192])
def test_keep_one_is_exact(spark, monkeypatch, tile):
    """Repeated lines do not link texts; pairs on both sides of the limit fall on their side."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(3)
    fresh = iter(range(10**6))

    def words(n):
        return [f"w{next(fresh)}" for _ in range(n)]

    line = words(10)
    texts = []
    for _ in range(6):  # one line twenty times among 220 words of its own
        own = words(220)
        texts.append(sum((own[11 * k : 11 * k + 11] + line for k in range(20)), []))
    for tail in (4, 10, 20, 24, 25, 26, 30, 40, 60):  # 100 shingles against 100 + tail: at the limit where tail is 25
        base = words(104)
        texts += [base, base + words(tail)]
    hub = words(204)  # a dense group and a chain that leaves it step by step
    for k in range(20):
        at = int(rng.integers(0, 200))
        texts.append(hub[:at] + words(1) + hub[at + 1 :])
    for k in range(0, 100, 15):
        texts.append(hub[k:] + words(k))
    texts = [" ".join(t) for t in texts]
    kept = simhash.keep_one(table(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    assert sorted(r.doc_id for r in kept.collect()) == jaccard_kept(texts)


@pytest.mark.parametrize("few", [50_000, 0])
def test_mixing_repeated_rows(spark, tmp_path, monkeypatch, few):
    """Equal rows are taken one by one: each source comes within one document of its target, in the query, its SQL and the mixed table."""
    import duckdb

    monkeypatch.setattr(mixing, "FEW", few)
    monkeypatch.setattr(mixing, "BLOCK", 100)
    rows = [(1, "w " * 10, "a")] * 900 + [(k, "v " * 10, "a") for k in range(2, 112)] + [(k, "u " * 10, "b") for k in range(200, 240)] + [(300, "x", None)] * 3
    docs = table(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op2_mixing(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    wanted = duckdb.sql(mixing.OP2_SQL).fetchall()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got) == sorted(wanted)
    mixed = [r.source for r in mixing.mix(docs).collect()]
    for source, words in (("a", 10), ("b", 10), (None, 1)):
        first = next(r for r in got if (r.source_size == {"a": 10_100, "b": 400, None: 3}[source]))
        taken = sum(r.taken for r in got if r.source_size == first.source_size)
        assert abs(taken - first.target) <= words and mixed.count(source) * words == taken
