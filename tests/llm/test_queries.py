"""The registered queries themselves: whole small tables, empty tables, odd rows; fingerprints by brute force."""

import hashlib
import zlib

import pytest
import xxhash

from leafquarry.llm.registry import ORACLE_SQL, QUERIES

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string"
ODD = [(0, "A b c d", "x"), (1, None, None), (2, "", "x"), (None, "no id", "x"), (4, "Same text here", "y"), (4, "Same text here", "y"), (5, "same  text here", "y"), (6, "word " * 30_000, None), (7, "é 😀\n\t x", "x")]
COLUMNS = {
    "op1_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op2_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op3_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op4_secrets": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op5_quality": {"doc_id", "held_out", "score", "predicted"},
    "op6_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op7_language_model": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op8_html": {"page_id", "url", "text", "n_chars"},
    "op9_simhash": {"doc_id", "fingerprint", "component_id"},
    "op10_jpeg": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
    "op11_prefix_trie": {"conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"},
    "op12_multiset_hash": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op13_ball_tree": {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"},
}


def write(spark, folder, docs, labels=()):
    spark.createDataFrame([(d, t, "en", s, len(t or ""), "own") for d, t, s in docs], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(d, None, t) for d, t, _ in docs], "page_id bigint, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(d, k, s, t) for k, (d, t, s) in enumerate(docs)], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame([(d, [float(k)] * 64) for k, (d, _, _) in enumerate(docs)], "vec_id bigint, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")


def test_registry():
    assert set(COLUMNS) == set(QUERIES) and set(ORACLE_SQL) <= set(QUERIES)


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    odd, none = (str(tmp_path_factory.mktemp(n)) for n in ("odd", "none"))
    write(spark, odd, ODD, [(k, k % 2, k % 2) for k in range(8)])
    write(spark, none, [])
    return odd, none


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, folders, name):
    got = QUERIES[name](spark, folders[0])
    assert COLUMNS[name] <= set(got.columns)
    rows = got.collect()
    key = {"op8_html": "page_id", "op13_ball_tree": "vec_id"}.get(name, "doc_id")
    assert name == "op11_prefix_trie" or sorted(str(r[key]) for r in rows) == sorted(str(d) for d, _, _ in ODD)
    assert QUERIES[name](spark, folders[1]).count() == 0
    modulus, rest = {"op1_toxicity": (5, 0), "op5_quality": (3, 1), "op7_language_model": (7, 2)}.get(name, (0, 0))
    for r in rows if modulus else ():
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % modulus == rest)
        assert name == "op7_language_model" or 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_media(spark, folders):
    got = {r.doc_id: r for r in QUERIES["op10_jpeg"](spark, folders[0]).collect()}
    for d, t, _ in ODD:
        raw = (t or "").encode()
        payload = raw + b"\0" * (64 if not raw else -len(raw) % 64)
        assert (got[d].n_bytes, got[d].payload_bytes, got[d].payload_sha256, got[d].tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert (got[1].media_sha256, got[1].feature) == (got[2].media_sha256, got[2].feature)


def brute_print(text):
    words = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_by_brute_force(spark, folders):
    rows = QUERIES["op9_simhash"](spark, folders[0]).collect()
    prints = {d: brute_print(t) for d, t, _ in ODD}
    for r in rows:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}"
        assert r.component_id == min((d for d in prints if d is not None and (prints[d] ^ prints[r.doc_id]).bit_count() <= 2), default=None)


def test_near_copies_are_caught(spark):
    """Of random texts with edits, every pair of five-word similarity 0.8 or more is linked, and no clean one goes."""
    import numpy as np

    from leafquarry.llm import simhash

    rng = np.random.default_rng(9)
    words = np.array([f"w{k}" for k in range(5000)])
    texts, near = [], 0
    for k in range(300):
        base = list(rng.choice(words, int(rng.integers(60, 900))))
        texts.append(base)
        if k % 2:
            edit = list(base)
            for at in rng.integers(0, len(base), int(rng.integers(1, max(2, len(base) // 50)))):
                edit[int(at)] = f"edit{k}"
            a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (base, edit))
            near += len(a & b) >= 0.8 * len(a | b)
            texts.append(edit)
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 0, "") for i, t in enumerate(texts)], DOCS)
    assert near > 100 and simhash.keep_one(docs).count() == len(texts) - near
