import collections

import numpy as np

import corpus_pipeline
from leafquarry.llm import toxicity
from tests.llm.test_dedup_mixing import brute_targets

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(spark, folder):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, int(rng.integers(20, 200)))) for _ in range(60)]
    texts += [t.replace(" ", "\n") for t in texts[:6]] + [t + " tail" for t in texts[6:12] if len(t) > 400]
    # copies with words changed in the middle, some of them still similar
    texts += [" ".join(w if k % int(step) else "changed" for k, w in enumerate(t.split(), 1)) for t, step in zip(texts[40:60], rng.integers(20, 120, 20), strict=True)]
    texts += [t + " vile word" for t in texts[12:40]] + [None, ""]
    rows = [(i, t, "en", "abc"[i % 3], len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    marks = [(i, 1, int("vile" in (t or ""))) for i, t, *_ in rows if i % 7]
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_near_groups(texts):
    """For each text the first one that it is linked with, by exact similarity of distinct five-word shingles of 0.8 or more."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def test_run_against_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    rows = corpus(spark, folder)
    docs, marks = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, marks)
    scorer = toxicity.Scorer(model)
    clean = [r for r in rows if scorer.score(r[1]) < 0.5]
    assert [r for r in clean if "vile" not in (r[1] or "")] == [r for r in rows if "vile" not in (r[1] or "")]
    groups = collections.defaultdict(list)
    for r in clean:
        groups["".join((r[1] or "").split())].append(r)
    single = sorted(min(g, key=lambda r: (-len(r[1] or ""), r[0])) for g in groups.values())
    roots = brute_near_groups([r[1] for r in single])
    apart = [r for k, r in enumerate(single) if roots[k] == k]
    assert len(apart) < len(single) < len(clean) < len(rows)

    got = [r.doc_id for r in corpus_pipeline.run(spark, folder).collect()]
    by_source = collections.defaultdict(list)
    for r in apart:
        by_source[r[3]].append(r)
    size = {r[0]: len((r[1] or "").split()) for r in apart}
    sizes = [sum(size[r[0]] for r in by_source[s]) for s in sorted(by_source)]
    goals = brute_targets(sizes, [1, 2, 3])
    for source, goal in zip(sorted(by_source), goals, strict=True):
        mine = {r[0] for r in by_source[source]}
        assert abs(sum(size[i] for i in got if i in mine) - goal) <= 200
    assert set(got) <= set(size) and max(collections.Counter(got).values()) <= 3


def test_stages_on_empty_and_odd_tables(spark, tmp_path):
    folder = str(tmp_path)
    corpus(spark, folder)
    odd = [(None, None, None, None, None), (1, "a b", None, None, 3), (1, "a b", None, None, 3), (2, "", "en", "s", 0)]
    for rows in ([], odd):
        docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", h int")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            assert name == "bpe" or out.columns == docs.columns
            assert out.count() <= 3 * len(rows)
