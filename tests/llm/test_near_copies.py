"""The stage near_copies finds what brute force finds at Jaccard 0.8 over five words."""

import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from lifecurve.llm import nearcopies

WORDS = [f"word{k}" for k in range(500)]


def shingled(text):
    words = "".join(c.lower() if c.isascii() else c for c in text).split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rnd, words, n):
    out = list(words)
    for k in rnd.sample(range(len(out)), n):
        out[k] = rnd.choice(WORDS)
    return out


def corpus():
    """Documents with copies of 1 to 8 changed words, one large group, null and empty texts."""
    rnd = random.Random(3)
    texts = []
    for _ in range(60):
        base = [rnd.choice(WORDS) for _ in range(rnd.randrange(60, 300))]
        texts += [" ".join(base)] + [" ".join(edited(rnd, base, rnd.randrange(1, 9))) for _ in range(3)]
    hot = [rnd.choice(WORDS) for _ in range(150)]
    texts += [" ".join(edited(rnd, hot, rnd.randrange(0, 7))).upper() for _ in range(120)]
    return [*texts, None, "", " \t", "a b c", "A  b c", "a b d"]


@pytest.fixture(scope="module")
def near(spark, tmp_path_factory):
    texts = corpus()
    path = tmp_path_factory.mktemp("near")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    sets = [shingled(t or "") for t in texts]
    pairs = {(a, b) for a, b in combinations(range(len(sets)), 2) if likeness(sets[a], sets[b]) >= 0.8}
    root = list(range(len(sets)))
    for a, b in sorted(pairs) * 9:
        low = min(root[a], root[b])
        root = [low if r in (root[a], root[b]) else r for r in root]
    return spark.read.parquet(f"{path}/documents.parquet"), pairs, root


def test_stage_equals_brute_force(spark, near):
    docs, pairs, root = near
    assert len(pairs) > 500
    stay = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert stay == set(root)


def test_recall_of_candidates(near):
    _, pairs, _ = near
    texts = corpus()
    low = [nearcopies.minima(nearcopies.shingle_set(t or "")).reshape(nearcopies.BANDS, nearcopies.EACH) for t in texts]
    found = [(low[a] == low[b]).all(axis=1).any() and (low[a] & 1 != low[b] & 1).sum() <= nearcopies.radius() for a, b in pairs]
    print(f"recall {sum(found)} of {len(found)}")
    assert all(found)


@pytest.mark.parametrize("limit", [2, 1000])
def test_pair_limit_does_not_matter(near, limit):
    docs, _, root = near
    assert {r["doc_id"] for r in nearcopies.one_of_each(docs, pair_limit=limit).collect()} == set(root)


def test_no_rows(none):
    assert nearcopies.one_of_each(none).count() == 0


def test_jaccard():
    a, b = np.array([1, 2, 3], np.uint64), np.array([2, 3, 4], np.uint64)
    assert nearcopies.jaccard(a, b) == 0.5 and nearcopies.jaccard(a[:0], a[:0]) == 1 and nearcopies.jaccard(a[:0], a) == 0


def passage_corpus(n=2000):
    """Texts that share one passage and differ in the rest: their sets meet in large buckets, no two are near copies."""
    rnd = random.Random(9)
    passage = " ".join(rnd.choice(WORDS) for _ in range(44))
    return [f"{passage} " + " ".join(f"own{k}x{j}" for j in range(14)) for k in range(n)]


def test_a_shared_passage_does_not_make_the_square(spark, tmp_path, monkeypatch):
    texts = passage_corpus() + [t.replace("x3 ", "x3y ") for t in passage_corpus(20)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    met = []
    real = nearcopies.prefix_pairs

    def counted(nodes, said, alike, **options):
        out = real(nodes, said, alike, **options)
        met.append((nodes.select("node").distinct().count(), out.count()))
        return out

    monkeypatch.setattr(nearcopies, "prefix_pairs", counted)
    stay = {r["doc_id"] for r in nearcopies.one_of_each(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    sets = [shingled(t) for t in texts]
    twins = {2000 + k for k in range(20) if likeness(sets[k], sets[2000 + k]) >= 0.8}
    assert stay == set(range(2020)) - twins
    assert met[0][0] > 1000 and met[0][1] < 100


def test_prefixes_find_all_pairs(spark):
    """On small words, so that the frequent shingles are many: all pairs of other roots that brute force finds."""
    rnd = random.Random(11)
    texts = []
    for _ in range(25):
        base = [rnd.choice(WORDS[:12]) for _ in range(rnd.randrange(5, 60))]
        texts += [" ".join(base)] + [" ".join(edited(rnd, base, rnd.randrange(0, 4))) for _ in range(8)]
    sets = [shingled(t) for t in texts]
    want = {(a, b) for a, b in combinations(range(len(sets)), 2) if likeness(sets[a], sets[b]) >= 0.8 and a % 2 != b % 2}
    said = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    nodes = spark.createDataFrame([(k, k % 2, len(s)) for k, s in enumerate(sets)], "node long, root long, size long")
    found = {tuple(r) for r in nearcopies.prefix_pairs(nodes, said, nearcopies.F.lit(True)).collect()}
    assert len(want) > 50 and want <= found


def test_stage_links_by_operator_4(spark, near, monkeypatch):
    """The generalised pigeonhole of operator 4 gives candidates: all pairs within its distance, and they alone connect near copies."""
    docs, _, _ = near
    texts = corpus()
    fps = [nearcopies.simhash.fingerprint(t or "", nearcopies.WORDS_EACH) for t in texts]
    nodes = spark.createDataFrame([(k, int(np.uint64(f).astype(np.int64))) for k, f in enumerate(fps)], "_row long, fp long")
    root = list(range(len(fps)))
    for a, b in [tuple(r) for r in nearcopies.fingerprint_pairs(nodes).collect()] * 9:
        low = min(root[a], root[b])
        root = [low if r in (root[a], root[b]) else r for r in root]
    want = {(a, b) for a, b in combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= nearcopies.MAX_DISTANCE}
    assert len(want) > 20 and all(root[a] == root[b] for a, b in want)
    called = []
    real = nearcopies.simhash.links
    monkeypatch.setattr(nearcopies.simhash, "links", lambda *a: called.append(1) or real(*a))
    corpus_pipeline.near_copies(spark, docs, "")
    assert called


def test_picked_nodes_change_no_result(spark, tmp_path, monkeypatch):
    """A large group whose smallest nodes are below 0.8 to the others."""
    rnd = random.Random(4)
    base = [f"own{k}" for k in range(150)]
    texts = []
    for k in range(400):
        words = list(base)
        for j in rnd.sample(range(150), 3 if k < 12 else 1):
            words[j] = f"new{k}x{j}"
        texts.append(" ".join(words))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stay = {r["doc_id"] for r in nearcopies.one_of_each(docs).collect()}
    monkeypatch.setattr(nearcopies, "PIVOT_ROUNDS", 0)
    assert stay == {r["doc_id"] for r in nearcopies.one_of_each(docs).collect()}
