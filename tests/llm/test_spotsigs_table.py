"""The comparison of fingerprints over a whole table finds what brute force finds."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from lifecurve.llm import spotsigs


def corpus():
    rnd = random.Random(4)
    words = [f"word{k}" for k in range(300)] + ["the", "of", "and", "der", "la"] * 40
    texts = []
    for _ in range(60):
        base = [rnd.choice(words) for _ in range(rnd.randrange(30, 250))]
        texts.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            for k in rnd.sample(range(len(copy)), rnd.randrange(0, 4)):
                copy[k] = rnd.choice(words)
            texts.append(" ".join(copy))
    hot = [rnd.choice(words) for _ in range(120)]
    texts += [" ".join(hot[: 119 - k % 5]) for k in range(60)]
    return [*texts, None, "", " ", "no anchor here", "No anchor here", "the", "the"]


def test_similar_documents_equal_brute_force(spark):
    texts = corpus()
    sets = [frozenset(spotsigs.spots(t or "").tolist()) for t in texts]
    like = lambda a, b: len(a & b) / len(a | b)
    distinct = sorted(set(sets), key=sorted)
    links = {(a, b) for a, b in combinations(range(len(distinct)), 2) if like(distinct[a], distinct[b]) >= 0.8}
    assert len(links) > 40
    root = list(range(len(distinct)))
    for a, b in sorted(links) * 9:
        low = min(root[a], root[b])
        root = [low if r in (root[a], root[b]) else r for r in root]
    group = {s: root[k] for k, s in enumerate(distinct)}
    first = {}
    for k, s in enumerate(sets):
        first.setdefault(group[s], k)
    degree = {s: sum(k in pair for pair in links) for k, s in enumerate(distinct)}
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in spotsigs.similar_documents(table).collect()}
    assert got == {k: (first[group[s]], degree[s]) for k, s in enumerate(sets)}


def test_classes_are_the_helper_s(spark):
    sizes = spark.range(1, 3000).select(F.floor(F.log(F.col("id").cast("double")) / F.lit(-float(spotsigs.np.log(0.8))) + 1e-9).cast("int").alias("c"), "id")
    assert all(r["c"] == spotsigs.length_class(r["id"]) for r in sizes.collect())


def test_no_rows(none):
    assert spotsigs.similar_documents(none).count() == 0
