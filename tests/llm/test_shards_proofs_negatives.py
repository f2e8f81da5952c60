"""Histogram sort, Merkle proofs and hard negatives against brute force, and on odd tables."""

import hashlib
import math
import random
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lifecurve.llm import hardnegatives, histsort, merkle
from lifecurve.llm.ranges import numbered
from lifecurve.session import materialize

# -- histogram sort


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_shards_of_the_fixture(spark, docs, rows):
    out = histsort.assign(docs).collect()
    assert len(out) == len(rows)
    assert {r["law"] for r in out} == {"bytes"} and {r["grown_shard"] for r in out} == {None}
    sizes = sorted((r["doc_id"] is None, r["doc_id"], r["size"], r["text_crc32"]) for r in out if r["doc_id"] is not None)
    want = sorted((False, r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows if r[0] is not None)
    assert sizes == want
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))


def test_shards_equal_a_sort(spark, tmp_path):
    """Boundaries lie within the tolerance of a whole sort's, or at the nearest row, with a group of a third of all rows."""
    rnd = random.Random(5)
    texts = ["hot copy " * 30] * 700 + [" ".join("abcdefgh"[rnd.randrange(8)] * 5 for _ in range(rnd.randrange(60))) for _ in range(1300)] + ["x" * 60_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/d")
    table = spark.read.parquet(f"{tmp_path}/d")
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in histsort.assign(table, shards=8).collect()}
    order = sorted((md5(t)[:16] + md5(str(k))[:16], k, len(t) + 16) for k, t in enumerate(texts))
    total, below, ends = sum(s for *_, s in order), 0, []
    for *_, s in order:
        below += s
        ends.append(below)
    shards = [got[k][0] for _, k, _ in order]
    assert shards == sorted(shards)
    for k in range(1, 8):
        cut = sum(s for (*_, s), shard in zip(order, shards, strict=True) if shard < k)
        nearest = min(abs(e - k * total / 8) for e in [0, *ends])
        assert abs(cut - k * total / 8) <= max(0.01 * total / 8, nearest)
    within = {}
    for (_, k, _), shard in zip(order, shards, strict=True):
        assert got[k][1] == within.get(shard, 0)
        within[shard] = within.get(shard, 0) + 1


def test_rows_equal_in_all_are_cut(spark, tmp_path):
    spark.createDataFrame([(None, "same text", 1)] * 800, "doc_id long, text string, slot int").repartition(4).write.parquet(f"{tmp_path}/d")
    table = spark.read.parquet(f"{tmp_path}/d")
    counts = [r["n_rows"] for r in histsort.shard_report(histsort.assign(table, shards=8)).collect()]
    assert sum(counts) == 800 and len(counts) == 8 and min(counts) >= 99 and max(counts) <= 101  # one per cent
    with pytest.raises(ValueError, match="slot"):
        histsort.sharded(table)
    whole = histsort.sharded(table, shards=8, names=("part", "place"))
    assert whole.columns == ["doc_id", "text", "slot", "part", "place"] and whole.count() == 800


def test_no_rows(spark, none):
    assert histsort.assign(none).count() == 0
    assert histsort.sharded(none).count() == 0
    assert merkle.manifest(none).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("0123456789abcdef~", max_size=4), max_size=20), st.text("0123456789abcdef", max_size=5))
def test_halving_counts_bounds(bounds, key):
    """``shard_of`` read as a decision tree gives the number of bounds not above the key."""
    bounds = sorted(bounds)

    def walk(part, first=0):
        if not part:
            return first
        mid = len(part) // 2
        return walk(part[:mid], first) if key < part[mid] else walk(part[mid + 1 :], first + mid + 1)

    assert walk(bounds) == bisect_right(bounds, key)


def test_numbers_within_groups(spark):
    rows = [(None if k % 3 == 0 else f"g{k % 5}", (k * 7919) % 101) for k in range(400)]
    table = materialize(spark.createDataFrame(rows, "g string, v int").repartition(6))
    got = {}
    for r in numbered(table, ["g"], ["v"], "place").collect():
        got.setdefault(r["g"], []).append((r["place"], r["v"]))
    for group, found in got.items():
        assert [v for _, v in sorted(found)] == sorted(v for g, v in rows if g == group)
        assert sorted(p for p, _ in found) == list(range(len(found)))


# -- Merkle proofs


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def said(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_manifest(rows):
    """doc_id -> leaf, subroot, root, proof, folded root; rows are (doc_id, text, lang, source, n_chars)."""

    def tree(level):
        levels = [level]
        while len(level) > 1:
            level = [H(*level[k : k + 2]) for k in range(0, len(level), 2)]
            levels.append(level)
        return levels

    def way(levels, i):
        return [(level[i >> h ^ 1] if i >> h ^ 1 < len(level) else None, i >> h & 1) for h, level in enumerate(levels[:-1])]

    leaf = lambda r, more=0: H(*map(said, (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])))
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs}
    trees = {g: tree([leaf(r) for r in own[g]]) for g in langs}
    upper = tree([trees[g][-1][0] for g in langs])
    out = []
    for rank, g in enumerate(langs):
        for i, r in enumerate(own[g]):
            steps = way(trees[g], i) + way(upper, rank)
            altered = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            digest = leaf(r, 1 if altered else 0)
            for other, odd in steps:
                digest = H(digest) if other is None else H(other, digest) if odd else H(digest, other)
            root = upper[-1][0]
            out.append((r[0], leaf(r), trees[g][-1][0], root, H(*(s for s, _ in steps if s)), digest, digest == root))
    return out


def order(found):
    return sorted(found, key=repr)


def test_manifest_of_the_fixture(docs, rows):
    got = [tuple(r) for r in merkle.manifest(docs).collect()]
    assert order(got) == order(brute_manifest([r[:5] for r in rows]))
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n, langs", [(1, ["a"]), (2, ["a", None]), (3, ["a"]), (70, ["a"]), (300, ["a", None]), (70, [None, "b", "é", "zz", "Z"]), (70, [f"l{k}" for k in range(70)])])
def test_manifest_of_any_shape(spark, n, langs):
    """Few and many groups, from one row on, with blocks of two levels so that trees need several rounds."""
    rows = [(k, f"text {k}", langs[0 if k % 3 else (k // 3) % len(langs)], None, k if k % 4 else None) for k in range(n)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert order(map(tuple, merkle.manifest(table, block_levels=2).collect())) == order(brute_manifest(rows))


def test_a_tampered_row_is_found(spark):
    rows = [(k, f"text {k}", "en", "s", 10) for k in range(50)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    bad = {r["doc_id"] for r in merkle.manifest(table).collect() if not r["verified"]}
    assert bad == {k for k in range(50) if zlib.crc32(str(k).encode()) % 7 == 0} and bad


# -- hard negatives


def brute_negatives(rows, anchor_every=50):
    """Rows of (vec_id, vector, label) as lists."""
    fine = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    fine = [(i, v, (y + 1) % 10 if i is not None and i % 7 == 0 else y) for i, v, y in fine]
    last = lambda i: (i is None, i or 0)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for at, (i, v, y) in enumerate(fine):
        if i is None or i % anchor_every:
            continue
        scored = sorted(((-dot(v, w), last(j), k, j, z) for k, (j, w, z) in enumerate(fine) if k != at))
        for neg, _, _, p, _ in [s for s in scored if s[-1] == y][:5]:
            ps = -neg
            fits = [(j, -n) for n, _, _, j, z in scored if z != y and 50 * ps <= -100 * n <= 95 * ps][:3]
            out += [(i, p, r + 1, j, ps, s) for r, (j, s) in enumerate(fits)]
    return out


def vectors(n=1500, seed=1):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(12, 16))
    rows = []
    for k in range(n):
        c = rnd.integers(12)
        v = centres[c] * rnd.uniform(0.2, 3) + rnd.normal(size=16) * rnd.choice([0.05, 0.5])
        rows.append((k, [float(np.float32(x)) for x in v], int(c % 10) if k % 3 else 4))
    rows += [(5000, None, 1), (5050, [1.0] * 16, None), (5100, [float("nan")] * 16, 2), (5150, [float("inf")] + [0.0] * 15, 2), (5200, [None] + [0.0] * 15, 2)]
    rows += [(5250, [0.0] * 16, 3), (5300, [0.5, 0.25], 3), (5350, [], 3), (50, rows[50][1], 4), (None, rows[100][1], 4), (6000, rows[3][1], 7), (6001, rows[3][1], 8)]
    return rows


SHAPE = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("options", [{}, {"block_rows": 64, "group_blocks": 1}, {"references": 2, "block_rows": 300}])
def test_negatives_equal_brute_force(spark, options):
    rows = vectors()
    table = spark.createDataFrame(rows, SHAPE).repartition(5)
    got = [tuple(r) for r in hardnegatives.mine(table, **options).collect()]
    want = brute_negatives(rows)
    assert len(want) > 100 and order(got) == order(want)


def test_negatives_of_few_rows(spark):
    assert hardnegatives.mine(spark.createDataFrame([], SHAPE)).count() == 0
    assert hardnegatives.mine(spark.createDataFrame([(50, [1.0, 2.0], 1)], SHAPE)).count() == 0
    assert hardnegatives.mine(spark.createDataFrame([(50, [0.0], 1), (51, [0.0], 1), (52, [0.0], 2)], SHAPE)).count() == 1
    rows = [(50, [1e30, 0.0], 1), (51, [1e30, 1.0], 1), (52, [8e29, 0.0], 2)]
    assert hardnegatives.mine(spark.createDataFrame(rows, SHAPE)).count() == 0  # both scores are the largest there is


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 40), st.floats(1e-3, 1e3))
def test_bounds_hold(seed, width, scale):
    rnd = np.random.default_rng(seed)
    rows = hardnegatives.integers(rnd.normal(size=(20, width)) * scale * rnd.choice([0, 1], (20, width), p=[0.2, 0.8]))
    refs = rnd.normal(size=(4, width))
    refs /= np.sqrt((refs**2).sum(axis=1))[:, None]
    to, long_ = hardnegatives.angles(rows, refs), hardnegatives.norms(rows)
    both = long_[:, None] * long_[None, :]
    low, high = hardnegatives.score_bounds(*hardnegatives.angle_bounds(to, to), both, both)
    scores = hardnegatives.products(rows, rows)
    assert (scores == [[sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for b in rows] for a in rows]).all()
    assert (low <= scores).all() and (scores <= high).all()


def test_components_of_any_size():
    rows = [[0.5, -0.25], [], [2.0**55, 1.0], [1e30, -1e-9], [3.4e38, 0.0]]
    got = hardnegatives.integers(hardnegatives.matrix(pa.array(rows, pa.list_(pa.float64()))))
    want = [[math.floor(x * 256) if abs(x) < 1e15 else int(x) * 256 for x in r] + [0] * (2 - len(r)) for r in rows]
    assert got.tolist() == want
    most = (1 << 63) - 1
    assert hardnegatives.products(got, got)[3].tolist() == [most, 0, most, most, most]
