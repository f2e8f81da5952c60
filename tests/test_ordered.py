"""The ordered layout gives the same rows with whole keys and with keys split over chunks."""

import random

from pyspark.sql import functions as F

from lifecurve.operators.ordered import arrange


def hot_rows(spark):
    """One key holds most rows; values and order are shuffled."""
    rng = random.Random(5)
    rows = [("hot", i, rng.randint(0, 9)) for i in range(300)] + [(f"k{j}", i, rng.randint(0, 9)) for j in range(6) for i in range(10)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, t int, v int").repartition(5)


def expected(rows):
    groups = {}
    for k, t, v in sorted(rows):
        groups.setdefault(k, []).append((t, v))
    return groups


def test_position_running_attach_frames_carry(spark, layout):
    rows, df = hot_rows(spark)
    o = arrange(df, ["k"], ["t"]).position("pos").running(total=F.col("v")).attach(top=F.max("v"), n=F.count(F.lit(1)))
    o = o.frames(3, 2, near=lambda w: F.sum("v").over(w.rowsBetween(-3, 2)), prev=lambda w: F.lag("v").over(w))
    o = o.carried("seen", F.when(F.col("v") == 7, F.col("t"))).carried("next", F.when(F.col("v") == 7, F.col("t")), ahead=True)
    assert (o.chunk is not None) == (layout == "chunked")
    got = {(r.k, r.t): r for r in o.rows().collect()}
    assert len(got) == len(rows)
    for k, series in expected(rows).items():
        vs = [v for _, v in series]
        for i, (t, v) in enumerate(series):
            r = got[(k, t)]
            assert r.pos == i + 1
            assert r.total == sum(vs[: i + 1])
            assert (r.top, r.n) == (max(vs), len(vs))
            assert r.near == sum(vs[max(0, i - 3) : i + 3])
            assert r.prev == (vs[i - 1] if i else None)
            before = [x for x, y in series[: i + 1] if y == 7]
            after = [x for x, y in series[i:] if y == 7]
            assert r.seen == (before[-1] if before else None)
            assert r.next == (after[0] if after else None)


def test_chunks_spread_the_hot_key(spark):
    spark.conf.set("lifecurve.chunkRows", "25")
    try:
        _, df = hot_rows(spark)
        o = arrange(df, ["k"], ["t"])
        sizes = [r["count"] for r in o.df.where("k = 'hot'").groupBy(o.chunk).count().collect()]
        assert len(sizes) >= 6 and max(sizes) < 120
    finally:
        spark.conf.unset("lifecurve.chunkRows")


def test_whole_table_without_keys(spark, layout):
    _, df = hot_rows(spark)
    o = arrange(df, [], ["k", "t"]).position("pos").attach(n=F.count(F.lit(1)))
    rows = o.rows().orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(1, 361))
    assert {r.n for r in rows} == {360}
    assert [(r.k, r.t) for r in rows] == sorted((r.k, r.t) for r in rows)


def test_join_facts(spark, layout):
    _, df = hot_rows(spark)
    facts = spark.createDataFrame([("hot", 1.5), ("k1", 2.5)], "k string, f double")
    out = arrange(df, ["k"], ["t"]).join_facts(facts).rows()
    got = {r.k: r.f for r in out.select("k", "f").distinct().collect()}
    assert got["hot"] == 1.5 and got["k1"] == 2.5 and got["k2"] is None
    assert out.count() == 360


def test_bound_skips_counting(spark):
    _, df = hot_rows(spark)
    assert arrange(df, ["k"], ["t"], bound=360).chunk is None
