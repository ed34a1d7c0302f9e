"""Running sums over ranges against a plain sort."""

import random

from pyspark.sql import functions as F

from dwellspark.operators.ordering import Ranged, nearest_ranks, running_sum


def test_running_sum(spark):
    rows = [(i * 37 % 1000, i % 7 if i % 5 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(7)
    got = {r.k: (r.total, r.nth) for r in running_sum(running_sum(df, [F.desc("k")], F.col("v"), "total"), [F.desc("k")], name="nth", parts=16).collect()}
    total = 0
    for n, (k, v) in enumerate(sorted(rows, reverse=True), 1):
        total += v or 0
        assert got[k] == (total, n)


def test_ties_and_nothing(spark):
    df = spark.createDataFrame([(1,)] * 50, "k long")
    assert sorted(r.nth for r in running_sum(df, [F.col("k")], name="nth").collect()) == list(range(1, 51))
    assert running_sum(df.limit(0), [F.col("k")], name="nth").count() == 0


def skewed(spark, n=2000):
    """A third of all rows in one key, a null key, ties and nulls."""
    i = F.col("id")
    key = F.when(i % 3 == 0, "hot").when(i % 7 == 1, None).otherwise((i % 11).cast("string"))
    return spark.range(n).select(key.alias("k"), F.floor((i * 7919) % n / 3).alias("t"), i.alias("i"), F.when(i % 4 == 0, i).alias("v")).repartition(5)


def test_windows_by_ranges(spark):
    r = Ranged(skewed(spark), ["k"], ["t", "i"], 16).number("n").neighbour({"i": "next", "v": "next_v"}, True).neighbour({"i": "before"}, False).last({"v": "known"})
    sizes = [x["count"] for x in r.rows.groupBy("_part").count().collect()]
    assert len(sizes) > 12 and max(sizes) < 400  # 667 rows have one key
    got = {x.i: x for x in r.done().collect()}
    groups = {}
    for x in skewed(spark).collect():
        groups.setdefault(x.k, []).append(x)
    for rows in groups.values():
        rows.sort(key=lambda x: (x.t, x.i))
        known = None
        for n, x in enumerate(rows):
            known = known if x.v is None else x.v
            after = rows[n + 1] if n + 1 < len(rows) else None
            g = got[x.i]
            assert (g.n, g.next, g.next_v, g.before, g.known) == (n, after and after.i, after and after.v, rows[n - 1].i if n else None, known)
    assert Ranged(skewed(spark).limit(0), ["k"], ["t"]).number("n").last({"v": "w"}).done().count() == 0


def test_nearest_ranks(spark):
    rng = random.Random(4)
    rows = [("hot", rng.choice([0.5, 0.5 + 1e-9, rng.random(), -3.0, 1e300, -1e300, float("inf")])) for _ in range(2000)] + [("one", 7.0), ("ties", 1.0), ("ties", 1.0), ("null", None), (None, 2.0)]
    shares = {"low": 0.0, "mid": 0.5, "high": 0.8, "top": 1.0}
    got = {r.k: r for r in nearest_ranks(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", shares, salts=3).collect()}
    for k in ("hot", "one", "ties"):
        vs = sorted(v for g, v in rows if g == k)
        assert [got[k][s] for s in shares] == [vs[min(int(p * len(vs)), len(vs) - 1)] for p in shares.values()] and got[k].n == len(vs)
    assert "null" not in got
