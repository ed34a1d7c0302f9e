"""Virtual slots: even shards, places without gaps, maps that move little."""

from collections import defaultdict

from pyspark.sql import functions as F

from dwellspark.llm import sharding as S
from dwellspark.llm.queries import op11_slots


def spread(rows):
    sizes, places = defaultdict(int), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    return sizes


def test_query_is_even(spark):
    rows = op11_slots(spark, "/root/testdata/sf0.01").collect()
    sizes = spread(rows)
    assert len(rows) == 1000 and set(sizes) == set(range(40))
    largest = max(r.size for r in rows)
    assert max(sizes.values()) <= max(largest, sum(sizes.values()) / 40 * 1.02)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}


def made(spark, n=3000):
    """A third of all rows alike, some sizes far above others, null keys, a clashing column."""
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 50 == 1, None).otherwise(F.col("id")).alias("k"),
        F.when(F.col("id") % 3 == 0, F.lit(40)).otherwise(F.when(F.col("id") % 100 == 2, 3000).otherwise(F.col("id") % 90)).cast("long").alias("size"),
        F.lit("x").alias("slot"),
    )
    return df.repartition(5)


def test_equal_rows_are_dealt_out(spark):
    parts = S.slotted(made(spark), ["k"], piece=16)
    assert parts.where("k = 7").select("virtual_slot").distinct().count() > 40
    loads = S.slot_loads(parts)
    placed = S.place_rows(parts, S.first_map(loads, 8), ["k"], together=20).collect()
    assert sorted((r.k or -1, r.size) for r in placed) == sorted((r.k or -1, r.size) for r in made(spark).collect())
    sizes = spread(placed)
    assert max(sizes.values()) - min(sizes.values()) < 100


def test_maps_are_edited_by_version(spark, tmp_path):
    folder, rows = f"file://{tmp_path}/map", made(spark).where("k <> 7 OR k IS NULL")
    a = S.shard_rows(rows, 8, ["k"], folder=folder).collect()
    b = S.shard_rows(rows, 9, ["k"], folder=folder).collect()
    old, new = ({r.virtual_slot: r.shard for r in S.read_map(spark, folder, v).collect()} for v in (1, 2))
    assert len(old) == len(new) == S.SLOTS
    moved = {s for s in old if old[s] != new[s]}
    assert moved and {new[s] for s in moved} == {8}
    sizes = spread(b)
    assert max(sizes.values()) < sum(sizes.values()) / 9 * 1.1 and {r.version for r in a} == {1} and {r.version for r in b} == {2}
    # a third version for more rows of one shard
    hot = [s for s, k in new.items() if k == 0]
    grown = (F.col("size") < 90) & F.col("virtual_slot").isin(hot[:300])
    more = rows.unionByName(S.slotted(rows, ["k"]).where(grown).select("k", (F.col("size") * 30).alias("size"), F.lit("x").alias("slot")))
    sizes = spread(S.shard_rows(more, 9, ["k"], folder=folder).collect())
    assert max(sizes.values()) < sum(sizes.values()) / 9 * 1.2
    third = {r.virtual_slot: r.shard for r in S.read_map(spark, folder).collect()}
    assert 0 < sum(third[s] != new[s] for s in new) < 700


def test_nothing_to_place(spark):
    none = made(spark).limit(0)
    assert S.shard_rows(none, 8, ["k"]).count() == 0
    assert S.first_map(S.slot_loads(S.slotted(none, ["k"])), 8).groupBy("shard").count().count() == 8
