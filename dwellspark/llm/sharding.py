"""Sharding by fixed virtual slots: records hash to slots, slots go to shards.

A record's slot never changes; only the map from slots to shards does, so growing or
rebalancing moves whole slots. Maps are tables ``(version, virtual_slot, shard, bytes)``
of one row a slot, made from the slots' bytes and stored by version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import exists
from .store import cut, drop

#: virtual slots; equal rows that hash together; rows that are numbered together
SLOTS, PIECE, TOGETHER = 4096, 1024, 65_536


def slotted(rows: DataFrame, keys: list[str], size: str = "size", slots: int = SLOTS, piece: int = PIECE) -> DataFrame:
    """Pieces ``(keys, size, piece, rows, virtual_slot)``: of equal rows at most ``piece``
    together, hashed by keys, size and the piece's number, so that a row that stands
    very often goes to many slots. Nulls hash as empty strings."""
    alike = rows.groupBy(*keys, size).agg(F.count("*").alias("_n"))
    parts = alike.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(piece).cast("long"))))
    text = F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*keys, size, "piece")))
    number = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % slots
    return parts.select(*keys, size, "piece", F.least(F.col("_n") - F.col("piece"), F.lit(piece)).alias("rows"), number.alias("virtual_slot"))


def slot_loads(parts: DataFrame, size: str = "size", slots: int = SLOTS) -> DataFrame:
    """``(virtual_slot, rows, bytes)`` of all slots, empty ones too."""
    sums = parts.groupBy("virtual_slot").agg(F.sum("rows").alias("rows"), F.sum(F.col("rows") * F.col(size)).alias("bytes"))
    every = parts.sparkSession.range(slots).withColumnRenamed("id", "virtual_slot")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return every.join(sums, "virtual_slot", "left").select("virtual_slot", zero("rows"), zero("bytes"))


def _shards(shards: int) -> Column:
    """(bytes, slots, shard) of each shard, still empty."""
    zero = F.lit(0).cast("long")
    return F.array(*(F.struct(zero.alias("bytes"), zero.alias("slots"), F.lit(k).alias("shard")) for k in range(shards)))


def _moved(loads: Column, shard: Column, sign: int, amount: Column) -> Column:
    """``loads`` with a slot of so many bytes more (or less) in one shard."""
    new = lambda s: F.struct((s["bytes"] + sign * amount).alias("bytes"), (s["slots"] + sign).alias("slots"), s["shard"].alias("shard"))
    return F.transform(loads, lambda s: F.when(s["shard"] == shard, new(s)).otherwise(s))


def first_map(loads: DataFrame, shards: int) -> DataFrame:
    """Version 1: slots by falling bytes, each to the shard with the least so far (of
    equal ones that with fewer slots, then the first). One row folds over all
    slots; their number is fixed, whatever the data."""
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot")))
    place = F.struct(_shards(shards).alias("loads"), F.array().cast("array<int>").alias("placed"))

    def step(acc, x):
        # the least is bound by a transform of one element, so it is sought once
        to = F.array(F.array_min(acc["loads"]))
        loads = F.transform(to, lambda m: _moved(acc["loads"], m["shard"], 1, -x["less"]))
        return F.struct(loads[0].alias("loads"), F.concat(acc["placed"], F.transform(to, lambda m: m["shard"])).alias("placed"))

    one = loads.agg(ordered.alias("slots")).withColumn("done", F.aggregate("slots", place, step))
    both = F.explode(F.arrays_zip("slots", F.col("done.placed").alias("shard"))).alias("p")
    return one.select(both).select(F.lit(1).alias("version"), F.col("p.slots.virtual_slot").alias("virtual_slot"), "p.shard", (-F.col("p.slots.less")).alias("bytes"))


def next_map(old: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The version after ``old``, for the slots' present bytes and so many shards (not
    fewer than before): slots by falling bytes move from shards above the mean to
    the one with the least, where that stays at or below the mean and the shard
    they leave at or above it. All other slots stay."""
    now = old.select("version", "virtual_slot", "shard").join(loads.select("virtual_slot", "bytes"), "virtual_slot")
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot", "shard")))
    one = now.agg(ordered.alias("slots"), (F.max("version") + 1).alias("version"), F.ceil(F.sum("bytes") / shards).alias("mean"))
    full = F.aggregate("slots", _shards(shards), lambda acc, x: _moved(acc, x["shard"], 1, -x["less"]))

    def step(acc, x):
        least = F.array_min(acc["loads"])
        here = F.filter(acc["loads"], lambda s: s["shard"] == x["shard"])[0]
        goes = (least["bytes"] - x["less"] <= F.col("mean")) & (here["bytes"] + x["less"] >= F.col("mean")) & (x["less"] < 0)
        to = F.array(F.when(goes, least["shard"]).otherwise(x["shard"]))
        loads = F.transform(to, lambda t: _moved(_moved(acc["loads"], x["shard"], -1, -x["less"]), t, 1, -x["less"]))
        return F.struct(loads[0].alias("loads"), F.concat(acc["placed"], to).alias("placed"))

    start = F.struct(F.col("full").alias("loads"), F.array().cast("array<int>").alias("placed"))
    one = one.withColumn("full", full).withColumn("done", F.aggregate("slots", start, step))
    both = F.explode(F.arrays_zip("slots", F.col("done.placed").alias("shard"))).alias("p")
    return one.select("version", both).select("version", F.col("p.slots.virtual_slot").alias("virtual_slot"), "p.shard", (-F.col("p.slots.less")).alias("bytes"))


def save_map(slot_map: DataFrame, folder: str) -> None:
    """Store a map as its version's folder; an earlier version is never changed."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(folder)


def read_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A stored map: that version, or the last."""
    maps = spark.read.parquet(folder)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == version).select("version", "virtual_slot", "shard", "bytes")


def place_rows(parts: DataFrame, slot_map: DataFrame, keys: list[str], size: str = "size", together: int = TOGETHER) -> DataFrame:
    """One row for each row of the table: its keys and size, ``virtual_slot``, ``shard``
    and ``slot``, its number within the shard, without gaps from 0.

    Slots are split by hash into buckets of about ``together`` rows; rows are numbered
    inside, behind the rows of all buckets of the shard that come before.
    """
    most = parts.groupBy("virtual_slot").agg(F.sum("rows").alias("n")).agg(F.max("n")).first()[0] or 0
    buckets = -(-most // together) or 1
    # one row a virtual slot
    placed = parts.join(F.broadcast(slot_map.select("virtual_slot", "shard", "version")), "virtual_slot")
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64(*keys, size, "piece"), F.lit(buckets)))
    counts = placed.groupBy("shard", "virtual_slot", "bucket").agg(F.sum("rows").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("shard").orderBy("virtual_slot", "bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("virtual_slot", "bucket", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("virtual_slot", "bucket").orderBy(*(F.asc_nulls_first(k) for k in keys), size, "piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("before", F.coalesce(F.sum("rows").over(inside), F.lit(0))).join(counts, ["virtual_slot", "bucket"])
    first = F.col("ahead") + F.col("before")
    return placed.withColumn("slot", F.explode(F.sequence(first, first + F.col("rows") - 1))).select(*keys, size, "virtual_slot", "version", "shard", "slot")


def shard_rows(rows: DataFrame, shards: int, keys: list[str], size: str = "size", folder: str | None = None, slots: int = SLOTS) -> DataFrame:
    """``rows(keys, size)`` over ``shards`` shards of nearly equal size: one row each, with
    ``virtual_slot``, ``version``, ``shard`` and ``slot`` (see ``place_rows``).

    With a ``folder`` the last map stored there is edited for the present bytes and
    stored as the next version; without one, or where it is empty, a first map is
    made. A single row larger than a shard's share makes that shard larger. Null
    keys are keys like any other; equal rows are placed one by one; an empty table
    gives no rows and a map of empty slots. Other columns are not read.
    """
    parts = cut(slotted(rows, keys, size, slots))
    loads = cut(slot_loads(parts, size, slots))
    spark = rows.sparkSession
    stored = folder is not None and exists(spark, folder)
    slot_map = cut(next_map(read_map(spark, folder), loads, shards) if stored else first_map(loads, shards))
    drop(loads)
    if folder is not None:
        save_map(slot_map, folder)
    return place_rows(parts, slot_map, keys, size)
