"""Places and running sums in one order over a whole table, and windows over keys that
may hold most of it, without one task for either."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import cut


def running_sum(df: DataFrame, order: list[Column], value: Column | None = None, name: str = "running", parts: int | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to and with each one, in
    ``order``; without a value the row's number from 1. Null values count as 0.

    Rows are dealt into ranges of the order and written once, as a range's limits
    are drawn anew each time a plan runs. A window adds up inside each range, and
    the sums of the ranges before it (one number a range) are added to it. Rows
    equal in ``order`` share a range, so it should tell most rows apart; equal
    rows follow each other in some order.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    value = F.lit(1) if value is None else F.coalesce(value, F.lit(0))
    ranged = cut(df.repartitionByRange(parts, *order).withColumns({"_part": F.spark_partition_id(), "_value": value.cast("long")}))
    sums = F.sort_array(F.collect_list(F.struct("_part", "_sum")))
    before = lambda x: F.aggregate(F.filter("sums", lambda y: y["_part"] < x["_part"]), F.lit(0).cast("long"), lambda a, y: a + y["_sum"])
    # one row a range, at most ``parts`` of them
    per = ranged.groupBy("_part").agg(F.sum("_value").alias("_sum")).agg(sums.alias("sums"))
    per = per.select(F.explode(F.transform("sums", lambda x: F.struct(x["_part"].alias("_part"), before(x).alias("_before")))).alias("p")).select("p.*")
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(per), "_part").withColumn(name, F.sum("_value").over(inside) + F.col("_before"))
    return out.select(*df.columns, name)


class Ranged:
    """Rows in ranges of (keys, order): what a window over the keys gives, without a
    task that holds a whole key.

    Rows are dealt into ranges and written once. A window then works inside each
    (range, key); a small table of one row a (range, key) holds what the others
    need of it, is worked on in the same order, and is joined back by both. Rows
    equal in keys and order share a range.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], parts: int | None = None):
        parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.keys, self.order = list(keys), list(order)
        ranged = df.repartitionByRange(parts, *(F.asc_nulls_first(c) for c in (*keys, *order)))
        self.rows = cut(ranged.withColumn("_part", F.spark_partition_id()))
        self.inside = Window.partitionBy("_part", *self.keys).orderBy(*(F.asc_nulls_first(c) for c in self.order))
        self.across = Window.partitionBy(*self.keys).orderBy("_part")
        self._place = F.struct(*(x for c in self.order for x in (F.col(c).isNotNull(), F.col(c))))

    def _with(self, rows: DataFrame, edges: DataFrame) -> DataFrame:
        """``rows`` with the columns of ``edges(_part, keys, ...)``; null keys meet too."""
        e = edges.withColumnsRenamed({c: f"_e{i}" for i, c in enumerate(["_part", *self.keys])})
        on = reduce(lambda a, b: a & b, (rows[c].eqNullSafe(e[f"_e{i}"]) for i, c in enumerate(["_part", *self.keys])))
        return rows.join(e, on, "left").drop(*(f"_e{i}" for i in range(len(self.keys) + 1)))

    def number(self, name: str) -> "Ranged":
        """Each row's number within its key, from 0."""
        n = self.rows.groupBy("_part", *self.keys).agg(F.count("*").alias("_n"))
        before = F.coalesce(F.sum("_n").over(self.across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        x = self._with(self.rows, n.withColumn("_before", before).drop("_n"))
        self.rows = x.withColumn(name, (F.row_number().over(self.inside) - 1 + F.col("_before")).cast("long")).drop("_before")
        return self

    def neighbour(self, columns: dict[str, str], ahead: bool) -> "Ranged":
        """The next (or last) row's columns within the key, as {column: new name}."""
        whole = F.struct(*(F.col(c).alias(c) for c in columns))
        edge, of, near = (F.min_by, F.lead, F.lead) if ahead else (F.max_by, F.lag, F.lag)
        edges = self.rows.groupBy("_part", *self.keys).agg(edge(whole, self._place).alias("_edge"))
        edges = edges.withColumn("_beyond", near("_edge").over(self.across)).drop("_edge")
        x = self._with(self.rows.withColumn("_near", of(whole).over(self.inside)), edges)
        x = x.withColumn("_near", F.coalesce("_near", "_beyond"))
        self.rows = x.withColumns({name: F.col(f"_near.{c}") for c, name in columns.items()}).drop("_near", "_beyond")
        return self

    def last(self, columns: dict[str, str]) -> "Ranged":
        """The last values that are not null up to and with each row within the key."""
        known = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), self._place)).alias(f"_l{i}") for i, c in enumerate(columns)]
        edges = self.rows.groupBy("_part", *self.keys).agg(*known)
        up_to = self.across.rowsBetween(Window.unboundedPreceding, -1)
        edges = edges.select("_part", *self.keys, *(F.last(f"_l{i}", ignorenulls=True).over(up_to).alias(f"_c{i}") for i in range(len(columns))))
        x = self._with(self.rows, edges)
        here = lambda c: F.last(c, ignorenulls=True).over(self.inside.rowsBetween(Window.unboundedPreceding, 0))
        self.rows = x.withColumns({name: F.coalesce(here(c), f"_c{i}") for i, (c, name) in enumerate(columns.items())}).drop(*(f"_c{i}" for i in range(len(columns))))
        return self

    def done(self) -> DataFrame:
        return self.rows.drop("_part")


def nearest_ranks(values: DataFrame, keys: list[str], value: str, shares: dict[str, float], salts: int = 32) -> DataFrame:
    """Per key ``n``, ``mean`` and, for each share p under its name, the value at rank
    floor(p * n) from 0 (n - 1 at most), of the values that are not null.

    Equal values are counted first. Values then fall into bins of 1/1024, counts of
    bins tell which one holds a rank, and only that bin's values go on, to bins of
    2^-26; those of the one that holds the rank are numbered. So no window has more
    than a key's bins or one fine bin's different values, and the values of a bin
    are joined in ``salts`` parts.
    """
    held = F.greatest(F.least(F.col("v"), F.lit(2.0**30)), F.lit(-(2.0**30)))
    each = values.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    each = cut(each.withColumns({"b1": F.floor(held * 2.0**10).cast("long"), "b2": F.floor(held * 2.0**26).cast("long"), "salt": F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")}))
    bins = each.groupBy(*keys, "b1").agg(F.sum("c").alias("c"), F.sum(F.col("v") * F.col("c")).alias("s"))
    total = bins.groupBy(*keys).agg(F.sum("c").alias("n"), (F.sum("s") / F.sum("c")).alias("mean"))
    bins = bins.drop("s")
    name = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.lit(float(p)).alias("p")) for k, p in shares.items()))).alias("w")
    wanted = total.select(*keys, "n", "mean", name).select(*keys, "n", "mean", "w.name", F.least(F.floor(F.col("w.p") * F.col("n")), F.col("n") - 1).cast("long").alias("rank"))

    def holding(counts: DataFrame, of: list[str], at: str, wanted: DataFrame) -> DataFrame:
        """``wanted`` with the bin ``at`` that holds its rank, which counts on from it."""
        before = F.coalesce(F.sum("c").over(Window.partitionBy(*of).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        x = counts.withColumn("before", before).join(wanted, of)
        return x.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("c"))).withColumn("rank", F.col("rank") - F.col("before")).drop("before", "c")

    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    coarse = holding(bins, list(keys), "b1", wanted)
    some = each.join(coarse.select(*keys, "b1").distinct().select("*", salt), [*keys, "b1", "salt"], "left_semi")
    fine = holding(some.groupBy(*keys, "b1", "b2").agg(F.sum("c").alias("c")), [*keys, "b1"], "b2", coarse)
    last = some.join(fine.select(*keys, "b1", "b2").distinct().select("*", salt), [*keys, "b1", "b2", "salt"], "left_semi")
    got = holding(last.select(*keys, "b1", "b2", "v", "c"), [*keys, "b1", "b2"], "v", fine)
    return got.groupBy(*keys).agg(F.max("n").alias("n"), F.max("mean").alias("mean"), *(F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in shares))
