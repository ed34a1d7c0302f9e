"""Input counters: attached to windows and summed over flush slots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.timefns import bucket_start
from ..options import FLUSH_MS
from .ordering import Ranged

COUNTERS = ("key_count", "click_count", "mouse_distance", "scroll_delta", "idle_ms")


def inputs_asof_window(deltas: DataFrame, windows: DataFrame, hot: bool = False) -> DataFrame:
    """Each delta with the window that was in front: the last one opened before it.
    At equal times the input comes first; inputs before any window have none. With
    ``hot`` sessions are worked on in ranges, for tables where one may be too large
    for a task."""
    left = deltas.select("session_id", "monotonic_ms", F.lit(0).alias("_first"), *COUNTERS, F.lit(None).cast("string").alias("_id"), F.lit(None).cast("long").alias("_at"))
    none = [F.lit(None).cast("long").alias(c) for c in COUNTERS]
    right = windows.select("session_id", "monotonic_ms", F.lit(1).alias("_first"), *none, F.col("event_id").cast("string").alias("_id"), F.col("monotonic_ms").alias("_at"))
    both = left.unionByName(right)
    if hot:
        both = Ranged(both, ["session_id"], ["monotonic_ms", "_first", "_id"]).last({"_id": "active_window_id", "_at": "window_start_ms"}).done()
    else:
        order = Window.partitionBy("session_id").orderBy("monotonic_ms", "_first", "_id")
        both = both.withColumns({"active_window_id": F.last("_id", ignorenulls=True).over(order), "window_start_ms": F.last("_at", ignorenulls=True).over(order)})
    return both.where("_first = 0").drop("_first", "_id", "_at")


def is_dirty() -> F.Column:
    """Whether a row of sums holds anything to flush (negative scrolling alone doesn't)."""
    out = F.lit(False)
    for c in COUNTERS:
        out = out | (F.col(c) > 0)
    return out


def accumulate(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of the five counters; null counts as 0."""
    return deltas.groupBy(*keys).agg(*(F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in COUNTERS))


def input_summaries(deltas: DataFrame, windows: DataFrame, flush_ms: int = FLUSH_MS, carry: bool = False, hot: bool = False) -> DataFrame:
    """One row for each session, window and flush slot with input; ``dwell_time_ms``
    is how long the window had been open at the slot's last input.

    A slot that holds nothing but scrolling backwards isn't flushed. Without ``carry``
    its sums are left out; with it they count on in the session's later slots until
    one is flushed, and inputs before the session's first window count in that
    window's first slot with input (see ``carried``).
    """
    d = inputs_asof_window(deltas, windows, hot).withColumn("slot_ms", bucket_start("monotonic_ms", flush_ms))
    if not carry:
        d = d.where("active_window_id IS NOT NULL")
    sums = [F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in COUNTERS]
    dwell = F.max(F.col("monotonic_ms") - F.col("window_start_ms")).cast("long").alias("dwell_time_ms")
    cells = d.groupBy("session_id", "active_window_id", "slot_ms").agg(*sums, dwell, F.min("window_start_ms").alias("window_start_ms"))
    out = carried(cells) if carry else cells.where(is_dirty())
    return out.select("session_id", "active_window_id", "slot_ms", *COUNTERS, "dwell_time_ms")


def carried(cells: DataFrame) -> DataFrame:
    """Sums of slots as they are flushed when those of slots that aren't go on.

    Counters but scrolling are never negative, so only scrolling is carried: a slot
    with any of the others is flushed, and starts a new run behind it. Within a
    run the carried sum falls back to 0 wherever it gets above 0, which is where
    the running sum exceeds its largest value so far.
    """
    first = cells.where("active_window_id IS NOT NULL").groupBy(F.col("session_id").alias("_s"))
    first = first.agg(F.min(F.struct("slot_ms", "window_start_ms", "active_window_id", "dwell_time_ms")).alias("_f"))
    x = cells.join(first, F.col("session_id") == F.col("_s"))
    early = F.col("active_window_id").isNull()
    x = x.withColumns({c: F.when(early, F.col(f"_f.{c}")).otherwise(F.col(c)) for c in ("slot_ms", "window_start_ms", "active_window_id", "dwell_time_ms")})
    keys = ["session_id", "slot_ms", "window_start_ms", "active_window_id"]
    x = x.groupBy(*keys).agg(*(F.sum(c).cast("long").alias(c) for c in COUNTERS), F.max("dwell_time_ms").alias("dwell_time_ms"))
    sure = reduce(lambda a, b: a | b, (F.col(c) > 0 for c in COUNTERS if c != "scroll_delta"))
    order = Window.partitionBy("session_id").orderBy(*keys[1:])
    run = F.coalesce(F.sum(sure.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = Window.partitionBy("session_id", "_run").orderBy(*keys[1:])
    x = x.withColumn("_run", run).withColumn("_sum", F.sum("scroll_delta").over(within))
    top = F.greatest(F.lit(0), F.coalesce(F.max("_sum").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return x.withColumn("scroll_delta", F.col("_sum") - top).where(sure | (F.col("scroll_delta") > 0))


def inputs_in_range(inputs: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    return inputs.where((F.col("timestamp_ms") >= start_ms) & (F.col("timestamp_ms") < end_ms)).orderBy("timestamp_ms")
