"""Fixed windows of activity: time by category, input rates, deep work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.categories import categorize
from ..functions.timefns import bucket_start, iso_local, iso_utc
from ..options import CATEGORIES, FeatureOptions


def dwell_x_bucket(dwells: DataFrame, window_ms: int = 30_000, origin: int = 0) -> DataFrame:
    """Each dwell once for each window it overlaps, with ``window_start`` and
    ``overlap_ms``: windows are counted out per dwell, so nothing is compared with
    anything. A dwell of no length counts in the window strictly around it."""
    end, start = F.col("timestamp_ms"), F.col("timestamp_ms") - F.col("dwell_time_ms")
    spans = F.sequence(bucket_start(start, window_ms, origin), bucket_start(end - 1, window_ms, origin), F.lit(window_ms))
    point = F.when(F.pmod(end - origin, F.lit(window_ms)) != 0, F.array(bucket_start(end, window_ms, origin))).otherwise(F.array().cast("array<bigint>"))
    out = dwells.withColumn("window_start", F.explode(F.when(F.col("dwell_time_ms") > 0, spans).otherwise(point)))
    overlap = F.least(end, F.col("window_start") + window_ms) - F.greatest(start, F.col("window_start"))
    return out.withColumn("overlap_ms", F.greatest(overlap, F.lit(0)).cast("long"))


def input_sums() -> list[F.Column]:
    """Sums of a window's inputs; scrolling counts in either direction."""
    sums = {"keys_n": "key_count", "clicks_n": "click_count", "mouse_n": "mouse_distance", "idle_n": "idle_ms"}
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return [*(F.sum(zero(c)).cast("long").alias(n) for n, c in sums.items()), F.sum(F.abs(zero("scroll_delta"))).cast("long").alias("scroll_n")]


def dealt(rows: DataFrame, keys: list[str], parts: int | None) -> DataFrame:
    """Rows of fixed windows over ``parts`` partitions by key and window, so that a task's
    work doesn't grow with the input; without ``parts`` as Spark deals them out."""
    return rows.repartition(parts, *keys, "window_start") if parts else rows


def bucket_inputs(inputs: DataFrame, keys: list[str], window_ms: int = 30_000, origin: int = 0, parts: int | None = None) -> DataFrame:
    """Input sums of each window; ``parts`` as in ``dealt``."""
    x = dealt(inputs.withColumn("window_start", bucket_start("timestamp_ms", window_ms, origin)), keys, parts)
    return x.groupBy(*keys, "window_start").agg(*input_sums())


def app_sums() -> list[F.Column]:
    """Of a window's pieces of one app: overlap, rows, opened windows, its first dwells."""
    order = F.struct("timestamp_ms", "id")
    return [
        F.sum("overlap_ms").cast("long").alias("ms"),
        F.count("*").alias("rows"),
        F.collect_set("window_event_id").alias("opened"),
        F.min(F.when(F.col("overlap_ms") > 0, order)).alias("first"),
        F.min(F.struct("timestamp_ms", "id", "timezone_offset")).alias("zone"),
    ]


def app_ms(pieces: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """Per window and app: overlap, rows, opened windows, and its first dwells;
    ``parts`` as in ``dealt``."""
    return dealt(pieces, keys, parts).groupBy(*keys, "window_start", "app_name").agg(*app_sums())


def window_sums(o: FeatureOptions) -> list[F.Column]:
    """Of a window's apps with their category: time by category, switches, the top app."""
    switches = F.sum("rows") if o.count_mode == "rows" else F.size(F.array_distinct(F.flatten(F.collect_list("opened"))))
    rank = F.when(F.col("ms") > 0, F.struct((-F.col("ms")).alias("m"), F.col("first")))
    return [
        *(F.sum(F.when(F.col("category") == c, F.col("ms")).otherwise(0)).cast("long").alias(f"{c}_ms") for c in CATEGORIES),
        switches.cast("long").alias("context_switch_count"),
        F.coalesce(F.min_by("app_name", rank), F.lit("")).alias("top_app_name"),
        F.min("zone")["timezone_offset"].alias("timezone_offset"),
    ]


def finished(out: DataFrame, o: FeatureOptions) -> DataFrame:
    """Rates, flags and times of windows with their category and input sums (which may
    be null)."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    seconds = o.window_ms / 1000
    out = out.withColumn("top_category", top_category()).withColumns(
        {
            "key_rate": n("keys_n") / seconds, "click_rate": n("clicks_n") / seconds, "scroll_rate": n("scroll_n") / seconds,
            "mouse_speed": n("mouse_n") / seconds, "idle_ratio": F.least(F.greatest(n("idle_n") / o.window_ms, F.lit(0.0)), F.lit(1.0)),
            "window_start_utc": iso_utc("window_start"), "window_start_local": iso_local("window_start", "timezone_offset"),
        }
    ).drop("keys_n", "clicks_n", "scroll_n", "mouse_n", "idle_n")
    out = out.withColumn("deep_work_candidate_flag", deep_work_flag(o))
    if o.extra_flags:
        local = F.to_timestamp("window_start_local")
        hour = F.hour(local)
        out = out.withColumns(
            {
                "video_like_flag": (F.col("video_ms") * 2 > o.window_ms).cast("int"),
                "night_flag": ((hour >= o.night_from) | (hour < o.night_to)).cast("int"),
                "weekday_flag": (F.weekday(local) < 5).cast("int"),
            }
        )
    return out


def top_category() -> F.Column:
    """First category in the fixed order with the most time; the first of all at zero."""
    most = F.greatest(*(F.col(f"{c}_ms") for c in CATEGORIES))
    out = None
    for c in CATEGORIES:
        hit = F.col(f"{c}_ms") == most
        out = F.when(hit, F.lit(c)) if out is None else out.when(hit, F.lit(c))
    return out


def deep_work_flag(o: FeatureOptions) -> F.Column:
    ok = (F.col("code_ms") + F.col("docs_ms") >= o.deep_ms) & (F.col("idle_ratio") <= o.deep_idle) & (F.col("context_switch_count") <= o.deep_switches)
    if o.deep_distraction_ms is not None:
        ok = ok & (F.col("video_ms") + F.col("social_ms") + F.col("game_ms") <= o.deep_distraction_ms)
    return ok.cast("int")


def build_features(
    dwells: DataFrame, inputs: DataFrame, keys: list[str] = (), options: FeatureOptions = FeatureOptions(), start_ms: int | None = None, end_ms: int | None = None,
    parts: int | None = None,
) -> DataFrame:
    """One row for each key and window with a dwell; windows without one don't exist,
    even with input. A given start is the grid's origin. Dwells and inputs are dealt over
    ``parts`` partitions by key and window (see ``dealt``), once for all that follows."""
    keys, size, origin = list(keys), options.window_ms, start_ms or 0
    pieces = dwell_x_bucket(dwells, size, origin)
    if start_ms is not None:
        pieces = pieces.where(F.col("window_start") >= start_ms)
    if end_ms is not None:
        pieces = pieces.where(F.col("window_start") < end_ms)
    apps = app_ms(pieces, keys, parts).withColumn("category", categorize("app_name"))
    out = apps.groupBy(*keys, "window_start").agg(*window_sums(options))
    return finished(out.join(bucket_inputs(inputs, keys, size, origin, parts), [*keys, "window_start"], "left"), options)


def features_in_local_range(features: DataFrame, low: str, high: str) -> DataFrame:
    """Rows with low <= local start < high, by string, in order."""
    return features.where((F.col("window_start_local") >= low) & (F.col("window_start_local") < high)).orderBy("window_start_local")


def features_on_local_day(features: DataFrame, day: str) -> DataFrame:
    return features_in_local_range(features, f"{day}T00:00:00", f"{day}T23:59:59.999")


def write_features(features: DataFrame, path: str, kind: str = "parquet") -> None:
    """Export as Parquet or CSV, a folder for each local day."""
    out = features.withColumn("local_date", F.substring("window_start_local", 1, 10)).write.partitionBy("local_date")
    out.option("header", True).csv(path) if kind == "csv" else out.parquet(path)
