"""Daily and weekly reports for all keys and days at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.timefns import DAY_MS, local_day_to_utc_ms, week_days
from ..functions.titles import bar, fmt_duration
from ..options import CATEGORIES
from .ordering import running_sum

_MS = [f"{c}_ms" for c in CATEGORIES]


def daily_totals(features: DataFrame, keys: list[str], window_ms: int = 30_000) -> DataFrame:
    """Category times, switches, windows and deep-work time of each local day."""
    f = features.where("substring(window_start_local, 12) < '23:59:59.999'").withColumn("local_date", F.substring("window_start_local", 1, 10))
    return f.groupBy(*keys, "local_date").agg(
        *(F.sum(c).cast("long").alias(c) for c in _MS),
        F.sum("context_switch_count").cast("long").alias("context_switches"),
        F.count("*").alias("windows"),
        F.sum("deep_work_candidate_flag").cast("long").alias("deep_work_windows"),
        (F.sum("deep_work_candidate_flag") * window_ms).cast("long").alias("deep_work_ms"),
        F.min_by("timezone_offset", "window_start_local").alias("timezone_offset"),
    ).withColumn("total_tracked_ms", total_tracked())


def total_tracked() -> F.Column:
    out = F.col(_MS[0])
    for c in _MS[1:]:
        out = out + F.col(c)
    return out


def top_apps(dwells: DataFrame, keys: list[str], start_ms=None, end_ms=None, limit: int = 5) -> DataFrame:
    """Apps with the most dwell among those that end in [start, end), per key."""
    d = dwells
    if start_ms is not None:
        d = d.where(F.col("timestamp_ms") >= start_ms)
    if end_ms is not None:
        d = d.where(F.col("timestamp_ms") < end_ms)
    total = d.groupBy(*keys, "app_name").agg(F.sum("dwell_time_ms").cast("long").alias("total_ms"))
    if not keys:
        # without keys the top is one sort of each task's own top
        return running_sum(total.orderBy(F.desc("total_ms"), "app_name").limit(limit), [F.desc("total_ms"), F.col("app_name")], name="rank", parts=1).withColumn("rank", F.col("rank").cast("int"))
    order = Window.partitionBy(*keys).orderBy(F.desc("total_ms"), "app_name")
    return total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def day_bounds_join(dwells: DataFrame, daily: DataFrame, keys: list[str]) -> DataFrame:
    """Dwells with the local day of their key that they end in, by the day's UTC
    bounds under its first window's offset. A dwell can end in at most the three
    UTC days around a local one, so days are matched by equality, then by range."""
    low = local_day_to_utc_ms("local_date", "timezone_offset")
    days = daily.select(*keys, "local_date", low.alias("low_ms"), (low + DAY_MS).alias("high_ms"))
    days = days.withColumn("_day", F.explode(F.sequence(F.floor(F.col("low_ms") / DAY_MS), F.floor((F.col("high_ms") - 1) / DAY_MS))))
    d = dwells.withColumn("_day", F.floor(F.col("timestamp_ms") / DAY_MS))
    return d.join(days, [*keys, "_day"]).where("timestamp_ms >= low_ms AND timestamp_ms < high_ms").drop("_day")


def daily_report(features: DataFrame, dwells: DataFrame, keys: list[str], limit: int = 5) -> DataFrame:
    """Daily totals with ``top_apps``, an array in order of rank."""
    daily = daily_totals(features, keys)
    per = [*keys, "local_date"]
    apps = top_apps(day_bounds_join(dwells, daily, keys), per, limit=limit)
    tops = apps.groupBy(*per).agg(F.sort_array(F.collect_list(F.struct("rank", "app_name", "total_ms"))).alias("top_apps"))
    return daily.join(tops, per, "left")


def top_distractions(dwells: DataFrame, keys: list[str], limit: int = 3) -> DataFrame:
    return top_apps(dwells.where(F.col("category").isin("video", "social", "game")), keys, limit=limit)


def dense_days(daily: DataFrame, keys: list[str], end_day: str) -> DataFrame:
    """Each key's seven days that end with ``end_day``; empty ones are zero."""
    numbers = [*_MS, "context_switches", "windows", "deep_work_windows", "deep_work_ms", "total_tracked_ms"]
    days = F.explode(F.transform(week_days(F.lit(end_day)), lambda d: d.cast("string"))).alias("local_date")
    grid = daily.select(*keys).distinct().select(*keys, days) if keys else daily.sparkSession.range(1).select(days)
    return grid.join(daily, [*keys, "local_date"], "left").fillna(0, numbers)


def weekly_report(daily: DataFrame, keys: list[str], end_day: str) -> DataFrame:
    """Sums of seven days, with ``trend_data``, one struct for each day, in order, and
    ``days``, each day's whole row of ``daily`` (its ``top_apps`` too, where it comes
    from ``daily_report``; empty on days without any)."""
    week = dense_days(daily, keys, end_day)
    if "top_apps" in week.columns:
        week = week.withColumn("top_apps", F.coalesce("top_apps", F.array().cast(week.schema["top_apps"].dataType)))
    trend = F.struct("local_date", *_MS, "deep_work_ms", "context_switches", F.col("windows").alias("window_count"))
    whole = F.struct("local_date", *(c for c in week.columns if c not in (*keys, "local_date")))
    return week.groupBy(*keys).agg(
        F.min("local_date").alias("first_day"), F.max("local_date").alias("last_day"),
        *(F.sum(c).cast("long").alias(c) for c in _MS),
        F.sum("deep_work_ms").cast("long").alias("deep_work_ms"), F.sum("context_switches").cast("long").alias("context_switches"),
        F.sort_array(F.collect_list(trend)).alias("trend_data"), F.sort_array(F.collect_list(whole)).alias("days"),
    )


def report_json(report: DataFrame) -> DataFrame:
    return report.select(F.to_json(F.struct("*")).alias("json"))


def _padded(text, width: int, left: bool = False):
    blank = F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.length(text), F.lit(0)))
    return F.concat(blank, text) if left else F.concat(text, blank)


def _boxed(width: int, *inside) -> F.Column:
    rule = "═" * width
    return F.concat(F.lit(f"\n╔{rule}╗\n║"), *inside, F.lit(f"║\n╚{rule}╝\n"))


def report_text(daily: DataFrame) -> DataFrame:
    """``daily`` with ``report``: the day as text, a bar for each category with time;
    where there is a column ``top_apps`` (of ``daily_report``), these at the end."""
    total = F.col("total_tracked_ms")
    # fixed values: the report's lines and widths
    lines = [F.when(F.col(m) != 0, F.concat(F.lit(f"  {c:7} "), bar(m, total), F.lit(" "), _padded(fmt_duration(m), 8, left=True))) for c, m in zip(CATEGORIES, _MS)]
    sums = (("\n  Total tracked:   ", fmt_duration(total)), ("  Deep work:       ", fmt_duration("deep_work_ms")), ("  Context switches: ", F.col("context_switches").cast("string")))
    apps = F.lit(None).cast("string")
    if "top_apps" in daily.columns:
        row = lambda a: F.concat(F.lit("  "), _padded(F.substring(a["app_name"], 1, 32), 33), F.lit(" "), fmt_duration(a["total_ms"]))
        apps = F.when(F.size("top_apps") > 0, F.concat(F.lit("\nTop Apps:\n"), F.array_join(F.transform("top_apps", row), "\n")))
    head = _boxed(34, F.lit("   Daily Report — "), F.col("local_date"), F.lit("    "))
    return daily.withColumn("report", F.concat_ws("\n", head, F.lit("Category Breakdown:"), *lines, *(F.concat(F.lit(k), v) for k, v in sums), apps, F.lit("")))


def weekly_text(weekly: DataFrame) -> DataFrame:
    """``weekly`` (of ``weekly_report``) with ``report``: the week as text, a line a day."""
    # fixed values: the report's lines and widths
    head = _boxed(46, F.lit("  Weekly Report — "), F.col("first_day"), F.lit(" to "), F.col("last_day"), F.lit("  "))
    of = lambda c: fmt_duration(f"{c}_ms")
    day = lambda d: F.concat(
        F.lit("  "), d["local_date"], F.lit("  "), _padded(fmt_duration(d["deep_work_ms"]), 9), F.lit("  "), _padded(fmt_duration(d["code_ms"]), 9),
        F.lit("  "), _padded(d["context_switches"].cast("string"), 4, left=True),
    )
    return weekly.withColumn("report", F.concat_ws(
        "\n", head, F.concat(F.lit("  Total deep work:      "), of("deep_work")), F.concat(F.lit("  Total ctx switches:   "), F.col("context_switches").cast("string")),
        F.concat(F.lit("\n  code:   "), of("code"), F.lit("   docs: "), of("docs"), F.lit("   video: "), of("video")),
        F.concat(F.lit("  social: "), of("social"), F.lit("   game: "), of("game"), F.lit("   other: "), of("other")),
        F.lit("\nDaily Trend:"), F.lit("  Date        Deep Work  Code       Ctx±"), F.lit("  ──────────  ─────────  ─────────  ────"),
        F.array_join(F.transform("trend_data", day), "\n"), F.lit(""),
    ))


def deep_work_blocks(features: DataFrame, keys: list[str], window_ms: int = 30_000) -> DataFrame:
    """Runs of neighbouring flagged windows: start, end, windows."""
    f = features.where("deep_work_candidate_flag = 1")
    if keys:
        f = f.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("window_start")).cast("long"))
    else:
        f = running_sum(f, [F.col("window_start")], name="_n")
    f = f.withColumn("_run", F.col("window_start") - F.col("_n") * window_ms).drop("_n")
    return f.groupBy(*keys, "_run").agg(
        F.min("window_start").alias("block_start"), (F.max("window_start") + window_ms).alias("block_end"), F.count("*").alias("windows")
    ).drop("_run")
