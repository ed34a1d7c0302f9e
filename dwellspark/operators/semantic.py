"""Semantic scores: windows against goals, thresholds and their calibration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.titles import app_boost, goal_display, normalize_goal
from ..options import SemanticOptions
from .ordering import nearest_ranks


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _dot(x, y) -> Column:
    return F.aggregate(F.zip_with(_c(x), _c(y), lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))


def norm(a) -> Column:
    """Length of an array in doubles."""
    return F.sqrt(_dot(a, a))


def cosine(a, b, norm_a=None, norm_b=None) -> Column:
    """Cosine of two arrays in doubles; 0 where either has no length. Lengths that are
    known may be given."""
    both = (norm(a) if norm_a is None else _c(norm_a)) * (norm(b) if norm_b is None else _c(norm_b))
    return F.when(both == 0, F.lit(0.0)).otherwise(_dot(a, b) / both)


def clamp(x) -> Column:
    return F.least(F.greatest(_c(x), F.lit(0.0)), F.lit(1.0))


def label(score, t_on, t_off) -> Column:
    return F.when(_c(score) >= _c(t_on), "on_goal").when(_c(score) >= _c(t_off), "related").otherwise("off_goal")


def confidence(dwell_ms) -> Column:
    d = _c(dwell_ms)
    return F.when(d.isNull() | (d < 10_000), "low").when(d <= 30_000, "medium").otherwise("high")


def with_thresholds(df: DataFrame, calibration: DataFrame, day_col: str = "day_utc", options: SemanticOptions = SemanticOptions()) -> DataFrame:
    """``df`` with t_on, t_off and threshold_mode: the goal's and day's calibrated pair,
    or the fixed one."""
    c = calibration.select("goal_id", F.col("day_utc").alias(day_col), F.col("t_on").alias("_on"), F.col("t_off").alias("_off"))
    use = F.col("_on").isNotNull() & F.lit(not options.force_fixed)
    return df.join(c, ["goal_id", day_col], "left").withColumns(
        {
            "t_on": F.when(use, F.col("_on")).otherwise(options.t_on),
            "t_off": F.when(use, F.col("_off")).otherwise(options.t_off),
            "threshold_mode": F.when(use, "calibrated").otherwise("fixed"),
        }
    ).drop("_on", "_off")


def score_windows(windows: DataFrame, goals: DataFrame, calibration: DataFrame, options: SemanticOptions = SemanticOptions(), on: list[str] = ("user_id",)) -> DataFrame:
    """Each window ``(on, day_utc, app_name, dwell_ms, vector)`` against its goal
    ``(on, goal_id, app_hint, goal_vector)``.

    Without a goal, or with a known dwell under the least, the label is
    'unknown' with scores 0 and low confidence, and no thresholds.
    """
    # a goal's length is worked out once, not once a window
    goals = goals.withColumn("_goal_norm", norm("goal_vector"))
    w = with_thresholds(windows.join(goals, list(on), "left"), calibration, options=options)
    known = F.col("goal_id").isNotNull() & ~F.coalesce(F.col("dwell_ms") < options.min_dwell_ms, F.lit(False))
    w = w.withColumn("sim_score", F.when(known, cosine("vector", "goal_vector", norm_b="_goal_norm")).otherwise(0.0)).drop("_goal_norm")
    w = w.withColumn("final_score", F.when(known, clamp(F.col("sim_score") + app_boost("app_name", "app_hint", options.boost))).otherwise(0.0))
    return w.withColumns(
        {
            "label": F.when(known, label("final_score", "t_on", "t_off")).otherwise("unknown"),
            "confidence": F.when(known, confidence("dwell_ms")).otherwise("low"),
            "t_on": F.when(known, F.col("t_on")),
            "t_off": F.when(known, F.col("t_off")),
        }
    )


def calibrate(scores: DataFrame, options: SemanticOptions = SemanticOptions()) -> DataFrame:
    """``scores(goal_id, day_utc, score)`` -> t_on, t_off, sample_count of each goal
    and day with enough scores and a high enough mean.

    A percentile is the score at rank floor(p * n) from 0, found by counts of bins, so a
    goal's scores never meet in one task (see ``nearest_ranks``).
    """
    per = ["goal_id", "day_utc"]
    at = nearest_ranks(scores, per, "score", {"on": options.p_on, "off": options.p_off})
    out = at.where((F.col("n") >= options.min_samples) & (F.col("mean") >= options.min_mean))
    return out.select(*per, F.greatest("on", F.lit(options.t_on_floor)).alias("t_on"), F.col("off").alias("t_off"), F.col("n").alias("sample_count"))


def compare_models(a: DataFrame, b: DataFrame, key: str | list[str]) -> DataFrame:
    """Scores of two models for the same windows: their difference, and whether labels agree."""
    key = [key] if isinstance(key, str) else list(key)
    x = a.select(*key, F.col("final_score").alias("score_a"), F.col("label").alias("label_a"))
    y = b.select(*key, F.col("final_score").alias("score_b"), F.col("label").alias("label_b"))
    return x.join(y, key).withColumns({"delta": F.col("score_b") - F.col("score_a"), "label_same": F.col("label_a") == F.col("label_b")})


def embed_distinct(df: DataFrame, text_col: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with ``vector``: ``embed`` gets each different trimmed text once, as
    ``(text)``, and returns ``(text, vector)``."""
    texts = df.select(F.trim(text_col).alias("text")).where("text <> ''").distinct()
    got = embed(texts).select(F.col("text").alias("_text"), "vector")
    return df.join(got, F.trim(df[text_col]) == got["_text"], "left").drop("_text")


def apply_goal_log(log: DataFrame, key: str = "user_id") -> DataFrame:
    """Current goals from ``(key, at_ms, action set|clear, todo_text, app_hint)``: the
    last action decides; a goal keeps the time of the first set since it was cleared."""
    order = Window.partitionBy(key).orderBy("at_ms")
    log = log.withColumn("_life", F.sum((F.col("action") == "clear").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    last = F.max_by(F.struct("action", "todo_text", "app_hint", "at_ms", F.coalesce("_life", F.lit(0)).alias("life")), "at_ms").alias("g")
    now = log.groupBy(key).agg(last).where("g.action = 'set'")
    first = log.where("action = 'set'").groupBy(key, F.coalesce("_life", F.lit(0)).alias("life")).agg(F.min("at_ms").alias("created_at_ms"))
    now = now.select(key, "g.*").join(first, [key, "life"])
    return now.select(
        key, goal_display(F.col("todo_text"), F.col("app_hint")).alias("text"), "todo_text", "app_hint",
        normalize_goal("todo_text").alias("normalized_text"), "created_at_ms", F.col("at_ms").alias("updated_at_ms"),
    )


def on_goal_time(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Dwell by goal, label and day; unknown windows are left out."""
    return scored.where("label <> 'unknown'").groupBy(*keys, "goal_id", "day_utc", "label").agg(F.sum("dwell_ms").cast("long").alias("total_ms"))
