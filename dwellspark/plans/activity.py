"""Driver tables read as activity: events as windows, dwells and inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timefns import epoch_ms
from ..operators.dwell import assign_seq, dwell_from_windows

APPS = {"click": "Visual Studio Code", "view": "YouTube", "purchase": "Notion", "signup": "Slack", "error": "Minecraft"}
#: dwell of this table's sparse users is cut to so much
CAP_MS = 120_000
#: events whose pieces one task works on
PER_TASK = 25_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions that hold PER_TASK events each; Parquet has the count at hand."""
    return 1 + table(spark, sf_dir, "events").count() // PER_TASK


def active_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    app = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in APPS.items()))
    tz = F.when(F.col("user_id") % 3 == 0, -300).when(F.col("user_id") % 3 == 1, 0).otherwise(540)
    e = e.select(
        F.col("event_id").cast("string").alias("event_id"), F.col("event_id").alias("n"), F.col("user_id").cast("string").alias("session_id"),
        epoch_ms("ts").alias("timestamp"), epoch_ms("ts").alias("monotonic_ms"), app.alias("app_name"),
        F.concat(F.lit("("), (F.col("event_id") % 9).cast("string"), F.lit(") "), F.col("event_type"), F.lit(" page - Google Chrome")).alias("window_title"),
        tz.alias("timezone_offset"), "event_type", "value", "props", "ts",
    )
    return assign_seq(e.repartition(parts(spark, sf_dir), "session_id"), ["session_id"], ["ts", "n"]).drop("ts")


def dwells(spark: SparkSession, sf_dir: str, cap_ms: int = CAP_MS) -> DataFrame:
    d = dwell_from_windows(active_windows(spark, sf_dir))
    cut = F.least("dwell_time_ms", F.lit(cap_ms))
    d = d.withColumns({"timestamp_ms": F.col("start_monotonic_ms") + cut, "end_monotonic_ms": F.col("start_monotonic_ms") + cut, "dwell_time_ms": cut})
    # ids by number, as SQL writes them
    return d.withColumn("id", F.lpad("window_event_id", 12, "0"))


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("session_id"), epoch_ms("ts").alias("timestamp_ms"),
        epoch_ms("ts").alias("monotonic_ms"), F.get_json_object("props", "$.k").cast("long").alias("key_count"),
        (F.col("event_type") == "click").cast("long").alias("click_count"), F.floor("value").cast("long").alias("mouse_distance"),
        (F.col("event_id") % 7 - 3).alias("scroll_delta"), (F.col("event_id") % 5 * 1000).alias("idle_ms"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines of one file a user, some of them damaged."""
    w = active_windows(spark, sf_dir)
    seq = F.when(F.col("n") % 101 == 0, F.greatest(F.col("seq") - 1, F.lit(0))).otherwise(F.col("seq"))
    text = F.concat(F.lit('{"event_id":"'), F.col("event_id"), F.lit('","session_id":"'), F.col("session_id"), F.lit('","seq":'), seq.cast("string"), F.lit("}"))
    line = F.when(F.col("n") % 97 == 0, F.substring(text, 1, 20)).otherwise(text)
    return w.select(F.concat(F.lit("events-"), F.col("session_id")).alias("file"), F.col("seq").cast("int").alias("pos"), "session_id", line.alias("line"), seq.alias("seq"), "n")


def goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A goal for each label of ``embeddings``: its first vector."""
    v = table(spark, sf_dir, "embeddings")
    g = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("goal_vector"))
    return g.select(F.concat(F.lit("g"), F.col("label").cast("string")).alias("goal_id"), "goal_vector", F.col("label").alias("goal_label"))


def windows_of_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a window of every goal, on two days (shifted on the first).
    Goals are the ten labels, so windows grow with the vectors."""
    v = table(spark, sf_dir, "embeddings")
    ids = F.explode(F.array(*(F.lit(f"g{k}") for k in range(10)))).alias("goal_id")
    day = F.explode(F.array(F.lit("2024-01-01"), F.lit("2024-01-02"))).alias("day_utc")
    x = v.select("vec_id", "embedding", ids).select("*", day)
    shift = F.when(F.col("day_utc") == "2024-01-01", 0.1).otherwise(0.0)
    x = x.withColumn("vector", F.transform("embedding", lambda p: p.cast("double") + shift))
    return x.select("vec_id", "goal_id", "day_utc", "vector", ((F.col("vec_id") % 40) * 1000).alias("dwell_ms"), F.lit("Google Chrome").alias("app_name"))


