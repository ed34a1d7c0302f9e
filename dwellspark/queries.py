"""Queries of the activity operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import boosts as B
from .functions import timefns as T
from .functions import titles as N
from .functions.categories import RULES, categorize, with_category
from .operators import audit, dwell, features, inputs, reports, semantic
from .options import CATEGORIES, FeatureOptions, SemanticOptions
from .plans import activity as A
from .scratch import cut, shared_dir
from .sources import logs, sinks
from .streaming import streams

QUERIES = {}
KEYS = ["session_id"]
_MS = [f"{c}_ms" for c in CATEGORIES]


def query(f):
    QUERIES[f.__name__] = f
    return f


def _features(s, d, **o):
    return features.build_features(A.dwells(s, d), A.deltas(s, d), KEYS, FeatureOptions(**o), parts=A.parts(s, d))


def _daily(s, d):
    return reports.daily_totals(_features(s, d), KEYS)


def _pages(s, d):
    p = A.table(s, d, "pages")
    title = F.concat(
        F.lit("Visit "), F.col("url"), F.lit(" mail user"), F.col("page_id").cast("string"), F.lit("@site.org C:\\Users\\bob\\doc"),
        F.col("page_id").cast("string"), F.lit(".txt in /var/log/app/"), F.col("page_id").cast("string"), F.lit(".log of /tmp"),
    )
    return p.select("page_id", title.alias("title"))


def _titles(s, d):
    p = A.table(s, d, "pages")
    n = F.col("page_id").cast("string")
    title = F.concat(
        F.lit("("), n, F.lit(") Watch Later - "), F.regexp_extract("url", "//([^/]+)", 1), F.lit(" [HD] 12:30 "), n, F.lit(" views follow-up 0123456789abcdef012 - YouTube - Google Chrome")
    )
    return p.select("page_id", title.alias("title"), F.when(F.col("page_id") % 2 == 0, "Chrome").otherwise(" Safari ").alias("app"))


def _end(df, days: int):
    """One row of session 'end' so many days behind the last, other columns null."""
    ts = df.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.make_dt_interval(F.lit(days))).alias("ts"))
    given = {"session_id": F.lit("end"), "event_id": F.lit(f"end{days}"), "seq": F.lit(days).cast("long"), "ts": F.col("ts"), "monotonic_ms": F.unix_millis("ts")}
    return ts.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema))


def _scratch(s: SparkSession) -> str:
    return f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"


def _stream(s: SparkSession, df: DataFrame) -> tuple[DataFrame, str]:
    """A table as a stream: written as files, read back as they come."""
    folder = _scratch(s)
    df.write.mode("overwrite").parquet(f"{folder}/in")
    return s.readStream.schema(df.schema).parquet(f"{folder}/in"), folder


# windows and dwell


@query
def assign_seq(s, d):
    return A.active_windows(s, d).select("session_id", "event_id", "seq", "timestamp", "app_name", "timezone_offset")


@query
def window_changes(s, d):
    w = A.active_windows(s, d).withColumn("app_name", F.when(F.col("n") % 13 != 0, F.col("app_name"))).withColumn("window_title", F.col("app_name"))
    return dwell.window_changes(w, ["seq"]).select("session_id", "event_id", "app_name")


@query
def resolve_poll(s, d):
    p = A.table(s, d, "pages").select("page_id", F.col("url").alias("title"), F.struct(
        F.when(F.col("page_id") % 3 == 0, "  Chrome ").when(F.col("page_id") % 3 == 1, "  ").alias("name"), F.lit("").alias("processName"), F.lit(None).cast("string").alias("bundleId")).alias("owner"))
    return dwell.resolve_poll(p).select("page_id", "app_name", "window_title", "process_name")


@query
def window_records(s, d):
    """Polls of windows as records: every event is a poll, some without an owner's name."""
    w, n = A.active_windows(s, d), F.col("n")
    owner = F.struct(F.when(n % 7 != 0, F.col("app_name")).alias("name"), F.when(n % 2 == 0, F.lit("p.exe")).otherwise("").alias("processName"), F.when(n % 5 == 0, F.lit("com.x")).alias("bundleId"))
    title = F.when(n % 21 != 0, F.when(n % 3 == 0, F.col("event_type")).otherwise("page"))
    polls = w.select("session_id", "timestamp", "monotonic_ms", "timezone_offset", "n", title.alias("title"), owner.alias("owner"))
    return dwell.window_records(polls, ["timestamp", "n"])


@query
def log_folder(s, d):
    """A folder of logs by day and rotation: order, lines, tail and gaps of each file."""
    folder, name = _scratch(s), F.concat(F.lit("events-"), F.date_format(F.timestamp_millis("timestamp"), "yyyyMMdd"), F.when(F.col("n") % 2 == 0, ".1").otherwise(""), F.lit(".jsonl"))
    w = A.active_windows(s, d)
    text = F.concat(F.lit('{"session_id":"'), "session_id", F.lit('","seq":'), F.col("n").cast("string"), F.lit("}"))
    lines = w.select(name.alias("file"), "n", F.when(F.col("n") % 97 == 0, F.substring(text, 1, 20)).otherwise(text).alias("value"))
    lines.repartition("file").sortWithinPartitions("file", "n").select("file", "value").write.partitionBy("file").text(f"{folder}/written")
    logs.as_log_files(s, f"{folder}/written", f"{folder}/log")
    x = logs.read_log_lines(s, f"{folder}/log")
    order = audit.log_file_order(logs.list_log_files(s, f"{folder}/log"))
    per = audit.audit_log(x).join(audit.log_tail_seq(x), "file")
    return order.join(per, "file").select("file", "log_date", "rotation", "newest", "bytes", "lines", "parse_errors", "first_bad_pos", "tail_seq", "truncated_lines")


_DW = ["session_id", "window_event_id", "app_name", "timezone_offset", "timestamp_ms", "start_monotonic_ms", "dwell_time_ms"]


@query
def dwell_from_windows(s, d):
    return A.dwells(s, d).select(*_DW)


@query
def heartbeat_split(s, d):
    return dwell.heartbeat_split(A.dwells(s, d)).select(*_DW)


@query
def dwells_uncut(s, d):
    """Dwells of their whole length, in pieces of an hour."""
    return dwell.heartbeat_split(A.dwells(s, d, 1 << 50), 3_600_000).select("session_id", "window_event_id", "start_monotonic_ms", "dwell_time_ms")


@query
def dwell_time_range(s, d):
    return dwell.dwell_time_range(A.dwells(s, d))


@query
def dwells_in_range(s, d):
    return dwell.dwells_in_range(A.dwells(s, d), 1_704_500_000_000, 1_705_000_000_000).select(*_DW)


@query
def session_dwells(s, d):
    return dwell.session_dwells(A.dwells(s, d), "1").select(*_DW)


@query
def confirm_labels(s, d):
    w = A.active_windows(s, d)
    seen = w.select("session_id", F.floor(F.col("seq") / 6).cast("string").alias("window_event_id"), F.col("monotonic_ms").alias("t"), F.when(F.col("n") % 3 == 0, "on_goal").otherwise("related").alias("label"))
    return dwell.confirm_labels(seen, 20_000_000)


# one session with a third of all events, worked on in ranges


def _hot(s, d):
    w = A.active_windows(s, d).drop("seq").withColumn("session_id", F.when(F.col("n") % 3 == 0, "hot").otherwise(F.col("session_id")))
    return dwell.assign_seq(w, ["session_id"], ["monotonic_ms", "n"], hot=True)


@query
def hot_dwells(s, d):
    return dwell.dwell_from_windows(_hot(s, d), hot=True).select(*_DW, "seq")


@query
def hot_changes(s, d):
    return dwell.window_changes(_hot(s, d).withColumn("window_title", F.lit("")), ["seq"], hot=True).select("session_id", "event_id", "app_name")


@query
def hot_asof(s, d):
    x = A.deltas(s, d).withColumn("session_id", F.when(F.col("id").cast("long") % 2 == 0, "hot").otherwise(F.col("session_id")))
    return inputs.inputs_asof_window(x, _hot(s, d), hot=True).select("session_id", "monotonic_ms", "key_count", "scroll_delta", "active_window_id", "window_start_ms")


@query
def hot_audit(s, d):
    return audit.audit_sequence(_hot(s, d).withColumn("seq", F.when(F.col("n") % 101 == 0, F.col("seq") + 1).otherwise(F.col("seq"))), hot=True)


@query
def hot_labels(s, d):
    w = _hot(s, d)
    label = F.when(F.col("n") % 3 == 0, F.when(F.floor(F.col("seq") / 5) % 2 == 0, "on_goal").otherwise("off")).otherwise("related")
    return dwell.confirm_labels(w.select("session_id", F.lit("w").alias("window_event_id"), F.col("monotonic_ms").alias("t"), label.alias("label")), 20_000_000, hot=True)


# categories and titles


@query
def categorize_apps(s, d):
    return A.active_windows(s, d).select("event_id", categorize("app_name").alias("category"))


@query
def categorize_join(s, d):
    rules = s.createDataFrame([(i, p, c) for i, (p, c) in enumerate([("chrome", "video"), *RULES])], "rule_no long, pattern string, category string")
    p = A.table(s, d, "pages").select("page_id", F.regexp_extract("url", "//([^/]+)", 1).alias("app_name"))
    return with_category(p, "app_name", rules).select("page_id", "category")


@query
def sanitize_title(s, d):
    return _pages(s, d).select("page_id", N.sanitize_title("title").alias("clean"))


@query
def normalize_title(s, d):
    return _titles(s, d).select("page_id", N.normalize_title("app", "title").alias("normalized"), N.domain_hint("title").alias("hint"))


@query
def app_boost(s, d):
    return A.active_windows(s, d).select("event_id", N.app_boost("app_name", F.when(F.col("n") % 2 == 0, "tube").when(F.col("n") % 3 == 0, "my slack app")).alias("boost"))


@query
def boosts(s, d):
    """Titles of pages, apps and keywords by the page's number, with the built-in boosts."""
    p, n = A.table(s, d, "pages"), F.col("page_id")
    word = F.element_at(F.array(*map(F.lit, ("LeetCode 12", "a Pull Request", "shorts", "MySQL and Netflix", "nothing"))), (n % 5 + 1).cast("int"))
    app = F.element_at(F.array(*map(F.lit, ("Google Chrome", "Visual Studio Code", "CMD", "YouTube", "Netflix app", "Mail"))), (n % 6 + 1).cast("int"))
    x = p.select("page_id", app.alias("app"), F.concat_ws(" ", "url", word).alias("text"))
    return x.select("page_id", F.round(B.app_rule_boost("app", "text"), 2).alias("app_boost"), F.round(B.keyword_boost("text"), 2).alias("keyword_boost"))


@query
def boosts_by_table(s, d):
    """Parts' names against a table of terms made of other parts: one word, two words, and
    one word for one brand."""
    p, k = A.table(s, d, "part"), F.col("p_partkey")
    first = F.substring_index("p_name", " ", 1)
    terms = p.select(F.when(k % 3 == 0, first).when(k % 3 == 1, F.upper("p_name")).otherwise(F.substring_index("p_name", " ", -1)).alias("term"), F.when(k % 2 == 0, F.col("p_brand")).alias("app_name"), ((k % 41 - 20) / 100).alias("boost"))
    x = p.select("p_partkey", F.col("p_brand").alias("app_name"), F.concat_ws(" ", F.lit("The"), "p_name").alias("text"))
    return B.with_table_boost(x, terms).select("p_partkey", F.round("boost", 2).alias("boost"))


@query
def categorize_many(s, d):
    """Names against thousands of plain rules and some regular expressions."""
    p = A.table(s, d, "part")
    k = F.col("p_partkey")
    plain = p.select((k * 2).alias("rule_no"), F.concat(F.lit("q"), k.cast("string"), F.lit("z|Z"), k.cast("string"), F.lit(" x")).alias("pattern"), F.concat(F.lit("plain"), (k % 5).cast("string")).alias("category"))
    regex = s.createDataFrame([(101, "^a[0-9]+7$", "seven"), (1_000_001, "b.*99", "late")], "rule_no long, pattern string, category string")
    n = F.col("page_id")
    name = F.when(n % 4 == 0, F.concat(F.lit("A"), n.cast("string"))).when(n % 4 == 1, F.concat(F.lit("app Q"), n.cast("string"), F.lit("Z"))).when(n % 4 == 2, F.concat(F.lit("b z"), n.cast("string"), F.lit(" X 99")))
    pages = A.table(s, d, "pages").select("page_id", name.alias("app_name"))
    return with_category(pages, "app_name", plain.unionByName(regex)).select("page_id", "category")


@query
def goal_text(s, d):
    p = A.table(s, d, "part").select("p_partkey", F.concat(F.lit("  Read "), F.col("p_name"), F.lit("  ")).alias("todo"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("hint"))
    return p.select("p_partkey", N.normalize_goal("todo").alias("goal"), N.goal_display("todo", "hint").alias("shown"))


# inputs


@query
def inputs_asof_window(s, d):
    w = A.active_windows(s, d).where("n % 4 = 0")
    x = A.deltas(s, d)
    return inputs.inputs_asof_window(x, w).select("session_id", "monotonic_ms", "active_window_id", "window_start_ms", "key_count")


@query
def input_summaries(s, d):
    return inputs.input_summaries(A.deltas(s, d), A.active_windows(s, d).where("n % 4 = 0"), 3_600_000)


@query
def input_summaries_carried(s, d):
    """Sums of slots that hold only scrolling backwards go on to later ones; most slots
    here hold nothing else."""
    x = A.deltas(s, d)
    few = F.col("id").cast("long") % 5 == 0
    x = x.withColumns({c: F.when(few, F.col(c)).otherwise(0) for c in inputs.COUNTERS if c != "scroll_delta"})
    return inputs.input_summaries(x, A.active_windows(s, d).where("n % 4 = 0"), 3_600_000, carry=True)


@query
def accumulate_inputs(s, d):
    return inputs.accumulate(A.deltas(s, d), KEYS).where(inputs.is_dirty())


@query
def inputs_in_days(s, d):
    low, high = T.day_range_ms("a", "b")
    days = s.range(1).select(F.lit("2024-01-05").alias("a"), F.lit("2024-01-08").alias("b")).select(low.alias("low"), high.alias("high")).first()
    return inputs.inputs_in_range(A.deltas(s, d), days.low, days.high).select("id", "session_id", "timestamp_ms")


@query
def inputs_in_range(s, d):
    return inputs.inputs_in_range(A.deltas(s, d), 1_704_500_000_000, 1_705_000_000_000).select("id", "session_id", "timestamp_ms", "key_count")


# features


@query
def dwell_x_bucket(s, d):
    return features.dwell_x_bucket(A.dwells(s, d)).select("session_id", "window_event_id", "window_start", "overlap_ms")


@query
def app_ms(s, d):
    x = features.app_ms(features.dwell_x_bucket(A.dwells(s, d)), KEYS, A.parts(s, d))
    return x.select("session_id", "window_start", "app_name", "ms", F.col("rows").alias("n_rows"))


@query
def bucket_inputs(s, d):
    return features.bucket_inputs(A.deltas(s, d), KEYS, parts=A.parts(s, d))


@query
def build_features(s, d):
    f = _features(s, d)
    rounded = [F.round(c, 6).alias(c) for c in ("key_rate", "click_rate", "scroll_rate", "mouse_speed", "idle_ratio")]
    return f.select("session_id", "window_start", "window_start_utc", "window_start_local", "timezone_offset", *_MS, "context_switch_count", "top_app_name", "top_category", "deep_work_candidate_flag", *rounded)


@query
def top_key(s, d):
    return _features(s, d).select("session_id", "window_start", "top_app_name", "top_category")


@query
def features_60s(s, d):
    return _features(s, d, window_ms=60_000, count_mode="windows", extra_flags=True).select("session_id", "window_start", "context_switch_count", "code_ms", "video_like_flag", "night_flag", "weekday_flag")


@query
def features_calm(s, d):
    """Deep work only with little video, social and game time."""
    return _features(s, d, deep_distraction_ms=2_000, deep_ms=5_000, deep_switches=3, deep_idle=1.0).select("session_id", "window_start", "deep_work_candidate_flag")


@query
def write_features(s, d):
    """Features exported by local day, as Parquet and as CSV, and read back."""
    folder, out = _scratch(s), []
    for kind in ("parquet", "csv"):
        features.write_features(_features(s, d).select("session_id", "window_start", "window_start_local", "code_ms"), f"{folder}/{kind}", kind)
        x = s.read.option("header", True).format(kind).load(f"{folder}/{kind}")
        out.append(x.select(F.lit(kind).alias("kind"), F.col("session_id").cast("string").alias("session_id"), F.col("window_start").cast("long").alias("window_start"), F.col("code_ms").cast("long").alias("code_ms"), F.col("local_date").cast("string").alias("local_date")))
    return logs.merge_streams(*out)


@query
def features_on_local_day(s, d):
    return features.features_on_local_day(_features(s, d), "2024-01-05").select("session_id", "window_start_local", "other_ms", "code_ms")


@query
def upsert_features(s, d):
    f = _features(s, d).select("session_id", "window_start", "code_ms")
    new = f.where("window_start % 7 = 0").withColumn("code_ms", F.lit(-1).cast("long"))
    return sinks.upsert(new, f, ["session_id", "window_start"])


# reports


@query
def daily_totals(s, d):
    return _daily(s, d).drop("timezone_offset")


@query
def top_apps(s, d):
    return reports.top_apps(A.dwells(s, d), KEYS, limit=2).select("session_id", "app_name", "total_ms", "rank")


@query
def top_distractions(s, d):
    return reports.top_distractions(A.dwells(s, d).withColumn("category", categorize("app_name")), KEYS).select("session_id", "app_name", "total_ms", "rank")


@query
def day_bounds_join(s, d):
    x = reports.day_bounds_join(A.dwells(s, d), _daily(s, d), KEYS)
    return x.groupBy("session_id", "local_date").agg(F.count("*").alias("dwells"), F.sum("dwell_time_ms").cast("long").alias("total_ms"))


@query
def daily_report(s, d):
    x = reports.daily_report(_features(s, d), A.dwells(s, d), KEYS, 3)
    return x.select("session_id", "local_date", "deep_work_ms", F.explode("top_apps").alias("t")).select("session_id", "local_date", "deep_work_ms", "t.rank", "t.app_name", "t.total_ms")


@query
def weekly_report(s, d):
    x = reports.weekly_report(_daily(s, d), KEYS, "2024-01-10")
    return x.select("session_id", "first_day", "last_day", *_MS, "deep_work_ms", "context_switches", F.size("trend_data").alias("days"))


@query
def dense_days(s, d):
    return reports.dense_days(_daily(s, d), KEYS, "2024-01-10").select("session_id", "local_date", "code_ms", "windows")


@query
def deep_work_blocks(s, d):
    return reports.deep_work_blocks(_features(s, d), KEYS)


@query
def report_text(s, d):
    x = reports.daily_report(_features(s, d), A.dwells(s, d), KEYS, 3)
    return reports.report_text(x).select("session_id", "local_date", "report")


@query
def report_text_weekly(s, d):
    return reports.weekly_text(reports.weekly_report(_daily(s, d), KEYS, "2024-01-10")).select("session_id", "report")


@query
def weekly_trend(s, d):
    x = reports.weekly_report(_daily(s, d), KEYS, "2024-01-10").select("session_id", F.explode("trend_data").alias("t"))
    return x.select("session_id", "t.*")


@query
def weekly_days(s, d):
    """Each day's whole report inside the week's."""
    daily = reports.daily_report(_features(s, d), A.dwells(s, d), KEYS, 2)
    x = reports.weekly_report(daily, KEYS, "2024-01-10").select("session_id", F.explode("days").alias("t"))
    return x.select("session_id", "t.local_date", "t.windows", "t.deep_work_ms", F.explode_outer("t.top_apps").alias("a")).select("session_id", "local_date", "windows", "deep_work_ms", "a.rank", "a.app_name")


@query
def report_json(s, d):
    return reports.report_json(_daily(s, d).select("session_id", "local_date", "code_ms"))


@query
def fmt_duration(s, d):
    return A.dwells(s, d).select("window_event_id", N.fmt_duration(F.col("dwell_time_ms") * 40).alias("text"))


@query
def time_functions(s, d):
    w = A.active_windows(s, d)
    day = F.substring(T.iso_local("timestamp", "timezone_offset"), 1, 10)
    return w.select("event_id", T.iso_utc("timestamp").alias("utc"), T.iso_local("timestamp", "timezone_offset").alias("local"), T.bucket_start("timestamp", 30_000).alias("bucket"), T.date_key("timestamp", "timezone_offset").alias("day_key"), T.local_day_to_utc_ms(day, "timezone_offset").alias("day_start_ms"))


# semantic scores


def _scored(s, d, shift=0.0, calibration=None, options=SemanticOptions()):
    w = A.windows_of_goals(s, d)
    if shift:
        w = w.withColumn("vector", F.transform("vector", lambda x: x + shift))
    g = A.goals(s, d).withColumn("app_hint", F.when(F.col("goal_label") % 2 == 0, "chrome")).drop("goal_label").withColumnRenamed("goal_id", "gid")
    w = w.withColumnRenamed("goal_id", "key")
    g = g.withColumn("key", F.col("gid")).withColumnRenamed("gid", "goal_id")
    fixed = s.createDataFrame([], "goal_id string, day_utc string, t_on double, t_off double")
    return semantic.score_windows(w, g, fixed if calibration is None else calibration, options, on=["key"])


@query
def score_windows(s, d):
    x = _scored(s, d)
    return x.select("vec_id", F.col("key").alias("goal"), "day_utc", F.round("sim_score", 6).alias("sim_score"), F.round("final_score", 6).alias("final_score"), "label", "confidence")


@query
def calibrate_thresholds(s, d):
    shift = F.when(F.col("day_utc") == "2024-01-01", 0.1).otherwise(0.0)
    raw = A.windows_of_goals(s, d).join(A.goals(s, d), "goal_id").withColumn("goal_vector", F.transform("goal_vector", lambda x: x + shift))
    raw = raw.select("goal_id", "day_utc", semantic.cosine("vector", "goal_vector").alias("score"))
    c = semantic.calibrate(raw)
    return c.select("goal_id", "day_utc", F.round("t_on", 6).alias("t_on"), F.round("t_off", 6).alias("t_off"), "sample_count")


def _calibration(s, d):
    """Pairs measured on the first day over older ones of both days and of every second goal."""
    raw = A.windows_of_goals(s, d).where("day_utc = '2024-01-01'").join(A.goals(s, d), "goal_id")
    raw = raw.select("goal_id", "day_utc", semantic.cosine("vector", "goal_vector").alias("score"))
    new = semantic.calibrate(raw, SemanticOptions(min_samples=5, min_mean=-1.0))
    day = F.explode(F.array(F.lit("2024-01-01"), F.lit("2024-01-02"))).alias("day_utc")
    old = A.goals(s, d).where("goal_label % 2 = 0").select("goal_id", day, F.lit(0.2).alias("t_on"), F.lit(0.1).alias("t_off"), F.lit(0).cast("long").alias("sample_count"))
    return sinks.upsert(new, old, ["goal_id", "day_utc"])


@query
def upsert_calibration(s, d):
    return _calibration(s, d).select("goal_id", "day_utc", F.round("t_on", 6).alias("t_on"), F.round("t_off", 6).alias("t_off"), "sample_count")


@query
def score_calibrated(s, d):
    x = _scored(s, d, calibration=_calibration(s, d))
    return x.select("vec_id", F.col("key").alias("goal"), "day_utc", "threshold_mode", F.round("t_on", 6).alias("t_on"), F.round("t_off", 6).alias("t_off"), "label")


@query
def compare_models(s, d):
    a = _scored(s, d).where("key = 'g1' AND day_utc = '2024-01-01'")
    b = _scored(s, d, 0.05).where("key = 'g1' AND day_utc = '2024-01-01'")
    return semantic.compare_models(a, b, "vec_id").select("vec_id", F.round("delta", 6).alias("delta"), "label_same")


@query
def compare_models_all(s, d):
    key = ["vec_id", "key", "day_utc"]
    x = semantic.compare_models(_scored(s, d), _scored(s, d, 0.05), key)
    return x.select("vec_id", F.col("key").alias("goal"), "day_utc", F.round("delta", 6).alias("delta"), "label_same")


@query
def score_forced(s, d):
    """Calibrated pairs are there, but fixed thresholds are forced."""
    x = _scored(s, d, calibration=_calibration(s, d), options=SemanticOptions(force_fixed=True))
    return x.select("vec_id", F.col("key").alias("goal"), "day_utc", "threshold_mode", "label")


@query
def on_goal_time(s, d):
    return semantic.on_goal_time(_scored(s, d), []).withColumnRenamed("label", "label")


@query
def goal_table(s, d):
    w = A.active_windows(s, d)
    log = w.select(F.col("session_id").alias("user_id"), F.col("seq").alias("at_ms"), F.when(F.col("n") % 5 == 0, "clear").otherwise("set").alias("action"), F.concat(F.lit("Do "), F.col("event_id")).alias("todo_text"), F.when(F.col("n") % 2 == 0, F.col("app_name")).alias("app_hint"))
    return semantic.apply_goal_log(log)


@query
def embed_distinct(s, d):
    p = A.table(s, d, "part").select("p_partkey", F.col("p_brand").alias("text"))
    length = lambda t: t.select("text", F.array(F.length("text").cast("double")).alias("vector"))
    return semantic.embed_distinct(p, "text", length).select("p_partkey", F.col("vector")[0].alias("v0"))


# logs


@query
def audit_log(s, d):
    return audit.audit_log(A.log_lines(s, d))


@query
def log_tail_seq(s, d):
    return audit.log_tail_seq(A.log_lines(s, d)).select("file", "tail_seq", "truncated_lines", "truncated")


@query
def audit_sequence(s, d):
    return audit.audit_sequence(A.log_lines(s, d).withColumn("seq", F.col("seq").cast("long")))


def _ckpt(s, d):
    t = audit.log_tail_seq(A.log_lines(s, d)).select(F.col("file").alias("session_id"), F.col("tail_seq"))
    n = F.regexp_extract("session_id", "([0-9]+)$", 1).cast("long") % 3
    return t, t.select("session_id", (F.col("tail_seq") + n - 1).alias("last_flushed_seq"))


@query
def reconcile_checkpoint(s, d):
    return audit.reconcile_checkpoint(*_ckpt(s, d))


@query
def audit_checkpoint(s, d):
    return audit.audit_checkpoint(*_ckpt(s, d)).select("session_id", "tail_seq", "last_flushed_seq")


@query
def validate_events(s, d):
    w = A.active_windows(s, d)
    good = F.to_json(F.struct(F.lit("1.0.0").alias("schema_version"), F.when(F.col("n") % 11 != 0, F.col("event_id")).alias("event_id"), "session_id", F.when(F.col("n") % 13 == 0, -1).otherwise(F.col("seq")).alias("seq"),
        F.when(F.col("n") % 17 == 0, "soon").otherwise(T.iso_utc("timestamp")).alias("created_at"), F.col("timestamp").alias("epoch_ms"), "monotonic_ms", "timezone_offset", F.lit("os").alias("source"), F.col("event_type").alias("type"),
        F.struct("value").alias("payload")))
    lines = w.select(F.col("event_id").alias("id"), F.when(F.col("n") % 19 == 0, "not json").otherwise(good).alias("line"))
    return audit.validate_events(lines).select("id", "violation")


@query
def insert_or_ignore(s, d):
    w = A.active_windows(s, d).withColumn("event_id", F.when(F.col("n") % 23 == 0, "dup").otherwise(F.col("event_id")))
    old = w.where("n % 10 = 0 AND event_id <> 'dup'")
    new = sinks.insert_or_ignore(w.withColumn("session_id", F.when(F.col("n") % 29 != 0, F.col("session_id"))), old, [["event_id"], ["session_id", "seq"]], ["session_id"], ["n"])
    return new.select("event_id", "session_id", "seq")


@query
def events_raw(s, d):
    return sinks.events_raw(A.active_windows(s, d).select("event_id", "session_id", "seq", F.lit("x").alias("created_at"), "timezone_offset", "timestamp", "monotonic_ms", F.col("event_type").alias("type")))


@query
def merge_streams(s, d):
    w = A.active_windows(s, d).select("session_id", "timestamp", F.lit("active_window").alias("type"))
    i = A.deltas(s, d).select("session_id", F.col("timestamp_ms").alias("timestamp"), F.lit("input_summary").alias("type"), "key_count")
    return logs.merge_streams(w, i).groupBy("session_id", "type").agg(F.count("*").alias("n"), F.sum("key_count").alias("keys_n"))


@query
def log_file_order(s, d):
    o = A.table(s, d, "orders").select(F.concat(F.lit("events-"), F.date_format("o_orderdate", "yyyyMMdd"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("."), (F.col("o_orderkey") % 12).cast("string"))).otherwise(""), F.lit(".jsonl")).alias("file")).distinct()
    return audit.log_file_order(o).select("file", "log_date", "rotation", "newest")


@query
def retention_purge(s, d):
    o = A.table(s, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("bytes"))
    files = o.select(F.date_format("day", "yyyyMMdd").alias("file"), (F.unix_date("day").cast("long") * 86_400_000).alias("log_day_ms"), "bytes")
    return audit.retention_purge(files, 900_000_000_000, 2_000, 500)


# streams, each over what is there


@query
def stream_dwell(s, d):
    sdf, folder = _stream(s, A.active_windows(s, d).select("session_id", "seq", "event_id", "app_name", "monotonic_ms"))
    return streams.run_available(streams.stream_dwell(sdf), folder)


@query
def stream_heartbeats(s, d):
    """Windows in four runs of one query that is stopped in between; events of a session
    of its own, days behind the others, move time on until every session is closed."""
    w = A.active_windows(s, d).select("session_id", "seq", "event_id", "app_name", "monotonic_ms", F.timestamp_millis("timestamp").alias("ts"))
    slices = [w.where("ts < '2024-01-10'"), w.where("ts >= '2024-01-10' AND ts < '2024-01-20'"), w.where("ts >= '2024-01-20'")]
    slices[2:] = [slices[2].unionByName(_end(w, 2)), _end(w, 3)]
    return streams.run_slices(slices, lambda x: streams.stream_dwell(x, 7_200_000, 36_000_000), _scratch(s)).where("session_id <> 'end'")


@query
def stream_window_changes(s, d):
    w = A.active_windows(s, d).select("session_id", "seq", "monotonic_ms", "app_name", F.col("app_name").alias("window_title"))
    sdf, folder = _stream(s, w)
    return streams.run_available(streams.stream_window_changes(sdf), folder).select("session_id", "seq", "app_name")


@query
def stream_dedup(s, d):
    w = A.active_windows(s, d).select("event_id", F.timestamp_millis("timestamp").alias("ts"))
    sdf, folder = _stream(s, w.unionByName(w))
    return streams.run_available(streams.stream_dedup(sdf, "60 days"), folder).select("event_id")


@query
def stream_confirm_label(s, d):
    w = A.active_windows(s, d)
    sdf, folder = _stream(s, w.select(F.concat_ws("-", "session_id", F.floor(F.col("seq") / 6).cast("string")).alias("window_event_id"), F.col("monotonic_ms").alias("t"), F.when(F.col("n") % 3 == 0, "on_goal").otherwise("related").alias("label")))
    out = streams.run_available(streams.stream_confirm_label(sdf, 20_000_000), folder)
    return out.groupBy("window_event_id").agg(F.max_by("semantic_label", "t").alias("semantic_label"))


@query
def stream_input_summary(s, d):
    x = inputs.inputs_asof_window(A.deltas(s, d), A.active_windows(s, d)).where("active_window_id IS NOT NULL").withColumn("ts", F.timestamp_millis("monotonic_ms"))
    sdf, folder = _stream(s, x)
    out = streams.stream_input_summary(sdf, 3_600_000, "0 seconds")
    return streams.run_available(out, folder)


def _by_time(df: DataFrame, ms: str) -> list[DataFrame]:
    """Slices of a table by time, and after them three rows of a session of its own,
    days behind, that move time on until all is written. The table is written once, as
    each slice would work it out again."""
    df, t = cut(df), F.col(ms)
    slices = [df.where(t < 1704844800000), df.where((t >= 1704844800000) & (t < 1705708800000)), df.where(t >= 1705708800000)]
    return [*slices, *(_end(df, k) for k in (2, 3, 4))]


@query
def stream_asof_summaries(s, d):
    """Inputs and windows as two streams that are stopped between slices."""
    x = A.deltas(s, d)
    few = F.col("id").cast("long") % 5 == 0
    x = x.withColumns({c: F.when(few, F.col(c)).otherwise(0) for c in inputs.COUNTERS if c != "scroll_delta"})
    both = logs.merge_streams(
        x.select("session_id", "monotonic_ms", F.lit("input").alias("type"), *inputs.COUNTERS),
        A.active_windows(s, d).where("n % 4 = 0").select("session_id", "monotonic_ms", F.lit("window").alias("type"), "event_id"),
    ).withColumn("ts", F.timestamp_millis("monotonic_ms"))
    make = lambda e: streams.stream_asof_summary(e.where("type = 'input'"), e.where("type = 'window' OR session_id = 'end'"), 3_600_000, "0 seconds", carry=True)
    return streams.run_slices(_by_time(both, "monotonic_ms"), make, _scratch(s)).where("session_id <> 'end'")


@query
def stream_features(s, d):
    """Dwells and inputs as two streams that are stopped between slices."""
    both = logs.merge_streams(A.dwells(s, d).withColumn("type", F.lit("dwell")), A.deltas(s, d).withColumn("type", F.lit("input"))).withColumn("ts", F.timestamp_millis("timestamp_ms"))
    ends = "session_id = 'end'"
    stamped = lambda e: e.withColumn("timestamp_ms", F.unix_millis("ts")).withColumn("dwell_time_ms", F.coalesce("dwell_time_ms", F.lit(1)))
    make = lambda e: streams.stream_features(stamped(e.where(f"type = 'dwell' OR {ends}")), stamped(e.where(f"type = 'input' OR {ends}")))
    out = streams.run_slices(_by_time(both, "timestamp_ms"), make, _scratch(s)).where(f"NOT {ends}")
    rounded = [F.round(c, 6).alias(c) for c in ("key_rate", "click_rate", "scroll_rate", "mouse_speed", "idle_ratio")]
    return out.select("session_id", "window_start", "window_start_utc", "window_start_local", "timezone_offset", *_MS, "context_switch_count", "top_app_name", "top_category", "deep_work_candidate_flag", *rounded)


def _events(s, d):
    """Windows, dwells and inputs as one event table with ``n``; some lack ``created_at``."""
    w, x, i = A.active_windows(s, d), A.dwells(s, d), A.deltas(s, d)
    e = logs.merge_streams(
        w.select("n", F.concat(F.lit("w"), "event_id").alias("event_id"), "session_id", (F.col("seq") * 2).alias("seq"), "timestamp", "monotonic_ms", "timezone_offset", F.lit("active_window").alias("type"), "app_name"),
        x.select(F.col("window_event_id").cast("long").alias("n"), F.concat(F.lit("d"), "window_event_id").alias("event_id"), "session_id", (F.col("seq") * 2 + 1).alias("seq"), F.col("timestamp_ms").alias("timestamp"), "timezone_offset",
            F.lit("window_dwell").alias("type"), "window_event_id", "app_name", "normalized_window_title", "start_monotonic_ms", "end_monotonic_ms", "dwell_time_ms"),
        i.select(F.col("id").cast("long").alias("n"), F.concat(F.lit("i"), "id").alias("event_id"), "session_id", (F.col("id").cast("long") + 1_000_000_000).alias("seq"), F.col("timestamp_ms").alias("timestamp"), "monotonic_ms", F.lit(0).alias("timezone_offset"),
            F.lit("input_summary").alias("type"), F.col("id").alias("active_window_id"), *(F.coalesce(c, F.lit(0)).alias(c) for c in inputs.COUNTERS), F.lit(0).cast("long").alias("dwell_time_ms")),
    )
    return e.withColumn("created_at", F.when(F.col("n") % 29 != 0, T.iso_utc("timestamp")))


@query
def stream_fanout(s, d):
    """Two runs of one stream. The second brings events of the first again, some under
    new ids; then the first batch is written once more. Rows of all three outputs."""
    e, folder = cut(_events(s, d), sinks.CODEC), _scratch(s)  # read five times
    early = e.where("timestamp < 1705276800000")
    again = early.where("n % 10 = 0").unionByName(early.where("n % 15 = 0").withColumn("event_id", F.concat(F.lit("x"), "event_id")))
    for part in (early, e.where("timestamp >= 1705276800000").unionByName(again)):
        part.write.mode("append").option("compression", sinks.CODEC).parquet(f"{folder}/in")
        sdf = s.readStream.schema(part.schema).parquet(f"{folder}/in")
        streams.stream_fanout(sdf, f"{folder}/out", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    sinks.fanout(early, f"{folder}/out", 0)
    out = [sinks.stored_rows(s, f"{folder}/out/{name}").select(F.lit(name).alias("sink"), "id", "session_id", "seq", "timestamp_ms") for name in ("events_raw", *sinks.DERIVED)]
    return logs.merge_streams(*out)


@query
def read_generations(s, d):
    """Three generations of records in one log: typed payloads (some of them no object),
    flat ones, and flat ones without a type."""
    _, folder = _stream(s, A.active_windows(s, d).limit(0))
    w = A.active_windows(s, d)
    n = F.col("n")
    inner = F.to_json(F.struct("app_name", F.when(n % 2 == 0, n).alias("key_count")))
    payload = F.when(n % 21 == 0, '"{not an object"').when(n % 33 == 0, "[1]").when(n % 15 == 0, "null").otherwise(inner)
    head = F.concat(F.lit('{"event_id":"'), "event_id", F.lit('","session_id":"'), "session_id", F.lit('","seq":'), F.col("seq").cast("string"))
    t = F.col("timestamp").cast("string")
    first = F.concat(head, F.lit(',"schema_version":"1.0.0","type":"active_window","epoch_ms":'), t, F.lit(',"payload":'), payload, F.lit("}"))
    flat = F.concat(head, F.lit(',"timestamp":'), t, F.lit(',"app_name":"'), "app_name", F.lit('"'))
    typed = F.concat(flat, F.lit(',"schema_version":"1.1.0","type":"window_dwell"}'))
    bare = F.concat(flat, F.when(n % 2 == 0, F.concat(F.lit(',"key_count":'), n.cast("string"))).otherwise(""), F.lit("}"))
    w.select(F.when(n % 3 == 0, first).when(n % 3 == 1, typed).otherwise(bare)).write.mode("overwrite").text(f"{folder}/log")
    return logs.read_all_versions(logs.read_event_log(s, f"{folder}/log", "part-*")).select("event_id", "session_id", "seq", "type", "timestamp", "app_name", "key_count")


@query
def validate_types(s, d):
    """Envelopes whose values have the wrong JSON type."""
    w, n = A.active_windows(s, d), F.col("n")
    payload = F.when(n % 7 == 0, '"{not an object"').when(n % 11 == 0, "[{}]").when(n % 13 == 0, "null").otherwise("{}")
    line = F.concat(F.lit('{"schema_version":'), F.when(n % 17 == 0, "1").otherwise('"1.0.0"'), F.lit(',"event_id":"'), "event_id", F.lit('","session_id":"'), "session_id", F.lit('","seq":'),
        F.when(n % 19 == 0, '"5"').when(n % 23 == 0, "1.5").otherwise(F.col("seq").cast("string")), F.lit(',"created_at":"'), T.iso_utc("timestamp"), F.lit('","epoch_ms":'), F.col("timestamp").cast("string"), F.lit(',"monotonic_ms":'),
        F.when(n % 29 == 0, "true").otherwise("12.5"), F.lit(',"timezone_offset":0,"source":"os","type":"t","payload":'), payload, F.lit("}"))
    lines = w.select("event_id", F.when(n % 31 == 0, F.concat(F.lit("["), line, F.lit("]"))).when(n % 37 == 0, '"text"').otherwise(line).alias("line"))
    return audit.validate_events(lines.withColumnRenamed("event_id", "id")).select("id", "violation")


@query
def read_event_log(s, d):
    """The events written as JSON lines, some of them broken, and read back."""
    _, folder = _stream(s, A.active_windows(s, d).limit(0))
    line = F.to_json(F.struct("event_id", "session_id", "seq", "timestamp", "app_name"))
    A.active_windows(s, d).select(F.when(F.col("n") % 19 == 0, "not json").otherwise(line)).write.mode("overwrite").text(f"{folder}/log")
    e = logs.read_all_versions(logs.read_event_log(s, f"{folder}/log", "part-*"))
    return e.groupBy("session_id", "type").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"), F.count("_corrupt").alias("corrupt"))


@query
def log_round_trip(s, d):
    """Events written as a log by date and read back as a stream."""
    folder = _scratch(s)
    e = A.active_windows(s, d).select("event_id", "session_id", "seq", F.col("timestamp").alias("epoch_ms"), "app_name")
    sinks.write_event_log(e, f"{folder}/log", 1000)
    back = logs.event_log_stream(s, f"{folder}/log", names="part-*.json")
    return streams.run_available(back.select("event_id", "session_id", "seq", "epoch_ms", "app_name", "_corrupt"), folder).select("event_id", "session_id", "seq", "epoch_ms", "app_name")


def _mixed(s, d):
    w = A.active_windows(s, d).select("session_id", "event_id", "timestamp", "monotonic_ms", F.lit("active_window").alias("type"))
    x = A.dwells(s, d).select("session_id", F.col("id").alias("event_id"), F.col("timestamp_ms").alias("timestamp"), "end_monotonic_ms", F.lit("window_dwell").alias("type"))
    return logs.normalize_envelope(logs.merge_streams(w, x))


@query
def route_events(s, d):
    """Windows by ``monotonic_ms``, dwells by ``end_monotonic_ms``, each by its route."""
    e = _mixed(s, d)
    parts = [logs.route_by_type(e, k) for k in ("window_dwell", "active_window")]
    return logs.merge_streams(*parts).select("session_id", "event_id", "type", "timestamp_ms", "monotonic_ms")


@query
def event_ids(s, d):
    w = A.active_windows(s, d)
    host = F.concat(F.lit("my host."), "session_id")
    return w.select("event_id", N.session_id(host, F.col("timestamp")).alias("made_session"), N.event_id("session_id", "seq").alias("made_event"))
