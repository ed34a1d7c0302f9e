"""Dwell: how long each window was in front."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.timefns import iso_utc
from ..functions.titles import event_id, resolve_app_name, sanitize_title
from ..options import CONFIRM_MS, HEARTBEAT_MS
from .ordering import Ranged


def resolve_poll(polls: DataFrame) -> DataFrame:
    """Polls ``(title, owner struct)`` -> app_name, window_title, process_name, bundle_id."""
    owner = F.col("owner")
    return polls.withColumns(
        {
            "app_name": resolve_app_name(owner["name"], F.col("title")),
            "window_title": sanitize_title("title"),
            "process_name": F.coalesce(F.nullif(owner["processName"], F.lit("")), owner["name"]),
            "bundle_id": owner["bundleId"],
        }
    ).drop("owner", "title")


def window_changes(polls: DataFrame, order: list[str] = ("timestamp",), session: str = "session_id", hot: bool = False) -> DataFrame:
    """Polls whose app or title differs from the last poll's; null polls are left out
    first and change nothing. The first poll of a session stays. With ``hot`` sessions
    are worked on in ranges, for tables where one may be too large for a task."""
    polls = polls.where("app_name IS NOT NULL OR window_title IS NOT NULL")
    polls = polls.withColumn("_key", F.concat_ws("|", F.coalesce("app_name", F.lit("")), F.coalesce("window_title", F.lit(""))))
    if hot:
        polls = Ranged(polls, [session], list(order)).neighbour({"_key": "_before"}, ahead=False).done()
    else:
        polls = polls.withColumn("_before", F.lag("_key").over(Window.partitionBy(session).orderBy(*order)))
    return polls.where("NOT (_key <=> _before)").drop("_before", "_key")


def window_records(polls: DataFrame, order: list[str] = ("timestamp",), hot: bool = False) -> DataFrame:
    """Polls ``(session_id, timestamp, monotonic_ms, timezone_offset, title, owner)`` as
    ``active_window`` records: one for each change, numbered within its session.

    ``created_at`` is the poll's own time, and the id follows from session and number,
    so a second run gives the same records. ``bundle_id`` and ``process_name`` are
    null where the poll has none. Polls without an owner and a title change nothing.
    """
    known = polls.where("owner.name IS NOT NULL OR title IS NOT NULL")
    changed = assign_seq(window_changes(resolve_poll(known), order, hot=hot), ["session_id"], list(order), hot)
    return changed.select(
        F.lit("1.1.0").alias("schema_version"), F.lit("active_window").alias("type"), event_id("session_id", "seq").alias("event_id"), "session_id", "seq",
        iso_utc("timestamp").alias("created_at"), "timezone_offset", "timestamp", "monotonic_ms", "app_name", "window_title", F.lit("WINDOW_CHANGE").alias("trigger_reason"), "bundle_id", "process_name",
    )


def assign_seq(df: DataFrame, keys: list[str], order: list[str], hot: bool = False) -> DataFrame:
    """``df`` with ``seq``, each row's number within its keys; ``hot`` as in ``window_changes``."""
    if hot:
        return Ranged(df, keys, order).number("seq").done()
    return df.withColumn("seq", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def dwell_from_windows(windows: DataFrame, session_end: DataFrame | None = None, hot: bool = False) -> DataFrame:
    """One row for each window that was left: its time in front, stamped at its end.

    ``session_end(session_id, end_monotonic_ms, end_timestamp)`` closes last
    windows; without it they are still open and left out. A clock that runs
    backwards gives 0. ``hot`` as in ``window_changes``.
    """
    if hot:
        w = Ranged(windows, ["session_id"], ["seq"]).neighbour({"monotonic_ms": "end_monotonic_ms", "timestamp": "end_timestamp"}, ahead=True).done()
    else:
        order = Window.partitionBy("session_id").orderBy("seq")
        w = windows.withColumns({"end_monotonic_ms": F.lead("monotonic_ms").over(order), "end_timestamp": F.lead("timestamp").over(order)})
    if session_end is not None:
        ends = session_end.select("session_id", F.col("end_monotonic_ms").alias("_m"), F.col("end_timestamp").alias("_t"))
        w = w.join(ends, "session_id", "left").withColumns({"end_monotonic_ms": F.coalesce("end_monotonic_ms", "_m"), "end_timestamp": F.coalesce("end_timestamp", "_t")})
    w = w.where("end_monotonic_ms IS NOT NULL")
    return w.select(
        event_id("session_id", "event_id", F.lit("dwell")).alias("id"), "session_id", "seq", "timezone_offset",
        F.col("end_timestamp").alias("timestamp_ms"), F.col("event_id").alias("window_event_id"), "app_name",
        F.col("window_title").alias("normalized_window_title"), F.col("monotonic_ms").alias("start_monotonic_ms"), "end_monotonic_ms",
        F.greatest(F.lit(0), F.col("end_monotonic_ms") - F.col("monotonic_ms")).cast("long").alias("dwell_time_ms"),
    )


def heartbeat_split(dwells: DataFrame, every_ms: int = HEARTBEAT_MS) -> DataFrame:
    """Each dwell as pieces of at most ``every_ms``, counted from the window's opening;
    a dwell of no length is one piece."""
    start, end = F.col("start_monotonic_ms"), F.col("start_monotonic_ms") + F.col("dwell_time_ms")
    at = F.explode(F.sequence(start, F.greatest(start, end - 1), F.lit(every_ms)))
    d = dwells.withColumn("_end", end).withColumn("_at", at)
    stop = F.least(F.col("_at") + every_ms, F.col("_end"))
    return d.withColumns(
        {
            "id": event_id("id", "_at"),
            "timestamp_ms": F.col("timestamp_ms") - (F.col("_end") - stop),
            "start_monotonic_ms": F.col("_at"),
            "end_monotonic_ms": stop,
            "dwell_time_ms": stop - F.col("_at"),
        }
    ).drop("_at", "_end")


def confirm_labels(seen: DataFrame, confirm_ms: int = CONFIRM_MS, keys: list[str] = ("session_id", "window_event_id"), hot: bool = False) -> DataFrame:
    """``seen(keys, t, label)`` -> one row for each window with its last confirmed
    label: one seen again ``confirm_ms`` or more after it was first seen, with no
    other between. Without one it is 'unknown'. With ``hot`` windows are worked on in
    ranges: a run of one label began where the last row with another one ended."""
    if hot:
        s = Ranged(seen, list(keys), ["t", "label"]).neighbour({"label": "_before", "t": "_at"}, ahead=False)
        s.rows = s.rows.withColumn("_began", F.when(F.col("_at").isNull() | ~F.col("_before").eqNullSafe(F.col("label")), F.col("t")))
        s = s.last({"_began": "_since"}).done()
        ok = F.col("t") - F.col("_since") >= confirm_ms
        label = F.max_by(F.when(ok, F.col("label")), F.when(ok, F.struct("t", "label")))
        return s.groupBy(*keys).agg(F.coalesce(label, F.lit("unknown")).alias("semantic_label"))
    order = Window.partitionBy(*keys).orderBy("t", "label")
    s = seen.withColumn("_new", (~F.lag("label").over(order).eqNullSafe(F.col("label"))).cast("int"))
    s = s.withColumn("_run", F.sum("_new").over(order))
    s = s.withColumn("_since", F.min("t").over(Window.partitionBy(*keys, "_run")))
    ok = F.col("t") - F.col("_since") >= confirm_ms
    label = F.max_by(F.when(ok, F.col("label")), F.when(ok, F.struct("t", "_run")))
    return s.groupBy(*keys).agg(F.coalesce(label, F.lit("unknown")).alias("semantic_label"))


def dwells_in_range(dwells: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Dwells that overlap [start, end), in order of their end."""
    return dwells.where((F.col("timestamp_ms") - F.col("dwell_time_ms") < end_ms) & (F.col("timestamp_ms") > start_ms)).orderBy("timestamp_ms")


def session_dwells(dwells: DataFrame, session: str) -> DataFrame:
    return dwells.where(F.col("session_id") == session).orderBy("seq")


def dwell_time_range(dwells: DataFrame) -> DataFrame:
    """(min_ts, max_ts) over dwells with a length; nulls when there is none."""
    d = dwells.where("dwell_time_ms > 0")
    return d.agg(F.min(F.col("timestamp_ms") - F.col("dwell_time_ms")).alias("min_ts"), F.max("timestamp_ms").alias("max_ts"))
