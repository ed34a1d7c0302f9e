"""Streams: window changes, dwell, summaries, labels, features, fan-out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.features import dwell_x_bucket, finished, input_sums
from ..operators.inputs import COUNTERS, is_dirty
from ..options import CATEGORIES, CONFIRM_MS, FLUSH_MS, FeatureOptions
from ..functions.categories import categorize
from ..sources.sinks import fanout

_ORDER = ["monotonic_ms", "seq"]


def _rows(batches) -> pd.DataFrame:
    frames = [b for b in batches if len(b)]
    return pd.concat(frames).sort_values(_ORDER, kind="stable") if frames else pd.DataFrame()


def _null(v) -> bool:
    return v is None or v != v


def _sorted_rows(batches, cols: list[str], order: int) -> list[tuple]:
    """A key's rows as tuples, in the order of their first columns, nulls last. A key has a
    few rows a batch, for which frames would cost more than the work."""
    rows = [r for b in batches for r in zip(*(b[c].tolist() for c in cols))]
    return sorted(rows, key=lambda r: [(_null(v), 0 if _null(v) else v) for v in r[:order]])


def stream_window_changes(polls: DataFrame) -> DataFrame:
    """Polls whose app or title differs from the session's last; state: that key."""
    schema = "session_id string, seq long, monotonic_ms long, app_name string, window_title string"

    def step(key, batches, state: GroupState) -> Iterator[pd.DataFrame]:
        x = _rows(batches)
        if x.empty:
            return
        x = x[x.app_name.notna() | x.window_title.notna()]
        now = x.app_name.fillna("") + "|" + x.window_title.fillna("")
        before = now.shift(1)
        if len(now):
            before.iloc[0] = state.get[0] if state.exists else None
            state.update((now.iloc[-1],))
        yield x[now != before]

    cols = polls.select("session_id", "seq", "monotonic_ms", "app_name", "window_title")
    return cols.groupBy("session_id").applyInPandasWithState(step, schema, "last string", "append", GroupStateTimeout.NoTimeout)


_DWELL = "session_id string, window_event_id string, app_name string, start_monotonic_ms long, end_monotonic_ms long, dwell_time_ms long"


class _OpenWindow(StatefulProcessor):
    """The window that a session has in front: ``opened`` and ``segment`` on its own
    clock, ``shift`` from that clock to event time."""

    def __init__(self, heartbeat_ms: int | None, close_after_ms: int | None):
        self.pace, self.close_after = heartbeat_ms, close_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.front = handle.getValueState("front", "event_id string, app_name string, opened long, segment long, shift long")

    def _pieces(self, key, front, until: int, closed: bool) -> tuple[list[tuple], int]:
        """Rows from the segment's start to ``until``: whole beats, and where the window
        is closed what is left of it, if anything or if nothing was written yet."""
        event_id, app, opened, at, _ = front
        rows = []
        while self.pace and at + self.pace <= until:
            rows.append((key[0], event_id, app, at, at + self.pace, self.pace))
            at += self.pace
        if closed and (at < until or at == opened):
            end = max(at, until)
            rows.append((key[0], event_id, app, at, end, end - at))
        return rows, at

    def _last(self, front) -> int:
        """When the window is closed for want of news, on its own clock."""
        return front[2] + self.close_after

    def _due(self, front) -> int | None:
        """Event time of the next beat or the closing, whichever comes first: when the
        session's only timer is set to."""
        due = [front[3] + self.pace] if self.pace else []
        due += [self._last(front)] if self.close_after else []
        return min(due) + front[4] if due else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        x = _sorted_rows(rows, [*_ORDER, "event_id", "app_name", "ts_ms"], 2)
        if not x:
            return
        front = self.front.get()
        front = None if front is None else tuple(front)
        before, out = front and self._due(front), []
        for at, _, event_id, app, ts in x:
            if front is not None:
                until = min(int(at), self._last(front)) if self.close_after else int(at)
                out += self._pieces(key, front, until, True)[0]
            front = (str(event_id), None if _null(app) else str(app), int(at), int(at), int(ts) - int(at))
        self.front.update(front)
        after = self._due(front)
        if before is not None and before != after:
            self.handle.deleteTimer(before)
        if after is not None and before != after:
            self.handle.registerTimer(after)
        if out:
            yield pd.DataFrame(out, columns=_DWELL_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        front = self.front.get()
        if front is None:
            return
        front = tuple(front)
        now = timerValues.getCurrentWatermarkInMs() - front[4]  # several timers may be due
        done = bool(self.close_after) and now >= self._last(front)
        out, at = self._pieces(key, front, min(now, self._last(front)) if done else now, done)
        if done:
            self.front.clear()
        else:
            front = (*front[:3], at, front[4])
            self.front.update(front)
            self.handle.registerTimer(self._due(front))
        if out:
            yield pd.DataFrame(out, columns=_DWELL_NAMES)

    def close(self) -> None:
        pass


_DWELL_NAMES = [c.split()[0] for c in _DWELL.split(", ")]


def stream_dwell(windows: DataFrame, heartbeat_ms: int | None = None, close_after_ms: int | None = None, late: str = "0 seconds") -> DataFrame:
    """A row for each window that was left; state: the open window, one row a session.

    With ``heartbeat_ms`` a window that stays in front gives a piece each time so much
    event time (``ts``, ``late`` behind the newest) has passed, while it is still open.
    With ``close_after_ms`` it is closed so long after it opened without another
    one, its last piece is written and the session's state goes. Timers and later
    windows give the same pieces, so results don't depend on how batches are cut.
    A clock that runs backwards gives 0; a null app stays null. Needs the RocksDB
    state store.
    """
    timed = bool(heartbeat_ms or close_after_ms)
    ts = F.unix_millis("ts") if timed else F.lit(0).cast("long")
    cols = ["session_id", "seq", "event_id", "app_name", F.col("monotonic_ms").cast("long").alias("monotonic_ms"), ts.alias("ts_ms")]
    x = windows.withWatermark("ts", late).select(*cols, "ts") if timed else windows.select(*cols)
    work = _OpenWindow(heartbeat_ms, close_after_ms)
    return x.groupBy("session_id").transformWithStateInPandas(work, _DWELL, "Append", "EventTime" if timed else "None")


def stream_input_summary(inputs: DataFrame, flush_ms: int = FLUSH_MS, late: str = "1 minute") -> DataFrame:
    """Sums of each session, window and tumbling slot that hold input."""
    slot = F.window("ts", f"{flush_ms} milliseconds")
    sums = [F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in COUNTERS]
    out = inputs.withWatermark("ts", late).groupBy("session_id", "active_window_id", slot).agg(*sums).where(is_dirty())
    return out.select("session_id", "active_window_id", F.unix_millis("window.start").alias("slot_ms"), *COUNTERS)


_SUMS = "session_id string, active_window_id string, slot_ms long, " + ", ".join(f"{c} long" for c in COUNTERS) + ", dwell_time_ms long"


class _InputSums(StatefulProcessor):
    """Events wait until their slot is over; ``front`` is the window that the last one
    before left in front, ``pending`` the sums that were not flushed."""

    def __init__(self, flush_ms: int, carry: bool):
        self.flush, self.carry = flush_ms, carry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        counts = ", ".join(f"{c} long" for c in COUNTERS)
        self.waiting = handle.getListState("waiting", f"at long, is_window int, event_id string, ts long, {counts}")
        self.front = handle.getValueState("front", "event_id string, opened long")
        self.pending = handle.getValueState("pending", counts)

    def _due(self, at: int, ts: int) -> int:
        """Event time at which a row's slot is over."""
        return (at // self.flush + 1) * self.flush + ts - at

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = _sorted_rows(rows, ["at", "is_window", "event_id", "ts_ms", *COUNTERS], 0)
        if new:
            new = [(int(at), int(w), None if _null(i) else str(i), int(ts), *(0 if _null(c) else int(c) for c in counts)) for at, w, i, ts, *counts in new]
            self.waiting.appendList(new)
            self.handle.registerTimer(min(self._due(r[0], r[3]) for r in new))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(r) for r in self.waiting.get()]
        ready = sorted((r for r in rows if self._due(r[0], r[3]) <= now), key=lambda r: (r[0], r[1], r[2] or ""))
        left = [r for r in rows if self._due(r[0], r[3]) > now]
        if left:  # one timer goes from slot to slot that has rows
            self.handle.registerTimer(min(self._due(r[0], r[3]) for r in left))
        if not ready:
            return
        self.waiting.put(left) if left else self.waiting.clear()
        front = self.front.get()
        window, opened = (None, None) if front is None else tuple(front)
        cells: dict[tuple, list] = {}
        for at, is_window, event_id, _, *counts in ready:
            if is_window:
                window, opened = event_id, at
                continue
            cell = cells.setdefault((at // self.flush * self.flush, window), [0] * len(COUNTERS) + [0])
            cell[:-1] = [a + b for a, b in zip(cell, counts)]
            cell[-1] = max(cell[-1], at - opened) if window is not None else 0
        if window is not None:
            self.front.update((window, opened))
        pending = self.pending.get() if self.carry else None
        pending = [0] * len(COUNTERS) if pending is None else list(pending)
        out = []
        for (slot, win), cell in cells.items():
            sums = [a + b for a, b in zip(cell, pending)] if self.carry else cell[:-1]
            if win is not None and max(sums) > 0:
                out.append((key[0], win, slot, *sums, cell[-1]))
                sums = [0] * len(COUNTERS)
            pending = sums
        if self.carry:
            self.pending.update(tuple(pending))
        if out:
            yield pd.DataFrame(out, columns=_SUM_NAMES)

    def close(self) -> None:
        pass


_SUM_NAMES = [c.split()[0] for c in _SUMS.split(", ")]


def stream_asof_summary(deltas: DataFrame, windows: DataFrame, flush_ms: int = FLUSH_MS, late: str = "1 minute", carry: bool = False) -> DataFrame:
    """``input_summaries`` of two streams, inputs and windows, each with event time ``ts``.

    A session's events wait in state until time is ``late`` past their slot, then
    inputs meet the last window opened before them and the slot's sums are
    written; so results don't depend on how batches are cut or on which stream is
    ahead. With ``carry`` sums of slots that aren't flushed go on, and inputs before
    the first window wait for it. Needs the RocksDB state store.
    """
    at = F.col("monotonic_ms").cast("long").alias("at")
    none = [F.lit(None).cast("long").alias(c) for c in COUNTERS]
    x = deltas.select("session_id", at, F.lit(0).alias("is_window"), F.lit(None).cast("string").alias("event_id"), "ts", *(F.col(c).cast("long").alias(c) for c in COUNTERS))
    x = x.unionByName(windows.select("session_id", at, F.lit(1).alias("is_window"), F.col("event_id").cast("string").alias("event_id"), "ts", *none))
    x = x.withWatermark("ts", late).withColumn("ts_ms", F.unix_millis("ts"))
    return x.groupBy("session_id").transformWithStateInPandas(_InputSums(flush_ms, carry), _SUMS, "Append", "EventTime")


def stream_confirm_label(seen: DataFrame, confirm_ms: int = CONFIRM_MS) -> DataFrame:
    """Labels as they are confirmed: (window_event_id, t, label); state: the pending
    label, since when, and the confirmed one."""

    def step(key, batches, state: GroupState) -> Iterator[pd.DataFrame]:
        pending, since, sure = state.get if state.exists else (None, 0, None)
        rows = []
        for t, label in _sorted_rows(batches, ["t", "label"], 1):
            if label != pending:
                pending, since = label, int(t)
            elif int(t) - since >= confirm_ms and label != sure:
                sure = label
                rows.append((key[0], int(t), label))
        state.update((pending, since, sure))
        if rows:
            yield pd.DataFrame(rows, columns=["window_event_id", "t", "semantic_label"])

    out = "window_event_id string, t long, semantic_label string"
    return seen.select("window_event_id", "t", "label").groupBy("window_event_id").applyInPandasWithState(step, out, "pending string, since long, sure string", "append", GroupStateTimeout.NoTimeout)


def stream_dedup(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


#: a piece of a dwell, sorted so that an app's pieces stand together, its first dwell ahead
_PIECE = ["app_name", "timestamp_ms", "id", "overlap_ms", "timezone_offset", "window_event_id"]


def _top_app(pieces: F.Column, kind: StructType) -> F.Column:
    """The app with the most time in a window's pieces, then the first dwell, as in
    ``window_sums``: one pass over the sorted pieces, app by app."""
    null = lambda c: F.lit(None).cast(kind[c].dataType).alias(c)
    start = F.struct(null("app_name"), F.lit(0).cast("long").alias("ms"), F.struct(null("timestamp_ms"), null("id")).alias("first"))
    sooner = lambda a, b: (a["ms"] > b["ms"]) | ((a["ms"] == b["ms"]) & (b["ms"] > 0) & (a["first"] < b["first"]))
    best = lambda x: F.when(sooner(x["now"], x["best"]), x["now"]).otherwise(x["best"])

    def step(x, p):
        same = (x["now"]["ms"] > 0) & x["now"]["app_name"].eqNullSafe(p["app_name"])
        one = F.struct(p["app_name"].alias("app_name"), p["overlap_ms"].alias("ms"), F.struct(p["timestamp_ms"].alias("timestamp_ms"), p["id"].alias("id")).alias("first"))
        more = F.struct(x["now"]["app_name"].alias("app_name"), (x["now"]["ms"] + p["overlap_ms"]).alias("ms"), x["now"]["first"].alias("first"))
        return F.struct(F.when(same, more).otherwise(one).alias("now"), F.when(same, x["best"]).otherwise(best(x)).alias("best"))

    timed = F.array_sort(F.filter(pieces, lambda p: p["overlap_ms"] > 0))
    return F.coalesce(F.aggregate(timed, F.struct(start.alias("now"), start.alias("best")), step, lambda x: best(x)["app_name"]), F.lit(""))


def stream_features(dwells: DataFrame, inputs: DataFrame | None = None, options: FeatureOptions = FeatureOptions(), late: str = "10 minutes") -> DataFrame:
    """The columns of ``build_features`` for each session and fixed window, once time is
    ``late`` past its end in both streams. Pieces of dwells and inputs go into one
    aggregation by window, so that there is one state and it goes as windows end; a
    window's pieces are kept in it for the top app and the switches. Rows that come
    later than that are left out; building the day's features in batch puts them right.
    """
    size = options.window_ms
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    rows = dwell_x_bucket(dwells, size).select("session_id", F.timestamp_millis("window_start").alias("at"), F.struct(*_PIECE).alias("piece"), categorize("app_name").alias("category"), *(none(c, "long") for c in COUNTERS))
    kind = rows.schema["piece"].dataType
    rows = rows.withWatermark("at", late)
    if inputs is not None:
        own = inputs.select("session_id", F.timestamp_millis("timestamp_ms").alias("at"), none("piece", kind), none("category", "string"), *COUNTERS)
        rows = rows.unionByName(own.withWatermark("at", late))
    ms = F.col("piece.overlap_ms")
    zone = F.min(F.when(F.col("piece").isNotNull(), F.struct("piece.timestamp_ms", "piece.id", "piece.timezone_offset")))
    out = rows.groupBy("session_id", F.window("at", f"{size} milliseconds")).agg(
        *(F.sum(F.when(F.col("category") == c, ms).otherwise(0)).cast("long").alias(f"{c}_ms") for c in CATEGORIES),
        F.collect_list("piece").alias("pieces"), zone["timezone_offset"].alias("timezone_offset"), *input_sums(),
    )
    switches = F.size("pieces") if options.count_mode == "rows" else F.size(F.array_distinct(F.array_compact("pieces.window_event_id")))
    out = out.where(F.size("pieces") > 0).withColumns({"context_switch_count": switches.cast("long"), "top_app_name": _top_app(F.col("pieces"), kind), "window_start": F.unix_millis("window.start")})
    return finished(out.drop("window", "pieces"), options)


def stream_fanout(events: DataFrame, folder: str, checkpoint: str):
    """Start a query that writes each micro-batch to the raw and derived tables; a
    batch that runs again replaces its own folders, and the checkpoint resumes."""

    def put(batch, number):
        batch.persist()
        try:
            fanout(batch, folder, number)
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


#: state that Spark keeps on disk, as processors with timers need
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_PER_CORE = 2


def run_available(out: DataFrame, folder: str, mode: str = "append", state_parts: int | None = None) -> DataFrame:
    """Run a stream over what is there, from its checkpoint in ``folder`` if it has one,
    and read back all that it wrote. State has ``state_parts`` partitions, or
    STATE_PER_CORE for each core, but no more than the session's shuffles."""
    spark = out.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # a batch writes what it changed in a state, not the whole state
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", True)
    # every state partition is opened and committed in each batch, whatever it holds; a checkpoint keeps its number
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", min(int(parts), state_parts or STATE_PER_CORE * spark.sparkContext.defaultParallelism))
    try:
        query = out.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def run_slices(slices: list[DataFrame], make: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """A stream that is stopped and started again: each slice is written to its input,
    then the query that ``make`` builds runs from its checkpoint over what is new."""
    spark = slices[0].sparkSession
    out = None
    for part in slices:
        part.write.mode("append").parquet(f"{folder}/in")
        out = run_available(make(spark.readStream.schema(part.schema).parquet(f"{folder}/in")), folder)
    return out
