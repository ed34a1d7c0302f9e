"""Streams with state and timers: heartbeats, idle sessions, restarts."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from dwellspark.operators import dwell
from dwellspark.operators.audit import audit_sequence
from dwellspark.sources import sinks
from dwellspark.streaming import streams

SCHEMA = "session_id string, seq long, event_id string, app_name string, monotonic_ms long"


def windows(spark, rows, schema=SCHEMA):
    # event time is a day ahead of the session's own clock
    return spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_millis(F.col("monotonic_ms") + 86_400_000))


def pieces(df):
    return sorted((r.session_id, r.window_event_id, r.app_name, r.start_monotonic_ms, r.end_monotonic_ms, r.dwell_time_ms) for r in df.collect() if r.session_id != "z")


def test_beats_idle_sessions_and_restarts(spark, tmp_path):
    a = [("s", 0, "w0", "Code", 0), ("s", 1, "w1", None, 70_000), ("t", 0, "v0", "Mail", 10_000)]
    b = [("s", 2, "w2", "Code", 70_000 + 30_000), ("s", 3, "w3", "Web", 100_000), ("u", 0, "u0", "Web", 95_000)]
    ends = [("z", k, f"z{k}", None, 1_000_000 * (k + 1)) for k in range(2)]
    make = lambda x: streams.stream_dwell(x, 30_000, 100_000)
    parts = [windows(spark, x) for x in (a, b, ends[:1], ends[1:])]
    cut_up = pieces(streams.run_slices(parts, make, f"file://{tmp_path}/many"))
    whole = pieces(streams.run_slices([windows(spark, a + b + ends[:1]), parts[3]], make, f"file://{tmp_path}/one"))
    assert cut_up == whole
    assert [p[3:] for p in whole if p[1] == "w0"] == [(0, 30_000, 30_000), (30_000, 60_000, 30_000), (60_000, 70_000, 10_000)]
    assert [p[2:] for p in whole if p[1] == "w1"] == [(None, 70_000, 100_000, 30_000)]
    assert [p[3:] for p in whole if p[1] == "w2"] == [(100_000, 100_000, 0)]
    # nothing new for 100 s: closed then, and not when the next event comes
    assert [p[3:] for p in whole if p[1] == "v0"][-1] == (100_000, 110_000, 10_000)
    # as in batch, with each session's end given
    end = spark.createDataFrame([("s", 200_000, 0), ("t", 110_000, 0), ("u", 195_000, 0)], "session_id string, end_monotonic_ms long, end_timestamp long")
    w = windows(spark, a + b).withColumns({"timestamp": F.lit(0).cast("long"), "window_title": F.lit(""), "timezone_offset": F.lit(0)})
    assert pieces(dwell.heartbeat_split(dwell.dwell_from_windows(w, end), 30_000)) == whole


def test_beats_come_while_the_window_is_open(spark, tmp_path):
    first = windows(spark, [("s", 0, "w0", "Code", 0), ("z", 0, "z0", None, 95_000)])
    make = lambda x: streams.stream_dwell(x, 30_000)
    got = pieces(streams.run_slices([first, windows(spark, [("z", 1, "z1", None, 96_000)])], make, f"file://{tmp_path}/x"))
    assert [p[3:5] for p in got] == [(0, 30_000), (30_000, 60_000), (60_000, 90_000)]


def test_plain_dwell(spark, tmp_path):
    rows = [("s", 0, "w0", "Code", 50), ("s", 1, "w1", None, 20), ("s", 2, "w2", "Web", 90)]
    got = pieces(streams.run_slices([windows(spark, rows[:2]), windows(spark, rows[2:])], streams.stream_dwell, f"file://{tmp_path}/x"))
    # one batch is put in the order of its clock, a later one that lies behind gives 0
    assert got == [("s", "w0", "Code", 50, 90, 40), ("s", "w1", None, 20, 50, 30)]
    got = pieces(streams.run_slices([windows(spark, rows[:1]), windows(spark, rows[1:2])], streams.stream_dwell, f"file://{tmp_path}/y"))
    assert got == [("s", "w0", "Code", 50, 50, 0)]


def test_stopped_stream_goes_on_without_loss(spark, tmp_path):
    """A writer that breaks in a batch, a restart, and the log's numbers as the proof."""
    folder = f"file://{tmp_path}"
    rows = lambda low, high: spark.range(low, high).select(F.concat(F.lit("e"), "id").alias("event_id"), (F.col("id") % 3).cast("string").alias("session_id"), F.floor(F.col("id") / 3).alias("seq"), F.lit("active_window").alias("type"),
        F.lit("x").alias("created_at"), F.lit(0).alias("timezone_offset"), F.col("id").alias("timestamp"), F.lit(1.0).alias("monotonic_ms"))
    schema = rows(0, 1).schema
    start = lambda: streams.stream_fanout(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/state").trigger(availableNow=True).start()
    for k in range(4):
        rows(k * 30, k * 30 + 30).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    real, calls = sinks.derived_rows, []

    def breaks(events, kind):
        calls.append(kind)
        if len(calls) == 4:
            raise OSError("lost")
        return real(events, kind)

    sinks.derived_rows = breaks
    try:
        with pytest.raises(Exception, match="lost"):
            start().awaitTermination()
    finally:
        sinks.derived_rows = real
    start().awaitTermination()
    stored = sinks.stored_rows(spark, f"{folder}/out/events_raw")
    audit = audit_sequence(stored).collect()
    assert [(r.records, r.distinct_seqs, r.first_seq, r.last_seq, r.expected_seq) for r in audit] == [(40, 40, 0, 39, None)] * 3


@pytest.mark.parametrize("hot", [False, True])
def test_sessions_that_go_on_at_a_tail(spark, hot):
    """After a recovery a new session starts at the old one's last number."""
    rows = [("a", k) for k in range(8)] + [("b", k) for k in (7, 8, 9)] + [("c", k) for k in (7, 9)] + [(None, 4), (None, 5), ("d", None)]
    df = spark.createDataFrame(rows, "session_id string, seq long")
    of = lambda zero: {r.session_id: (r.records, r.first_seq, r.last_seq, r.expected_seq, r.found_seq) for r in audit_sequence(df, require_zero_start=zero, hot=hot).collect()}
    assert of(False) == {"a": (8, 0, 7, None, None), "b": (3, 7, 9, None, None), "c": (2, 7, 9, 8, 9), None: (2, 4, 5, None, None)}
    assert of(True)["b"] == (3, 7, 9, 0, 7) and of(True)["a"] == (8, 0, 7, None, None)


class Handle:
    """Timers and values of one session, as a state store would hold them."""

    def __init__(self):
        self.timers = []

    def getListState(self, name, schema):
        return List()

    def getValueState(self, name, schema):
        return Value()

    def registerTimer(self, t):
        self.timers.append(t)

    def deleteTimer(self, t):
        self.timers.remove(t)


class Value:
    value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def exists(self):
        return self.value is not None

    def clear(self):
        self.value = None


class List(Value):
    def get(self):
        return iter(self.value or [])

    def appendList(self, rows):
        self.value = [*(self.value or []), *rows]

    put = Value.update


def test_a_session_has_one_timer(spark):
    n = 50
    work, handle = streams._InputSums(10, True), Handle()
    work.init(handle)
    rows = pd.DataFrame({"at": range(0, n * 10, 10), "is_window": [1] + [0] * (n - 1), "event_id": ["w"] + [None] * (n - 1), "ts_ms": range(0, n * 10, 10), **{c: [None] + [1] * (n - 1) for c in streams.COUNTERS}})
    list(work.handleInputRows(("s",), iter([rows]), None))
    assert handle.timers == [10]
    clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda self: 255})()
    (out,) = list(work.handleExpiredTimer(("s",), clock, None))
    assert len(out) == 24 and handle.timers == [10, 260]
    beat, handle = streams._OpenWindow(30, 1000), Handle()
    beat.init(handle)
    for k in range(3):
        x = pd.DataFrame({"monotonic_ms": [k * 50], "seq": [k], "event_id": [f"w{k}"], "app_name": [None], "ts_ms": [k * 50]})
        list(beat.handleInputRows(("s",), iter([x]), None))
        assert handle.timers == [k * 50 + 30]


def test_rows_of_a_key_keep_their_order():
    a = pd.DataFrame({"t": [3.0, None, 1.0], "label": ["c", "d", "a"]})
    b = pd.DataFrame({"t": [3.0, 2.0], "label": ["b", None]})
    assert [r[1] for r in streams._sorted_rows(iter([a, b]), ["t", "label"], 1)] == ["a", None, "c", "b", "d"]


def test_state_has_few_partitions(spark, tmp_path):
    make = lambda x: streams.stream_dwell(x)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        streams.run_slices([windows(spark, [("s", 0, "w0", "Code", 50)])], make, f"file://{tmp_path}/x")
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len([p for p in (tmp_path / "x/state/state/0").iterdir() if p.name.isdigit()]) == 2 * spark.sparkContext.defaultParallelism
