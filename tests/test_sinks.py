"""Keyed sinks over several batches, against inserting row by row."""

import random

import pytest
from pyspark.sql import functions as F

from dwellspark.functions.categories import load_category_rules
from dwellspark.operators.audit import validate_events
from dwellspark.sources import logs, sinks

EVENT = "event_id string, session_id string, seq long, type string, created_at string, timezone_offset int, timestamp long, monotonic_ms double"


def events(spark, rows):
    return spark.createDataFrame([(i, s, q, t, c, 0, n, 1.0) for n, (i, s, q, t, c) in enumerate(rows)], EVENT)


def row_by_row(rows, stored):
    ids, places = {i for i, *_ in stored}, {(s, q) for _, s, q in stored}
    out = []
    for i, s, q in rows:
        if s is None or (i is not None and i in ids) or (q is not None and (s, q) in places):
            continue
        ids.add(i)
        places.add((s, q))
        out.append((i, s, q))
    return out


def test_insert_or_ignore_is_sequential(spark):
    rng = random.Random(3)
    made = lambda n: [(rng.choice([None, *"abcdefghij"]), rng.choice([None, "s", "t"]), rng.choice([None, 1, 2, 3, 4, 5])) for _ in range(n)]
    for n, m in ((0, 0), (40, 0), (60, 5), (25, 25)):
        rows, old = made(n), row_by_row(made(m), [])
        new = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "id string, session_id string, seq long, at int")
        known = spark.createDataFrame(old, "id string, session_id string, seq long")
        got = sinks.insert_or_ignore(new, known, [["id"], ["session_id", "seq"]], ["session_id"], ["at"]).collect()
        key = lambda r: tuple(map(str, r))
        assert sorted(((r.id, r.session_id, r.seq) for r in got), key=key) == sorted(row_by_row(rows, old), key=key)


def test_events_are_stored_once(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    batch = events(spark, [("a", "s", 0, "active_window", "x"), ("b", "s", 0, "active_window", "x"), ("c", "s", 1, "active_window", None), ("d", "s", 1, "active_window", "x")])
    for number in (0, 1, 0):
        sinks.fanout(batch, folder, number)
    sinks.fanout(events(spark, [("d", "s", 7, "active_window", "x"), ("e", "s", 1, "active_window", "x"), ("f", "s", 2, "window_dwell", "x")]), folder, 2)
    assert sorted(r.id for r in sinks.stored_rows(spark, f"{folder}/events_raw").collect()) == ["a", "d", "f"]
    assert sinks.stored_rows(spark, f"{folder}/window_dwell").count() == 0  # no window, no title: not stored


def test_a_batch_that_broke_off_comes_again(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/out"
    batch = events(spark, [("a", "s", 0, "active_window", "x")])
    real = sinks.keyed_append

    def broken(rows, where, *rest, **more):
        if where.endswith("window_dwell"):
            raise OSError("disk")
        return real(rows, where, *rest, **more)

    monkeypatch.setattr(sinks, "keyed_append", broken)
    with pytest.raises(sinks.SinkErrors) as e:
        sinks.fanout(batch, folder, 0, log=True)
    assert set(e.value.errors) == {"window_dwell"}
    monkeypatch.setattr(sinks, "keyed_append", real)
    assert sinks.stored_rows(spark, f"{folder}/events_raw").count() == 1 and sinks.stored_rows(spark, f"{folder}/window_dwell") is None
    assert spark.read.json(f"{folder}/log").count() == 1
    # rows without their batch's number don't count and are written over
    events(spark, [("z", "s", 9, "active_window", "x")]).select(F.col("event_id").alias("id"), "session_id", "seq").write.parquet(f"{folder}/events_raw/rows/batch=1")
    assert sinks.stored_rows(spark, f"{folder}/events_raw").count() == 1
    sinks.fanout(batch, folder, 0)
    sinks.fanout(events(spark, [("b", "s", 1, "active_window", "x")]), folder, 1)
    assert sorted(r.id for r in sinks.stored_rows(spark, f"{folder}/events_raw").collect()) == ["a", "b"]


def test_files_that_are_not_there(spark, tmp_path):
    assert logs.read_checkpoint(spark, f"{tmp_path}/none.json").count() == 0
    with pytest.warns(UserWarning, match="built-in"):
        assert load_category_rules(spark, f"{tmp_path}/none.json").count() == 30


def test_json_types(spark):
    good = {"schema_version": '"1"', "event_id": '"a"', "session_id": '"s"', "seq": "0", "created_at": '"2024-01-01T00:00:00.000Z"', "epoch_ms": "1", "monotonic_ms": "0.5", "timezone_offset": "-5", "source": '"o"', "type": '"t"', "payload": "{}"}
    cases = [({}, None), ({"payload": '"{not an object"'}, "payload"), ({"payload": "[]"}, "payload"), ({"payload": "null"}, "payload"), ({"seq": '"0"'}, "seq"), ({"seq": "2.0"}, None), ({"seq": "-1"}, "seq"),
        ({"event_id": "7"}, "event_id"), ({"event_id": '"  "'}, "event_id"), ({"monotonic_ms": "-1"}, "monotonic_ms"), ({"created_at": '"soon"'}, "created_at"), ({"source": "null"}, "source")]
    lines = ["{" + ",".join(f'"{k}":{v}' for k, v in (good | change).items()) + "}" for change, _ in cases]
    rows = [*zip(lines, (w for _, w in cases)), ("nope", "record"), (None, "record"), ("3", "record"), ("null", "record"), ("[1]", "schema_version"), ("{}", "schema_version")]
    got = validate_events(spark.createDataFrame(rows, "line string, want string")).select("want", "violation").collect()
    assert [r.violation for r in got] == [r.want for r in got]


def test_generations(spark):
    row = lambda **k: {c.split()[0]: k.get(c.split()[0]) for c in logs.EVENT.split(", ")}
    rows = [row(event_id="1", payload='{"app_name":"Code","key_count":"x","end_monotonic_ms":2}', type="t", epoch_ms=5), row(event_id="2", app_name="A", payload='{"app_name":"B"}'), row(event_id="3", payload='"{"'), row(event_id="4", key_count=1)]
    got = {r.event_id: r for r in logs.read_all_versions(spark.createDataFrame(rows, logs.EVENT)).collect()}
    assert (got["1"].app_name, got["1"].key_count, got["1"].end_monotonic_ms, got["1"].timestamp) == ("Code", None, 2.0, 5)
    assert (got["2"].app_name, got["2"].type, got["3"].app_name, got["4"].type) == ("A", "active_window", None, "input_summary")
