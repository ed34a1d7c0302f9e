"""Streamed features: one state, and the same rows as in batch."""

from pyspark.sql import functions as F

from dwellspark.operators.features import build_features
from dwellspark.options import FeatureOptions
from dwellspark.streaming import streams

DWELLS = "session_id string, timestamp_ms long, dwell_time_ms long, id long, window_event_id string, app_name string, timezone_offset int"
INPUTS = "session_id string, timestamp_ms long, key_count long, click_count long, mouse_distance long, scroll_delta long, idle_ms long"


def rows(spark, n):
    names = ["Code", None, "Slack", "YouTube", "Code"]
    # windows with many apps, apps that come back, equal times, dwells of no length, ids whose text sorts otherwise
    dwells = [(f"s{k % 3}", 121_000 + k // 3 * 4000 + k % 2, [4000, 0, 2000, 4000, 4000, 70_000][(k + k // 5) % 6], 3 * n - k, f"w{k // 4}" if k % 7 else None, names[(k // 3 + k * k // 7) % 5], [0, 60][k % 2]) for k in range(n)]
    inputs = [(f"s{k % 4}", 120_000 + k * 2500, k, None, 2 * k, -k, 100 * k) for k in range(n)]
    end = 3_600_000
    return [spark.createDataFrame(dwells + [("end", d * end, 1, d, "e", None, 0) for d in more], DWELLS) for more in ([], [1])], [
        spark.createDataFrame(inputs + [("end", d * end, 0, 0, 0, 0, 0) for d in more], INPUTS) for more in ([], [1])
    ]


def test_streamed_features_are_those_of_batch(spark, tmp_path):
    dwells, inputs = rows(spark, 120)
    for mode in ("rows", "windows"):
        o, folder = FeatureOptions(count_mode=mode), f"file://{tmp_path}/{mode}"
        for k in range(2):
            more = (lambda x: x) if k == 0 else (lambda x: x.where("session_id = 'end'"))
            more(dwells[k]).write.mode("append").parquet(f"{folder}/dwells")
            more(inputs[k]).write.mode("append").parquet(f"{folder}/inputs")
            read = lambda x, name: spark.readStream.schema(x.schema).parquet(f"{folder}/{name}")  # noqa: E731, B023
            got = streams.run_available(streams.stream_features(read(dwells[0], "dwells"), read(inputs[0], "inputs"), o), folder)
        want = build_features(dwells[0], inputs[0], ["session_id"], o)
        got = got.where("session_id <> 'end'").select(*want.columns)
        assert want.count() > 15 and {r[0] for r in want.select("top_app_name").collect()} == {"Code", "", "Slack", "YouTube"}
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
        # one aggregation: a store for each partition, and no second or third state to open and commit in every batch
        (state,) = (tmp_path / mode / "state/state").iterdir()
        # and a batch commits its changes
        assert list(state.rglob("*.changelog"))


def test_features_without_inputs(spark, tmp_path):
    dwells, _ = rows(spark, 30)
    slices = [dwells[0], *(x.where("session_id = 'end'") for x in dwells[1:])]
    got = streams.run_slices(slices, streams.stream_features, f"file://{tmp_path}/x").where("session_id <> 'end'")
    want = build_features(dwells[0], spark.createDataFrame([], INPUTS), ["session_id"])
    assert got.count() == want.count() > 0 and want.exceptAll(got.select(*want.columns)).count() == 0
    assert got.agg(F.max("idle_ratio")).first()[0] == 0
