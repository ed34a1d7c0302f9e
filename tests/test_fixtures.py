"""Known answers: titles, dwell, labels, inputs, categories, buckets, scores, logs."""

import pytest
from pyspark.sql import functions as F

from dwellspark.functions import titles as N
from dwellspark.functions.categories import categorize, load_category_rules, with_category
from dwellspark.plans import activity
from dwellspark.operators import audit, dwell, features, inputs, semantic
from dwellspark.options import FeatureOptions
from dwellspark.sources import logs, sinks


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


TITLES = {
    "Ferry times: https://ferries.test/routes/7?day=mon#north (cached)": "Ferry times: ferries.test (cached)",
    "HTTP://Shop.Test/cart then": "Shop.Test then",
    "http://one.test/a http://two.test/b?c": "one.test two.test",
    "Seed catalogue, spring": "Seed catalogue, spring",
    "draft for m.ode+list@garden.test, second": "draft for ***@garden.test, second",
    "q_1%x@mail.sub.test": "***@mail.sub.test",
    "a@b.test;c@d.test": "***@b.test;***@d.test",
    r"D:\maps\2021\river.svg - viewer": "river.svg - viewer",
    "less /opt/maps/2021/river.svg": "less river.svg",
    "/srv/seeds/list": "list",
    "cd /srv": "cd /srv",
    "k" * 513: "k" * 512,
    "m" * 512: "m" * 512,
    "": "",
    "D:\\maps\\": "D:\\maps\\",
    "/srv/seeds/ z": "/srv/seeds/ z",
    "/a/b//c/d": "/a/b/d",
}


def test_titles(spark):
    df = spark.createDataFrame(list(TITLES.items()), "t string, want string")
    assert df.where(N.sanitize_title("t") != F.col("want")).count() == 0
    assert one(spark, N.sanitize_title(F.lit(None).cast("string"))) == ""
    assert one(spark, N.normalize_title(F.lit("Chrome"), F.lit("(3) Two Sum - LeetCode - Google Chrome"))) == "two sum leetcode"
    assert one(spark, N.normalize_title(F.lit(" Code "), F.lit(""))) == "code"
    assert one(spark, N.normalize_title(F.lit("x"), F.lit("follow-up"))) == "follow up"
    assert one(spark, N.normalize_title(F.lit("x"), F.lit("é12:30 z"))) == "é z"


def windows(spark, monos, app="a"):
    rows = [("s", i, f"aw-{i + 1}", app, f"t{i}", m, m, 0) for i, m in enumerate(monos)]
    return spark.createDataFrame(rows, "session_id string, seq long, event_id string, app_name string, window_title string, monotonic_ms long, timestamp long, timezone_offset int")


@pytest.mark.parametrize("monos,want", [([1000, 4500], [3500]), ([0, 1000, 3000], [1000, 2000]), ([5000, 3000], [0]), ([7], [])])
def test_dwell(spark, monos, want):
    assert [r.dwell_time_ms for r in dwell.dwell_from_windows(windows(spark, monos)).orderBy("seq").collect()] == want


def test_last_window_closes_with_session(spark):
    ends = spark.createDataFrame([("s", 900, 900)], "session_id string, end_monotonic_ms long, end_timestamp long")
    assert [r.dwell_time_ms for r in dwell.dwell_from_windows(windows(spark, [100, 400]), ends).orderBy("seq").collect()] == [300, 500]


@pytest.mark.parametrize("length,pieces", [(0, [0]), (1, [1]), (29_999, [29_999]), (30_000, [30_000]), (30_001, [30_000, 1]), (60_000, [30_000, 30_000])])
def test_heartbeat(spark, length, pieces):
    d = dwell.dwell_from_windows(windows(spark, [1000, 1000 + length]))
    got = dwell.heartbeat_split(d).orderBy("start_monotonic_ms").collect()
    assert [r.dwell_time_ms for r in got] == pieces and got[-1].timestamp_ms == 1000 + length


@pytest.mark.parametrize(
    "seen,want",
    [([(0, "on"), (2999, "on")], "unknown"), ([(0, "on"), (3000, "on")], "on"), ([(0, "on"), (1000, "off"), (2000, "on"), (4999, "on")], "unknown"), ([(0, "on"), (3000, "on"), (3500, "off")], "on")],
)
def test_labels(spark, seen, want):
    df = spark.createDataFrame([("s", "w", t, x) for t, x in seen], "session_id string, window_event_id string, t long, label string")
    assert dwell.confirm_labels(df).first().semantic_label == want


def test_inputs(spark):
    kind = "session_id string, monotonic_ms long, key_count long, click_count long, mouse_distance long, scroll_delta long, idle_ms long"
    w = windows(spark, [100, 5000])
    rows = [("s", 50, 9, 9, 9, 9, 9), ("s", 200, 1, 2, 50, 1, 100), ("s", 300, None, 0, 1, -1, 0), ("s", 5000, 1, 0, 0, 0, 0), ("s", 6000, 3, 0, 0, 0, 0), ("s", 20_000, 0, 0, 0, -5, 0)]
    got = {(r.active_window_id, r.slot_ms): (r.key_count, r.click_count, r.mouse_distance, r.scroll_delta, r.idle_ms) for r in inputs.input_summaries(spark.createDataFrame(rows, kind), w).collect()}
    assert got == {("aw-1", 0): (2, 2, 51, 0, 100), ("aw-2", 0): (3, 0, 0, 0, 0)}


def test_categories(spark, tmp_path):
    want = {"Visual Studio Code": "code", "Notion": "docs", "YouTube": "video", "Slack": "social", "Steam": "game", "Google Chrome": "other", "Minecraft": "docs", "StarCraft": "docs",
            "World of Warcraft": "docs", "Microsoft Teams": "video", "Microsoft Outlook": "social", "Amazed": "code", "Online Banking": "social", "x.com": "social", "xXcom": "other", "": "other"}
    df = spark.createDataFrame([*want.items(), (None, "other")], "app_name string, want string")
    assert df.where(categorize("app_name") != F.col("want")).count() == 0
    (tmp_path / "rules.json").write_text('[{"pattern": "chrome", "category": "video"}]')
    got = {r.app_name: r.category for r in with_category(df, "app_name", load_category_rules(spark, str(tmp_path / "rules.json"))).collect()}
    assert got == want | {"Google Chrome": "video", None: "other"}
    (tmp_path / "bad.json").write_text("{")
    assert load_category_rules(spark, str(tmp_path / "bad.json")).count() == 30


T = 30_000 * 1000


def bucket(spark, rows, ins=(), **o):
    d = spark.createDataFrame([("s", f"d{i}", f"w{i}", T + b, b - a, app, 60) for i, (a, b, app) in enumerate(rows)], "session_id string, id string, window_event_id string, timestamp_ms long, dwell_time_ms long, app_name string, timezone_offset int")
    i = spark.createDataFrame(list(ins), "session_id string, timestamp_ms long, key_count long, click_count long, mouse_distance long, scroll_delta long, idle_ms long")
    return {(r.window_start - T): r for r in features.build_features(d, i, ["session_id"], FeatureOptions(**o)).collect()}


def test_buckets(spark):
    got = bucket(spark, [(10_000, 50_000, "Code")])
    assert {k: (r.code_ms, r.context_switch_count, r.deep_work_candidate_flag) for k, r in got.items()} == {0: (20_000, 1, 1), 30_000: (20_000, 1, 1)}
    assert list(bucket(spark, [(0, 30_000, "Code")])) == [0]
    r = bucket(spark, [(0, 15_000, "Slack"), (15_000, 30_000, "Code")])[0]
    assert (r.top_app_name, r.top_category, r.context_switch_count, r.deep_work_candidate_flag) == ("Slack", "code", 2, 0)
    r = bucket(spark, [(5, 5, "Code")])[0]
    assert (r.top_app_name, r.top_category, r.context_switch_count, r.code_ms) == ("", "code", 1, 0)
    assert bucket(spark, [(0, 0, "Code")]) == {}
    r = bucket(spark, [(0, 1000, "Code")], [("s", T + 5, 30, 0, 0, -3, 40_000), ("s", T + 6, 0, 0, 0, 3, 0), ("s", T + 90_000, 1, 1, 1, 1, 1)])
    assert list(r) == [0] and (r[0].idle_ratio, r[0].scroll_rate, r[0].key_rate) == (1.0, 0.2, 1.0)


def test_scores(spark):
    x = F.array(F.lit(1.0), F.lit(2.0))
    assert one(spark, F.round(semantic.cosine(x, F.array(F.lit(2.0), F.lit(1.0))), 9)) == 0.8
    assert one(spark, semantic.cosine(x, F.array(F.lit(0.0), F.lit(0.0)))) == 0
    assert one(spark, N.app_boost(F.lit("Google Chrome"), F.lit("chrome"))) == 0.15 and one(spark, N.app_boost(F.lit("a"), F.lit(None).cast("string"))) == 0
    assert [one(spark, semantic.confidence(F.lit(d))) for d in (None, 9999, 10_000, 30_000, 30_001)] == ["low", "low", "medium", "medium", "high"]
    rows = lambda n, lift=0.0: spark.createDataFrame([("g", "d", i / 100 + lift) for i in range(n)], "goal_id string, day_utc string, score double")
    assert semantic.calibrate(rows(99)).count() == 0
    r = semantic.calibrate(rows(100)).first()
    assert (r.t_on, r.t_off, r.sample_count) == (0.8, 0.5, 100)


def test_logs(spark, tmp_path):
    (tmp_path / "events-20240101.jsonl").write_text('{"seq":0}\n{"seq":1}\n\n{"seq":2}\n{"partial":true')
    (tmp_path / "events-20240101.2.jsonl").write_text("".join(f'{{"seq":{i}}}\n' for i in range(4)) + "seq is lost here\n")
    (tmp_path / "events-20240101.10.jsonl").write_text("")
    (tmp_path / "other.jsonl").write_text('{"seq":9}')
    lines = logs.read_log_lines(spark, str(tmp_path))
    got = {r.file: (r.tail_seq, r.truncated) for r in audit.log_tail_seq(lines).collect()}
    assert got == {"events-20240101.jsonl": (2, True), "events-20240101.2.jsonl": (3, True)}
    files = logs.list_log_files(spark, str(tmp_path)).select("file")
    assert audit.latest_log_file(files).first().file == "events-20240101.10.jsonl"
    assert logs.read_event_log(spark, str(tmp_path)).where("seq IS NOT NULL").count() == 7
    (tmp_path / "ck.json").write_text('{"session_id": "s", "last_flushed_seq": "x"}')
    assert logs.read_checkpoint(spark, str(tmp_path / "ck.json")).first().last_flushed_seq == -1


def test_log_round_trip(spark, tmp_path):
    e = spark.createDataFrame([(f"e{i}", "s", i, 1_704_067_200_000 + i * 40_000_000) for i in range(5)], "event_id string, session_id string, seq long, epoch_ms long")
    sinks.write_event_log(e, str(tmp_path / "log"), 1)
    back = spark.read.json(str(tmp_path / "log"))
    assert back.count() == 5 and back.select("event_date").distinct().count() == 2


def test_features_in_so_many_parts_are_the_same(spark, sf):
    d, i = activity.dwells(spark, sf), activity.deltas(spark, sf)
    of = lambda parts: features.build_features(d, i, ["session_id"], parts=parts)
    dealt = of(7)
    assert dealt.rdd.getNumPartitions() == 7
    assert sorted(map(str, dealt.collect())) == sorted(map(str, of(None).collect()))
    assert features.app_ms(features.dwell_x_bucket(d), ["session_id"], 5).rdd.getNumPartitions() == 5


def test_parts_grow_with_the_events(spark, sf, monkeypatch):
    monkeypatch.setattr(activity, "PER_TASK", 100)
    n = activity.table(spark, sf, "events").count()
    assert activity.active_windows(spark, sf).rdd.getNumPartitions() == activity.parts(spark, sf) == 1 + n // 100
