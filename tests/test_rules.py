"""Rule tables and boosts of any size against plain loops; carried sums against a fold."""

import random
import re

import pytest
from pyspark.sql import functions as F

from dwellspark.functions import boosts as B
from dwellspark.functions.categories import RULES, categorize, first_rules, with_category
from dwellspark.operators import inputs


@pytest.mark.parametrize("at_once", [10**6, 40])
def test_first_rule_of_many(spark, at_once):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abAB .c") for _ in range(n))
    rules = [(i, rng.choice([word(3), f"{word(2)}|{word(4)}", f"^{word(2)}", r"a\.b", f"{word(1)}[bc]", "||", "a||zz"]), f"c{i % 7}") for i in range(60)]
    names = sorted({word(rng.randrange(1, 9)) for _ in range(200)} | {"a.b", "É"})
    df = spark.createDataFrame([(n,) for n in names], "_app string")
    got = {r._app: (r.rule_no, r.category) for r in first_rules(df, spark.createDataFrame(rules, "rule_no long, pattern string, category string"), at_once).collect()}
    for n in names:
        want = next(((no, c) for no, p, c in rules if re.search(p, n, re.I | re.A)), None)
        assert got.get(n) == want, (n, want)


def test_built_in_rules_as_a_table(spark):
    names = ["Visual Studio Code", "YouTube", None, "", "xcode", "Steam", "unknown thing", "TERMINAL"]
    df = spark.createDataFrame([(n,) for n in names], "app_name string")
    table = spark.createDataFrame([(i, p, c) for i, (p, c) in enumerate(RULES)], "rule_no long, pattern string, category string")
    got = with_category(df, rules=table).withColumn("want", categorize("app_name")).collect()
    assert len(got) == len(names) and all(r.category == r.want for r in got)
    assert {r.category for r in with_category(df, rules=table.limit(0)).collect()} == {"other"}


def test_boosts_by_table(spark):
    table = [("sql", None, 0.1), ("Pull  Request", None, 0.2), ("pull", "code", -0.3), ("sql", "Code", 0.05), ("x", None, None), ("", None, 1.0), ("tie", None, 0.4), ("tie", None, -0.4)]
    rows = [("Code", "my SQL here", 0.05), ("Mail", "my SQL here", 0.1), ("Mail", "MySQL", 0.0), ("CODE", "pull request", -0.3), ("Web", "a pull-request!", 0.2), (None, "sql", 0.1), ("Web", None, 0.0), ("Web", "tie", 0.4), ("Web", "", 0.0)]
    df = spark.createDataFrame(rows + rows, "app_name string, text string, want double")
    got = B.with_table_boost(df, spark.createDataFrame(table, "term string, app_name string, boost double")).collect()
    assert len(got) == 2 * len(rows) and all(r.boost == r.want for r in got)
    none = spark.createDataFrame([], "term string, app_name string, boost double")
    assert {r.boost for r in B.with_table_boost(df, none).collect()} == {0.0}


def test_built_in_boosts(spark):
    rows = [("VSCode", "x", 0.15, 0.0), ("Chrome", "LeetCode", 0.2, 0.1), ("Chrome", "x", 0.0, 0.0), ("YouTube", "jira shorts", -0.3, -0.05), (None, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "app string, text string, a double, k double")
    for r in df.select("a", "k", F.round(B.app_rule_boost("app", "text"), 2).alias("x"), F.round(B.keyword_boost("text"), 2).alias("y")).collect():
        assert (r.a, r.k) == (r.x, r.y)


def test_carried_sums(spark):
    rng = random.Random(2)
    cells, want = [], []
    for s in range(40):
        pending = [0] * 5
        for i in range(rng.randrange(1, 40)):
            early = i < s % 4
            row = [rng.choice([0, 0, 0, 0, 1]), 0, 0, rng.randrange(-6, 7), 0]
            cells.append((f"s{s}", None if early else f"w{i // 3:02}", None if early else i // 3 * 1000, i * 100, *row, i))
            pending = [a + b for a, b in zip(pending, row)]
            if not early and max(pending) > 0:
                want.append((f"s{s}", f"w{i // 3:02}", i * 100, *pending))
                pending = [0] * 5
    kinds = "session_id string, active_window_id string, window_start_ms long, slot_ms long, " + ", ".join(f"{c} long" for c in inputs.COUNTERS) + ", dwell_time_ms long"
    got = inputs.carried(spark.createDataFrame(cells, kinds)).select("session_id", "active_window_id", "slot_ms", *inputs.COUNTERS).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_scrolling_back_is_carried(spark):
    x = spark.createDataFrame([("s", 500.0, 0, 0, 0, -5, 0), ("s", 10_500.0, 1, 0, 0, 0, 0)], "session_id string, monotonic_ms double, " + ", ".join(f"{c} long" for c in inputs.COUNTERS))
    x = x.withColumn("monotonic_ms", F.col("monotonic_ms").cast("long"))
    w = spark.createDataFrame([("s", "w", 0)], "session_id string, event_id string, monotonic_ms long")
    sums = lambda **o: [(r.slot_ms, r.key_count, r.scroll_delta) for r in inputs.input_summaries(x, w, **o).collect()]
    assert sums() == [(10_000, 1, 0)] and sums(carry=True) == [(10_000, 1, -5)] and sums(carry=True, hot=True) == [(10_000, 1, -5)]


def test_a_term_that_stands_often_in_a_boost_table_is_one_row_an_app(spark):
    n = F.col("id")
    table = spark.range(3000).select(F.when(n % 2 == 0, "Red").otherwise("red!").alias("term"), F.when(n % 3 == 0, "Mail").alias("app_name"), ((n % 41 - 20) / 100).alias("boost"))
    assert sorted((r._term, r._for or "", r.boost) for r in B.strongest_terms(table).collect()) == [("red", "", 0.2), ("red", "mail", 0.2)]
    df = spark.createDataFrame([("Mail", "a red one"), ("Web", "Red"), (None, "red"), ("Mail", "blue")], "app_name string, text string")
    weak = spark.createDataFrame([("red", "mail", -0.1), ("red", "mail", 0.05), ("red", None, 0.3), ("red", None, -0.3)], "term string, app_name string, boost double")
    got = {(r.app_name, r.text): r.boost for r in B.with_table_boost(df, weak).collect()}
    assert got == {("Mail", "a red one"): -0.1, ("Web", "Red"): 0.3, (None, "red"): 0.3, ("Mail", "blue"): 0.0}
