"""What a batch costs a sink: whole rows are written when they come and when they are stored."""

from pyspark.sql import functions as F

from dwellspark.sources import sinks


def rows(spark, low, high):
    """Rows whose payload doesn't compress."""
    noise = F.concat(*(F.sha2(F.concat_ws("-", "id", F.lit(k)), 512) for k in range(8)))
    return spark.range(low, high).select(F.concat(F.lit("e"), "id").alias("id"), (F.col("id") % 5).cast("string").alias("session_id"), "id", noise.alias("payload")).toDF("id", "session_id", "seq", "payload")


def test_keys_are_compared_without_the_rows(spark, tmp_path, monkeypatch):
    seen, real = [], sinks.cut
    monkeypatch.setattr(sinks, "cut", lambda df, *codec: seen.append(df.columns) or real(df, *codec))
    folder = f"file://{tmp_path}"
    for k in range(2):
        batch = rows(spark, k * 50, k * 50 + 100).withColumn("id", F.when(F.col("seq") % 10 == 3, F.concat("id", F.lit("x"))).otherwise(F.col("id")))
        clash = rows(spark, k * 50 + 10, k * 50 + 20).withColumn("id", F.concat("id", F.lit("y")))
        sinks.keyed_append(batch.unionByName(clash), folder, k, [["id"], ["session_id", "seq"]], ["session_id"], ["seq", "id"])
    assert sum("payload" in columns for columns in seen) == 2
    stored = sinks.stored_rows(spark, folder)
    assert stored.columns == ["id", "session_id", "seq", "payload"]
    want = rows(spark, 0, 150).select(F.when(F.col("seq") % 10 == 3, F.concat("id", F.lit("x"))).otherwise(F.col("id")).alias("id"), "session_id", "seq", "payload")
    assert stored.exceptAll(want).count() == want.exceptAll(stored).count() == 0


def test_insert_or_ignore_writes_whole_rows_once(spark, monkeypatch):
    seen, real = [], sinks.cut
    monkeypatch.setattr(sinks, "cut", lambda df, *codec: seen.append(df.columns) or real(df, *codec))
    old, new = rows(spark, 0, 20), rows(spark, 10, 40)
    chain = new.withColumns({"id": F.concat("id", F.lit("z")), "seq": F.col("seq") + 5}).where("seq < 30")
    got = sinks.insert_or_ignore(new.unionByName(chain), old, [["id"], ["session_id", "seq"]], ["session_id"])
    assert sum("payload" in columns for columns in seen) == 1 and got.columns == new.columns
    assert sorted(r.id for r in got.collect()) == sorted(f"e{k}" for k in range(20, 40))
