"""Log audits: record checks, tails, gaps, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.timefns import parses_as_time
from ..functions.titles import rotation_index, trim_all
from .ordering import Ranged, running_sum

#: fields of the envelope in the order they are checked
ENVELOPE = ["schema_version", "event_id", "session_id", "seq", "created_at", "epoch_ms", "monotonic_ms", "timezone_offset", "source", "type", "payload"]
_NUMBERS = {"seq", "epoch_ms", "monotonic_ms", "timezone_offset"}


def _field(c: str) -> Column:
    return F.try_variant_get("_v", f"$.{c}", "variant")


def _kind(v: Column) -> Column:
    """What a JSON value is: STRING, BIGINT, DECIMAL(…), OBJECT<…>, ARRAY<…>, VOID, …;
    empty where there is none."""
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def violation() -> Column:
    """Name of the first field of the record ``_v`` that breaks its rule, or null. Types
    are JSON's: a number in quotes is no number, and only an object is a payload."""
    text = lambda c: F.when(_kind(_field(c)) == "STRING", F.try_variant_get("_v", f"$.{c}", "string"))
    number = lambda c: F.when(_kind(_field(c)).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get("_v", f"$.{c}", "double"))
    blank = lambda c: F.coalesce(trim_all(text(c)), F.lit("")) == ""
    whole = lambda c: F.coalesce(number(c) == F.floor(number(c)), F.lit(False))
    rules = [
        ("record", ~_kind(F.col("_v")).rlike("^(OBJECT|ARRAY)")), ("schema_version", blank("schema_version")), ("event_id", blank("event_id")),
        ("session_id", blank("session_id")), ("seq", ~(whole("seq") & (number("seq") >= 0))), ("created_at", ~F.coalesce(parses_as_time(text("created_at")), F.lit(False))),
        ("epoch_ms", ~whole("epoch_ms")), ("monotonic_ms", ~F.coalesce(number("monotonic_ms") >= 0, F.lit(False))), ("timezone_offset", ~whole("timezone_offset")),
        ("source", blank("source")), ("type", blank("type")), ("payload", ~_kind(_field("payload")).startswith("OBJECT")),
    ]
    return F.coalesce(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules))


def validate_events(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """``lines`` with the envelope's fields (numbers as double, ``payload`` as JSON),
    ``is_object`` and ``violation``. A line that isn't JSON is no record."""
    out = lines.withColumn("_v", F.try_parse_json(line_col))
    get = lambda c: F.to_json(_field(c)) if c == "payload" else F.try_variant_get("_v", f"$.{c}", "double" if c in _NUMBERS else "string")
    return out.select(*lines.columns, *(get(c).alias(c) for c in ENVELOPE), _kind(F.col("_v")).startswith("OBJECT").alias("is_object"), violation().alias("violation"))


def _seq(line_col: str) -> Column:
    """The line's seq where it is a whole JSON record with an integer there."""
    text = F.get_json_object(line_col, "$.seq")
    return F.when(F.get_json_object(line_col, "$").isNotNull() & text.rlike(r"^-?[0-9]+$"), text.cast("long"))


def audit_log(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """``lines(file, pos, line)`` -> per file: lines, parse errors, records without a
    numeric seq, and the first bad line's place. Blank lines don't count."""
    x = lines.where(F.trim(line_col) != "").withColumns(
        {"_parsed": F.get_json_object(line_col, "$").isNotNull(), "_seq": _seq(line_col)}
    )
    bad = ~F.col("_parsed") | F.col("_seq").isNull()
    return x.groupBy("file").agg(
        F.count("*").alias("lines"), F.count_if(~F.col("_parsed")).alias("parse_errors"),
        F.count_if(F.col("_parsed") & F.col("_seq").isNull()).alias("missing_seq"), F.min(F.when(bad, F.col("pos"))).alias("first_bad_pos"),
    )


def log_tail_seq(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Per file: seq of the last valid line (-1 without one) and how many lines
    behind it are cut off or broken."""
    x = lines.where(F.trim(line_col) != "").withColumn("_seq", _seq(line_col))
    last = x.where("_seq IS NOT NULL").groupBy("file").agg(F.max(F.struct("pos", "_seq")).alias("t")).select("file", "t.pos", F.col("t._seq").alias("tail_seq"))
    lines = x.select("file", F.col("pos").alias("_pos")).join(last, "file", "left")
    per = lines.groupBy("file").agg(F.coalesce(F.max("tail_seq"), F.lit(-1)).alias("tail_seq"), F.count_if(F.col("_pos") > F.coalesce("pos", F.lit(-1))).cast("int").alias("truncated_lines"))
    return per.withColumn("truncated", F.col("truncated_lines") > 0)


def log_file_order(files: DataFrame, name_col: str = "file") -> DataFrame:
    """Log files, newest first: by date, then by rotation number; other names go."""
    f = files.where(F.col(name_col).rlike(r"events-[0-9]{8}(\.[0-9]+)?\.jsonl$"))
    f = f.withColumns({"log_date": F.regexp_extract(name_col, r"events-([0-9]{8})", 1), "rotation": rotation_index(name_col)})
    return running_sum(f, [F.desc("log_date"), F.desc("rotation"), F.col(name_col)], name="newest").withColumn("newest", F.col("newest").cast("int"))


def latest_log_file(files: DataFrame, name_col: str = "file") -> DataFrame:
    f = files.where(F.col(name_col).rlike(r"events-[0-9]{8}(\.[0-9]+)?\.jsonl$"))
    return f.orderBy(F.desc(F.regexp_extract(name_col, r"events-([0-9]{8})", 1)), F.desc(rotation_index(name_col)), name_col).limit(1)


def audit_sequence(events: DataFrame, session: str = "session_id", require_zero_start: bool = True, hot: bool = False) -> DataFrame:
    """Per session: records, different seqs, first and last seq, and the first place
    where the sorted seqs leave 0, 1, 2, … (or first, first + 1, …).

    With ``hot`` sessions are numbered in ranges, for tables where one session may be
    too large for a task.
    """
    x = events.where("seq IS NOT NULL")
    if hot:
        x = Ranged(x.select(session, "seq"), [session], ["seq"]).number("_n").done()
    else:
        x = x.withColumn("_n", F.row_number().over(Window.partitionBy(session).orderBy("seq")) - 1)
    # from the first seq where that need not be 0: the least difference is that of the first row
    shift = F.lit(0) if require_zero_start else F.col("_low")
    if not require_zero_start:
        low = x.where("_n = 0").select(F.col(session).alias("_s"), F.col("seq").alias("_low"))
        x = x.join(low, F.col(session).eqNullSafe(F.col("_s")), "left").drop("_s")
    n = (F.col("_n") + shift).cast("long")
    wrong = F.when(F.col("seq") != n, F.struct(n.alias("n"), "seq"))
    return x.groupBy(session).agg(
        F.count("*").alias("records"), F.countDistinct("seq").alias("distinct_seqs"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
        F.min(wrong).alias("_w"),
    ).select(session, "records", "distinct_seqs", "first_seq", "last_seq", F.col("_w.n").alias("expected_seq"), F.col("_w.seq").alias("found_seq"))


def reconcile_checkpoint(tails: DataFrame, checkpoints: DataFrame, key: str = "session_id") -> DataFrame:
    """``tails(key, tail_seq)`` against ``checkpoints(key, last_flushed_seq)``: A equal,
    B log ahead, C checkpoint ahead. The log wins; a missing side is -1."""
    j = tails.select(key, "tail_seq").join(checkpoints.select(key, "last_flushed_seq"), key, "full").fillna(-1, ["tail_seq", "last_flushed_seq"])
    kind = F.when(F.col("tail_seq") == F.col("last_flushed_seq"), "A").when(F.col("tail_seq") > F.col("last_flushed_seq"), "B").otherwise("C")
    return j.withColumns({"case": kind, "checkpoint_updated": F.col("tail_seq") != F.col("last_flushed_seq"), "resume_seq": F.col("tail_seq")})


def audit_checkpoint(tails: DataFrame, checkpoints: DataFrame, key: str = "session_id") -> DataFrame:
    """Checkpoints that lead their log; they may only lag it."""
    return reconcile_checkpoint(tails, checkpoints, key).where("case = 'C'")


def retention_purge(files: DataFrame, now_ms: int, most_days: int | None = None, most_bytes: int | None = None) -> DataFrame:
    """``files(file, log_day_ms, bytes)`` with ``purge``: too old, or beyond the total
    size when the newest are kept first."""
    out = F.lit(False)
    if most_days is not None:
        out = out | (F.col("log_day_ms") < now_ms - most_days * 86_400_000)
    files = running_sum(files, [F.desc("log_day_ms"), F.desc("file")], F.col("bytes"), "_sum")
    if most_bytes is not None:
        out = out | (F.col("_sum") > most_bytes)
    return files.withColumn("purge", out).drop("_sum")
