"""Writing events and derived tables: keep-first inserts, upserts, fan-out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import cut, drop, exists
from .logs import normalize_envelope

#: of stored and intermediate tables, whose JSON is long
CODEC = "zstd"


def write_event_log(events: DataFrame, folder: str, max_records: int = 100_000) -> None:
    """Append as JSON lines, a folder for each date, a new file past a size."""
    dated = events.withColumn("event_date", F.date_format(F.timestamp_millis("epoch_ms"), "yyyyMMdd"))
    dated.write.mode("append").partitionBy("event_date").option("maxRecordsPerFile", max_records).json(folder)


def insert_or_ignore(new: DataFrame, old: DataFrame | None, key_sets: list[list[str]], required: list[str] = (), arrival: list[str] = ("seq",)) -> DataFrame:
    """Rows of ``new`` that an insert-or-ignore, row by row in the order of ``arrival``,
    would add to ``old``: required columns are there, and no stored row has the same
    value of any key set. A row that is passed over holds no key; a key with a null
    in it clashes with nothing. Rows that arrive at once come in some order.

    Only keys and order are compared; whole rows are written once and meet the numbers
    of those that are stored. The result reads written tables, which it has as ``scratch``.
    """
    for c in required:
        new = new.where(F.col(c).isNotNull())
    cols, whole = new.columns, cut(new.withColumn("_row", F.monotonically_increasing_id()), CODEC)
    left = _slim(whole, key_sets, arrival)
    if old is not None:
        for keys in key_sets:
            left = left.join(old.select(*keys).distinct(), list(keys), "left_anti").select(*left.columns)
    kept, scratch = _first_rows(left, key_sets, arrival)
    stored = whole.join(kept.select("_row"), "_row", "left_semi").select(*cols)
    stored.scratch = [whole, *scratch]
    return stored


def _slim(rows: DataFrame, key_sets: list[list[str]], arrival: list[str]) -> DataFrame:
    """The columns that say which rows are stored, and the row's number."""
    return rows.select(*dict.fromkeys([*(k for keys in key_sets for k in keys), *arrival]), "_row")


def _first_rows(left: DataFrame, key_sets: list[list[str]], arrival: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """Of the slim rows of a batch those that are stored, and the tables they are read from.

    A round stores the rows that come first in all their keys and passes over those
    that clash with them; what neither befell goes to the next round, which few
    rows ever see.
    """
    kept, scratch, cols = None, [], left.columns
    while True:
        x = left
        for i, keys in enumerate(key_sets):
            whole = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
            nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*arrival, "_row"))
            x = x.withColumn(f"_first{i}", ~whole | (nth == 1))
        first = reduce(lambda a, b: a & b, (F.col(f"_first{i}") for i in range(len(key_sets))))
        x = cut(x.select(*cols, first.alias("_first")), CODEC)
        scratch.append(x)
        here = x.where("_first").select(*cols)
        kept = here if kept is None else kept.unionByName(here)
        rest = x.where("NOT _first").select(*cols)
        if len(key_sets) == 1 or rest.isEmpty():
            return kept, scratch
        for keys in key_sets:
            rest = rest.join(here.select(*keys).distinct(), list(keys), "left_anti").select(*cols)
        left = cut(rest, CODEC)
        scratch.append(left)
        if left.isEmpty():
            return kept, scratch


def events_raw(events: DataFrame) -> DataFrame:
    """Envelope columns and the whole event as JSON; an event without ``monotonic_ms``
    takes ``end_monotonic_ms``."""
    whole = events.withColumn("payload_json", F.to_json(F.struct(*events.columns)))
    if "end_monotonic_ms" not in whole.columns:
        whole = whole.withColumn("end_monotonic_ms", F.lit(None).cast("double"))
    return normalize_envelope(whole).select(
        F.col("event_id").alias("id"), "session_id", "seq", "created_at", "timezone_offset", "timestamp_ms", "monotonic_ms", "type", "payload_json"
    )


def upsert(new: DataFrame, old: DataFrame | None, keys: list[str]) -> DataFrame:
    """``old`` with ``new``'s rows in place of those with the same keys; other old
    rows stay. Write the result to a new version or over whole day folders."""
    return new if old is None else new.unionByName(old.join(new.select(*keys).distinct(), list(keys), "left_anti").select(*new.columns))


#: columns of the derived tables, none of which may be null, beside ``id``
DERIVED = {
    "window_dwell": ["session_id", "seq", "created_at", "timezone_offset", "timestamp_ms", "window_event_id", "app_name", "normalized_window_title", "start_monotonic_ms", "end_monotonic_ms", "dwell_time_ms"],
    "input_summary": ["session_id", "seq", "created_at", "timezone_offset", "timestamp_ms", "active_window_id", "key_count", "click_count", "mouse_distance", "scroll_delta", "idle_ms", "dwell_time_ms"],
}
RAW = ["session_id", "seq", "type", "created_at", "timezone_offset", "timestamp_ms", "monotonic_ms", "payload_json"]
ARRIVAL = ["timestamp_ms", "seq", "id"]


def derived_rows(events: DataFrame, kind: str) -> DataFrame:
    """The derived table's columns of all events of one kind; columns that the events
    don't have are null."""
    x = events.where(F.col("type") == kind).withColumnsRenamed({"event_id": "id", "timestamp": "timestamp_ms"})
    return x.select(*(F.col(c) if c in x.columns else F.lit(None).cast("string").alias(c) for c in ("id", *DERIVED[kind])))


def _commits(spark: SparkSession, folder: str) -> DataFrame | None:
    if not exists(spark, f"{folder}/commits"):
        return None
    return spark.read.schema("batch long").option("recursiveFileLookup", True).json(f"{folder}/commits")


def stored_rows(spark: SparkSession, folder: str) -> DataFrame | None:
    """Rows of a keyed table, of whole batches only; None before the first."""
    done = _commits(spark, folder)
    if done is None:
        return None
    rows = spark.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")
    return rows.join(F.broadcast(done), "batch", "left_semi").drop("batch")  # one number a batch


def keyed_append(rows: DataFrame, folder: str, batch_id: int, key_sets: list[list[str]], required: list[str] = (), arrival: list[str] = ARRIVAL, buckets: int = 64) -> None:
    """Insert-or-ignore of one batch into a stored table.

    Each key set has a key table beside the rows, in folders by the keys' hash; a
    batch reads those folders that its own keys fall in and nothing else of what is
    stored. Rows, keys, and last of all the batch's number are written; a batch
    whose number is missing counts as not written, and writes its folders over
    when it is run again. One whose number is there does nothing.
    """
    spark = rows.sparkSession
    done = _commits(spark, folder)
    if done is not None and not done.where(F.col("batch") == batch_id).isEmpty():
        return
    bucket = lambda keys: F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    for c in required:
        rows = rows.where(F.col(c).isNotNull())
    # the whole rows are written, and dealt out once when the numbers of those to be stored are known
    new = cut(rows.withColumn("_row", F.monotonically_increasing_id()), CODEC)
    fresh = _slim(new, key_sets, arrival)
    for i, keys in enumerate(key_sets):
        if done is None or not exists(spark, f"{folder}/keys{i}"):
            continue
        used = [r[0] for r in new.select(bucket(keys)).distinct().collect()]  # at most ``buckets`` numbers
        kinds = new.select(*keys, F.lit(0).cast("long").alias("batch"), F.lit(0).alias("bucket")).schema
        stored = spark.read.schema(kinds).option("basePath", f"{folder}/keys{i}").parquet(f"{folder}/keys{i}").where(F.col("bucket").isin(used))
        stored = stored.join(F.broadcast(done), "batch", "left_semi").select(*keys)
        fresh = fresh.join(stored, list(keys), "left_anti").select(*fresh.columns)
    kept, scratch = _first_rows(fresh, key_sets, arrival)
    new.join(kept.select("_row"), "_row", "left_semi").drop("_row").write.mode("overwrite").option("compression", CODEC).parquet(f"{folder}/rows/batch={batch_id}")
    for i, keys in enumerate(key_sets):
        kept.select(*keys, bucket(keys).alias("bucket")).write.mode("overwrite").option("compression", CODEC).partitionBy("bucket").parquet(f"{folder}/keys{i}/batch={batch_id}")
    spark.range(1).select(F.lit(batch_id).alias("batch")).write.mode("overwrite").json(f"{folder}/commits/number={batch_id}")
    drop(new, *scratch)


class SinkErrors(Exception):
    """Sinks of one batch that failed, by name; the others have written it."""

    def __init__(self, errors: dict[str, Exception]):
        super().__init__("; ".join(f"{name}: {e}" for name, e in errors.items()))
        self.errors = errors


def fanout(batch: DataFrame, folder: str, batch_id: int = 0, log: bool = False) -> None:
    """One batch to raw events (each id and each session's seq once), to the derived
    tables (each id once), and with ``log`` to JSON lines.

    An event that was stored by an earlier batch, or by this one when it is run again,
    isn't stored twice. Each sink is tried even where another fails; then the
    failures are raised together, so that the batch comes again and only what is
    missing is written.
    """
    tasks = {"events_raw": lambda: keyed_append(events_raw(batch), f"{folder}/events_raw", batch_id, [["id"], ["session_id", "seq"]], RAW)}
    for kind, needed in DERIVED.items():
        tasks[kind] = lambda kind=kind, needed=needed: keyed_append(derived_rows(batch, kind), f"{folder}/{kind}", batch_id, [["id"]], needed)
    if log:
        tasks["log"] = lambda: batch.write.mode("overwrite").json(f"{folder}/log/batch={batch_id}")
    failed = {}
    for name, task in tasks.items():
        try:
            task()
        except Exception as e:  # noqa: BLE001
            failed[name] = e
    if failed:
        raise SinkErrors(failed)
