"""Reading event logs: folders of JSON lines, in batch and as streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import exists

#: all generations of events in one row; readers ignore what they don't know
EVENT = (
    "schema_version string, event_id string, session_id string, seq long, created_at string, epoch_ms long, timestamp long, monotonic_ms double,"
    " timezone_offset int, source string, type string, payload string, app_name string, window_title string, trigger_reason string, bundle_id string,"
    " process_name string, active_window_id string, key_count long, click_count long, mouse_distance long, scroll_delta long, idle_ms long,"
    " dwell_time_ms long, window_event_id string, normalized_window_title string, start_monotonic_ms double, end_monotonic_ms double,"
    " semantic_label string, _corrupt string"
)


def read_event_log(spark: SparkSession, folder: str, names: str = "events-*.jsonl") -> DataFrame:
    """All records of a folder's logs, with ``file``; bad lines fill ``_corrupt``."""
    df = spark.read.schema(EVENT).option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", names).json(folder)
    return df.withColumn("file", F.col("_metadata.file_name"))


def read_log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(file, pos, line) of each log file: files are kept whole, so places are exact."""
    raw = spark.read.option("pathGlobFilter", "events-*.jsonl").text(folder, wholetext=True).withColumn("file", F.col("_metadata.file_name"))
    return raw.select("file", F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))


def list_log_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes) of each log file; contents aren't read. Scans pass over empty
    files, so names come from the scan's file listing and missing sizes are 0."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "events-*.jsonl").load(folder)
    names = spark.createDataFrame([(path.rsplit("/", 1)[-1],) for path in df.inputFiles()], "file string")
    sizes = df.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("_bytes"))
    return names.join(sizes, "file", "left").select("file", F.coalesce("_bytes", F.lit(0).cast("long")).alias("bytes"))


def as_log_files(spark: SparkSession, written: str, folder: str) -> None:
    """Give what was written by ``file=<log name>`` its names: each folder's one part
    becomes that log in ``folder``. A rename a log; contents aren't read."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    source, target = hadoop.Path(written), hadoop.Path(folder)
    fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target)
    for part in fs.globStatus(hadoop.Path(source, "file=*/part-*")):
        path = part.getPath()
        name = path.getParent().getName().removeprefix("file=")
        if not fs.rename(path, hadoop.Path(target, name)):
            raise OSError(f"two parts, or none that can be moved, for {name}")


def event_log_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100, names: str = "events-*.jsonl") -> DataFrame:
    """The log as a stream; with ``recursiveFileLookup`` in all of the folder's folders."""
    stream = spark.readStream.schema(EVENT).option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", names).option("recursiveFileLookup", True)
    return stream.option("maxFilesPerTrigger", files_per_trigger).json(folder)


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, last_flushed_seq): -1 where a number is missing or the file can't be
    parsed; no row where there is no file."""
    kinds = "session_id string, last_flushed_seq long"
    if not exists(spark, path):
        return spark.createDataFrame([], kinds)
    v = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    seq = F.coalesce(F.try_variant_get("v", "$.last_flushed_seq", "bigint"), F.lit(-1).cast("long"))
    return v.select(F.try_variant_get("v", "$.session_id", "string").alias("session_id"), seq.alias("last_flushed_seq"))


def merge_streams(*parts: DataFrame) -> DataFrame:
    """Event tables of several types as one, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def normalize_envelope(events: DataFrame) -> DataFrame:
    """``timestamp_ms`` and ``monotonic_ms`` with zeros and nulls passed over."""
    nz = lambda c: F.nullif(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    mono = F.coalesce(nz("monotonic_ms"), nz("end_monotonic_ms"), F.lit(0.0))
    return events.withColumns({"timestamp_ms": F.coalesce("timestamp", F.lit(0)).cast("long"), "monotonic_ms": mono})


#: columns that records of the first generation keep in their payload
PAYLOAD = {
    **dict.fromkeys(("app_name", "window_title", "trigger_reason", "bundle_id", "process_name", "active_window_id", "window_event_id", "normalized_window_title", "semantic_label"), "string"),
    **dict.fromkeys(("key_count", "click_count", "mouse_distance", "scroll_delta", "idle_ms", "dwell_time_ms"), "bigint"),
    **dict.fromkeys(("start_monotonic_ms", "end_monotonic_ms"), "double"),
}


def read_all_versions(events: DataFrame) -> DataFrame:
    """Records of all generations in one shape: what the first one keeps in ``payload``
    fills the flat columns that are null, ``epoch_ms`` fills ``timestamp``, and a flat
    record without a type is a summary where it holds counters, a window otherwise.
    A payload that is no JSON object gives nothing; one field of a wrong type is null.
    """
    payload = F.try_parse_json("payload")
    inner = F.when(F.coalesce(F.schema_of_variant(payload), F.lit("")).startswith("OBJECT"), payload)
    x = events.withColumn("_p", inner)
    x = x.withColumns({c: F.coalesce(c, F.try_variant_get("_p", f"$.{c}", t)) for c, t in PAYLOAD.items() if c in events.columns}).drop("_p")
    kind = F.coalesce("type", F.when(F.col("key_count").isNotNull(), "input_summary").otherwise("active_window"))
    return x.withColumns({"type": kind, "timestamp": F.coalesce("timestamp", "epoch_ms")})


def route_by_type(events: DataFrame, kind: str) -> DataFrame:
    return events.where(F.col("type") == kind)
