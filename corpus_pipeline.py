"""Corpus pipeline: five operators, each working on what the one before kept.

Rows are told apart by 128-bit hashes of their columns, nulls marked, not by doc_id, so
rows with a null id or a shared one are rows like any other. Where a stage doesn't say
otherwise, equal rows fare alike, null and empty texts are texts without words,
very long texts are handled whole, columns other than those of ``documents`` are
left out, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellspark.llm.decontaminate import contaminated
from dwellspark.llm.pieces import encode_pieces
from dwellspark.llm.quality_rules import quality_rules
from dwellspark.llm.simhash import near_copies
from dwellspark.llm.store import cut
from dwellspark.llm.substring import drop_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def row_key(*columns: str) -> Column:
    """128 bits of the columns' values, with a mark where one is null."""
    marked = [x for c in columns for x in (F.isnull(c), F.col(c))]
    return F.struct(F.xxhash64(*marked).alias("a"), F.xxhash64(F.lit(1), *marked).alias("b"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep; texts of fewer than 50 words go, null and
    empty ones among them. A verdict depends on text, language and source, and
    comes back to rows by a 128-bit hash of these."""
    keyed = docs.select(*COLUMNS, row_key("text", "lang", "source").alias("row_key"))
    kept = quality_rules(keyed, "row_key").where("kept").select("row_key")
    return keyed.join(kept, "row_key", "left_semi").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies (five-word shingles, similarity 0.8 or
    more): that of the least id, one without an id only where no other has one.
    Of equal rows one stays. Texts without words are one class."""
    keyed = docs.select(*COLUMNS, F.struct(F.isnull("doc_id").alias("none"), "doc_id", row_key(*COLUMNS).alias("row")).alias("row_key"))
    kept = near_copies(keyed, "row_key").where("row_key = component_id").select("row_key").distinct()
    return keyed.join(kept, "row_key", "left_semi").dropDuplicates(["row_key"]).select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without passages that stand earlier; those with no word left go, but not
    those that had none. Rows without an id lose nothing; of rows with one id
    the text's hash gives the order."""
    out = drop_repeats(docs, carry=("lang", "source", "n_chars")).where("n_removed = 0 OR n_removed < n_words")
    n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return out.select("doc_id", "text", "lang", "source", n_chars.alias("n_chars"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in whose text no benchmark item is found."""
    keyed = docs.select(*COLUMNS, row_key("text").alias("row_key"))
    hits = cut(contaminated(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "row_key").select("row_key").distinct())
    return keyed.join(hits, "row_key", "left_anti").select(*COLUMNS)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each row's text, checked to decode to that very text."""
    return encode_pieces(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding", pieces_stage),
]

#: SQL can't express the stages; tests hold them against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
