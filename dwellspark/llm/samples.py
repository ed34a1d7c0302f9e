"""Bounded samples of labelled rows, chosen by hash of the id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: characters of all sampled texts, and parts in which a label's rows meet
MOST_TOTAL, PARTS = 256_000_000, 64


def remainder(id_col: str, parts: int) -> F.Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def labelled_texts(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int, most_chars: int, most_total: int = MOST_TOTAL
) -> list[tuple[int, str, object]]:
    """At most ``per_label`` whole texts of each label, as (id, text, label) on the driver.

    Of the texts that may be learned from (not null, of ``most_chars`` at most; none
    is cut) those with the least hash of the id are taken, so a sample doesn't
    depend on how rows are dealt out. With many labels each gets fewer texts, so
    that all together have at most ``most_total`` characters; more labels than texts
    of ``most_chars`` fit into that are an error.

    Where ``labels`` is ``docs`` a row's label is its own, else that of its id: ids with
    more than one label are left out. A text is chosen with its row, so rows that
    share an id keep their own texts and labels; rows alike in all three are one.
    """
    fit = docs.where((F.length(text_col) <= most_chars) & F.col(id_col).isNotNull())
    own = [F.col(label_col).alias("label")] if labels is docs else []
    texts = fit.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"), *own)
    named = texts.drop("text")  # texts themselves are never shuffled
    if labels is not docs:
        of = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
        of = of.agg(F.min(label_col).alias("label"), F.max(label_col).alias("most")).where("label = most").drop("most")
        named = named.join(of, "id")
    named = named.where("label IS NOT NULL")
    kinds = named.agg(F.count_distinct("label")).first()[0]
    if not kinds:
        return []
    per_label = min(per_label, most_total // (kinds * most_chars))
    if not per_label:
        raise ValueError(f"{kinds} labels: {most_total} characters don't hold a text of {most_chars} for each")
    # a label's rows meet in parts first, so that a hot one is no single task's work
    rows = named.select("id", "t", "label").distinct().withColumn("h", F.xxhash64("id")).withColumn("part", F.pmod(F.xxhash64("id", "t"), F.lit(PARTS)))
    for by in (["label", "part"], ["label"]):
        nth = F.row_number().over(Window.partitionBy(*by).orderBy("h", "id", "t"))
        rows = rows.withColumn("nth", nth).where(F.col("nth") <= per_label).drop("nth")
    wanted = [tuple(r) for r in rows.select("id", "t", "label").collect()]
    small = docs.sparkSession.createDataFrame(wanted, named.select("id", "t", "label").schema)
    # bounded by per_label rows a label, in the broadcast and in what is collected
    on = ["id", "t", "label"] if labels is docs else ["id", "t"]
    got = texts.join(F.broadcast(small), on).groupBy("id", "t", "label").agg(F.min("text").alias("text")).collect()
    return sorted((r.id, r.text, r.label) for r in got)
