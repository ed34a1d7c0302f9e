"""WARC fixity audit: Merkle trees over records and ordered offset ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import cut, drop

#: ids of one archive file, and children of one tree node
ARCHIVE, FANOUT = 1024, 16
#: copies of one id that are hashed together, and equal records that are dealt out together
TOGETHER = 4096
#: nodes of ids that are null or negative, and what stands for a null id in joins
STRAY, LONE = 4096, -(1 << 63)


def warc_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """``(id, record binary)``: each page as a WARC/1.1 resource record. Null urls
    and bodies become empty; the same page always gives the same bytes."""
    body = F.coalesce(F.col(body_col).cast("binary"), F.lit("").cast("binary"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(F.col(url_col), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return pages.select(F.col(id_col).cast("long").alias("id"), F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary")).alias("record"))


def leaves(records: DataFrame, archive: int = ARCHIVE) -> DataFrame:
    """``(archive, id, copy, offset, length, hash)``: record hashes in the order of
    their ids, with each record's byte range in its archive.

    An archive holds the ids of one fixed range; equal ids follow each other by hash
    and are numbered ``copy``. Null ids form archive -1. One id, or none, may hold any
    share of the records: equal records are counted first, then those of each id
    by the first digits of their hash, so that a window has an archive's ids times
    65,536 rows at most, or the different records of one id with the same digits.
    """
    number = F.coalesce(F.floor(F.col("id") / archive), F.lit(-1)).cast("long").alias("archive")
    slim = records.select(number, "id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("hash"), F.substring(F.sha2("record", 256), 1, 4).alias("digits"))
    alike = slim.groupBy("archive", "id", "digits", "length", "hash").agg(F.count("*").alias("n")).withColumn("bytes", F.col("n") * F.col("length"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = alike.groupBy("archive", "id", "digits").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    first = F.asc_nulls_first("id")
    sums = sums.select(
        F.col("archive").alias("a"), F.col("id").alias("i"), F.col("digits").alias("d"),
        before("n", Window.partitionBy("archive", "id").orderBy("digits")).alias("of_id"), before("bytes", Window.partitionBy("archive").orderBy(first, "digits")).alias("of_archive"),
    )
    inside = Window.partitionBy("archive", "id", "digits").orderBy("hash")
    alike = alike.withColumns({"copy": before("n", inside), "offset": before("bytes", inside)})
    x = alike.join(sums, (F.col("archive") == F.col("a")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("digits") == F.col("d")))
    x = x.withColumns({"copy": F.col("copy") + F.col("of_id"), "offset": F.col("offset") + F.col("of_archive")})
    each = lambda k: [(F.col("copy") + k).cast("int").alias("copy"), (F.col("offset") + k * F.col("length")).alias("offset")]
    # equal records in portions, dealt out anew before they become rows
    x = x.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(TOGETHER).cast("long")))).repartition("archive", "hash", "from")
    out = x.withColumn("k", F.explode(F.sequence("from", F.least(F.col("from") + TOGETHER - 1, F.col("n") - 1))))
    return out.select("archive", "id", *each(F.col("k")), "length", "hash")


def _node(fanout: int) -> F.Column:
    """Lowest node of a leaf: its id range, behind the STRAY nodes to which null and
    negative ids are dealt by hash, so that none of them holds them all."""
    stray = F.pmod(F.xxhash64("id", "hash"), F.lit(STRAY))
    return F.coalesce(F.when(F.col("id") >= 0, F.floor(F.col("id") / fanout) + STRAY), stray).cast("long")


def merkle_levels(leaf: DataFrame, fanout: int = FANOUT, archive: int = ARCHIVE) -> list[DataFrame]:
    """Levels ``(node, hash, ranges, low, high)`` of two trees of one shape, leaf nodes'
    parents first, one root last: ``hash`` covers records, ``ranges`` their ordered
    byte ranges.

    A node covers a fixed range of ids, so the same record has the same path in
    every replica and a lost record changes its own branch only. At level 0
    ``hash`` is of the records' ids, copies and hashes in order; ``ranges`` of where
    each begins within the node, and its length; copies beyond 4096 of an id are
    hashed in portions, and the portions' hashes and places after that. Above, a node's hashes cover
    its children's numbers and hashes, and how long each child is. Null and
    negative ids are dealt to STRAY nodes of their own by hash.
    """
    parts = F.sort_array(F.collect_list(F.struct("archive", "offset", "id", "copy", "length", "hash")))
    text = lambda of: F.sha2(F.array_join(F.transform(F.col("parts"), of), "|"), 256)
    whole = lambda p: F.concat_ws(":", F.coalesce(p["id"].cast("string"), F.lit("")), p["copy"], p["hash"])
    placed = lambda p: F.concat_ws(":", F.coalesce(p["id"].cast("string"), F.lit("")), p["copy"], p["offset"] - F.col("low"), p["length"])
    span = [F.min("offset").alias("low"), F.max(F.col("offset") + F.col("length")).alias("high")]
    rows = leaf.withColumn("node", _node(fanout)).withColumn("portion", F.floor(F.col("copy") / TOGETHER))
    level = rows.groupBy("archive", "node", "portion").agg(parts.alias("parts"), *span)
    level = level.select("archive", "node", "portion", text(whole).alias("hash"), text(placed).alias("ranges"), "low", "high")
    portions = F.sort_array(F.collect_list(F.struct("portion", "hash", "ranges", "low", "high")))
    level = level.groupBy("archive", "node").agg(portions.alias("parts"), F.min("low").alias("low"), F.max("high").alias("high"))
    put = lambda p: F.concat_ws(":", p["portion"], p["ranges"], p["low"] - F.col("low"), p["high"] - F.col("low"))
    levels = [cut(level.select("archive", "node", text(lambda p: F.concat_ws(":", p["portion"], p["hash"])).alias("hash"), text(put).alias("ranges"), "low", "high"))]
    # a node's archive is part of its place, as offsets start anew in each
    top = levels[0].agg(F.max("node"), F.min("node")).first()
    high, low = top[0] or 0, top[1] or 0
    while high != low:
        high, low = high // fanout, low // fanout
        up = levels[-1].select(F.floor(F.col("node") / fanout).cast("long").alias("node"), F.col("node").alias("n"), "hash", "ranges", (F.col("high") - F.col("low")).alias("size"), "low", "high")
        child = F.sort_array(F.collect_list(F.struct("n", "hash", "ranges", "size", "low")))
        level = up.groupBy("node").agg(child.alias("parts"), F.min("low").alias("low"), F.max("high").alias("high"))
        records, spans = (lambda p: F.concat_ws(":", p["n"], p["hash"])), (lambda p: F.concat_ws(":", p["n"], p["ranges"], p["size"]))
        levels.append(cut(level.select("node", text(records).alias("hash"), text(spans).alias("ranges"), "low", "high")))
    return levels


def audit(left: DataFrame, right: DataFrame, fanout: int = FANOUT, archive: int = ARCHIVE) -> DataFrame:
    """Records on which two replicas ``(id, record)`` differ: ``(id, copy, kind,
    left/right offset, length, hash)``; kind is changed, missing (only left) or
    extra (only right).

    Roots of both trees are compared first; each level then looks only at children
    of nodes whose records or ranges differ, so equal branches are never opened
    and two equal replicas end at their roots. Empty replicas have no root and
    differ in all rows. Equal ids are matched in the order of their hashes, so ties are
    records alike; long records are hashed whole, inside their row; columns other than
    ``id`` and ``record`` are not read, whatever their names.
    """
    a, b = cut(leaves(left, archive)), cut(leaves(right, archive))
    ta, tb = merkle_levels(a, fanout, archive), merkle_levels(b, fanout, archive)
    used = [a, b, *ta, *tb]
    while len(ta) != len(tb):  # the shorter tree's root range is opened whole
        (ta if len(ta) > len(tb) else tb).pop()
    open_nodes = None
    for x, y in zip(reversed(ta), reversed(tb)):
        if open_nodes is not None:
            x, y = (t.join(open_nodes, F.floor(t["node"] / fanout) == open_nodes["open"], "left_semi") for t in (x, y))
        at = ["archive", "node"] if "archive" in x.columns else ["node"]
        x, y = (t.select(*at, F.struct("hash", "ranges").alias(h)) for t, h in ((x, "h1"), (y, "h2")))
        both = x.join(y, at, "full").where("NOT (h1 <=> h2)")
        open_nodes = cut(both.select(F.col("node").alias("open")).distinct())
        used.append(open_nodes)
    a, b = (t.withColumn("node", _node(fanout)).join(open_nodes, F.col("node") == F.col("open"), "left_semi") for t in (a, b))
    a, b = (t.select(F.coalesce("id", F.lit(LONE)).alias("_id"), "copy", *(F.col(c).alias(f"{side}_{c}") for c in ("offset", "length", "hash"))) for t, side in ((a, "left"), (b, "right")))
    kind = F.when(F.col("left_hash").isNull(), "extra").when(F.col("right_hash").isNull(), "missing").otherwise("changed")
    out = a.join(b, ["_id", "copy"], "full").where("NOT (left_hash <=> right_hash)")
    out = cut(out.select(F.nullif("_id", F.lit(LONE)).alias("id"), "copy", kind.alias("kind"), *(f"{s}_{c}" for s in ("left", "right") for c in ("offset", "length", "hash"))))
    drop(*used)
    return out


def damaged(records: DataFrame, lose: int = 211, flip: int = 97, cut_short: int = 131) -> DataFrame:
    """A second replica with known damage, by id: some records lost, some with
    their last bytes replaced, some cut short."""
    broken = F.when(F.col("id") % flip == 0, F.concat(F.expr("substring(record, 1, octet_length(record) - 6)"), F.lit("??\r\n\r\n").cast("binary"))).when(
        F.col("id") % cut_short == 0, F.expr("substring(record, 1, octet_length(record) div 2)")
    )
    return records.where(F.col("id") % lose != 0).select("id", F.coalesce(broken, "record").alias("record"))

