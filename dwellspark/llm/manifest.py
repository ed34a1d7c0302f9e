"""Merkle manifest of a table: one tree a group, one over the groups' roots.

A leaf's place among its group's ids comes from bitmaps: each group's ids as words
of 64 bits (only words that hold an id are stored), merged by OR, with directories
of row counts over 4096 words, 4096 of those, and so on. The rank of an id is its
word's count of rows before it plus the bits below its own, so leaves are never
sorted. Leaves then go to slots of arrays keyed by (group, place / 729), where six
levels of the tree are reduced at once, and the arrays' tops likewise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ordering import running_sum
from .store import cut, drop

#: children of a node; levels that one array reduces, and its slots
FANOUT, LEVELS = 3, 6
SPAN = FANOUT**LEVELS
#: nodes of a directory that one node above counts, as a shift
WIDE = 12
#: equal leaves that are dealt out together
PIECE = 1024
_LOW = -(1 << 63)


def leaf_digest(*fields: Column) -> Column:
    """sha256 of the fields' values in decimal or UTF-8, each behind its byte count
    and a colon, null as a dash."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*(part(c) for c in fields)), 256)


def _bit() -> Column:
    return F.col("id").bitwiseAND(F.lit(63)).cast("int")


def _levels(total: Column) -> Column:
    """Levels above the leaves of a tree of ``total`` leaves."""
    return F.size(F.filter(F.array(*(F.lit(FANOUT**k) for k in range(40))), lambda x: x < total))


def id_bitmaps(leaves: DataFrame) -> DataFrame:
    """``(grp, word, bits, n)``: which of 64 neighbouring ids a group has, and how many
    rows have them. Words follow the ids' signed order; null ids are in word 0,
    that of the least ids there can be."""
    return leaves.groupBy("grp", "word").agg(F.coalesce(F.bit_or("bit"), F.lit(0)).cast("long").alias("bits"), F.count("*").alias("n"))


def directory(words: DataFrame) -> DataFrame:
    """``words`` with ``base``, the rows of the group in words before, ``total``, the
    group's rows, and ``tree``, the group's place among all (null first, then by
    UTF-8 bytes). No window has more than 4096 rows."""
    levels = [words.select("grp", F.col("word").alias("node"), "n")]
    high, low = words.agg(F.max("word"), F.min("word")).first()
    high, low = high or 0, low or 0
    while high != low:
        high, low = high >> WIDE, low >> WIDE
        levels.append(cut(levels[-1].groupBy("grp", F.shiftright("node", WIDE).alias("node")).agg(F.sum("n").alias("n"))))
    groups = cut(levels[-1].groupBy("grp").agg(F.sum("n").alias("total")))
    places = running_sum(groups, [F.asc_nulls_first("grp")], name="tree").withColumn("tree", F.col("tree") - 1)
    above = levels[-1].join(places.withColumnRenamed("grp", "g"), F.col("grp").eqNullSafe(F.col("g"))).select("grp", "node", F.lit(0).cast("long").alias("base"), "total", "tree")
    for level in reversed(levels[:-1]):
        before = F.coalesce(F.sum("n").over(Window.partitionBy("grp", "up").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        level = level.withColumn("up", F.shiftright("node", WIDE)).withColumn("before", before)
        up = above.select(F.col("grp").alias("g"), F.col("node").alias("up"), "base", "total", "tree")
        above = level.join(up, level["grp"].eqNullSafe(up["g"]) & (level["up"] == up["up"])).select("grp", "node", (F.col("base") + F.col("before")).alias("base"), "total", "tree")
    out = above.select(F.col("grp").alias("g"), F.col("node").alias("w"), "base", "total", "tree")
    return words.join(out, words["grp"].eqNullSafe(out["g"]) & (words["word"] == out["w"])).drop("g", "w")


def leaf_places(leaves: DataFrame) -> DataFrame:
    """``leaves(grp, id, leaf, ...)`` with ``tree``, ``total`` and ``place``: the number of
    the group's rows before it, by id. Null ids come first; equal ids follow each
    other by leaf, equal leaves are one another's like.

    Ids that stand once are ranked by their bitmap. Words with repeated or null ids
    hold more rows than bits: their rows are counted by id and first digits of the
    leaf, so that the rows of one id are never one group.
    """
    keep = [c for c in leaves.columns if c not in ("grp", "id", "leaf")]
    word = F.coalesce(F.shiftrightunsigned(F.col("id").bitwiseXOR(F.lit(_LOW)), 6), F.lit(0)).cast("long")
    rows = cut(leaves.select("*", word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), _bit()).alias("bit")))
    words = cut(id_bitmaps(rows))
    ranked = cut(directory(words))
    r = ranked.withColumnsRenamed({"grp": "g", "word": "w"})
    found = rows.join(r, F.col("grp").eqNullSafe(F.col("g")) & (F.col("word") == F.col("w"))).drop("g", "w")
    below = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), _bit()))))
    lone = F.col("n") == F.bit_count("bits")
    cols = ["grp", "id", "leaf", *keep, "tree", "total", "place"]
    out = found.where(lone).withColumn("place", F.col("base") + below).select(*cols)
    if not ranked.where(~lone).isEmpty():
        digits = F.substring("leaf", 1, 4).alias("digits")
        alike = found.where(~lone).groupBy("tree", "total", "word", "base", "grp", "id", "leaf", *keep, digits).agg(F.count("*").alias("rows"))
        alike = cut(alike)
        ahead = Window.partitionBy("tree", "word").orderBy(F.asc_nulls_first("id"), "digits").rowsBetween(Window.unboundedPreceding, -1)
        counts = alike.groupBy("tree", "word", "id", "digits").agg(F.sum("rows").alias("c")).withColumn("ahead", F.coalesce(F.sum("c").over(ahead), F.lit(0)))
        counts = counts.select(F.col("tree").alias("t"), F.col("word").alias("w"), F.col("id").alias("i"), F.col("digits").alias("d"), "ahead")
        inside = Window.partitionBy("tree", "word", "id", "digits").orderBy("leaf", *keep).rowsBetween(Window.unboundedPreceding, -1)
        alike = alike.withColumn("inside", F.coalesce(F.sum("rows").over(inside), F.lit(0)))
        on = (F.col("tree") == F.col("t")) & (F.col("word") == F.col("w")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("digits") == F.col("d"))
        first = F.col("base") + F.col("ahead") + F.col("inside")
        many = alike.join(counts, on).withColumn("first", first).withColumn("end", first + F.col("rows") - 1)
        many = many.withColumn("from", F.explode(F.sequence("first", "end", F.lit(PIECE).cast("long")))).repartition("tree", "from")
        many = many.withColumn("place", F.explode(F.sequence("from", F.least("end", F.col("from") + PIECE - 1))))
        out = out.unionByName(many.select(*cols))
    out = cut(out)
    drop(rows, words, ranked)
    return out


def _parents(below: str) -> Column:
    """Hashes of every three neighbours of an array."""
    runs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda j: F.sha2(F.array_join(F.slice(below, j * FANOUT + 1, F.lit(FANOUT)), ""), 256))


def reduce_trees(nodes: DataFrame, keep: list[str] = ()) -> list[DataFrame]:
    """Trees ``nodes(tree, place, total, hash, keep...)`` to their roots: tables
    ``(tree, place, total, levels, members, hashes, hash)`` from the leaves up, each row
    an array of at most 729 neighbours, its levels, and the hash they come to."""
    most = nodes.agg(F.max("total")).first()[0] or 0
    out, left = [], _levels(F.col("total"))
    while True:
        slot = F.struct((F.col("place") % SPAN).cast("int").alias("slot"), "hash", *keep)
        x = nodes.groupBy("tree", F.floor(F.col("place") / SPAN).cast("long").alias("place")).agg(F.max("total").alias("total"), F.sort_array(F.collect_list(slot)).alias("members"))
        x = x.withColumn("levels", F.greatest(F.least(left - LEVELS * len(out), F.lit(LEVELS)), F.lit(0)))
        x = x.withColumn("h0", F.transform("members", lambda m: m["hash"]))
        for k in range(LEVELS):
            x = x.withColumn(f"h{k + 1}", F.when(F.col("levels") > k, _parents(f"h{k}")).otherwise(F.col(f"h{k}")))
        arrays = F.array(*(f"h{k}" for k in range(LEVELS))).alias("hashes")
        out.append(cut(x.select("tree", "place", "total", "levels", "members", arrays, F.get(f"h{LEVELS}", F.lit(0)).alias("hash"))))
        most = -(-most // SPAN)
        if most <= 1:
            return out
        nodes, keep = out[-1].select("tree", "place", "total", "hash"), []


def _path(slot: Column) -> Column:
    """Siblings of a slot's node on each level: those on its left and on its right."""

    def step(k):
        size = F.element_at(F.array(*(F.lit(FANOUT**j) for j in range(LEVELS))), k + 1)
        i = F.floor(slot / size).cast("int")
        run = i - i % FANOUT
        h = F.element_at("hashes", k + 1)
        left = F.array_join(F.slice(h, run + 1, i % FANOUT), "")
        right = F.array_join(F.slice(h, i + 2, F.lit(FANOUT - 1) - i % FANOUT), "")
        return F.struct(left.alias("l"), right.alias("r"))

    steps = F.transform(F.sequence(F.lit(0), F.col("levels") - 1), step)
    return F.when(F.col("levels") > 0, steps).otherwise(F.array().cast("array<struct<l:string,r:string>>"))


def tree_paths(levels: list[DataFrame], roots: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Each leaf of ``reduce_trees`` with its ``path`` to what ``roots(tree, path, ...)``
    adds above its tree's root, and the other columns of ``roots``."""
    given = [c for c in roots.columns if c not in ("tree", "path")]
    above = roots.select("tree", F.lit(0).cast("long").alias("place"), "path", *given)
    for k in range(len(levels) - 1, -1, -1):
        cols = list(keep) if k == 0 else []
        member = F.transform("members", lambda m: F.struct(m.alias("own"), _path(m["slot"]).alias("path")))
        x = levels[k].select("tree", "place", member.alias("members")).join(above.withColumnRenamed("path", "rest"), ["tree", "place"])
        x = x.select("tree", "place", "rest", *given, F.explode("members").alias("m"))
        above = x.select("tree", (F.col("place") * SPAN + F.col("m.own.slot")).alias("place"), F.col("m.own.hash").alias("hash"), *(F.col(f"m.own.{c}").alias(c) for c in cols), F.concat("m.path", "rest").alias("path"), *given)
    return above


def merkle_manifest(leaves: DataFrame) -> DataFrame:
    """``leaves(grp string, id long, leaf string, ...)`` with ``subroot`` (of the group's
    tree), ``root`` (over all groups, null first, then by UTF-8 bytes) and ``path``:
    for each level up to the root the siblings on the left and on the right.

    Equal rows are leaves of their own. Null ids and null groups come first. An
    empty table gives no rows. Further columns stay; theirs must not be called
    tree, place, total, word, bit, hash, path, subroot or root.
    """
    keep = [c for c in leaves.columns if c not in ("grp", "leaf")]
    placed = leaf_places(leaves)
    trees = reduce_trees(placed.withColumnRenamed("leaf", "hash"), ["grp", *keep])
    subroots = cut(trees[-1].where("place = 0").select("tree", F.col("hash").alias("subroot")))
    number = subroots.count()
    if not number:
        none = F.lit(None).cast("string")
        return leaves.select("*", none.alias("subroot"), none.alias("root"), F.array().cast("array<struct<l:string,r:string>>").alias("path")).limit(0)
    one = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(number).cast("long").alias("total"), F.col("subroot").alias("hash"))
    over = reduce_trees(one)
    top = over[-1].select("tree", F.col("hash").alias("root"), F.array().cast("array<struct<l:string,r:string>>").alias("path"))
    roots = tree_paths(over, top).select(F.col("place").alias("tree"), "path", F.col("hash").alias("subroot"), "root")
    out = tree_paths(trees, roots, ["grp", *keep])
    return out.select("grp", F.col("hash").alias("leaf"), *keep, "subroot", "root", "path")


def proof(path: Column) -> Column:
    """sha256 of all siblings of a path, in order."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["l"], p["r"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings come to."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p["l"], h, p["r"]), 256))
