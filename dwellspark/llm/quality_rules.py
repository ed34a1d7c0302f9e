"""Quality rules: base counts and robust multivariate outliers, all in Spark SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import cut, drop

WORD = r"[^\\x20\\x09-\\x0D]+"
#: share of a group's rows that an estimate rests on, and what makes the
#: covariance of that share fit normal data in five dimensions
SHARE, CONSISTENT = 0.75, 1.41
#: 0.99999 quantile of chi-square with five degrees of freedom
CUT = 30.86
#: rows below which a group borrows the estimate of its language, then of all
LEAST_ROWS = 60
#: rows of one salt of a group, most concentration steps, and the change of every
#: group's log spread at which they end
SALT_ROWS, STEPS, SETTLED = 2000, 8, 0.01
#: transformed statistics, and the least spread (given those before it) that counts
#: for each: a floor under the estimate, so small that the last two reach CUT alone
STATS = {
    "x0": ("ln(n_words + 1)", 0.8),
    "x1": ("word_chars / greatest(n_words, 1)", 0.3),
    "x2": ("sqrt(100 * n_symbols / greatest(n_words, 1))", 0.5),
    "x3": ("sqrt(100 * n_dup_lines / greatest(n_lines, 1))", 1.0),
    "x4": ("ln(1 + 100 * n_repeat_words / greatest(n_words, 1))", 0.65),
}
_X = list(STATS)
_PAIRS = [(i, j) for i in range(len(_X)) for j in range(i + 1)]


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines (lines with a word),
    n_dup_lines and n_repeat_words of each whole text; null counts as empty.

    Repeats of three words are found inside the row. A text whose windows all
    hash apart has none. In others each hash shares a long with its place, the
    sorted longs put equal windows side by side, and the words of neighbours with
    one hash are compared.
    """
    at = lambda d: f"s[least(greatest(i + {d}, 0), size(s) - 1)]"
    place = lambda y, k: f"w[cast({y} & k.m AS int) + {k}]"
    alike = lambda d: f"(i + {d} BETWEEN 0 AND size(s) - 1 AND shiftright(x, k.b) = shiftright({at(d)}, k.b))"
    equal = lambda d: f"({alike(d)} AND {' AND '.join(f'{place("x", k)} = {place(at(d), k)}' for k in range(3))})"
    near = f"({alike(-1)} OR {alike(1)}) AND ({' OR '.join(map(equal, (-1, 1, -2, 2)))})"
    inner = f"""
      transform(array(regexp_extract_all(coalesce({text_col}, ''), '{WORD}', 0)), w ->
        transform(array(struct(size(w) AS n, length(bin(size(w))) AS b, shiftleft(1L, length(bin(size(w)))) - 1 AS m)), k -> struct(
          cast(k.n AS long) AS n_words,
          cast(length(array_join(w, '')) AS long) AS word_chars,
          transform(array(if(k.n < 4, array(), transform(sequence(0, k.n - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])))), h ->
            if(size(array_distinct(h)) = size(h), 0L,
              transform(array(sort_array(transform(h, (x, i) -> shiftleft(x, k.b) | cast(i AS long)))), s ->
                transform(array(transform(filter(s, (x, i) -> {near}), x -> x & k.m)), r ->
                  cast(size(array_union(array_union(r, transform(r, x -> x + 1)), transform(r, x -> x + 2))) AS long))[0])[0]))[0]
            AS n_repeat_words))[0])[0]"""
    lines = f"""transform(array(filter(split(coalesce({text_col}, ''), '\\n'), l -> l rlike '{WORD}')), l ->
        struct(cast(size(l) AS long) AS n_lines, cast(size(l) - size(array_distinct(l)) AS long) AS n_dup_lines))[0]"""
    keep = [F.col(c) for c in docs.columns]
    return docs.select(
        *keep, F.expr(inner).alias("_w"), F.expr(lines).alias("_l"),
        F.expr(f"cast(regexp_count(coalesce({text_col}, ''), '[#*$%&|<>]') AS long)").alias("n_symbols"),
    ).select(*keep, "_w.*", "_l.*", "n_symbols")


def _with_distance(rows: DataFrame) -> DataFrame:
    for i in range(len(_X)):
        rest = F.col(_X[i]) - F.col(f"c{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"y{j}")
        rows = rows.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, len(_X))), F.col("y0") * F.col("y0")))


def _factored(table: DataFrame) -> DataFrame:
    """Cholesky factor l of covariance v (columns vij), row by row; what is left
    on the diagonal counts as the statistic's least spread, squared, at least."""
    for i, j in _PAIRS:
        rest = F.col(f"v{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        floor = STATS[_X[i]][1] ** 2
        table = table.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(floor))) if i == j else rest / F.col(f"l{j}{j}"))
    return table


def outlier_distances(rows: DataFrame, keys: list[str], fit: F.Column) -> DataFrame:
    """``rows`` with ``d2``: distance from its group's minimum-covariance-determinant estimate.

    rows has x0..x4; only rows where ``fit`` holds are estimated from. Groups
    are the values of ``keys`` (null is a value); one with under LEAST_ROWS rows
    borrows. Starting from medians and quartiles, each concentration step takes
    the SHARE of rows nearest to the estimate and re-estimates centre and
    covariance from them, until no group's determinant shrinks further, STEPS times
    at most: a group that hasn't settled by then keeps its last estimate. A step
    sums by group, salt and bin of distance (a group has a salt for SALT_ROWS
    rows), then by group and bin, so a hot group's rows never meet and its bins
    are 1001 at most.
    """
    named = [F.to_json(F.struct(*keys[:k])) if k else F.lit("{}") for k in range(len(keys), -1, -1)]
    rows = rows.withColumns({f"_g{k}": F.concat(F.lit(f"{k}"), g) for k, g in enumerate(named)}).withColumn("_fit", F.coalesce(fit, F.lit(False)))
    levels = [f"_g{k}" for k in range(len(named))]
    sizes = rows.where("_fit").groupBy(*levels).agg(F.count("*").alias("n_g0"))
    of = rows.select(*levels).distinct().join(sizes, levels, "left")
    for g in levels[1:-1]:
        of = of.join(sizes.groupBy(g).agg(F.sum("n_g0").alias(f"n{g}")), g, "left")
    grp = F.coalesce(*(F.when(F.col(f"n{g}") >= LEAST_ROWS, F.col(g)) for g in levels[:-1]), F.col(levels[-1]))
    of = of.select(levels[0], grp.alias("grp"), "n_g0")
    salts = of.groupBy("grp").agg(F.greatest(F.ceil(F.sum("n_g0") / SALT_ROWS).cast("int"), F.lit(1)).alias("salts"))
    of = of.join(salts, "grp").select(levels[0], "grp", F.coalesce("salts", F.lit(1)).alias("salts"))
    salt = F.pmod(F.hash(*_X, "id"), F.col("salts")).alias("salt")
    rows = cut(rows.join(of, levels[0]).select("*", salt).drop(*levels))
    fitted = rows.where("_fit")

    bins = [F.percentile(F.round(F.col(x) * 64) / 64, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias(f"q{i}") for i, x in enumerate(_X)]
    start = fitted.groupBy("grp", "salts").agg(*bins)
    model = start.select(
        "grp", "salts", *(F.col(f"q{i}")[1].alias(f"c{i}") for i in range(len(_X))),
        *(F.pow(F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(STATS[_X[i]][1])), 2).alias(f"v{i}{i}") if i == j else F.lit(0.0).alias(f"v{i}{j}") for i, j in _PAIRS),
    )
    model = cut(_factored(model).drop(*(f"v{i}{j}" for i, j in _PAIRS)))
    dev = {i: F.col(_X[i]) - F.col(f"c{i}") for i in range(len(_X))}
    sums = {"n": F.count("*"), **{f"s{i}": F.sum(dev[i]) for i in dev}, **{f"p{i}{j}": F.sum(dev[i] * dev[j]) for i, j in _PAIRS}}
    upto = Window.partitionBy("grp").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    mean = {i: F.col(f"s{i}") / F.col("n") for i in dev}
    cov = {(i, j): CONSISTENT * (F.col(f"p{i}{j}") / F.col("n") - mean[i] * mean[j]) for i, j in _PAIRS}
    for _ in range(STEPS):
        dealt = model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        near = _with_distance(fitted.join(dealt, ["grp", "salt"])).withColumn("bin", F.least(F.floor(16 * F.log2(F.col("d2") + 1)), F.lit(1000)))
        table = near.groupBy("grp", "salt", "bin").agg(*(v.alias(k) for k, v in sums.items()))
        table = table.groupBy("grp", "bin").agg(*(F.sum(k).alias(k) for k in sums))
        table = table.withColumn("all", F.sum("n").over(Window.partitionBy("grp")))
        table = table.select("grp", "all", "bin", *(F.sum(k).over(upto).alias(k) for k in sums)).where(F.col("n") >= SHARE * F.col("all"))
        table = table.groupBy("grp").agg(*(F.min_by(k, "bin").alias(k) for k in sums))
        size = sum((F.log(f"l{i}{i}") for i in dev), F.lit(0.0))
        centre = model.select("grp", "salts", size.alias("before"), *(f"c{i}" for i in dev)).join(table, "grp")
        moved = centre.select("grp", "salts", "before", *((F.col(f"c{i}") + mean[i]).alias(f"c{i}") for i in dev), *(cov[i, j].alias(f"v{i}{j}") for i, j in _PAIRS))
        moved = cut(_factored(moved).withColumn("shrunk", F.col("before") - size).drop(*(f"v{i}{j}" for i, j in _PAIRS), "before"))
        drop(model)
        model = moved.drop("shrunk")
        model.cut_path = moved.cut_path
        if not (moved.agg(F.max(F.abs("shrunk"))).first()[0] or 0) > SETTLED:
            break
    dealt = model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    out = _with_distance(rows.join(dealt, ["grp", "salt"], "left"))
    return out.drop("grp", "salt", "salts", "_fit", *(f"y{i}" for i in range(len(_X))), *(f"c{i}" for i in range(len(_X))), *(f"l{i}{j}" for i, j in _PAIRS))


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", most: float = CUT
) -> DataFrame:
    """``(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, d2)`` for each row.

    A text of fewer than 50 words, or with more than half its words in repeated
    3-word windows, fails the base rule (null and empty texts too). Of the
    others, those whose squared distance from their language's and source's
    estimate exceeds ``most`` are rejected. Null languages and sources are groups
    of their own; repeated rows are judged alike, and each gets its row, null and
    repeated ids too; very long texts are counted whole; an empty table gives no
    rows. Columns other than the four named are not read, whatever their names.
    Rows at the cut itself are kept.
    """
    named = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source")
    )
    rows = cut(base_counts(named).drop("text"))
    rows = rows.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
    rows = rows.withColumns({x: F.expr(e).cast("double") for x, (e, _) in STATS.items()})
    out = outlier_distances(rows, ["lang", "source"], ~F.col("base_failed"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= most, F.lit(True))
    return out.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", kept.alias("kept"), F.when(~F.col("base_failed"), F.round("d2", 6)).alias("d2"),
    )
