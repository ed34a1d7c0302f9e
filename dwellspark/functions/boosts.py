"""Boosts of a semantic score: by app, and by keywords of the title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: what an app's name holds, what the title must hold too, the boost; the first that fits counts
APP_BOOSTS = [
    (("vscode", "visual studio code"), "", 0.15),
    (("intellij",), "", 0.15),
    (("terminal", "powershell", "cmd"), "", 0.12),
    (("chrome",), "leetcode", 0.20),
    (("youtube",), "", -0.30),
    (("netflix",), "", -0.40),
]
#: fixed values: keywords of a title and what any of them gives, once
KEYWORD_BOOSTS = [
    (("leetcode", "pull request", "jira", "design doc", "sql"), 0.10),
    (("youtube", "shorts", "netflix", "tiktok", "instagram"), -0.15),
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def app_rule_boost(app, text) -> Column:
    """The boost of the first rule that an app's name (and the title) fits, else 0."""
    a, t = F.lower(F.coalesce(_c(app), F.lit(""))), F.lower(F.coalesce(_c(text), F.lit("")))
    out = F.when(F.lit(False), F.lit(0.0))
    for names, also, boost in APP_BOOSTS:
        out = out.when(_any(a, names) & t.contains(also), F.lit(boost))
    return out.otherwise(F.lit(0.0))


def keyword_boost(text) -> Column:
    """Sum of what each group of keywords gives, each once however many are there."""
    t, out = F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(0.0)
    for words, boost in KEYWORD_BOOSTS:
        out = out + F.when(_any(t, words), F.lit(boost)).otherwise(F.lit(0.0))
    return out


def _strongest(boost: Column) -> Column:
    """The boost furthest from 0, of equal ones the positive; null where there is none."""
    return F.when(F.max(boost) >= -F.min(boost), F.max(boost)).otherwise(F.min(boost))


def _words(c) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"))


def strongest_terms(table: DataFrame) -> DataFrame:
    """(_term, _n, _for, boost): of a boost table's rows with the same words and app the
    one that counts; rows without a word or a boost are left out."""
    term = table.select(F.array_join(_words("term"), " ").alias("_term"), F.size(_words("term")).alias("_n"), F.lower("app_name").alias("_for"), F.col("boost").cast("double").alias("boost"))
    return term.where("_n > 0 AND boost IS NOT NULL").groupBy("_term", "_n", "_for").agg(_strongest(F.col("boost")).alias("boost"))


def with_table_boost(df: DataFrame, table: DataFrame, app_col: str = "app_name", text_col: str = "text") -> DataFrame:
    """``df`` with ``boost`` by a table ``(term, app_name, boost)`` of any size.

    A term is one word or several, and stands in a text where its words follow each
    other; words are runs of letters and digits, in lower case. A row with an app
    counts for that app only. Of the rows that fit, those with the text's app come
    before those for every app; the strongest of them counts, of equal ones the
    positive. Different (app, text) pairs are cut into runs of words once and
    joined by term and app with the strongest row of each, so a run meets two rows
    at most, however often a term stands in the table.
    """
    term = strongest_terms(table)
    sizes = [r[0] for r in term.select("_n").distinct().orderBy("_n").collect()]  # lengths of terms: a handful
    pairs = df.select(F.col(app_col).alias("_app"), F.col(text_col).alias("_text")).distinct().withColumn("_w", _words("_text"))
    size, none = F.size("_w"), F.array().cast("array<int>")
    runs = [F.transform(F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(none), _run_of(n)) for n in sizes]
    if not runs:
        return df.withColumn("boost", F.lit(0.0))
    found = pairs.select("_app", "_text", F.explode(F.array_distinct(F.concat(*runs))).alias("_run"))
    found = found.withColumn("_own", F.explode(F.array_distinct(F.array(F.lit(None).cast("string"), F.lower("_app")))))
    fits = found.join(term, (F.col("_run") == F.col("_term")) & F.col("_own").eqNullSafe(F.col("_for")))
    own, every = (_strongest(F.when(which, F.col("boost"))) for which in (F.col("_for").isNotNull(), F.col("_for").isNull()))
    best = fits.groupBy("_app", "_text").agg(F.coalesce(own, every).alias("boost"))
    on = df[app_col].eqNullSafe(best["_app"]) & df[text_col].eqNullSafe(best["_text"])
    return df.join(best, on, "left").drop("_app", "_text").withColumn("boost", F.coalesce("boost", F.lit(0.0)))


def _run_of(n: int):
    return lambda i: F.array_join(F.slice("_w", i, n), " ")
