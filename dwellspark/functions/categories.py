"""App categories: ordered rules, the first that matches wins."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import exists

#: fixed values: patterns in order, with their category
RULES = [
    ("code|vscode|vs code|visual studio code", "code"),
    ("intellij|pycharm|webstorm|goland|clion|rider|datagrip|rubymine", "code"),
    ("vim|nvim|neovim|nano|emacs|sublime text|atom|zed", "code"),
    ("terminal|iterm|cmd|powershell|bash|zsh|wsl|alacritty|kitty|wezterm|hyper", "code"),
    ("xcode|android studio|unity|unreal engine|godot", "code"),
    ("postman|insomnia|dbeaver|tableplus|datagrip|pgadmin|sequel pro", "code"),
    ("github desktop|sourcetree|fork|gitkraken|tower", "code"),
    ("docker desktop|lens|k9s", "code"),
    ("figma|sketch|zeplin", "code"),
    ("notion|obsidian|roam research|logseq|bear|craft", "docs"),
    ("microsoft word|google docs|pages|libreoffice writer", "docs"),
    ("acrobat|pdf|preview|foxit|sumatra", "docs"),
    ("microsoft excel|google sheets|numbers|libreoffice calc", "docs"),
    ("microsoft powerpoint|google slides|keynote|libreoffice impress", "docs"),
    ("confluence|jira|linear|trello|asana|monday|clickup|basecamp", "docs"),
    ("evernote|onenote|simplenote", "docs"),
    ("youtube|netflix|twitch|hulu|disney|prime video|hbo|apple tv", "video"),
    ("vlc|mpv|iina|quicktime|windows media player|kmplayer|potplayer", "video"),
    ("plex|kodi|infuse|jellyfin|emby", "video"),
    ("zoom|teams|meet|webex|skype", "video"),
    (r"twitter|x\.com", "social"),
    ("instagram|facebook|tiktok|pinterest|tumblr|snapchat", "social"),
    ("reddit|hackernews|hacker news", "social"),
    ("discord", "social"),
    ("slack|microsoft teams|telegram|whatsapp|line|wechat|signal|kakaotalk", "social"),
    ("gmail|outlook|mail|thunderbird|apple mail|spark mail", "social"),
    ("steam|league of legends|lol client|valorant", "game"),
    ("overwatch|fortnite|minecraft|roblox|apex legends", "game"),
    (r"epic games|battle\.net|origin|ea app|gog galaxy|xbox app", "game"),
    ("hearthstone|starcraft|diablo|world of warcraft", "game"),
]


def categorize(app, custom: list[tuple[str, str]] | None = None) -> Column:
    """Category of an app name; custom rules come first, null and '' are other."""
    app = F.col(app) if isinstance(app, str) else app
    out = F.when(F.coalesce(app, F.lit("")) == "", F.lit("other"))
    for pattern, category in [*(custom or []), *RULES]:
        out = out.when(app.rlike(f"(?i){pattern}"), F.lit(category))
    return out.otherwise(F.lit("other"))


def load_category_rules(spark: SparkSession, path: str | None) -> DataFrame:
    """(rule_no, pattern, category): a JSON array's rules in front of the built-in
    ones. A file that isn't there (with a warning), or what isn't a list of rules with
    both parts, gives the built-in ones alone."""
    built_in = spark.createDataFrame([(i, p, c) for i, (p, c) in enumerate(RULES)], "rule_no long, pattern string, category string")
    if path and not exists(spark, path):
        warnings.warn(f"no category rules at {path}: built-in ones are used", stacklevel=2)
    if not path or not exists(spark, path):
        return built_in
    raw = spark.read.text(path, wholetext=True)
    custom = raw.select(F.posexplode(F.from_json("value", "array<struct<pattern:string,category:string>>")).alias("i", "r"))
    custom = custom.select((F.col("i") - 1_000_000).cast("long").alias("rule_no"), "r.pattern", "r.category")
    return custom.where("pattern IS NOT NULL AND category IS NOT NULL").unionByName(built_in)


_FOLD = {c: c + 32 for c in range(0x41, 0x5B)}
#: characters of the patterns that one automaton is made of
AT_ONCE = 16_000_000
#: a pattern of plain alternatives: no character that means something but | and \\. (a dot)
_PLAIN = r"^(?:[^\\\[\](){}.*+?^$|]|\\[.\-+() ])+(?:\|(?:[^\\\[\](){}.*+?^$|]|\\[.\-+() ])+)*$"


def _plain_matches(names: DataFrame, rules: list[tuple[int, str]]) -> DataFrame:
    """(_app, rule_no): the first rule of each name, by one pass over it for all rules."""
    first: dict[str, int] = {}
    for no, pattern in rules:
        for part in pattern.split("|"):
            part = part.replace("\\", "").translate(_FOLD)
            first[part] = min(no, first.get(part, no))
    sent = names.sparkSession.sparkContext.broadcast(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for word, no in sent.value.items():
            automaton.add_word(word, no)
        automaton.make_automaton()
        for b in batches:
            apps, hits = [], []
            for app in b.column(0).to_pylist():
                best = min((no for _, no in automaton.iter(app.translate(_FOLD))), default=None)
                if best is not None:
                    apps.append(app)
                    hits.append(best)
            yield pa.RecordBatch.from_arrays([pa.array(apps, pa.string()), pa.array(hits, pa.int64())], ["_app", "rule_no"])

    return names.mapInArrow(run, "_app string, rule_no long")


def first_rules(names: DataFrame, rules: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """(_app, rule_no, category) of the first rule (in the order of rule_no) that each
    name ``_app`` fits; names that fit none are left out.

    Rules that are plain alternatives become one automaton, which looks at a name once
    however many there are; tables of more than ``at_once`` characters become
    several, one after the other. Other rules are regular expressions and are tried on
    each name. Letters A-Z count as a-z. Names are not null.
    """
    plain = F.col("pattern").rlike(_PLAIN)
    out = names.join(rules.where(~plain).select("rule_no", "pattern"), F.expr("_app rlike concat('(?i)', pattern)")).select("_app", "rule_no")
    part, size = [], 0
    for r in rules.where(plain).select(F.col("rule_no").cast("long"), "pattern").toLocalIterator():
        part.append((r[0], r[1]))
        size += len(r[1])
        if size > at_once:
            out, part, size = out.unionByName(_plain_matches(names, part)), [], 0
    if part:
        out = out.unionByName(_plain_matches(names, part))
    best = out.groupBy("_app").agg(F.min("rule_no").alias("rule_no"))
    return best.join(rules.groupBy("rule_no").agg(F.min("category").alias("category")), "rule_no")


def with_category(df: DataFrame, app_col: str = "app_name", rules: DataFrame | None = None) -> DataFrame:
    """``df`` with ``category``. With a rule table, each different app name is
    matched once against it and joined back; otherwise it is one expression."""
    if rules is None:
        return df.withColumn("category", categorize(app_col))
    names = df.select(F.col(app_col).alias("_app")).where("_app <> ''").distinct()
    best = first_rules(names, rules).drop("rule_no")
    return df.join(best, df[app_col] == best["_app"], "left").drop("_app").withColumn("category", F.coalesce("category", F.lit("other")))
