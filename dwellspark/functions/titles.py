"""Window titles: taking private parts out, and normal forms for matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: white space, wider than Java's \s
S = r"\s\x0b   -     　﻿"
_A = "0-9A-Za-z_"
_NOT_AFTER, _NOT_BEFORE = f"(?<![{_A}])", f"(?![{_A}])"
_EDGE = f"(?:(?<![{_A}])(?=[{_A}])|(?<=[{_A}])(?![{_A}]))"

#: fixed values: top-level names of hints, browser names cut from the end of a
#: title, names dropped when they stand alone, and leading page names
HINT_NAMES = "com|org|net|io|dev|ai|app|co|edu|gov"
SUFFIXES = "youtube|google chrome|chrome|microsoft edge|edge|mozilla firefox|firefox|safari|brave|opera"
PLATFORMS = ["chrome", "edge", "firefox", "safari", "brave", "opera"]
LEADING = "watch later|home|for you|trending|subscriptions"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_all(x: Column) -> Column:
    return F.regexp_replace(x, f"^[{S}]+|[{S}]+$", "")


def sanitize_title(title, max_len: int = 512) -> Column:
    """URLs become their host, mail addresses lose their name, paths become their
    last part (those that end in a separator stay), long titles are cut. Null is ''."""
    seg, unix = rf'[^\\<>:"/|?*\r\n{S}]', rf'[^{S}/\\:*?"<>|]'
    t = F.coalesce(_c(title), F.lit(""))
    # fixed values: what is private in a title, and what is left of it
    t = F.regexp_replace(t, rf'(?i)https?://([^/{S}?#"<>]+)[^{S}"<>]*', "$1")
    t = F.regexp_replace(t, r"[a-zA-Z0-9._%+\-]+@([a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})", "***@$1")
    t = F.regexp_replace(t, rf"[A-Za-z]:\\(?:{seg}+\\)*+({seg}+)", "$1")
    t = F.regexp_replace(t, rf"/(?:{unix}+/)++({unix}+)", "$1")
    return F.substring(t, 1, max_len)


def clean_noise(t: Column) -> Column:
    """Drop counters, bullets, tags, clock times, view counts and long ids."""
    # fixed values: the patterns of noise
    t = F.regexp_replace(t, rf"^[(\[][0-9]+[)\]][{S}]*", "")
    t = F.regexp_replace(t, rf"^[•●·{S}]+|[•●·{S}]+$", "")
    t = F.regexp_replace(t, rf"[(\[][{S}]*[0-9]+[{S}]*[)\]]", " ")
    t = F.regexp_replace(t, rf"[(\[][{S}]*(?:4k|8k|hd|uhd|live|new)[{S}]*[)\]]", " ")
    t = F.regexp_replace(t, rf"{_NOT_AFTER}[0-9]{{1,2}}:[0-9]{{2}}(?::[0-9]{{2}})?{_NOT_BEFORE}", " ")
    t = F.regexp_replace(t, rf"{_NOT_AFTER}[0-9]+(?:[.,][0-9]+)?[{S}]*[kmb]?[{S}]*(?:views?|watching|watchers?){_NOT_BEFORE}", " ")
    long_id = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9a-f]{16,}|[0-9]{10,}"
    t = F.regexp_replace(t, rf"(?i){_NOT_AFTER}(?:{long_id}){_NOT_BEFORE}", " ")
    return trim_all(F.regexp_replace(t, f"[{S}]+", " "))


def strip_app_suffix(t: Column) -> Column:
    return trim_all(F.regexp_replace(t, rf"(?i)(?:[{S}]*-[{S}]*(?:{SUFFIXES})[{S}]*)+$", ""))


def strip_leading_noise(t: Column) -> Column:
    return trim_all(F.regexp_replace(t, rf"(?i)^(?:{LEADING})[{S}]*-[{S}]*", ""))


def domain_hint(title) -> Column:
    """First host-like name in the title, or null."""
    raw = trim_all(F.lower(F.coalesce(_c(title), F.lit(""))))
    return F.nullif(F.regexp_extract(raw, rf"{_EDGE}([a-z0-9-]+\.(?:{HINT_NAMES})){_NOT_BEFORE}", 1), F.lit(""))


def normalize_title(app, title, max_len: int = 180, app_prefix: bool = False) -> Column:
    """Text that a title is matched by; the app's name where nothing is left.
    ``app_prefix`` puts the app's name in front."""
    name = trim_all(F.lower(F.coalesce(_c(app), F.lit(""))))
    t = strip_leading_noise(strip_app_suffix(clean_noise(trim_all(F.lower(F.coalesce(_c(title), F.lit("")))))))
    parts = F.filter(F.split(t, f"[{S}]*-[{S}]*"), lambda p: (p != "") & ~trim_all(p).isin(PLATFORMS))
    t = trim_all(F.regexp_replace(F.array_join(parts, " "), f"[{S}]+", " "))
    if app_prefix:
        t = F.when((t != "") & (name != ""), F.concat_ws(" ", name, t)).otherwise(t)
    return F.substring(F.when(t != "", t).otherwise(name), 1, max_len)


def normalize_goal(text) -> Column:
    return F.lower(F.regexp_replace(trim_all(F.coalesce(_c(text), F.lit(""))), f"[{S}]+", " "))


def goal_display(todo, hint) -> Column:
    shown = trim_all(F.coalesce(_c(hint), F.lit("")))
    return F.when(shown != "", F.concat(_c(todo), F.lit(" [app: "), shown, F.lit("]"))).otherwise(_c(todo))


def app_boost(app, hint, boost: float = 0.15) -> Column:
    """``boost`` if the app's name holds the hint or the hint the name, else 0."""
    a, h = F.lower(_c(app)), F.lower(_c(hint))
    return F.when((a != "") & (h != "") & (a.contains(h) | h.contains(a)), F.lit(boost)).otherwise(F.lit(0.0))


def resolve_app_name(owner_name, title) -> Column:
    """The owner's name, else the sanitised title, else 'Unknown'."""
    return F.coalesce(F.nullif(trim_all(_c(owner_name)), F.lit("")), F.nullif(sanitize_title(title), F.lit("")), F.lit("Unknown"))


def rotation_index(name) -> Column:
    """Number before the ending of a rotated log file, 0 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(_c(name), r"\.([0-9]+)\.jsonl$", 1), F.lit("")).cast("int"), F.lit(0))


def host_part(host) -> Column:
    clean = F.substring(F.regexp_replace(F.coalesce(_c(host), F.lit("")), "[^a-zA-Z0-9]", ""), 1, 32)
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("host"))


def session_id(host, start_ms) -> Column:
    """host-epoch-8hex; the last part is a hash of the others, so re-runs agree."""
    head = F.concat_ws("-", host_part(host), _c(start_ms).cast("string"))
    return F.concat_ws("-", head, F.substring(F.sha2(head, 256), 1, 8))


def event_id(*parts) -> Column:
    """A UUID-shaped id from what identifies the event."""
    h = F.md5(F.concat_ws("|", *(_c(p).cast("string") for p in parts)))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in cuts))


def fmt_duration(ms) -> Column:
    """``Xh Ym``, ``Xm Ys`` or ``Xs``; ``0s`` for nothing or less."""
    s = F.floor(_c(ms) / 1000)
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    text = lambda *p: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in p))
    long, middle = text(h.cast("string"), "h ", m.cast("string"), "m"), text(m.cast("string"), "m ", r.cast("string"), "s")
    return F.when(F.coalesce(_c(ms), F.lit(0)) <= 0, "0s").when(h > 0, long).when(m > 0, middle).otherwise(text(r.cast("string"), "s"))


def bar(ms, total, width: int = 20) -> Column:
    n = F.when(_c(total) > 0, F.floor(_c(ms) / _c(total) * width + 0.5)).otherwise(0).cast("int")
    return F.when(_c(total) > 0, F.rpad(F.repeat(F.lit("█"), n), width, "░")).otherwise(" " * width)
