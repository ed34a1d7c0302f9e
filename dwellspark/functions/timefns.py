"""Epoch milliseconds, buckets, local days. Long columns in, longs or strings out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def epoch_ms(ts) -> Column:
    """Milliseconds of a timestamp, rounded down."""
    return F.floor(F.unix_micros(_c(ts).cast("timestamp")) / 1000).cast("long")


def bucket_start(ms, size: int, origin=0) -> Column:
    """Start of the fixed window that holds ``ms``, on a grid through ``origin``."""
    origin = F.lit(origin) if isinstance(origin, int) else origin
    return _c(ms) - F.pmod(_c(ms) - origin, F.lit(size))


def iso_utc(ms) -> Column:
    return F.date_format(F.timestamp_millis(_c(ms)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_local(ms, tz_minutes) -> Column:
    """Wall clock at an offset of minutes east, without a zone."""
    return F.date_format(F.timestamp_millis(_c(ms) + _c(tz_minutes).cast("long") * 60_000), "yyyy-MM-dd'T'HH:mm:ss.SSS")


def local_day_to_utc_ms(day, tz_minutes) -> Column:
    """Epoch milliseconds at which a local day starts; days have 24 hours."""
    return F.unix_date(F.to_date(_c(day))).cast("long") * DAY_MS - _c(tz_minutes).cast("long") * 60_000


def week_days(end_day) -> Column:
    """The seven dates that end with ``end_day``."""
    d = F.to_date(_c(end_day))
    return F.sequence(F.date_sub(d, 6), d)


def day_range_ms(first_day, last_day) -> tuple[Column, Column]:
    """[first day's UTC midnight, the midnight after the last day)."""
    zero = F.lit(0)
    return local_day_to_utc_ms(first_day, zero), local_day_to_utc_ms(last_day, zero) + DAY_MS


def date_key(ms, tz_minutes) -> Column:
    return F.date_format(F.timestamp_millis(_c(ms) + _c(tz_minutes).cast("long") * 60_000), "yyyyMMdd")


def parses_as_time(text) -> Column:
    return F.try_to_timestamp(_c(text)).isNotNull()
