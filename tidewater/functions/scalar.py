"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats that ``parse`` tries in turn.
FORMATS = ("yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")


def parse(text: Column) -> Column:
    """A timestamp from any of FORMATS; blank or unknown text is null; a Z is UTC."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in FORMATS])


def format_millis(ms: Column, pattern: str) -> Column:
    return F.date_format(F.timestamp_millis(ms), pattern)


def plus_days(ts: Column, days: int) -> Column:
    return ts + F.expr(f"INTERVAL {int(days)} DAYS")


def zero_date(ts: Column) -> Column:
    return F.date_trunc("DAY", ts)


def month0(ts: Column) -> Column:
    """Months from 0."""
    return F.month(ts) - 1


def rounded_millis(ts: Column) -> Column:
    """Epoch milliseconds, the nearest; halves away from zero."""
    us = F.unix_micros(ts)
    return F.call_function("div", us + F.when(us < 0, -500).otherwise(500), F.lit(1000))


def days_between(start: Column, end: Column) -> Column:
    """Whole days of 24 hours between two instants, towards zero."""
    diff = F.unix_millis(end) - F.unix_millis(start)
    return (F.signum(diff) * F.floor(F.abs(diff) / 86_400_000)).cast("long")


def iso_seconds(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def pad_code(value: Column, width: int) -> Column:
    """Zeros in front up to ``width``; longer values stay whole."""
    text = value.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def local_to_millis(ts: Column, zone: str = "Asia/Shanghai") -> Column:
    """Epoch milliseconds of a wall-clock time in ``zone``."""
    return F.unix_millis(F.to_utc_timestamp(ts, zone))


def random_digits(n: int, seed: Column, salt: int = 0) -> Column:
    """``n`` digits made from ``seed``: the same seed gives the same text again."""
    return _random_text("0123456789", n, seed, salt)


def random_letters(seed: Column, n: int = 11, salt: int = 0) -> Column:
    """``n`` letters of both cases made from ``seed``."""
    return _random_text("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", n, seed, salt)


def _random_text(alphabet: str, n: int, seed: Column, salt: int) -> Column:
    pick = lambda k: F.substr(F.lit(alphabet), (F.pmod(F.xxhash64(F.lit(salt), seed, k), F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), pick), "") if n > 0 else F.lit("")


def basic_auth(user: Column, password: Column) -> Column:
    return F.concat(F.lit("Basic "), F.base64(F.concat_ws(":", user, password).cast("binary")))


def day_before(ts: Column) -> Column:
    """The day before, as ``yyyy-MM-dd``."""
    return F.date_format(F.date_sub(F.to_date(ts), 1), "yyyy-MM-dd")


def prefixed(value: Column) -> Column:
    """``value`` behind the number of the task that handles it and the time it is handled."""
    return F.concat_ws("|", F.spark_partition_id().cast("string"), F.unix_millis(F.current_timestamp()).cast("string"), value.cast("string"))
