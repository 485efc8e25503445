"""Time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rfc3339(c: Column) -> Column:
    """A full moment with its zone, else null."""
    good = c.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")
    return F.when(good, F.try_to_timestamp(F.regexp_replace(F.upper(c), " ", "T")))


def provider_utc(c: Column) -> Column:
    """Moments without a zone are UTC; seconds may be missing."""
    good = c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?)?$")
    return F.when(good, F.try_to_timestamp(F.replace(c, F.lit("T"), F.lit(" ")))).otherwise(rfc3339(c))


def rss_time(c: Column) -> Column:
    """RFC 822 with or without its weekday, else RFC 3339."""
    day = F.regexp_replace(F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", ""), r"(GMT|UTC|UT|Z)$", "+0000")
    return F.coalesce(F.try_to_timestamp(day, F.lit("d MMM yyyy HH:mm:ss Z")), rfc3339(F.trim(c)))


def epoch_ms(c: Column) -> Column:
    return F.timestamp_millis(F.when(c.between(0, 253402300799999), c))


def window_state(start: Column, stop: Column, at: Column) -> Column:
    return F.when(start.isNull() | stop.isNull() | (stop <= start), "invalid").when(at >= stop, "expired").when(at < start, "future").otherwise("current")


def seconds_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / 1e6


def age_label(at: Column, now: Column) -> Column:
    s = F.greatest(F.floor(seconds_between(at, now)), F.lit(0))
    say = lambda n, u: F.concat(F.floor(s / n).cast("string"), F.lit(f"{u} ago"))
    return F.when(at.isNull(), "age unknown").when(s < 60, say(1, "s")).when(s < 3600, say(60, "m")).when(s < 86400, say(3600, "h")).otherwise(say(86400, "d"))


def utc_label(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss 'UTC'"), F.lit("Not reported"))


def expiration_state(status: Column, expires: Column, now: Column) -> Column:
    return F.when(status == "cancelled", "Cancelled").when(status == "ended", "Ended").when(expires <= now, "Expired").otherwise("Current")


def quiet(at: Column, start: int, stop: int) -> Column:
    """Whether the minute of the day lies in a window that may wrap round midnight; equal bounds are none."""
    minute = F.hour(at) * 60 + F.minute(at)
    if start == stop:
        return F.lit(False)
    return (minute >= start) & (minute < stop) if start < stop else (minute >= start) | (minute < stop)
