"""Day keys, visibility instants and buckets. All instants are UTC."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col

# Reporting zone, and market close of a trading day as a UTC offset (15:00 at +08:00).
REPORT_ZONE = "Asia/Shanghai"
CLOSE_OFFSET = dt.timedelta(hours=7)


def instant(value: dt.datetime | str | Column) -> Column:
    """Literal or column as a UTC timestamp."""
    if isinstance(value, Column):
        return value.cast("timestamp")
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    if value.tzinfo is None:
        value = value.replace(tzinfo=dt.timezone.utc)
    return F.lit(value)


def visible_at(day: Column | str, visible: Column | str) -> Column:
    """Instant from which a bar may be read: the stored one, else the day's close."""
    start = col(day).cast("timestamp")
    return F.coalesce(col(visible), start + F.expr("INTERVAL '7' HOUR"))


def local_day(ts: Column | str, zone: str = REPORT_ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(col(ts), zone))


def local_midnight(day: Column, zone: str = REPORT_ZONE) -> Column:
    """UTC instant at which a local day begins."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def bucket(ts: Column | str, minutes: int, zone: str = REPORT_ZONE) -> Column:
    """Start (in local wall time) of the N-minute bucket holding an instant."""
    step = minutes * 60
    seconds = F.unix_seconds(F.from_utc_timestamp(col(ts), zone))
    return F.timestamp_seconds(seconds - seconds % step)


def parse_local_ts(c: Column | str, zone: str = REPORT_ZONE) -> Column:
    """Local 'YYYY-MM-DD[ HH:mm[:ss]]' to UTC; text carrying an offset keeps it; impossible dates give null."""
    text = F.trim(col(c))
    pattern_day, pattern_minute, pattern_second = (
        r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}$", r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}$")
    flat = F.regexp_replace(text, "T", " ")
    local = (
        F.when(text.rlike(pattern_day), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
        .when(text.rlike(pattern_minute), F.try_to_timestamp(flat, F.lit("yyyy-MM-dd HH:mm")))
        .when(text.rlike(pattern_second), F.try_to_timestamp(flat, F.lit("yyyy-MM-dd HH:mm:ss")))
    )
    with_offset = F.when(
        text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"), text.try_cast("timestamp"))
    return F.coalesce(F.to_utc_timestamp(local, zone), with_offset)
