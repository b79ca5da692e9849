"""Time rules: naive timestamps throughout, bounds resolved on the driver."""

from __future__ import annotations

from datetime import UTC, datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT_SECONDS = {"seconds": 1.0, "minutes": 60.0, "hours": 3600.0, "days": 86400.0}
BUCKETS = {"D": "DAY", "W": "WEEK", "MS": "MONTH", "H": "HOUR"}


def as_timestamp(df: DataFrame, name: str) -> Column:
    """A naive timestamp: text is read from its first 19 characters, so an offset suffix is dropped; bad text is null."""
    kind = dict(df.dtypes)[name]
    if kind == "timestamp_ntz":
        return F.col(name)
    if kind in ("timestamp", "date"):
        return F.col(name).cast("timestamp_ntz")
    return F.col(name).substr(1, 19).try_cast("timestamp_ntz")


def bound(text: str, timezone: str = "UTC") -> datetime:
    """An ISO bound as naive UTC; a naive one is taken in the given time zone."""
    at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    at = at if at.tzinfo else at.replace(tzinfo=ZoneInfo(timezone))
    return at.astimezone(UTC).replace(tzinfo=None)


def literal(at: datetime) -> Column:
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds, towards zero."""
    return F.timestamp_diff("SECOND", start, end)


def bucket(at: Column, frequency: str) -> Column:
    return F.date_trunc(BUCKETS[frequency], at).cast("timestamp_ntz")


def duration_seconds(text: Column) -> Column:
    """Seconds of texts like 7d, 24h, 60m, 3600s or plain numbers; null if it is none of these."""
    clean = F.lower(F.trim(text))
    number = F.regexp_extract(clean, r"^([0-9.]+)[dhms]?$", 1).try_cast("double")
    unit = F.regexp_extract(clean, r"([dhms])$", 1)
    factor = F.when(unit == "d", 86400.0).when(unit == "h", 3600.0).when(unit == "m", 60.0).otherwise(1.0)
    return number * factor


def convert(at: Column, source: str, target: str = "UTC") -> Column:
    return F.convert_timezone(F.lit(source), F.lit(target), at)
