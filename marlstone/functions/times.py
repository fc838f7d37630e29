"""Times as whole microseconds, for timestamps with and without a zone alike, and declared epochs as UTC text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def micros(rows: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a column that is a timestamp, a timestamp without zone (read as UTC), text or whole seconds."""
    kind = dict(rows.dtypes)[name]
    if kind == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, `{name}`)")
    if kind in ("timestamp", "date"):
        return F.unix_micros(F.col(name).cast("timestamp"))
    if kind == "string":
        return F.unix_micros(F.col(name).try_cast("timestamp"))
    return F.floor(F.col(name) * 1_000_000).cast("long")


def floored(rows: DataFrame, name: str, seconds: int) -> Column:
    """The start of a time's period of so many seconds, without zone if the column is."""
    width = seconds * 1_000_000
    if dict(rows.dtypes)[name] == "timestamp_ntz":
        return F.expr(f"timestampadd(MICROSECOND, timestampdiff(MICROSECOND, {_EPOCH}, `{name}`) - pmod(timestampdiff(MICROSECOND, {_EPOCH}, `{name}`), {width}L), {_EPOCH})")
    at = micros(rows, name)
    return F.timestamp_micros(at - F.pmod(at, F.lit(width)))


def utc_text(epoch: Column, unit: str) -> Column:
    """An epoch in seconds, milliseconds or microseconds as ISO text with microseconds and Z."""
    per = {"s": 1_000_000, "ms": 1_000, "us": 1}[unit]
    return F.concat(F.date_format(F.timestamp_micros((epoch * per).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
