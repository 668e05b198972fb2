"""Time helpers (C23, C36): epoch milliseconds without any session time zone in between."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_ms(ts: Column | str) -> Column:
    """Milliseconds since 1970 of a zone-less or UTC timestamp."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    zero = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return F.timestamp_diff("MILLISECOND", zero, ts.cast("timestamp_ntz"))


def epoch_us(ts: Column | str) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    zero = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return F.timestamp_diff("MICROSECOND", zero, ts.cast("timestamp_ntz"))


def ms_between(start: Column, end: Column, digits: int = 1) -> Column:
    """Latency in ms between two epoch-ms columns, rounded."""
    return F.round((end - start).cast("double"), digits)


def trigger_to_capture_ms(triggered: Column, captured: Column) -> Column:
    """Trigger-to-capture latency, -1 when either side is unknown."""
    return F.coalesce(ms_between(triggered, captured), F.lit(-1.0))


def parse_iso(text: Column) -> Column:
    """Local ISO text with blank or T separator, NULL when it does not parse."""
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS")),
    )


def iso_ms(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS")


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd")


def end_of_bound(text: str) -> str:
    """A date-only upper bound means the end of that day."""
    return f"{text} 23:59:59.999999" if len(text) == 10 else text
