"""Event-time column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Feed timestamp formats (with and without milliseconds) and the
# day format of result tables.
TS_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSSX"
TS_SECONDS = "yyyy-MM-dd'T'HH:mm:ssX"
DAY = "yyyy-MM-dd"


def event_time(x) -> Column:
    """Parse an ISO-8601 UTC string to its UTC wall-clock time (a timestamp
    without zone, like the events table's ``ts``, so no reader re-zones it);
    NULL when it matches neither format. Needs the UTC session zone that
    ``session.configure`` pins."""
    c = F.col(x) if isinstance(x, str) else x
    t = F.coalesce(F.try_to_timestamp(c, F.lit(TS_MILLIS)), F.try_to_timestamp(c, F.lit(TS_SECONDS)))
    return t.cast("timestamp_ntz")


def event_or_ingest_time(x, ingest) -> Column:
    """Event time, or the ingest time of the record where it has none: an undated or
    unreadable event is dated when it is indexed, so time filters keep it."""
    i = F.col(ingest) if isinstance(ingest, str) else ingest
    return F.coalesce(event_time(x), i.cast("timestamp_ntz"))


def day(ts) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(c, DAY)


def now_iso() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
