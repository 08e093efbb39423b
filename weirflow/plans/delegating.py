"""The choice between reading everything and reading what is new, by the state of earlier reads."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def oldest_cursor(state: DataFrame | None, cursor: str) -> datetime | None:
    """The smallest cursor of a state (a row a partition); None without state or where any partition has none."""
    if state is None:
        return None
    found = state.agg(F.min(cursor).alias("least"), F.count(F.when(F.col(cursor).isNull(), 1)).alias("missing")).first()
    return None if found.missing else found.least


def delegated(state: DataFrame | None, cursor: str, full: Callable[[], DataFrame], incremental: Callable[[datetime], DataFrame], retention: timedelta | None = None, now: datetime | None = None) -> tuple[DataFrame, str]:
    """What to read, and which of both it is: ``full`` or ``incremental``.

    Without a state everything is read. So it is where the state is older than ``retention``, the time for which the source
    still tells what has changed: records that changed before that would be lost. Else ``incremental``
    is given the oldest cursor, and its filter reaches the scan.
    """
    oldest = oldest_cursor(state, cursor)
    if oldest is None or retention is not None and oldest < (now or datetime.now(oldest.tzinfo)) - retention:
        return full(), "full"
    return incremental(oldest), "incremental"
