"""What to do with a response, and how long to wait, as columns of request logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Statuses that are tried again, that are rate limits, and that mean a wrong configuration.
RETRY, LIMITED, CONFIG = (408, 500, 502, 503, 504), (429,), (401, 403, 404, 405)


def action(status: Column, ignore: tuple[int, ...] = ()) -> Column:
    """success, ignore, rate_limited, retry or fail."""
    return (
        F.when(status.isin(list(ignore) or [-1]), "ignore").when(status.between(200, 399), "success").when(status.isin(list(LIMITED)), "rate_limited")
        .when(status.isin(list(RETRY)) | (status >= 500), "retry").otherwise("fail")
    )


def exponential_wait(attempt: Column, factor: float = 5.0) -> Column:
    """Seconds before the next attempt."""
    return F.lit(factor) * F.pow(F.lit(2.0), attempt)


def wait_from_header(value: Column, pattern: str = r"(\d+)", most: float | None = None) -> Column:
    """Seconds that a header asks for; null where it has none or asks for ``most`` or more."""
    seconds = F.regexp_extract(value, pattern, 1).try_cast("double")
    return F.when(seconds < most, seconds) if most is not None else seconds


def wait_until(value: Column, now: Column, least: float = 0.0) -> Column:
    """Seconds until an epoch that a header names."""
    return F.greatest(value.try_cast("double") - now, F.lit(least))
