"""Dates and times: strftime formats, epoch tokens, clamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strftime directives and Java patterns.
PATTERNS = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%f": "SSSSSS",
    "%p": "a", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%z": "xx", "%Z": "z", "%%": "%",
}
#: Formats that are numbers, in units a second.
EPOCHS = {"%s": 1, "%s_as_float": 1, "%ms": 1_000, "%epoch_microseconds": 1_000_000}


def java_pattern(format: str) -> str:
    """A strftime format as a Java pattern; letters outside directives are quoted."""
    out, at = [], 0
    while at < len(format):
        two = format[at : at + 2]
        if two in PATTERNS:
            out.append(PATTERNS[two])
            at += 2
        elif format[at] == "%":
            raise ValueError(f"no pattern for {two!r}")
        else:
            out.append(f"'{format[at]}'" if format[at].isalpha() else format[at])
            at += 1
    return "".join(out).replace("''", "")


def parse(value: Column, *formats: str) -> Column:
    """The timestamp by the first format that fits, else null."""
    tries = []
    for f in formats:
        if f in EPOCHS:
            tries.append(F.timestamp_micros((value.try_cast("double") * (1_000_000 // EPOCHS[f])).cast("long")))
        else:
            tries.append(F.try_to_timestamp(value.cast("string"), F.lit(java_pattern(f.replace("%_ms", "%f")))))
    return F.coalesce(*tries)


def parse_any(value: Column) -> Column:
    """The timestamp of ISO 8601 text (a date, or a date and time, with or without zone) or of seconds since 1970, else null."""
    text = F.trim(value.cast("string"))
    seconds = F.timestamp_micros((text.try_cast("double") * 1_000_000).cast("long"))
    return F.when(text.rlike(r"^[+-]?\d+(\.\d+)?$") & (F.length(text) != 4), seconds).when(text.rlike(r"^\d{4}-"), text.try_cast("timestamp"))


def duration(value: Column) -> Column:
    """The interval of an ISO 8601 duration such as ``P1Y2M3DT4H5M6.5S``, else null."""
    fine = value.rlike(r"^P(?=.)(\d+Y)?(\d+M)?(\d+W)?(\d+D)?(T(?=\d)(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?$")
    day, time = F.regexp_extract(value, "^P([^T]*)", 1), F.regexp_extract(value, "T(.*)$", 1)
    of = lambda part, unit, kind="int": F.coalesce(F.regexp_extract(part, rf"(\d+(?:\.\d+)?){unit}", 1).try_cast(kind), F.lit(0).cast(kind))
    return F.when(fine, F.make_interval(of(day, "Y"), of(day, "M"), of(day, "W"), of(day, "D"), of(time, "H"), of(time, "M"), of(time, "S", "decimal(18,6)")))


def render(ts: Column, format: str) -> Column:
    """The timestamp in the format, as text."""
    if format in EPOCHS:
        micros = F.unix_micros(ts)
        if format == "%s_as_float":
            return (micros / 1_000_000).cast("string")
        return F.floor(micros / (1_000_000 // EPOCHS[format])).cast("string")
    return F.date_format(ts, java_pattern(format.replace("%_ms", "%f").replace("%f", "SSS") if "%_ms" in format else format))


def epoch_seconds(value: Column) -> Column:
    """Seconds since 1970 with fractions."""
    return F.unix_micros(value.cast("timestamp")) / 1_000_000


def ceiling(ts: Column, unit: str, weekday: str = "MON") -> Column:
    """The end of the unit: the next day always, the next month unless on its first, the next weekday unless on it."""
    day = F.date_trunc("day", ts)
    if unit == "day":
        return day + F.expr("INTERVAL 1 DAY")
    if unit == "month":
        first = F.date_trunc("month", ts)
        return F.when(F.dayofmonth(ts) == 1, day).otherwise(first + F.expr("INTERVAL 1 MONTH"))
    if unit == "week":
        return F.next_day(F.date_sub(ts.cast("date"), 1), weekday).cast("timestamp")
    raise ValueError(unit)


def floor(ts: Column, unit: str) -> Column:
    return F.date_trunc(unit, ts)


def bounded(ts: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """The value, not below ``low`` nor above ``high``; a null stays null."""
    out = ts
    if low is not None:
        out = F.greatest(out, low)
    if high is not None:
        out = F.least(out, high)
    return F.when(ts.isNotNull(), out)


def today_in(zone: str) -> Column:
    """The date that it is in a time zone."""
    return F.from_utc_timestamp(F.current_timestamp(), zone).cast("date")


def day_delta(days: int, format: str = "%Y-%m-%dT%H:%M:%S") -> Column:
    """Now, so many days on, as text."""
    return render(F.current_timestamp() + F.make_interval(days=F.lit(days)), format)


def lookback(cursor: Column, amount: str) -> Column:
    """The cursor moved back by an interval; months go by the calendar."""
    return cursor - F.expr(f"INTERVAL {amount}")
