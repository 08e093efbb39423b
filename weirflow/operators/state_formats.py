"""Sync state as text, in the forms that sources keep it in, and as rows of intervals.

A sequential state is an object with the cursor: all before it was read. A state of ranges holds
``slices`` with ``start``, ``end`` and ``most_recent_cursor_value``. Cursors are seconds or milliseconds since 1970,
ISO 8601 with milliseconds, or of a format of one's own; what is read may have any general form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions import dates
from weirflow.operators.state import merge_intervals

#: The name of a state of ranges, and the fields of its slices.
RANGES, RECENT = "date-range", "most_recent_cursor_value"
SLICES = f"array<struct<start: string, end: string, {RECENT}: string>>"
EPOCHS = {"seconds": 1, "millis": 1_000, "micros": 1_000_000}


def parsed(text: Column, form: str) -> Column:
    """A cursor's text as a time; null where it is none."""
    if form in EPOCHS:
        return F.timestamp_micros((text.try_cast("decimal(30,6)") * (1_000_000 // EPOCHS[form])).cast("long"))
    return dates.parse_any(text) if form == "iso" else F.coalesce(F.try_to_timestamp(text, F.lit(dates.java_pattern(form))), dates.parse_any(text))


def shown(time: Column, form: str) -> Column:
    """A time as a cursor's text, whole seconds or milliseconds rounded down."""
    if form in EPOCHS:
        return F.floor(F.unix_micros(time) / (1_000_000 // EPOCHS[form])).cast("string")
    if form == "iso":
        return F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.date_format(time, dates.java_pattern(form))


def intervals_of(states: DataFrame, keys: list[str], state: str, cursor: str, form: str = "iso", start: Column | None = None) -> DataFrame:
    """``keys``, ``start``, ``end`` and ``most_recent`` of every interval that states (JSON text) hold as read.

    A sequential state is one interval up to its cursor, from ``start`` on if that is given (and no earlier than it), else of that moment alone. A
    state that is null, empty or of neither form holds none, unless there is a ``start``, from which on nothing was read.
    """
    ranges = F.from_json(F.get_json_object(state, "$.slices"), SLICES)
    low = F.get_json_object(state, f"$['{cursor}']")
    at = parsed(low, form) if start is None else F.greatest(parsed(low, form), start)
    one = F.struct((at if start is None else start).alias("start"), at.alias("end"), at.alias("most_recent"))
    many = F.transform(ranges, lambda s: F.struct(parsed(s["start"], form).alias("start"), parsed(s["end"], form).alias("end"), parsed(s[RECENT], form).alias("most_recent")))
    rows = F.when(F.get_json_object(state, "$.state_type") == RANGES, many).when(at.isNotNull(), F.array(one))
    return states.select(*keys, F.explode(rows).alias("s")).select(*keys, "s.start", "s.end", "s.most_recent")


def states_of(intervals: DataFrame, keys: list[str], cursor: str, form: str = "iso", sequential: bool = False) -> DataFrame:
    """``keys`` and ``state``, JSON text, of intervals that were read.

    A sequential state claims what was read without a gap from the start: the first interval's most recent cursor, or its start if it held no record.
    """
    recent = intervals if "most_recent" in intervals.columns else intervals.withColumn("most_recent", F.lit(None).cast("timestamp"))
    micros = [F.unix_micros(c).alias(c) for c in ("start", "end", "most_recent")]
    times = [F.timestamp_micros(c).alias(c) for c in ("start", "end", "most_recent")]
    merged = merge_intervals(recent.select(*keys, *micros), keys, most_recent="most_recent").select(*keys, *times)
    text = lambda c: shown(F.col(c), form)
    if sequential:
        first = merged.groupBy(*keys).agg(F.min_by(F.struct("start", "most_recent"), "start").alias("f"))
        value = shown(F.coalesce("f.most_recent", "f.start"), form)
        plain = value.cast("long") if form in EPOCHS else value
        return first.select(*keys, F.to_json(F.struct(plain.alias(cursor))).alias("state"))
    number = (lambda c: text(c).cast("long")) if form in EPOCHS else text
    rows = merged.select(*keys, F.struct(number("start").alias("start"), number("end").alias("end"), number("most_recent").alias(RECENT)).alias("s"), F.col("start").alias("__at"))
    held = F.transform(F.array_sort(F.collect_list(F.struct("__at", "s"))), lambda x: x.s)  # a key's intervals, as its state has them
    return rows.groupBy(*keys).agg(held.alias("slices")).select(*keys, F.to_json(F.struct(F.lit(RANGES).alias("state_type"), "slices")).alias("state"))
