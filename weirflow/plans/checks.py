"""Whether streams can be read, tried with one record each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def available(read: Callable[[], DataFrame], needs_rows: bool = False) -> tuple[bool, str]:
    """Whether a stream gives its first record, and why not; one without records is there, unless it ``needs_rows``."""
    try:
        found = read().limit(1).collect()
    except Exception as e:  # whatever a source fails with is the answer
        return False, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
    return (bool(found) or not needs_rows), "" if found else "no records"


def checked(streams: dict[str, Callable[[], DataFrame]], names: list[str] | None = None, most: int | None = None) -> dict[str, tuple[bool, str]]:
    """``available`` of the streams ``names`` (all without), ``most`` of them at most, as for streams that a template makes.

    A name that isn't among the streams fails: a check that tests nothing would pass.
    """
    wanted = list(streams) if names is None else names
    missing = [n for n in wanted if n not in streams]
    if missing:
        raise ValueError(f"no streams named {', '.join(missing)}; there are {', '.join(sorted(streams))}")
    return {n: available(streams[n]) for n in wanted[:most]}
