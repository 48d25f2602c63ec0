"""Instants as microseconds, durations, and right-closed window bounds."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def duration(value) -> timedelta:
    """``24h`` and the like; timedeltas pass."""
    if isinstance(value, timedelta):
        return value
    m = re.fullmatch(r"\s*(\d+)([smhd])\s*", value) if isinstance(value, str) else None
    if m is None:
        raise ValueError(f"not a duration: {value!r}")
    return timedelta(seconds=int(m[1]) * _SECONDS[m[2]])


def micros(value) -> int:
    return duration(value) // timedelta(microseconds=1)


def us(column: Column) -> Column:
    """Microseconds since 1970, for timestamps with or without zone (UTC session)."""
    return F.unix_micros(column.cast("timestamp"))


def window_end(at: Column, slide: int) -> Column:
    """The end of the ``(end - slide, end]`` pane that holds ``at`` (microseconds)."""
    return at + F.pmod(-at, F.lit(slide))


def iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
