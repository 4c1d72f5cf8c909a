"""Time helpers. Times inside vigil are BIGINT micro-seconds since the epoch (``*_us``)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

US = 1
MS = 1_000
SEC = 1_000_000
MIN = 60 * SEC
HOUR = 60 * MIN
DAY = 24 * HOUR

_UNIT_US = {"ms": MS, "s": SEC, "m": MIN, "h": HOUR, "d": DAY, "w": 7 * DAY, "y": 365 * DAY}


def dur_us(text: str | int) -> int:
    """Parse a duration literal such as ``"5m"`` or ``"1h30m"`` into micro-seconds (driver side,
    for operator parameters only)."""
    if isinstance(text, int):
        return text
    parts = re.findall(r"(\d+)(ms|s|m|h|d|w|y)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"bad duration: {text!r}")
    return sum(int(n) * _UNIT_US[u] for n, u in parts)


def ts_to_us(c: Column | str) -> Column:
    """TIMESTAMP / TIMESTAMP_NTZ -> BIGINT micro-seconds (session zone UTC)."""
    return F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp"))


def us_to_ts(c: Column | str) -> Column:
    return F.timestamp_micros(F.col(c) if isinstance(c, str) else c)


def floor_to(c: Column, step_us: int) -> Column:
    """Floor a micro-second column to a multiple of ``step_us``."""
    return (c - F.pmod(c, F.lit(step_us))).cast("bigint")
