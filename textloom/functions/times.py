"""Instants as numbers. Timestamps without a zone are read as UTC, whatever the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_us(ts: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def epoch_s(ts: str) -> Column:
    return F.floor(epoch_us(ts) / 1_000_000).cast("long")
