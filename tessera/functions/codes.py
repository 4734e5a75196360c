"""Column expressions shared by all operators: code forms, epochs, months."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Epoch values from here on were delivered in milliseconds.
MILLISECONDS_FROM = 100_000_000_000


def code_form(c: Column) -> Column:
    """Upper case with only A-Z and 0-9 kept; null where nothing is left (a blank refers to nothing)."""
    return F.nullif(F.regexp_replace(F.upper(c), "[^A-Z0-9]", ""), F.lit(""))


def epoch_seconds(c: Column) -> Column:
    """UTC seconds of an epoch column that mixes seconds and milliseconds; null stays null."""
    return F.when(c >= MILLISECONDS_FROM, F.floor(c / 1000)).otherwise(c).cast("long")


def usable_interval(code: Column, start: Column, end: Column) -> Column:
    """Code not blank, start not null, end null (still open) or later than start. Never null."""
    return code.isNotNull() & start.isNotNull() & (end.isNull() | (end > start))


def utc_month(ts: Column) -> Column:
    """UTC month of a timestamp as yyyy-MM, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM")
