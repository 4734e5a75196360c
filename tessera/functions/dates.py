"""Dates in requests and data: ISO texts and ``now`` expressions as UTC seconds."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.plans.errors import Rejected

# Seconds of each unit.
UNITS = {"y": 31_536_000, "M": 2_592_000, "w": 604_800, "d": 86_400, "h": 3_600, "m": 60, "s": 1}
ISO_START = r"^\d{4}-\d{2}-\d{2}"
_EXPRESSION = re.compile(r"now(?P<steps>(?:[+-]\d+[yMwdhms])*)(?:/(?P<floor>[yMwdhms]))?")
_LIKE = re.compile(r"now(?:[+\-/].*)")
_STEP = re.compile(r"([+-])(\d+)([yMwdhms])")

Clock = Callable[[], int]


def now_expression(text: str, clock: Clock) -> int | None:
    """The seconds a ``now`` expression stands for; None: the text is no such expression."""
    found = _EXPRESSION.fullmatch(text)
    if not found:
        if _LIKE.fullmatch(text):
            raise Rejected(f"{text!r} is no valid date expression")
        return None
    at = clock()
    for sign, n, unit in _STEP.findall(found["steps"]):
        at += (1 if sign == "+" else -1) * int(n) * UNITS[unit]
    if unit := found["floor"]:
        if unit in "yM":
            raise Rejected(f"{text!r}: years and months have no fixed length to round down to")
        at -= at % UNITS[unit]
    return at


def iso_seconds(text: str) -> int | None:
    """The UTC second of an ISO date text, rounded down; None: it does not start like one."""
    if not re.match(ISO_START, text):
        return None
    try:
        at = datetime.fromisoformat(text.replace(" ", "T", 1) if "T" not in text else text)
    except ValueError as e:
        raise Rejected(f"{text!r} is no valid date") from e
    return int((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() // 1)


def request_literal(value, clock: Clock):
    """A literal of a request: date texts and expressions become seconds, all else stays."""
    if not isinstance(value, str):
        return value
    at = now_expression(value, clock)
    if at is None:
        at = iso_seconds(value)
    return value if at is None else at


def iso_column(c: Column) -> Column:
    """UTC seconds of a text column's ISO dates; null where the text is none."""
    at = F.try_to_timestamp(c)
    # A text without a zone was read in the session's; it means UTC.
    zoned = c.rlike(r"([Zz]|[+-]\d{2}:?\d{2})$") & (F.length(c) > 10)
    return F.when(c.rlike(ISO_START), F.unix_seconds(F.when(zoned, at).otherwise(F.from_utc_timestamp(at, F.current_timezone()))))


def format_utc(seconds: Column, pattern: str) -> Column:
    """UTC seconds in a pattern of yyyy, MM, dd, HH, mm and ss."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), pattern)
