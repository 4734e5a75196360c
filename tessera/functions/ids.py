"""Values of effects: number expressions and generated identifiers."""

from __future__ import annotations

import re
import secrets
import time
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.dates import UNITS

_OPERAND = r"(?:(?:current|request)\.[A-Za-z_]\w*|\d+(?:\.\d+)?)"
NUMBER_EXPRESSION = re.compile(rf"({_OPERAND})([+-])({_OPERAND})")
#: Texts that are meant as expressions, well formed or not.
LIKE_EXPRESSION = re.compile(r"now[+\-/]|(?:current|request)\.")
_DATE = re.compile(rf"now(?:[+-]\d+[{''.join(UNITS)}])*(?:/[wdhms])?")


def is_date_expression(text: str) -> bool:
    return _DATE.fullmatch(text) is not None


def number_expression(text: str, look_up: Callable[[str, str], Column]) -> Column | None:
    """A sum or difference as a column; ``look_up(scope, name)`` gives a property or parameter. None: no expression."""
    found = NUMBER_EXPRESSION.fullmatch(text)
    if not found:
        return None

    def operand(token: str) -> Column:
        if token[0].isdigit():
            return F.lit(float(token) if "." in token else int(token))
        return look_up(*token.split(".", 1))

    a, b = operand(found[1]), operand(found[3])
    return a + b if found[2] == "+" else a - b


# Bits of time since this millisecond (2020-01-01 UTC), of the machine and of the sequence.
SNOWFLAKE_EPOCH_MS, MACHINE_BITS, SEQUENCE_BITS = 1_577_836_800_000, 10, 12


class Snowflake:
    """Identifiers of 41 time, 10 machine and 12 sequence bits; ascending within a machine."""

    def __init__(self, machine: int = 0, clock_ms: Callable[[], int] | None = None) -> None:
        self.machine, self.clock_ms = machine % (1 << MACHINE_BITS), clock_ms or (lambda: time.time_ns() // 1_000_000)
        self.last, self.sequence = -1, 0

    def __call__(self) -> int:
        now = max(self.clock_ms(), self.last)
        self.sequence = self.sequence + 1 if now == self.last else 0
        if self.sequence >> SEQUENCE_BITS:
            now, self.sequence = now + 1, 0
        self.last = now
        return ((now - SNOWFLAKE_EPOCH_MS) << (MACHINE_BITS + SEQUENCE_BITS)) | (self.machine << SEQUENCE_BITS) | self.sequence


def snowflake_column(start_ms: int, row: Column, machine: int = 0) -> Column:
    """Identifiers for numbered rows, as :class:`Snowflake` gives them from a millisecond on; the same on every attempt."""
    tick = F.lit(start_ms - SNOWFLAKE_EPOCH_MS) + F.shiftright(row, SEQUENCE_BITS)
    return F.shiftleft(tick, MACHINE_BITS + SEQUENCE_BITS).bitwiseOR(F.lit(machine << SEQUENCE_BITS)).bitwiseOR(row.bitwiseAND(F.lit((1 << SEQUENCE_BITS) - 1)))


def uuid7(ms: int | None = None, random: Callable[[int], int] = secrets.randbits) -> str:
    """A version 7 UUID: 48 bits of time, the rest random."""
    ms = time.time_ns() // 1_000_000 if ms is None else ms
    n = (ms << 80) | (0x7 << 76) | (random(12) << 64) | (0b10 << 62) | random(62)
    h = f"{n:032x}"
    return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))
