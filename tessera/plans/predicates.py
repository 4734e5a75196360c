"""Conditions as columns.

A property has one of three states: undefined (no source that maps it has a row), null, or a value. No condition holds on
an undefined property. Null is equal to null only, and differs from every value; on dates a null bound means "until
now": it is after everything, as data, and everything is before it, as an operand. Values compare strictly: a text never
equals a number, texts have no order, and a text that starts like an ISO date counts as its UTC second.

Columns returned here mean "holds" where true; null counts as false. :func:`two_valued` makes that explicit where a
condition is negated or used as a value.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.dates import iso_column
from tessera.plans.errors import Rejected



def two_valued(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def every(columns: list[Column]) -> Column:
    return reduce(and_, columns) if columns else F.lit(True)


def some(columns: list[Column]) -> Column:
    return reduce(or_, columns) if columns else F.lit(False)


@dataclass
class Value:
    """One side of a comparison. ``kind``: number, text, boolean, time or null; ``literal`` for constants."""

    kind: str
    column: Column
    literal: object = None
    constant: bool = False
    #: Whether a constant number was written as a date.
    dated: bool = False

    @property
    def missing(self) -> Column:
        return F.lit(self.literal is None) if self.constant else self.column.isNull()

    def number(self) -> Column | None:
        """As a number that can be ordered; a text's ISO date counts."""
        if self.kind == "number":
            return self.column
        if self.kind == "time":
            return F.unix_seconds(self.column)
        if self.kind == "text" and not self.constant:
            return iso_column(self.column)
        return None


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.TimestampType, T.DateType, T.TimestampNTZType)):
        return "time"
    return "null" if isinstance(t, T.NullType) else "text"


def column_value(c: Column, t: T.DataType) -> Value:
    if isinstance(t, (T.DateType, T.TimestampNTZType)):
        return Value("time", c.cast("timestamp"))
    return Value(kind_of(t), c)


def literal_value(v, dated: bool = False) -> Value:
    if v is None:
        return Value("null", F.lit(None), None, True)
    if isinstance(v, bool):
        return Value("boolean", F.lit(v), v, True)
    if isinstance(v, (int, float)):
        return Value("number", F.lit(v), v, True, dated)
    if isinstance(v, str):
        return Value("text", F.lit(v), v, True)
    raise Rejected(f"{v!r} is no literal")


def _same(a: Value, e: Value) -> Column:
    """Equality of two values; null where either is."""
    if a.kind == e.kind and a.kind in ("text", "boolean", "number", "time"):
        return a.column == e.column
    if {a.kind, e.kind} <= {"number", "time", "text"} and "boolean" not in (a.kind, e.kind):
        x, y = a.number(), e.number()
        if x is not None and y is not None:
            return x == y
    return F.lit(False)


def compare(a: Value, op: str, e: Value | list[Value], date: bool) -> Column:
    if op == "in":
        texts = [x for x in e if x.kind == a.kind and x.literal is not None]
        others = [x for x in e if x.kind != a.kind and x.literal is not None]
        found = [a.column.isin([x.literal for x in texts])] if texts else []
        return some(found + [_same(a, x) for x in others])
    if op == "eq":
        if e.constant:
            return a.column.isNull() if e.literal is None else _same(a, e)
        return (a.missing & e.missing) | _same(a, e)
    if op == "ne":
        if e.constant:
            return a.column.isNotNull() if e.literal is None else a.column.isNull() | (~_same(a, e) if a.kind == e.kind else ~two_valued(_same(a, e)))
        return ~((a.missing & e.missing) | two_valued(_same(a, e)))
    if op == "contains":
        if e.literal is None and e.constant:
            return F.lit(False)
        text = F.unix_seconds(a.column).cast("string") if a.kind == "time" else a.column.cast("string")
        return text.contains(e.column.cast("string"))
    x, y = a.number(), e.number()
    test = {"lt": Column.__lt__, "lte": Column.__le__, "gt": Column.__gt__, "gte": Column.__ge__}[op]
    ordered = test(x, y) if x is not None and y is not None else F.lit(False)
    if not date:
        return ordered
    if op in ("gt", "gte"):
        return a.missing | ordered
    if e.constant and e.literal is not None:
        return ordered
    return ~a.missing & (e.missing | two_valued(ordered))
