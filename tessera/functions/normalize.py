"""Normalising identifiers before they are compared across sources.

The first rule that at least 60 % of a sample of values fit is taken; an empty sample fits the first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SHARE = 0.6


@dataclass(frozen=True)
class Rule:
    name: str
    #: What a value must look like, after the characters ``ignoring`` are dropped.
    looks: str
    ignoring: str | None
    #: Replacements in order, each to nothing.
    drops: tuple[str, ...] = ()
    case: str | None = None
    trims: bool = False

    def fits(self, value: str) -> bool:
        return re.search(self.looks, re.sub(self.ignoring, "", value) if self.ignoring else value) is not None

    def text(self, value: str) -> str:
        for d in self.drops:
            value = re.sub(d, "", value)
        value = value.strip() if self.trims else value
        return value.upper() if self.case == "upper" else value.lower() if self.case == "lower" else value

    def column(self, c: Column) -> Column:
        c = c.cast("string")
        for d in self.drops:
            c = F.regexp_replace(c, "(?U)" + d, "")
        if self.trims:
            c = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
        return F.upper(c) if self.case == "upper" else F.lower(c) if self.case == "lower" else c


# What the identifiers look like and how they are brought to one form.
RULES = (
    Rule("serial", r"^[A-Za-z]{1,4}[-\s]?\d{3,}", None, (r"[-\s]",), "upper"),
    Rule("phone", r"^(\+?86)?1[3-9]\d{9}$", r"[-\s]", (r"[-\s]", r"^\+?86")),
    Rule("id_card", r"^\d{17}[\dXx]$", r"\s", (r"\s",), "upper"),
    Rule("email", r"^[^@\s]+@[^@\s]+\.[^@\s]+$", None, (), "lower", True),
    Rule("plain", "", None, (), None, True),
)
BY_NAME = {r.name: r for r in RULES}


def pick_rule(sample: list[str]) -> Rule:
    return next(r for r in RULES if sum(map(r.fits, sample)) >= SHARE * len(sample))
