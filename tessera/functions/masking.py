"""Hiding sensitive values in samples."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of the names of sensitive columns.
SENSITIVE = re.compile(r"id_?card|idcard|phone|mobile|身份证|手机|邮箱|email", re.I)
HIDDEN = "******"


def masked(c: Column) -> Column:
    """Up to six characters vanish; of longer values the first four and last two stay."""
    text = c.cast("string")
    return F.when(F.length(text) <= 6, F.lit(HIDDEN)).otherwise(F.concat(F.substring(text, 1, 4), F.lit(HIDDEN), F.substring(text, -2, 2)))


def mask(name: str, c: Column) -> Column:
    """The column, masked if its name says that it is sensitive; null stays null."""
    return F.when(c.isNotNull(), masked(c)) if SENSITIVE.search(name) else c
