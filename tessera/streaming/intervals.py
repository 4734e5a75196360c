"""Gaps of intervals as they arrive: the ordered map of each entity lives in the stream's keyed state.

Every batch of an entity is inserted in its map; what comes out are the changes to its gap list, so the gaps at any time
are those opened and not closed since. The state of an entity is its disjoint periods.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.intervals import OPEN, IntervalMap


def _update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    held = IntervalMap()
    if state.exists:
        starts, ends = state.get
        held.starts, held.ends = list(starts), list(ends)
    shut, fresh = set(), set()
    for frame in frames:
        for lo, hi in zip(frame["lo"].tolist(), frame["hi"].tolist()):
            closed, opened = held.change(lo, hi)
            shut |= set(closed) - fresh  # a gap that came and went within the batch was never there
            fresh = fresh - set(closed) | set(opened)
    state.update((held.starts, held.ends))
    rows = [(*key, lo, hi, "closed") for lo, hi in sorted(shut - fresh)] + [(*key, lo, hi, "opened") for lo, hi in sorted(fresh - shut)]
    yield pd.DataFrame(rows, columns=["key", "gap_from", "gap_to", "change"])


def gap_changes(stream: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """key, gap_from, gap_to, change (opened or closed) of a stream of intervals; null keys and unusable intervals are ignored."""
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(start).cast("long").alias("lo"), F.coalesce(F.col(end).cast("long"), F.lit(OPEN)).alias("hi"))
    rows = rows.where(F.col("key").isNotNull() & F.col("lo").isNotNull() & (F.col("hi") > F.col("lo")))
    return rows.groupBy("key").applyInPandasWithState(_update, "key string, gap_from long, gap_to long, change string", "starts array<long>, ends array<long>", "update", "NoTimeout")
