"""Overlapping and gapped time intervals: continuous periods and the gaps between them.

Each entity owns an :class:`IntervalMap`, an ordered map of disjoint intervals. An insertion finds the intervals it
overlaps or touches by binary search and merges them; what lies between neighbours is the gap list.

The work is done in three steps, none of which gathers an entity in one place:

1. *combine*: each task keeps the maps of the entities it meets and hands out merged intervals only, cut at the edges of
   fixed time slots. A hot entity leaves a task as its few disjoint pieces, not as its rows.
2. *merge*: pieces are shuffled by entity **and slot**; each task inserts a slot's pieces in the map that is its keyed
   state. A slot has whole seconds only, so no state outgrows half its width, in whatever year.
3. *stitch*: only the first and last piece of each slot meet per entity, at most two per slot, in a window.

Defined results: rows with a null key, a null start or an end not after its start are no intervals; a null end is open
(+infinity); repeated rows change nothing; intervals that touch leave no gap; an empty table gives an empty result;
columns other than those named are ignored, so clashing names do no harm.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: End of an interval that is still open.
OPEN = 1 << 62
#: Seconds in a slot, as a power of two (about 194 days). That holds within EVEN of 1970 (the years 881 to 3058); beyond,
#: each slot is twice as wide as the one before, so that even an interval over all time has a bounded number of parts.
#: What lies after the last start in the data shares its slot: nothing can be uncovered there, and open ends have few parts.
SLOT_BITS, EVEN = 24, 1 << 35
#: A task hands out its maps when they hold so many entities or intervals, and any map that outgrows the last figure, as
#: insertions in random order would get slow.
FLUSH_ENTITIES, FLUSH_PIECES, FLUSH_MAP, ROWS_OUT = 100_000, 200_000, 10_000, 20_000

GAP, INNER, EDGE = 0, 1, 2


class IntervalMap:
    """Disjoint half-open intervals in order; ``starts`` and ``ends`` both ascend and never touch."""

    __slots__ = ("starts", "ends")

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, lo: int, hi: int) -> None:
        """Insert [lo, hi), merging whatever it overlaps or touches."""
        starts, ends = self.starts, self.ends
        i = bisect_left(ends, lo)
        j = bisect_right(starts, hi, i)
        if i == j:
            starts.insert(i, lo)
            ends.insert(i, hi)
        elif j == i + 1:
            if lo < starts[i]:
                starts[i] = lo
            if hi > ends[i]:
                ends[i] = hi
        else:
            starts[i:j] = [min(lo, starts[i])]
            ends[i:j] = [max(hi, ends[j - 1])]

    def change(self, lo: int, hi: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """Insert [lo, hi); the gaps that vanish and those that appear by it."""
        i, j = bisect_left(self.ends, lo), bisect_right(self.starts, hi)
        near = slice(max(i - 1, 0), j + 1)
        before = set(zip(self.ends[near], self.starts[near][1:]))
        grown = len(self.starts)
        self.add(lo, hi)
        near = slice(max(i - 1, 0), j + 1 + len(self.starts) - grown)
        after = set(zip(self.ends[near], self.starts[near][1:]))
        return sorted(before - after), sorted(after - before)

    def periods(self) -> Iterator[tuple[int, int]]:
        return zip(self.starts, self.ends)

    def gaps(self) -> Iterator[tuple[int, int]]:
        return zip(self.ends, self.starts[1:])

    def __len__(self) -> int:
        return len(self.starts)


def slot_of(t: int, bits: int) -> int:
    if -EVEN <= t < EVEN:
        return t >> bits
    return (EVEN >> bits) + (t // EVEN).bit_length() - 1 if t > 0 else -(EVEN >> bits) - (-(t + 1) // EVEN).bit_length()


def slot_end(slot: int, bits: int) -> int:
    n = EVEN >> bits
    if -n <= slot < n:
        return (slot + 1) << bits
    return EVEN << (slot - n + 1) if slot > 0 else -(EVEN << (-slot - n - 1))


def _cut(lo: int, hi: int, bits: int, horizon: int) -> Iterator[tuple[int, int, int]]:
    """The parts of an interval by slot."""
    slot, last = slot_of(lo, bits), slot_of(min(hi - 1, horizon), bits)
    while slot < last:
        edge = slot_end(slot, bits)
        yield slot, lo, edge
        lo, slot = edge, slot + 1
    yield slot, lo, hi


class _Out:
    """Rows gathered column by column, handed out as batches."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.columns = schema, [[] for _ in schema]

    def add(self, *values) -> None:
        for column, v in zip(self.columns, values):
            column.append(v)

    def full(self) -> bool:
        return len(self.columns[0]) >= ROWS_OUT

    def take(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, self.schema)], schema=self.schema)
        self.columns = [[] for _ in self.schema]
        return batch


def _arrow(keys: list[T.StructField], *rest: tuple[str, pa.DataType]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.schema([(k.name, to_arrow_type(k.dataType)) for k in keys] + list(rest))


def _combine(schema: pa.Schema, n_keys: int, bits: int, horizon: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[tuple, IntervalMap] = {}
        pieces, out = 0, _Out(schema)

        def hand_out(key, held):
            for lo, hi in held.periods():
                for part in _cut(lo, hi, bits, horizon):
                    out.add(*key, *part)

        def flush():
            for key, held in maps.items():
                hand_out(key, held)
                if out.full():
                    yield out.take()
            maps.clear()

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for key, lo, hi in zip(zip(*columns[:n_keys]), columns[-2], columns[-1]):
                held = maps.get(key)
                if held is None:
                    held = maps[key] = IntervalMap()
                pieces -= len(held.starts)
                held.add(lo, hi)
                if len(held.starts) > FLUSH_MAP:
                    hand_out(key, maps.pop(key))
                else:
                    pieces += len(held.starts)
            if out.full():
                yield out.take()
            if len(maps) > FLUSH_ENTITIES or pieces > FLUSH_PIECES:
                yield from flush()
                pieces = 0
        yield from flush()
        yield out.take()

    return run


def _merge(schema: pa.Schema, n_keys: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, out = None, IntervalMap(), _Out(schema)

        def close():
            if current is None:
                return
            key, last = current, len(state) - 1
            for i, (lo, hi) in enumerate(state.periods()):
                out.add(*key, EDGE if i in (0, last) else INNER, lo, hi)
            for lo, hi in state.gaps():
                out.add(*key, GAP, lo, hi)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for key, lo, hi in zip(zip(*columns[:n_keys]), columns[-2], columns[-1]):
                if key != current:
                    close()
                    if out.full():
                        yield out.take()
                    current, state = key, IntervalMap()
                state.add(lo, hi)
        close()
        yield out.take()

    return run


def _pieces(df: DataFrame, keys: list[str], start: Column, end: Column, slot_bits: int) -> DataFrame:
    """Disjoint pieces by entity and slot with ``__kind`` gap, inner or edge, after steps 1 and 2."""
    rows = df.select(*keys, start.cast("long").alias("__lo"), F.coalesce(end.cast("long"), F.lit(OPEN)).alias("__hi"))
    rows = rows.where(F.col("__lo").isNotNull() & (F.col("__hi") > F.col("__lo")))
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    fields = [rows.schema[k] for k in keys]
    horizon = rows.agg(F.max("__lo")).first()[0] or 0
    sliced = T.StructType([*fields, *(T.StructField(n, T.LongType()) for n in ("__slot", "__lo", "__hi"))])
    parts = rows.mapInArrow(_combine(_arrow(fields, ("__slot", pa.int64()), ("__lo", pa.int64()), ("__hi", pa.int64())), len(keys), slot_bits, horizon), sliced)
    # By start within a slot, so that an insertion, though still found by search, lands at the end of its map and moves
    # nothing; the last key first, as it tells most.
    parts = parts.repartition(*keys, "__slot").sortWithinPartitions(*reversed(keys), "__slot", "__lo")
    kinds = T.StructType([*fields, T.StructField("__slot", T.LongType()), T.StructField("__kind", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("__lo", "__hi"))])
    return parts.mapInArrow(_merge(_arrow(fields, ("__slot", pa.int64()), ("__kind", pa.int32()), ("__lo", pa.int64()), ("__hi", pa.int64())), len(keys) + 1), kinds)


def _stitched(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the end and slot of the edge piece before each edge piece of its entity; other rows stay with their slot."""
    by = Window.partitionBy(*keys, F.when(F.col("__kind") != EDGE, F.col("__slot"))).orderBy("__kind", "__lo")
    return pieces.withColumns({"__last_hi": F.lag("__hi").over(by), "__last_slot": F.lag("__slot").over(by)})


def interval_gaps(df: DataFrame, keys: list[str], start: Column, end: Column, *, slot_bits: int = SLOT_BITS) -> DataFrame:
    """The gaps between covered stretches: keys, gap_from (end of the earlier), gap_to (start of the later)."""
    rows = _stitched(_pieces(df, keys, start, end, slot_bits).where(F.col("__kind") != INNER), keys)
    inner, between = F.col("__kind") == GAP, (F.col("__last_slot") < F.col("__slot")) & (F.col("__last_hi") < F.col("__lo"))
    return rows.where(inner | between).select(
        *keys, F.when(inner, F.col("__lo")).otherwise(F.col("__last_hi")).alias("gap_from"), F.when(inner, F.col("__hi")).otherwise(F.col("__lo")).alias("gap_to")
    )


def interval_periods(df: DataFrame, keys: list[str], start: Column, end: Column, *, slot_bits: int = SLOT_BITS) -> DataFrame:
    """The continuous periods: keys, period_from, period_to (null: still open)."""
    rows = _stitched(_pieces(df, keys, start, end, slot_bits).where(F.col("__kind") != GAP), keys)
    spread = F.when(F.col("__kind") != EDGE, F.col("__slot"))
    fresh = (F.col("__kind") != EDGE) | F.col("__last_hi").isNull() | (F.col("__last_hi") < F.col("__lo"))
    rows = rows.withColumn("__spread", spread).withColumn("__fresh", fresh.cast("int"))
    upto = Window.partitionBy(*keys, "__spread").orderBy("__kind", "__lo").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__island", F.sum("__fresh").over(upto))
    found = rows.groupBy(*keys, "__spread", "__island").agg(F.min("__lo").alias("period_from"), F.max("__hi").alias("__to"))
    return found.select(*keys, "period_from", F.when(F.col("__to") < OPEN, F.col("__to")).alias("period_to"))
