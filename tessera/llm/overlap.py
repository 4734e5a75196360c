"""Overlap sizes between all pairs of many large sets, by a blocked matrix product.

Items are shuffled so that each item's sets meet in one row (pre-aggregated before the shuffle, so that an item that is
repeated without end, or a set that holds most of all rows, moves only once per task). Each task writes its rows into
0/1 tiles, one column per set, and adds the product of the transposed tile with itself: the co-occurrence counts of its
rows. The integer matrices of all tasks are summed; the diagonal holds the set sizes. No intersection is ever built.
All pairs of a scope's sets, where asked for, are made in blocks too.

Tiles are float32 with at most 2**13 rows, so every product is exact. Sets beyond one block of columns are multiplied
block by block.

Defined results: null scopes, sets and items count for nothing; repeated rows count once; a set without items has size 0
and overlaps nothing (rate 0); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.shared import pairs_within, store

TILE_ROWS, BLOCK = 1 << 13, 1_024
#: Cells of the matrices that a task keeps; what comes beyond is handed out block by block. Sets that meet in one task.
MOST_CELLS, ROWS_OUT, PAIRED = 8_000_000, 50_000, 512
#: Ones of the tiles that wait in a task.
MOST_WAITING = 2_000_000


class Cooccurrence:
    """Counts, for the sets of one scope, how many rows hold each pair of them; keeps ``most`` cells at most."""

    def __init__(self, most: int | None = None) -> None:
        self.most = MOST_CELLS if most is None else most
        self.names: dict[str, int] = {}
        self.blocks: dict[tuple[int, int], np.ndarray] = {}
        self.cells = 0
        self._rows = 0
        self._row_of: list[int] = []
        self._column_of: list[int] = []

    def add(self, sets: Iterable[str]) -> bool:
        """Adds a row; whether the tile is full and is to be multiplied."""
        names = self.names
        for s in sets:
            self._row_of.append(self._rows)
            self._column_of.append(names.setdefault(s, len(names)))
        self._rows += 1
        return self._rows == TILE_ROWS

    def waiting(self) -> int:
        return len(self._row_of)

    def multiply(self) -> Iterator[tuple[str, str, int]]:
        """Adds the product of the waiting tile; gives the counts of blocks there is no room for."""
        if not self._rows:
            return
        rows, columns = np.array(self._row_of, np.int64), np.array(self._column_of, np.int64)
        n, self._rows, self._row_of, self._column_of = self._rows, 0, [], []
        in_block = {block: columns // BLOCK == block for block in np.unique(columns // BLOCK).tolist()}

        def tile(block: int) -> np.ndarray:
            made = np.zeros((n, min(BLOCK, len(self.names) - block * BLOCK)), np.float32)
            made[rows[in_block[block]], columns[in_block[block]] - block * BLOCK] = 1
            return made

        names: list[str] | None = None
        for i in in_block:
            left = tile(i)
            for j in in_block:
                if i > j:
                    continue
                part = (left.T @ (left if i == j else tile(j))).astype(np.int64)
                held = self.blocks.get((i, j))
                if held is None or held.shape != part.shape:
                    size = part.size - (0 if held is None else held.size)
                    if self.cells + size > self.most:
                        names = names or list(self.names)
                        yield from self._named(names, i, j, part)
                        continue
                    self.cells += size
                    grown = np.zeros(part.shape, np.int64)
                    if held is not None:
                        grown[: held.shape[0], : held.shape[1]] = held
                    self.blocks[i, j] = held = grown
                held += part

    @staticmethod
    def _named(names: list[str], i: int, j: int, block: np.ndarray) -> Iterator[tuple[str, str, int]]:
        for r, c in zip(*(x.tolist() for x in np.nonzero(block))):
            if i < j or r <= c:
                a, b = names[i * BLOCK + r], names[j * BLOCK + c]
                yield (a, b, int(block[r, c])) if a <= b else (b, a, int(block[r, c]))

    def counts(self) -> Iterator[tuple[str, str, int]]:
        """Each pair of sets that share rows, the lesser name first, and how many; (a, a) is the size of a.

        A pair may come several times, with parts of its count.
        """
        yield from self.multiply()
        names = list(self.names)
        for (i, j), block in self.blocks.items():
            yield from self._named(names, i, j, block)


def _count(schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scopes: dict = {}

        def out(rows):
            columns = zip(*rows) if rows else [[] for _ in schema]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        def handed_out(scope, found):
            rows = []
            for one in found:
                rows.append((scope, *one))
                if len(rows) >= ROWS_OUT:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)

        for batch in batches:
            for scope, sets in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = scopes.get(scope)
                if held is None:
                    held = scopes[scope] = Cooccurrence()
                if held.add(sets):
                    yield from handed_out(scope, held.multiply())
            if sum(map(Cooccurrence.waiting, scopes.values())) > MOST_WAITING:
                for scope, held in scopes.items():
                    yield from handed_out(scope, held.multiply())
            if sum(held.cells for held in scopes.values()) > MOST_CELLS or len(scopes) > ROWS_OUT:
                for scope, held in scopes.items():
                    yield from handed_out(scope, held.counts())
                scopes.clear()
        for scope, held in scopes.items():
            yield from handed_out(scope, held.counts())
        yield out([])

    return run


def cooccurrences(df: DataFrame, scope: str, name: str, item: str) -> DataFrame:
    """scope, a, b, n: the items that sets a <= b of a scope share; a = b gives the size. Only pairs that share any."""
    rows = df.select(F.col(scope).cast("long").alias("scope"), F.col(name).alias("name"), F.col(item).alias("item"))
    rows = rows.where(F.col("scope").isNotNull() & F.col("name").isNotNull() & F.col("item").isNotNull())
    sets = rows.groupBy("scope", "item").agg(F.collect_set("name").alias("sets")).select("scope", "sets")
    schema = pa.schema([("scope", pa.int64()), ("a", pa.string()), ("b", pa.string()), ("n", pa.int64())])
    parts = sets.mapInArrow(_count(schema), "scope long, a string, b string, n long")
    return parts.groupBy("scope", "a", "b").agg(F.sum("n").alias("n"))


def _with_sizes(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    for side in "ab":
        sizes = counts.where(F.col("a") == F.col("b")).select("scope", F.col("a").alias(side), F.col("n").alias(f"count_{side}"))
        pairs = pairs.join(sizes, ["scope", side], "left")
    pairs = pairs.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("count_a", "count_b", "count_hit")})
    most = F.greatest("count_a", "count_b")
    return pairs.withColumn("rate", F.when(most > 0, F.col("count_hit") / most).otherwise(F.lit(0.0)))


def overlaps(df: DataFrame, scope: str, name: str, item: str) -> DataFrame:
    """scope, a, b, count_a, count_b, count_hit, rate of every pair a < b of a scope's sets, disjoint ones too."""
    counts = store(cooccurrences(df, scope, name, item))
    names = store(df.select(F.col(scope).cast("long").alias("scope"), F.col(name).alias("set")).where(F.col("scope").isNotNull() & F.col("set").isNotNull()).distinct())
    pairs = pairs_within(names, ["scope"], "set", PAIRED).select("scope", F.col("set_a").alias("a"), F.col("set_b").alias("b"))
    pairs = pairs.join(counts.where(F.col("a") < F.col("b")).withColumnRenamed("n", "count_hit"), ["scope", "a", "b"], "left")
    return _with_sizes(pairs, counts)


def overlapping(df: DataFrame, scope: str, name: str, item: str, least: float) -> DataFrame:
    """The pairs of :func:`overlaps` with a rate of at least ``least`` (above 0); disjoint pairs are never made."""
    counts = store(cooccurrences(df, scope, name, item))
    pairs = counts.where(F.col("a") < F.col("b")).withColumnRenamed("n", "count_hit")
    return _with_sizes(pairs, counts).where(F.col("rate") >= least)
