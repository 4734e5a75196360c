"""References to records that do not exist, per table and period.

Skew-aware split:

1. references are pre-aggregated per key, table and period, which shrinks any hot key to its periods, and the groups are
   stored once;
2. keys that hold many rows are few, so their targets are looked up by broadcast; all other keys go through a shuffled
   anti-join with the targets;
3. both give the faulty groups (table, key, period), whose counts are united. The faulty rows themselves are listed by
   joining the references to those groups, by broadcast where the key is hot and by shuffle elsewhere; rows of hot keys
   are never shuffled, and not even read if none of those keys is faulty.

Kinds: ``late`` - the target exists, but first arrived after the referring row; ``deleted`` - it does not exist and has a
record of deletion; ``missing`` - neither. A group of an existing target can hold late and good rows: its ``cut`` is the
target's first arrival, and only rows before it are faulty.

Defined results: a null key refers to nothing and is no fault; every row counts, repeated ones too; a row without
arrival time has period null and is never late, nor is a row whose target has no arrival time; empty tables of targets
make every reference ``missing``; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.codes import utc_month
from tessera.plans.shared import hot_keys, store

#: A key is hot from so many references on, and if it has at least this part of all. So there are no more hot keys than
#: MOST_HOT (a few hundred kB to broadcast), none is left out, and any other has less than a two-thousandth of all rows.
HOT_ROWS, MOST_HOT = 10_000, 2_000


@dataclass(frozen=True)
class References:
    """``refs``: src, ref_id, key, loaded_at. ``targets``: key, loaded_at. ``deleted``: key."""

    refs: DataFrame
    targets: DataFrame
    deleted: DataFrame
    hot_rows: int = HOT_ROWS

    def __post_init__(self) -> None:
        refs = self.refs.where(F.col("key").isNotNull()).select("src", "ref_id", "key", "loaded_at", utc_month(F.col("loaded_at")).alias("period"))
        known = self.targets.select("key", F.lit(True).alias("here"), "loaded_at").unionByName(self.deleted.select("key", F.lit(False).alias("here"), F.lit(None).cast("timestamp").alias("loaded_at")))
        known = known.where(F.col("key").isNotNull()).groupBy("key").agg(F.max("here").alias("here"), F.min("loaded_at").alias("cut"))
        groups = refs.groupBy("key", "src", "period").agg(F.count(F.lit(1)).alias("n"), F.min("loaded_at").alias("earliest"), F.max("loaded_at").alias("latest"))
        groups = store(groups)
        least = max(self.hot_rows, -(-(groups.agg(F.sum("n")).first()[0] or 0) // MOST_HOT))
        hot = [k for k, _ in hot_keys(groups, "key", "n", least, MOST_HOT)]
        for name, value in (("_refs", refs), ("_known", known), ("_groups", groups), ("_hot", hot)):
            object.__setattr__(self, name, value)

    def _split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of hot keys, rows of the others."""
        is_hot = F.col("key").isin(self._hot) if self._hot else F.lit(False)
        return df.where(is_hot), df.where(~is_hot)

    def _faulty(self, groups: DataFrame, known: DataFrame) -> DataFrame:
        here = F.col("here")
        kind = F.when(here.isNull(), "missing").when(~here, "deleted").when(F.col("earliest") < F.col("cut"), "late")
        found = groups.join(known, "key", "left").withColumn("kind", kind).where(F.col("kind").isNotNull())
        return found.withColumn("mixed", (F.col("kind") == "late") & (F.col("latest") >= F.col("cut")))

    def _parts(self) -> list[tuple[DataFrame, DataFrame, bool]]:
        """References beside their faulty groups: those of hot keys, where any is faulty, with small groups; the others."""
        (hot_refs, cold_refs), (hot, cold), (known_hot, _) = map(self._split, (self._refs, self._groups, self._known))
        parts = [(cold_refs, self._faulty(cold, self._known), False)]
        if self._hot and not (faulty := self._faulty(hot, F.broadcast(known_hot))).isEmpty():
            # At most MOST_HOT keys times their tables and months.
            parts.append((hot_refs, faulty, True))
        return parts

    def rows(self) -> DataFrame:
        """src, ref_id, kind, period of each faulty row."""
        found = []
        for refs, groups, small in self._parts():
            groups = groups.select("key", "src", F.col("period").alias("__period"), "kind", "cut")
            on = (refs.key == groups.key) & (refs.src == groups.src) & refs.period.eqNullSafe(groups["__period"])
            rows = refs.join(F.broadcast(groups) if small else groups, on, "inner")
            found.append(rows.where((F.col("kind") != "late") | (F.col("loaded_at") < F.col("cut"))).select(refs.src, "ref_id", "kind", "period"))
        return reduce(DataFrame.unionByName, found)

    def counts(self) -> DataFrame:
        """src, period, kind, n of the faulty rows; only groups with late and good rows are counted row by row."""
        found = []
        for refs, groups, small in self._parts():
            found.append(groups.where(~F.col("mixed")).select("src", "period", "kind", "n"))
            mixed = groups.where("mixed").select("key", F.col("src").alias("__src"), F.col("period").alias("__period"), "kind", "cut")
            on = (refs.key == mixed.key) & (refs.src == mixed["__src"]) & (refs.period == mixed["__period"]) & (refs.loaded_at < mixed.cut)
            found.append(refs.join(F.broadcast(mixed) if small else mixed, on, "inner").select("src", "period", "kind", F.lit(1).cast("long").alias("n")))
        return reduce(DataFrame.unionByName, found).groupBy("src", "period", "kind").agg(F.sum("n").alias("n"))
