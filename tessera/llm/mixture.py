"""Mixing sources to target weights.

Sizes are tokens, or any other measure of a document. Capped water-filling gives each source its amount of a stated total:
a source whose share would need more than its allowed repetitions is clamped there, and what is left goes to the others in
proportion to their shares, until nothing more is clamped. The level of the others is all the driver sees, so sources may be
as many as there are. Without a total the mixture is the largest in which every target share is met exactly.

An amount is so many whole repetitions of all of a source's documents and one partial one. The partial one takes the
documents with the lowest seeded hashes until their sizes fill it: the cut is found by two histograms of hash prefixes
and the few documents of one last bucket, so no source is ever sorted or gathered, and it is met to within a document.

Defined results: sources compare in lower case and trimmed; documents of a null source or one without a target are left
out, as are documents of size 0 or null; a source with a target but without documents gets nothing and its share goes to
the others; repeated rows are documents of their own, taken or left together if their ids agree; a null target share counts
as 0, a null repetition limit as 1; empty tables give an empty mixture; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tokens import encode
from tessera.plans.shared import store

SEED = 20_240_229
#: Totals: what the targeted sources hold, once; as much as meets every share.
CORPUS, EXACT = "corpus", None
#: Bits of the hash, and of it what each of the two histograms looks at.
BITS, HEAD, NEXT = 60, 16, 16
#: Sources up to which their table is broadcast (a few MB); beyond, it is joined like any table.
BROADCAST_SOURCES = 50_000


def _name(c: str) -> Column:
    return F.nullif(F.lower(F.trim(F.col(c))), F.lit(""))


def hash_point(seed: int, doc_id: Column) -> Column:
    """A document's place in the seeded order: the first 60 bits of a digest, so that any system can say the same."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def water_level(sources: DataFrame, total: float | str | None) -> tuple[float, bool]:
    """The amount per unit of share of all sources that are not clamped, of ``sources`` (share, most, size), and whether
    those are few.

    Every round clamps the sources that the level of the round before would overdraw, and gives what is left to the rest.
    Few sources are added up here, more by Spark, in the same way.
    """
    active = sources.where((F.col("share") > 0) & (F.col("size") > 0) & (F.col("most") > 0)).select("share", "size", (F.col("most") * F.col("size")).cast("double").alias("limit"))
    rows = active.limit(BROADCAST_SOURCES + 1).collect()
    few = len(rows) <= BROADCAST_SOURCES
    if few:
        least, held = min((r.limit / r.share for r in rows), default=None), sum(r["size"] for r in rows)
    else:
        least, held = active.agg(F.min(F.col("limit") / F.col("share")), F.sum("size")).first()

    def clamp(level: float) -> tuple[float, float, int]:
        """What sources over the level take, the shares of the others, and how many are over it."""
        if few:
            over = [r.limit <= r.share * level for r in rows]
            return sum(r.limit for r, o in zip(rows, over) if o), sum(r.share for r, o in zip(rows, over) if not o), sum(over)
        over = F.col("limit") <= F.col("share") * F.lit(level)
        return tuple(active.agg(*(F.coalesce(F.sum(F.when(c, v)), F.lit(0)) for c, v in ((over, F.col("limit")), (~over, F.col("share")), (over, F.lit(1))))).first())

    if total is EXACT:
        return least or 0.0, few
    level, clamped, total = 0.0, -1, held or 0 if total == CORPUS else total
    while True:
        taken, weight, now = clamp(level)
        if not weight:
            return math.inf, few
        if now == clamped:
            return level, few
        level, clamped = max(level, (total - taken) / weight), now


class Mixture:
    """``documents``: doc_id, source, text. ``targets``: source, target_share, max_repeat.

    ``size``: a column of ``documents``; None: tokens. ``unit`` names it in the results.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, *, total: float | str | None = CORPUS, seed: int = SEED, size: Column | None = None, unit: str = "tokens") -> None:
        self.unit = unit
        if size is None:
            sized = encode(documents.select("doc_id", _name("source").alias("source"), "text"), ["doc_id", "source"], "text", only_counts=True).withColumnRenamed("n_tokens", "n")
        else:
            sized = documents.select("doc_id", _name("source").alias("source"), size.cast("long").alias("n"))
        self.sized = store(sized.where(F.col("source").isNotNull() & (F.col("n") > 0)).withColumn("point", hash_point(seed, F.col("doc_id"))))
        sizes = self.sized.groupBy("source").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("documents"))
        wanted = targets.select(_name("source").alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeat", F.lit(1)).alias("most"))
        wanted = wanted.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("share").alias("share"), F.max("most").alias("most"))
        plan = store(wanted.join(sizes, "source", "left").fillna(0, ["size", "documents"]))
        level, self.small = water_level(plan, total)
        limit = F.greatest(F.lit(0), F.col("most")) * F.col("size")
        plan = plan.withColumn("amount", F.when((F.col("share") > 0) & (F.col("size") > 0), F.least(limit.cast("double"), F.col("share") * F.lit(level))).otherwise(0.0))
        plan = plan.withColumn("epochs", F.when(F.col("size") > 0, F.col("amount") / F.col("size")).otherwise(0.0))
        plan = plan.withColumn("whole", F.least(F.floor(F.col("epochs") + 1e-12).cast("int"), F.greatest(F.lit(0), F.col("most"))))
        rest = F.col("amount") - F.col("whole") * F.col("size")
        plan = plan.withColumn("partial", F.when((F.col("whole") < F.col("most")) & (rest >= 0.5), rest).otherwise(0.0))
        #: source, share, most, size, documents, amount, epochs, whole, partial, upto: a row for each source.
        self.plan = store(plan.join(self._cuts(plan), "source", "left").fillna(-1, ["upto"]))

    def _beside(self, by_source: DataFrame) -> DataFrame:
        """The documents beside what is known of their source."""
        return self.sized.join(F.broadcast(by_source) if self.small else by_source, "source")

    def _cuts(self, plan: DataFrame) -> DataFrame:
        """source, upto: the hash up to which a source's documents take part in its partial repetition."""
        reached, rest = plan.where("partial > 0").select("source", F.lit(0).cast("long").alias("above"), F.col("partial").alias("left")), BITS
        for bits in (HEAD, NEXT):
            rest -= bits
            # From the bucket found so far, the next bits of the hash.
            inside = self._beside(reached).where(F.shiftright("point", rest + bits) == F.col("above"))
            # A source has at most 2**bits buckets, which bounds the window.
            by = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
            buckets = inside.groupBy("source", "left", F.shiftright("point", rest).alias("bucket")).agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(by))
            found = buckets.where(F.col("upto") >= F.col("left")).groupBy("source").agg(F.min(F.struct("bucket", (F.col("left") - F.col("upto") + F.col("n")).alias("left"))).alias("b"))
            reached = store(found.select("source", F.col("b.bucket").alias("above"), F.col("b.left").alias("left")))
        inside = self._beside(reached).where(F.shiftright("point", rest) == F.col("above"))
        by = Window.partitionBy("source").orderBy("point").rangeBetween(Window.unboundedPreceding, 0)
        last = inside.withColumn("reach", F.sum("n").over(by)).where(F.col("reach") - F.col("n") / 2 <= F.col("left")).groupBy("source").agg(F.max("point").alias("last"))
        return reached.join(last, "source", "left").select("source", F.coalesce("last", F.shiftleft("above", rest) - 1).alias("upto"))

    def documents(self) -> DataFrame:
        """doc_id, source, n_<unit>, repeats of every document in the mixture."""
        repeats = F.col("whole") + F.when(F.col("point") <= F.col("upto"), 1).otherwise(0)
        found = self._beside(self.plan.select("source", "whole", "upto"))
        return found.select("doc_id", "source", F.col("n").alias(f"n_{self.unit}"), repeats.alias("repeats")).where(F.col("repeats") > 0)

    def planned(self) -> DataFrame:
        """source, target_share, max_repeat, documents, <unit>, amount, epochs."""
        return self.plan.select("source", F.col("share").alias("target_share"), F.col("most").alias("max_repeat"), "documents", F.col("size").alias(self.unit), "amount", "epochs")

    def shares(self) -> DataFrame:
        """source, target_share, max_repeat, documents, <unit>, epochs, mixed_<unit>, reached_share."""
        mixed = self.documents().groupBy("source").agg(F.sum(F.col(f"n_{self.unit}") * F.col("repeats")).alias("mixed"))
        rows = store(self.planned().drop("amount").join(mixed, "source", "left").fillna(0, ["mixed"]))
        whole = rows.agg(F.sum("mixed")).first()[0] or 0
        return rows.withColumn("reached_share", F.col("mixed") / whole if whole else F.lit(0.0)).withColumnRenamed("mixed", f"mixed_{self.unit}")
