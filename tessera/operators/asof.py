"""Attributes as known at event time: a bitemporal as-of lookup.

Every entity has facts with a valid time [valid_from, valid_to) and a known time (when the fact arrived). An event at
time t takes the fact with the latest valid_from among those valid at t and known by t, never one that came later.

A shard of an entity is a :class:`FactTree`: a search tree over valid_from, each node holding the latest valid_to below
it. Facts enter in the order in which they became known, and every insertion copies the path from the root to its leaf,
so each known time keeps a root of its own that shares all other nodes. An event picks the root of its time by binary
search, then descends from the right to the first fact that is still valid.

A shard's rows come in order of time, facts by the second in which they become active, and are taken in runs of
``shard_rows``: a run's tree answers its events, and what goes on to the next run are those facts alone that can still be
chosen, i.e. that rank above all others ending later. So no entity, however large, is held as a whole.

Most entities are one shard. A hot entity is also spread over tasks, split by time at quantiles of its own rows: an event
goes to the shard of its time; a fact goes to the shard where it becomes active and to the one where it ends, unless that
lies behind the entity's last event; of the facts active throughout a shard only the one with the latest valid_from can
ever be chosen there, so tasks keep that one per shard (a range maximum) and send no others. Facts that become active in
one second (one load) or end in one (or never) rank among themselves first: a task sends one only for the time in which
none that ranks higher is valid. So neither one load time nor open ends fill a shard. The thousand largest entities are
split; any other has less than a thousandth of all rows, which one task takes in runs.

Defined results: facts with a null key, attribute, valid_from or known time, or that end before they start, are never
chosen; a null valid_to is open; events with a null key, time or id have no row; facts with equal valid_from rank by
known time, then id (null last), then value; repeated events (same id) give one row, that of the lowest row number; empty tables give an
empty result; other columns of the inputs are ignored. Events of one second share a shard, which answers them one by one.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.shared import hot_keys

OPEN = 1 << 62
#: Times beyond this many seconds count as this when compared with known times, whose microseconds end there.
FAR = 9_000_000_000_000
#: Rows of a run, and of a hot entity's shard; entities that are split, shards in all, and shards of one entity at most,
#: which bounds what the driver sees. Fewer shards are larger ones, still taken run by run.
SHARD_ROWS, MOST_ENTITIES, MOST_SHARDS, MOST_CUTS = 20_000, 1_000, 500_000, 32_768
#: Facts of hot entities that a task ranks among themselves at a time.
RANKED = 50_000
ROWS_OUT = 20_000


class FactTree:
    """Persistent search tree over facts that are given in order of known time.

    ``facts``: (known, valid_from, valid_to, number) each; the position in ``facts`` is what :meth:`find` returns.
    """

    def __init__(self, facts: list[tuple[int, int, int, int]]) -> None:
        ranked = sorted(range(len(facts)), key=lambda i: (facts[i][1], facts[i][0], facts[i][3]))
        self.ranked, self.starts = ranked, [facts[i][1] for i in ranked]
        self.size = 1
        while self.size < len(facts):
            self.size *= 2
        # Node 0 is the empty tree. The three arrays hold a node's children and the latest end below it.
        self.left, self.right, self.latest = array("q", [0]), array("q", [0]), array("q", [-OPEN])
        self.known, self.roots = [], []
        rank, root = [0] * len(facts), 0
        for r, i in enumerate(ranked):
            rank[i] = r
        for i, (known, _, end, _) in enumerate(facts):
            root = self._insert(root, rank[i], end)
            self.known.append(known)
            self.roots.append(root)

    def _insert(self, node: int, rank: int, end: int) -> int:
        left, right, latest = self.left, self.right, self.latest
        root, lo, hi = len(latest), 0, self.size
        while True:
            new = len(latest)
            left.append(left[node])
            right.append(right[node])
            latest.append(max(latest[node], end))
            if hi - lo == 1:
                return root
            mid = (lo + hi) >> 1
            if rank < mid:
                node, hi = left[node], mid
                left[new] = new + 1
            else:
                node, lo = right[node], mid
                right[new] = new + 1

    def find(self, known: int, at: int) -> int:
        """The fact with the latest start by ``at`` that ends after it, as known at ``known``; -1: none."""
        version = bisect_right(self.known, known) - 1
        if version < 0:
            return -1
        below, left, right, latest = bisect_right(self.starts, at), self.left, self.right, self.latest
        todo = [(self.roots[version], 0, self.size)]
        while todo:
            node, lo, hi = todo.pop()
            if lo >= below or latest[node] <= at:
                continue
            if hi - lo == 1:
                return self.ranked[lo]
            mid = (lo + hi) >> 1
            todo.append((left[node], lo, mid))
            todo.append((right[node], mid, hi))
        return -1


FACT, EVENT = 0, 1
SCHEMA = "key string, shard int, tag int, known long, starts long, ends long, number long, value string"
ARROW = pa.schema([("key", pa.string()), ("shard", pa.int32()), ("tag", pa.int32()), ("known", pa.int64()), ("starts", pa.int64()), ("ends", pa.int64()), ("number", pa.int64()), ("value", pa.string())])


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


class _Throughout:
    """Of the facts active in whole runs of shards, the best one of each shard."""

    def __init__(self, shards: int) -> None:
        self.size = 1 << max(shards - 1, 0).bit_length()
        self.best: dict[int, tuple] = {}

    def cover(self, lo: int, hi: int, fact: tuple) -> None:
        """Shards lo up to, not including, hi."""
        lo, hi, best = lo + self.size, hi + self.size, self.best
        while lo < hi:
            for node in (lo,) * (lo & 1) + (hi - 1,) * (hi & 1):
                if node not in best or best[node] < fact:
                    best[node] = fact
            lo, hi = (lo + 1) >> 1, hi >> 1

    def shards(self) -> Iterator[tuple[int, tuple]]:
        for node in range(2, 2 * self.size):
            up, own = self.best.get(node >> 1), self.best.get(node)
            if up is not None and (own is None or own < up):
                self.best[node] = up
        return ((node - self.size, fact) for node, fact in self.best.items() if node >= self.size)


def active(starts: int, known: int) -> int:
    """The first second in which a fact is both valid and known (in microseconds)."""
    return max(starts, -(-known // 1_000_000))


def _needed(facts: list[tuple]) -> Iterator[tuple[tuple, int | None]]:
    """Of facts (ends, rank ...) in descending order: those that no other both outranks and outlasts, with the end of the
    next one, before which that one is chosen instead."""
    kept: list[tuple] = []
    for fact in facts:
        if not kept or fact[1:] > kept[-1][1:]:
            kept.append(fact)
    for i, fact in enumerate(kept):
        yield fact, kept[i + 1][0] if i + 1 < len(kept) else None


def route(facts: list[tuple], cuts: dict[str, list[int]], throughout: dict[str, _Throughout]) -> list[tuple]:
    """The rows that tell shards about facts (key, active, ends, starts, known, number, value) of hot entities.

    Facts active throughout shards are noted in ``throughout``. The last cut of an entity lies behind its last event.
    """
    rows, ending = [], {}
    facts.sort(reverse=True)
    for (key, since), group in groupby(facts, key=lambda f: f[:2]):
        at = cuts[key]
        for fact, better_until in _needed([f[2:] for f in group]):
            ends, starts, known, number, value = fact
            first = bisect_right(at, since if better_until is None else max(since, better_until))
            if first == len(at):
                continue
            rows.append((key, first, FACT, known, starts, ends, number, value))
            last = bisect_right(at, ends - 1)
            if last > first:
                throughout[key].cover(first + 1, last, (starts, known, number, value, ends))
                if last < len(at):
                    ending.setdefault((key, last), []).append(fact)
    for (key, last), group in ending.items():
        rows += ((key, last, FACT, known, starts, ends, number, value) for (ends, starts, known, number, value), _ in _needed(sorted(group, reverse=True)))
    return rows


def _shard(cuts: dict[str, list[int]]):
    """Gives the rows of hot entities their shards; all others pass as they are."""
    hot = pa.array(list(cuts), pa.string())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        throughout, facts = {key: _Throughout(len(c)) for key, c in cuts.items()}, []
        for batch in batches:
            is_hot = pc.is_in(batch.column(0), value_set=hot)
            yield pa.RecordBatch.from_arrays(batch.filter(pc.invert(is_hot)).columns, schema=ARROW)
            rows = []
            for key, _, tag, known, starts, ends, number, value in zip(*(c.to_pylist() for c in batch.filter(is_hot).columns)):
                if tag == FACT:
                    facts.append((key, active(starts, known), ends, starts, known, number, value))
                else:
                    rows.append((key, bisect_right(cuts[key], starts), tag, known, starts, ends, number, value))
            if len(facts) >= RANKED:
                rows += route(facts, cuts, throughout)
                facts = []
            if rows:
                yield _batch(ARROW, rows)
        yield _batch(ARROW, route(facts, cuts, throughout))
        for key, best in throughout.items():
            yield _batch(ARROW, [(key, shard, FACT, known, starts, ends, number, value) for shard, (starts, known, number, value, ends) in best.shards()])

    return run


FOUND = "event string, number long, value string"
FOUND_ARROW = pa.schema([("event", pa.string()), ("number", pa.int64()), ("value", pa.string())])


class Shard:
    """Answers the events of one shard, whose rows come in order of time, run by run."""

    def __init__(self, run_rows: int) -> None:
        self.run_rows, self.held, self.facts, self.events = run_rows, 0, [], []

    def fact(self, ends: int, starts: int, known: int, number: int, value: str) -> None:
        self.facts.append((ends, starts, known, number, value))

    def event(self, known: int, at: int, number: int, event: str) -> None:
        if self.facts:
            self.events.append((known, at, number, event))

    def full(self) -> bool:
        """Whether as many rows came as were held over, so that building trees anew costs a constant per row."""
        return len(self.facts) + len(self.events) - self.held >= max(self.run_rows, self.held)

    def answers(self) -> Iterator[tuple[str, int, str]]:
        if self.events:
            facts = sorted(self.facts, key=lambda f: (f[2], f[4]))
            tree = FactTree([(known, starts, ends, number) for ends, starts, known, number, _ in facts])
            for known, at, number, event in self.events:
                if (i := tree.find(known, at)) >= 0:
                    yield event, number, facts[i][4]

    def go_on(self, now: int) -> None:
        """Keeps the facts that an event at ``now`` or later can choose."""
        self.facts = [f for f, _ in _needed(sorted((f for f in self.facts if f[0] > now), reverse=True))]
        self.held, self.events = len(self.facts), []


def _look_up(run_rows: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, shard, out = None, Shard(run_rows), []
        for batch in batches:
            for key, part, tag, known, starts, ends, number, value in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, part) != current:
                    out += shard.answers()
                    current, shard = (key, part), Shard(run_rows)
                if tag == FACT:
                    shard.fact(ends, starts, known, number, value)
                else:
                    shard.event(known, starts, number, value)
                if shard.full():
                    out += shard.answers()
                    shard.go_on(active(starts, known) if tag == FACT else starts)
            if len(out) >= ROWS_OUT:
                yield _batch(FOUND_ARROW, out)
                out = []
        yield _batch(FOUND_ARROW, [*out, *shard.answers()])

    return run


def _at() -> Column:
    """When a row matters first, in whole seconds."""
    return F.greatest("starts", F.ceil(F.col("known") / 1_000_000))


def _cuts(rows: DataFrame, hot: list[tuple], shard_rows: int) -> dict[str, list[int]]:
    """Times at which each hot entity is split, ascending; quantiles of its rows' times and of its facts' ends, one for
    about ``shard_rows`` rows, up to the second behind its last event."""
    if not hot:
        return {}
    cuts = min(MOST_CUTS, hot[0][1] // shard_rows + 1)
    parts, exact = [i / cuts for i in range(1, cuts)] or [0.5], max(10_000, 4 * cuts)
    found = (
        rows.where(F.col("key").isin([k for k, _ in hot])).groupBy("key")
        .agg(F.percentile_approx(_at(), parts, exact).alias("at"), F.percentile_approx(F.when(F.col("tag") == FACT, F.col("ends")), parts, exact).alias("ends"),
             F.max(F.when(F.col("tag") == EVENT, F.col("starts"))).alias("last"), F.count(F.lit(1)).alias("n"))
    )
    step = F.greatest(F.lit(1), F.floor(F.lit(cuts * shard_rows) / F.col("n")).cast("int"))
    both = F.array_union(*(F.filter(c, lambda c, i: ((i + 1) % step == 0) & (c <= F.col("last"))) for c in (F.col("at"), F.coalesce("ends", F.array().cast("array<long>")))))
    found = found.select("key", F.array_sort(F.coalesce(both, F.array().cast("array<long>"))), F.coalesce(F.col("last"), F.lit(-OPEN)))
    return {k: [*c, last + 1] for k, c, last in found.collect()}


def as_known(facts: DataFrame, events: DataFrame, *, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per event that has a fact: event, value.

    ``facts``: key, value (strings), starts, ends (seconds), known (timestamp), number. ``events``: key, event (strings),
    at (seconds), number.
    """
    f = facts.select("key", F.lit(0).alias("shard"), F.lit(FACT).alias("tag"), F.unix_micros("known").alias("known"), "starts", F.coalesce("ends", F.lit(OPEN)).alias("ends"), F.coalesce("number", F.lit(-OPEN)).alias("number"), "value")
    f = f.where(F.col("key").isNotNull() & F.col("value").isNotNull() & F.col("known").isNotNull() & (F.col("ends") > F.col("starts")))
    f = f.where(F.col("ends") > F.ceil(F.col("known") / 1_000_000))  # known only when it was over: never chosen
    e = events.select("key", F.lit(0).alias("shard"), F.lit(EVENT).alias("tag"), (F.greatest(F.least("at", F.lit(FAR)), F.lit(-FAR)) * 1_000_000).alias("known"), F.col("at").alias("starts"), F.lit(0).cast("long").alias("ends"), "number", F.col("event").alias("value"))
    e = e.where(F.col("key").isNotNull() & F.col("starts").isNotNull() & F.col("value").isNotNull())
    rows = f.unionByName(e)
    hot = hot_keys(rows, "key", None, 2 * shard_rows, MOST_ENTITIES)
    cuts = _cuts(rows, hot, max(shard_rows, sum(n for _, n in hot) // MOST_SHARDS))
    if cuts:
        rows = rows.mapInArrow(_shard(cuts), SCHEMA)
    found = rows.repartition("key", "shard").sortWithinPartitions("key", "shard", _at(), "tag").mapInArrow(_look_up(shard_rows), FOUND)
    return found.groupBy("event").agg(F.min(F.struct("number", "value")).alias("first")).select("event", F.col("first.value").alias("value"))
