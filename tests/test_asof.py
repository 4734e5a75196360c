import random

import pytest

from tessera.operators.asof import OPEN, FactTree, Shard, _Throughout, active, as_known, route
from tests.conftest import rows, second

FACTS = "key string, value string, starts long, ends long, known timestamp, number long, event string"
EVENTS = "key string, event string, at long, number long, value string"


def brute(facts, events):
    found = {}
    for key, event, at, number, _ in sorted(events, key=lambda e: (e[3] is None, e[3])):
        if key is None or event is None or at is None or event in found:
            continue
        fit = [f for f in facts if f[0] == key and f[1] is not None and f[2] is not None and f[4] is not None and f[2] <= at and (f[3] is None or (f[3] > at and f[3] > f[2])) and f[4] <= second(at)]
        if fit:
            found[event] = max(fit, key=lambda f: (f[2], f[4], f[5]))[1]
    return sorted(found.items())


def test_tree_keeps_each_version():
    tree = FactTree([(10, 100, 200, 0), (20, 50, 300, 1), (20, 150, 160, 2)])
    assert [tree.find(9, 120), tree.find(10, 120), tree.find(20, 155), tree.find(20, 170), tree.find(20, 250), tree.find(20, 40), tree.find(99, 300)] == [-1, 0, 2, 0, 1, -1, -1]


@pytest.mark.parametrize("shard_rows", [5, 40, 20_000])
def test_random_histories(spark, shard_rows):
    rng = random.Random(shard_rows)
    facts, events = [], []
    for i in range(700):
        key, starts = rng.choice(["hot"] * 6 + list("abcd")), rng.randrange(1_000, 4_000)
        facts.append((key, f"v{i}", starts, rng.choice([None, starts + rng.randrange(-20, 900)]), second(starts + rng.randrange(-300, 400)), i, "clash"))
    for i in range(400):
        events.append((rng.choice(["hot"] * 6 + list("abcde")), f"e{i % 390}", 0, i, "clash"))
    events = [(k, e, 1_000 + (int(e[1:]) * 37) % 3_500, n, v) for k, e, _, n, v in events]
    found = as_known(spark.createDataFrame(facts, FACTS).repartition(3), spark.createDataFrame(events, EVENTS).repartition(3), shard_rows=shard_rows)
    assert rows(found) == brute(facts, events)


def bulk(kind, n, rng):
    """Facts of one key (starts, ends, known in seconds) that arrive or end in ways that would crowd one shard."""
    for i in range(n):
        starts = rng.randrange(1_000, 900_000)
        if kind == "open":
            yield starts, OPEN, starts + rng.randrange(1_000)
        elif kind == "one load":
            yield starts, rng.choice([OPEN, rng.randrange(900_001, 1_000_000)]), 900_000
        elif kind == "one end":
            yield starts, 950_000, starts + rng.randrange(1_000)
        else:  # each within the one before, all known at once
            yield 900_000 - i // 2, 900_001 + i // 2, 900_000


@pytest.mark.parametrize("kind, n", [("open", 1_000_000), ("one load", 1_000_000), ("one end", 300_000), ("nested", 300_000)])
def test_no_shard_of_a_hot_entity_is_crowded(kind, n):
    rng = random.Random(kind)
    facts = [("hot", active(s, k * 1_000_000), e, s, k * 1_000_000, i, "v") for i, (s, e, k) in enumerate(bulk(kind, n, rng))]
    times = sorted([min(t, 1_099_999) for f in facts for t in f[1:3] if t < OPEN] + [rng.randrange(1_000, 1_100_000) for _ in range(n)])
    cuts = {"hot": [*sorted(set(times[:: len(times) * 20_000 // n // 2])), 1_100_000]}
    throughout, rows = {"hot": _Throughout(len(cuts["hot"]))}, []
    for at in range(0, n, 50_000):
        rows += route(facts[at : at + 50_000], cuts, throughout)
    sizes = [0] * len(cuts["hot"])
    for row in rows:
        sizes[row[1]] += 1
    for shard, _ in throughout["hot"].shards():
        sizes[shard] += 1
    assert len(sizes) > 20 and max(sizes) < 40_000


@pytest.mark.parametrize("kind", ["open", "one load", "one end", "nested"])
@pytest.mark.parametrize("shard_rows", [15, 20_000])
def test_crowded_histories(spark, kind, shard_rows):
    rng = random.Random(kind)
    facts = [("hot", f"v{i}", s, None if e == OPEN else e, second(k), i, None) for i, (s, e, k) in enumerate(bulk(kind, 400, rng))]
    events = [("hot", f"e{i}", rng.choice([rng.randrange(1_000, 1_100_000), rng.randrange(899_700, 900_300)]), i, None) for i in range(300)]
    found = as_known(spark.createDataFrame(facts, FACTS).repartition(3), spark.createDataFrame(events, EVENTS).repartition(3), shard_rows=shard_rows)
    assert rows(found) == brute(facts, events)


def test_a_shard_holds_one_run():
    rng, shard, most = random.Random(3), Shard(100), 0
    facts = sorted(((s := rng.randrange(100_000), s + rng.randrange(1, 5_000), s + rng.randrange(500)) for _ in range(20_000)), key=lambda f: f[2])
    for i, (starts, ends, known) in enumerate(facts):
        shard.fact(ends, starts, known * 1_000_000, i, "v")
        shard.event(known * 1_000_000, known, i, "e")
        most = max(most, len(shard.facts))
        if shard.full():
            list(shard.answers())
            shard.go_on(active(starts, known * 1_000_000))
    assert most < 1_000


def test_nulls_ties_and_late_arrivals(spark):
    facts = [
        ("a", "first", 10, None, second(5), 1, None), ("a", "tie", 10, None, second(5), 2, None), ("a", "late", 12, None, second(1_000), 3, None),
        ("a", None, 13, None, second(1), 4, None), (None, "x", 1, None, second(1), 5, None), ("a", "x", None, None, second(1), 6, None),
        ("a", "x", 14, None, None, 7, None), ("a", "x", 14, 14, second(1), 8, None), ("b", "known at the start", 20, 21, second(20), 9, None),
    ]
    events = [("a", "e1", 15, 1, None), ("a", "e1", 15, 2, None), ("a", None, 15, 3, None), (None, "e2", 15, 4, None), ("a", "e3", None, 5, None), ("a", "e4", 9, 6, None), ("b", "e5", 20, 7, None), ("b", "e6", 21, 8, None), ("c", "e7", 15, 9, None)]
    found = as_known(spark.createDataFrame(facts, FACTS), spark.createDataFrame(events, EVENTS))
    assert rows(found) == [("e1", "tie"), ("e5", "known at the start")]


def test_absurd_times(spark):
    far = 2**63 - 1
    facts = [("a", "x", -far, None, second(5), 1, None), ("a", "y", 10, far, second(5), 2, None)]
    events = [("a", "e1", far, 1, None), ("a", "e2", far - 1, 2, None), ("a", "e3", -far, 3, None)]
    assert rows(as_known(spark.createDataFrame(facts, FACTS), spark.createDataFrame(events, EVENTS))) == [("e2", "y")]


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], FACTS), spark.createDataFrame([("a", "e", 1, 1, None)], EVENTS)
    assert rows(as_known(none, some)) == rows(as_known(none, some.limit(0))) == []
