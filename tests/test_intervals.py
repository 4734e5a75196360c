import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators.intervals import EVEN, IntervalMap, _cut, interval_gaps, interval_periods, slot_end, slot_of
from tests.conftest import rows


def brute(intervals):
    """Continuous periods by sorting; their gaps lie between them."""
    periods = []
    for lo, hi in sorted(intervals):
        if periods and lo <= periods[-1][1]:
            periods[-1][1] = max(periods[-1][1], hi)
        else:
            periods.append([lo, hi])
    return [tuple(p) for p in periods]


@given(st.integers(-(2**62), 2**62), st.integers(20, 30))
@settings(max_examples=300, deadline=None)
def test_slots_follow_one_another(t, bits):
    slot = slot_of(t, bits)
    assert slot_end(slot - 1, bits) <= t < slot_end(slot, bits)
    assert slot_of(slot_end(slot, bits), bits) == slot + 1


def test_old_and_far_times_have_slots_of_their_own():
    """A hot entity's history of any age spreads over slots; all of time has a bounded number of parts."""
    for year in (900, 1200, 1810, 1935, 1970, 1999, 2050, 2900):
        t = (year - 1970) * 31_556_952
        assert len({slot_of(t + i * 86_400, 24) for i in range(3_650)}) >= 18
    assert len(list(_cut(-(2**62), 2**62, 24, 2**62))) < 4_200 and len(list(_cut(EVEN - 5, 2**62, 24, EVEN + 9))) == 2


INTERVALS = st.lists(st.tuples(st.integers(0, 60), st.integers(1, 12)).map(lambda p: (p[0], p[0] + p[1])), max_size=40)


@given(INTERVALS)
@settings(max_examples=300, deadline=None)
def test_map_equals_sorting(intervals):
    held = IntervalMap()
    for i in intervals:
        held.add(*i)
    assert list(held.periods()) == brute(intervals)


@given(INTERVALS)
@settings(max_examples=200, deadline=None)
def test_changes_add_up_to_the_gaps(intervals):
    held, gaps = IntervalMap(), set()
    for i in intervals:
        closed, opened = held.change(*i)
        assert set(closed) <= gaps and not set(opened) & gaps
        gaps = gaps - set(closed) | set(opened)
        assert gaps == set(held.gaps())


@pytest.mark.parametrize("bits", [5, 12, 24])
def test_random_intervals_over_slots(spark, bits):
    rng, at = random.Random(bits), 1_400_000_000
    data = []
    for key in ("a", "b", "c", "hot"):
        for _ in range(2_000 if key == "hot" else 30):
            lo = at + rng.randrange(0, 3_000 if bits == 5 else 40_000_000)
            data.append((key, lo, lo + rng.randrange(1, 9 if bits == 5 else 400_000)))
    df = spark.createDataFrame(data, "k string, lo long, hi long").repartition(5)
    want = {k: brute([(lo, hi) for x, lo, hi in data if x == k]) for k in ("a", "b", "c", "hot")}
    assert rows(interval_periods(df, ["k"], F.col("lo"), F.col("hi"), slot_bits=bits)) == sorted(((k, *p) for k, ps in want.items() for p in ps), key=repr)
    gaps = [(k, a[1], b[0]) for k, ps in want.items() for a, b in zip(ps, ps[1:])]
    assert rows(interval_gaps(df, ["k"], F.col("lo"), F.col("hi"), slot_bits=bits)) == sorted(gaps, key=repr)


def test_nulls_ties_open_ends_and_clashing_names(spark):
    data = [
        ("a", 10, 20, "x"), ("a", 10, 20, "x"), ("a", 20, 30, "x"),  # repeated; touching
        ("a", 31, None, "x"), ("a", 40, 50, "x"),  # open: covers what follows
        ("b", None, 5, "x"), ("b", 7, 7, "x"), ("b", 9, 8, "x"), (None, 1, 2, "x"),  # no intervals
        ("c", -5, 3, "x"), ("c", 4, 5_000_000_000, "x"), ("c", 6_000_000_000, 6_000_000_001, "x"),  # outside of all slots
    ]
    df = spark.createDataFrame(data, "k string, lo long, hi long, __lo string").withColumn("gap_from", F.lit(1))
    assert rows(interval_gaps(df, ["k"], F.col("lo"), F.col("hi"))) == [("a", 30, 31), ("c", 3, 4), ("c", 5_000_000_000, 6_000_000_000)]
    assert rows(interval_periods(df, ["k"], F.col("lo"), F.col("hi"))) == [("a", 10, 30), ("a", 31, None), ("c", -5, 3), ("c", 4, 5_000_000_000), ("c", 6_000_000_000, 6_000_000_001)]


def test_maps_are_handed_out_early(spark, monkeypatch):
    from tessera.operators import intervals

    for name in ("FLUSH_ENTITIES", "FLUSH_PIECES", "FLUSH_MAP", "ROWS_OUT"):
        monkeypatch.setattr(intervals, name, 3)
    rng = random.Random(9)
    data = [(rng.choice("ab"), lo := rng.randrange(3_000), lo + rng.randrange(1, 5)) for _ in range(800)]
    df = spark.createDataFrame(data, "k string, lo long, hi long").repartition(3)
    want = sorted(((k, *p) for k in "ab" for p in brute([(lo, hi) for x, lo, hi in data if x == k])), key=repr)
    assert rows(interval_periods(df, ["k"], F.col("lo"), F.col("hi"))) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "k string, lo long, hi long")
    assert rows(interval_gaps(df, ["k"], F.col("lo"), F.col("hi"))) == rows(interval_periods(df, ["k"], F.col("lo"), F.col("hi"))) == []
