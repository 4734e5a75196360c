import random
from collections import Counter

import pytest

from tessera.operators.references import References
from tests.conftest import rows, second

DAY = 86_400


def brute(refs, targets, deleted):
    first = {}
    for k, at in targets:
        if k is not None:
            first.setdefault(k, []).append(at)
    found = []
    for src, number, key, at in refs:
        if key is None:
            continue
        if key not in first:
            kind = "deleted" if key in {k for k, in deleted} else "missing"
        else:
            known = [x for x in first[key] if x is not None]
            kind = "late" if at is not None and known and at < min(known) else None
        if kind:
            found.append((src, number, kind, at.strftime("%Y-%m") if at else None))
    return sorted(found, key=repr)


def make(spark, refs, targets, deleted, hot):
    return References(
        spark.createDataFrame(refs, "src string, ref_id long, key string, loaded_at timestamp").repartition(3).selectExpr("*", "'clash' as kind", "1 as period", "2 as cut"),
        spark.createDataFrame(targets, "key string, loaded_at timestamp").selectExpr("*", "'x' as here"), spark.createDataFrame(deleted, "key string").selectExpr("*", "1 as loaded_at"), hot_rows=hot,
    )


@pytest.mark.parametrize("hot", [1, 30, 10_000])
def test_rows_and_counts(spark, hot):
    rng = random.Random(hot)
    keys = ["hot"] * 10 + ["gone"] * 5 + [f"k{i}" for i in range(30)] + [None]
    refs = [(rng.choice("xy"), i, rng.choice(keys), rng.choice([None, second(rng.randrange(400) * DAY)])) for i in range(900)]
    targets = [(k, second(rng.randrange(300) * DAY)) for k in keys if k not in ("gone", "k3", "k4")] + [("k5", None)]
    deleted = [("gone",), ("k3",), ("k3",), ("k7",), (None,)]
    made, want = make(spark, refs, targets, deleted, hot), brute(refs, targets, deleted)
    assert rows(made.rows()) == want
    counts = Counter((src, period, kind) for src, _, kind, period in want)
    assert rows(made.counts()) == sorted(((*k, n) for k, n in counts.items()), key=repr)


def test_empty_tables(spark):
    refs = [("x", 1, "a", second(0)), ("x", 1, "a", second(0)), ("x", 2, None, None)]
    assert rows(make(spark, refs, [], [], 10).rows()) == [("x", 1, "missing", "1970-01"), ("x", 1, "missing", "1970-01")]
    assert rows(make(spark, [], [("a", None)], [("b",)], 10).counts()) == []
