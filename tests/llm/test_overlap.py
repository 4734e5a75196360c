import random

import numpy as np
import pytest

from tessera.llm import overlap
from tessera.llm.overlap import Cooccurrence, overlapping, overlaps
from tests.conftest import rows

SCHEMA = "scope int, name string, item string, a string, n long"


def brute(data):
    sets = {}
    for scope, name, item, *_ in data:
        if scope is not None and name is not None:
            sets.setdefault(scope, {}).setdefault(name, set())
            if item is not None:
                sets[scope][name].add(item)
    found = []
    for scope, by in sets.items():
        for a in by:
            for b in by:
                if a < b:
                    hit, most = len(by[a] & by[b]), max(len(by[a]), len(by[b]))
                    found.append((scope, a, b, len(by[a]), len(by[b]), hit, hit / most if most else 0.0))
    return sorted(found, key=repr)


def data(n=3_000, sets=9):
    rng = random.Random(n)
    return [(rng.choice([1, 1, 2, None]), rng.choice([None, "big", "big", *(f"s{i}" for i in range(sets))]), rng.choice([None, "all over", f"i{rng.randrange(200)}"]), "clash", 1) for _ in range(n)]


def test_figures_of_all_pairs(spark):
    found = data() + [(3, "blank", None, "", 0), (3, "other", None, "", 0), (4, "alone", "x", "", 0)]
    df = spark.createDataFrame(found, SCHEMA).repartition(4)
    out = overlaps(df, "scope", "name", "item").select("scope", "a", "b", "count_a", "count_b", "count_hit", "rate")
    assert rows(out) == brute(found)
    assert rows(overlapping(df, "scope", "name", "item", 0.6).select("scope", "a", "b")) == sorted((x[:3] for x in brute(found) if x[6] >= 0.6), key=repr)


@pytest.mark.parametrize(("tile", "block", "cells"), [(7, 3, 10), (1 << 13, 1_024, 8_000_000), (64, 2, 50)])
def test_blocks_and_early_sums(spark, monkeypatch, tile, block, cells):
    for name, value in (("TILE_ROWS", tile), ("BLOCK", block), ("MOST_CELLS", cells)):
        monkeypatch.setattr(overlap, name, value)
    found = data(1_000, 12)
    out = overlaps(spark.createDataFrame(found, SCHEMA).repartition(3), "scope", "name", "item").select("scope", "a", "b", "count_a", "count_b", "count_hit", "rate")
    assert rows(out) == brute(found)


def test_matrix_grows_with_late_sets():
    rng, held, incidence = np.random.default_rng(0), Cooccurrence(), np.zeros((9_000, 40), np.int64)
    for r in range(9_000):
        some = rng.choice(2 + r * 38 // 9_000, size=rng.integers(0, 3), replace=False)
        incidence[r, some] = 1
        held.add(f"{c:02}" for c in some)
    want = incidence.T @ incidence
    found = {(int(a), int(b)): n for a, b, n in held.counts()}
    assert found == {(a, b): int(want[a, b]) for a in range(40) for b in range(a, 40) if want[a, b]}


def test_empty_table(spark):
    assert rows(overlaps(spark.createDataFrame([], SCHEMA), "scope", "name", "item")) == []
    assert rows(overlapping(spark.createDataFrame([], SCHEMA), "scope", "name", "item", 0.1)) == []
