import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixture
from tessera.llm.mixture import CORPUS, EXACT, Mixture, water_level
from tessera.llm.queries import QUERIES
from tests.catalogue import TABLES, connection
from tests.conftest import rows

DOCUMENTS, TARGETS = "doc_id long, source string, text string, n_tokens int, repeats string", "source string, target_share double, max_repeat int, size int"


def brute(sizes, shares, most, total):
    """Amounts by the plain rule: clamp, give the rest to the others, again."""
    active, amounts = {s for s in shares if sizes.get(s, 0) > 0 and shares[s] > 0}, dict.fromkeys(shares, 0.0)
    limit = {s: most[s] * sizes[s] for s in active}
    if total is EXACT:
        total = min((limit[s] * sum(shares[x] for x in active) / shares[s] for s in active), default=0)
    while active:
        weight = sum(shares[s] for s in active)
        over = {s for s in active if total * shares[s] / weight >= limit[s] * (1 - 1e-12)}
        for s in over or active:
            amounts[s] = limit[s] if over else total * shares[s] / weight
        if not over:
            break
        total, active = max(0.0, total - sum(limit[s] for s in over)), active - over
    return amounts


def amounts(level, sizes, shares, most):
    return {s: min(most[s] * sizes[s], shares[s] * level) if sizes.get(s) else 0.0 for s in shares}


def test_water_filling(spark, monkeypatch):
    def filled(sizes, shares, most, total):
        table = spark.createDataFrame([(shares[s], most[s], sizes.get(s, 0)) for s in shares], "share double, most int, size long")
        return amounts(water_level(table, total)[0], sizes, shares, most)

    sizes, shares, most = {"a": 100, "b": 1_000, "c": 50}, {"a": 0.5, "b": 0.4, "c": 0.1}, {"a": 2, "b": 1, "c": 3}
    assert filled(sizes, shares, most, EXACT) == pytest.approx({"a": 200, "b": 160, "c": 40})
    # A larger total clamps a, then c; b takes what is left, up to its own limit.
    assert filled(sizes, shares, most, 600) == pytest.approx({"a": 200, "b": 320, "c": 80})
    assert filled(sizes, shares, most, 1_000) == pytest.approx({"a": 200, "b": 650, "c": 150})
    assert filled(sizes, shares, most, 9_999) == pytest.approx({"a": 200, "b": 1_000, "c": 150})
    assert filled(sizes, shares, most, CORPUS) == pytest.approx({"a": 200, "b": 800, "c": 150})
    assert filled({"a": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 9}, EXACT) == pytest.approx({"a": 10, "b": 0})
    assert filled({}, {"a": 1.0}, {"a": 1}, CORPUS) == {"a": 0.0}
    rng = random.Random(4)
    for n in (3, 40, 2_000):  # no number of sources is too many
        monkeypatch.setattr(mixture, "BROADCAST_SOURCES", 39)
        names = [f"s{i}" for i in range(n)]
        sizes, shares, most = {s: rng.randrange(1, 1_000) for s in names}, {s: rng.random() / n for s in names}, {s: rng.randrange(1, 5) for s in names}
        for total in (sum(sizes.values()), EXACT):
            assert filled(sizes, shares, most, total) == pytest.approx(brute(sizes, shares, most, total), abs=1e-6)


def corpus():
    rng = random.Random(5)
    data = []
    for i in range(900):
        source = rng.choice(["big"] * 6 + ["mid", "Mid ", "small"])
        data.append((i, source, " word" * rng.randrange(1, 60), 0, "clash"))
    return data + [(900, "big", None, 0, ""), (901, "mid", "", 0, ""), (902, None, "x", 0, ""), (903, "other", "x", 0, ""), (904, " ", "x", 0, "")]


@pytest.mark.parametrize("total", [EXACT, CORPUS, 20_000, 10**9])
def test_shares_and_caps(spark, total):
    targets = [("big", 0.2, 1, 0), ("MID", 0.5, 2, 0), ("small", 0.3, 4, 0), ("absent", None, None, 0), (None, 0.1, 1, 0)]
    data = corpus()
    made = Mixture(spark.createDataFrame(data, DOCUMENTS).repartition(3), spark.createDataFrame(targets, TARGETS), total=total)
    taken, shares = made.documents().collect(), {r.source: r for r in made.shares().collect()}
    size = {d[0]: d[2].count("word") for d in data if d[2]}
    limits = {"big": 1, "mid": 2, "small": 4}
    assert len({r.doc_id for r in taken}) == len(taken) and {r.source for r in taken} <= set(limits)
    mixed = dict.fromkeys(limits, 0)
    for r in taken:
        assert r.n_tokens == size[r.doc_id] and 1 <= r.repeats <= limits[r.source]
        mixed[r.source] += r.n_tokens * r.repeats
    assert {s: shares[s].mixed_tokens for s in limits} == mixed
    assert shares["absent"].mixed_tokens == 0 and shares["absent"].reached_share == 0
    for p in made.plan.collect():
        assert p.source == "absent" or abs(mixed[p.source] - p.amount) <= 31  # half of the longest document
        assert p.amount <= p.most * p["size"] + 1e-6
    by_source = {s: sum(size[d[0]] for d in data if d[0] in size and (d[1] or "").strip().lower() == s) for s in limits}
    want = brute(by_source, {"big": 0.2, "mid": 0.5, "small": 0.3}, limits, sum(by_source.values()) if total == CORPUS else total)
    assert {p.source: p.amount for p in made.plan.collect() if p.source != "absent"} == pytest.approx(want)
    assert total != CORPUS or 0 < sum(want[s] == limits[s] * by_source[s] for s in limits) < 3  # some are clamped, some are not
    if total is EXACT:
        for s, want in (("big", 0.2), ("mid", 0.5), ("small", 0.3)):
            assert shares[s].reached_share == pytest.approx(want, abs=0.01)
    if total == 10**9:
        assert all(r.repeats == limits[r.source] for r in taken)
    again = Mixture(spark.createDataFrame(data, DOCUMENTS).repartition(5), spark.createDataFrame(targets, TARGETS), total=total)
    assert rows(again.documents()) == sorted(map(tuple, taken), key=repr)


def test_another_seed_takes_others(spark):
    df, targets = spark.createDataFrame(corpus(), DOCUMENTS), spark.createDataFrame([("big", 1.0, 1, 0)], TARGETS)
    a, b = (Mixture(df, targets, total=3_000, seed=s) for s in (1, 2))
    assert rows(a.documents()) != rows(b.documents())
    assert all(abs(sum(r.n_tokens for r in m.documents().collect()) - 3_000) <= 31 for m in (a, b))


def test_very_many_sources_and_any_measure(spark, monkeypatch):
    monkeypatch.setattr(mixture, "BROADCAST_SOURCES", 10)
    data = [(i, f"s{i % 1_500}", "x" * (1 + i % 7), 0, "") for i in range(6_000)]
    targets = [(f"s{i}", 1 / 1_500, 1 + i % 3, 0) for i in range(1_500)]
    made = Mixture(spark.createDataFrame(data, DOCUMENTS), spark.createDataFrame(targets, TARGETS), size=F.length("text"), unit="chars")
    shares = {r.source: r for r in made.shares().collect()}
    assert len(shares) == 1_500 and sum(r.mixed_chars for r in shares.values()) == pytest.approx(sum(len(d[2]) for d in data), rel=0.1)
    assert all(r.mixed_chars <= r.max_repeat * r.chars for r in shares.values())


def test_reached_shares_agree_with_sql_over_the_ids(spark):
    """What p6 encodes is what p7 counts; the shares are added up once more, in SQL."""
    if not TABLES.exists():
        pytest.skip("needs the test tables")
    con = connection()
    ids = QUERIES["p6_ids"](spark, str(TABLES)).selectExpr("doc_id", "size(ids) as n").toPandas()
    taken = QUERIES["p7_mix"](spark, str(TABLES)).toPandas()
    con.register("ids", ids)
    con.register("taken", taken)
    assert con.execute("select count(*) from taken join ids using (doc_id) where n <> n_tokens").fetchone() == (0,)
    sums = con.execute("""select m.source, coalesce(sum(n * repeats), 0)::bigint, max(repeats) <= max(max_repeat) or max(repeats) is null
        from mix_target m left join taken t on t.source = lower(trim(m.source)) left join ids using (doc_id) group by 1 order by 1""").fetchall()
    shares = sorted((r.source, r.mixed_tokens, True) for r in QUERIES["p7_shares"](spark, str(TABLES)).collect())
    assert shares == sums


def test_empty_tables(spark):
    none, targets = spark.createDataFrame([], DOCUMENTS), spark.createDataFrame([("a", 1.0, 1, 0)], TARGETS)
    assert rows(Mixture(none, targets).documents()) == []
    assert [r.reached_share for r in Mixture(none, targets).shares().collect()] == [0.0]
    assert rows(Mixture(spark.createDataFrame(corpus(), DOCUMENTS), targets.limit(0)).documents()) == []
