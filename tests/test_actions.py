import copy

import pytest
from pyspark.sql import functions as F

from tessera.plans.errors import Rejected
from tests import world
from tests.conftest import rows


@pytest.fixture(scope="module")
def e(spark):
    return world.engine(spark)


def requests(spark, *data, schema="request_id int, identity string, dept string"):
    return spark.createDataFrame([(*d, None)[: schema.count(",") + 1] for d in data], schema)


def ledger(batch):
    return sorted((r.request_id, r.source, r.op, r.key, r.outcome) for r in batch.ledger().collect())


def test_update_by_identity_and_rejections(spark, e):
    batch = e.plan_actions("equipment", "transfer", requests(spark, (1, "KX-5060", "D03"), (2, "KX-5061", "D99"), (3, "KX-5001", "D03"), (4, "nothing", "D03"), (5, "KX-5063", "D02")))
    # 2: no such department, 3: in transit, 4: unknown, 5: there already (the 14th device is in D02).
    assert sorted((r.request_id, r.stage) for r in batch.rejected.collect()) == [(2, "pre"), (3, "pre"), (4, "pre"), (5, "pre")]
    assert ledger(batch) == [(1, "device", "update", "KX-5060", "applied")]
    after = e.with_tables(batch.apply())
    assert after.rows({"object": "equipment", "identity": "KX-5060", "properties": ["dept"]}).first().dept == "D03"
    assert after.rows({"object": "equipment"}).count() == len(world.ALL)
    event = batch.notifications.first()
    assert event.properties == {"what": "KX-5060", "act": "transfer", "event_id": "KX-5060|transfer"} and event.to == ["desk"] and not event.delivered
    assert [(x.op, x.object_class, x.target, x.line_id) for x in event.lines] == [("update", "equipment", "KX-5060", "KX-5060|transfer#1")]


def test_conflicts_and_repeats(spark, e):
    batch = e.plan_actions("equipment", "transfer", requests(spark, (1, "KX-5060", "D03"), (2, "KX-5061", "D03")))
    device = e.sources.table("devices", "device")
    moved = e.with_tables({("devices", "device"): device.withColumn("dept_id", F.when(F.col("serial_no") == "KX-5060", "D01").when(F.col("serial_no") == "KX-5061", "D03").otherwise(F.col("dept_id")))})
    batch.table = moved.table
    assert ledger(batch) == [(1, "device", "update", "KX-5060", "conflict"), (2, "device", "update", "KX-5061", "already")]


def test_link_inserts_only_what_leads_to_the_stage(spark, e):
    batch = e.plan_actions("equipment", "convert", requests(spark, (1, "KX-5333"), (2, "KX-5060"), (3, "KX-5333")))
    assert sorted((r.request_id, r.stage) for r in batch.rejected.collect()) == [(2, "pre")]
    # The asset source alone would leave it in transit, so its row goes in after the device's, not before.
    assert ledger(batch) == [
        (1, "asset", "insert", "KX-5333", "applied"), (1, "base", "insert", "KX-5333", "applied"), (1, "device", "insert", "KX-5333", "applied"),
        (3, "asset", "insert", "KX-5333", "already"), (3, "base", "insert", "KX-5333", "already"), (3, "device", "insert", "KX-5333", "already"),
    ]
    after = e.with_tables(batch.apply())
    row = after.rows({"object": "equipment", "identity": "KX-5333", "properties": ["name", "status", "in_warranty"]}).first()
    assert (row.name, row.status, row.in_warranty) == ("item 5333", "in_service", True)
    assert after.rows({"object": "card", "identity": "KX-5333"}).first().expiry == world.NOW + 365 * world.DAY
    again = after.plan_actions("equipment", "convert", requests(spark, (1, "KX-5333")))
    assert [r.stage for r in again.rejected.collect()] == ["pre"] and ledger(again) == []


def test_delete_everywhere(spark, e):
    batch = e.plan_actions("equipment", "remove", requests(spark, (1, "KX-5055"), (2, "KX-9101"), (3, "nothing")))
    assert ledger(batch) == [(1, "asset", "delete", "KX-5055", "applied"), (1, "device", "delete", "KX-5055", "applied"), (1, "purchase", "delete", "KX-5055", "applied"), (2, "asset", "delete", "KX-9101", "applied")]
    assert e.with_tables(batch.apply()).rows({"object": "equipment"}).count() == len(world.ALL) - 2


def test_targets_by_filter(spark, e):
    batch = e.plan_actions("equipment", "close_repairs", requests(spark, (1, "KX-5055"), (2, "KX-5056")))
    assert [(r.request_id, r.stage) for r in batch.rejected.collect()] == [(2, "effect")]  # its repair is closed
    assert ledger(batch) == [(1, "base", "update", "R-1", "applied")]
    assert e.with_tables(batch.apply()).rows({"object": "repair", "identity": "R-1"}).first().ended_at == world.NOW


def test_one_target_set_for_all_requests(spark):
    model = copy.deepcopy(world.MODEL)
    for name, test in (("retire", {"mark": "scrapped"}), ("nobody", {"mark": "none such"})):
        model["object_types"]["equipment"]["actions"][name] = {"effect": [{"update": {"object": "equipment", "filter": test, "properties": {"dept": {"from": "request"}}}}]}
    e = world.engine(spark, model)
    batch = e.plan_actions("equipment", "retire", requests(spark, (2, "KX-5060", "D02"), (1, "KX-5061", "D01")))
    assert batch.rejected.count() == 0 and ledger(batch) == [(1, "device", "update", s, "applied") for s in world.SCRAPPED]
    assert {r.dept for r in e.with_tables(batch.apply()).rows({"object": "equipment", "filter": {"status": "scrapped"}}).collect()} == {"D01"}
    assert e.plan_actions("equipment", "nobody", requests(spark, (1, "x", "y"), (2, "z", "y"))).rejected.count() == 2


def test_mutex(spark, e):
    batch = e.plan_actions("equipment", "muddle", requests(spark, (1, "KX-5060")))
    assert [(r.request_id, r.stage) for r in batch.rejected.collect()] == [(1, "axiom")] and ledger(batch) == []


def test_waves(spark, e):
    after, batches = e.run_actions("equipment", "transfer", requests(spark, (1, "KX-5060", "D03"), (2, "KX-5060", "D06"), (3, "KX-5062", "D01")))
    assert len(batches) == 2 and sorted((r.request_id, r.outcome) for r in e.ledger(batches).collect()) == [(1, "applied"), (2, "applied"), (3, "applied")]
    assert after.rows({"object": "equipment", "identity": "KX-5060", "properties": ["dept"]}).first().dept == "D06"
    _, none = e.run_actions("equipment", "transfer", requests(spark).limit(0))
    assert none == []


def test_many_waves_have_plans_alike(spark, e):
    depts = [world.DEPTS[i % 6] for i in range(7)]
    after, batches = e.run_actions("equipment", "transfer", requests(spark, *((i, "KX-5060", d) for i, d in enumerate(depts))))
    plan = lambda b: b.table(b.changes[0].source)._jdf.queryExecution().optimizedPlan().toString()
    assert len(batches) == 7 and len({plan(b).count("\n") for b in batches[1:]}) == 1
    want, kept = [], world.DEPTS[10 % 6]
    for i, d in enumerate(depts):
        want.append((i, "rejected" if d == kept else "applied"))
        kept = d
    assert sorted([(r.request_id, "rejected") for b in batches for r in b.rejected.collect()] + [(r.request_id, r.outcome) for r in e.ledger(batches).collect()]) == want
    assert after.rows({"object": "equipment", "identity": "KX-5060", "properties": ["dept"]}).first().dept == kept


def test_numbers_of_requests_by_ranges(spark):
    from tessera.operators.actions import numbered

    df = spark.range(0, 2_000, 1, 7).selectExpr("(id * 7919) % 2000 as request_id")
    found = rows(numbered(df, "request_id", "n"))
    assert found == sorted(((i, i) for i in range(2_000)), key=repr)
    plan = numbered(df, "request_id", "n")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_generated_identifiers(spark):
    model = copy.deepcopy(world.MODEL)
    repair = model["object_types"]["repair"]["properties"]
    repair["repair_no"]["generate"] = ["R-", {"date": "now/d", "format": "yyyyMMdd"}, "-", {"snowflake": True}, "-", {"uuid": "v7"}, "-", {"from": "identity"}]
    model["object_types"]["equipment"]["actions"]["report"] = {"effect": [{"create": {"object": "repair", "properties": {"repair_no": {"from": "generated"}, "serial_no": {"from": "identity"}, "started_at": "now", "ended_at": "request.a+1"}}}]}
    e = world.engine(spark, model)
    frame = spark.createDataFrame([(i, f"Q-{i}", i) for i in range(5_000)], "request_id int, identity string, a long")
    batch = e.plan_actions("equipment", "report", frame)
    made = rows(batch.changes[0].rows)
    assert made == rows(e.plan_actions("equipment", "report", frame.repartition(3)).changes[0].rows)
    keys = [r[1] for r in made]
    assert len(set(keys)) == 5_000 and all(k.startswith("R-20250101-") and k.endswith(f"-Q-{r[0]}") for k, r in zip(keys, made))
    assert len({k.split("-")[2] for k in keys}) == 5_000 and keys[0].split("-")[5][0] == "7"
    assert {r[-1] - r[0] for r in made} == {1}


def test_rejected_plans(spark, e):
    for cls, action in (("nothing", "x"), ("equipment", "nothing")):
        with pytest.raises(Rejected):
            e.plan_actions(cls, action, requests(spark))
    with pytest.raises(Rejected):
        e.plan_actions("equipment", "transfer", spark.createDataFrame([(1,)], "identity int"))
    with pytest.raises(Rejected):
        e.plan_actions("equipment", "transfer", requests(spark, (1, "x"), schema="request_id int, identity string"))
