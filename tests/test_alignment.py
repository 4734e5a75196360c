import copy

import pytest

from tessera.functions.normalize import BY_NAME, RULES, pick_rule
from tessera.operators.integrate import key_trial, overlap
from tessera.plans import verdict
from tessera.plans.errors import InvalidModel, Rejected
from tessera.plans.model import Model
from tessera.sources.catalog import frames
from tests import world
from tests.conftest import rows


def split_model():
    """The world with one class per table."""
    m = {"object_types": {}, "link_types": {}}
    for name, connection, table, fields in (
        ("po_item", "purchases", "item", "name item_name sn sn"), ("device", "devices", "device", "name name serial_no serial_no dept dept_id mark status"), ("asset", "assets", "asset", "name asset_name sn sn"),
    ):
        words = fields.split()
        m["object_types"][name] = {"kind": "thing", "identity": "serial_no" if "serial_no" in words else "sn", "properties": {p: {"type": "string"} for p in words[::2]}, "sources": {name: {"connection": connection, "table": table, "fields": dict(zip(words[::2], words[1::2]))}}}
    return m


@pytest.fixture(scope="module")
def e(spark):
    return world.engine(spark, split_model())


def test_overlap(e, spark):
    assert rows(overlap(e, "po_item", "device")) == [("po_item", "device", "serial", len(world.BOUGHT), len(world.DEVICES), len(world.BOTH), len(world.BOTH) / len(world.BOUGHT))]
    with pytest.raises(Rejected):
        overlap(e, "asset", "asset")
    none = e.with_tables({("assets", "asset"): e.sources.table("assets", "asset").limit(0), ("devices", "device"): e.sources.table("devices", "device").limit(0)})
    assert rows(overlap(none, "asset", "device")) == [("asset", "device", "serial", 0, 0, 0, 0.0)]


def test_overlap_normalises(spark, e):
    data = spark.createDataFrame([("kx 5050",), ("KX5050",), ("kx-5051",), (None,), ("  ",), ("KX-999",)], "sn string").selectExpr("sn", "1 as asset_id", "'x' as asset_name")
    changed = e.with_tables({("assets", "asset"): data})
    assert rows(overlap(changed, "asset", "device"))[0][2:6] == ("serial", 3, len(world.DEVICES), 2)


def test_key_trial_and_suggestion(e):
    trial = [r.asDict() for r in key_trial(e, "po_item").collect()]
    best = {(r["candidate"], r["mate"], r["mate_key"]): (r["rows"], r["distinct_values"], r["unique_in_each"], r["hits"]) for r in trial}
    assert best["sn", "device", "serial_no"] == (len(world.BOUGHT), len(world.BOUGHT), True, len(world.BOTH)) and best["sn", "asset", "sn"][3] == len(world.BOTH)
    assert verdict.suggest_key(trial, "sn")[0] == "sn"
    assert verdict.suggest_key([], "sn")[0] is None
    assert verdict.suggest_key([{"candidate": "a", "unique_in_each": False, "hard": True, "hits": 5}], "a")[0] is None
    assert verdict.suggest_key([{"candidate": "a", "unique_in_each": True, "hard": False, "hits": 0}], "a")[0] == "a"


def test_candidates_of_keys(spark, e):
    from tessera.operators.integrate import key_candidates

    made = split_model()
    made["object_types"]["device"]["properties"] |= {"number": {"type": "number", "description": "编号"}, "tag_no": {"type": "string"}}
    made["object_types"]["device"]["sources"]["device"]["fields"] |= {"number": "dev_id", "tag_no": "status"}
    engine = world.engine(spark, made)
    names = lambda: [(c.name, c.hard) for c in key_candidates(engine, engine.model.object("device"))]
    assert names() == [("serial_no", False), ("tag_no", False)]  # a whole number is no candidate by its comment
    engine.sources.connections["devices"].unique = {"device": {"dev_id", "name"}}
    assert names() == [("name", True), ("serial_no", False), ("number", True), ("tag_no", False)]
    engine.sources.connections["devices"].primary = {"device": "dev_id"}
    assert ("number", True) not in names()
    broken = engine.with_tables({})
    broken.sources.connections["assets"] = type(engine.sources.connections["assets"])(lambda t: 1 / 0, lambda: ["asset"])
    assert {r.mate for r in key_trial(broken, "po_item", ["device"]).collect()} == {"device"}


def test_rules():
    assert [pick_rule(s).name for s in ([], ["SN-123", "ab 4567", "x"], ["138 1234 5678", "+8613912345678"], ["11010119900101123x"], ["a@b.c"], ["hello"])] == ["serial", "serial", "phone", "id_card", "email", "plain"]
    assert [BY_NAME[n].text(v) for n, v in (("serial", "sn-1 23"), ("phone", "+86 138-1234-5678"), ("id_card", "1 2x"), ("email", " A@B.c "), ("plain", " x "))] == ["SN123", "13812345678", "12X", "a@b.c", "x"]


def test_rules_as_columns(spark):
    from pyspark.sql import functions as F

    values = ["sn-1 23", "+86 138-1234-5678", " 86139", "1　2x", " A@B.c\t", None, "", "ß é"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for rule in RULES:
        assert [r[0] for r in df.select(rule.column(F.col("v"))).collect()] == [None if v is None else rule.text(v) for v in values]


def test_merge_then_query(spark, e):
    model = verdict.apply_verdict(e.model, "po_item", "device", verdict.SAME)
    model = verdict.apply_verdict(model, "po_item", "asset", verdict.OVERLAP)
    assert set(model.object_types) == {"po_item"} and list(model.object("po_item").sources) == ["po_item", "device", "asset"]
    made = world.engine(spark, model)
    assert made.rows({"object": "po_item"}).count() == len(world.ALL)
    assert made.rows({"object": "po_item", "identity": "KX-8001", "properties": ["name"]}).first().name == "device KX-8001"


def test_stages_then_a_further_stage(spark, e):
    model = verdict.apply_verdict(e.model, "po_item", "device", verdict.STAGE, {"from": "in_transit", "to": "in_service"})
    made = world.engine(spark, model)
    count = lambda m, s: m.rows({"object": "po_item", "filter": {"status": s}}).count()
    assert (count(made, "in_transit"), count(made, "in_service")) == (world.STAGES["in_transit"], len(world.DEVICES))
    assert model.object("po_item").actions["convert_to_in_service"]["effect"] == [{"link": "po_item_to_in_service"}]
    more = world.engine(spark, verdict.apply_verdict(model, "po_item", "asset", verdict.STAGE, {"from": "in_service", "to": "listed"}))
    assert [count(more, s) for s in ("in_transit", "in_service", "listed")] == [world.STAGES["in_transit"], len(world.OWN), len(world.BOTH + world.OFFICE)]
    with pytest.raises(InvalidModel):
        verdict.apply_verdict(Model.parse(split_model() | {"object_types": {k: v | {"properties": v["properties"] | {"status": {"type": "string"}}} for k, v in split_model()["object_types"].items()}}), "po_item", "device", verdict.STAGE)


def test_verdicts_without_effect(e):
    assert verdict.apply_verdict(e.model, "po_item", "device", verdict.SKIP) is e.model is verdict.apply_verdict(e.model, "po_item", "device", verdict.NAME_SIMILAR)


def test_actions_that_die_with_a_class():
    model = Model.parse(world.MODEL)
    actions = model.object("equipment").actions
    assert verdict.action_dies(model, "equipment", actions["convert"], "card") and not verdict.action_dies(model, "equipment", actions["convert"], "repair")
    assert verdict.action_dies(model, "equipment", actions["transfer"], "department") and verdict.action_dies(model, "equipment", actions["close_repairs"], "x", "serial_no")


def cls(name, *fields):
    return Model.parse({"object_types": {name: {"kind": "thing", "properties": {f: {"type": "string"} for f in fields}}}}).object(name)


def test_advice():
    a, b = cls("a_list", "x", "y", "z", "w"), cls("b_list", "x", "y", "z", "status")
    first = verdict.advise_by_schema(a, b)
    assert first.verdict == verdict.STAGE
    assert verdict.advise_by_schema(a, cls("b", "q")) is None and verdict.advise_by_schema(a, cls("a_list_old", "q")).verdict == verdict.NAME_SIMILAR
    assert verdict.advise_by_schema(a, cls("c", "x", "y", "z", "w")).verdict == verdict.SAME and verdict.advise_by_schema(a, cls("c", "x", "y", "q", "w")).verdict == verdict.OVERLAP
    by = lambda hits, rate, a_n=10: verdict.advise_by_overlap(first, a, b, a_n, 10, hits, rate).verdict
    assert [by(0, 0), by(0, 0, 0), by(9, 0.9), by(3, 0.3)] == [verdict.SAME, verdict.STAGE, verdict.STAGE, verdict.STAGE]


def test_pairs_after_a_merge():
    assert verdict.rewrite_pairs([("b", "c"), ("a", "c"), ("a", "b"), ("b", "d")], "a", "b", [("d", "a")]) == [("a", "c")]


def test_sources(spark):
    from tessera.plans.editing import draft_from_tables
    from tessera.sources.catalog import Sources

    held = Sources(spark)
    connection = frames({"person": spark.createDataFrame([(1, "13812345678", None), (2, "12345", "x@y.z")], "id int, phone string, email string")})
    connection.unique, connection.primary, connection.comments = {"person": {"phone"}}, {"person": "id"}, {"person": {"phone": "how to reach"}}
    held.register("crm", connection, test=True)
    held.register("broken", type(connection)(lambda t: 1 / 0, lambda: ["x"]))
    assert rows(held.sample("crm", "person")) == [(1, "1381******78", None), (2, "******", "******")]
    info = held.info("crm", "person")
    assert [(c.name, c.type, c.unique, c.pk) for c in info.columns] == [("id", "number", False, True), ("phone", "string", True, False), ("email", "string", False, False)]
    assert [(t.connection, bool(t.error)) for t in held.tables()] == [("crm", False), ("broken", True)]
    draft = draft_from_tables([info])
    assert draft["person"]["identity"] == "phone" and draft["person"]["sources"]["crm"]["pk"] == "id"
    Model.parse({"object_types": copy.deepcopy(draft)})
    with pytest.raises(Rejected):
        held.drop("crm", Model.parse({"object_types": draft}))
    with pytest.raises(Rejected):
        held.register("Bad name", connection)
    assert held.select_aggregate("crm", "person", [], {"n": __import__("pyspark.sql.functions", fromlist=["count"]).count("email")}).first().n == 1
