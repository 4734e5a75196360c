import copy
import itertools

import pytest
from pyspark.sql import functions as F

from tessera.plans.errors import InvalidModel, Rejected, SourceFault
from tessera.plans.predicates import column_value, compare, literal_value, two_valued
from tests import world
from tests.conftest import rows, second


@pytest.fixture(scope="module")
def e(spark):
    return world.engine(spark)


def n(e, **request):
    return e.rows({"object": "equipment", "properties": ["serial_no"]} | request).count()


def one(spark, data, schema, properties, fields, **more):
    """An engine over one or two frames of a class."""
    from tessera.plans.engine import Engine
    from tessera.sources.catalog import frames

    sources = {f"s{i}": {"connection": "c", "table": f"t{i}", "fields": f, **more} for i, f in enumerate(fields)}
    made = Engine(spark, {"object_types": {"x": {"kind": "thing", "identity": "k", "properties": properties, "sources": sources}}}, clock=lambda: world.NOW)
    made.sources.register("c", frames({f"t{i}": spark.createDataFrame(d, s) for i, (d, s) in enumerate(zip(data, schema))}))
    return made


def test_stages_and_totals(e):
    assert n(e) == len(world.ALL)
    assert {s: n(e, filter={"status": s}) for s in ("in_service", "in_transit", "scrapped")} == {s: k for s, k in world.STAGES.items() if s}
    assert n(e, filter={"status": {"ne": "scrapped"}}) == world.STAGES["in_service"] + world.STAGES["in_transit"]  # those without a stage meet no condition
    found = dict(rows(e.rows({"object": "equipment", "aggregate": {"group_by": ["status"], "metrics": [{"count": "*"}]}})))
    assert found == world.STAGES
    assert e.rows({"object": "equipment", "filter": {"status": "in_service"}, "aggregate": {"group_by": ["dept"], "metrics": [{"count": "*"}]}}).agg(F.sum("count")).first()[0] == world.STAGES["in_service"]


def test_the_first_source_names(e):
    assert rows(e.rows({"object": "equipment", "identity": "KX-5055", "properties": ["name", "status"]})) == [("item 5055", "in_service")]


def test_relations(e):
    with_dept = world.tables(e.spark)["devices"]["device"].where("dept_id is not null").count()
    assert n(e, filter={"$link": {"belongs_to": True}}) == with_dept
    assert n(e, filter={"$link": {"belongs_to": False}}) == len(world.ALL) - with_dept
    assert n(e, filter={"in_warranty": True}) == len(world.IN_WARRANTY) and n(e, filter={"in_warranty": False}) == len(world.ALL - world.IN_WARRANTY)
    assert n(e, filter={"movable": True}) == sum(world.STATUS[s] == "in_service" for s in world.IN_WARRANTY)
    assert n(e, filter={"$link": {"under_repair": {"ended_at": {"gt": "now"}}}}) == 1
    assert n(e, filter={"$link": {"converted": True}}) == len(set(world.BOUGHT) & set(world.DEVICES))
    assert e.rows({"object": "department", "filter": {"$link": {"has_equipment": {"$link": {"covered_by": {"expiry": {"lt": "now"}}}}}}}).count() > 0
    valid = {"valid_from": {"lte": "2025-06-01"}, "valid_to": {"gt": "2025-06-01"}}
    found = e.rows({"object": "equipment", "identity": "KX-5060", "properties": ["serial_no"], "expand": [{"relation": "assignments", "properties": ["asgn_no"], "filter": valid, "expand": [{"relation": "of_department", "properties": ["dept_name"]}]}]}).first()
    assert [(a.asgn_no, [d.dept_name for d in a.of_department]) for a in found.assignments] == [("A-1", ["dept D04"])]
    assert e.rows({"object": "equipment", "identity": "KX-9101", "expand": [{"relation": "belongs_to"}, {"relation": "converted", "properties": ["name"]}]}).first().belongs_to == []


def test_order_and_limit(e):
    found = e.query({"object": "equipment", "properties": ["serial_no"], "order": {"serial_no": "desc"}, "limit": 5}).df.collect()
    assert [r[0] for r in found] == sorted(world.ALL)[:-6:-1]
    assert e.query({"object": "equipment", "properties": ["serial_no"]}).df.count() == len(world.ALL)
    made = e.query({"object": "equipment", "properties": ["serial_no", "dept"], "order": {"dept": "desc"}, "limit": 3, "expand": [{"relation": "belongs_to", "properties": ["dept_id"]}]})
    assert [r.dept for r in made.df.collect()] == [None] * 3 and made.path
    plan = e.query({"object": "equipment", "properties": ["serial_no"], "order": {"serial_no": "asc"}}).df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_expansions_agree_from_few_and_from_all(e):
    nested = [{"relation": "has_equipment", "properties": ["serial_no"], "expand": [{"relation": "covered_by", "properties": ["expiry"]}, {"relation": "under_repair", "properties": ["repair_no"]}]}]
    request = {"object": "department", "properties": ["dept_id"], "filter": {"dept_id": {"in": ["D06", "D03"]}}, "expand": nested}
    flat = lambda df: sorted((r.dept_id, x.serial_no, tuple(c.expiry for c in x.covered_by), tuple(c.repair_no for c in x.under_repair)) for r in df.collect() for x in r.has_equipment)
    few = flat(e.query(request).df)
    assert few == flat(e.rows(request)) and any(c for _, _, c, _ in few) and any(r for *_, r in few)


def test_null_in_the_first_source_stays(spark):
    made = one(spark, [[("1", None), ("3", "c")], [("1", "x"), ("2", "y")]], ["k string, v string"] * 2, {"k": {"type": "string"}, "v": {"type": "string"}}, [{"k": "k", "v": "v"}] * 2)
    assert rows(made.rows({"object": "x"})) == [("1", None), ("2", "y"), ("3", "c")]


def test_undefined_is_not_null(spark):
    made = one(spark, [[("1",)], [("2", None), ("3", "x")]], ["k string", "k string, v string"], {"k": {"type": "string"}, "v": {"type": "string"}}, [{"k": "k"}, {"k": "k", "v": "v"}])
    keys = lambda f: [r[0] for r in rows(made.rows({"object": "x", "properties": ["k"], "filter": f}))]
    assert keys({"v": None}) == ["2"] and keys({"v": {"ne": "x"}}) == ["2"] and keys({"v": {"ne": None}}) == ["3"] and keys({"v": {"in": [None]}}) == []


def test_blank_and_repeated_keys(spark):
    data = [(None, 1), ("", 2), ("\t", 3), ("　", 4), ("A", 6), ("A", 5), (" A", 7)]
    made = one(spark, [data], ["k string, v int"], {"k": {"type": "string"}, "v": {"type": "number"}}, [{"k": "k", "v": "v"}])
    assert rows(made.rows({"object": "x"})) == [(" A", 7), ("A", 5)]


def test_number_keys_align_with_texts(spark):
    made = one(spark, [[(1.0, "a"), (2.5, "b")], [("1", "c"), ("9", "d")]], ["k double, v string", "k string, v string"], {"k": {"type": "string"}, "v": {"type": "string"}}, [{"k": "k", "v": "v"}] * 2)
    assert sorted(r.v for r in made.rows({"object": "x"}).collect()) == ["a", "b", "d"]


def test_dates(spark):
    data = [("1", "2024-13-99"), ("2", "2024-02-01"), ("3", "2024-02-01 08:00:00"), ("4", "2024-02-01T08:00:00+08:00"), ("5", "text"), ("6", None)]
    made = one(spark, [data], ["k string, at string"], {"k": {"type": "string"}, "at": {"type": "date"}}, [{"k": "k", "at": "at"}])
    keys = lambda c: [r[0] for r in rows(made.rows({"object": "x", "properties": ["k"], "filter": {"at": c}}))]
    assert keys("2024-02-01") == ["2", "4"]
    assert keys({"gt": "2024-02-01"}) == ["3", "6"] and keys({"lte": "2024-02-01"}) == ["2", "4"]
    assert keys({"lt": None}) == ["1", "2", "3", "4", "5"] and keys({"gte": None}) == ["6"] and keys("text") == ["5"]
    with pytest.raises(Rejected):
        keys("2024-02-30")


def holds(a, op, e, date):
    """The table of conditions, in plain Python. ``a``, ``e``: None or a value; ``a`` defined."""
    if op == "in":
        return a is not None and any(type(x) is type(a) and x == a for x in e)
    if op == "eq":
        return a is None and e is None or a is not None and type(a) is type(e) and a == e
    if op == "ne":
        return not holds(a, "eq", e, date)
    if op == "contains":
        return a is not None and e is not None and str(e) in str(a)
    if date and a is None:
        return op in ("gt", "gte")
    if date and e is None:
        return op in ("lt", "lte")
    if type(a) is not int or type(e) is not int:
        return False
    return {"lt": a < e, "lte": a <= e, "gt": a > e, "gte": a >= e}[op]


def test_the_whole_table_of_conditions(spark):
    kinds = {"n": ("int", [None, 1, 2]), "t": ("string", [None, "1", "b"]), "b": ("boolean", [None, True, False])}
    literals, columns, wanted = [None, 1, 2, "1", "b", True], [], []
    for (kind, (sql, values)), op, literal, date in itertools.product(kinds.items(), ("eq", "ne", "lt", "lte", "gt", "gte", "contains", "in"), literals, (False, True)):
        df = spark.createDataFrame([], f"{kind} {sql}")
        for v in values:
            actual = column_value(F.lit(v).cast(sql), df.schema[0].dataType)
            if op == "contains" and (isinstance(v, bool) or isinstance(literal, bool)):
                continue
            expected = [literal_value(literal), literal_value(2)] if op == "in" else literal_value(literal)
            columns.append(two_valued(compare(actual, op, expected, date)).alias(f"c{len(columns)}"))
            wanted.append(((kind, v, op, literal, date), holds(v, op, [literal, 2] if op == "in" else literal, date)))
    found = spark.range(1).select(*columns).first()
    assert [(k, w) for (k, w), f in zip(wanted, found) if w != f] == []


def test_aggregates_of_nothing_and_of_nulls(spark):
    made = one(spark, [[("1", "g", None), ("2", "g", None), ("3", None, 5.0)]], ["k string, g string, v double"], {"k": {"type": "string"}, "g": {"type": "string"}, "v": {"type": "number"}}, [{"k": "k", "g": "g", "v": "v"}])
    metrics = [{m: "v"} for m in ("sum", "avg", "min", "max", "count")]
    found = made.rows({"object": "x", "aggregate": {"group_by": ["g"], "metrics": metrics}})
    assert found.columns == ["g", "sum_v", "avg_v", "min_v", "max_v", "count_v"]
    assert rows(found) == [("g", 0.0, None, None, None, 0), (None, 5.0, 5.0, 5.0, 5.0, 1)]
    assert rows(made.rows({"object": "x", "filter": {"k": "none"}, "aggregate": {"metrics": [{"sum": "v"}, {"count": "*"}]}})) == [(0.0, 0)]


@pytest.mark.parametrize(
    "request_",
    [
        {"object": "nothing"}, {"object": "equipment", "properties": ["nothing"]}, {"object": "equipment", "filter": {"nothing": 1}}, {"object": "equipment", "filter": {"$link": {"nothing": True}}},
        {"object": "equipment", "filter": {"name": {"between": 1}}}, {"object": "equipment", "filter": {"name": {"eq": [1]}}}, {"object": "equipment", "filter": {"name": {"in": 1}}}, {"object": "equipment", "filter": {"name": ["a"]}},
        {"object": "equipment", "order": {"dept": "asc"}, "properties": ["name"]}, {"object": "equipment", "order": {"name": "asc", "dept": "asc"}}, {"object": "equipment", "limit": 0}, {"object": "equipment", "limit": 1001},
        {"object": "equipment", "aggregate": {"metrics": [{"median": "name"}]}}, {"object": "equipment", "aggregate": {"metrics": [{"count": "*"}, {"count": "name"}]}}, {"object": "equipment", "aggregate": {"metrics": [{"sum": "*"}]}},
        {"object": "equipment", "aggregate": {"metrics": [{"count": "*"}]}, "expand": [{"relation": "belongs_to"}]}, {"object": "equipment", "filter": {"$exists": True}}, {"object": "equipment", "filter": {"$request": {}}},
        {"object": "equipment", "filter": {"$link": {"belongs_to": {"dept_id": "D01"}}}}, {"object": "equipment", "filter": {"$link": {"converted": {"name": "x"}}}}, {"object": "equipment", "expand": [{"relation": "converted", "filter": {"name": "x"}}]},
        {"object": "equipment", "filter": {"name": "now-1x"}}, {"object": "equipment", "filter": {"name": "now/M"}}, {"object": "equipment", "filter": {"name": {"from": "identity"}}}, {"object": "equipment", "surprise": 1},
        {"object": "equipment", "filter": {"$link": {"belongs_to": {"$link": {"has_equipment": {"$link": {"belongs_to": {"$link": {"has_equipment": True}}}}}}}}},
        {"object": "equipment", "expand": [{"relation": "belongs_to", "expand": [{"relation": "has_equipment", "expand": [{"relation": "belongs_to", "expand": [{"relation": "has_equipment"}]}]}]}]},
    ],
)
def test_rejections_come_before_any_job(e, request_):
    with pytest.raises(Rejected):
        e.query(request_)


def test_expressions_and_plain_words(e):
    assert n(e, filter={"name": "nowadays"}) == 0
    assert e.rows({"object": "card", "filter": {"expiry": {"gte": "now-6d", "lt": "now-6d+1s"}}}).count() == len(world.LAPSED)
    assert e.rows({"object": "repair", "filter": {"started_at": {"gte": "now/w"}}}).count() == 1  # weeks start on a Thursday: 2024-12-26


def test_source_faults_are_no_rejections(spark):
    model = copy.deepcopy(world.MODEL)
    model["object_types"]["card"]["sources"]["base"]["table"] = "absent"
    with pytest.raises(SourceFault):
        world.engine(spark, model).query({"object": "card"})
    model["object_types"]["card"]["sources"]["base"]["connection"] = "absent"
    with pytest.raises(Rejected):
        world.engine(spark, model).query({"object": "card"})


def test_identity_and_filters_reach_the_scan(spark, tmp_path):
    from tessera.plans.engine import Engine
    from tessera.sources.catalog import files

    spark.range(100).selectExpr("id", "id * 2 as v", "id as unused").write.parquet(str(tmp_path / "a.parquet"))
    spark.range(50).selectExpr("id as key", "id * 3 as w").write.parquet(str(tmp_path / "b.parquet"))
    sources = {"a": {"connection": "f", "table": "a", "fields": {"k": "id", "v": "v"}, "unique": True}, "b": {"connection": "f", "table": "b", "fields": {"k": "key", "w": "w"}, "unique": True}}
    made = Engine(spark, {"object_types": {"x": {"kind": "thing", "identity": "k", "properties": {p: {"type": "number"} for p in "kvw"}, "sources": sources}}})
    made.sources.register("f", files(spark, str(tmp_path)))
    plan = lambda r: made.rows({"object": "x", **r})._jdf.queryExecution().executedPlan().toString()
    by_key = plan({"identity": 7})
    assert "EqualTo(id,7)" in by_key and "EqualTo(key,7)" in by_key
    narrow = plan({"properties": ["k", "v"], "filter": {"v": {"gte": 10}}})
    assert "GreaterThanOrEqual(v,10)" in narrow and "unused" not in narrow and "FullOuter" not in narrow
    assert made.rows({"object": "x", "filter": {"w": 9}}).first().asDict() == {"k": 3, "v": 6, "w": 9}


@pytest.mark.parametrize(
    ("path", "value"),
    [
        (("equipment", "identity"), "nothing"), (("equipment", "identity"), "status"), (("equipment", "properties", "status", "derived", 0, "when"), {"nowhere": True}),
        (("equipment", "properties", "status", "derived", 0, "when"), {"device": {"nothing": 1}}), (("equipment", "properties", "in_warranty", "derived"), {"nothing": 1}),
        (("equipment", "properties", "in_warranty", "derived"), {"movable": True}), (("equipment", "sources", "asset", "fields"), {"name": "asset_name"}), (("equipment", "sources", "asset", "fields", "status"), "x"),
        (("equipment", "kind"), "idea"), (("card", "properties", "expiry", "type"), "decimal"), (("equipment", "actions", "remove", "effect"), []), (("equipment", "actions", "transfer", "inform", 0, "to"), ["nobody"]),
    ],
)
def test_models_that_contradict_themselves(spark, path, value):
    model = copy.deepcopy(world.MODEL)
    at = model["object_types"]
    for p in path[:-1]:
        at = at[p]
    at[path[-1]] = value
    with pytest.raises(InvalidModel):
        world.engine(spark, model)


def test_timestamps_compare_by_the_second(spark):
    made = one(spark, [[("1", second(100)), ("2", None)]], ["k string, at timestamp"], {"k": {"type": "string"}, "at": {"type": "date"}}, [{"k": "k", "at": "at"}])
    assert rows(made.rows({"object": "x", "properties": ["k"], "filter": {"at": {"lte": 100}}})) == [("1",)]
