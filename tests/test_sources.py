import json
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.plans.engine import Engine
from tessera.plans.errors import SourceFault
from tessera.sources.catalog import files, jdbc, read_comments, save_tables
from tests.conftest import rows

TOOL = {
    "kind": "thing", "identity": "code", "properties": {"code": {"type": "string"}, "owner": {"type": "string"}, "status": {"type": "enum"}},
    "sources": {"base": {"connection": "plant", "table": "tool", "fields": {"code": "code", "owner": "owner"}}},
    "actions": {"give": {"pre": {"$exists": True}, "effect": [{"update": {"object": "tool", "identity": {"from": "identity"}, "properties": {"owner": {"from": "request"}}}}]}},
}


def test_folders_in_and_out(spark, tmp_path):
    spark.createDataFrame([("a", "x", 1), ("b", None, 2)], "code string, owner string, more int").write.parquet(str(tmp_path / "tool.parquet"))
    (tmp_path / "comments.json").write_text(json.dumps({"tool": {"owner": "who has it"}}))
    engine = Engine(spark, {"object_types": {"tool": TOOL}})
    engine.sources.register("plant", files(spark, str(tmp_path)), test=True)
    assert [(c.name, c.comment) for t in engine.sources.tables() for c in t.columns] == [("code", None), ("owner", "who has it"), ("more", None)]
    batch = engine.plan_actions("tool", "give", spark.createDataFrame([(1, "b", "y")], "request_id int, identity string, owner string"))
    with pytest.raises(SourceFault):
        save_tables(batch.apply(), {})
    assert save_tables(batch.apply(), {"plant": str(tmp_path)}) == [f"{tmp_path}/tool.parquet"]
    assert rows(engine.sources.table("plant", "tool")) == [("a", "x", 1), ("b", "y", 2)]
    assert sorted(p.name for p in tmp_path.iterdir() if p.is_dir()) == ["tool.parquet"]


def test_comments_beside_a_source():
    assert read_comments(None) == ("missing", {})
    for text, state in ((b'{"t": {}}', "ok"), (b"[1]", "corrupt"), (b"{", "corrupt")):
        assert read_comments(text)[0] == state


def test_folders_by_any_address(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    for folder in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}"):
        held = files(spark, folder)
        assert held.names() == ["t"] and held.read("t").count() == 3
    assert files(spark, f"{tmp_path}/none").names() == []


@pytest.fixture
def database(spark):
    """A database in this process's memory, by a driver that Spark brings along."""
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    jvm = spark.sparkContext._jvm
    jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register("org.apache.derby.iapi.jdbc.AutoloadedDriver")
    held = jvm.java.sql.DriverManager.getConnection(url)
    run = held.createStatement()
    run.execute("create table TOOL (CODE varchar(9) primary key, OWNER varchar(9), WEIGHT double, USED int not null unique)")
    run.execute("create table PAIR (A int not null, B int not null, primary key (A, B))")
    for i in range(50):
        run.execute(f"insert into TOOL values ('T{i:02}', {'null' if i % 5 == 0 else chr(39) + 'o' + str(i % 3) + chr(39)}, {i / 2}, {i})")
    held.close()
    return url


def test_databases(spark, database):
    held = jdbc(spark, database, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver", schema="APP")
    assert held.names() == ["PAIR", "TOOL"] and held.primary == {"TOOL": "CODE"} and held.unique["TOOL"] == {"CODE", "USED"} and "PAIR" not in held.unique
    fields = {"code": "CODE", "owner": "OWNER", "weight": "WEIGHT", "used": "USED"}
    properties = {"code": {"type": "string"}, "owner": {"type": "string"}, "weight": {"type": "number"}, "used": {"type": "number"}}
    engine = Engine(spark, {"object_types": {"tool": {"kind": "thing", "identity": "used", "properties": properties, "sources": {"base": {"connection": "plant", "table": "TOOL", "fields": fields, "unique": True}}}}})
    engine.sources.register("plant", held, test=True)
    assert [(c.name, c.unique, c.pk) for c in engine.sources.info("plant", "TOOL").columns] == [("CODE", True, True), ("OWNER", False, False), ("WEIGHT", False, False), ("USED", True, False)]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = engine.rows({"object": "tool", "properties": ["code"], "filter": {"used": {"gte": 40}, "owner": "o1"}})
    assert rows(found) == [("T43",), ("T46",), ("T49",)] and "USED >= 40" in plan(found) and "OWNER = 'o1'" in plan(found)
    # The database adds up; only groups cross over.
    sums = engine.rows({"object": "tool", "filter": {"used": {"gte": 10}}, "aggregate": {"group_by": ["owner"], "metrics": [{"count": "*"}, {"sum": "used"}, {"max": "weight"}]}})
    assert "PushedAggregates: [COUNT(*), SUM(USED), MAX(WEIGHT)]" in plan(sums) and "PushedGroupByExpressions: [OWNER]" in plan(sums)
    want = {}
    for i in range(10, 50):
        n, total, most = want.get(None if i % 5 == 0 else f"o{i % 3}", (0, 0, 0))
        want[None if i % 5 == 0 else f"o{i % 3}"] = n + 1, total + i, max(most, i / 2)
    assert {r[0]: tuple(r[1:]) for r in sums.collect()} == want
    direct = engine.sources.select_aggregate("plant", "TOOL", [], {"n": F.count(F.lit(1)), "most": F.max("USED")}, "OWNER is not null")
    assert rows(direct) == [(40, 49)] and "PushedAggregates: [COUNT(*), MAX(USED)]" in plan(direct)


def test_class_without_sources_and_notes(spark):
    bare = TOOL | {"sources": {}, "actions": {}}
    engine = Engine(spark, {"object_types": {"tool": bare}})
    assert rows(engine.rows({"object": "tool"})) == [] and engine.rows({"object": "tool"}).columns == ["code", "owner", "status"]
    assert rows(engine.rows({"object": "tool", "filter": {"owner": None}, "aggregate": {"metrics": [{"count": "*"}, {"sum": "owner"}]}})) == [(0, 0.0)]
    notes = engine.query({"object": "tool", "aggregate": {"metrics": [{"sum": "owner"}]}}).path
    assert any("no number" in n for n in notes)
