import sqlite3

import pytest

from tessera.plans.engine import Engine
from tessera.plans.errors import SourceFault
from tessera.sources.catalog import discover
from tessera.sources.sqlite import sqlite, write_back
from tests import world
from tests.conftest import rows


@pytest.fixture
def file(tmp_path):
    path = tmp_path / "Plant A.db"
    with sqlite3.connect(path) as db:
        db.executescript("""
            create table tool (code text primary key, name text unique, owner text, weight real, used int, ok boolean);
            create index i on tool (owner);
            create unique index partial on tool (used) where used > 1000;
            create table "odd name" (a int, b int, unique (a, b));
        """)
        db.executemany("insert into tool values (?, ?, ?, ?, ?, ?)", [(f"T{i:03}", f"tool {i}", "ann" if i % 2 else None, i / 2, i, i % 3 == 0) for i in range(100)] + [("T100", 7, "5", "heavy", 3.0, 1)])
    db.close()
    return str(path)


def test_reads_in_ranges_with_filters(spark, file):
    held = sqlite(spark, file, partition_rows=30)
    df = held.read("tool")
    assert held.names() == ["odd name", "tool"] and held.unique["tool"] == {"code", "name"} and held.primary["tool"] == "code" and "odd name" not in held.unique
    assert df.rdd.getNumPartitions() == 4 and df.count() == 101
    assert rows(df.where("used >= 97 and owner is not null").select("code")) == [("T097",), ("T099",)]
    assert rows(df.where("owner = '5'").select("code", "name", "weight", "used", "ok")) == [("T100", "7", None, 3, True)]
    assert rows(df.where("name in ('7', 'tool 1') and ok").select("code")) == [("T100",)]
    assert held.read("odd name").count() == 0
    with pytest.raises(SourceFault):
        sqlite(spark, file + "x")


def test_partitions_follow_rows_not_row_ids(spark, tmp_path):
    from tessera.functions.ids import Snowflake

    path, made = str(tmp_path / "far.db"), Snowflake(clock_ms=lambda: 1_735_689_600_000)
    with sqlite3.connect(path) as db:
        db.executescript("create table far (id integer primary key, v text); create table bare (k text primary key, v int) without rowid; create table none (a int)")
        db.executemany("insert into far values (?, ?)", [(1, "first"), (2, "second")] + [(made(), f"v{i}") for i in range(98)])
        db.executemany("insert into bare values (?, ?)", [(f"k{i}", i) for i in range(10)])
    db.close()
    held = sqlite(spark, path, partition_rows=25)
    assert held.read("far").rdd.glom().map(len).collect() == [25] * 4
    assert held.read("far").where("id <= 2").count() == 2 and held.read("far").agg({"id": "max"}).first()[0] > 1 << 52
    assert held.read("bare").where("v >= 5").count() == 5 and held.read("bare").rdd.getNumPartitions() == 1
    assert held.read("none").count() == 0


def test_queries_and_write_back(spark, file):
    properties = {"code": {"type": "string"}, "name": {"type": "string"}, "owner": {"type": "string"}}
    actions = {
        "give": {"pre": {"$exists": True}, "effect": [{"update": {"object": "tool", "identity": {"from": "identity"}, "properties": {"owner": {"from": "request"}}}}]},
        "drop": {"effect": [{"delete": {"object": "tool", "identity": {"from": "identity"}}}]},
        "buy": {"effect": [{"create": {"object": "tool", "properties": {"code": {"from": "identity"}, "name": {"property": "owner", "from": "request"}}}}]},
    }
    tool = {"kind": "thing", "identity": "code", "properties": properties, "sources": {"base": {"connection": "plant", "table": "tool", "fields": {p: p for p in properties}}}, "actions": actions}
    engine = Engine(spark, {"object_types": {"tool": tool}}, clock=lambda: world.NOW)
    engine.sources.register("plant", sqlite(spark, file), test=True)
    assert engine.rows({"object": "tool", "filter": {"owner": "ann"}}).count() == 50
    ask = lambda *data: spark.createDataFrame(data, "request_id int, identity string, owner string")
    out = lambda batch: [(r["key"], r["outcome"]) for r in write_back(batch, {"plant": file})]
    late, stale = engine.plan_actions("tool", "give", ask((1, "T002", "bob"))), engine.plan_actions("tool", "give", ask((1, "T002", "eve")))
    stale.changes[0].rows = stale.changes[0].rows.cache()
    stale.changes[0].rows.count()
    assert out(late) == [("T002", "applied")]
    assert out(stale) == [("T002", "conflict")]
    assert out(engine.plan_actions("tool", "give", ask((1, "T002", "bob")))) == [("T002", "applied")]
    assert out(engine.plan_actions("tool", "drop", ask((1, "T003", None), (2, "none", None)))) == [("T003", "applied")]
    assert out(engine.plan_actions("tool", "buy", ask((1, "T004", "x"), (2, "N1", "new")))) == [("T004", "already"), ("N1", "applied")]
    assert engine.rows({"object": "tool", "identity": "N1", "properties": ["name"]}).first().name == "new" and engine.rows({"object": "tool"}).count() == 101


def test_discovery(tmp_path, file):
    (tmp_path / "2nd.db").touch()
    (tmp_path / "plant-a.db").touch()
    assert [n for n, _ in discover(str(tmp_path))] == ["s_2nd", "plant_a", "plant_a_2"]
