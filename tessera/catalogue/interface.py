"""Queries that show the rest of the interface: actions and their gates, sources, models and their edits, evidence, records.

Those over tables have plain SQL; those about models and records have the rows they must give, written out.
"""

from __future__ import annotations

import shutil
import sqlite3
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalogue.reference import _EQUIPMENT, _ORDERS, _values
from tessera.catalogue.retail import MODEL, NOW, engine
from tessera.catalogue.tables import read
from tessera.functions.dates import format_utc
from tessera.functions.ids import SNOWFLAKE_EPOCH_MS
from tessera.functions.normalize import BY_NAME
from tessera.operators import integrate
from tessera.plans import editing, verdict
from tessera.plans.catalog import Workspace, workspaces
from tessera.plans.engine import Engine
from tessera.plans.errors import Rejected
from tessera.plans.filters import describe
from tessera.plans.model import Model, lineage, properties_of_column, same_structure
from tessera.plans.scripted import RETAIL_SCRIPT
from tessera.plans.service import Service
from tessera.plans.shared import ensure_checkpoint_dir
from tessera.plans.workingcopy import unpack
from tessera.sources.catalog import Sources, files, frames, jdbc
from tessera.sources.sqlite import sqlite

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str):
    def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name], ORACLE[name] = run, sql
        return run

    return add


def _told(name: str, schema: str, wanted: list[tuple]):
    """A query whose rows are worked out without tables; ``wanted`` is what they must be."""

    def add(run: Callable[[SparkSession, str], list[tuple]]) -> Callable:
        QUERIES[name], ORACLE[name] = lambda spark, at: spark.createDataFrame(run(spark, at), schema), _values(schema, wanted)
        return run

    return add


def _outcome(run: Callable[[], object]) -> str:
    try:
        run()
    except Rejected as e:
        return type(e).__name__
    return "accepted"


def _folder(spark: SparkSession) -> Path:
    """A folder of this run's own in the shared one, for files and records."""
    found = Path("/" + ensure_checkpoint_dir(spark).removeprefix("file:").lstrip("/")) / f"files-{uuid.uuid4().hex}"
    found.mkdir(parents=True)
    return found


# Sources

_PLAIN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "department", "device", "disposal", "assignment", "repair")
_KIND = "case when column_type in ('VARCHAR') then 'string' when column_type = 'BOOLEAN' then 'boolean' when column_type like 'TIMESTAMP%' or column_type = 'DATE' then 'date' else 'number' end"


@_query("source_columns", " union all ".join(f"select '{t}' as table_name, column_name, {_KIND} as kind from (describe {t})" for t in _PLAIN))
def _source_columns(spark: SparkSession, at: str) -> DataFrame:
    sources = Sources(spark)
    sources.register("retail", files(spark, at), test=True)
    found = [(t.table, c.name, c.type) for t in sources.tables() if t.table in _PLAIN for c in t.columns]
    return spark.createDataFrame(found, "table_name string, column_name string, kind string")


@_query("select_aggregate", "select l_returnflag, count(*) as n, max(l_quantity) as most, min(l_extendedprice) as least from lineitem where l_quantity > 10 group by 1")
def _select_aggregate(spark: SparkSession, at: str) -> DataFrame:
    return engine(spark, at).sources.select_aggregate("retail", "lineitem", ["l_returnflag"], {"n": F.count(F.lit(1)), "most": F.max("l_quantity"), "least": F.min("l_extendedprice")}, F.col("l_quantity") > 10)


@_query("sample_masked", "select n_nationkey, n_name, case when length(n_name) <= 6 then '******' else substring(n_name, 1, 4) || '******' || right(n_name, 2) end as mobile_no from nation")
def _sample_masked(spark: SparkSession, at: str) -> DataFrame:
    """A sample of as many rows as there are, one of its columns sensitive by name."""
    sources = Sources(spark)
    sources.register("crm", frames({"contact": read(spark, at, "nation").select("n_nationkey", "n_name", F.col("n_name").alias("mobile_no"))}))
    return sources.sample("crm", "contact", rows=25)


_DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def _database(spark: SparkSession, at: str) -> str:
    """Nations as a table of a database, by the driver that Spark brings along; gives its address.

    It is filled here and packed into the shared folder, to be read only, since one in memory would be another one in each
    executor, and an unpacked one belongs to the process that opened it first.
    """
    jvm = spark.sparkContext._jvm
    jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(_DERBY)
    with tempfile.TemporaryDirectory() as made:
        held = jvm.java.sql.DriverManager.getConnection(f"jdbc:derby:directory:{made}/plant;create=true")
        held.createStatement().execute("create table NATION (N_KEY int, R_KEY int)")
        put = held.prepareStatement("insert into NATION values (?, ?)")
        for r in read(spark, at, "nation").select("n_nationkey", "n_regionkey").collect():
            for i, v in enumerate(r, 1):
                put.setObject(i, v)
            put.addBatch()
        put.executeBatch()
        held.close()
        try:
            jvm.java.sql.DriverManager.getConnection(f"jdbc:derby:directory:{made}/plant;shutdown=true")
        except Py4JJavaError as e:
            if e.java_exception.getSQLState() != "08006":  # that it is closed, which is told as an error
                raise
        return f"jdbc:derby:jar:({shutil.make_archive(str(_folder(spark) / 'plant'), 'zip', made, 'plant')})plant"


@_query("database_aggregate", "select n_regionkey as region_key, count(*) as count, sum(n_nationkey) as sum_nation_key, max(n_nationkey) as max_nation_key from nation where n_nationkey >= 3 group by 1")
def _database_aggregate(spark: SparkSession, at: str) -> DataFrame:
    """Grouped by the database itself, which the executors open too; 25 rows go in, whatever the scale."""
    url = _database(spark, at)
    nation = {"kind": "thing", "identity": "nation_key", "properties": {"nation_key": {"type": "number"}, "region_key": {"type": "number"}}, "sources": {"base": {"connection": "db", "table": "NATION", "fields": {"nation_key": "N_KEY", "region_key": "R_KEY"}, "unique": True}}}
    e = Engine(spark, {"object_types": {"nation": nation}})
    e.sources.register("db", jdbc(spark, url, schema="APP", driver=_DERBY), test=True)
    return e.rows({"object": "nation", "filter": {"nation_key": {"gte": 3}}, "aggregate": {"group_by": ["region_key"], "metrics": [{"count": "*"}, {"sum": "nation_key"}, {"max": "nation_key"}]}})


@_query("expand_joined", "select r_regionkey as region_key, n_nationkey as nation_key, c_custkey as customer_key, c_acctbal as balance from region left join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey and c_acctbal > 5000")
def _expand_joined(spark: SparkSession, at: str) -> DataFrame:
    """Related individuals row by row; nothing is gathered per region or nation."""
    chain = [{"relation": "nations", "properties": ["nation_key"], "expand": [{"relation": "customers", "properties": ["customer_key", "balance"], "filter": {"balance": {"gt": 5000}}}]}]
    found = engine(spark, at).related({"object": "region", "properties": ["region_key"], "expand": chain})
    return found.select("region_key", "nations.nation_key", "nations.customers.customer_key", "nations.customers.balance")


def _file(spark: SparkSession, at: str) -> str:
    """Regions and nations (25 rows whatever the scale) as tables of a database file."""
    path = str(_folder(spark) / "plant.db")
    with sqlite3.connect(path) as db:
        db.executescript("create table region (r_regionkey integer primary key, r_name text unique); create table nation (n_code text primary key, n_nationkey int unique, n_name text, n_regionkey int) without rowid")
        db.executemany("insert into region values (?, ?)", [tuple(r) for r in read(spark, at, "region").select("r_regionkey", "r_name").collect()])
        db.executemany("insert into nation values (?, ?, ?, ?)", [(f"N{r[0]:02}", *r) for r in read(spark, at, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()])
    db.close()
    return path


@_query("sqlite_scan", "select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey where n_nationkey >= 5 and n_name <> 'CHINA' and r_name in ('ASIA', 'EUROPE')")
def _sqlite_scan(spark: SparkSession, at: str) -> DataFrame:
    held = sqlite(spark, _file(spark, at))
    nations = held.read("nation").where("n_nationkey >= 5 and n_name <> 'CHINA'")
    return nations.join(held.read("region").where("r_name in ('ASIA', 'EUROPE')"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@_told("sqlite_introspect", "table_name string, column_name string, kind string, is_unique boolean, is_key boolean", [
    ("nation", "n_code", "string", True, True), ("nation", "n_nationkey", "number", True, False), ("nation", "n_name", "string", False, False), ("nation", "n_regionkey", "number", False, False),
    ("region", "r_regionkey", "number", False, True), ("region", "r_name", "string", True, False)])
def _sqlite_introspect(spark: SparkSession, at: str) -> list[tuple]:
    sources = Sources(spark)
    sources.register("plant", sqlite(spark, _file(spark, at)), test=True)
    return [(t.table, c.name, c.type, c.unique, c.pk) for t in sources.tables() for c in t.columns]


@_told("source_registry", "step string, outcome string", [
    ("register", "accepted"), ("bad name", "Rejected"), ("unknown connection", "Rejected"), ("absent table", "SourceFault"), ("drop in use", "Rejected"), ("drop", "accepted"), ("after drop", "Rejected"), ("located", "nation"), ("comment", "the nation's name")])
def _source_registry(spark: SparkSession, at: str) -> list[tuple]:
    e = engine(spark, at)
    s, done = e.sources, []

    def step(name: str, run) -> None:
        try:
            done.append((name, _outcome(run)))
        except RuntimeError as fault:
            done.append((name, type(fault).__name__))

    step("register", lambda: s.register("more", frames({"nation": read(spark, at, "nation")}), test=True))
    step("bad name", lambda: s.register("Bad Name", frames({})))
    step("unknown connection", lambda: s.table("none", "nation"))
    step("absent table", lambda: s.table("more", "absent"))
    step("drop in use", lambda: s.drop("retail", e.model))
    located = [t.table for t in s.locate("nation") if t.connection == "more"]
    s.connections["more"].comments["nation"] = {"n_name": "the nation's name"}
    comment = next(c.comment for c in s.info("more", "nation").columns if c.name == "n_name")
    step("drop", lambda: s.drop("more", e.model))
    step("after drop", lambda: s.table("more", "nation"))
    return [*done, ("located", located[0]), ("comment", comment)]


@_query("left_out_rows", """select 'equipment' as object, 'device' as source, 'blank key' as reason, count(*) filter (serial_no is null or not regexp_matches(serial_no, '[^\\s\\pZ]')) as n from device
    union all select 'equipment', 'device', 'repeated key', count(*) - count(distinct serial_no) from device where regexp_matches(serial_no, '[^\\s\\pZ]')
    union all select 'equipment', 'disposal', 'blank key', count(*) filter (sn is null or not regexp_matches(sn, '[^\\s\\pZ]')) from disposal
    union all select 'equipment', 'disposal', 'repeated key', count(*) - count(distinct sn) from disposal where regexp_matches(sn, '[^\\s\\pZ]')""")
def _left_out_rows(spark: SparkSession, at: str) -> DataFrame:
    return engine(spark, at).left_out({"object": "equipment"})


@_query("left_out_values", "select 'customer' as object, 'base' as source, 'blank key' as reason, count(*) filter (c_custkey is null) as n from customer union all select 'customer', 'name', 'no number', count(c_name) from customer where c_acctbal > 0")
def _left_out_values(spark: SparkSession, at: str) -> DataFrame:
    return engine(spark, at).left_out({"object": "customer", "filter": {"balance": {"gt": 0}}, "aggregate": {"metrics": [{"sum": "name"}, {"avg": "balance"}]}})


@_query("working_copies", """select id, coalesce(json_type(c, '$.config') = 'OBJECT', false) as from_pack, coalesce(len(json_keys(c, '$.config.object_types')), 0)::int as classes,
    coalesce(len(json_keys(c, '$.layout')), 0)::int as placed from (select id, case when json_valid(canvas_json) then canvas_json::json end as c from onto_version where version is null)""")
def _working_copies(spark: SparkSession, at: str) -> DataFrame:
    def opened(batches):
        import pandas as pd

        for frame in batches:
            found = []
            for number, text in zip(frame["id"], frame["canvas_json"]):
                held = unpack(text)
                found.append((number, isinstance(held.get("config"), dict), len((held.get("config") or {}).get("object_types") or ()), len(held.get("layout") or ())))
            yield pd.DataFrame(found, columns=["id", "from_pack", "classes", "placed"])

    rows = read(spark, at, "onto_version").where("version is null").select("id", "canvas_json")
    return rows.mapInPandas(opened, "id long, from_pack boolean, classes int, placed int")


# Values

@_query("utc_format", "select event_id, strftime(ts, '%Y%m%d') || '-' || strftime(ts, '%H%M%S') as text from events where ts is not null")
def _utc_format(spark: SparkSession, at: str) -> DataFrame:
    return read(spark, at, "events").where("ts is not null").select("event_id", format_utc(F.unix_seconds(F.col("ts").cast("timestamp")), "yyyyMMdd-HHmmss").alias("text"))


@_query("normalise_id_card", "select dev_id, upper(regexp_replace(serial_no, '[\\s\\pZ]', '', 'g')) as normalised from device")
def _normalise_id_card(spark: SparkSession, at: str) -> DataFrame:
    return read(spark, at, "device").select("dev_id", BY_NAME["id_card"].column(F.col("serial_no")).alias("normalised"))


_LINEAGE = [(o, p, s["table"], c) for o, x in MODEL["object_types"].items() for s in x["sources"].values() for p, c in s["fields"].items()]


@_told("lineage", "object string, property string, table string, column string", _LINEAGE)
def _lineage(spark: SparkSession, at: str) -> list[tuple]:
    return [(x["object"], x["property"], x["table"], x["column"]) for x in lineage(engine(spark, at).model)]


@_told("column_uses", "table_name string, column_name string, object string, property string", [("customer", "c_custkey", "customer", "customer_key"), ("customer", "c_custkey", "account", "account_key"), ("lineitem", "l_orderkey", "order", "order_key"), ("lineitem", "l_orderkey", "line", "order_key"), ("lineitem", "l_orderkey", "order_line", "order_key")])
def _column_uses(spark: SparkSession, at: str) -> list[tuple]:
    model = engine(spark, at).model
    return [(t, c, *x) for t, c in (("customer", "c_custkey"), ("lineitem", "l_orderkey"), ("lineitem", "nothing")) for x in properties_of_column(model, "retail", t, c)]


@_told("explained_filters", "filter string, words string", [
    ("range", "total is at least 10 and is before or below 20"), ("list", "priority is one of 1-URGENT, 2-HIGH"), ("null", "priority is empty"), ("link", "has a placed_by customer that segment is BUILDING"),
    ("no link", "has no placed_by customer"), ("property", "total is after or above the current quantity"), ("request", "request parameter priority names a nation"), ("exists", "does not exist"), ("nothing", "holds always")])
def _explained(spark: SparkSession, at: str) -> list[tuple]:
    asked = {
        "range": {"total": {"gte": 10, "lt": 20}}, "list": {"priority": {"in": ["1-URGENT", "2-HIGH"]}}, "null": {"priority": None}, "link": {"$link": {"placed_by": {"segment": "BUILDING"}}}, "no link": {"$link": {"placed_by": False}},
        "property": {"total": {"gt": {"property": "quantity"}}}, "request": {"$request": {"priority": {"object": "nation"}}}, "exists": {"$exists": False}, "nothing": {},
    }
    model = engine(spark, at).model
    return [(name, describe(model, "order", f)) for name, f in asked.items()]


@_told("same_structures", "nth int, same boolean", [(0, True), (1, False), (2, True), (3, False), (4, False)])
def _same(spark: SparkSession, at: str) -> list[tuple]:
    pairs = [({"a": 1, "b": [1]}, {"b": [1], "a": 1}), ([1, 2], [2, 1]), ({"x": {"p": 1, "q": None}}, {"x": {"q": None, "p": 1}}), ({"a": 1}, {"a": "1"}), ({}, None)]
    return [(i, same_structure(a, b)) for i, (a, b) in enumerate(pairs)]


# Requests that are rejected

_REJECTED = {
    "unknown class": {"object": "none"}, "unknown property": {"object": "order", "properties": ["none"]}, "unknown filter": {"object": "order", "filter": {"none": 1}}, "unknown relation": {"object": "order", "filter": {"$link": {"none": True}}},
    "unknown operator": {"object": "order", "filter": {"total": {"between": 1}}}, "list without in": {"object": "order", "filter": {"total": [1]}}, "in without list": {"object": "order", "filter": {"total": {"in": 1}}}, "exists in a query": {"object": "order", "filter": {"$exists": True}},
    "request in a query": {"object": "order", "filter": {"$request": {"a": 1}}}, "pairing conflict": {"object": "order", "filter": {"$link": {"placed_by": {"customer_key": 1}}}}, "filter on a transition": {"object": "order", "filter": {"$link": {"fulfilled": {"total": 1}}}},
    "links too deep": {"object": "region", "filter": {"$link": {"nations": {"$link": {"customers": {"$link": {"orders": {"$link": {"lines": True}}}}}}}}}, "order by what is not shown": {"object": "order", "properties": ["total"], "order": {"priority": "asc"}}, "two orders": {"object": "order", "order": {"total": "asc", "priority": "asc"}},
    "limit 0": {"object": "order", "limit": 0}, "limit 1001": {"object": "order", "limit": 1001}, "unknown aggregate": {"object": "order", "aggregate": {"metrics": [{"median": "total"}]}}, "aggregate with expand": {"object": "order", "aggregate": {"metrics": [{"count": "*"}]}, "expand": [{"relation": "placed_by"}]},
    "sum of everything": {"object": "order", "aggregate": {"metrics": [{"sum": "*"}]}}, "aggregate ordered by another": {"object": "order", "aggregate": {"metrics": [{"count": "*"}]}, "order": {"total": "asc"}}, "bad date": {"object": "order", "filter": {"ordered_on": "2024-02-30"}}, "bad expression": {"object": "order", "filter": {"ordered_on": "now-1x"}},
    "no identity": {"object": "order", "filter": {"order_key": {"from": "identity"}}}, "unknown key": {"object": "order", "surprise": 1}, "good": {"object": "order", "limit": 1000}, "good aggregate": {"object": "order", "aggregate": {"group_by": ["stage"], "metrics": [{"count": "*"}]}, "order": {"count": "desc"}},
}


@_told("rejected_requests", "name string, outcome string", [(n, "accepted" if n.startswith("good") else "Rejected") for n in _REJECTED])
def _rejected(spark: SparkSession, at: str) -> list[tuple]:
    e = engine(spark, at)
    return [(n, _outcome(lambda r=r: e.query(r))) for n, r in _REJECTED.items()]


def _with_action(cls: str, action: dict, **more) -> dict:
    d = Model.parse(MODEL).to_dict()
    d["object_types"][cls]["actions"] = {"act": action}
    d["object_types"]["order"].setdefault("actions", {})["ship"] = {"effect": [{"link": "fulfilled"}]}
    return d | more


_ACTS = {
    "good": {"pre": {"$exists": True}, "effect": [{"update": {"object": "customer", "identity": {"from": "identity"}, "properties": {"segment": {"from": "request"}, "balance": "current.balance+1"}}}]},
    "writes a derived property": {"effect": [{"update": {"object": "customer", "identity": {"from": "identity"}, "properties": {"good_standing": True}}}]},
    "unknown class": {"effect": [{"create": {"object": "none", "properties": {}}}]}, "unknown property": {"effect": [{"create": {"object": "customer", "properties": {"none": 1}}}]},
    "no target": {"effect": [{"update": {"object": "customer", "properties": {"name": "x"}}}]}, "no effect": {"effect": []}, "bad filter": {"effect": [{"delete": {"object": "customer", "filter": {"balance": [1]}}}]},
    "current in a create": {"effect": [{"create": {"object": "customer", "properties": {"balance": "current.balance+1"}}}]}, "generated from nothing": {"effect": [{"create": {"object": "customer", "properties": {"name": {"from": "generated"}}}}]},
    "a list as value": {"effect": [{"create": {"object": "customer", "properties": {"name": ["x"]}}}]}, "bad expression": {"effect": [{"create": {"object": "customer", "properties": {"name": "now/1"}}}]}, "link that is no transition": {"effect": [{"link": "in_nation"}]},
    "informs an unknown outlet": {"effect": [{"delete": {"object": "customer", "identity": {"from": "identity"}}}], "inform": [{"object": "event", "to": ["nobody"], "properties": {}}]}, "asks for an unknown class": {"pre": {"$request": {"a": {"object": "none"}}}, "effect": [{"delete": {"object": "customer", "identity": {"from": "identity"}}}]},
}


@_told("rejected_actions", "name string, outcome string", [(n, "accepted" if n == "good" else "InvalidModel") for n in _ACTS])
def _rejected_actions(spark: SparkSession, at: str) -> list[tuple]:
    return [(n, _outcome(lambda a=a: editing.gate(Model.parse(_with_action("customer", a))))) for n, a in _ACTS.items()]


# Actions over whole tables

def _acting(spark: SparkSession, at: str, cls: str, action: dict, generate: dict | None = None, **more) -> Engine:
    d = _with_action(cls, action, **more)
    for (of, p), items in (generate or {}).items():
        d["object_types"][of]["properties"][p]["generate"] = items
    made = Engine(spark, d, clock=lambda: NOW)
    made.sources.register("retail", files(spark, at))
    return made


def _asked(spark: SparkSession, at: str, table: str, identity: str, **parameters: str) -> DataFrame:
    """One request for each row of a table."""
    return read(spark, at, table).select(F.expr(identity).alias("identity"), *(F.expr(x).alias(p) for p, x in parameters.items())).withColumn("request_id", F.col("identity"))


@_query("action_request_gate", "select c_custkey as request_id, 'pre' as stage from customer where not (c_custkey % 30 in (select n_nationkey from nation) and c_custkey % 7 in (1, 2, 3))")
def _request_gate(spark: SparkSession, at: str) -> DataFrame:
    e = _acting(spark, at, "customer", {"pre": {"$exists": True, "$request": {"nation": {"object": "nation"}, "rank": {"in": [1, 2, 3]}}}, "effect": [{"update": {"object": "customer", "identity": {"from": "identity"}, "properties": {"nation_key": {"property": "nation", "from": "request"}}}}]})
    return e.plan_actions("customer", "act", _asked(spark, at, "customer", "c_custkey", nation="c_custkey % 30", rank="c_custkey % 7")).rejected.select("request_id", "stage")


@_query("action_exists_gate", "select s_suppkey + 5 as request_id from supplier where s_suppkey + 5 in (select s_suppkey from supplier)")
def _exists_gate(spark: SparkSession, at: str) -> DataFrame:
    e = _acting(spark, at, "supplier", {"pre": {"$exists": True}, "effect": [{"delete": {"object": "supplier", "identity": {"from": "identity"}}}]})
    return e.plan_actions("supplier", "act", _asked(spark, at, "supplier", "s_suppkey + 5")).accepted.select("request_id")


@_query("action_absent_gate", "select count(*) as n from (select s_suppkey + 5 as k from supplier) where k not in (select s_suppkey from supplier)")
def _absent_gate(spark: SparkSession, at: str) -> DataFrame:
    """A creation that only those who are not there yet may ask for."""
    e = _acting(spark, at, "supplier", {"pre": {"$exists": False}, "effect": [{"create": {"object": "supplier", "properties": {"supplier_key": {"from": "identity"}, "name": "new"}}}]})
    return e.plan_actions("supplier", "act", _asked(spark, at, "supplier", "s_suppkey + 5")).ledger().where("outcome = 'applied'").agg(F.count(F.lit(1)).alias("n"))


@_query("action_by_filter", "select o_orderkey, case when o_orderstatus = 'O' and o_custkey % 2 = 0 and o_custkey in (select c_custkey from customer) then 'X' else o_orderstatus end as o_orderstatus from orders")
def _by_filter(spark: SparkSession, at: str) -> DataFrame:
    """Even customers close all their open orders."""
    e = _acting(spark, at, "customer", {"effect": [{"update": {"object": "order", "filter": {"customer_key": {"from": "identity"}, "order_status": "O"}, "properties": {"order_status": "X"}}}]})
    batch = e.plan_actions("customer", "act", _asked(spark, at, "customer", "c_custkey").where("identity % 2 = 0"))
    return batch.apply()["retail", "orders"].select("o_orderkey", "o_orderstatus")


@_query("action_carriers", "select 'crm' as source, 'update' as op, 'applied' as outcome, count(*) as n from customer")
def _carriers(spark: SparkSession, at: str) -> DataFrame:
    """Only the source that maps all that is set is written to."""
    e = _acting(spark, at, "account", {"effect": [{"update": {"object": "account", "identity": {"from": "identity"}, "properties": {"name": "renamed"}}}]})
    return e.plan_actions("account", "act", _asked(spark, at, "customer", "c_custkey")).ledger().groupBy("source", "op", "outcome").agg(F.count(F.lit(1)).alias("n"))


@_query("action_set_fields", "select s_suppkey, case when s_suppkey in (select s_suppkey - 3 from supplier) then 'S' || s_suppkey else s_name end as s_name from supplier")
def _set_fields(spark: SparkSession, at: str) -> DataFrame:
    """The action that the service proposes for some fields, carried out."""
    service = Service(spark, engine(spark, at).sources, _folder(spark), clock=lambda: NOW)
    service.workspace.replace(Model.parse(MODEL), 0)
    e = _acting(spark, at, "supplier", service.propose_action("supplier", ["name"]))
    return e.plan_actions("supplier", "act", _asked(spark, at, "supplier", "s_suppkey - 3", name="concat('S', s_suppkey - 3)")).apply()["retail", "supplier"].select("s_suppkey", "s_name")


@_query("action_notifications", "select s_suppkey as request_id, 'event' as object, 'act|' || s_suppkey as change_id, 'update supplier ' || s_suppkey || ' act|' || s_suppkey || '#1' as line, false as delivered from supplier")
def _notifications(spark: SparkSession, at: str) -> DataFrame:
    inform = [{"object": "event", "to": ["desk"], "properties": {"type": {"from": "action"}, "user": {"from": "identity"}}}]
    e = _acting(spark, at, "supplier", {"effect": [{"update": {"object": "supplier", "identity": {"from": "identity"}, "properties": {"name": "x"}}}], "inform": inform}, outlets={"desk": {"connection": "mail"}})
    found = e.plan_actions("supplier", "act", _asked(spark, at, "supplier", "s_suppkey")).notifications
    line = F.col("lines")[0]
    return found.select("request_id", "object", F.col("properties")["event_id"].alias("change_id"), F.concat_ws(" ", line["op"], line["object_class"], line["target"], line["line_id"]).alias("line"), "delivered")


_MS = NOW * 1000


@_query("generated_identifiers", f"""select c_custkey as request_id, 'A' || c_custkey || '-' || '20250101' || '-' || ((({_MS} - {SNOWFLAKE_EPOCH_MS} + (r // 4096)) * 4194304) + (r % 4096)) || '-' || u as identifier from (
    select c_custkey, row_number() over (order by c_custkey) - 1 as r, '{_MS:012x}'[1:8] || '-' || '{_MS:012x}'[9:12] || '-7' || h[1:3] || '-a' || h[4:6] || '-' || h[7:18] as u
    from (select c_custkey, sha256('supplier.name.{NOW}|' || c_custkey) as h from customer))""")
def _generated(spark: SparkSession, at: str) -> DataFrame:
    generate = {("supplier", "name"): ["A", {"from": "identity"}, "-", {"date": "now", "format": "yyyyMMdd"}, "-", {"snowflake": True}, "-", {"uuid": "v7"}]}
    e = _acting(spark, at, "customer", {"effect": [{"create": {"object": "supplier", "properties": {"supplier_key": {"from": "identity"}, "name": {"from": "generated"}}}}]}, generate)
    made = e.plan_actions("customer", "act", _asked(spark, at, "customer", "c_custkey")).changes[0]
    return made.rows.select("request_id", F.col(f"new_{made.columns.index('s_name')}").alias("identifier"))


@_query("action_date_form", "select o_orderkey, '2025-01-02 00:00:00' as text, 1735776000 as seconds from orders")
def _date_form(spark: SparkSession, at: str) -> DataFrame:
    """A date is written as its column holds it: as a UTC text or as seconds."""
    properties = {"k": {"type": "number"}, "day": {"type": "date"}, "second": {"type": "date"}}
    stamp = {"effect": [{"update": {"object": "x", "identity": {"from": "identity"}, "properties": {"day": "now+1d", "second": "now+1d"}}}]}
    source = {"connection": "c", "table": "t", "fields": {"k": "o_orderkey", "day": "text", "second": "seconds"}, "unique": True}
    e = Engine(spark, {"object_types": {"x": {"kind": "event", "identity": "k", "properties": properties, "sources": {"base": source}, "actions": {"stamp": stamp}}}}, clock=lambda: NOW)
    e.sources.register("c", frames({"t": read(spark, at, "orders").select("o_orderkey", F.col("o_orderdate").cast("string").alias("text"), F.lit(0).cast("long").alias("seconds"))}))
    return e.plan_actions("x", "stamp", _asked(spark, at, "orders", "o_orderkey")).apply()["c", "t"]


@_query("action_waves", "select s_suppkey, round(s_acctbal + 3, 4) as s_acctbal from supplier")
def _waves(spark: SparkSession, at: str) -> DataFrame:
    """Three requests on each supplier, one after the other."""
    e = _acting(spark, at, "supplier", {"effect": [{"update": {"object": "supplier", "identity": {"from": "identity"}, "properties": {"balance": "current.balance+1"}}}]})
    asked = _asked(spark, at, "supplier", "s_suppkey").withColumn("nth", F.explode(F.array(*map(F.lit, range(3))))).select((F.col("request_id") * 3 + F.col("nth")).alias("request_id"), "identity")
    after, _ = e.run_actions("supplier", "act", asked)
    return after.table(after.model.object("supplier").sources["base"]).select("s_suppkey", F.round("s_acctbal", 4).alias("s_acctbal"))


# Evidence for aligning classes

@_told("schema_advice", "class_a string, class_b string, verdict string, keep string", [("customer", "supplier", "overlap", "customer"), ("region", "nation", "overlap", "nation"), ("order", "order_line", "name_similar", "order"), ("department", "department_copy", "same", "department"), ("device", "device_state", "stage", "device_state")])
def _schema_advice(spark: SparkSession, at: str) -> list[tuple]:
    d = Model.parse(MODEL).to_dict()
    text = {"type": "string"}
    d["object_types"] |= {"department_copy": d["object_types"]["department"], "device": {"kind": "thing", "properties": {"serial_no": text, "name": text}}, "device_state": {"kind": "thing", "properties": {"serial_no": text, "name": text, "state": text}}}
    model = Model.parse(d)
    found = []
    for a, b in (("customer", "supplier"), ("region", "nation"), ("order", "order_line"), ("department", "department_copy"), ("device", "device_state")):
        advice = verdict.advise_by_schema(model.object(a), model.object(b))
        found.append((a, b, advice.verdict if advice else "none", advice.keep if advice else ""))
    return found


@_told("overlap_advice", "before string, count_a int, count_b int, count_hit int, after string", [
    ("overlap", 10, 10, 0, "same"), ("name_similar", 10, 10, 0, "name_similar"), ("stage", 10, 10, 0, "same"), ("stage", 0, 10, 0, "stage"), ("overlap", 10, 10, 9, "same"), ("stage", 10, 10, 8, "stage"), ("overlap", 10, 10, 5, "overlap"), ("name_similar", 10, 10, 3, "name_similar")])
def _overlap_advice(spark: SparkSession, at: str) -> list[tuple]:
    d = Model.parse(MODEL).to_dict()["object_types"]
    staged = {**d["customer"], "properties": {**d["customer"]["properties"], "state": {"type": "string"}}, "sources": {}}
    model = Model.parse({"object_types": {"a": staged, "b": staged}, "link_types": {}})
    found = []
    for before, a, b, hit in (("overlap", 10, 10, 0), ("name_similar", 10, 10, 0), ("stage", 10, 10, 0), ("stage", 0, 10, 0), ("overlap", 10, 10, 9), ("stage", 10, 10, 8), ("overlap", 10, 10, 5), ("name_similar", 10, 10, 3)):
        after = verdict.advise_by_overlap(verdict.Advice("a", "b", before, "a", ""), model.object("a"), model.object("b"), a, b, hit, hit / max(a, b))
        found.append((before, a, b, hit, after.verdict))
    return found


@_told("key_suggestion", "object string, key_name string", [("nation", "nation_key"), ("supplier", "supplier_key")])
def _key_suggestion(spark: SparkSession, at: str) -> list[tuple]:
    e = engine(spark, at)
    return [(c, verdict.suggest_key([r.asDict() for r in integrate.key_trial(e, c, [mate]).collect()], e.model.object(c).identity)[0]) for c, mate in (("nation", "region"), ("supplier", "customer"))]


@_told("key_rules", "name string, key_name string", [("hits decide", "b"), ("hard decides ties", "b"), ("the present one stays", "a"), ("none is unique", "-"), ("no candidates", "-"), ("unknown elsewhere", "-")])
def _key_rules(spark: SparkSession, at: str) -> list[tuple]:
    def trial(*rows):
        return [dict(zip(("candidate", "unique_in_each", "hard", "hits"), r)) for r in rows]

    cases = [
        ("hits decide", trial(("a", True, True, 3), ("b", True, False, 5)), "a"), ("hard decides ties", trial(("a", True, False, 5), ("b", True, True, 5)), None), ("the present one stays", trial(("a", True, False, 0), ("b", True, True, 0)), "a"),
        ("none is unique", trial(("a", False, True, 9)), "a"), ("no candidates", [], "a"), ("unknown elsewhere", trial(("a", True, False, 0)), None),
    ]
    return [(name, verdict.suggest_key(rows, current)[0] or "-") for name, rows, current in cases]


@_told("comparable_classes", "object string, comparable boolean", [("customer", True), ("line", False), ("order", True), ("sourceless", False)])
def _comparable(spark: SparkSession, at: str) -> list[tuple]:
    model = Model.parse({"object_types": Model.parse(MODEL).to_dict()["object_types"] | {"sourceless": {"kind": "thing", "identity": "k", "properties": {"k": {"type": "string"}}}}})
    return [(c, integrate.eligible(model.object(c))) for c in ("customer", "line", "order", "sourceless")]


@_told("candidate_pairs", "step string, class_a string, class_b string", [("open", "customer", "supplier"), ("open", "supplier", "partner"), ("open", "customer", "partner"), ("decided", "customer", "partner"), ("decided", "supplier", "partner"), ("rewritten", "customer", "partner"), ("rewritten", "customer", "part")])
def _candidates(spark: SparkSession, at: str) -> list[tuple]:
    d = Model.parse(MODEL).to_dict()["object_types"]
    own = {n: {**x, "properties": {p: v for p, v in x["properties"].items() if "derived" not in v}} for n, x in d.items() if n in ("customer", "supplier", "region")}
    model = Model.parse({"object_types": own | {"partner": own["supplier"]}})
    pairs = [("open", *sorted((a.class_a, a.class_b), key=["customer", "supplier", "partner"].index)) for a in verdict.open_pairs(model, [])]
    pairs += [("decided", *sorted((a.class_a, a.class_b), key=["customer", "supplier", "partner"].index)) for a in verdict.open_pairs(model, [("supplier", "customer")])]
    return pairs + [("rewritten", *p) for p in verdict.rewrite_pairs([("customer", "supplier"), ("supplier", "partner"), ("customer", "partner"), ("part", "supplier")][1:3] + [("supplier", "part"), ("customer", "supplier")], "customer", "supplier")]


@_query("class_drafts", " union all ".join(f"select '{t}' as object, column_name as property, {_KIND} as kind from (describe {t})" for t in ("region", "nation", "orders")))
def _class_drafts(spark: SparkSession, at: str) -> DataFrame:
    """Classes drafted from tables; columns dropped by hand come back as uncovered ones."""
    sources = engine(spark, at).sources
    infos = [sources.info("retail", t) for t in ("region", "nation", "orders")]
    drafts = editing.draft_from_tables(infos)
    for c in ("o_custkey", "o_orderdate"):
        drafts["orders"]["properties"].pop(c)
        drafts["orders"]["sources"]["retail"]["fields"].pop(c)
    full = editing.uncovered(drafts, infos)
    return spark.createDataFrame([(o, p, x["type"]) for o, c in full.items() for p, x in c["properties"].items()], "object string, property string, kind string")


@_told("dying_actions", "name string, dies boolean", [("sets a field", False), ("links to the lost class", True), ("creates the lost class", True), ("asks for the lost class", True), ("tests the lost identity", True), ("informs the lost class", True)])
def _dying(spark: SparkSession, at: str) -> list[tuple]:
    update = {"update": {"object": "customer", "identity": {"from": "identity"}, "properties": {"name": "x"}}}
    acts = {
        "sets a field": {"effect": [update]}, "links to the lost class": {"pre": {"$link": {"in_nation": True}}, "effect": [update]}, "creates the lost class": {"effect": [{"create": {"object": "nation", "properties": {}}}]},
        "asks for the lost class": {"pre": {"$request": {"a": {"object": "nation"}}}, "effect": [update]}, "tests the lost identity": {"pre": {"customer_key": 1}, "effect": [update]}, "informs the lost class": {"effect": [update], "inform": [{"object": "nation", "properties": {}}]},
    }
    model = engine(spark, at).model
    return [(n, verdict.action_dies(model, "customer", a, "nation", "customer_key")) for n, a in acts.items()]


@_told("verdicts", "verdict string, classes int, relations int, sources int, actions int, outcome string", [("same", 1, 0, 2, 0, "accepted"), ("overlap", 1, 0, 2, 0, "accepted"), ("stage", 1, 1, 2, 1, "accepted"), ("name_similar", 2, 0, 1, 0, "accepted"), ("skip", 2, 0, 1, 0, "accepted"), ("perhaps", 2, 0, 1, 0, "Rejected")])
def _verdicts(spark: SparkSession, at: str) -> list[tuple]:
    order = MODEL["object_types"]["order"]
    base = Model.parse({"object_types": {n: {"kind": "event", "identity": "order_key", "properties": {p: order["properties"][p] for p in order["sources"][n]["fields"]}, "sources": {n: order["sources"][n]}} for n in ("header", "shipment")}, "link_types": {}})
    found = []
    for choice in (*verdict.VERDICTS, "perhaps"):
        model, outcome = base, "accepted"
        try:
            model = verdict.apply_verdict(base, "header", "shipment", choice)
        except Rejected as e:
            outcome = type(e).__name__
        c = model.object("header")
        found.append((choice, len(model.object_types), len(model.link_types), len(c.sources), len(c.actions), outcome))
    return found


# Editing models

@_told("model_edits", "step string, record string, change string", [
    ("create", "object_types.tool", "added"), ("property", "object_types.tool", "changed"), ("identity", "object_types.tool", "changed"), ("link", "link_types.uses_tool", "added"), ("rename", "link_types.uses_tool", "changed"), ("rename", "object_types.instrument", "added"), ("rename", "object_types.tool", "removed"),
    ("action", "object_types.instrument", "changed"), ("import", "object_types.extra", "added"), ("replace", "object_types.extra", "changed"), ("stages", "object_types.account", "changed"), ("unlink", "link_types.uses_tool", "removed"), ("delete", "object_types.instrument", "removed")])
def _edits(spark: SparkSession, at: str) -> list[tuple]:
    ops = {
        "create": {"op": "create_object", "name": "tool", "kind": "thing"}, "property": {"op": "add_property", "object": "tool", "name": "code", "type": "string"}, "identity": {"op": "set_identity", "object": "tool", "name": "code"},
        "link": {"op": "create_link", "name": "uses_tool", "from": "repair", "to": "tool", "match": {"from": "repair_no", "to": "code"}}, "rename": {"op": "update_object", "name": "tool", "new_name": "instrument"},
        "action": {"op": "set_action", "object": "instrument", "name": "drop", "def": {"effect": [{"delete": {"object": "instrument", "identity": {"from": "identity"}}}]}}, "import": {"op": "import_objects", "objects": {"extra": {"kind": "event", "properties": {"p": {"type": "string"}}}}},
        "replace": {"op": "replace_object", "name": "extra", "def": {"kind": "thing", "properties": {}}}, "stages": {"op": "edit_stages", "object": "account", "items": [{"value": "known", "when": {"crm": True}}]}, "unlink": {"op": "delete_link", "name": "uses_tool"}, "delete": {"op": "delete_object", "name": "instrument"},
    }
    model, found = engine(spark, at).model, []
    for step, op in ops.items():
        changed = editing.edit(model, op)
        found += [(step, x["record"], x["change"]) for x in editing.difference(model, changed)]
        model = changed
    return found


@_told("rejected_edits", "name string, outcome string", [("taken name", "Rejected"), ("bad name", "Rejected"), ("property in use", "Rejected"), ("relation in use", "Rejected"), ("class in use", "Rejected"), ("stage in use", "Rejected"), ("derived identity", "InvalidModel"), ("unknown edit", "Rejected"), ("part missing", "Rejected"), ("import of a taken name", "Rejected")])
def _rejected_edits(spark: SparkSession, at: str) -> list[tuple]:
    model = engine(spark, at).model
    ops = {
        "taken name": {"op": "create_object", "name": "order", "kind": "thing"}, "bad name": {"op": "create_object", "name": "An Order", "kind": "thing"}, "property in use": {"op": "remove_property", "object": "order", "name": "priority"}, "relation in use": {"op": "delete_link", "name": "placed_by"},
        "class in use": {"op": "replace_object", "name": "nation", "def": {"kind": "thing", "properties": {}}}, "stage in use": {"op": "edit_stages", "object": "order", "items": [{"value": "shipped", "when": {"shipment": True}}]}, "derived identity": {"op": "set_identity", "object": "order", "name": "stage"},
        "unknown edit": {"op": "paint"}, "part missing": {"op": "create_object"}, "import of a taken name": {"op": "import_objects", "objects": {"order": {"kind": "event", "properties": {}}}},
    }
    return [(n, _outcome(lambda op=op: editing.edit(model, op))) for n, op in ops.items()]


@_told("model_uses", "kind string, name string, uses int", [("property", "order.priority", 1), ("property", "customer.segment", 0), ("link", "placed_by", 1), ("link", "in_nation", 0), ("class", "region", 1)])
def _uses(spark: SparkSession, at: str) -> list[tuple]:
    model = engine(spark, at).model
    return [("property", "order.priority", editing.uses(model, "property", "order", "priority")), ("property", "customer.segment", editing.uses(model, "property", "customer", "segment")),
            ("link", "placed_by", editing.uses(model, "link", None, "placed_by")), ("link", "in_nation", editing.uses(model, "link", None, "in_nation")), ("class", "region", editing.uses(model, "class", None, "region"))]


@_told("class_stages", "object string, stage string, transitions string", [("order", "returned", ""), ("order", "placed", "fulfilled"), ("order", "shipped", ""), ("account", "active", ""), ("account", "dormant", ""), ("account", "unknown", "")])
def _stages(spark: SparkSession, at: str) -> list[tuple]:
    model = engine(spark, at).model
    return [(c, s["value"], ",".join(s["transitions"])) for c in ("order", "account", "customer") for s in editing.stages(model, c)]


@_told("model_views", "kind string, name string", [("class", "nation"), ("property", "customer.nation_key"), ("property", "nation.nation_key"), ("property", "supplier.nation_key"), ("relation", "in_nation"), ("relation", "in_region"), ("relation", "of_nation"), ("relation", "same_nation"), ("listed", "15"), ("read", "in_region,customers,suppliers")])
def _views(spark: SparkSession, at: str) -> list[tuple]:
    model = engine(spark, at).model
    found = [(x["kind"], x["name"]) for x in editing.search(model, "Nation")]
    return [*found, ("listed", str(len(editing.list_classes(model)))), ("read", ",".join(r["name"] for r in editing.read_class(model, "nation")["relations"]))]


@_told("workspace_history", "step string, told string", [
    ("publish", "1"), ("edit", "1"), ("stale edit", "StaleRevision"), ("state", "added object_types.tool"), ("publish again", "2"), ("discard", "tool"), ("decisions", "0"), ("decided", "same 3"), ("rollback", "4"), ("versions", "1,2,3,4"), ("overlaps", "1 2 1"), ("candidates", "1"), ("questions", "1"), ("unknown version", "Rejected"), ("workspaces", "main,other")])
def _history(spark: SparkSession, at: str) -> list[tuple]:
    folder, base = _folder(spark), Model.parse(_with_action("customer", _ACTS["good"]))
    ws, other, done = Workspace(folder, "main", now=lambda: 0.0), Workspace(folder, "other"), []
    ws.replace(base, 0)
    done.append(("publish", str(ws.publish("first"))))
    rev = ws.edit({"op": "create_object", "name": "tool", "kind": "thing"})
    done += [("edit", str(rev)), ("stale edit", _outcome(lambda: ws.edit({"op": "create_object", "name": "more", "kind": "thing"}, rev - 1))), ("state", " ".join(f"{c['change']} {c['record']}" for c in ws.state()["changes"]))]
    done.append(("publish again", str(ws.publish())))
    ws.edit({"op": "delete_object", "name": "tool"})
    ws.decide("customer", "supplier", "skip")
    ws.discard()
    done += [("discard", "tool" if "tool" in ws.draft()[0].object_types else "-"), ("decisions", str(len(ws.decisions())))]
    ws.decide("customer", "supplier", "same")
    ws.publish()
    done += [("decided", " ".join(f"{d['verdict']} {d['version']}" for d in ws.decisions())), ("rollback", str(ws.rollback(1))), ("versions", ",".join(map(str, ws.versions())))]
    for a, b, n in (("a", "b", 1), ("b", "a", 2)):
        ws.save_overlap({"class_a": a, "class_b": b, "norm_rule": "plain", "count_a": n, "count_b": 1, "count_hit": 1, "rate": 0.5})
    (row,) = ws.overlaps()
    done.append(("overlaps", f"1 {row['count_a']} {row['count_b']}"))
    ws.save_candidates(base, [{"class_a": "order", "class_b": "order_line"}, {"class_a": "customer", "class_b": "supplier"}])
    done.append(("candidates", str(len(ws.candidates(base)[0]))))
    ws.save_questions([{"question": "?", "expected": 1}])
    other.replace(base, 0)
    return [*done, ("questions", str(len(ws.questions()))), ("unknown version", _outcome(lambda: ws.published(9))), ("workspaces", ",".join(workspaces(folder)))]


@_told("service_log", "kind string, ok boolean, version int, error string", [("query", True, 1, ""), ("query", False, 1, "there is no class 'none'"), ("query", True, 1, ""), ("action", True, 1, ""), ("action", False, 1, "supplier has no action 'none'")])
def _service_log(spark: SparkSession, at: str) -> list[tuple]:
    """What a service notes of the requests made to it: queries, a question put through its port, actions."""
    action = {"pre": {"$exists": True}, "effect": [{"update": {"object": "supplier", "identity": {"from": "identity"}, "properties": {"name": "x"}}}]}
    service = Service(spark, engine(spark, at).sources, _folder(spark), clock=lambda: NOW, ask=lambda question, model: {"object": question.split()[-1]})
    service.workspace.replace(Model.parse(_with_action("supplier", action)), 0)
    service.publish()
    asked = spark.createDataFrame([(1, 1)], "request_id int, identity int")
    for run in (lambda: service.query({"object": "nation"}), lambda: service.query({"object": "none"}), lambda: service.ask("show every region"), lambda: service.run_action("supplier", "act", asked), lambda: service.run_action("supplier", "none", asked)):
        _outcome(run)
    return [(kind, r["ok"], r["version"], r["error"] or "") for kind in ("query", "action") for r in service.workspace.records(f"log_{kind}")]


_QUESTIONS = {
    "How many orders are in each stage?": "with {orders} select count(distinct coalesce(stage, '')) from aligned",
    "Which customers in BUILDING without orders are there?": "select count(*) from customer where c_mktsegment = 'BUILDING' and c_custkey not in (select o_custkey from orders where o_custkey is not null)",
    "Who has a balance above 5000.5?": "select count(*) from customer where c_acctbal > 5000.5",
    "What are the nations of ASIA?": "select count(*) from nation join region on n_regionkey = r_regionkey where r_name = 'ASIA'",
    "Where is order 7?": "select count(*) from orders where o_orderkey = 7",
}


@_query("scripted_questions", " union all ".join(f"select '{q}' as question, ({sql.replace('{orders}', _ORDERS)}) as n" for q, sql in _QUESTIONS.items()) + " union all select 'What is the weather?', -1")
def _scripted(spark: SparkSession, at: str) -> DataFrame:
    """Questions in words, compiled by a script and answered; -1: no pattern fits."""
    script, e, parts = RETAIL_SCRIPT, engine(spark, at), []
    for q in (*_QUESTIONS, "What is the weather?"):
        try:
            n = e.rows(script(q, e.model)).agg(F.count(F.lit(1)).alias("n"))
        except Rejected:
            n = spark.range(1).select(F.lit(-1).cast("long").alias("n"))
        parts.append(n.select(F.lit(q).alias("question"), "n"))
    return reduce(DataFrame.unionByName, parts)


@_told("alignment_by_service", "step string, told string", [("candidates", "header shipment"), ("overlap", "all headers"), ("decide", "2"), ("again", "Rejected"), ("left", "0"), ("publish", "1"), ("classes", "header")])
def _alignment(spark: SparkSession, at: str) -> list[tuple]:
    """Candidates, evidence, a verdict and what it leaves, by the service's methods."""
    order = MODEL["object_types"]["order"]
    sources = {n: order["sources"][n] | {"fields": {p: c for p, c in order["sources"][n]["fields"].items() if p in ("order_key", keep)}} for n, keep in (("header", "total"), ("shipment", "quantity"))}
    model = Model.parse({"object_types": {n: {"kind": "event", "identity": "order_key", "properties": {p: order["properties"][p] for p in s["fields"]}, "sources": {n: s}} for n, s in sources.items()}, "link_types": {}})
    service = Service(spark, engine(spark, at).sources, _folder(spark), clock=lambda: NOW)
    service.workspace.replace(model, 0)
    done = [("candidates", " ".join(f"{p['class_a']} {p['class_b']}" for p in service.list_candidates()))]
    row = service.compute_overlap("header", "shipment")
    done.append(("overlap", "all headers" if row["count_a"] >= row["count_hit"] == row["count_b"] > 0 else str(row)))
    done += [("decide", str(service.decide("header", "shipment", "same"))), ("again", _outcome(lambda: service.decide("shipment", "header", "skip"))), ("left", str(len(service.list_candidates()))), ("publish", str(service.publish()))]
    return [*done, ("classes", ",".join(c["name"] for c in service.list_classes()))]


@_query("identity_exists", f"with {_EQUIPMENT} select serial_no as request_id from equipment e where exists (select 1 from department where dept_id = e.dept)")
def _identity_exists(spark: SparkSession, at: str) -> DataFrame:
    """Requests whose parameter names an individual that is there: each device's department, among all departments."""
    e = _acting(spark, at, "equipment", {"pre": {"$exists": True, "$request": {"dept": {"object": "department"}}}, "effect": [{"delete": {"object": "equipment", "identity": {"from": "identity"}}}]})
    asked = e.rows({"object": "equipment", "properties": ["serial_no", "dept"]}).select(F.col("serial_no").alias("request_id"), F.col("serial_no").alias("identity"), "dept")
    return e.plan_actions("equipment", "act", asked).accepted.select("request_id")
