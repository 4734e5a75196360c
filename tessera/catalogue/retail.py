"""A business model over the retail, event and document tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessera.plans.engine import Engine
from tessera.sources.catalog import files

_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _props(text: str, **more) -> dict:
    """Properties from ``name type`` pairs."""
    words = text.split()
    return dict(zip(words[::2], ({"type": t} for t in words[1::2]))) | more


def _class(kind: str, identity: str | None, properties: dict, sources: dict, **more) -> dict:
    return {"kind": kind, "identity": identity, "properties": properties, "sources": sources, **more}


def _table(table: str, fields: str, **more) -> dict:
    words = fields.split()
    return {"connection": "retail", "table": table, "fields": dict(zip(words[::2], words[1::2])), **more}


MODEL = {
    "object_types": {
        "region": _class("thing", "region_key", _props("region_key number name string"), {"base": _table("region", "region_key r_regionkey name r_name", unique=True)}),
        "nation": _class("thing", "nation_key", _props("nation_key number name string region_key number"), {"base": _table("nation", "nation_key n_nationkey name n_name region_key n_regionkey", unique=True)}),
        "customer": _class(
            "thing", "customer_key",
            _props("customer_key number name string nation_key number balance number segment enum",
                   has_urgent_order={"type": "boolean", "derived": {"$link": {"orders": {"priority": "1-URGENT", "total": {"gte": 400000}}}}},
                   good_standing={"type": "boolean", "derived": {"balance": {"gte": 0}, "has_urgent_order": False}}),
            {"base": _table("customer", "customer_key c_custkey name c_name nation_key c_nationkey balance c_acctbal segment c_mktsegment", unique=True)},
        ),
        "supplier": _class("thing", "supplier_key", _props("supplier_key number name string nation_key number balance number"), {"base": _table("supplier", "supplier_key s_suppkey name s_name nation_key s_nationkey balance s_acctbal", unique=True)}),
        "part": _class("thing", "part_key", _props("part_key number name string brand string kind string size number price number"), {"base": _table("part", "part_key p_partkey name p_name brand p_brand kind p_type size p_size price p_retailprice", unique=True)}),
        "order": _class(
            "event", "order_key",
            _props("order_key number customer_key number total number ordered_on date priority enum order_status enum shipped_on date return_flag enum quantity number",
                   stage={"type": "enum", "values": ["returned", "placed", "shipped"], "derived": [
                       {"when": {"shipment": {"return_flag": "R"}}, "value": "returned"},
                       {"when": {"header": True, "shipment": False}, "value": "placed"},
                       {"when": {"shipment": True}, "value": "shipped"}]},
                   late_and_large={"type": "boolean", "derived": {"stage": "shipped", "total": {"gt": 200000}}}),
            {"header": _table("orders", "order_key o_orderkey customer_key o_custkey total o_totalprice ordered_on o_orderdate priority o_orderpriority order_status o_orderstatus", unique=True),
             "shipment": _table("lineitem", "order_key l_orderkey shipped_on l_shipdate return_flag l_returnflag quantity l_quantity", order_by=_LINE_ORDER)},
            axioms={"one_stage": {"type": "mutex", "property": "order_status"}},
        ),
        "line": _class("event", None, _props("order_key number part_key number supplier_key number line_no number quantity number price number discount number tax number return_flag enum line_status enum shipped_on date"),
                       {"base": _table("lineitem", "order_key l_orderkey part_key l_partkey supplier_key l_suppkey line_no l_linenumber quantity l_quantity price l_extendedprice discount l_discount tax l_tax return_flag l_returnflag line_status l_linestatus shipped_on l_shipdate")}, rows_only=True),
        "order_line": _class("thing", "order_key", _props("order_key number"), {"base": _table("lineitem", "order_key l_orderkey", order_by=_LINE_ORDER)}),
        "account": _class(
            "thing", "account_key",
            _props("account_key number name string user number last_event string active_since date",
                   activity={"type": "enum", "derived": [{"when": {"crm": True, "activity": True}, "value": "active"}, {"when": {"crm": True}, "value": "dormant"}, {"when": {"activity": True}, "value": "unknown"}]}),
            {"crm": _table("customer", "account_key c_custkey name c_name", unique=True),
             "activity": _table("events", "user user_id last_event event_type active_since ts", key="user", order_by=["ts", "event_id"])},
        ),
        "event": _class("event", "event_id", _props("event_id number at date user number type enum value number"), {"base": _table("events", "event_id event_id at ts user user_id type event_type value value", unique=True)}),
        "document": _class("thing", "doc_id", _props("doc_id number lang string origin string n_chars number serial_no string"), {"base": _table("documents", "doc_id doc_id lang lang origin source n_chars n_chars serial_no serial_no", unique=True)}),
        "department": _class("thing", "dept_id", _props("dept_id string dept_name string"), {"base": _table("department", "dept_id dept_id dept_name dept_name", unique=True)}),
        "equipment": _class(
            "thing", "serial_no",
            _props("serial_no string name string dept string mark string disposed_on number reason string",
                   status={"type": "enum", "values": ["disposed", "scrapped", "in_service", "unlisted"], "derived": [
                       {"when": {"disposal": True}, "value": "disposed"},
                       {"when": {"device": {"mark": "scrapped"}}, "value": "scrapped"},
                       {"when": {"device": True}, "value": "in_service"}]},
                   ever_repaired={"type": "boolean", "derived": {"$link": {"repairs": True}}}),
            {"device": _table("device", "serial_no serial_no name name dept dept_id mark status", order_by=["dev_id"]),
             "disposal": _table("disposal", "serial_no sn disposed_on disposed_at reason reason", order_by=["record_no"])},
        ),
        "assignment": _class("event", "id", _props("id number serial_no string dept_id string valid_from date valid_to date"), {"base": _table("assignment", "id id serial_no sn dept_id dept_id valid_from valid_from valid_to valid_to", unique=True)}),
        "repair": _class("event", "id", _props("id number repair_no string serial_no string symptom string started_at date ended_at date"), {"base": _table("repair", "id id repair_no repair_no serial_no serial_no symptom symptom started_at started_at ended_at ended_at", unique=True)}),
    },
    "link_types": {
        "placed_by": {"from": "order", "to": "customer", "inverse": "orders", "card": "N:1", "match": [{"from": "customer_key", "to": "customer_key"}]},
        "in_nation": {"from": "customer", "to": "nation", "inverse": "customers", "card": "N:1", "match": [{"from": "nation_key", "to": "nation_key"}]},
        "in_region": {"from": "nation", "to": "region", "inverse": "nations", "card": "N:1", "match": [{"from": "region_key", "to": "region_key"}]},
        "of_nation": {"from": "supplier", "to": "nation", "inverse": "suppliers", "card": "N:1", "match": [{"from": "nation_key", "to": "nation_key"}]},
        "of_order": {"from": "line", "to": "order", "inverse": "lines", "card": "N:1", "match": [{"from": "order_key", "to": "order_key"}]},
        "of_part": {"from": "line", "to": "part", "inverse": "part_lines", "card": "N:1", "match": [{"from": "part_key", "to": "part_key"}]},
        "from_supplier": {"from": "line", "to": "supplier", "inverse": "supplied_lines", "card": "N:1", "match": [{"from": "supplier_key", "to": "supplier_key"}]},
        "by_account": {"from": "event", "to": "account", "inverse": "account_events", "card": "N:1", "match": [{"from": "user", "to": "account_key"}]},
        "neighbour": {"from": "supplier", "to": "customer", "inverse": "near_suppliers", "card": "N:N", "match": [{"from": "nation_key", "to": "nation_key"}]},
        "twin": {"from": "supplier", "to": "customer", "inverse": "twins", "card": "N:N", "match": [{"from": "nation_key", "to": "nation_key"}, {"from": "supplier_key", "to": "customer_key"}]},
        "same_nation": {"from": "supplier", "to": "supplier", "inverse": "same_nation_as", "card": "N:N", "match": [{"from": "nation_key", "to": "nation_key"}]},
        "fulfilled": {"from": "order", "to": "order", "inverse": "fulfilled_from", "card": "1:1", "transition": {"property": "stage", "from": "placed", "to": "shipped"}},
        "belongs_to": {"from": "equipment", "to": "department", "inverse": "has_equipment", "card": "N:1", "match": [{"from": "dept", "to": "dept_id"}]},
        "of_equipment": {"from": "assignment", "to": "equipment", "inverse": "assignments", "card": "N:1", "match": [{"from": "serial_no", "to": "serial_no"}]},
        "on_equipment": {"from": "repair", "to": "equipment", "inverse": "repairs", "card": "N:1", "match": [{"from": "serial_no", "to": "serial_no"}]},
    },
}

#: 2025-01-01 00:00 UTC, the clock of all queries here.
NOW = 1_735_689_600


def engine(spark: SparkSession, at: str) -> Engine:
    made = Engine(spark, MODEL, clock=lambda: NOW)
    made.sources.register("retail", files(spark, at))
    return made
