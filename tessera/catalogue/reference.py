"""Queries that show the structured query interface operator by operator, each with its plain SQL.

All run over whole tables. Limits appear only where ordering with a limit is the feature.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalogue.retail import MODEL, NOW, engine
from tessera.catalogue.tables import read
from tessera.functions.masking import masked
from tessera.functions.normalize import BY_NAME
from tessera.operators import integrate
from tessera.plans import verdict
from tessera.plans.acceptance import RETAIL_PACK, run_pack
from tessera.plans.engine import Engine
from tessera.plans.model import Model
from tessera.sources.catalog import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _add(name: str, request: dict, sql: str | None, shape: Callable[[DataFrame], DataFrame] | None = None, most: bool = False) -> None:
    def run(spark: SparkSession, at: str) -> DataFrame:
        e = engine(spark, at)
        df = e.query(request).df if most else e.rows(request)
        return shape(df) if shape else df

    run.__name__ = name
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


_FIRST = """first_line as (select * from (select *, row_number() over (partition by l_orderkey order by l_linenumber nulls first, l_partkey nulls first,
    l_suppkey nulls first, l_quantity nulls first, l_extendedprice nulls first, l_discount nulls first, l_tax nulls first, l_returnflag nulls first,
    l_linestatus nulls first, l_shipdate nulls first) as nth from lineitem) where nth = 1)"""
_ORDERS = f"""{_FIRST}, aligned as (select coalesce(o_orderkey, l_orderkey) as order_key, o_custkey as customer_key, o_totalprice as total, o_orderdate as ordered_on,
    o_orderpriority as priority, l_shipdate as shipped_on, l_returnflag as return_flag, l_quantity as quantity, o_orderkey is not null as header, l_orderkey is not null as shipment,
    case when l_orderkey is not null and l_returnflag = 'R' then 'returned' when o_orderkey is not null and l_orderkey is null then 'placed' when l_orderkey is not null then 'shipped' end as stage
    from orders full outer join first_line on o_orderkey = l_orderkey)"""
_EQUIPMENT = """d1 as (select * from (select *, row_number() over (partition by serial_no order by dev_id) as nth from device where regexp_matches(serial_no, '[^\\s\\pZ]')) where nth = 1),
    x1 as (select * from (select *, row_number() over (partition by sn order by record_no) as nth from disposal where regexp_matches(sn, '[^\\s\\pZ]')) where nth = 1),
    equipment as (select coalesce(d1.serial_no, x1.sn) as serial_no, d1.name as name, d1.dept_id as dept, d1.status as mark, d1.serial_no is not null as device, x1.sn is not null as disposal,
    case when x1.sn is not null then 'disposed' when d1.serial_no is not null and d1.status = 'scrapped' then 'scrapped' when d1.serial_no is not null then 'in_service' end as status
    from d1 full outer join x1 on d1.serial_no = x1.sn)"""

_C = "c_custkey as customer_key, c_name as name"
_KEY = ["customer_key", "name"]
_add("scan_project", {"object": "customer", "properties": _KEY}, f"select {_C} from customer")
_add("filter_eq", {"object": "customer", "properties": _KEY, "filter": {"segment": "BUILDING"}}, f"select {_C} from customer where c_mktsegment = 'BUILDING'")
_add("filter_ne", {"object": "customer", "properties": _KEY, "filter": {"segment": {"ne": "BUILDING"}}}, f"select {_C} from customer where c_mktsegment is distinct from 'BUILDING'")
_add("filter_range_number", {"object": "customer", "properties": _KEY, "filter": {"balance": {"gte": 1000, "lt": 5000.5}}}, f"select {_C} from customer where c_acctbal >= 1000 and c_acctbal < 5000.5")
_add("filter_text_has_no_order", {"object": "customer", "properties": _KEY, "filter": {"name": {"gt": "A"}}}, f"select {_C} from customer where false")
_add("filter_in", {"object": "order", "properties": ["order_key"], "filter": {"priority": {"in": ["1-URGENT", "2-HIGH", None]}}}, "select o_orderkey as order_key from orders where o_orderpriority in ('1-URGENT', '2-HIGH')")
_add("filter_empty_in", {"object": "customer", "properties": _KEY, "filter": {"segment": {"in": []}}}, f"select {_C} from customer where false")
_add("filter_contains", {"object": "part", "properties": ["part_key", "name"], "filter": {"name": {"contains": "a"}}}, "select p_partkey as part_key, p_name as name from part where contains(p_name, 'a')")
_add("filter_block_and_keys", {"object": "part", "properties": ["part_key"], "filter": {"size": {"gt": 10, "lte": 30, "ne": 20}, "price": {"gt": 900}}}, "select p_partkey as part_key from part where p_size > 10 and p_size <= 30 and p_size <> 20 and p_retailprice > 900")
_add("filter_range_date", {"object": "event", "properties": ["event_id", "user"], "filter": {"at": {"gte": "2024-01-15", "lt": "2024-01-20 12:00:00"}}}, "select event_id, user_id as user from events where ts is null or (epoch(ts) // 1 >= epoch(timestamp '2024-01-15') and epoch_ms(ts) // 1000 < epoch(timestamp '2024-01-20 12:00:00'))".replace("ts is null or (epoch(ts) // 1", "(epoch_ms(ts) // 1000"))
_add("filter_date_math", {"object": "event", "properties": ["event_id"], "filter": {"at": {"gte": "now-1y+1w/d"}}}, "select event_id from events where ts is null or epoch_ms(ts) // 1000 >= ((1735689600 - 31536000 + 604800) // 86400) * 86400")
_add("filter_week_floor", {"object": "event", "properties": ["event_id"], "filter": {"at": {"lt": "now-49w/w"}}}, "select event_id from events where epoch_ms(ts) // 1000 < ((1735689600 - 49 * 604800) // 604800) * 604800")
_add("filter_two_properties", {"object": "line", "properties": ["order_key", "line_no"], "filter": {"discount": {"gt": {"property": "tax"}}}}, "select l_orderkey as order_key, l_linenumber as line_no from lineitem where l_discount > l_tax")
_add("filter_null", {"object": "equipment", "properties": ["serial_no"], "filter": {"mark": None}}, f"with {_EQUIPMENT} select serial_no from equipment where device and mark is null")
_add("filter_not_null", {"object": "equipment", "properties": ["serial_no"], "filter": {"mark": {"ne": None}}}, f"with {_EQUIPMENT} select serial_no from equipment where device and mark is not null")
_add("filter_ne_skips_undefined", {"object": "equipment", "properties": ["serial_no"], "filter": {"mark": {"ne": "in use"}}}, f"with {_EQUIPMENT} select serial_no from equipment where device and mark is distinct from 'in use'")
_add("filter_open_interval", {"object": "assignment", "properties": ["id"], "filter": {"valid_from": {"lte": "2024-06-01"}, "valid_to": {"gt": "2024-06-01"}}}, "select id from assignment where valid_from <= 1717200000 and (valid_to is null or valid_to > 1717200000)")
_add("filter_null_bound", {"object": "assignment", "properties": ["id"], "filter": {"valid_from": {"lt": None}}}, "select id from assignment where valid_from is not null")
_add("filter_from_to", {"object": "repair", "properties": ["id"], "filter": {"ended_at": {"gt": {"property": "started_at"}}}}, "select id from repair where ended_at is null or coalesce(ended_at > started_at, false)")
_add("identity_lookup", {"object": "order", "identity": 42, "properties": ["order_key", "stage", "customer_key"]}, f"with {_ORDERS} select order_key, stage, customer_key from aligned where order_key = 42")
_add("identity_operand", {"object": "order", "identity": 7, "properties": ["order_key"], "filter": {"order_key": {"from": "identity"}}}, "select o_orderkey as order_key from orders where o_orderkey = 7")
_add("order_desc_limit", {"object": "customer", "properties": ["customer_key", "balance"], "order": {"balance": "desc"}, "limit": 25}, "select c_custkey as customer_key, c_acctbal as balance from customer order by c_acctbal desc nulls first, c_custkey limit 25", most=True)
_add("order_asc_nulls_last", {"object": "equipment", "properties": ["serial_no", "reason"], "order": {"reason": "asc"}, "limit": 100}, f"with {_EQUIPMENT} select serial_no, x.reason from equipment left join x1 x on x.sn = serial_no order by x.reason asc nulls last, serial_no limit 100", most=True)
_add("agg_count", {"object": "customer", "aggregate": {"group_by": ["segment"], "metrics": [{"count": "*"}]}}, "select c_mktsegment as segment, count(*) as count from customer group by 1")
_add("agg_numbers", {"object": "customer", "aggregate": {"group_by": ["segment"], "metrics": [{"count": "balance"}, {"avg": "balance"}, {"sum": "balance"}, {"min": "balance"}, {"max": "balance"}]}},
     "select c_mktsegment as segment, count(c_acctbal) as count_balance, round(avg(c_acctbal), 6) as avg_balance, round(coalesce(sum(c_acctbal), 0), 4) as sum_balance, min(c_acctbal) as min_balance, max(c_acctbal) as max_balance from customer group by 1",
     lambda df: df.withColumns({"avg_balance": F.round("avg_balance", 6), "sum_balance": F.round("sum_balance", 4)}))
_add("agg_global", {"object": "line", "aggregate": {"group_by": [], "metrics": [{"count": "*"}, {"max": "price"}, {"min": "quantity"}]}}, "select count(*) as count, max(l_extendedprice) as max_price, min(l_quantity) as min_quantity from lineitem")
_add("agg_global_empty", {"object": "customer", "filter": {"segment": "none such"}, "aggregate": {"metrics": [{"count": "*"}, {"sum": "balance"}, {"avg": "balance"}]}}, "select count(*) as count, coalesce(sum(c_acctbal), 0.0) as sum_balance, avg(c_acctbal) as avg_balance from customer where false")
_add("agg_text_is_no_number", {"object": "customer", "aggregate": {"group_by": ["segment"], "metrics": [{"sum": "name"}, {"count": "name"}]}}, "select c_mktsegment as segment, 0.0::double as sum_name, count(c_name) as count_name from customer group by 1")
_add("agg_by_stage", {"object": "order", "aggregate": {"group_by": ["stage"], "metrics": [{"count": "*"}, {"max": "total"}]}}, f"with {_ORDERS} select stage, count(*) as count, max(total) as max_total from aligned group by stage")
_add("agg_line_flags", {"object": "line", "filter": {"shipped_on": {"lte": "1998-09-02"}}, "aggregate": {"group_by": ["return_flag", "line_status"], "metrics": [{"count": "*"}, {"sum": "quantity"}]}},
     "select l_returnflag as return_flag, l_linestatus as line_status, count(*) as count, sum(l_quantity) as sum_quantity from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2")
_add("align_order_stage", {"object": "order", "properties": ["order_key", "stage", "total", "return_flag"]}, f"with {_ORDERS} select order_key, stage, total, return_flag from aligned")
_add("align_stage_filter", {"object": "order", "properties": ["order_key", "total"], "filter": {"stage": "returned"}}, f"with {_ORDERS} select order_key, total from aligned where stage = 'returned'")
_add("align_absent_source", {"object": "order", "properties": ["order_key"], "filter": {"stage": "placed"}}, "select o_orderkey as order_key from orders where o_orderkey not in (select l_orderkey from lineitem where l_orderkey is not null)")
_add("align_dup_first", {"object": "order", "properties": ["order_key", "quantity"], "filter": {"quantity": {"gte": 0}}}, f"with {_FIRST} select l_orderkey as order_key, l_quantity as quantity from first_line where l_quantity >= 0")
_add("align_key_override", {"object": "account", "properties": ["account_key", "name", "last_event", "activity"]},
     """with e1 as (select * from (select *, row_number() over (partition by user_id order by ts, event_id) as nth from events where user_id is not null) where nth = 1)
     select c_custkey as account_key, c_name as name, event_type as last_event,
     case when c_custkey is not null and user_id is not null then 'active' when c_custkey is not null then 'dormant' else 'unknown' end as activity
     from customer full outer join e1 on c_custkey = user_id""")  # fmt: skip
_add("align_dirty_keys", {"object": "equipment", "properties": ["serial_no", "name", "status"]}, f"with {_EQUIPMENT} select serial_no, name, status from equipment")
_add("link_true", {"object": "customer", "properties": ["customer_key"], "filter": {"$link": {"orders": True}}}, "select c_custkey as customer_key from customer where exists (select 1 from orders where o_custkey = c_custkey)")
_add("link_false", {"object": "customer", "properties": ["customer_key"], "filter": {"$link": {"orders": False}}}, "select c_custkey as customer_key from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
_add("link_filter", {"object": "customer", "properties": ["customer_key"], "filter": {"$link": {"orders": {"order_status": "O", "total": {"gte": 400000}}}}}, "select c_custkey as customer_key from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'O' and o_totalprice >= 400000)")
_add("link_nested", {"object": "order", "properties": ["order_key"], "filter": {"$link": {"placed_by": {"$link": {"in_nation": {"$link": {"in_region": {"name": "ASIA"}}}}}}}},
     "select o_orderkey as order_key from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA'")
_add("link_inverse", {"object": "region", "properties": ["region_key", "name"], "filter": {"$link": {"nations": {"$link": {"suppliers": True}}}}}, "select r_regionkey as region_key, r_name as name from region where exists (select 1 from nation join supplier on s_nationkey = n_nationkey where n_regionkey = r_regionkey)")
_add("link_null_pair", {"object": "equipment", "properties": ["serial_no"], "filter": {"$link": {"belongs_to": False}}}, f"with {_EQUIPMENT} select serial_no from equipment where not exists (select 1 from department where dept_id = dept)")
_add("link_two_pairs", {"object": "supplier", "properties": ["supplier_key"], "filter": {"$link": {"twin": True}}}, "select s_suppkey as supplier_key from supplier where exists (select 1 from customer where c_nationkey = s_nationkey and c_custkey = s_suppkey)")
_add("link_self", {"object": "supplier", "properties": ["supplier_key"], "filter": {"$link": {"same_nation": {"balance": {"gt": 9000}}}}}, "select s_suppkey as supplier_key from supplier s where exists (select 1 from supplier t where t.s_nationkey = s.s_nationkey and t.s_acctbal > 9000)")
_add("bool_derived", {"object": "customer", "aggregate": {"group_by": ["has_urgent_order"], "metrics": [{"count": "*"}]}}, "select exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT' and o_totalprice >= 400000) as has_urgent_order, count(*) as count from customer group by 1")
_add("bool_derived_negated", {"object": "equipment", "properties": ["serial_no"], "filter": {"ever_repaired": False}}, f"with {_EQUIPMENT} select serial_no from equipment e where not exists (select 1 from repair r where r.serial_no = e.serial_no)")
_add("derived_on_derived", {"object": "customer", "properties": ["customer_key", "good_standing"]}, "select c_custkey as customer_key, coalesce(c_acctbal >= 0, false) and not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT' and o_totalprice >= 400000) as good_standing from customer")
_add("derived_of_stage", {"object": "order", "properties": ["order_key"], "filter": {"late_and_large": True}}, f"with {_ORDERS} select order_key from aligned where stage = 'shipped' and total > 200000")
_add("transition_holds", {"object": "order", "properties": ["order_key"], "filter": {"$link": {"fulfilled": True}}}, f"with {_ORDERS} select order_key from aligned where header and shipment")
_add("transition_not", {"object": "order", "properties": ["order_key"], "filter": {"$link": {"fulfilled": False}}}, f"with {_ORDERS} select order_key from aligned where not (header and shipment)")
_add("temporal_asof", {"object": "assignment", "properties": ["id", "serial_no", "dept_id"], "filter": {"valid_from": {"lte": "2025-01-01"}, "valid_to": {"gt": "2025-01-01"}, "$link": {"of_equipment": {"status": "in_service"}}}},
     f"with {_EQUIPMENT} select a.id, a.sn as serial_no, a.dept_id from assignment a where valid_from <= 1735689600 and (valid_to is null or valid_to > 1735689600) and exists (select 1 from equipment e where e.serial_no = a.sn and e.status = 'in_service')")
_add("expand_flat", {"object": "nation", "properties": ["nation_key"], "expand": [{"relation": "customers", "properties": ["customer_key", "balance"], "filter": {"balance": {"gt": 5000}}}]},
     "select n_nationkey as nation_key, c_custkey as customer_key, c_acctbal as balance from nation join customer on c_nationkey = n_nationkey where c_acctbal > 5000",
     lambda df: df.select("nation_key", F.inline("customers")))
_add("expand_forward", {"object": "order", "properties": ["order_key"], "filter": {"total": {"gte": 450000}}, "expand": [{"relation": "placed_by", "properties": ["name"]}]},
     "select o_orderkey as order_key, c_name as name from orders left join customer on o_custkey = c_custkey where o_totalprice >= 450000",
     lambda df: df.select("order_key", F.inline_outer("placed_by")))
_add("expand_nested_count", {"object": "region", "properties": ["name"], "expand": [{"relation": "nations", "properties": ["nation_key"], "expand": [{"relation": "customers", "properties": ["customer_key"]}]}]},
     "select r_name as name, count(distinct n_nationkey) as nations, count(c_custkey) as customers from region left join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey group by 1",
     lambda df: df.select("name", F.size("nations").cast("long").alias("nations"), F.aggregate("nations", F.lit(0).cast("long"), lambda a, n: a + F.size(n["customers"])).alias("customers")))
_add("expand_transition", {"object": "order", "properties": ["order_key"], "expand": [{"relation": "fulfilled", "properties": ["stage"]}]},
     f"with {_ORDERS} select order_key, case when header and shipment then 1 else 0 end::int as n from aligned",
     lambda df: df.select("order_key", F.size("fulfilled").alias("n")))
_add("expand_empty", {"object": "customer", "properties": ["customer_key"], "expand": [{"relation": "orders", "properties": ["order_key"], "filter": {"total": {"gt": 499000}}}]},
     "select c_custkey as customer_key, (select count(*) from orders where o_custkey = c_custkey and o_totalprice > 499000)::int as n from customer",
     lambda df: df.select("customer_key", F.size("orders").alias("n")))
_add("flagship_shipped_orders", {"object": "order", "properties": ["order_key", "total", "shipped_on"], "filter": {"stage": "shipped"}, "expand": [{"relation": "placed_by", "properties": ["name", "segment"]}]},
     f"with {_ORDERS} select order_key, total, strftime(shipped_on, '%Y-%m-%d') as shipped_on, c_name as name, c_mktsegment as segment from aligned left join customer on customer_key = c_custkey where stage = 'shipped'",
     lambda df: df.select("order_key", "total", F.date_format("shipped_on", "yyyy-MM-dd").alias("shipped_on"), F.inline_outer("placed_by")))


def _frame(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


def _values(schema: str, rows: list[tuple]) -> str:
    """Rows as SQL, with the names and types of a schema."""
    types = {"int": "integer", "long": "bigint", "string": "varchar", "boolean": "boolean", "double": "double"}
    columns = [c.strip().split() for c in schema.split(",")]

    def literal(v) -> str:
        return "null" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)

    shown = ", ".join(f'"{n}"::{types[t]} as "{n}"' for n, t in columns)
    return f"select {shown} from (values {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) as t({', '.join(f'"{n}"' for n, _ in columns)})"


def _overlap(a: str, b: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, at: integrate.overlap(engine(spark, at), a, b)


def _overlap_sql(a: str, b: str, from_a: str, from_b: str, rule: str) -> str:
    return f"""with a as (select distinct v from ({from_a}) where v is not null), b as (select distinct v from ({from_b}) where v is not null)
    select '{a}' as class_a, '{b}' as class_b, '{rule}' as norm_rule, (select count(*) from a) as count_a, (select count(*) from b) as count_b,
    (select count(*) from a join b using (v)) as count_hit,
    (select count(*) from a join b using (v))::double / greatest((select count(*) from a), (select count(*) from b)) as rate"""


_frame("overlap_customers_and_suppliers", _overlap("customer", "supplier"), _overlap_sql("customer", "supplier", "select c_custkey::varchar as v from customer", "select s_suppkey::varchar as v from supplier", "plain"))
_frame("overlap_over_sources", _overlap("order", "order_line"), _overlap_sql("order", "order_line", "select o_orderkey::varchar as v from orders union all select l_orderkey::varchar from lineitem", "select l_orderkey::varchar as v from lineitem", "plain"))
_SERIAL = "upper(regexp_replace({0}, '[-\\s\\pZ]', '', 'g'))"
_frame("overlap_normalised", lambda spark, at: integrate.overlap_counts(integrate.texts(read(spark, at, "device"), "serial_no"), integrate.texts(read(spark, at, "repair"), "serial_no"), BY_NAME["serial"]),
       "with " + f"""a as (select distinct {_SERIAL.format('serial_no')} as v from device where regexp_matches(serial_no, '[^\\s\\pZ]')), b as (select distinct {_SERIAL.format('serial_no')} as v from repair where regexp_matches(serial_no, '[^\\s\\pZ]'))
       select 'serial' as norm_rule, (select count(*) from a) as count_a, (select count(*) from b) as count_b, (select count(*) from a join b using (v)) as count_hit,
       (select count(*) from a join b using (v))::double / greatest((select count(*) from a), (select count(*) from b)) as rate""")  # fmt: skip
_frame("key_trial", lambda spark, at: integrate.key_trial(engine(spark, at), "customer", ["supplier"]).where("candidate = 'customer_key' and mate_key = 'supplier_key'").drop("hard"),
       """select 'customer_key' as candidate, count(*) as rows, count(distinct c_custkey) as distinct_values, count(*) = count(distinct c_custkey) as unique_in_each, 'supplier' as mate, 'supplier_key' as mate_key,
       (select count(*) from (select distinct c_custkey from customer) join (select distinct s_suppkey from supplier) on c_custkey = s_suppkey) as hits from customer""")  # fmt: skip
for _rule, _sql in (("serial", _SERIAL.format("serial_no")), ("email", "lower(regexp_replace(serial_no, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g'))"), ("phone", "regexp_replace(regexp_replace(serial_no, '[-\\s\\pZ]', '', 'g'), '^\\+?86', '', 'g')")):
    _frame(f"normalise_{_rule}", lambda spark, at, rule=_rule: read(spark, at, "device").select("dev_id", BY_NAME[rule].column(F.col("serial_no")).alias("normalised")), f"select dev_id, {_sql} as normalised from device")
_frame("mask", lambda spark, at: read(spark, at, "customer").select("c_custkey", masked(F.col("c_name")).alias("c_name")), "select c_custkey, case when length(c_name) <= 6 then '******' else substring(c_name, 1, 4) || '******' || right(c_name, 2) end as c_name from customer")
_frame("acceptance_pack", lambda spark, at: spark.createDataFrame([(o.question, o.ok) for o in run_pack(engine(spark, at), RETAIL_PACK)], "question string, ok boolean"),
       "select * from (values " + ", ".join(f"('{q['question']}', true)" for q in RETAIL_PACK) + ") as t(question, ok)")


def _split() -> dict:
    """Header and shipment of an order as two classes, to be merged again."""
    order = MODEL["object_types"]["order"]
    parts = {"header": ("header", ["order_key", "customer_key", "total"]), "shipment": ("shipment", ["order_key", "shipped_on", "return_flag"])}
    return {"object_types": {n: {"kind": "event", "identity": "order_key", "properties": {p: order["properties"][p] for p in ps}, "sources": {s: order["sources"][s] | {"fields": {p: order["sources"][s]["fields"][p] for p in ps}}}} for n, (s, ps) in parts.items()}, "link_types": {}}


def _merged(choice: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, at: str) -> DataFrame:
        model = verdict.apply_verdict(Model.parse(_split()), "header", "shipment", choice, {"from": "placed", "to": "shipped"})
        made = Engine(spark, model, clock=lambda: NOW)
        made.sources.register("retail", files(spark, at))
        return made.rows({"object": "header", "properties": ["order_key", "total", "return_flag"] + (["status"] if choice == verdict.STAGE else [])})

    return run


_frame("merged_same", _merged(verdict.SAME), f"with {_ORDERS} select order_key, total, return_flag from aligned")
_frame("merged_stage", _merged(verdict.STAGE), f"with {_ORDERS} select order_key, total, return_flag, case when header and not shipment then 'placed' when shipment then 'shipped' end as status from aligned")

# Actions over whole tables: one request per order or customer.
_ACTIONS = {
    "order": {
        "raise_priority": {"pre": {"stage": "placed", "priority": {"ne": {"property": "priority", "from": "request"}}}, "effect": [{"update": {"object": "order", "identity": {"from": "identity"}, "properties": {"priority": {"from": "request"}, "total": "current.total+1"}}}]},
        "cancel": {"pre": {"stage": "placed"}, "effect": [{"delete": {"object": "order", "identity": {"from": "identity"}}}]},
        "muddle": {"effect": [{"update": {"object": "order", "identity": {"from": "identity"}, "properties": {"order_status": s}}} for s in ("F", "O")]},
        "ship": {"pre": {"stage": "placed"}, "effect": [{"link": "fulfilled"}]},
    },
    "customer": {"open_account": {"effect": [{"create": {"object": "supplier", "properties": {"supplier_key": {"from": "identity"}, "name": "new", "nation_key": 1, "balance": 0.0}}}]}},
}


def _acting(spark: SparkSession, at: str) -> Engine:
    model = Model.parse(MODEL).to_dict()
    for cls, actions in _ACTIONS.items():
        model["object_types"][cls]["actions"] = actions
    made = Engine(spark, model, clock=lambda: NOW)
    made.sources.register("retail", files(spark, at))
    return made


def _requests(spark: SparkSession, at: str, table: str, key: str) -> DataFrame:
    return read(spark, at, table).select(F.col(key).alias("request_id"), F.col(key).alias("identity"), F.lit("1-URGENT").alias("priority"))


def _action_after(action: str, shown: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, at: str) -> DataFrame:
        batch = _acting(spark, at).plan_actions("order", action, _requests(spark, at, "orders", "o_orderkey"))
        return batch.apply()["retail", "orders" if action != "ship" else "lineitem"].selectExpr(*shown.split("; "))

    return run


_PLACED = "o_orderkey not in (select l_orderkey from lineitem where l_orderkey is not null)"
_frame("action_update", _action_after("raise_priority", "o_orderkey; o_orderpriority; round(o_totalprice, 4) as o_totalprice"),
       f"select o_orderkey, case when {_PLACED} then '1-URGENT' else o_orderpriority end as o_orderpriority, round(case when {_PLACED} and o_orderpriority <> '1-URGENT' then o_totalprice + 1 else o_totalprice end, 4) as o_totalprice from orders")
_frame("action_delete", _action_after("cancel", "o_orderkey; o_custkey"), f"select o_orderkey, o_custkey from orders where not ({_PLACED})")
_frame("action_link", _action_after("ship", "l_orderkey; l_linenumber; l_returnflag"), f"select l_orderkey, l_linenumber, l_returnflag from lineitem union all select o_orderkey, null, null from orders where {_PLACED}")
_frame("action_create_ledger", lambda spark, at: _acting(spark, at).plan_actions("customer", "open_account", _requests(spark, at, "customer", "c_custkey")).ledger().groupBy("object", "op", "outcome").count().withColumnRenamed("count", "n"),
       "select 'supplier' as object, 'insert' as op, case when s_suppkey is null then 'applied' else 'already' end as outcome, count(*) as n from customer left join supplier on s_suppkey = c_custkey group by 3")
_frame("action_conflict", lambda spark, at: _conflicts(spark, at), f"select o_orderkey % 2 = 0 as even, case when o_orderkey % 2 = 0 then 'conflict' else 'applied' end as outcome, count(*) as n from orders where {_PLACED} and o_orderpriority <> '1-URGENT' group by 1, 2")
_frame("action_rejected", lambda spark, at: _acting(spark, at).plan_actions("order", "raise_priority", _requests(spark, at, "orders", "o_orderkey")).rejected.select("request_id", "stage"), f"select o_orderkey as request_id, 'pre' as stage from orders where not ({_PLACED} and o_orderpriority <> '1-URGENT')")
_frame("axiom_mutex", lambda spark, at: _acting(spark, at).plan_actions("order", "muddle", _requests(spark, at, "orders", "o_orderkey")).rejected.groupBy("stage").count().withColumnRenamed("count", "n"), "select 'axiom' as stage, count(*) as n from orders")


def _conflicts(spark: SparkSession, at: str) -> DataFrame:
    """The ledger of an update whose even orders were changed after it was planned."""
    batch = _acting(spark, at).plan_actions("order", "raise_priority", _requests(spark, at, "orders", "o_orderkey"))
    now = read(spark, at, "orders").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") * 2 + 7).otherwise(F.col("o_totalprice")))
    batch.table = lambda source: now
    return batch.ledger().groupBy((F.col("key").cast("long") % 2 == 0).alias("even"), "outcome").agg(F.count(F.lit(1)).alias("n"))
