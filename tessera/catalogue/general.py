"""The general data-processing queries p1 to p4, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalogue.tables import assignments, read, repairs
from tessera.functions.codes import code_form, usable_interval
from tessera.operators.asof import as_known
from tessera.operators.intervals import interval_gaps, interval_periods
from tessera.operators.references import References
from tessera.operators.snapshots import WARN, model_changes


def _intervals(spark: SparkSession, at: str) -> DataFrame:
    both = [df.select(F.lit(name).alias("src"), "sn", "starts", "ends") for name, df in (("assignment", assignments(spark, at)), ("repair", repairs(spark, at)))]
    return both[0].unionByName(both[1]).where(usable_interval(F.col("sn"), F.col("starts"), F.col("ends")))


def p1_found(spark: SparkSession, at: str) -> DataFrame:
    return interval_gaps(_intervals(spark, at), ["src", "sn"], F.col("starts"), F.col("ends"))


def p1_periods(spark: SparkSession, at: str) -> DataFrame:
    return interval_periods(_intervals(spark, at), ["src", "sn"], F.col("starts"), F.col("ends"))


def p2_found(spark: SparkSession, at: str) -> DataFrame:
    facts, events = assignments(spark, at), repairs(spark, at)
    facts = facts.where(usable_interval(F.col("sn"), F.col("starts"), F.col("ends")))
    found = as_known(
        facts.select(F.col("sn").alias("key"), F.col("dept_id").alias("value"), "starts", "ends", F.col("loaded_at").alias("known"), F.col("id").alias("number")),
        events.select(F.col("sn").alias("key"), F.col("repair_no").alias("event"), F.col("starts").alias("at"), F.col("id").alias("number")),
    )
    return found.select(F.col("event").alias("repair_no"), F.col("value").alias("dept_id"))


def _references(spark: SparkSession, at: str) -> References:
    def refs(table: str, number: str, column: str, to: str) -> DataFrame:
        key = F.concat(F.lit(to + "/"), code_form(F.col(column)))
        return read(spark, at, table).select(F.lit(table).alias("src"), F.col(number).alias("ref_id"), key.alias("key"), "loaded_at")

    def targets(table: str, column: str, to: str) -> DataFrame:
        return read(spark, at, table).select(F.concat(F.lit(to + "/"), code_form(F.col(column))).alias("key"), "loaded_at")

    all_refs = refs("device", "dev_id", "dept_id", "department").unionByName(refs("assignment", "id", "sn", "device")).unionByName(refs("repair", "id", "serial_no", "device"))
    return References(
        all_refs,
        targets("department", "dept_id", "department").unionByName(targets("device", "serial_no", "device")),
        targets("disposal", "sn", "device").select("key"),
    )


def p3_found(spark: SparkSession, at: str) -> DataFrame:
    return _references(spark, at).rows()


def p3_counts(spark: SparkSession, at: str) -> DataFrame:
    return _references(spark, at).counts()


def p4_found(spark: SparkSession, at: str) -> DataFrame:
    return model_changes(read(spark, at, "onto_version"), unreadable=WARN)


def p4_canvas(spark: SparkSession, at: str) -> DataFrame:
    """The changes between the configs within the canvases alone, which SQL can read too."""
    versions = read(spark, at, "onto_version").withColumn("yaml", F.lit(None).cast("string"))
    return model_changes(versions)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_periods, p2_found, p3_found, p3_counts, p4_found, p4_canvas)}


_CODE = "nullif(regexp_replace(upper({0}), '[^A-Z0-9]', '', 'g'), '')"
_SECONDS = "case when {0} >= 100000000000 then {0} // 1000 else {0} end"
_USABLE = f"""usable as (
  select src, sn, f, coalesce(t, 4611686018427387904) as t from (
    select 'assignment' as src, {_CODE.format("sn")} as sn, {_SECONDS.format("valid_from")} as f, {_SECONDS.format("valid_to")} as t from assignment
    union all
    select 'repair', {_CODE.format("serial_no")}, {_SECONDS.format("started_at")}, {_SECONDS.format("ended_at")} from repair)
  where sn is not null and f is not null and (t is null or t > f))"""
_REFS = f"""refs as (
    select 'device' as src, dev_id as ref_id, 'department/' || {_CODE.format("dept_id")} as k, loaded_at from device
    union all select 'assignment', id, 'device/' || {_CODE.format("sn")}, loaded_at from assignment
    union all select 'repair', id, 'device/' || {_CODE.format("serial_no")}, loaded_at from repair),
  known as (
    select k, min(loaded_at) as first from (
      select 'department/' || {_CODE.format("dept_id")} as k, loaded_at from department
      union all select 'device/' || {_CODE.format("serial_no")}, loaded_at from device)
    where k is not null group by k),
  gone as (select distinct 'device/' || {_CODE.format("sn")} as k from disposal where {_CODE.format("sn")} is not null),
  faults as (
    select src, ref_id, strftime(r.loaded_at at time zone 'UTC', '%Y-%m') as period,
           case when n.k is null then case when g.k is null then 'missing' else 'deleted' end when r.loaded_at < n.first then 'late' end as kind
    from refs r left join known n on r.k = n.k left join gone g on r.k = g.k where r.k is not null)"""

ORACLE: dict[str, str] = {
    "p1_found": f"""with {_USABLE},
      runs as (select *, max(t) over (partition by src, sn order by f, t rows between unbounded preceding and 1 preceding) as upto from usable)
      select src, sn, upto as gap_from, f as gap_to from runs where upto < f""",
    "p1_periods": f"""with {_USABLE},
      runs as (select *, max(t) over (partition by src, sn order by f, t rows between unbounded preceding and 1 preceding) as upto from usable),
      islands as (select *, sum(case when upto >= f then 0 else 1 end) over (partition by src, sn order by f, t rows unbounded preceding) as island from runs)
      select src, sn, min(f) as period_from, nullif(max(t), 4611686018427387904) as period_to from islands group by src, sn, island""",
    "p2_found": f"""with a as (
        select id, {_CODE.format("sn")} as sn, {_CODE.format("dept_id")} as dept_id, {_SECONDS.format("valid_from")} as f, {_SECONDS.format("valid_to")} as t, loaded_at from assignment),
      r as (select id, repair_no, {_CODE.format("serial_no")} as sn, {_SECONDS.format("started_at")} as s from repair),
      pairs as (
        select r.repair_no, r.id, a.dept_id, row_number() over (partition by r.repair_no order by r.id, a.f desc, a.loaded_at desc, a.id desc) as nth
        from r join a on r.sn = a.sn and a.f <= r.s and (a.t is null or (a.t > r.s and a.t > a.f)) and epoch_us(a.loaded_at) <= r.s * 1000000
        where a.dept_id is not null and r.repair_no is not null)
      select repair_no, dept_id from pairs where nth = 1""",
    "p3_found": f"with {_REFS} select src, ref_id, kind, period from faults where kind is not null",
    "p3_counts": f"with {_REFS} select src, period, kind, count(*) as n from faults where kind is not null group by src, period, kind",
    "p4_canvas": """with packs as (
    select id, workspace_id, version, canvas_json::json as j from onto_version
    where workspace_id is not null and version is not null and case when json_valid(canvas_json) then json_type(canvas_json, '$.config') end = 'OBJECT'),
  parts as (select id, workspace_id, version, section, json_extract(j, '$.config.' || section) as entries from packs, (values ('object_types'), ('link_types')) as s(section)),
  records as (select p.id, workspace_id, version, section || '.' || e.key as record, e.value from parts p, json_each(p.entries) e where json_type(p.entries) = 'OBJECT'),
  contents as (
    select r.id, r.workspace_id, r.version, r.record,
           md5(string_agg(t.fullkey || ':' || case when t.type in ('UBIGINT', 'BIGINT', 'DOUBLE') then 'N' || t.atom::varchar::double else t.type || coalesce(t.atom::varchar, '') end, '|' order by t.fullkey)) as content
    from records r, json_tree(r.value) t group by all),
  held as (select workspace_id, version, record, max(content) as content from contents group by all),
  steps as (select workspace_id, version, lag(version) over (partition by workspace_id order by version) as before from (select distinct workspace_id, version from packs)),
  pairs as (
    select s.workspace_id, s.version, coalesce(n.record, o.record) as record, o.content as old, n.content as new
    from (select s.workspace_id, s.version, h.record, h.content from steps s join held h using (workspace_id, version) where before is not null) n
    full join (select s.workspace_id, s.version, h.record, h.content from steps s join held h on h.workspace_id = s.workspace_id and h.version = s.before) o
      on n.workspace_id = o.workspace_id and n.version = o.version and n.record = o.record
    join steps s on s.workspace_id = coalesce(n.workspace_id, o.workspace_id) and s.version = coalesce(n.version, o.version))
  select workspace_id, version, record, case when old is null then 'added' when new is null then 'removed' else 'changed' end as change from pairs where old is distinct from new""",
}
