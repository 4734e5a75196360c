"""Structured queries: a tree rooted in a class, bound to one lazy DataFrame.

``{object, identity, properties, filter, order, limit, aggregate, expand}``. Everything that can be wrong with a request
is rejected while binding; no job runs before the caller asks for rows.

Order and limit come before expansion, which neither adds nor removes individuals, so related rows are fetched only for
those that are returned; their keys are at most :data:`MOST_ROWS` rows, which is what may be broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.dates import request_literal
from tessera.operators.classframe import Binding, ClassFrame, needed_sources
from tessera.plans.errors import Rejected
from tessera.plans.filters import MOST_DEPTH, check_shapes
from tessera.plans.predicates import literal_value

ROWS, MOST_ROWS = 200, 1000
KEYS = {"object", "identity", "properties", "filter", "order", "limit", "aggregate", "expand"}
AGGREGATES = ("count", "avg", "sum", "min", "max")


@dataclass
class Result:
    df: DataFrame
    #: How the request was answered, one line per step.
    path: list[str] = field(default_factory=list)


def metric_name(op: str, of: str) -> str:
    return op if of == "*" else f"{op}_{of}"


def check_request(request: dict) -> None:
    if not isinstance(request, dict) or not isinstance(request.get("object"), str):
        raise Rejected("a query names the class it starts from")
    if extra := set(request) - KEYS:
        raise Rejected(f"unknown keys: {', '.join(sorted(extra))}")
    if (order := request.get("order")) is not None:
        if not isinstance(order, dict) or len(order) != 1 or next(iter(order.values())) not in ("asc", "desc"):
            raise Rejected("order has one key, asc or desc")
    if (limit := request.get("limit")) is not None and (isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= MOST_ROWS):
        raise Rejected(f"limit is a whole number from 1 to {MOST_ROWS}")
    if (a := request.get("aggregate")) is not None:
        if request.get("expand"):
            raise Rejected("an aggregate has no individuals to expand")
        metrics = a.get("metrics") if isinstance(a, dict) else None
        if not metrics or any(not isinstance(m, dict) or len(m) != 1 for m in metrics):
            raise Rejected("an aggregate has metrics of one operator each")
        ops = [next(iter(m)) for m in metrics]
        if unknown := [op for op in ops if op not in AGGREGATES]:
            raise Rejected(f"unknown aggregate {unknown[0]!r}")
        if len(set(ops)) != len(ops):
            raise Rejected("an aggregate has each operator once")
    check_shapes(request.get("filter") or {})

    def nest(nodes, depth: int) -> None:
        for node in nodes or ():
            if depth > MOST_DEPTH:
                raise Rejected(f"expansions nest more than {MOST_DEPTH} deep")
            if not isinstance(node, dict) or not isinstance(node.get("relation"), str):
                raise Rejected("an expansion names a relation")
            check_shapes(node.get("filter") or {})
            nest(node.get("expand"), depth + 1)

    nest(request.get("expand"), 1)


def _metric(frame: ClassFrame, op: str, of: str) -> Column:
    name = metric_name(op, of)
    if op == "count":
        return F.count(F.lit(1) if of == "*" else F.when(frame.value(of)[1], frame.value(of)[0].column)).alias(name)
    value, defined = frame.value(of)
    if value.kind != "number":
        frame.binding.notes.append(f"{of} is no number and takes no part in {op}")
        # Only numbers take part: a sum of none is 0, the others have no value.
        return (F.coalesce(F.max(F.lit(0.0)), F.lit(0.0)) if op == "sum" else F.max(F.lit(None).cast("double"))).alias(name)
    number = F.when(defined, value.column)
    found = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[op](number)
    return (F.coalesce(found, F.lit(0)) if op == "sum" else found).alias(name)


def _aggregate(frame: ClassFrame, spec: dict) -> DataFrame:
    group = list(spec.get("group_by") or ())
    if len(set(group)) != len(group):
        raise Rejected("a property is grouped by once")
    metrics = [(op, of) for m in spec["metrics"] for op, of in m.items()]
    for _, of in metrics:
        if of != "*":
            frame.property(of)
    if any(op != "count" and of == "*" for op, of in metrics):
        raise Rejected("only count takes '*'")
    keys = [(g, *frame.value(g)) for g in group]
    columns = [_metric(frame, op, of) for op, of in metrics]
    if not group:
        return frame.df.agg(*columns)
    # An undefined value groups with the nulls.
    frame.df = frame.df.withColumns({f"{frame.tag}g_{g}": F.when(defined, value.column) for g, value, defined in keys})
    return frame.df.groupBy(*(F.col(f"{frame.tag}g_{g}").alias(g) for g, _, _ in keys)).agg(*columns)


def _sort(name: str, direction: str) -> Column:
    return F.col(name).asc_nulls_last() if direction == "asc" else F.col(name).desc_nulls_first()


def _names(frame: ClassFrame, wanted: list[str] | None) -> list[str]:
    names = list(wanted) if wanted is not None else list(frame.cls.properties)
    for n in names:
        frame.property(n)
    return names


#: How many rows of a class an expansion starts from: at most MOST_ROWS, those related to such, or all.
FEW, NEAR, ALL = range(3)


def _expand(frame: ClassFrame, nodes: list[dict], start: int) -> list[str]:
    """Adds one array column per expansion to a frame; gives their names.

    From few individuals, related rows are first cut down to theirs, at the price of reading the few again; from all of
    them that would only compute everything twice.
    """
    made = []
    for node in nodes or ():
        hop = frame.hop(node["relation"])
        column = f"{frame.tag}e_{node['relation']}"
        if hop.link.transition:
            if node.get("filter") or node.get("expand"):
                raise Rejected(f"{node['relation']} is a transition; it takes no filter and no further expansion")
            own = F.struct(*(frame.output(n) for n in _names(frame, node.get("properties"))))
            holds = frame.transition(hop)
            frame.df = frame.df.withColumn(column, F.when(holds, F.array(own)).otherwise(F.array().cast(f"array<{frame.df.select(own.alias('x')).schema['x'].dataType.simpleString()}>")))
            made.append(node["relation"])
            continue
        target = frame.target(hop, node.get("filter"))
        pairs = frame.paired(hop, target)
        ours = {f"{column}_{i}": a for i, (a, _) in enumerate(pairs)}
        theirs = {f"{column}_t{i}": b for i, (_, b) in enumerate(pairs)}
        frame.df, target.df = frame.df.withColumns(ours), target.df.withColumns(theirs)
        on = [F.col(a) == F.col(b) for a, b in zip(ours, theirs)]
        if start != ALL:
            wanted = frame.df.select(*ours).distinct()
            target.df = target.df.join(F.broadcast(wanted) if start == FEW else wanted, on, "left_semi")
        names = _names(target, node.get("properties"))
        inner = _expand(target, node.get("expand"), ALL if start == ALL else NEAR)
        item = F.struct(*(target.output(n) for n in names), *(F.col(f"{target.tag}e_{r}").alias(r) for r in inner))
        # In the order of the target's key, whatever the columns shown are.
        by_key = F.array_sort(F.collect_list(F.struct(target.key.alias("key"), item.alias("item")))) if not inner else F.collect_list(F.struct(target.key.alias("key"), item.alias("item")))
        rows = target.df.groupBy(*theirs).agg(F.transform(by_key, lambda x: x["item"]).alias(column))
        frame.df = frame.df.join(rows, on, "left").drop(*theirs)
        kind = rows.schema[column].dataType.simpleString()
        frame.df = frame.df.withColumn(column, F.coalesce(F.col(column), F.array().cast(kind)))
        made.append(node["relation"])
    return made


def _expand_flat(frame: ClassFrame, nodes: list[dict]) -> list[str]:
    """Adds one struct column: an individual has a row for each related one, or one row without any."""
    if len(nodes or ()) > 1:
        raise Rejected("only one chain of relations can be shown row by row")
    for node in nodes or ():
        hop = frame.hop(node["relation"])
        if hop.link.transition:
            raise Rejected(f"{node['relation']} is a transition and has no rows of its own")
        target = frame.target(hop, node.get("filter"))
        column = f"{frame.tag}e_{node['relation']}"
        pairs = frame.paired(hop, target)
        theirs = {f"{column}_t{i}": b for i, (_, b) in enumerate(pairs)}
        ours = {f"{column}_{i}": a for i, (a, _) in enumerate(pairs)}
        frame.df, target.df = frame.df.withColumns(ours), target.df.withColumns(theirs)
        names = _names(target, node.get("properties"))
        for n in names:
            target.value(n)
        inner = _expand_flat(target, node.get("expand"))
        item = F.struct(*(target.output(n) for n in names), *(F.col(f"{target.tag}e_{r}").alias(r) for r in inner))
        rows = target.df.select(*theirs, item.alias(column))
        frame.df = frame.df.join(rows, [F.col(a) == F.col(b) for a, b in zip(ours, theirs)], "left").drop(*theirs)
    return [node["relation"] for node in nodes or ()]


def run_query(binding: Binding, request: dict, *, most: int | None = MOST_ROWS, flat: bool = False) -> Result:
    """The DataFrame of a request. ``most`` None lifts the limit on rows (for queries within the library).

    ``flat`` shows related individuals row by row, as structs, in place of one array per individual, so that nothing is
    gathered however many there are.
    """
    check_request(request)
    cls = request["object"]
    if cls not in binding.model.object_types:
        raise Rejected(f"there is no class {cls!r}")
    identity = None
    if (named := request.get("identity")) is not None:
        plain = request_literal(named, binding.clock) if not isinstance(named, str) else named
        binding.identity = identity = literal_value(plain)
    filter_ = request.get("filter") or {}
    required, absent = needed_sources(binding.model.object(cls), filter_)
    frame = ClassFrame(binding, cls, identity=identity, required=required, absent=absent)
    if frame.cls.rows_only and (request.get("expand") or not request.get("aggregate")) and named is not None:
        raise Rejected(f"{cls} has no key to name one row by")
    frame.where(filter_)
    if filter_:
        binding.notes.append(f"filter on {', '.join(filter_)}")
    limit = request.get("limit") or ROWS
    order = next(iter((request.get("order") or {}).items()), None)
    if (spec := request.get("aggregate")) is not None:
        df = _aggregate(frame, spec)
        if order and order[0] not in df.columns:
            raise Rejected(f"order is by an output column, not {order[0]!r}")
        if order:
            ties = [F.col(g).asc_nulls_last() for g in spec.get("group_by") or () if g != order[0]]
            df = df.orderBy(_sort(*order), *ties)
        binding.notes.append(f"aggregate by {', '.join(spec.get('group_by') or ()) or 'nothing'}")
        return Result(df.limit(limit) if most is not None else df, binding.notes)
    names = _names(frame, request.get("properties"))
    if order and order[0] not in names:
        raise Rejected(f"order is by a returned property, not {order[0]!r}")
    for n in names:
        frame.value(n)
    if order:
        made = f"{frame.tag}o"
        frame.df = frame.df.withColumn(made, frame.value(order[0])[0].column).orderBy(_sort(made, order[1]), frame.key.asc_nulls_last())
    if most is not None:
        frame.df = frame.df.limit(limit)
        binding.notes.append(f"at most {limit} rows")
    expanded = _expand_flat(frame, request.get("expand")) if flat else _expand(frame, request.get("expand"), FEW if most is not None else ALL)
    df = frame.df.select(*(frame.output(n) for n in names), *(F.col(f"{frame.tag}e_{r}").alias(r) for r in expanded))
    if order and expanded:
        df = df.orderBy(_sort(*order))  # joins do not keep the order
    return Result(df, binding.notes)


