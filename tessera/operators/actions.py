"""Batches of actions: requests in, change sets out.

A batch is a DataFrame of requests (``request_id``, ``identity`` and one column per parameter) for one action of a class.
All requests are checked and planned together, by joins with the class frame; nothing loops over requests. The requests
beside their individuals are stored once, and all that follows is read from there. Planning changes nothing. :meth:`Batch.ledger` compares the change sets with the tables as they are now, and :meth:`Batch.apply`
gives the tables after them:

* an update names the key and the values it was planned on; where they differ now it is a ``conflict``, unless the new
  values are there ``already``;
* an insert whose key exists is there ``already``; of several for one key the first request's counts;
* a delete removes the rows of the keys it names.

Sources are written independently; there is no rollback. Requests on one individual depend on each other, so
:func:`waves` splits a batch where an identity repeats.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.dates import format_utc, now_expression, request_literal
from tessera.functions.ids import number_expression, snowflake_column
from tessera.operators.classframe import Binding, ClassFrame, needed_sources
from tessera.plans.errors import Rejected
from tessera.plans.filters import check_shapes, is_block
from tessera.plans.model import ObjectType, Source
from tessera.plans.validate import effects
from tessera.plans.predicates import Value, column_value, two_valued
from tessera.plans.shared import store

REQUEST = "request_id"
#: Bits of a row's place within its partition in the numbers Spark gives rows.
PLACE_BITS = 33


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """The rows, stored, with their place in the order of a column: sorted range by range, the ranges' sizes added up."""
    held = store(df.repartitionByRange(by).sortWithinPartitions(by).withColumn("__at", F.monotonically_increasing_id()))
    sizes = held.groupBy(F.shiftright("__at", PLACE_BITS).cast("int").alias("__part")).count().orderBy("__part").collect()
    before = [(p, sum(n for _, n in sizes[:i])) for i, (p, n) in enumerate(sizes)]
    # One row for each partition of the sort.
    offsets = df.sparkSession.createDataFrame(before, "__part int, __before long")
    place = F.col("__at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    found = held.withColumn("__part", F.shiftright("__at", PLACE_BITS).cast("int")).join(F.broadcast(offsets), "__part", "left")
    return found.withColumn(name, place + F.coalesce("__before", F.lit(0))).drop("__part", "__at", "__before")


@dataclass
class Change:
    """A change set of one source. ``rows``: request_id, key, and ``new_<i>`` (``old_<i>``) for each of ``columns``."""

    op: str
    cls: ObjectType
    source: Source
    rows: DataFrame
    columns: list[str] = field(default_factory=list)

    @property
    def key_column(self) -> str:
        return self.source.fields[self.cls.key_of(self.source)]


@dataclass
class Batch:
    accepted: DataFrame
    #: request_id, stage (pre, effect or axiom), reason.
    rejected: DataFrame
    changes: list[Change]
    notifications: DataFrame | None
    table: Callable[[Source], DataFrame]

    def _judged(self, c: Change) -> DataFrame:
        """The rows of a change set with their ``outcome``."""
        now = self.table(c.source)
        key = F.col(f"`{c.key_column}`")
        rows = c.rows
        if c.op == "insert":
            rows = rows.withColumn("__nth", F.row_number().over(Window.partitionBy("key").orderBy(REQUEST)))
        current = now.select(key.alias("__key"), *(F.col(f"`{x}`").alias(f"now_{i}") for i, x in enumerate(c.columns))) if c.op == "update" else now.select(key.alias("__key")).distinct()
        joined = rows.join(current, F.col("key") == F.col("__key").cast(rows.schema["key"].dataType), "left")
        there = F.col("__key").isNotNull()
        if c.op == "insert":
            return joined.withColumn("outcome", F.when(there | (F.col("__nth") > 1), "already").otherwise("applied"))
        if c.op == "delete":
            return joined.withColumn("outcome", F.when(there, "applied").otherwise("conflict"))

        def all_equal(side: str) -> Column:
            return reduce(Column.__and__, [F.col(f"now_{i}").eqNullSafe(F.col(f"{side}_{i}")) for i in range(len(c.columns))])

        return joined.withColumn("outcome", F.when(there & all_equal("old"), "applied").when(there & all_equal("new"), "already").otherwise("conflict"))

    def ledger(self) -> DataFrame:
        """request_id, object, source, table, op, key, outcome: one row per attempted write."""
        parts = [self._judged(c).select(REQUEST, F.lit(c.cls.name).alias("object"), F.lit(c.source.name).alias("source"), F.lit(c.source.table).alias("table"), F.lit(c.op).alias("op"), F.col("key").cast("string").alias("key"), "outcome") for c in self.changes]
        if not parts:
            return self.accepted.sparkSession.createDataFrame([], "request_id string, object string, source string, table string, op string, key string, outcome string")
        return reduce(DataFrame.unionByName, parts)

    def apply(self) -> dict[tuple[str, str], DataFrame]:
        """The changed tables, by connection and table."""
        tables: dict[tuple[str, str], DataFrame] = {}
        for c in self.changes:
            at = (c.source.connection, c.source.table)
            now = tables.get(at, self.table(c.source))
            key = F.col(f"`{c.key_column}`")
            if c.op == "insert":
                rows = self._judged(c).where(F.col("outcome") == "applied")
                given = {x: F.col(f"new_{i}") for i, x in enumerate(c.columns)}
                new = rows.select(*((given[f.name] if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in now.schema))
                tables[at] = now.unionByName(new)
                continue
            same = key.cast(c.rows.schema["key"].dataType) == F.col("__key")
            if c.op == "delete":
                tables[at] = now.join(c.rows.select(F.col("key").alias("__key")), same, "left_anti")
                continue
            # Each row that still has the values its change was planned on; two updates of one key in a batch agree (the
            # axiom check) or are the same, so one is enough.
            changed = c.rows.select(F.col("key").alias("__key"), *(F.col(f"{side}_{i}").alias(f"__{side}_{i}") for i in range(len(c.columns)) for side in ("old", "new"))).dropDuplicates(["__key"])
            index = {x: i for i, x in enumerate(c.columns)}
            valid = reduce(Column.__and__, [F.col("__key").isNotNull(), *(F.col(f"`{x}`").eqNullSafe(F.col(f"__old_{i}")) for x, i in index.items())])
            new = now.join(changed, same, "left").withColumn("__valid", valid)
            tables[at] = new.select(*((F.when(F.col("__valid"), F.col(f"__new_{index[f.name]}").cast(f.dataType)).otherwise(F.col(f"`{f.name}`")) if f.name in index else F.col(f"`{f.name}`")).alias(f.name) for f in now.schema))
        return tables


class Planner:
    """Plans one action for a batch of requests."""

    def __init__(self, binding: Binding, cls: str, action: str, requests: DataFrame) -> None:
        model = binding.model
        self.model, self.binding, self.name = model, binding, action
        if cls not in model.object_types:
            raise Rejected(f"there is no class {cls!r}")
        self.cls = model.object(cls)
        if action not in self.cls.actions:
            raise Rejected(f"{cls} has no action {action!r}")
        self.action = self.cls.actions[action]
        if not {REQUEST, "identity"} <= set(requests.columns):
            raise Rejected("requests have request_id and identity")
        self.parameters = [c for c in requests.columns if c not in (REQUEST, "identity")]
        renamed = requests.select(REQUEST, F.col("identity").alias("r__identity"), *(F.col(f"`{p}`").alias(f"r__{p}") for p in self.parameters))
        # Sequential identifiers number the requests in order, the same on every attempt; nothing else needs that.
        self.requests = numbered(renamed, REQUEST, "r__row") if self._sequential() else renamed.withColumn("r__row", F.lit(0).cast("long"))
        binding.identity = column_value(F.col("r__identity"), renamed.schema["r__identity"].dataType)
        binding.request = {p: column_value(F.col(f"r__{p}"), renamed.schema[f"r__{p}"].dataType) for p in self.parameters}

    def _sequential(self) -> bool:
        """Whether an effect of this action makes sequential identifiers."""
        for _, spec in effects(self.action, "create", "update"):
            for p, v in (spec.get("properties") or {}).items():
                made = self.model.object(spec["object"]).properties.get(p) if isinstance(v, dict) and v.get("from") == "generated" else None
                if made is not None and any(isinstance(i, dict) and i.get("snowflake") for i in made.generate):
                    return True
        return False

    def _frame(self) -> ClassFrame:
        """Requests beside the individuals they name, absent ones with no source present."""
        # An individual that cannot meet the precondition may as well be absent: it is rejected either way.
        required, absent = needed_sources(self.cls, self.action.get("pre") or {})
        frame = ClassFrame(self.binding, self.cls.name, required=required, absent=absent)
        frame.certain = False
        named, key = F.col("r__identity"), frame.key
        if self.requests.schema["r__identity"].dataType != frame.df.schema[frame.tag + "key"].dataType:
            named, key = named.cast("string"), key.cast("string")
        near = frame.df
        if len(self.cls.sources) == 1:
            # Nothing has brought its rows together by key yet, so few requests leave most of them where they are.
            near = near.join(self.requests.select(named.alias("__wanted")).distinct(), key == F.col("__wanted"), "left_semi")
        frame.df = self.requests.join(near, named == key, "left")
        frame.df = frame.df.withColumns({f"{frame.tag}s_{i}": F.coalesce(F.col(f"{frame.tag}s_{i}"), F.lit(False)) for i in range(len(self.cls.sources))})
        return frame

    def value(self, spec, name: str, frame: ClassFrame | None, of: ObjectType | None = None) -> Column:
        """What an effect assigns to a property."""
        request = self.binding.request
        if isinstance(spec, dict):
            source, named = spec.get("from", "current"), spec.get("property", name)
            if source == "request":
                if named not in request:
                    raise Rejected(f"the request lacks {named!r}")
                return request[named].column
            if source == "current":
                if frame is None:
                    raise Rejected(f"{named!r}: there is no current individual here")
                return frame.value(named)[0].column
            if source == "generated":
                return self.generated(of, name, frame)
            found = {"identity": F.col("r__identity"), "action": F.lit(self.name), "object": F.lit(self.cls.name)}
            if source not in found:
                raise Rejected(f"no value can be taken from {source!r}")
            return found[source]
        if isinstance(spec, str):

            def operand(scope: str, p: str) -> Column:
                return self.value({"property": p, "from": scope}, p, frame)

            if (number := number_expression(spec, operand)) is not None:
                return number
            return F.lit(request_literal(spec, self.binding.clock))
        return F.lit(spec)

    def generated(self, cls: ObjectType, name: str, frame: ClassFrame | None) -> Column:
        """An identifier put together from the items a property lists."""
        now, parts = self.binding.clock(), []
        for item in cls.properties[name].generate:
            if isinstance(item, str):
                parts.append(F.lit(item))
            elif item.get("from") or item.get("property"):
                parts.append(self.value(item, name, frame).cast("string"))
            elif item.get("date"):
                at = now_expression(item["date"], self.binding.clock)
                if at is None:
                    raise Rejected(f"{item['date']!r} is no date expression")
                parts.append(format_utc(F.lit(at), item.get("format", "yyyyMMdd")))
            elif item.get("snowflake") is True:
                parts.append(snowflake_column(now * 1000, F.col("r__row")).cast("string"))
            elif item.get("uuid") == "v7":
                h = F.sha2(F.concat_ws("|", F.lit(f"{cls.name}.{name}.{now}"), F.col(REQUEST).cast("string")), 256)
                ms = f"{now * 1000:012x}"
                parts.append(F.concat(F.lit(f"{ms[:8]}-{ms[8:]}-7"), F.substring(h, 1, 3), F.lit("-a"), F.substring(h, 4, 3), F.lit("-"), F.substring(h, 7, 12)))
            else:
                raise Rejected(f"{item!r} generates nothing")
        if not parts:
            raise Rejected(f"{cls.name}.{name} has nothing to generate it by")
        return F.concat(*parts)

    # Effects

    def _targets(self, spec: dict, accepted: ClassFrame) -> ClassFrame:
        """Individuals an update or delete is about, each beside its request."""
        if spec["object"] == self.cls.name and spec.get("identity") == {"from": "identity"}:
            return accepted
        binding = Binding(self.binding.spark, self.model, self.binding.table, self.binding.clock, self.binding.notes)
        frame = ClassFrame(binding, spec["object"])
        requests = accepted.df.select(REQUEST, *(c for c in accepted.df.columns if c.startswith("r__")))
        if "identity" in spec:
            wanted = self.value(spec["identity"], frame.cls.identity or "identity", None)
            frame.df = requests.withColumn("__target", wanted.cast("string")).join(frame.df, F.col("__target") == frame.key.cast("string"), "inner").drop("__target")
            return frame
        filter_ = spec.get("filter") or {}
        check_shapes(filter_)
        pairs, rest = [], {}
        for key, test in filter_.items():
            operand = test.get("eq") if is_block(test) and set(test) == {"eq"} else test
            of_request = isinstance(operand, dict) and (operand.get("from") in ("request", "identity")) and not key.startswith("$")
            if of_request:
                pairs.append((key, self.value(operand if operand["from"] == "request" else {"from": "identity"}, key, None)))
            else:
                rest[key] = test
        frame.where(rest)
        if not pairs:
            # The same individuals for every request: they go with the first one, read as one value, not joined.
            first = requests.agg(F.min(F.struct(*requests.columns)).alias("first")).scalar()
            frame.df = frame.df.withColumn("__first", first).where(F.col("__first").isNotNull())
            frame.df = frame.df.withColumns({c: F.col("__first")[c] for c in requests.columns}).drop("__first")
            frame.shared = True
            return frame
        on = []
        for i, (key, value) in enumerate(pairs):
            requests = requests.withColumn(f"__pair_{i}", value)
            own = frame.value(key)[0].column
            on.append(own == F.col(f"__pair_{i}"))
        frame.df = requests.join(frame.df, reduce(Column.__and__, on), "inner").drop(*(f"__pair_{i}" for i in range(len(pairs))))
        return frame

    def _present(self, frame: ClassFrame, s: Source) -> DataFrame:
        return frame.df.where(F.col(f"{frame.tag}s_{frame._index[s.name]}"))

    def _fit(self, cls: ObjectType, s: Source, p: str, value: Column) -> Column:
        """A value as a source writes it: seconds of a date become a UTC text where its column holds texts."""
        column = self.binding.table(s).schema[s.fields[p]].dataType
        if cls.properties[p].type != "date" or not isinstance(column, T.StringType):
            return value
        text = value.cast("string")
        return F.when(text.rlike(r"^-?\d{1,12}$"), format_utc(text.cast("long"), "yyyy-MM-dd HH:mm:ss")).otherwise(text)

    def _key(self, frame: ClassFrame, s: Source) -> Column:
        return frame.from_source(s.name, frame.cls.key_of(s)).column

    def update(self, spec: dict, accepted: ClassFrame) -> tuple[list[Change], ClassFrame]:
        frame = self._targets(spec, accepted)
        self._writable(frame.cls, spec["properties"])
        carriers = [s for s in frame.cls.sources.values() if all(p in s.fields for p in spec["properties"])]
        if not carriers:
            raise Rejected(f"no source of {frame.cls.name} maps all that is changed")
        new = {p: self.value(v, p, frame, frame.cls) for p, v in spec["properties"].items()}
        return [
            Change("update", frame.cls, s, self._present(frame, s).select(REQUEST, self._key(frame, s).alias("key"), *(self._fit(frame.cls, s, p, c).alias(f"new_{i}") for i, (p, c) in enumerate(new.items())), *(frame.from_source(s.name, p).column.alias(f"old_{i}") for i, p in enumerate(spec["properties"]))), [s.fields[p] for p in spec["properties"]])
            for s in carriers
        ], frame

    def delete(self, spec: dict, accepted: ClassFrame) -> tuple[list[Change], ClassFrame]:
        frame = self._targets(spec, accepted)
        return [Change("delete", frame.cls, s, self._present(frame, s).select(REQUEST, self._key(frame, s).alias("key"))) for s in frame.cls.sources.values()], frame

    def create(self, spec: dict, accepted: ClassFrame) -> list[Change]:
        cls = self.model.object(spec["object"])
        self._writable(cls, spec["properties"])
        values = {p: self.value(v, p, None, cls) for p, v in spec["properties"].items()}
        found = []
        for s in cls.sources.values():
            if not all(p in s.fields for p in values):
                continue
            key = values.get(cls.key_of(s), F.lit(None).cast("string"))
            names = [p for p in s.fields if p in values]
            found.append(Change("insert", cls, s, accepted.df.select(REQUEST, key.alias("key"), *(self._fit(cls, s, p, values[p]).alias(f"new_{i}") for i, p in enumerate(names))), [s.fields[p] for p in names]))
        if not found:
            raise Rejected(f"no source of {cls.name} maps all that is set")
        return found

    def link(self, name: str, accepted: ClassFrame) -> list[Change]:
        """Rows for the sources an individual has none in, as long as they bring it to the new stage and no other.

        Sources are tried in order, each on top of the ones before; a rule's filter is read on the row that would be there.
        """
        hop = accepted.hop(name)
        if not hop.link.transition:
            raise Rejected(f"{name!r} is no transition")
        t, cls, found = hop.link.transition, self.cls, []
        rules = accepted.property(t["property"]).rules
        here = {s: F.col(f"{accepted.tag}s_{i}") for s, i in accepted._index.items()}
        for s in cls.sources.values():
            key = cls.key_of(s)
            if not key or key not in s.fields:
                continue
            values = {p: F.col("r__identity") if p == key else accepted.value(p)[0].column for p in s.fields}

            def hit(rule: dict, s: Source = s, values: dict = values, here: dict = dict(here)) -> Column:
                tests = []
                for source, test in rule["when"].items():
                    there = F.lit(True) if source == s.name else here[source]
                    if isinstance(test, bool):
                        tests.append(there if test else ~there)
                        continue
                    tests.append(there)
                    for p, condition in test.items():
                        if p.startswith("$"):
                            tests.append(accepted.predicate({p: condition}, source))
                            continue
                        own = accepted.from_source(source, p)
                        trial = Value(own.kind, F.when(here[source], own.column).otherwise(values[p].cast(accepted.types[f"{source}.{p}"]))) if source == s.name else own
                        tests.append(accepted.condition(trial, condition, cls.properties[p].type == "date", source))
                return two_valued(reduce(Column.__and__, tests))

            stage = None
            for rule in rules:
                stage = F.when(hit(rule), F.lit(rule["value"])) if stage is None else stage.when(hit(rule), F.lit(rule["value"]))
            good = ~here[s.name] & two_valued(stage == F.lit(t["to"]))
            names = list(s.fields)
            found.append(Change("insert", cls, s, accepted.df.where(good).select(REQUEST, F.col("r__identity").alias("key"), *(values[p].alias(f"new_{i}") for i, p in enumerate(names))), [s.fields[p] for p in names]))
            here[s.name] = here[s.name] | good
        return found

    def _writable(self, cls: ObjectType, names) -> None:
        for p in names:
            if p not in cls.properties:
                raise Rejected(f"{cls.name} has no property {p!r}")
            if cls.properties[p].derived is not None:
                raise Rejected(f"{cls.name}.{p} is derived and cannot be written")

    def plan(self) -> Batch:
        frame = self._frame()
        if pre := self.action.get("pre"):
            check_shapes(pre)
            test = two_valued(frame.predicate(pre))
        else:
            test = F.lit(True)
        frame.df = store(frame.df.withColumn("r__ok", test))
        rejected = [frame.df.where(~F.col("r__ok")).select(REQUEST, F.lit("pre").alias("stage"), F.lit("the precondition does not hold").alias("reason"))]
        frame.df = frame.df.where("r__ok")
        # Effect filters are ordinary ones: what only preconditions may read is out of reach there.
        changes, lines, updates, apart = [], [], [], len(self.action["effect"]) > 1
        for n, item in enumerate(self.action["effect"]):
            (kind, spec), = item.items()
            if kind == "create":
                made = self.create(spec, frame)
                identity = self.model.object(spec["object"]).identity
                given = spec["properties"].get(identity) if identity else None
                known = given is not None and not (isinstance(given, dict) and given.get("from") == "generated")
                lines.append((kind, spec["object"], n, frame.df.select(REQUEST, (self.value(given, identity, None).cast("string") if known else F.lit(None).cast("string")).alias("target"))))
            elif kind == "link":
                made = self.link(spec, frame)
                lines.append((kind, self.cls.name, n, frame.df.select(REQUEST, F.col("r__identity").cast("string").alias("target"))))
            else:
                made, target = (self.update if kind == "update" else self.delete)(spec, frame)
                exists = target.df.where(target.exists())
                apart |= target is not frame
                if target is frame:
                    missing = frame.df.where(~frame.exists())
                elif getattr(target, "shared", False):
                    missing = frame.df.select(REQUEST).where(exists.agg(F.count(F.lit(1))).scalar() == 0)
                else:
                    missing = frame.df.select(REQUEST).join(exists.select(REQUEST), REQUEST, "left_anti")
                rejected.append(missing.select(REQUEST, F.lit("effect").alias("stage"), F.lit(f"there is no {spec['object']} to {kind}").alias("reason")))
                lines.append((kind, spec["object"], n, exists.select(REQUEST, target.key.cast("string").alias("target"))))
                if kind == "update":
                    updates.append((spec, target, exists))
            changes += made
        clashes = self._axioms(updates)
        rejected += clashes
        bad = reduce(DataFrame.unionByName, rejected).groupBy(REQUEST).agg(F.min(F.struct(F.when(F.col("stage") == "pre", 0).when(F.col("stage") == "effect", 1).otherwise(2).alias("rank"), "stage", "reason")).alias("first"))
        bad = bad.select(REQUEST, "first.stage", "first.reason")
        if len(rejected) > 1 and (apart or clashes):
            # Otherwise what is rejected has no rows here: neither precondition nor individual.
            bad = store(bad)
            for c in changes:
                c.rows = c.rows.join(bad.select(REQUEST), REQUEST, "left_anti")
        accepted = self.requests.join(bad.select(REQUEST), REQUEST, "left_anti")
        return Batch(accepted.select(REQUEST, F.col("r__identity").alias("identity")), bad, changes, self._notifications(frame, lines, bad), self.binding.table)

    def _axioms(self, updates: list[tuple[dict, ClassFrame, DataFrame]]) -> list[DataFrame]:
        """Requests whose updates give one property of one individual several values at once."""
        found = []
        by: dict[tuple[str, str], list[DataFrame]] = {}
        for spec, frame, exists in updates:
            for axiom in frame.cls.axioms.values():
                p = axiom["property"]
                if p in spec["properties"]:
                    by.setdefault((frame.cls.name, p), []).append(exists.select(REQUEST, frame.key.cast("string").alias("target"), self.value(spec["properties"][p], p, frame).cast("string").alias("value")))
        for (cls, p), parts in by.items():
            clash = reduce(DataFrame.unionByName, parts).groupBy(REQUEST, "target").agg(F.countDistinct(F.coalesce("value", F.lit("\0"))).alias("n")).where("n > 1")
            found.append(clash.select(REQUEST, F.lit("axiom").alias("stage"), F.lit(f"{cls}.{p} would have several values").alias("reason")).distinct())
        return found

    def _notifications(self, frame: ClassFrame, lines: list, bad: DataFrame) -> DataFrame | None:
        """request_id, object, to, properties, lines of each event; none is delivered."""
        parts = []
        for inform in self.action.get("inform") or ():
            identity = self.model.object(inform["object"]).identity
            values = {p: self.value(v, p, None).cast("string") for p, v in inform["properties"].items()}
            if identity and identity not in values and values:
                joined = F.concat(*[x for v in values.values() for x in (F.lit("|"), v)][1:])
                values[identity] = joined
            change = values.get(identity, F.lit(None).cast("string")) if identity else F.lit(None).cast("string")
            base = frame.df.join(bad.select(REQUEST), REQUEST, "left_anti").select(REQUEST, change.alias("change_id"), F.create_map(*[x for p, v in values.items() for x in (F.lit(p), v)]).alias("properties"))
            all_lines = reduce(DataFrame.unionByName, [df.select(REQUEST, F.lit(n).alias("nth"), F.lit(op).alias("op"), F.lit(of).alias("object_class"), "target") for op, of, n, df in lines])
            grouped = all_lines.groupBy(REQUEST).agg(F.array_sort(F.collect_list(F.struct("nth", "target", "op", "object_class"))).alias("raw"))
            numbered = F.transform("raw", lambda x, i: F.struct(x["op"].alias("op"), x["object_class"].alias("object_class"), x["target"].alias("target"), F.col("change_id").alias("change_id"), F.concat(F.col("change_id"), F.lit("#"), (i + 1).cast("string")).alias("line_id")))
            parts.append(base.join(grouped, REQUEST).select(REQUEST, F.lit(inform["object"]).alias("object"), F.array(*map(F.lit, inform.get("to") or ())).cast("array<string>").alias("to"), "properties", numbered.alias("lines"), F.lit(False).alias("delivered")))
        return reduce(DataFrame.unionByName, parts) if parts else None


def waves(requests: DataFrame) -> DataFrame:
    """The requests with ``wave``: those on one identity come one after the other, in order of request_id."""
    return requests.withColumn("wave", F.row_number().over(Window.partitionBy("identity").orderBy(REQUEST)))


def bind_action(binding: Binding, cls: str, action: str, requests: DataFrame) -> Batch:
    return Planner(binding, cls, action, requests).plan()

