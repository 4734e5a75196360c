"""Class frames: the rows of several sources aligned into one row per individual.

For each source, in order: rows with a blank key are dropped, of several rows with one key the first (by ``order_by``,
else by the columns the class maps) is kept, and the row is marked present. The sources are joined on the key by full outer
joins, or by inner and left joins where the filter needs a source to be present, which keeps filters on that source below
the join. A source that the filter needs to be absent is an anti join on its keys; nothing else of it is read.

A property's value is that of the first source in order that maps it **and has a row**, even if that value is null; only
a missing row falls through. A property no present source maps is undefined, and no condition holds on it.

A frame grows as it is asked: derived values and existence flags of relations become columns when first used, so nothing
unused is computed or joined.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.dates import request_literal
from tessera.plans.errors import Rejected
from tessera.plans.filters import MOST_DEPTH, check_condition, is_block
from tessera.plans.model import Hop, Model, ObjectType, Property, Source
from tessera.plans.predicates import Value, column_value, compare, every, literal_value, some, two_valued

_serial = count()


@dataclass
class Binding:
    """What binding a request needs: the model, where tables come from, the clock, and the notes it leaves."""

    spark: SparkSession
    model: Model
    table: Callable[[Source], DataFrame]
    clock: Callable[[], int]
    notes: list[str] = field(default_factory=list)
    #: The identity a request names, as a literal or as a column of a batch of requests.
    identity: Value | None = None
    #: Parameters of a batch of requests, by name; only preconditions may read them.
    request: dict[str, Value] | None = None


def not_blank(key: Column) -> Column:
    return key.isNotNull() & key.cast("string").rlike(r"(?U)\S")


def _key_type(types: list[T.DataType]) -> str:
    """A type that all key columns agree in: their own, a long for whole numbers, else text."""
    if len({t.simpleString() for t in types}) == 1:
        return types[0].simpleString()
    return "bigint" if all(isinstance(t, T.IntegralType) for t in types) else "string"


def _key_column(c: Column, t: T.DataType, to: str) -> Column:
    if to == "string" and isinstance(t, (T.FractionalType, T.DecimalType)):
        return F.when(c == F.floor(c), F.floor(c).cast("bigint").cast("string")).otherwise(c.cast("string"))
    return c.cast(to)


class ClassFrame:
    """The individuals of a class. Columns: ``key``, ``s_<i>`` (presence) and ``v_<i>_<property>`` of each source."""

    def __init__(self, binding: Binding, name: str, *, identity: Value | None = None, required: set[str] = frozenset(), absent: set[str] = frozenset(), link_depth: int = 0) -> None:
        self.binding, self.model = binding, binding.model
        self.cls: ObjectType = self._object(name)
        self.link_depth = link_depth
        self.tag = f"f{next(_serial)}_"
        self.types: dict[str, T.DataType] = {}
        self._deriving: list[str] = []
        #: Whether every row is an individual; beside requests, a row may have no source at all.
        self.certain = True
        self._made: dict[str, tuple[Value, Column]] = {}
        self._index = {s: i for i, s in enumerate(self.cls.sources)}
        self.df = self._align(identity, required, absent)

    def _object(self, name: str) -> ObjectType:
        if name not in self.model.object_types:
            raise Rejected(f"there is no class {name!r}")
        return self.model.object_types[name]

    @property
    def key(self) -> Column:
        return F.col(self.tag + "key")

    def _align(self, identity: Value | None, required: set[str], absent: set[str]) -> DataFrame:
        cls, tag = self.cls, self.tag
        tables, key_types = {}, []
        for s in cls.sources.values():
            key = cls.key_of(s)
            if not cls.rows_only and (not key or key not in s.fields):
                raise Rejected(f"{cls.name}: source {s.name!r} has no key")
            table = self.binding.table(s)
            for p, c in s.fields.items():
                if c not in table.columns:
                    raise Rejected(f"{cls.name}: source {s.name!r} has no column {c!r} for {p!r}")
                self.types[f"{s.name}.{p}"] = table.schema[c].dataType
            tables[s.name] = table
            if not cls.rows_only:
                key_types.append(table.schema[s.fields[key]].dataType)
        if not tables:
            return self.binding.spark.createDataFrame([], T.StructType([T.StructField(tag + "key", T.StringType())]))
        to = "string" if cls.rows_only else _key_type(key_types)
        parts, gone = [], []
        for name, table in tables.items():
            s, i = cls.sources[name], self._index[name]
            values = [F.col(f"`{c}`").alias(f"{tag}v_{i}_{p}") for p, c in s.fields.items()]
            if cls.rows_only:
                parts.append((name, table.select(F.lit(None).cast("string").alias(tag + "key"), F.lit(True).alias(f"{tag}s_{i}"), *values)))
                continue
            column = s.fields[cls.key_of(s)]
            own = F.col(f"`{column}`")
            rows = table.where(not_blank(own) if isinstance(table.schema[column].dataType, T.StringType) else own.isNotNull())
            if identity is not None:
                # Below the join, where it reaches the scan; a coalesced key would not let it through.
                same = compare(column_value(own, table.schema[column].dataType), "eq", identity, False)
                rows = rows.where(same if to != "string" or isinstance(table.schema[column].dataType, T.StringType) else own.cast("string") == identity.column.cast("string"))
            key = _key_column(own, table.schema[column].dataType, to).alias(tag + "key")
            if name in absent:
                gone.append((name, rows.select(key)))
                continue
            if not s.unique:
                # The least row of a key, combined before the shuffle; only the ordering and mapped columns are read.
                order = list(s.order_by or sorted(set(s.fields.values())))
                order += [c for c in dict.fromkeys(s.fields.values()) if c not in order]
                ordered = F.struct(*(F.col(f"`{c}`").alias(f"o{n}") for n, c in enumerate(order)))
                rows = rows.groupBy(key).agg(F.min(ordered).alias("first")).select(tag + "key", F.lit(True).alias(f"{tag}s_{i}"), *(F.col("first")[f"o{order.index(c)}"].alias(f"{tag}v_{i}_{p}") for p, c in s.fields.items()))
            else:
                rows = rows.select(key, F.lit(True).alias(f"{tag}s_{i}"), *values)
            parts.append((name, rows))
        if cls.rows_only and len(parts) > 1:
            raise Rejected(f"{cls.name}: a class of rows has one source")
        parts.sort(key=lambda p: p[0] not in required)
        df = parts[0][1]
        how = []
        for name, rows in parts[1:]:
            how.append("inner" if name in required else "left" if required else "full")
            df = df.join(rows, tag + "key", how[-1])
        for name, keys in gone:
            s, i = cls.sources[name], self._index[name]
            df = df.join(keys, tag + "key", "left_anti")
            df = df.withColumns({f"{tag}s_{i}": F.lit(False)} | {f"{tag}v_{i}_{p}": F.lit(None).cast(self.types[f"{name}.{p}"]) for p in s.fields})
            how.append("anti")
            parts.append((name, keys))
        if len(parts) > 1:
            df = df.withColumns({f"{tag}s_{i}": F.coalesce(F.col(f"{tag}s_{i}"), F.lit(False)) for i in self._index.values()})
        self.binding.notes.append(f"{cls.name}: {', '.join(f'{n} ({len(cls.sources[n].fields)} columns)' for n, _ in parts)}" + (f"; joined {', '.join(how)}" if how else ""))
        return df

    # Values

    def present(self, source: str) -> Column:
        if source not in self._index:
            raise Rejected(f"{self.cls.name}: there is no source {source!r}")
        return F.lit(True) if len(self._index) == 1 and self.certain else F.col(f"{self.tag}s_{self._index[source]}")

    def exists(self) -> Column:
        return some([F.col(f"{self.tag}s_{i}") for i in self._index.values()])

    def property(self, name: str) -> Property:
        if name not in self.cls.properties:
            raise Rejected(f"{self.cls.name} has no property {name!r}")
        return self.cls.properties[name]

    def from_source(self, source: str, name: str) -> Value | None:
        """A property as one source has it; None: the source does not map it."""
        if name not in self.cls.sources[source].fields:
            return None
        return column_value(F.col(f"{self.tag}v_{self._index[source]}_{name}"), self.types[f"{source}.{name}"])

    def value(self, name: str) -> tuple[Value, Column]:
        """A property's value, and whether it is defined."""
        p = self.property(name)
        if name not in self._made:
            self._made[name] = self._derived(p) if p.derived is not None else self._mapped(name)
        return self._made[name]

    def _mapped(self, name: str) -> tuple[Value, Column]:
        sources = self.cls.mapped(name)
        if not sources:
            return literal_value(None), F.lit(False)
        types = [self.types[f"{s.name}.{name}"] for s in sources]
        columns = [F.col(f"{self.tag}v_{self._index[s.name]}_{name}") for s in sources]
        if len({t.simpleString() for t in types}) > 1:
            to = T.DoubleType() if all(isinstance(t, T.NumericType) for t in types) else T.StringType()
            columns, types = [c.cast(to) for c in columns], [to]
        if len(sources) == 1:
            found = columns[0]  # null where the source has no row; definedness tells the two apart
        else:
            found = F.when(self.present(sources[0].name), columns[0])
            for s, c in zip(sources[1:], columns[1:]):
                found = found.when(self.present(s.name), c)
        return column_value(found, types[0]), some([self.present(s.name) for s in sources])

    def _derived(self, p: Property) -> tuple[Value, Column]:
        if p.name in self._deriving:
            raise Rejected(f"{self.cls.name}: {' -> '.join([*self._deriving, p.name])} derive from each other")
        self._deriving.append(p.name)
        try:
            if p.rules is None:
                value, defined = literal_value(True), F.lit(True)
                column = two_valued(self.predicate(p.derived))
                kind: T.DataType = T.BooleanType()
            else:
                hits = [two_valued(self.rule(r)) for r in p.rules]
                literals = [r["value"] for r in p.rules]
                kind = T.BooleanType() if all(isinstance(v, bool) for v in literals) else T.DoubleType() if all(isinstance(v, (int, float)) for v in literals) else T.StringType()
                if isinstance(kind, T.StringType):
                    literals = [v if v is None or isinstance(v, str) else str(v) for v in literals]
                column = None
                for hit, v in zip(hits, literals):
                    column = F.when(hit, F.lit(v).cast(kind)) if column is None else column.when(hit, F.lit(v).cast(kind))
                defined = some(hits)
            made = f"{self.tag}d_{p.name}"
            self.df = self.df.withColumns({made: column, made + "_": defined})
            value = column_value(F.col(made), kind)
            return value, F.col(made + "_") if p.rules else F.lit(True)
        finally:
            self._deriving.pop()

    def rule(self, rule: dict) -> Column:
        """Whether a when-rule hits: each source it names is present, absent, or present with a filter on its own columns."""
        tests = []
        for source, test in rule["when"].items():
            if source not in self._index:
                raise Rejected(f"{self.cls.name}: a rule names the unknown source {source!r}")
            here = self.present(source)
            if isinstance(test, bool):
                tests.append(here if test else ~here)
            else:
                for k in test:
                    if k.startswith("$") and k != "$link":
                        raise Rejected(f"{k} has no place in a rule")
                tests += [here, self.predicate(test, source)]
        return every(tests)

    def output(self, name: str) -> Column:
        """A property as results show it."""
        return self.value(name)[0].column.alias(name)

    # Conditions

    def _operand(self, v, source: str | None) -> tuple[Value, Column | None]:
        if isinstance(v, dict):
            if isinstance(v.get("property"), str):
                if v.get("from") == "request":
                    request = self.binding.request
                    if request is None or v["property"] not in request:
                        raise Rejected(f"there is no request parameter {v['property']!r}")
                    return request[v["property"]], None
                if source:
                    found = self.from_source(source, v["property"])
                    if found is None:
                        raise Rejected(f"{self.cls.name}: {source!r} does not map {v['property']!r}")
                    return found, None
                return self.value(v["property"])
            if v.get("from") == "identity":
                if self.binding.identity is None:
                    raise Rejected("the request names no identity")
                return self.binding.identity, None
            raise Rejected(f"{v!r} is no operand")
        plain = request_literal(v, self.binding.clock)
        return literal_value(plain, dated=plain is not v), None

    def condition(self, actual: Value, condition, date: bool, source: str | None = None) -> Column:
        block = condition if is_block(condition) else {"eq": condition}
        tests = []
        for op, operand in block.items():
            if op == "in":
                tests.append(compare(actual, op, [literal_value(request_literal(x, self.binding.clock)) for x in operand], date))
                continue
            expected, defined = self._operand(operand, source)
            test = compare(actual, op, expected, date)
            tests.append(test if defined is None else test & defined)
        return every(tests)

    def property_test(self, name: str, condition, source: str | None = None) -> Column:
        check_condition(name, condition)
        p = self.property(name)
        if source:
            value = self.from_source(source, name)
            if value is None:
                raise Rejected(f"{self.cls.name}: {source!r} does not map {name!r}")
            return self.condition(value, condition, p.type == "date", source)
        value, defined = self.value(name)
        test = self.condition(value, condition, p.type == "date")
        alone = len(self._index) == 1 and self.certain and p.derived is None
        return test if alone else defined & test

    def predicate(self, filter_: dict, source: str | None = None) -> Column:
        """A whole filter as one column; relations become existence flags."""
        tests = []
        for key, value in filter_.items():
            if key == "$link":
                for relation, target in value.items():
                    flag = self.link_flag(relation, target)
                    tests.append(~flag if target is False else flag)
            elif key == "$exists":
                self._only_pre(key)
                tests.append(self.exists() if value else ~self.exists())
            elif key == "$request":
                self._only_pre(key)
                tests += [self._request_test(p, c) for p, c in value.items()]
            elif key.startswith("$"):
                raise Rejected(f"{key} is unknown")
            else:
                tests.append(self.property_test(key, value, source))
        return every(tests)

    def _only_pre(self, key: str) -> None:
        if self.binding.request is None:
            raise Rejected(f"{key} belongs in preconditions only")

    def _request_test(self, name: str, condition) -> Column:
        value = self.binding.request.get(name)
        if isinstance(condition, dict) and "object" in condition:
            if value is None:
                return F.lit(False)
            target = ClassFrame(Binding(self.binding.spark, self.model, self.binding.table, self.binding.clock, self.binding.notes), condition["object"])
            known = target.df.select(target.key.cast("string").alias("known"))
            return self._flag(known.distinct(), [(value.column.cast("string"), "known")])
        return self.condition(value, condition, False) if value is not None else F.lit(False)

    # Relations

    def hop(self, relation: str) -> Hop:
        found = self.model.hop(self.cls.name, relation)
        if not found:
            raise Rejected(f"{self.cls.name} has no relation {relation!r}")
        return found

    def transition(self, hop: Hop) -> Column:
        """Whether an individual has passed a transition: the rule of the new stage hits and the old stage's sources are there."""
        t = hop.link.transition
        rules = self.property(t["property"]).rules
        ends = {r["value"]: r for r in rules or ()}
        if t["from"] not in ends or t["to"] not in ends:
            raise Rejected(f"{hop.link.name}: no rules give {t['from']!r} and {t['to']!r}")
        before = [self.present(s) for s, test in ends[t["from"]]["when"].items() if test is True]
        return two_valued(every([*before, self.rule(ends[t["to"]])]))

    def target(self, hop: Hop, filter_: dict | None) -> ClassFrame:
        if filter_:
            for pair in hop.pairs:
                if pair[1] in filter_:
                    raise Rejected(f"{hop.link.name} already pairs {pair[1]!r}; a filter on it has no place there")
        required, absent = needed_sources(self.model.object(hop.target), filter_ or {})
        frame = ClassFrame(self.binding, hop.target, required=required, absent=absent, link_depth=self.link_depth + 1)
        if filter_:
            frame.where(filter_)
        return frame

    def paired(self, hop: Hop, frame: ClassFrame) -> list[tuple[Column, Column]]:
        """The columns that must be equal; a pair of types that never agree gives no match."""
        pairs = []
        for own, theirs in hop.pairs:
            (a, _), (b, _) = self.value(own), frame.value(theirs)
            if a.kind != b.kind and not {a.kind, b.kind} <= {"number", "time"}:
                pairs.append((a.column.cast("string"), F.when(F.lit(False), b.column.cast("string"))))
            else:
                pairs.append((a.number(), b.number()) if a.kind != b.kind else (a.column, b.column))
        return pairs

    def _linked(self, relation: str, target) -> tuple[Hop, ClassFrame | None]:
        hop = self.hop(relation)
        if self.link_depth + 1 > MOST_DEPTH:
            raise Rejected(f"link conditions nest more than {MOST_DEPTH} deep")
        if hop.link.transition:
            if not isinstance(target, bool):
                raise Rejected(f"{relation} is a transition; it holds or not")
            return hop, None
        return hop, self.target(hop, target if isinstance(target, dict) else None)

    def _flag(self, right: DataFrame, on: list[tuple[Column, str]]) -> Column:
        """A column that says whether a row has a partner in ``right``, whose rows are distinct."""
        flag = f"{self.tag}x_{next(_serial)}"
        names = {n: f"{flag}_{n}" for _, n in on}
        right = right.select(*(F.col(n).alias(names[n]) for _, n in on)).where(every([F.col(x).isNotNull() for x in names.values()])).withColumn(flag, F.lit(True))
        joined = self.df.join(right, every([c == F.col(names[n]) for c, n in on]), "left").drop(*names.values())
        self.df = joined.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
        return F.col(flag)

    def link_flag(self, relation: str, target) -> Column:
        """Whether a related individual exists, as a value."""
        hop, frame = self._linked(relation, target)
        if frame is None:
            return self.transition(hop)
        pairs = self.paired(hop, frame)
        right = frame.df.select(*(b.alias(f"p{i}") for i, (_, b) in enumerate(pairs))).distinct()
        return self._flag(right, [(a, f"p{i}") for i, (a, _) in enumerate(pairs)])

    def where(self, filter_: dict) -> None:
        """Keeps the individuals that meet a filter; relations become semi and anti joins."""
        links, rest = filter_.get("$link", {}), {k: v for k, v in filter_.items() if k != "$link"}
        for key, value in rest.items():
            test = self.predicate({key: value})  # may join flags to the frame
            self.df = self.df.where(test)
        for relation, target in links.items():
            hop, frame = self._linked(relation, target)
            if frame is None:
                holds = self.transition(hop)
                self.df = self.df.where(~holds if target is False else holds)
                continue
            pairs = self.paired(hop, frame)
            names = [f"{frame.tag}p{i}" for i in range(len(pairs))]
            right = frame.df.select(*(b.alias(n) for (_, b), n in zip(pairs, names)))
            on = every([a == F.col(n) for (a, _), n in zip(pairs, names)])
            # An anti join keeps rows with a null on their side: there the relation does not hold.
            self.df = self.df.join(right, on, "left_anti" if target is False else "left_semi")


def needed_sources(cls: ObjectType, filter_: dict) -> tuple[set[str], set[str]]:
    """Sources whose presence, and whose absence, the filter cannot hold without: those that alone map a filtered property,
    and what every rule of the filtered stage needs. None need be absent unless some need be present."""
    here: set[str] = set()
    gone: set[str] = set()
    for key, value in filter_.items():
        p = cls.properties.get(key)
        if p is None:
            continue
        if p.derived is None:
            mapped = cls.mapped(key)
            if len(mapped) == 1:
                here.add(mapped[0].name)
        elif p.rules is not None and value is not None and not isinstance(value, (dict, list)):
            rules = [r["when"] for r in p.rules if r["value"] == value]
            if rules:
                here |= set.intersection(*({s for s, test in r.items() if test is not False} for r in rules)) & set(cls.sources)
                gone |= set.intersection(*({s for s, test in r.items() if test is False} for r in rules)) & set(cls.sources)
    if len(cls.sources) < 2 or cls.rows_only:
        return set(), set()
    return here, gone - here if here else set()
