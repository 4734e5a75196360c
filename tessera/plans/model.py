"""The business model: classes, their properties, sources and relations, parsed from a plain mapping."""

from __future__ import annotations

import copy
import json
import re
from dataclasses import dataclass, field
from hashlib import sha1
from typing import Any

from tessera.functions.yamltext import Unreadable, load
from tessera.plans.errors import InvalidModel

NAME = re.compile(r"[a-z][a-z0-9_]*")
TYPES = ("string", "number", "boolean", "date", "enum")


@dataclass(frozen=True)
class Property:
    name: str
    type: str
    description: str | None = None
    values: tuple = ()
    derived: Any = None
    generate: tuple = ()

    @property
    def rules(self) -> list[dict] | None:
        """The when-rules of a derivation by cases; None for any other property."""
        return self.derived if isinstance(self.derived, list) else None

    def allowed(self) -> list:
        """The plain values of an enumeration."""
        return [v["value"] if isinstance(v, dict) else v for v in self.values]


@dataclass(frozen=True, eq=False)
class Source:
    """``fields`` maps properties to columns. ``order_by``: which of several rows with one key is the first (all columns
    where empty). ``unique``: the key is known not to repeat, so rows need no deduplication."""

    name: str
    connection: str
    table: str
    fields: dict[str, str]
    key: str | None = None
    pk: str | None = None
    order_by: tuple[str, ...] = ()
    unique: bool = False


@dataclass(frozen=True)
class ObjectType:
    name: str
    kind: str
    identity: str | None
    properties: dict[str, Property]
    sources: dict[str, Source] = field(default_factory=dict)
    axioms: dict[str, dict] = field(default_factory=dict)
    actions: dict[str, dict] = field(default_factory=dict)
    description: str | None = None
    #: Rows of a class without one key (say, order lines): never aligned, so only for aggregates and as link targets.
    rows_only: bool = False

    def key_of(self, source: Source) -> str | None:
        return source.key or self.identity

    def mapped(self, name: str) -> list[Source]:
        """The sources that map a property, in order of precedence."""
        return [s for s in self.sources.values() if name in s.fields]


@dataclass(frozen=True)
class Link:
    name: str
    from_: str
    to: str
    inverse: str | None = None
    card: str | None = None
    match: tuple[tuple[str, str], ...] = ()
    transition: dict | None = None
    description: str | None = None


@dataclass(frozen=True)
class Hop:
    """A relation seen from one of its ends."""

    link: Link
    target: str
    pairs: tuple[tuple[str, str], ...]


def _need(at: str, value, kind: type | tuple[type, ...]):
    if not isinstance(value, kind):
        raise InvalidModel(f"{at}: expected {getattr(kind, '__name__', kind)}, found {type(value).__name__}")
    return value


def _property(at: str, name: str, d: dict) -> Property:
    _need(at, d, dict)
    if d.get("type") not in TYPES:
        raise InvalidModel(f"{at}: type is one of {', '.join(TYPES)}")
    derived = d.get("derived")
    if derived is not None:
        if isinstance(derived, list):
            if not derived:
                raise InvalidModel(f"{at}: a derivation needs a rule")
            for rule in derived:
                if not isinstance(rule, dict) or not isinstance(rule.get("when"), dict) or "value" not in rule:
                    raise InvalidModel(f"{at}: a rule has 'when' and 'value'")
        else:
            _need(f"{at}.derived", derived, dict)
    return Property(name, d["type"], d.get("description"), tuple(d.get("values") or ()), derived, tuple(d.get("generate") or ()))


def _source(at: str, name: str, d: dict) -> Source:
    _need(at, d, dict)
    for k in ("connection", "table"):
        _need(f"{at}.{k}", d.get(k), str)
    fields = _need(f"{at}.fields", d.get("fields"), dict)
    return Source(name, d["connection"], d["table"], dict(fields), d.get("key"), d.get("pk"), tuple(d.get("order_by") or ()), bool(d.get("unique")))


def _object(name: str, d: dict) -> ObjectType:
    _need(name, d, dict)
    if d.get("kind") not in ("thing", "event"):
        raise InvalidModel(f"{name}: kind is thing or event")
    properties = {p: _property(f"{name}.{p}", p, x) for p, x in _need(f"{name}.properties", d.get("properties"), dict).items()}
    sources = {s: _source(f"{name}.{s}", s, x) for s, x in (d.get("sources") or {}).items()}
    for a, x in (d.get("axioms") or {}).items():
        if not isinstance(x, dict) or x.get("type") != "mutex" or not isinstance(x.get("property"), str):
            raise InvalidModel(f"{name}.{a}: an axiom is of type mutex on a property")
    for a, x in (d.get("actions") or {}).items():
        if not isinstance(x, dict) or not isinstance(x.get("effect"), list) or not x["effect"]:
            raise InvalidModel(f"{name}.{a}: an action has effects")
        for item in x["effect"]:
            if not isinstance(item, dict) or len(item) != 1 or next(iter(item)) not in ("update", "delete", "create", "link"):
                raise InvalidModel(f"{name}.{a}: an effect updates, deletes, creates or links")
            if "update" in item and not item["update"].get("properties"):
                raise InvalidModel(f"{name}.{a}: an update sets properties")
    return ObjectType(name, d["kind"], d.get("identity"), properties, sources, d.get("axioms") or {}, d.get("actions") or {}, d.get("description"), bool(d.get("rows_only")))


def _link(name: str, d: dict) -> Link:
    _need(name, d, dict)
    for k in ("from", "to"):
        _need(f"{name}.{k}", d.get(k), str)
    if bool(d.get("match")) == bool(d.get("transition")):
        raise InvalidModel(f"{name}: a relation has either match pairs or a transition")
    pairs = tuple((p["from"], p["to"]) for p in d.get("match") or ())
    transition = d.get("transition")
    if transition and not {"property", "from", "to"} <= transition.keys():
        raise InvalidModel(f"{name}: a transition names a property and two stages")
    return Link(name, d["from"], d["to"], d.get("inverse"), d.get("card"), pairs, transition, d.get("description"))


@dataclass(frozen=True)
class Model:
    object_types: dict[str, ObjectType]
    link_types: dict[str, Link]
    raw: dict

    @classmethod
    def parse(cls, d: dict | str) -> Model:
        """From a mapping, or a YAML or JSON text."""
        if isinstance(d, str):
            try:
                d = load(d)
            except Unreadable as e:
                raise InvalidModel(f"the text cannot be read: {e}") from e
        d = copy.deepcopy(_need("model", d, dict))
        objects = {n: _object(n, x) for n, x in _need("object_types", d.get("object_types"), dict).items()}
        links = {n: _link(n, x) for n, x in (d.get("link_types") or {}).items()}
        for row in d.get("class_conclusions") or ():
            if row.get("kind") not in ("overlap", "homonym", "subtype") or len(set(row.get("classes") or ())) < 2 or len(set(row["classes"])) != len(row["classes"]):
                raise InvalidModel("a class conclusion names two or more different classes")
            if row.get("shared") and row["kind"] != "overlap":
                raise InvalidModel("only an overlap names a shared class")
        return cls(objects, links, d)

    def object(self, name: str) -> ObjectType:
        if name not in self.object_types:
            raise InvalidModel(f"there is no class {name!r}")
        return self.object_types[name]

    def hop(self, of: str, relation: str) -> Hop | None:
        """A relation by its name from its start, or by its inverse name from its end."""
        link = self.link_types.get(relation)
        if link and link.from_ == of:
            return Hop(link, link.to, link.match)
        for link in self.link_types.values():
            if link.inverse == relation and link.to == of:
                return Hop(link, link.from_, tuple((b, a) for a, b in link.match))
        return None

    def to_dict(self) -> dict:
        return copy.deepcopy(self.raw)


def structural_hash(value) -> str:
    """Equal for mappings that differ in key order only."""
    return sha1(json.dumps(value, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()


def same_structure(a, b) -> bool:
    return structural_hash(a) == structural_hash(b)


def lineage(model: Model) -> list[dict]:
    """Which column feeds which property, one entry per mapping."""
    return [
        {"connection": s.connection, "table": s.table, "column": column, "object": o.name, "source": s.name, "property": p}
        for o in model.object_types.values() for s in o.sources.values() for p, column in s.fields.items()
    ]


def properties_of_column(model: Model, connection: str, table: str, column: str) -> list[tuple[str, str]]:
    return [(x["object"], x["property"]) for x in lineage(model) if (x["connection"], x["table"], x["column"]) == (connection, table, column)]
