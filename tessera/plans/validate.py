"""Whether a model fits together: what names refer to, then the shapes of its actions."""

from __future__ import annotations

from collections.abc import Iterator

from tessera.functions.ids import LIKE_EXPRESSION, NUMBER_EXPRESSION, is_date_expression
from tessera.plans.errors import InvalidModel, Rejected
from tessera.plans.filters import check_shapes, is_block, walk
from tessera.plans.model import Model, ObjectType


def _fail(message: str):
    raise InvalidModel(message)


def check_filter(model: Model, of: str, filter_: dict, at: str) -> None:
    """All properties and relations that a filter names exist."""
    for seen in walk(model, of, filter_):
        if seen.kind == "link" and (seen.of is None or not model.hop(seen.of, seen.key)):
            _fail(f"{at}: {seen.of} has no relation {seen.key!r}")
        if seen.kind == "property" and seen.of in model.object_types and seen.key not in model.object_types[seen.of].properties:
            _fail(f"{at}: {seen.of} has no property {seen.key!r}")


def effects(action: dict, *kinds: str) -> Iterator[tuple[str, dict | str]]:
    for item in action["effect"]:
        for kind, spec in item.items():
            if not kinds or kind in kinds:
                yield kind, spec


def _check_class(model: Model, cls: ObjectType, keyless: bool) -> None:
    name = cls.name
    if cls.identity:
        if cls.identity not in cls.properties:
            _fail(f"{name}: the identity {cls.identity!r} is no property")
        if cls.properties[cls.identity].derived is not None:
            _fail(f"{name}: the identity {cls.identity!r} is derived")
    for s in cls.sources.values():
        key = cls.key_of(s)
        if not key:
            if not keyless and not cls.rows_only:
                _fail(f"{name}: source {s.name!r} has nothing to tell individuals apart by")
        elif key not in s.fields:
            _fail(f"{name}: source {s.name!r} does not map its key {key!r}")
        for p in s.fields:
            if p not in cls.properties:
                _fail(f"{name}: source {s.name!r} maps the unknown property {p!r}")
            if cls.properties[p].derived is not None:
                _fail(f"{name}: source {s.name!r} maps the derived property {p!r}")
    for p in cls.properties.values():
        if p.rules is None:
            if p.derived is not None:
                check_filter(model, name, p.derived, f"{name}.{p.name}")
            continue
        for rule in p.rules:
            for source, test in rule["when"].items():
                if source not in cls.sources:
                    _fail(f"{name}.{p.name}: there is no source {source!r}")
                if not isinstance(test, dict):
                    continue
                for seen in walk(model, name, test):
                    if seen.kind == "special":
                        _fail(f"{name}.{p.name}: {seen.key} has no place in a rule")
                    if seen.kind == "link" and (seen.of is None or not model.hop(seen.of, seen.key)):
                        _fail(f"{name}.{p.name}: there is no relation {seen.key!r}")
                    if seen.kind == "property" and (seen.key not in cls.sources[source].fields if seen.depth == 0 else seen.of not in model.object_types or seen.key not in model.object_types[seen.of].properties):
                        _fail(f"{name}.{p.name}: {source!r} does not map {seen.key!r}")
    _check_cycles(cls)
    for a, action in cls.actions.items():
        at = f"{name}.{a}"
        if action.get("pre"):
            check_filter(model, name, action["pre"], at)
            for parameter, test in (action["pre"].get("$request") or {}).items():
                if isinstance(test, dict) and "object" in test and test["object"] not in model.object_types:
                    _fail(f"{at}: {parameter} names the unknown class {test['object']!r}")
        for kind, spec in effects(action, "update", "delete", "create"):
            if spec.get("object") not in model.object_types:
                _fail(f"{at}: {kind} of the unknown class {spec.get('object')!r}")
            if kind != "create" and spec.get("filter"):
                check_filter(model, spec["object"], spec["filter"], at)
            for p in spec.get("properties") or ():
                target = model.object_types[spec["object"]].properties
                if p not in target:
                    _fail(f"{at}: {spec['object']} has no property {p!r}")
                if target[p].derived is not None:
                    _fail(f"{at}: {p!r} is derived and cannot be written")
        for inform in action.get("inform") or ():
            if inform.get("object") not in model.object_types:
                _fail(f"{at}: informs of the unknown class {inform.get('object')!r}")
            for outlet in inform.get("to") or ():
                if outlet not in (model.raw.get("outlets") or {}):
                    _fail(f"{at}: there is no outlet {outlet!r}")


def _check_cycles(cls: ObjectType) -> None:
    """No property derives from itself through filters on derived properties of its own class."""

    def needs(name: str) -> set[str]:
        p = cls.properties[name]
        if p.rules is not None or not isinstance(p.derived, dict):
            return set()
        found = {k for k in p.derived if not k.startswith("$")}
        for v in p.derived.values():
            for operand in v.values() if is_block(v) else [v]:
                if isinstance(operand, dict) and isinstance(operand.get("property"), str):
                    found.add(operand["property"])
        return {n for n in found if n in cls.properties and cls.properties[n].derived is not None}

    done: set[str] = set()

    def visit(name: str, path: tuple[str, ...]) -> None:
        if name in path:
            _fail(f"{cls.name}: {' -> '.join([*path, name])} derive from each other")
        if name not in done:
            for n in needs(name):
                visit(n, (*path, name))
            done.add(name)

    for n in cls.properties:
        visit(n, ())


def check_model(model: Model, *, keyless: bool = False) -> None:
    """Raises :class:`InvalidModel` at the first name that refers to nothing. ``keyless`` lets drafts have classes without a key."""
    for cls in model.object_types.values():
        _check_class(model, cls, keyless)
    for link in model.link_types.values():
        for end in (link.from_, link.to):
            if end not in model.object_types:
                _fail(f"{link.name}: there is no class {end!r}")
        for pair in link.match:
            for end, p in zip((link.from_, link.to), pair):
                found = model.object_types[end].properties.get(p)
                if found is None:
                    _fail(f"{link.name}: {end} has no property {p!r}")
                if found.derived is not None:
                    _fail(f"{link.name}: {end}.{p} is derived and pairs with nothing")
        if t := link.transition:
            p = model.object_types[link.from_].properties.get(t["property"])
            if p is None or p.rules is None:
                _fail(f"{link.name}: {t['property']!r} has no rules")
            if not {t["from"], t["to"]} <= {r["value"] for r in p.rules}:
                _fail(f"{link.name}: no rules give both {t['from']!r} and {t['to']!r}")
    for row in model.raw.get("class_conclusions") or ():
        for c in [*row["classes"], *([row["shared"]] if row.get("shared") else [])]:
            if c not in model.object_types:
                _fail(f"a conclusion names the unknown class {c!r}")


# Where a value of an action stands, and what it may be taken from there.
_FROM = {
    "create": {"request", "identity", "action", "object", "generated"},
    "identity": {"request", "identity", "action", "object"},
    "update": {"request", "identity", "action", "object", "current"},
    "inform": {"request", "identity", "action", "object"},
}


def check_value(place: str, value, at: str, *, generates: bool = False) -> None:
    if isinstance(value, dict):
        source = value.get("from", "current" if "property" in value else None)
        if source not in _FROM[place]:
            _fail(f"{at}: no value can be taken from {source!r} here")
        if source == "generated" and not generates:
            _fail(f"{at}: the property has nothing to generate it by")
    elif isinstance(value, str) and not is_date_expression(value):
        if found := NUMBER_EXPRESSION.fullmatch(value):
            if place != "update" and "current." in found[0]:
                _fail(f"{at}: there is no current individual here")
        elif LIKE_EXPRESSION.match(value):
            _fail(f"{at}: {value!r} is no valid expression")
    elif isinstance(value, (list, tuple)):
        _fail(f"{at}: a value is no list")


def check_actions(model: Model) -> None:
    """The shapes of actions, which only drafts and publishing insist on."""
    linked = set()
    for cls in model.object_types.values():
        for a, action in cls.actions.items():
            at = f"{cls.name}.{a}"
            for kind, spec in effects(action):
                if kind == "link":
                    link = model.link_types.get(spec)
                    if link is None or not link.transition:
                        _fail(f"{at}: {spec!r} is no transition")
                    if link.from_ != cls.name or link.to != cls.name:
                        _fail(f"{at}: {spec!r} is not a transition of {cls.name}")
                    linked.add(spec)
                    continue
                if kind in ("update", "delete"):
                    if "identity" not in spec and not spec.get("filter"):
                        _fail(f"{at}: {kind} does not say of what")
                    if "identity" in spec:
                        check_value("identity", spec["identity"], at)
                    try:
                        check_shapes(spec.get("filter") or {})
                    except InvalidModel:
                        raise
                    except Rejected as e:
                        _fail(f"{at}: {e}")
                target = model.object_types[spec["object"]].properties
                for p, v in (spec.get("properties") or {}).items():
                    check_value("update" if kind == "update" else "create", v, f"{at}.{p}", generates=bool(target[p].generate))
            for inform in action.get("inform") or ():
                for p, v in inform["properties"].items():
                    check_value("inform", v, f"{at}.{p}")
    for link in model.link_types.values():
        if link.transition and link.name not in linked:
            _fail(f"{link.name}: no action makes this transition")
