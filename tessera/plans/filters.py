"""Filters: shape checks and walking, without looking at data."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from tessera.plans.errors import Rejected
from tessera.plans.model import Model

OPERATORS = ("eq", "ne", "lt", "lte", "gt", "gte", "in", "contains")
#: How deep link conditions, and expansions, may nest.
MOST_DEPTH = 3


def is_block(value) -> bool:
    """Whether a condition is a block of operators rather than an operand."""
    return isinstance(value, dict) and bool(value) and all(k in OPERATORS for k in value)


def is_operand(value) -> bool:
    return not isinstance(value, dict) or isinstance(value.get("property"), str) or value.get("from") == "identity"


@dataclass(frozen=True)
class Seen:
    """One key of a filter: the class it is about, how deep in links, and whether it is a property, relation or other."""

    of: str | None
    kind: str
    key: str
    value: object
    depth: int


def walk(model: Model | None, of: str | None, filter_: dict, depth: int = 0) -> Iterator[Seen]:
    """All keys of a filter; with a model, link targets are followed and get their class (None: unknown relation)."""
    if not isinstance(filter_, dict):
        raise Rejected("a filter is a mapping")
    for key, value in filter_.items():
        if key == "$link":
            if not isinstance(value, dict):
                raise Rejected("$link maps relations to conditions")
            for relation, target in value.items():
                hop = model.hop(of, relation) if model and of else None
                yield Seen(of, "link", relation, target, depth)
                if isinstance(target, dict):
                    yield from walk(model, hop.target if hop else None, target, depth + 1)
                elif not isinstance(target, bool):
                    raise Rejected(f"{relation}: a link condition is true, false or a filter")
        elif key.startswith("$"):
            yield Seen(of, "special", key, value, depth)
        else:
            yield Seen(of, "property", key, value, depth)


def check_condition(key: str, value) -> None:
    if isinstance(value, (list, tuple)):
        raise Rejected(f"{key}: only 'in' takes a list")
    if not isinstance(value, dict):
        return
    if is_block(value):
        for op, operand in value.items():
            if (op == "in") != isinstance(operand, (list, tuple)):
                raise Rejected(f"{key}: 'in' takes a list, {op!r} was given {operand!r}" if op == "in" else f"{key}: {op!r} takes no list")
            if op != "in" and not is_operand(operand):
                raise Rejected(f"{key}: {operand!r} is no operand")
    elif not is_operand(value):
        raise Rejected(f"{key}: {value!r} holds neither operators nor an operand")


def check_shapes(filter_: dict) -> None:
    """Rejects lists and depths that no filter may have."""
    for seen in walk(None, None, filter_):
        if seen.kind == "link" and seen.depth + 1 > MOST_DEPTH:
            raise Rejected(f"link conditions nest more than {MOST_DEPTH} deep")
        if seen.kind == "property":
            check_condition(seen.key, seen.value)


def describe(model: Model, of: str, filter_: dict) -> str:
    """A filter in plain words."""
    words = {"eq": "is", "ne": "is not", "lt": "is before or below", "lte": "is at most", "gt": "is after or above", "gte": "is at least", "in": "is one of", "contains": "contains"}

    def operand(v) -> str:
        if isinstance(v, dict):
            return f"the {v.get('from', 'current')} {v['property']}" if "property" in v else "the requested identity"
        return "empty" if v is None else "now" if v == "now" else ", ".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v)

    parts = []
    for key, value in filter_.items():
        if key == "$link":
            for relation, target in value.items():
                hop = model.hop(of, relation)
                to = hop.target if hop else "?"
                parts.append(f"has {'no ' if target is False else 'a '}{relation} {to}" + (f" that {describe(model, to, target)}" if isinstance(target, dict) else ""))
        elif key == "$exists":
            parts.append("exists" if value else "does not exist")
        elif key == "$request":
            parts += [f"request parameter {p} " + (f"names a {c['object']}" if isinstance(c, dict) and "object" in c else describe(model, of, {"": c}).strip()) for p, c in value.items()]
        else:
            block = value if is_block(value) else {"eq": value}
            parts.append(f"{key} " + " and ".join(f"{words[op]} {operand(v)}" for op, v in block.items()))
    return " and ".join(parts) or "holds always"
