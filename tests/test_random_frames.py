"""Random sources, rules and filters against a row-at-a-time model of the same semantics."""

import random

import pytest

from tessera.plans.engine import Engine
from tessera.sources.catalog import frames
from tests.conftest import rows

MISSING = object()


def blank(v):
    return v is None or not str(v).strip()


def first_rows(data):
    """The least row of each key, nulls first."""
    found = {}
    for r in sorted(data, key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r)):
        if not blank(r[0]):
            found.setdefault(r[0], r)
    return found


class Naive:
    def __init__(self, sources, rules):
        self.rules = rules
        kept = {s: (fields, first_rows(data)) for s, (fields, data) in sources.items()}
        keys = dict.fromkeys(k for _, by in kept.values() for k in by)
        self.individuals = [{s: dict(zip(fields, by[k])) if k in by else None for s, (fields, by) in kept.items()} for k in keys]
        self.fields = {s: fields for s, (fields, _) in sources.items()}

    def value(self, ind, p):
        if p == "stage":
            for rule in self.rules:
                if all((ind[s] is not None) is t if isinstance(t, bool) else ind[s] is not None and self.all_hold(t, lambda q, s=s: ind[s][q]) for s, t in rule["when"].items()):
                    return rule["value"]
            return MISSING
        for s, fields in self.fields.items():
            if p in fields and ind[s] is not None:
                return ind[s][p]
        return MISSING

    def all_hold(self, filter_, value):
        return all(self.holds(value(p), c) for p, c in filter_.items())

    def holds(self, a, condition):
        if a is MISSING:
            return False
        for op, e in (condition if isinstance(condition, dict) else {"eq": condition}).items():
            both = a is not None and e is not None
            number = both and not isinstance(a, str) and not isinstance(e, str)
            ok = {
                "eq": (a is None and e is None) or (both and type(a) is type(e) and a == e), "ne": not ((a is None and e is None) or (both and type(a) is type(e) and a == e)),
                "in": op == "in" and a is not None and any(type(x) is type(a) and x == a for x in e), "contains": op == "contains" and both and str(e) in str(a),
                "lt": number and a < e if op == "lt" else False, "gte": number and a >= e if op == "gte" else False,
            }[op]
            if not ok:
                return False
        return True


def make(rng):
    sources, names = {}, ["a", "b", "c"][: rng.choice([1, 2, 3])]
    for s in names:
        fields = ["k", *rng.sample(["x", "y", "n"], rng.randrange(1, 4))]
        keys = [None, "", " ", "　", *"ABCDEFGH"]
        kinds = {"k": lambda: rng.choice(keys), "x": lambda: rng.choice([None, "p", "q", "pq"]), "y": lambda: rng.choice([None, "1", "p"]), "n": lambda: rng.choice([None, 1, 2, 3])}
        sources[s] = fields, [tuple(kinds[f]() for f in fields) for _ in range(rng.randrange(0, 14))]
    rules = []
    for i in range(rng.randrange(1, 4)):
        when = {}
        for s in rng.sample(names, rng.randrange(1, len(names) + 1)):
            p = rng.choice(sources[s][0])
            when[s] = rng.choice([True, False, {p: condition(rng, p)}])
        rules.append({"when": when, "value": f"s{i % 2}"})
    return sources, rules


def condition(rng, p):
    literals = [None, 1, 2] if p == "n" else [None, "p", "1", "s0", "s1", "A", 1]
    op = rng.choice(["eq", "ne", "in", "contains", "lt", "gte", "bare"])
    if op == "bare":
        return rng.choice(literals)
    return {op: [rng.choice(literals) for _ in range(rng.randrange(3))] if op == "in" else rng.choice(literals)}


@pytest.mark.parametrize("seed", range(25))
def test_random_model(spark, seed):
    rng = random.Random(seed)
    sources, rules = make(rng)
    kinds = {"k": "string", "x": "string", "y": "string", "n": "number", "stage": "enum"}
    mapped = [p for p in "kxyn" if any(p in f for f, _ in sources.values())]
    model = {
        "object_types": {"o": {
            "kind": "thing", "identity": "k", "properties": {p: {"type": kinds[p]} for p in mapped} | {"stage": {"type": "enum", "derived": rules}},
            "sources": {s: {"connection": "c", "table": s, "fields": {f: f for f in fields}, "order_by": fields} for s, (fields, _) in sources.items()},
        }}
    }
    engine = Engine(spark, model)
    engine.sources.register("c", frames({s: spark.createDataFrame(data, ", ".join(f"{f} {'int' if f == 'n' else 'string'}" for f in fields)) for s, (fields, data) in sources.items()}))
    naive = Naive(sources, rules)
    wanted = [*mapped, "stage"]
    for filter_ in [{}] + [{p: condition(rng, p) for p in rng.sample(wanted, rng.choice([1, 1, 2]))} for _ in range(4)]:
        found = rows(engine.rows({"object": "o", "properties": wanted, "filter": filter_}))
        shown = [tuple(None if (v := naive.value(i, p)) is MISSING else v for p in wanted) for i in naive.individuals if naive.all_hold(filter_, lambda p, i=i: naive.value(i, p))]
        assert found == sorted(shown, key=repr), filter_
