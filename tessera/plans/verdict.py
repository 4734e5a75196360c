"""What the evidence says about two classes, and models with a verdict carried out. Pure functions; no data."""

from __future__ import annotations

import copy
from collections.abc import Iterable
from dataclasses import dataclass, replace

from tessera.plans.errors import InvalidModel, Rejected
from tessera.plans.filters import walk
from tessera.plans.model import Model, ObjectType
from tessera.plans.validate import effects

SAME, OVERLAP, STAGE, NAME_SIMILAR, SKIP = "same", "overlap", "stage", "name_similar", "skip"
VERDICTS = (SAME, OVERLAP, STAGE, NAME_SIMILAR, SKIP)
# Shares of common fields and rates of common identifiers that advice turns on.
FEW_FIELDS, MOST_FIELDS, NEARLY_ALL = 0.4, 0.8, 0.8
STAGE_FIELD = ("status", "state", "阶段", "状态")
SHARED = "shared_"


@dataclass(frozen=True)
class Advice:
    class_a: str
    class_b: str
    verdict: str
    keep: str
    reason: str


def pair_key(a: str, b: str) -> tuple[str, str]:
    return (a, b) if a <= b else (b, a)


def _fields(cls: ObjectType) -> list[str]:
    return [p.name for p in cls.properties.values() if p.derived is None]


def _has_stage(*classes: ObjectType) -> bool:
    return any(s in f.lower() for c in classes for f in _fields(c) for s in STAGE_FIELD)


def _keep(a: ObjectType, b: ObjectType) -> str:
    shared = a.name.startswith(SHARED), b.name.startswith(SHARED)
    if shared[0] != shared[1]:
        return b.name if shared[0] else a.name
    return b.name if len(_fields(b)) > len(_fields(a)) else a.name


def _names_alike(a: str, b: str) -> bool:
    return a == b or (len(a) > 2 and a in b) or (len(b) > 2 and b in a)


def advise_by_schema(a: ObjectType, b: ObjectType) -> Advice | None:
    """From names and fields alone; None: not worth comparing."""
    mine, theirs = _fields(a), _fields(b)
    common = [f for f in mine if f in theirs]
    share = len(common) / max(len(mine), len(theirs), 1)
    if share < FEW_FIELDS:
        return Advice(a.name, b.name, NAME_SIMILAR, _keep(a, b), "the names are alike, the fields are not") if _names_alike(a.name, b.name) else None
    verdict = SAME if share > MOST_FIELDS else STAGE if _has_stage(a, b) else OVERLAP
    return Advice(a.name, b.name, verdict, _keep(a, b), f"{len(common)} of {max(len(mine), len(theirs))} fields agree")


def advise_by_overlap(before: Advice, a: ObjectType, b: ObjectType, count_a: int, count_b: int, count_hit: int, rate: float) -> Advice:
    """Advice revised by how many identifiers the classes share."""
    counts = f"{count_hit} common identifiers of {count_a} and {count_b}"
    if count_hit == 0:
        empty = not count_a or not count_b
        demoted = before.verdict == OVERLAP or (before.verdict == STAGE and not empty)
        return replace(before, verdict=SAME if demoted else before.verdict, reason=f"{counts}; that does not speak against one class")
    if rate >= NEARLY_ALL:
        stage = before.verdict == STAGE and _has_stage(a, b)
        return replace(before, verdict=STAGE if stage else SAME, reason=f"{counts}; nearly all")
    return replace(before, reason=f"{counts}; some, not all")


def suggest_key(trial: Iterable[dict], current: str | None) -> tuple[str | None, str]:
    """The candidate to tell individuals apart by, from the rows of a key trial, and why."""
    by: dict[str, dict] = {}
    for r in trial:
        held = by.setdefault(r["candidate"], {"unique": r["unique_in_each"], "hard": r["hard"], "hits": 0})
        held["hits"] = max(held["hits"], r["hits"] or 0)
    if not by:
        return None, "there are no candidates"
    usable = {n: c for n, c in by.items() if c["unique"]}
    if not usable:
        return None, "every candidate repeats within a source"
    best = max(usable, key=lambda n: (usable[n]["hits"], usable[n]["hard"]))
    if usable[best]["hits"]:
        return best, f"{usable[best]['hits']} values are known elsewhere; {'declared' if usable[best]['hard'] else 'found'} unique"
    if current in usable:
        return current, "no value is known elsewhere; the present key stays"
    return None, "no value is known elsewhere"


# Candidate pairs


def open_pairs(model: Model, decided: Iterable[tuple[str, str]]) -> list[Advice]:
    """Pairs of classes with sources that are worth a decision and have none."""
    done = {pair_key(*p) for p in decided}
    classes = [c for c in model.object_types.values() if c.sources]
    found = []
    for i, a in enumerate(classes):
        for b in classes[i + 1 :]:
            if pair_key(a.name, b.name) not in done and (advice := advise_by_schema(a, b)):
                found.append(advice)
    return found


def rewrite_pairs(pairs: Iterable[tuple[str, str]], kept: str, gone: str, decided: Iterable[tuple[str, str]] = ()) -> list[tuple[str, str]]:
    """Pairs after ``gone`` was merged into ``kept``: its pairs become those of ``kept``, once each, and none that is decided."""
    done, found = {pair_key(*p) for p in decided}, []
    for a, b in pairs:
        a, b = (kept if x == gone else x for x in (a, b))
        if a != b and pair_key(a, b) not in done and pair_key(a, b) not in {pair_key(*p) for p in found}:
            found.append((a, b))
    return found


def stage_names(names: dict | None) -> tuple[str, str]:
    return (names or {}).get("from", "early"), (names or {}).get("to", "late")


# Carrying a verdict out


def conversion_action(link: str, stage: str) -> dict:
    return {"description": f"to {stage}", "pre": {"$link": {link: False}}, "effect": [{"link": link}]}


def action_dies(model: Model, owner: str, action: dict, gone: str, lost: str | None = None) -> bool:
    """Whether an action cannot outlive a class: it uses the class, one of its relations, or its lost identity."""

    def filter_dies(of: str, f: dict | None) -> bool:
        for seen in walk(model, of, f or {}):
            if seen.kind == "link":
                hop = model.hop(seen.of, seen.key) if seen.of else None
                if hop is None or gone in (hop.link.from_, hop.link.to):
                    return True
            elif seen.kind == "property":
                if lost and (seen.key == lost or (isinstance(seen.value, dict) and seen.value.get("property") == lost)):
                    return True
            elif seen.key == "$request" and any(isinstance(t, dict) and t.get("object") == gone for t in seen.value.values()):
                return True
        return False

    if filter_dies(owner, action.get("pre")):
        return True
    for kind, spec in effects(action):
        if kind == "link":
            link = model.link_types.get(spec)
            if link is None or gone in (link.from_, link.to):
                return True
        elif spec.get("object") == gone or filter_dies(spec["object"], spec.get("filter")):
            return True
    return any(i.get("object") == gone for i in action.get("inform") or ())


def drop_class(d: dict, name: str) -> None:
    """Removes a class and all relations from or to it."""
    d["object_types"].pop(name, None)
    d["link_types"] = {n: x for n, x in (d.get("link_types") or {}).items() if name not in (x["from"], x["to"])}
    if d.get("class_conclusions"):
        d["class_conclusions"] = [r for r in d["class_conclusions"] if name not in (*r["classes"], r.get("shared"))]


def merge_classes(model: Model, kept: str, gone: str) -> dict:
    """The model with ``gone`` merged into ``kept``: properties united, sources added, identities made one."""
    d = model.to_dict()
    a, b = model.object(kept), model.object(gone)
    into, from_ = d["object_types"][kept], d["object_types"][gone]
    lost = b.identity if a.identity and b.identity and a.identity != b.identity else None
    renamed = {s: f"{s}_{gone}" if s in a.sources else s for s in b.sources}
    for name, p in from_["properties"].items():
        if name == lost or name in into["properties"]:
            continue
        p = copy.deepcopy(p)
        if isinstance(p.get("derived"), list):
            for rule in p["derived"]:
                rule["when"] = {renamed.get(s, s): t for s, t in rule["when"].items()}
        into["properties"][name] = p
    into.setdefault("sources", {})
    for s, entry in (from_.get("sources") or {}).items():
        entry = copy.deepcopy(entry)
        if lost:
            entry["fields"] = {a.identity if p == lost else p: c for p, c in entry["fields"].items()}
            if entry.get("key") == lost:
                entry["key"] = a.identity
        into["sources"][renamed[s]] = entry
    for part, lives in (("actions", lambda x: not action_dies(model, gone, x, gone, lost)), ("axioms", lambda x: True)):
        for name, x in (from_.get(part) or {}).items():
            if name not in (into.get(part) or {}) and lives(x):
                into.setdefault(part, {})[name] = copy.deepcopy(x)
    drop_class(d, gone)
    return d


def apply_verdict(model: Model, class_a: str, class_b: str, verdict: str, names: dict | None = None) -> Model:
    """The model after a verdict; ``class_a`` stays. It is parsed anew, and wholly as before where the verdict changes nothing."""
    if verdict not in VERDICTS:
        raise Rejected(f"unknown verdict {verdict!r}")
    a, b = model.object(class_a), model.object(class_b)
    if verdict in (NAME_SIMILAR, SKIP):
        return model
    d = merge_classes(model, class_a, class_b)
    if verdict != STAGE:
        return Model.parse(d)
    start, end = stage_names(names)
    into = d["object_types"][class_a]
    new = [s for s in into["sources"] if s not in a.sources]
    if not a.sources or not new:
        raise InvalidModel("two stages need a source each")
    link, action = f"{class_a}_to_{end}", f"convert_to_{end}"
    if link in d["link_types"] or action in (into.get("actions") or {}):
        raise InvalidModel(f"{link!r} or {action!r} exists already")
    status = a.properties.get("status")
    if status and status.rules:
        # A further stage of a known life: the new source's rule comes first.
        p = into["properties"]["status"]
        p["derived"] = [{"when": {new[0]: True}, "value": end}, *p["derived"]]
        if end not in status.allowed():
            p["values"] = [*(p.get("values") or ()), {"value": end}]
        start = (names or {}).get("from", status.rules[0]["value"])
    else:
        if "status" in a.properties or ("status" in b.properties and "status" in into["properties"]):
            raise InvalidModel(f"{class_a} has a property 'status' already; rename it first")
        first = next(iter(a.sources))
        into["properties"]["status"] = {"type": "enum", "values": [{"value": start}, {"value": end}], "derived": [{"when": {first: True, new[0]: False}, "value": start}, {"when": {new[0]: True}, "value": end}]}
    d["link_types"][link] = {"from": class_a, "to": class_a, "inverse": f"{class_a}_from_{start}", "card": "1:1", "transition": {"property": "status", "from": start, "to": end}}
    into.setdefault("actions", {})[action] = conversion_action(link, end)
    return Model.parse(d)
