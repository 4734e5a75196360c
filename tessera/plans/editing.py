"""Edits of a model as pure functions: each gives a new model, or rejects and leaves the old one as it is."""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator

from tessera.plans.errors import Rejected
from tessera.plans.filters import is_block
from tessera.plans.model import NAME, Model
from tessera.plans.validate import check_actions, check_model
from tessera.plans.verdict import drop_class

# The names of all edits.
EDITS = ("create_object", "delete_object", "update_object", "edit_stages", "add_property", "remove_property", "update_property", "set_identity", "create_link", "delete_link", "update_link", "import_objects", "replace_object", "set_action", "remove_action")


def legal_name(name: str) -> str:
    if not isinstance(name, str) or not NAME.fullmatch(name):
        raise Rejected(f"{name!r} is no name: lower case letters, digits and underscores, a letter first")
    return name


def _map_filter(model: Model, of: str | None, f: dict, change: Callable[[str | None, str, str], str]) -> dict:
    """A filter with its property and relation names changed: ``change(class, kind, name)``."""
    out = {}
    for key, value in f.items():
        if key == "$link":
            out[key] = {}
            for relation, target in value.items():
                hop = model.hop(of, relation) if of else None
                out[key][change(of, "link", relation)] = _map_filter(model, hop.target if hop else None, target, change) if isinstance(target, dict) else target
        elif key == "$request":
            out[key] = {p: {**t, "object": change(None, "class", t["object"])} if isinstance(t, dict) and "object" in t else t for p, t in value.items()}
        elif key.startswith("$"):
            out[key] = value
        else:
            def operand(v):
                return {**v, "property": change(of, "property", v["property"])} if isinstance(v, dict) and "property" in v and v.get("from") != "request" else v

            out[change(of, "property", key)] = {op: operand(v) for op, v in value.items()} if is_block(value) else operand(value)
    return out


def map_names(model: Model, change: Callable[[str | None, str, str], str]) -> dict:
    """The model with names changed wherever they are used, not where they are declared."""
    d = model.to_dict()
    for cls, c in d["object_types"].items():
        for p in c["properties"].values():
            if isinstance(p.get("derived"), dict):
                p["derived"] = _map_filter(model, cls, p["derived"], change)
            for rule in p["derived"] if isinstance(p.get("derived"), list) else ():
                rule["when"] = {s: _map_filter(model, cls, t, change) if isinstance(t, dict) else t for s, t in rule["when"].items()}
        if c.get("identity"):
            c["identity"] = change(cls, "property", c["identity"])
        for s in (c.get("sources") or {}).values():
            s["fields"] = {change(cls, "property", p): x for p, x in s["fields"].items()}
            if s.get("key"):
                s["key"] = change(cls, "property", s["key"])
        for a in (c.get("axioms") or {}).values():
            a["property"] = change(cls, "property", a["property"])
        for a in (c.get("actions") or {}).values():
            if a.get("pre"):
                a["pre"] = _map_filter(model, cls, a["pre"], change)
            for item in a["effect"]:
                for kind, spec in item.items():
                    if kind == "link":
                        item[kind] = change(cls, "link", spec)
                        continue
                    of = spec["object"]
                    if spec.get("filter"):
                        spec["filter"] = _map_filter(model, of, spec["filter"], change)
                    if spec.get("properties"):
                        spec["properties"] = {change(of, "property", p): v for p, v in spec["properties"].items()}
                    spec["object"] = change(None, "class", of)
            for i in a.get("inform") or ():
                i["properties"] = {change(i["object"], "property", p): v for p, v in i["properties"].items()}
                i["object"] = change(None, "class", i["object"])
    for link in d.get("link_types", {}).values():
        for pair in link.get("match") or ():
            pair["from"], pair["to"] = change(link["from"], "property", pair["from"]), change(link["to"], "property", pair["to"])
        if link.get("transition"):
            link["transition"]["property"] = change(link["from"], "property", link["transition"]["property"])
        link["from"], link["to"] = change(None, "class", link["from"]), change(None, "class", link["to"])
    for row in d.get("class_conclusions") or ():
        row["classes"] = [change(None, "class", c) for c in row["classes"]]
        if row.get("shared"):
            row["shared"] = change(None, "class", row["shared"])
    return d


def uses(model: Model, kind: str, of: str | None, name: str) -> int:
    """How often a property (of a class), relation or class is used, apart from its own declaration and source mappings."""
    count = 0
    mapped = sum(name in s.fields for s in model.object_types[of].sources.values()) if kind == "property" and of in model.object_types else 0

    def change(cls: str | None, k: str, n: str) -> str:
        nonlocal count
        same = k == kind and (n == name or (k == "link" and cls and (hop := model.hop(cls, n)) is not None and hop.link.name == name))
        count += bool(same and (k != "property" or cls == of))
        return n

    map_names(model, change)
    return count - mapped


def _need(d: dict, part: str, name: str) -> dict:
    if name not in d[part]:
        raise Rejected(f"there is no {name!r}")
    return d[part][name]


def _rename_key(d: dict, old: str, new: str) -> dict:
    return {new if k == old else k: v for k, v in d.items()}


def _edit(model: Model, op: dict) -> dict:
    kind = op["op"]
    d = model.to_dict()
    d.setdefault("link_types", {})
    objects, links = d["object_types"], d["link_types"]
    if kind == "create_object":
        if legal_name(op["name"]) in objects:
            raise Rejected(f"{op['name']!r} exists already")
        objects[op["name"]] = {"kind": op["kind"], "properties": {}} | ({"description": op["description"]} if op.get("description") else {})
    elif kind == "delete_object":
        _need(d, "object_types", op["name"])
        drop_class(d, op["name"])
    elif kind == "update_object":
        old, new = op["name"], op.get("new_name") or op["name"]
        _need(d, "object_types", old)
        if new != old:
            if legal_name(new) in objects:
                raise Rejected(f"{new!r} exists already")
            d = map_names(model, lambda cls, k, n: new if k == "class" and n == old else n)
            d["object_types"] = _rename_key(d["object_types"], old, new)
        if "description" in op:
            d["object_types"][new]["description"] = op["description"]
    elif kind == "add_property":
        c = _need(d, "object_types", op["object"])
        if legal_name(op["name"]) in c["properties"]:
            raise Rejected(f"{op['name']!r} exists already")
        c["properties"][op["name"]] = {k: op[k] for k in ("type", "description", "values") if k in op}
    elif kind in ("remove_property", "update_property", "set_identity"):
        c = _need(d, "object_types", op["object"])
        name = op["name"]
        if kind == "set_identity" and not name:
            c.pop("identity", None)
            return d
        if name not in c["properties"]:
            raise Rejected(f"{op['object']} has no property {name!r}")
        if kind == "set_identity":
            c["identity"] = name
        elif kind == "remove_property":
            if uses(model, "property", op["object"], name):
                raise Rejected(f"{op['object']}.{name} is in use")
            del c["properties"][name]
            for s in (c.get("sources") or {}).values():
                s["fields"].pop(name, None)
        else:
            new = op.get("new_name") or name
            if new != name:
                if legal_name(new) in c["properties"]:
                    raise Rejected(f"{new!r} exists already")
                d = map_names(model, lambda cls, k, n: new if k == "property" and cls == op["object"] and n == name else n)
                c = d["object_types"][op["object"]]
                c["properties"] = _rename_key(c["properties"], name, new)
            for k in ("type", "values", "description"):
                if k in op:
                    if op[k] in ("", []):
                        c["properties"][new].pop(k, None)
                    else:
                        c["properties"][new][k] = op[k]
    elif kind == "create_link":
        if legal_name(op["name"]) in links:
            raise Rejected(f"{op['name']!r} exists already")
        links[op["name"]] = {k: op[k] for k in ("from", "to", "inverse", "card", "description") if op.get(k)} | {"match": [op["match"]] if isinstance(op["match"], dict) else op["match"]}
    elif kind == "delete_link":
        _need(d, "link_types", op["name"])
        if uses(model, "link", None, op["name"]):
            raise Rejected(f"{op['name']!r} is in use")
        del links[op["name"]]
    elif kind == "update_link":
        old, new = op["name"], op.get("new_name") or op["name"]
        link = _need(d, "link_types", old)
        moved = any(op.get(k) and op[k] != link[k] for k in ("from", "to"))
        if moved and (link.get("transition") or uses(model, "link", None, old)):
            raise Rejected(f"{old!r} is in use or a transition; its ends stay")
        if moved and op.get("from", link["from"]) == op.get("to", link["to"]):
            raise Rejected("a relation is not moved onto one class")
        if new != old:
            if legal_name(new) in links:
                raise Rejected(f"{new!r} exists already")
            d = map_names(model, lambda cls, k, n: new if k == "link" and n == old else n)
            d["link_types"] = _rename_key(d["link_types"], old, new)
        link = d["link_types"][new]
        if op.get("inverse") and link.get("inverse") and op["inverse"] != link["inverse"]:
            was = link["inverse"]
            d = map_names(Model.parse(d), lambda cls, k, n: op["inverse"] if k == "link" and n == was else n)
            link = d["link_types"][new]
        for k in ("description", "inverse", "from", "to"):
            if k in op:
                link[k] = op[k]
        if op.get("match"):
            link["match"] = [op["match"]] if isinstance(op["match"], dict) else op["match"]
    elif kind == "import_objects":
        for name, c in op["objects"].items():
            if legal_name(name) in objects:
                raise Rejected(f"{name!r} exists already")
            objects[name] = {k: v for k, v in c.items() if k not in ("actions", "axioms")}
    elif kind == "replace_object":
        old = _need(d, "object_types", op["name"])
        if blockers := replace_blockers(model, op["name"]):
            raise Rejected(f"{op['name']!r} cannot be replaced: {', '.join(blockers)}")
        objects[op["name"]] = {k: v for k, v in op["def"].items() if k not in ("actions", "axioms")} | {k: old[k] for k in ("actions", "axioms") if k in old}
    elif kind == "edit_stages":
        c = _need(d, "object_types", op["object"])
        staged = [p for p in model.object_types[op["object"]].properties.values() if p.rules]
        if len(staged) != 1:
            raise Rejected(f"{op['object']} has {len(staged)} properties with stages")
        p, kept = c["properties"][staged[0].name], [i["value"] for i in op["items"]]
        if len(set(kept)) != len(kept):
            raise Rejected("a stage is named once")
        for link in model.link_types.values():
            if link.transition and link.from_ == op["object"] and not {link.transition["from"], link.transition["to"]} <= set(kept):
                raise Rejected(f"{link.name!r} needs its stages")
        p["derived"] = [{"when": i["when"], "value": i["value"]} for i in op["items"]]
        p["values"] = [{"value": i["value"]} | ({"label": i["label"]} if i.get("label") else {}) for i in op["items"]]
    elif kind == "set_action":
        _need(d, "object_types", op["object"]).setdefault("actions", {})[legal_name(op["name"])] = copy.deepcopy(op["def"])
    elif kind == "remove_action":
        actions = _need(d, "object_types", op["object"]).get("actions") or {}
        if actions.pop(op["name"], None) is None:
            raise Rejected(f"there is no action {op['name']!r}")
    else:
        raise Rejected(f"unknown edit {kind!r}")
    return d


def edit(model: Model, op: dict) -> Model:
    """The model after an edit (see :data:`EDITS`); classes may lack a key until they are published."""
    if not isinstance(op, dict) or op.get("op") not in EDITS:
        raise Rejected(f"unknown edit {op.get('op') if isinstance(op, dict) else op!r}")
    try:
        changed = Model.parse(_edit(model, op))
    except KeyError as e:
        raise Rejected(f"{op['op']}: {e.args[0]!r} is missing") from e
    check_model(changed, keyless=True)
    return changed


def gate(model: Model) -> None:
    """All that a model must meet to be published."""
    check_model(model)
    check_actions(model)


def replace_blockers(model: Model, name: str) -> list[str]:
    """Why a class cannot be replaced as a whole: what others rely on in it."""
    found = [f"relation {x.name}" for x in model.link_types.values() if name in (x.from_, x.to)]
    found += [f"action {c.name}.{a}" for c in model.object_types.values() if c.name != name for a, x in c.actions.items() for item in x["effect"] for spec in item.values() if isinstance(spec, dict) and spec.get("object") == name]
    return found


# Views


def stages(model: Model, name: str) -> list[dict]:
    """The stages of a class and the transitions out of each."""
    found = []
    for p in model.object(name).properties.values():
        for rule in p.rules or ():
            out = [x.name for x in model.link_types.values() if x.transition and x.from_ == name and x.transition["from"] == rule["value"]]
            found.append({"property": p.name, "value": rule["value"], "when": rule["when"], "transitions": out})
    return found


def list_classes(model: Model) -> list[dict]:
    return [{"name": c.name, "kind": c.kind, "description": c.description, "identity": c.identity, "sources": len(c.sources), "properties": len(c.properties)} for c in model.object_types.values()]


def read_class(model: Model, name: str) -> dict:
    c = model.object(name)
    relations = [{"name": x.name, "to": x.to, "match": list(x.match), "transition": x.transition} for x in model.link_types.values() if x.from_ == name]
    relations += [{"name": x.inverse, "to": x.from_, "match": [(b, a) for a, b in x.match], "transition": x.transition} for x in model.link_types.values() if x.to == name and x.inverse]
    return {"name": name, "kind": c.kind, "identity": c.identity, "properties": {p.name: {"type": p.type, "derived": p.derived is not None, "values": p.allowed()} for p in c.properties.values()}, "relations": relations, "stages": stages(model, name), "actions": {a: x.get("description") for a, x in c.actions.items()}}


def search(model: Model, word: str) -> list[dict]:
    """Classes, properties and relations whose name or description has a word."""
    word = word.lower()

    def hits() -> Iterator[dict]:
        def has(*texts: str | None) -> bool:
            return any(word in (t or "").lower() for t in texts)

        for c in model.object_types.values():
            if has(c.name, c.description):
                yield {"kind": "class", "name": c.name}
            for p in c.properties.values():
                if has(p.name, p.description):
                    yield {"kind": "property", "name": f"{c.name}.{p.name}"}
        for x in model.link_types.values():
            if has(x.name, x.inverse, x.description):
                yield {"kind": "relation", "name": x.name}

    return list(hits())


def difference(old: Model, new: Model) -> list[dict]:
    """Classes and relations added, removed or changed."""
    found = []
    for part in ("object_types", "link_types"):
        a, b = old.raw.get(part) or {}, new.raw.get(part) or {}
        for name in sorted(a.keys() | b.keys()):
            change = "added" if name not in a else "removed" if name not in b else "changed" if a[name] != b[name] else None
            if change:
                found.append({"record": f"{part}.{name}", "change": change})
    return found


def draft_from_tables(tables, taken: set[str] = frozenset()) -> dict:
    """Class drafts from tables: every column becomes a property; a text key or unique column the identity."""
    found: dict[str, dict] = {}
    for t in tables:
        name = t.table.lower()
        if name in found or name in taken:
            name = f"{t.connection}_{name}"
        keys = [c for c in t.columns if (c.unique or c.pk) and not c.integer]
        keys.sort(key=lambda c: not c.pk)
        pk = next((c.name for c in t.columns if c.pk), None)
        properties = {c.name.lower(): {"type": c.type} | ({"description": c.comment} if c.comment else {}) for c in t.columns}
        found[name] = {"kind": "thing", "properties": properties, "sources": {t.connection: {"connection": t.connection, "table": t.table, "fields": {c.name.lower(): c.name for c in t.columns}} | ({"pk": pk} if pk else {})}} | ({"identity": keys[0].name.lower()} if keys else {})
    return found


def uncovered(draft: dict, tables) -> dict:
    """The draft with a property for every column that no property maps yet."""
    draft = copy.deepcopy(draft)
    for t in tables:
        for c in t.columns:
            owners = [(o, s) for o in draft.values() for s in (o.get("sources") or {}).values() if (s["connection"], s["table"]) == (t.connection, t.table)]
            if owners and all(c.name not in s["fields"].values() for _, s in owners):
                owner, source = owners[0]
                name = c.name.lower()
                while name in owner["properties"]:
                    name += "_2"
                owner["properties"][name] = {"type": c.type}
                source["fields"][name] = c.name
    return draft


