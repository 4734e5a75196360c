"""The working copy of a model as one pack: the model itself and what a drawing of it remembers.

A pack that lost a part is still of use: a missing or malformed part of the drawing is that of the published version, and a
missing model is the published one. Only a model that is there and contradicts itself is rejected.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from tessera.plans.errors import InvalidModel, Rejected
from tessera.plans.model import Model, same_structure

# The parts of a drawing, and the numbers each of their entries has.
DRAWING = {"layout": ("x", "y"), "edgeBends": ("dx", "dy"), "edgePins": ()}
ENDS = ("source", "target")


@dataclass
class WorkingCopy:
    model: Model
    drawing: dict[str, dict]
    dirty: bool


def pack(copy: WorkingCopy) -> str:
    return json.dumps({"config": copy.model.raw, **{part: copy.drawing.get(part) or {} for part in DRAWING}}, ensure_ascii=False)


def _is_number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def _part(name: str, held) -> dict | None:
    """A part of a drawing as it is written; None: there is none, or it is malformed."""
    if not isinstance(held, dict) or not all(isinstance(e, dict) and all(_is_number(e.get(n)) for n in DRAWING[name]) for e in held.values()):
        return None
    if name == "edgePins":  # a malformed pin costs its own end only
        return {edge: {end: pin for end, pin in e.items() if end not in ENDS or isinstance(pin, dict)} for edge, e in held.items()}
    return held


def unpack(text: str | None) -> dict:
    """The parts of a pack that can be used; a text that is a bare model is a pack of nothing else."""
    if not text or not text.strip():
        return {}
    try:
        held = json.loads(text)
    except (ValueError, RecursionError):
        return {}
    if not isinstance(held, dict):
        return {}
    if not {"config", *DRAWING} & held.keys():
        return {"config": held}
    found = {part: _part(part, held.get(part)) for part in DRAWING}
    return {part: v for part, v in found.items() if v is not None} | ({"config": held["config"]} if held.get("config") is not None else {})


def hydrate(saved: str | None, published: Model, published_pack: str | None = None) -> WorkingCopy:
    """The working copy that a saved pack stands for, over the published version and its own pack."""
    held, before = unpack(saved), unpack(published_pack)
    try:
        model = Model.parse(held["config"]) if "config" in held else published
    except InvalidModel as e:
        raise Rejected(f"the working copy cannot be read: {e}") from e
    return WorkingCopy(model, {part: held.get(part, before.get(part, {})) for part in DRAWING}, not same_structure(model.raw, published.raw))
