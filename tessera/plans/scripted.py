"""Questions in plain words by a script: patterns, each with the structured request it stands for.

A port for :class:`~tessera.plans.service.Service` where no language model is at hand. The first pattern that occurs in a
question counts; texts of its request may name the pattern's groups in braces. A question no pattern fits is rejected, as is
one whose class the model does not have: a wrong answer would be worse than none.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from tessera.plans.errors import Rejected
from tessera.plans.model import Model


def _filled(value, groups: dict[str, str]):
    if isinstance(value, dict):
        return {_filled(k, groups): _filled(v, groups) for k, v in value.items()}
    if isinstance(value, list):
        return [_filled(v, groups) for v in value]
    if not isinstance(value, str):
        return value
    whole = re.fullmatch(r"\{(\w+):number\}", value)
    if whole:
        return float(groups[whole[1]]) if "." in groups[whole[1]] else int(groups[whole[1]])
    return re.sub(r"\{(\w+)\}", lambda m: groups[m[1]], value)


class Script:
    def __init__(self, rules: Iterable[tuple[str, dict]]) -> None:
        self.rules = [(re.compile(pattern, re.I), request) for pattern, request in rules]

    def __call__(self, question: str, model: Model) -> dict:
        for pattern, request in self.rules:
            if found := pattern.search(question):
                filled = _filled(request, {k: v for k, v in found.groupdict().items() if v is not None})
                if filled["object"] not in model.object_types:
                    raise Rejected(f"the script speaks of {filled['object']!r}, which this model does not have")
                return filled
        raise Rejected("the script has no pattern for this question")


#: Questions about the retail tables.
RETAIL_SCRIPT = Script([
    (r"orders? (?P<key>\d+)", {"object": "order", "identity": "{key:number}", "properties": ["order_key", "stage", "total"]}),
    (r"how many orders.* each stage", {"object": "order", "aggregate": {"group_by": ["stage"], "metrics": [{"count": "*"}]}}),
    (r"customers? in (?P<segment>[a-z]+) without orders", {"object": "customer", "properties": ["customer_key", "name"], "filter": {"segment": "{segment}", "$link": {"orders": False}}}),
    (r"balance (?:above|over) (?P<least>\d+(?:\.\d+)?)", {"object": "customer", "properties": ["customer_key", "balance"], "filter": {"balance": {"gt": "{least:number}"}}}),
    (r"nations? of (?P<region>[a-z ]+?)\??$", {"object": "nation", "properties": ["name"], "filter": {"$link": {"in_region": {"name": "{region}"}}}}),
])
