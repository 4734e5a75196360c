"""Questions with expected answers, run in a batch."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import functions as F

from tessera.plans.engine import Engine
from tessera.plans.errors import Rejected
from tessera.plans.query import ROWS, metric_name


@dataclass(frozen=True)
class Outcome:
    question: str
    ok: bool
    #: Where it failed: compile, execute or wrong.
    stage: str | None = None
    found: object = None
    message: str = ""


def parse_expectation(text: str | int | None) -> tuple[str, object]:
    """``empty``, a number of rows or total, or ``field=value`` of the one row."""
    text = str(text if text is not None else "").strip()
    if text in ("", "empty"):
        return "empty", None
    if text.lstrip("-").isdigit():
        return "number", int(text)
    if "=" in text:
        field, _, value = text.partition("=")
        return "field", (field.strip(), value.strip())
    raise Rejected(f"{text!r} is no expectation")


def check(engine: Engine, question: str, request: dict, expected: str | int | None) -> Outcome:
    """Runs a structured query. Lists are counted; an aggregate of one metric is summed over its groups."""
    try:
        kind, want = parse_expectation(expected)
        if kind == "number" and not request.get("aggregate") and request.get("limit", ROWS) < want <= ROWS:
            return Outcome(question, False, "wrong", message="the limit is below the expected count")
        df = engine.rows({k: v for k, v in request.items() if k != "limit"})
    except Rejected as e:
        return Outcome(question, False, "compile", message=str(e))
    try:
        if kind == "field":
            field, value = want
            if field not in df.columns:
                return Outcome(question, False, "wrong", message=f"there is no column {field!r}")
            values = [str(r[0]) for r in df.select(field).limit(2).collect()]
            return Outcome(question, values == [value], None if values == [value] else "wrong", values)
        if (spec := request.get("aggregate")) and kind == "number":
            if len(spec["metrics"]) != 1:
                return Outcome(question, False, "wrong", message="an expected total needs one metric")
            (op, of), = spec["metrics"][0].items()
            found = df.agg(F.sum(metric_name(op, of))).first()[0] or 0
        else:
            found = df.count()
    except Exception as e:
        return Outcome(question, False, "execute", message=str(e).splitlines()[0])
    ok = found == (0 if kind == "empty" else want)
    return Outcome(question, ok, None if ok else "wrong", found)


def run_pack(engine: Engine, pack: Iterable[dict]) -> list[Outcome]:
    """``pack``: question, request, expected. A failure does not stop the others."""
    return [check(engine, q["question"], q["request"], q.get("expected")) for q in pack]


#: Questions about the retail tables whose answers do not depend on their scale.
RETAIL_PACK = [
    {"question": "How many regions are there?", "request": {"object": "region"}, "expected": 5},
    {"question": "How many nations, by region?", "request": {"object": "nation", "aggregate": {"group_by": ["region_key"], "metrics": [{"count": "*"}]}}, "expected": 25},
    {"question": "Which orders are placed and returned at once?", "request": {"object": "order", "filter": {"stage": "placed", "return_flag": "R"}}, "expected": "empty"},
    {"question": "What is region 2 called?", "request": {"object": "region", "identity": 2, "properties": ["name"]}, "expected": "name=ASIA"},
]
