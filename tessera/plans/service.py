"""The whole interface as methods of one object: querying, acting, aligning and editing, over a workspace and its sources."""

from __future__ import annotations

import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import integrate
from tessera.plans import editing, verdict
from tessera.plans.acceptance import Outcome, run_pack
from tessera.plans.catalog import Workspace
from tessera.plans.engine import Engine
from tessera.plans.errors import Rejected
from tessera.plans.model import Model
from tessera.plans.query import Result
from tessera.sources.catalog import Sources, TableInfo


class Service:
    """``ask``: turns a question into a structured request; there is no such thing unless one is given."""

    def __init__(self, spark: SparkSession, sources: Sources, folder: str | Path, workspace: str = "main", *, clock: Callable[[], int] | None = None, ask: Callable[[str, Model], dict] | None = None) -> None:
        self.spark, self.sources, self.clock, self.ask_port = spark, sources, clock, ask
        self.workspace = Workspace(folder, workspace)

    def engine(self, *, draft: bool = False) -> Engine:
        model = self.workspace.draft()[0] if draft else self.workspace.published()
        if not draft:
            return Engine(self.spark, model, sources=self.sources, clock=self.clock)
        made = Engine.__new__(Engine)
        made.spark, made.sources, made.clock, made.model = self.spark, self.sources, self.clock or (lambda: int(time.time())), model
        return made

    def _logged(self, kind: str, request: dict, run: Callable[[], object]):
        began = time.perf_counter()
        try:
            found = run()
        except Exception as e:
            self.workspace.log(kind, request, False, None, time.perf_counter() - began, str(e).splitlines()[0])
            raise
        self.workspace.log(kind, request, True, None, time.perf_counter() - began)
        return found

    # Reading and writing

    def query(self, request: dict) -> Result:
        """Binds a request against the published model. The rows are computed when they are asked for."""
        return self._logged("query", request, lambda: self.engine().query(request))

    def ask(self, question: str) -> Result:
        if self.ask_port is None:
            raise Rejected("nothing here understands questions")
        return self.query(self.ask_port(question, self.workspace.published()))

    def run_action(self, object: str, action: str, requests: DataFrame):
        return self._logged("action", {"object": object, "action": action}, lambda: self.engine().run_actions(object, action, requests))

    # The model

    def list_classes(self) -> list[dict]:
        return editing.list_classes(self.workspace.draft()[0])

    def read_class(self, name: str) -> dict:
        return editing.read_class(self.workspace.draft()[0], name)

    def search(self, word: str) -> list[dict]:
        return editing.search(self.workspace.draft()[0], word)

    def edit_draft(self, op: dict, rev: int | None = None) -> int:
        return self.workspace.edit(op, rev)

    def publish(self, note: str = "") -> int:
        return self.workspace.publish(note)

    def propose_action(self, object: str, fields: list[str]) -> dict:
        """An action that sets fields of one individual from request parameters."""
        cls = self.workspace.draft()[0].object(object)
        for f in fields:
            if f not in cls.properties or cls.properties[f].derived is not None:
                raise Rejected(f"{object}.{f} cannot be written")
        return {"description": f"set {', '.join(fields)}", "pre": {"$exists": True}, "effect": [{"update": {"object": object, "identity": {"from": "identity"}, "properties": {f: {"from": "request"} for f in fields}}}]}

    # Sources

    def list_tables(self) -> list[TableInfo]:
        return self.sources.tables()

    def propose_objects(self, tables: list[tuple[str, str]]) -> dict:
        """Class drafts for tables, every column covered."""
        infos = [self.sources.info(c, t) for c, t in tables]
        return editing.uncovered(editing.draft_from_tables(infos, set(self.workspace.draft()[0].object_types)), infos)

    # Alignment

    def list_candidates(self) -> list[dict]:
        """Open pairs of classes; only pairs of classes that changed since the last call are judged anew."""
        model = self.workspace.draft()[0]
        kept, changed = self.workspace.candidates(model)
        done = [(d["class_a"], d["class_b"]) for d in self.workspace.decisions()]
        fresh = [vars(a) for a in verdict.open_pairs(model, done) if {a.class_a, a.class_b} & changed]
        pairs = [p for p in kept if not {p["class_a"], p["class_b"]} & changed] + fresh
        self.workspace.save_candidates(model, pairs)
        return [p for p in pairs if model.object(p["class_a"]).sources and model.object(p["class_b"]).sources]

    def compute_overlap(self, class_a: str, class_b: str) -> dict:
        row = integrate.overlap(self.engine(draft=True), class_a, class_b).first().asDict()
        self.workspace.save_overlap(row)
        return row

    def propose_key(self, object: str) -> dict:
        engine = self.engine(draft=True)
        evidence = [r.asDict() for r in integrate.key_trial(engine, object).collect()]
        key, reason = verdict.suggest_key(evidence, engine.model.object(object).identity)
        return {"object": object, "key": key, "reason": reason, "hard": any(r["hard"] for r in evidence if r["candidate"] == key), "evidence": evidence}

    def propose_pair(self, class_a: str, class_b: str, overlap: dict | None = None) -> dict | None:
        model = self.workspace.draft()[0]
        a, b = model.object(class_a), model.object(class_b)
        advice = verdict.advise_by_schema(a, b)
        if overlap is not None:
            advice = advice or verdict.Advice(class_a, class_b, verdict.NAME_SIMILAR, class_a, "neither names nor fields are alike")
            advice = verdict.advise_by_overlap(advice, a, b, overlap["count_a"], overlap["count_b"], overlap["count_hit"], overlap["rate"])
        return vars(advice) if advice else None

    def decide(self, class_a: str, class_b: str, choice: str, *, stage_names: dict | None = None, **evidence) -> int:
        """Carries a verdict out on the draft and records it with its evidence."""
        model, rev = self.workspace.draft()
        if any({d["class_a"], d["class_b"]} == {class_a, class_b} for d in self.workspace.decisions()):
            raise Rejected(f"{class_a} and {class_b} are decided")
        pairs, _ = self.workspace.candidates(model)
        changed = verdict.apply_verdict(model, class_a, class_b, choice, stage_names)
        if changed is not model:
            rev = self.workspace.replace(changed, rev)
        self.workspace.decide(class_a, class_b, choice, **evidence)
        if class_b not in changed.object_types:
            done = [(d["class_a"], d["class_b"]) for d in self.workspace.decisions()]
            by = {frozenset((p["class_a"], p["class_b"])): p for p in pairs}
            kept = verdict.rewrite_pairs([(p["class_a"], p["class_b"]) for p in pairs], class_a, class_b, done)
            self.workspace.save_candidates(changed, [by.get(frozenset(k), {"verdict": verdict.OVERLAP, "keep": k[0], "reason": "after a merge"}) | {"class_a": k[0], "class_b": k[1]} for k in kept])
        return rev

    # Acceptance

    def run_questions(self, pack: list[dict] | None = None) -> list[Outcome]:
        return run_pack(self.engine(), pack if pack is not None else self.workspace.questions())
