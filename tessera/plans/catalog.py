"""Versions, drafts and records of a workspace, kept as small files so that any driver sees the same state.

Published versions are numbered and never change. The one draft has a revision; whoever edits it names the revision they
read, and a stale one is rejected. Records (decisions, overlaps, queries, actions) are appended as JSON lines and hold
no business values.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from tessera.plans.editing import difference, edit, gate
from tessera.plans.errors import Rejected, StaleRevision
from tessera.plans.model import Model, structural_hash


#: Seconds after which a lock counts as left behind; writes under it take milliseconds.
LOCK_S = 60


class Workspace:
    def __init__(self, folder: str | Path, name: str = "main", *, now: Callable[[], float] = time.time) -> None:
        self.at, self.now = Path(folder) / name, now
        self.at.mkdir(parents=True, exist_ok=True)

    # Files

    def _read(self, name: str):
        try:
            return json.loads((self.at / name).read_text())
        except FileNotFoundError:
            return None

    def _write(self, name: str, value) -> None:
        part = self.at / f"{name}.{uuid.uuid4().hex}"
        part.write_text(json.dumps(value, ensure_ascii=False))
        part.replace(self.at / name)

    @contextmanager
    def _locked(self) -> Iterator[None]:
        lock, until = self.at / "lock", time.monotonic() + 10
        while True:
            try:
                os.close(os.open(lock, os.O_CREAT | os.O_EXCL))
                break
            except FileExistsError:
                try:
                    if time.time() - lock.stat().st_mtime > LOCK_S:
                        lock.unlink(missing_ok=True)  # whoever held it is gone
                        continue
                except FileNotFoundError:
                    continue
                if time.monotonic() > until:
                    raise StaleRevision("the workspace is locked") from None
                time.sleep(0.01)
        try:
            yield
        finally:
            lock.unlink(missing_ok=True)

    def _append(self, kind: str, record: dict) -> None:
        with (self.at / f"{kind}.jsonl").open("a") as f:
            f.write(json.dumps(record | {"at": self.now()}, ensure_ascii=False, default=str) + "\n")

    def records(self, kind: str) -> list[dict]:
        try:
            return [json.loads(line) for line in (self.at / f"{kind}.jsonl").read_text().splitlines()]
        except FileNotFoundError:
            return []

    # Versions

    def versions(self) -> list[int]:
        return sorted(int(p.stem[1:]) for p in self.at.glob("v*.json"))

    def published(self, version: int | None = None) -> Model:
        numbers = self.versions()
        if not numbers or (version is not None and version not in numbers):
            raise Rejected("nothing is published" if not numbers else f"there is no version {version}")
        return Model.parse(self._read(f"v{version or numbers[-1]}.json")["model"])

    def draft(self) -> tuple[Model, int]:
        """The draft and its revision; without one, the published model as revision 0."""
        held = self._read("draft.json")
        if held:
            return Model.parse(held["model"]), held["rev"]
        return (self.published(), 0) if self.versions() else (Model.parse({"object_types": {}, "link_types": {}}), 0)

    def _save(self, model: Model, rev: int) -> int:
        with self._locked():
            held = self._read("draft.json")
            if (held["rev"] if held else 0) != rev:
                raise StaleRevision(f"the draft is at revision {held['rev'] if held else 0}, not {rev}")
            self._write("draft.json", {"rev": rev + 1, "model": model.raw})
        return rev + 1

    def edit(self, op: dict, rev: int | None = None) -> int:
        """Carries out one edit; the new revision. A rejected edit leaves the draft as it was."""
        model, current = self.draft()
        return self._save(edit(model, op), current if rev is None else rev)

    def replace(self, model: Model, rev: int | None = None) -> int:
        return self._save(model, self.draft()[1] if rev is None else rev)

    def publish(self, note: str = "") -> int:
        model, rev = self.draft()
        gate(model)
        with self._locked():
            version = (self.versions() or [0])[-1] + 1
            self._write(f"v{version}.json", {"model": model.raw, "note": note, "at": self.now()})
            held = self._read("draft.json")
            if held and held["rev"] == rev:
                (self.at / "draft.json").unlink()
        for d in self.open_decisions():
            self._append("decisions", d | {"version": version})
        return version

    def discard(self) -> None:
        (self.at / "draft.json").unlink(missing_ok=True)
        for d in self.open_decisions():
            self._append("decisions", d | {"discarded": True})

    def rollback(self, version: int) -> int:
        """Publishes an earlier version again, under a new number."""
        model = self.published(version)
        with self._locked():
            number = self.versions()[-1] + 1
            self._write(f"v{number}.json", {"model": model.raw, "note": f"back to {version}", "at": self.now()})
        return number

    def state(self) -> dict:
        """Where the draft stands, for a client that watches it."""
        model, rev = self.draft()
        published = self.published() if self.versions() else None
        changes = difference(published, model) if published else []
        return {"rev": rev, "etag": structural_hash([rev, model.raw]), "version": (self.versions() or [None])[-1], "changes": changes, "dirty": bool(changes)}

    # Records

    def decide(self, class_a: str, class_b: str, verdict: str, **evidence) -> None:
        self._append("decisions", {"id": uuid.uuid4().hex, "class_a": class_a, "class_b": class_b, "verdict": verdict, **evidence})

    def decisions(self) -> list[dict]:
        """The latest record of each decision that was not discarded."""
        latest = {}
        for d in self.records("decisions"):
            latest[d["id"]] = d
        return [d for d in latest.values() if not d.get("discarded")]

    def open_decisions(self) -> list[dict]:
        return [{k: v for k, v in d.items() if k != "at"} for d in self.decisions() if "version" not in d]

    def save_overlap(self, row: dict) -> None:
        """One row per pair, the latest; counts and rates only."""
        kept = ("class_a", "class_b", "norm_rule", "count_a", "count_b", "count_hit", "rate")
        with self._locked():
            held = self._read("overlaps.json") or {}
            held["|".join(sorted((row["class_a"], row["class_b"])))] = {k: row[k] for k in kept}
            self._write("overlaps.json", held)

    def overlaps(self) -> list[dict]:
        return list((self._read("overlaps.json") or {}).values())

    def save_candidates(self, model: Model, pairs: list[dict]) -> None:
        self._write("candidates.json", {"classes": {c: structural_hash(model.raw["object_types"][c]) for c in model.object_types}, "pairs": pairs})

    def candidates(self, model: Model) -> tuple[list[dict], set[str]]:
        """The recorded pairs that are still open, and the classes that changed since."""
        held = self._read("candidates.json") or {"classes": {}, "pairs": []}
        changed = {c for c in model.object_types if held["classes"].get(c) != structural_hash(model.raw["object_types"][c])}
        decided = {frozenset((d["class_a"], d["class_b"])) for d in self.decisions()}
        return [p for p in held["pairs"] if {p["class_a"], p["class_b"]} <= set(model.object_types) and frozenset((p["class_a"], p["class_b"])) not in decided], changed

    def log(self, kind: str, request: dict, ok: bool, rows: int | None, seconds: float, error: str | None = None) -> None:
        self._append(f"log_{kind}", {"version": (self.versions() or [None])[-1], "request": request, "ok": ok, "rows": rows, "seconds": round(seconds, 6), "error": error})

    def save_questions(self, questions: list[dict]) -> None:
        self._write("questions.json", questions)

    def questions(self) -> list[dict]:
        return self._read("questions.json") or []


def workspaces(folder: str | Path) -> list[str]:
    return sorted(p.name for p in Path(folder).iterdir() if p.is_dir()) if Path(folder).exists() else []
