"""One object that answers requests against a published model."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.actions import Batch, bind_action, waves
from tessera.operators.classframe import Binding
from tessera.plans.leftout import left_out
from tessera.plans.model import Model, Source
from tessera.plans.query import MOST_ROWS, Result, run_query
from tessera.plans.shared import store
from tessera.plans.validate import check_model
from tessera.sources.catalog import Sources, frames


class Engine:
    """``model``: a mapping, a text or a parsed model. ``clock``: the current UTC second."""

    def __init__(self, spark: SparkSession, model: Model | dict | str, *, sources: Sources | None = None, clock: Callable[[], int] | None = None) -> None:
        self.spark, self.sources = spark, sources or Sources(spark)
        self.clock = clock or (lambda: int(time.time()))
        self.publish(model)

    def publish(self, model: Model | dict | str) -> None:
        self.model = model if isinstance(model, Model) else Model.parse(model)
        check_model(self.model)

    def table(self, source: Source) -> DataFrame:
        return self.sources.table(source.connection, source.table)

    def binding(self) -> Binding:
        return Binding(self.spark, self.model, self.table, self.clock)

    def query(self, request: dict, *, most: int | None = MOST_ROWS) -> Result:
        return run_query(self.binding(), request, most=most)

    def rows(self, request: dict) -> DataFrame:
        """All rows of a request, without the limit of the request interface."""
        return self.query(request, most=None).df

    def related(self, request: dict) -> DataFrame:
        """All rows of a request with its chain of relations joined, one row for each related individual, as structs."""
        return run_query(self.binding(), request, most=None, flat=True).df

    def left_out(self, request: dict) -> DataFrame:
        """What the class or the aggregate of a request leaves out: object, source, reason, n."""
        return left_out(self.binding(), request)

    def plan_actions(self, cls: str, action: str, requests: DataFrame) -> Batch:
        """Checks and plans a batch of requests; changes nothing."""
        return bind_action(self.binding(), cls, action, requests)

    def run_actions(self, cls: str, action: str, requests: DataFrame) -> tuple[Engine, list[Batch]]:
        """Plans and applies a batch, in waves where an identity repeats; an engine over the changed tables, and the batches.

        What a wave changes is stored before the next is planned, so the plans of all waves are alike. Many requests on one
        identity take as many waves, since each depends on the one before.
        """
        ordered, engine, done = store(waves(requests)), self, []
        last = ordered.agg({"wave": "max"}).first()[0] or 0
        for n in range(1, last + 1):
            batch = engine.plan_actions(cls, action, ordered.where(ordered.wave == n).drop("wave"))
            done.append(batch)
            changed = batch.apply()
            engine = engine.with_tables(changed if last == 1 else {at: store(df) for at, df in changed.items()})
        return engine, done

    def with_tables(self, tables: dict[tuple[str, str], DataFrame]) -> Engine:
        """The same model over other tables."""
        sources = Sources(self.spark)
        for name, held in self.sources.connections.items():
            mine = {t: df for (c, t), df in tables.items() if c == name}
            if not mine:
                sources.register(name, held)
                continue
            changed = frames(mine)
            sources.register(name, type(held)(lambda t, held=held, mine=mine, changed=changed: changed.read(t) if t in mine else held.read(t), held.names, held.comments, held.unique, held.primary))
        return Engine(self.spark, self.model, sources=sources, clock=self.clock)

    @staticmethod
    def ledger(batches: list[Batch]) -> DataFrame:
        return reduce(DataFrame.unionByName, [b.ledger() for b in batches])
