"""Actions from a stream of requests: each micro-batch is planned and applied as one batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from tessera.operators.actions import Batch
from tessera.plans.engine import Engine


def act_on(stream: DataFrame, engine: Callable[[], Engine], cls: str, action: str, done: Callable[[list[Batch], Engine, int], None]) -> DataStreamWriter:
    """``done`` gets the batches, the engine over the changed tables and the number of the micro-batch; it stores what it
    wants to keep. A repeated micro-batch has the same number, so storing by it makes the effects exactly-once."""

    def run(requests: DataFrame, number: int) -> None:
        after, batches = engine().run_actions(cls, action, requests)
        done(batches, after, number)

    return stream.writeStream.foreachBatch(run)
