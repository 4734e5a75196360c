"""What changed between full snapshots.

Both sides of every comparison are united, tagged by side, and grouped by record key; per-side content hashes classify
a record in that one aggregation. A snapshot's rows are a side twice: the new side of the comparison with the snapshot
before, the old side of the one with the snapshot after. Snapshots are numbered per scope with holes in the numbers, so
each one's neighbours are found first, among (scope, number) pairs alone and in blocks of numbers, so that a scope with
very many snapshots needs no single task.

Defined results: the first snapshot of a scope gives nothing; a snapshot without records is one (all records removed,
then added); repeated deliveries of a snapshot count once, and if they disagree the largest hash of a record counts; rows
with a null scope or number are no snapshots; other columns are ignored.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.yamltext import Unreadable, content_hash, load
from tessera.plans.shared import store

#: Snapshot numbers in a block, as a power of two.
BLOCK_BITS = 10


def neighbours(numbers: DataFrame, scope: list[str], number: str) -> DataFrame:
    """Each distinct (scope, number) with the next lower and next higher number present: before, after."""
    own = numbers.select(*scope, number).distinct().withColumn("__block", F.shiftright(F.col(number).cast("long"), BLOCK_BITS))
    inside = Window.partitionBy(*scope, "__block").orderBy(number)
    own = own.withColumns({"before": F.lag(number).over(inside), "after": F.lead(number).over(inside)})
    across = Window.partitionBy(*scope).orderBy("__block")
    blocks = own.groupBy(*scope, "__block").agg(F.min(number).alias("__first"), F.max(number).alias("__last"))
    blocks = blocks.withColumns({"__before": F.lag("__last").over(across), "__after": F.lead("__first").over(across)}).drop("__first", "__last")
    found = own.join(blocks, [*scope, "__block"])
    return found.select(*scope, number, F.coalesce("before", "__before").alias("before"), F.coalesce("after", "__after").alias("after"))


def snapshot_changes(rows: DataFrame, scope: list[str], number: str, record: str, content: str) -> DataFrame:
    """scope, number, record, change for each record that differs from the snapshot before.

    ``rows``: one row per record of a snapshot; a row with a null record only says that the snapshot exists.
    """
    rows = rows.select(*scope, number, record, content)
    for c in (*scope, number):
        rows = rows.where(F.col(c).isNotNull())
    sides = rows.where(F.col(record).isNotNull()).join(neighbours(rows, scope, number), [*scope, number])
    tagged = F.filter(
        F.array(
            F.struct(F.when(F.col("before").isNotNull(), F.col(number)).alias("at"), F.col(content).alias("new"), F.lit(None).cast("binary").alias("old")),
            F.struct(F.col("after").alias("at"), F.lit(None).cast("binary").alias("new"), F.col(content).alias("old")),
        ),
        lambda side: side["at"].isNotNull(),
    )
    united = sides.select(*scope, record, F.inline(tagged))
    pairs = united.groupBy(*scope, "at", record).agg(F.max("new").alias("new"), F.max("old").alias("old"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("new") != F.col("old"), "changed")
    return pairs.select(*scope, F.col("at").alias(number), record, change.alias("change")).where(F.col("change").isNotNull())


#: The parts of a model whose entries are records.
SECTIONS = ("object_types", "link_types")
RECORDS = pa.schema([("workspace_id", pa.int32()), ("version", pa.int32()), ("record", pa.string()), ("content", pa.binary()), ("fault", pa.string())])
#: What is done about versions whose text cannot be read.
FAIL, WARN = "fail", "warn"


def read_model(text: str | None, canvas: str | None) -> dict | None:
    """The model of a row: its text or, if that is blank, the config within the canvas. None: neither holds one.

    A text that is not blank and holds no model is :class:`Unreadable`; nothing takes its place.
    """
    if text and text.strip():
        model = load(text)
        if not isinstance(model, dict):
            raise Unreadable("the text is no mapping")
        return model
    if canvas and canvas.strip():
        try:
            model = json.loads(canvas).get("config")
        except (ValueError, AttributeError, RecursionError):
            model = None
        if isinstance(model, dict):
            return model
    return None


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for workspace, version, text, canvas in zip(*(c.to_pylist() for c in batch.columns)):
            try:
                model = read_model(text, canvas)
            except Unreadable as e:
                out.append((workspace, version, None, None, str(e)))
                continue
            if model is None:
                continue
            out.append((workspace, version, None, None, None))
            for section in SECTIONS:
                entries = model.get(section)
                if isinstance(entries, dict):
                    out += ((workspace, version, f"{section}.{name}", content_hash(value), None) for name, value in entries.items())
        columns = zip(*out) if out else [[] for _ in RECORDS]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RECORDS)], schema=RECORDS)


def model_records(versions: DataFrame) -> DataFrame:
    """workspace_id, version, record, content (hash), fault of each published row.

    A row without a text and a config is no snapshot; one whose text cannot be read has one row, with the reason as fault.
    """
    rows = versions.where(F.col("version").isNotNull() & F.col("workspace_id").isNotNull())
    return rows.select("workspace_id", "version", "yaml", "canvas_json").mapInArrow(_records, "workspace_id int, version int, record string, content binary, fault string")


def model_changes(versions: DataFrame, *, unreadable: str = FAIL) -> DataFrame:
    """workspace_id, version, record, change. The texts are read once; what they hold is kept in the shared folder.

    Versions with an unreadable text end the job with their number and the first of them; with ``unreadable`` WARN they
    are left out, as a warning says, and the versions around them are compared.
    """
    records = store(model_records(versions))
    faulty = records.where(F.col("fault").isNotNull())
    if first := faulty.select("workspace_id", "version", "fault").orderBy("workspace_id", "version", "fault").limit(5).collect():
        told = f"{faulty.count()} model texts cannot be read: " + "; ".join(f"workspace {w}, version {v}: {why}" for w, v, why in first)
        if unreadable != WARN:
            raise Unreadable(told)
        warnings.warn(told, stacklevel=2)
    return snapshot_changes(records.where(F.col("fault").isNull()), ["workspace_id"], "version", "record", "content")
