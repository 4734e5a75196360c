"""What a class or an aggregate leaves out, counted on request: rows without a key, rows of a repeated key, values that are
no numbers. A query itself never counts them, so its filters stay where the sources can use them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.classframe import Binding, ClassFrame, not_blank
from tessera.plans.errors import Rejected
from tessera.plans.model import ObjectType, Source

BLANK, REPEATED, NO_NUMBER = "blank key", "repeated key", "no number"
SCHEMA = "object string, source string, reason string, n long"


def _rows(binding: Binding, cls: ObjectType, s: Source) -> list[DataFrame]:
    table = binding.table(s)
    column = s.fields[cls.key_of(s)]
    own = F.col(f"`{column}`")
    named = not_blank(own) if isinstance(table.schema[column].dataType, T.StringType) else own.isNotNull()
    parts = [(BLANK, table.agg(F.count(F.when(~named, 1)).alias("n")))]
    if not s.unique:
        # Counted per key first, so that no key's rows meet in one place.
        parts.append((REPEATED, table.where(named).groupBy(own).agg((F.count(F.lit(1)) - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).alias("n"))))
    return [df.select(F.lit(cls.name).alias("object"), F.lit(s.name).alias("source"), F.lit(reason).alias("reason"), F.col("n").cast("long").alias("n")) for reason, df in parts]


def left_out(binding: Binding, request: dict) -> DataFrame:
    """object, source, reason, n of a request's class; for aggregates also values of each property that are no numbers."""
    if request.get("object") not in binding.model.object_types:
        raise Rejected(f"there is no class {request.get('object')!r}")
    cls = binding.model.object(request["object"])
    parts = [] if cls.rows_only else [df for s in cls.sources.values() for df in _rows(binding, cls, s)]
    for of in sorted({of for m in (request.get("aggregate") or {}).get("metrics") or () for op, of in m.items() if op != "count" and of != "*"}):
        frame = ClassFrame(binding, cls.name)
        frame.where(request.get("filter") or {})
        value, defined = frame.value(of)
        if value.kind != "number":
            n = frame.df.agg(F.count(F.when(defined & value.column.isNotNull(), 1)).alias("n"))
            parts.append(n.select(F.lit(cls.name).alias("object"), F.lit(of).alias("source"), F.lit(NO_NUMBER).alias("reason"), "n"))
    return reduce(DataFrame.unionByName, parts) if parts else binding.spark.createDataFrame([], SCHEMA)
