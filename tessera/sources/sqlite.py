"""SQLite files as a Spark data source, for reading and for writing change sets back.

``spark.read.format("sqlite_file").options(path=..., table=...)`` reads a table in parallel by ranges of its row ids,
each of as many rows however far apart the ids lie; a table without row ids is read as one. Comparisons of columns with constants are pushed into the statement each task runs. The file must be where the
executors can read it. Writing goes through :func:`write_back`, one statement per change, since a file has one writer.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

from tessera.operators.actions import Batch
from tessera.plans.errors import SourceFault
from tessera.sources.catalog import Connection

#: Rows of a partition, and partitions at most.
PARTITION_ROWS, MOST_PARTITIONS = 500_000, 1_000
CONDITIONS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True, timeout=10)


def spark_type(declared: str) -> T.DataType:
    """The column type of a declared one, by the affinity rules of the format."""
    d = declared.upper()
    if "BOOL" in d:
        return T.BooleanType()
    if "INT" in d:
        return T.LongType()
    if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")):
        return T.DoubleType()
    return T.BinaryType() if "BLOB" in d else T.StringType()


def table_schema(path: str, table: str) -> T.StructType:
    with _open(path) as c:
        columns = c.execute(f"pragma table_info({quoted(table)})").fetchall()
    if not columns:
        raise SourceFault(f"{path} has no table {table!r}")
    return T.StructType([T.StructField(name, spark_type(kind)) for _, name, kind, *_ in columns])


def condition(f: Filter) -> tuple[str, list] | None:
    """A pushed filter as SQL with its parameters; None: Spark keeps it."""
    if len(getattr(f, "attribute", ())) != 1:
        return None
    name = quoted(f.attribute[0])
    if isinstance(f, IsNull):
        return f"{name} is null", []
    if isinstance(f, IsNotNull):
        return f"{name} is not null", []
    if isinstance(f, In) and all(isinstance(v, (int, float, str)) for v in f.value):
        return f"{name} in ({', '.join('?' * len(f.value))})", list(f.value)
    if type(f) in CONDITIONS and isinstance(f.value, (int, float, str)):
        return f"{name} {CONDITIONS[type(f)]} ?", [int(f.value) if isinstance(f.value, bool) else f.value]
    return None


@dataclass
class Range(InputPartition):
    """Row ids from ``lo`` to ``hi``; None: all rows, whatever tells them apart."""

    lo: int | None
    hi: int | None


class Reader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: T.StructType, rows: int) -> None:
        self.path, self.table, self.columns, self.rows = path, table, schema, rows
        self.where: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            found = condition(f)
            # A text compared with a number is left to Spark: the file would convert one to the other.
            if found is None or not self._same_kind(f):
                yield f
            else:
                self.where.append(found)

    def _same_kind(self, f: Filter) -> bool:
        kind = self.columns[f.attribute[0]].dataType
        values = list(f.value) if isinstance(f, In) else [f.value] if hasattr(f, "value") else []
        return all(isinstance(v, str) == isinstance(kind, T.StringType) for v in values)

    def partitions(self) -> list[InputPartition]:
        with _open(self.path) as c:
            try:
                last, n = c.execute(f"select max(rowid), count(*) from {quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:
                return [Range(None, None)]  # there are no row ids
            of = max(self.rows, -(-n // MOST_PARTITIONS))
            # Every so many rows, however their ids are spread.
            first = [r[0] for r in c.execute(f"select id from (select rowid as id, row_number() over (order by rowid) as nth from {quoted(self.table)}) where nth % ? = 1 % ? order by id", [of, of])]
        return [Range(a, b - 1) for a, b in zip(first, [*first[1:], last + 1])] if n else [Range(0, -1)]

    def read(self, partition: Range) -> Iterator[tuple]:
        kinds = [f.dataType for f in self.columns]
        tests, values = [w for w, _ in self.where], [v for _, vs in self.where for v in vs]
        if partition.lo is not None:
            tests, values = ["rowid between ? and ?", *tests], [partition.lo, partition.hi, *values]
        where = f" where {' and '.join(tests)}" if tests else ""
        with _open(self.path) as c:
            for row in c.execute(f"select {', '.join(quoted(f.name) for f in self.columns)} from {quoted(self.table)}{where}", values):
                yield tuple(_value(v, k) for v, k in zip(row, kinds))


def _value(v, kind: T.DataType):
    """A stored value as its column's type; what does not fit is null, as the format lets any column hold anything."""
    if v is None:
        return None
    if isinstance(kind, T.StringType):
        return v if isinstance(v, str) else v.decode(errors="replace") if isinstance(v, bytes) else str(v)
    if isinstance(kind, T.BinaryType):
        return v if isinstance(v, bytes) else str(v).encode()
    if isinstance(v, (int, float)):
        return bool(v) if isinstance(kind, T.BooleanType) else int(v) if isinstance(kind, T.LongType) and v == int(v) else float(v) if isinstance(kind, T.DoubleType) else None
    return None


class SqliteFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_file"

    def schema(self) -> T.StructType:
        return table_schema(self.options["path"], self.options["table"])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return Reader(self.options["path"], self.options["table"], schema, int(self.options.get("partitionRows", PARTITION_ROWS)))


def sqlite(spark: SparkSession, path: str, *, partition_rows: int = PARTITION_ROWS) -> Connection:
    """A connection to a file: its tables, primary keys and columns that are unique by themselves."""
    spark.dataSource.register(SqliteFile)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

    def names() -> list[str]:
        with _open(path) as c:
            return [r[0] for r in c.execute("select name from sqlite_master where type = 'table' and name not like 'sqlite_%' order by name")]

    def read(table: str):
        return spark.read.format("sqlite_file").options(path=path, table=table, partitionRows=str(partition_rows)).load()

    if not Path(path).exists():
        raise SourceFault(f"there is no file {path}")
    unique, primary = {}, {}
    with _open(path) as c:
        for t in names():
            keys = [r[1] for r in c.execute(f"pragma table_info({quoted(t)})") if r[5]]
            if len(keys) == 1:
                primary[t] = keys[0]
            for _, index, is_unique, _, partial in c.execute(f"pragma index_list({quoted(t)})").fetchall():
                columns = [r[2] for r in c.execute(f"pragma index_info({quoted(index)})")]
                if is_unique and not partial and len(columns) == 1:
                    unique.setdefault(t, set()).add(columns[0])
    return Connection(read, names, {}, unique, primary)


def write_back(batch: Batch, paths: dict[str, str]) -> list[dict]:
    """Writes a batch's change sets into files, by connection name; one record per write: source, table, op, key, outcome.

    Updates name the key and the values they were planned on, so a row changed meanwhile is a ``conflict`` unless it has
    the new values ``already``. Inserts skip keys that exist. Changes stream through the driver; writes that succeeded stay.
    """
    done = []
    for c in batch.changes:
        if c.source.connection not in paths:
            raise SourceFault(f"nothing says where {c.source.connection!r} is")
        table, key = quoted(c.source.table), quoted(c.key_column)
        new, old = [f"new_{i}" for i in range(len(c.columns))], [f"old_{i}" for i in range(len(c.columns))]
        columns = [quoted(x) for x in c.columns]
        with sqlite3.connect(paths[c.source.connection], timeout=10) as db:
            for r in c.rows.orderBy("request_id").toLocalIterator():
                if c.op == "delete":
                    hit = db.execute(f"delete from {table} where {key} = ?", [r["key"]]).rowcount
                    outcome = "applied" if hit else "conflict"
                elif c.op == "insert":
                    there = r["key"] is not None and db.execute(f"select 1 from {table} where {key} = ?", [r["key"]]).fetchone()
                    if not there:
                        db.execute(f"insert into {table} ({', '.join(columns)}) values ({', '.join('?' * len(columns))})", [r[n] for n in new])
                    outcome = "already" if there else "applied"
                else:
                    hit = db.execute(f"update {table} set {', '.join(f'{x} = ?' for x in columns)} where {key} = ? and {' and '.join(f'{x} is ?' for x in columns)}", [*(r[n] for n in new), r["key"], *(r[o] for o in old)]).rowcount
                    same = not hit and db.execute(f"select 1 from {table} where {key} = ? and {' and '.join(f'{x} is ?' for x in columns)}", [r["key"], *(r[n] for n in new)]).fetchone()
                    outcome = "applied" if hit else "already" if same else "conflict"
                done.append({"request_id": r["request_id"], "source": c.source.name, "table": c.source.table, "op": c.op, "key": r["key"], "outcome": outcome})
        db.close()
    return done
