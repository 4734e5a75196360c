"""Where tables come from: named connections that hand out DataFrames.

Reading is lazy; Catalyst prunes columns and pushes filters into whatever is behind a connection. A table that cannot be
found or read is a :class:`SourceFault`, never a rejection of the request.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from hashlib import blake2b
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.masking import mask
from tessera.plans.errors import Rejected, SourceFault

SAMPLE_ROWS = 3


@dataclass
class Connection:
    """Tables by name. ``read`` gives the DataFrame of a table; ``names`` lists the tables."""

    read: Callable[[str], DataFrame]
    names: Callable[[], list[str]]
    comments: dict = field(default_factory=dict)
    #: Statistics of unique columns by table, where the source declares them.
    unique: dict[str, set[str]] = field(default_factory=dict)
    primary: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class ColumnInfo:
    """``unique``: a declared unique column; ``pk``: the primary key; ``integer``: a whole number, as row numbers are."""

    name: str
    type: str
    comment: str | None
    unique: bool
    pk: bool
    integer: bool = False


@dataclass(frozen=True)
class TableInfo:
    connection: str
    table: str
    columns: tuple[ColumnInfo, ...] = ()
    error: str | None = None


def property_type(t: T.DataType) -> str:
    """The property type of a column type."""
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.TimestampType, T.DateType, T.TimestampNTZType)):
        return "date"
    return "boolean" if isinstance(t, T.BooleanType) else "string"


def files(spark: SparkSession, folder: str, format: str = "parquet", **options) -> Connection:
    """A folder with one file (or folder of files) per table: ``<table>.<format>``."""

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(conf)  # a local folder, an object store, whatever the address says

    def names() -> list[str]:
        found = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(n.removesuffix(f".{format}") for n in found if n.endswith(f".{format}"))

    def read(table: str) -> DataFrame:
        return spark.read.format(format).options(**options).load(f"{folder}/{table}.{format}")

    side, text = jvm.org.apache.hadoop.fs.Path(at, "comments.json"), None
    if fs.exists(side):
        stream = fs.open(side)
        text = bytes(stream.readAllBytes())
        stream.close()
    return Connection(read, names, read_comments(text)[1])


def frames(tables: dict[str, DataFrame]) -> Connection:
    """DataFrames at hand, say temporary views or results of other queries."""

    def read(table: str) -> DataFrame:
        if table not in tables:
            raise SourceFault(f"there is no table {table!r}")
        return tables[table]

    return Connection(read, lambda: sorted(tables))


def jdbc(spark: SparkSession, url: str, tables: Iterable[str] | None = None, *, schema: str | None = None, timeout_s: int = 10, read_options: dict | None = None, **options) -> Connection:
    """Tables of a database, by the JDBC driver on the class path; filters, columns, limits, orders and aggregates are
    pushed down, in the database's own dialect.

    The database itself is asked for its tables, keys, unique columns and comments. ``options`` connect (``driver``, ``user``,
    ``password``); give ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` as ``read_options`` to read
    in parallel. Tables are read through a catalog of the session, since only those push aggregates. The driver and every
    executor connect for themselves, so ``url`` must mean the same database to all of them; one in memory is each process's own.
    """
    catalog = f"tessera_{blake2b(url.encode(), digest_size=8).hexdigest()}"
    settings = {"": "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog", ".url": url, ".queryTimeout": str(timeout_s), ".pushDownAggregate": "true", ".pushDownLimit": "true", ".pushDownOffset": "true"}
    for k, v in (settings | {f".{k}": v for k, v in options.items()}).items():
        spark.conf.set(f"spark.sql.catalog.{catalog}{k}", v)
    schemas, comments, unique, primary = described(spark, url, schema, **options)
    listed = sorted(tables) if tables is not None else sorted(schemas)

    def read(table: str) -> DataFrame:
        if table not in schemas:
            raise SourceFault(f"there is no table {table!r}")
        parts = [catalog, *([schemas[table]] if schemas[table] else []), table]
        return spark.read.options(**(read_options or {})).table(".".join(f"`{p}`" for p in parts))

    return Connection(read, lambda: listed, comments, unique, primary)


def described(spark: SparkSession, url: str, schema: str | None = None, **options) -> tuple[dict, dict, dict, dict]:
    """A database's tables with their schemas, comments by table and column, unique columns and primary keys of one column."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    properties = jvm.java.util.Properties()
    for k, v in options.items():
        if k in ("user", "password"):
            properties.setProperty(k, v)
    if "driver" in options:
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(options["driver"])
    held = jvm.java.sql.DriverManager.getConnection(url, properties)
    try:
        about = held.getMetaData()

        def rows(found, *columns: str) -> list[tuple]:
            out = []
            while found.next():
                out.append(tuple(found.getString(c) for c in columns))
            found.close()
            return out

        kinds = gateway.new_array(jvm.java.lang.String, 1)
        kinds[0] = "TABLE"
        schemas, comments, unique, primary = {}, {}, {}, {}
        for name, schema in rows(about.getTables(None, schema, "%", kinds), "TABLE_NAME", "TABLE_SCHEM"):
            schemas[name] = schema
            comments[name] = {c: r for c, r in rows(about.getColumns(None, schema, name, "%"), "COLUMN_NAME", "REMARKS") if r}
            keys = [c for (c,) in rows(about.getPrimaryKeys(None, schema, name), "COLUMN_NAME")]
            if len(keys) == 1:
                primary[name] = keys[0]
            indexes: dict[str, list[str]] = {}
            for index, column in rows(about.getIndexInfo(None, schema, name, True, True), "INDEX_NAME", "COLUMN_NAME"):
                if column:
                    indexes.setdefault(index, []).append(column)
            for columns in indexes.values():
                if len(columns) == 1:
                    unique.setdefault(name, set()).add(columns[0])
        return schemas, comments, unique, primary
    finally:
        held.close()


def read_comments(text: bytes | None) -> tuple[str, dict]:
    """Column comments beside a source: ``missing``, ``ok`` or ``corrupt``, and the comments."""
    if text is None:
        return "missing", {}
    try:
        found = json.loads(text)
        return ("ok", found) if isinstance(found, dict) else ("corrupt", {})
    except ValueError:
        return "corrupt", {}


class Sources:
    """Connections by name."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.connections = spark, {}

    def register(self, name: str, connection: Connection, *, test: bool = False) -> None:
        """Adds or replaces a connection; with ``test``, only if all its tables can be listed and their columns read."""
        if not re.fullmatch(r"[a-z][a-z0-9_]*", name):
            raise Rejected(f"{name!r} is no connection name")
        if test:
            try:
                for table in connection.names():
                    connection.read(table).schema  # noqa: B018
            except Exception as e:
                raise SourceFault(f"{name}: {e}") from e
        self.connections[name] = connection

    def drop(self, name: str, model=None) -> None:
        if model and any(s.connection == name for o in model.object_types.values() for s in o.sources.values()):
            raise Rejected(f"the published model reads from {name!r}")
        self.connections.pop(name, None)

    def _of(self, name: str) -> Connection:
        if name not in self.connections:
            raise Rejected(f"there is no connection {name!r}")
        return self.connections[name]

    def table(self, connection: str, table: str) -> DataFrame:
        try:
            return self._of(connection).read(table)
        except (Rejected, SourceFault):
            raise
        except Exception as e:
            raise SourceFault(f"{connection}.{table}: {e}") from e

    def select(self, connection: str, table: str, columns: list[str] | None = None, where=None, limit: int | None = None) -> DataFrame:
        df = self.table(connection, table)
        if where is not None:
            df = df.where(where)
        if columns:
            df = df.select(*columns)
        return df.limit(limit) if limit else df

    def select_aggregate(self, connection: str, table: str, group: list[str], metrics: dict, where=None) -> DataFrame:
        df = self.select(connection, table, where=where)
        found = [c.alias(n) for n, c in metrics.items()]
        return df.groupBy(*group).agg(*found) if group else df.agg(*found)

    def info(self, connection: str, table: str) -> TableInfo:
        held, df = self._of(connection), self.table(connection, table)
        unique, primary = held.unique.get(table, set()), held.primary.get(table)
        comments = held.comments.get(table) or {}
        return TableInfo(connection, table, tuple(
            ColumnInfo(f.name, property_type(f.dataType), comments.get(f.name) or f.metadata.get("comment"), f.name in unique, f.name == primary, isinstance(f.dataType, T.IntegralType))
            for f in df.schema
        ))

    def tables(self) -> list[TableInfo]:
        """All tables; a connection that fails has one entry with its error."""
        found = []
        for name, held in self.connections.items():
            try:
                found += [self.info(name, t) for t in held.names()]
            except Exception as e:
                found.append(TableInfo(name, "", error=str(e)))
        return found

    def locate(self, table: str) -> list[TableInfo]:
        return [t for t in self.tables() if t.table == table]

    def sample(self, connection: str, table: str, rows: int = SAMPLE_ROWS) -> DataFrame:
        """A few rows with sensitive columns masked."""
        df = self.table(connection, table).limit(rows)
        return df.select(*(mask(c, F.col(f"`{c}`")).alias(c) for c in df.columns))


def save_tables(tables: dict[tuple[str, str], DataFrame], folders: dict[str, str], format: str = "parquet") -> list[str]:
    """Writes changed tables (see ``Batch.apply``) back to their folders, by connection name; gives what was written.

    A table is written beside the old one and takes its place when it is whole, so a failed job leaves the old one, and a
    table can be computed from the one it replaces. Folders are reached through Hadoop's file system, whatever it is.
    """
    done = []
    for (connection, table), df in tables.items():
        if connection not in folders:
            raise SourceFault(f"nothing says where {connection!r} is")
        at = f"{folders[connection]}/{table}.{format}"
        df.write.format(format).mode("overwrite").save(f"{at}.next")
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        fs = path(at).getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
        fs.delete(path(f"{at}.last"), True)
        if fs.exists(path(at)):
            fs.rename(path(at), path(f"{at}.last"))
        fs.rename(path(f"{at}.next"), path(at))
        fs.delete(path(f"{at}.last"), True)
        done.append(at)
    return done


def discover(folder: str) -> list[tuple[str, str]]:
    """Database files in a folder that could be connected, with legal names for them."""
    found, taken = [], set()
    for p in sorted(Path(folder).glob("*.db")):
        name = re.sub(r"[^a-z0-9_]+", "_", p.stem.lower()).strip("_") or "source"
        name = name if name[0].isalpha() else f"s_{name}"
        while name in taken:
            name += "_2"
        taken.add(name)
        found.append((name, str(p)))
    return found
