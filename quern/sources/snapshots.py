"""Versioned tables: a snapshot is a list of immutable Parquet files and the columns they are read by.

A change adds files, or puts new ones in the place of those it hits; the others are shared with the snapshot
before. Files name columns by numbers that never change, so renaming and dropping a column write nothing, and AS OF
reads an old snapshot by the names and types of its time. Transactions are a stack of tables: a rollback puts back
what was there.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class ColumnDef:
    name: str
    type: str
    not_null: bool = False
    primary: bool = False
    unique: bool = False
    auto: bool = False
    default: str | None = None
    check: str | None = None
    references: tuple[str, str, str, str] | None = None  # table, column, what a delete does, what an update does
    id: int = 0


@dataclass
class Snapshot:
    transaction: int
    time: datetime
    files: list[str]
    columns: list[tuple[int, str, str]]  # number, name, type


@dataclass
class Table:
    name: str
    columns: list[ColumnDef]
    keys: list[tuple[str, ...]] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)
    snapshots: list[Snapshot] = field(default_factory=list)
    indexes: dict[str, tuple[tuple[str, ...], bool, str]] = field(default_factory=dict)
    folder: str = field(default_factory=lambda: uuid.uuid4().hex[:12])
    numbered: int = 0
    #: The largest number that AUTO_INCREMENT has given or met.
    counter: int = 0

    def __post_init__(self):
        for c in self.columns:
            if not c.id:
                self.number(c)

    def number(self, c: ColumnDef) -> ColumnDef:
        self.numbered += 1
        c.id = self.numbered
        return c

    @property
    def files(self) -> list[str]:
        return self.snapshots[-1].files if self.snapshots else []

    def unique_keys(self) -> list[tuple[str, ...]]:
        single = [(c.name,) for c in self.columns if c.primary or c.unique]
        return [*self.keys, *single, *(k for k, unique, _ in self.indexes.values() if unique)]

    def copy(self) -> Table:
        return replace(self, columns=[replace(c) for c in self.columns], keys=list(self.keys), checks=list(self.checks), snapshots=list(self.snapshots), indexes=dict(self.indexes))


class Store:
    """The files and snapshots of all tables under one folder of the warehouse."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/quern-{uuid.uuid4().hex[:8]}"
        self.tables: dict[str, Table] = {}
        self.transaction = 0

    def stage(self, table: Table, rows: DataFrame, *extra: str) -> tuple[DataFrame, list[str]]:
        """(rows as written, their files): the table's columns cast to their types, and `extra` columns, which no reader of the table sees."""
        path = f"{self.folder}/{table.folder}/{uuid.uuid4().hex[:12]}"
        kinds = {f.name: f.dataType for f in rows.schema}
        rows.select(*[F.col(f"`{c.name}`").cast(c.type).alias(f"c{c.id}") for c in table.columns], *[F.col(f"`{x}`") for x in extra]).write.parquet(path)
        schema = T.StructType([*T._parse_datatype_string(", ".join(f"c{c.id} {c.type}" for c in table.columns)), *[T.StructField(x, kinds[x]) for x in extra]])
        written = self.spark.read.schema(schema).parquet(path)
        return written.select(*[F.col(f"c{c.id}").alias(c.name) for c in table.columns], *extra), list(written.inputFiles())

    def commit(self, table: Table, files: list[str]) -> None:
        self.transaction += 1
        columns = [(c.id, c.name, c.type) for c in table.columns]
        table.snapshots.append(Snapshot(self.transaction, datetime.now(timezone.utc).replace(tzinfo=None), files, columns))

    def read(self, table: Table, as_of: tuple[str, str] | None = None, files: list[str] | None = None, places: bool = False) -> DataFrame:
        """The rows of a snapshot, or of some files of the newest; with `places`, also _file and _row."""
        found = table.snapshots
        if as_of:
            kind, value = as_of
            if kind == "TRANSACTION":
                found = [s for s in found if s.transaction <= int(value)]
            else:
                when = datetime.fromisoformat(value)
                found = [s for s in found if s.time <= when]
        columns = found[-1].columns if as_of and found else [(c.id, c.name, c.type) for c in table.columns]
        files = (found[-1].files if found else []) if files is None else files
        if not files:
            place = ", _file string, _row bigint" if places else ""
            return self.spark.createDataFrame([], ", ".join(f"`{n}` {t}" for _, n, t in columns) + place)
        df = self.spark.read.schema(", ".join(f"c{i} {t}" for i, _, t in columns)).parquet(*files)
        more = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")] if places else []
        return df.select(*[F.col(f"c{i}").alias(n) for i, n, _ in columns], *more)

    def others(self, table: Table, files) -> list[str]:
        """The table's files but these, however their names are written."""
        plain = lambda f: f.partition(":")[2].lstrip("/") if ":" in f else f.lstrip("/")
        gone = {plain(f) for f in files}
        return [f for f in table.files if plain(f) not in gone]

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(sc._jvm.java.net.URI(path))
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)

    def discard(self, files: list[str]) -> None:
        for f in files:
            self._delete(f)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the files that only snapshots but the newest of each table read; how many snapshots went."""
        gone = 0
        for table in self.tables.values():
            old, table.snapshots = table.snapshots[:-keep], table.snapshots[-keep:]
            held = {f for s in table.snapshots for f in s.files}
            self.discard(sorted({f for s in old for f in s.files} - held))
            gone += len(old)
        return gone

    # whole stores

    def save(self, path: str, views: dict[str, str]) -> None:
        """All tables as they are, and the views' texts, as Parquet and one manifest row in a folder."""
        tables = []
        for t in self.tables.values():
            self.read(t).select(*[F.col(f"`{c.name}`").alias(f"c{c.id}") for c in t.columns]).write.parquet(f"{path}/{t.folder}")
            tables.append({k: v for k, v in asdict(t).items() if k != "snapshots"})
        self.spark.createDataFrame([(json.dumps({"tables": tables, "views": views}),)], "manifest string").coalesce(1).write.parquet(f"{path}/manifest")

    def restore(self, path: str) -> dict[str, str]:
        """The tables that `save` wrote there, in the place of all; gives the views."""
        kept = json.loads(self.spark.read.parquet(f"{path}/manifest").first()[0])
        tables = {}
        for d in kept["tables"]:
            columns = [ColumnDef(**{**c, "references": tuple(c["references"]) if c["references"] else None}) for c in d["columns"]]
            indexes = {k: (tuple(a), u, kind) for k, (a, u, kind) in d["indexes"].items()}
            t = Table(d["name"], columns, [tuple(k) for k in d["keys"]], d["checks"], [], indexes, uuid.uuid4().hex[:12], d["numbered"], d["counter"])
            rows = self.spark.read.schema(", ".join(f"c{c.id} {c.type}" for c in columns)).parquet(f"{path}/{d['folder']}")
            _, files = self.stage(t, rows.toDF(*[c.name for c in columns]))
            self.commit(t, files)
            tables[t.name] = t
        self.tables = tables
        return kept["views"]
