"""The SQL engine: statements of the dialect over Spark tables and versioned tables.

    db = Engine(spark)
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT)")
    db.execute("INSERT INTO t VALUES (1, 'a'), ($1, $2)", [2, "b"])
    db.query("SELECT DISTINCT ON (name) * FROM t ORDER BY name, id DESC").show()

Queries are rewritten to Spark SQL and planned by Catalyst. Changes of a table are one new snapshot,
checked against its constraints before it is published; only files with rows that change are written anew.
"""

from __future__ import annotations

import re
import threading
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quern.plans.dialect import DialectError, Rewriter, Token, tokens
from quern.sources.copy import read_csv, read_json
from quern.sources.snapshots import ColumnDef, Store, Table

CASCADE_DEPTH = 16


class ConstraintError(ValueError):
    pass


class Engine:
    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.store = Store(spark, folder)
        #: Views by name: their query in the dialect, rewritten at each use.
        self.view_texts: dict[str, str] = {}
        self.settings: dict[str, str] = {}
        #: Functions of the caller, by upper-case name, from the arguments' SQL texts to SQL text.
        self.functions: dict = {}
        self._saved: list[tuple[str, dict[str, Table], dict[str, str]]] = []
        self._views = 0
        spark.conf.set("spark.sql.cteRecursionLevelLimit", "10000")

    # rewriting

    def _ask(self, sql: str):
        try:
            return self.spark.sql(sql).schema
        except AnalysisException:
            return None

    def _rewriter(self, sql, params=None) -> Rewriter:
        def kind_of(e, relation, with_):
            schema = self._ask(f"{with_}SELECT {e} AS x" + (f" FROM {relation}" if relation else ""))
            return schema[0].dataType.simpleString() if schema else None

        def columns_of(relation, with_):
            schema = self._ask(f"{with_}SELECT * FROM {relation}")
            return schema.names if schema else []

        return Rewriter(sql, params, kind_of, columns_of, self._table, self.functions)

    def _table(self, name: str, as_of) -> str:
        if as_of and as_of[0] == "CURRENT":
            return str(self.store.transaction)
        key = name.lower()
        if key in self.view_texts and not as_of:
            view = f"_quern_{key}_{id(self) & 0xFFFFFF:x}_v"
            self._sql(self.rewrite(self.view_texts[key])).createOrReplaceTempView(view)
            return view
        if key not in self.store.tables:
            if as_of:
                raise DialectError(f"{name} has no versions")
            return name
        view = f"_quern_{key}_{id(self) & 0xFFFFFF:x}" + (f"_{self._next()}" if as_of else "")
        self.store.read(self.store.tables[key], as_of).createOrReplaceTempView(view)
        return view

    def _next(self) -> int:
        self._views += 1
        return self._views

    def rewrite(self, sql: str, params=None) -> str:
        """The Spark SQL of a query."""
        r = self._rewriter(sql, params)
        out = r.query()
        r.done()
        return out

    def query(self, sql: str, params=None) -> DataFrame:
        return self.spark.sql(self.rewrite(sql, params))

    def query_one(self, sql: str, params=None):
        row = self.query(sql, params).head()
        if row is None:
            raise LookupError("the query has no rows")
        return row

    def query_opt(self, sql: str, params=None):
        return self.query(sql, params).head()

    def query_as(self, kind, sql: str, params=None) -> list:
        """The rows as objects of a class that takes the columns by name."""
        return [kind(**r.asDict()) for r in self.query(sql, params).toLocalIterator()]

    def rows(self, sql: str, params=None, timeout: float | None = None) -> list:
        """A query's rows; after `timeout` seconds its jobs are cancelled and TimeoutError is raised."""
        df = self.query(sql, params)
        if timeout is None:
            return df.collect()
        tag, late = f"quern-{id(self):x}-{self._next()}", threading.Event()

        def stop():
            late.set()
            self.spark.sparkContext.cancelJobsWithTag(tag)

        clock = threading.Timer(timeout, stop)
        self.spark.sparkContext.addJobTag(tag)
        clock.start()
        try:
            return df.collect()
        except Exception as e:
            if late.is_set():
                raise TimeoutError(f"no result in {timeout} s") from e
            raise
        finally:
            clock.cancel()
            self.spark.sparkContext.removeJobTag(tag)

    def prepare(self, sql: str):
        """A callable of the parameters; the text is read once."""
        parsed = tokens(sql)
        return lambda *params: self.execute(parsed, list(params))

    @contextmanager
    def transaction(self):
        """Commits when the block ends, rolls back when it raises."""
        self.execute("BEGIN")
        try:
            yield self
        except BaseException:
            self.execute("ROLLBACK")
            raise
        self.execute("COMMIT")

    def create_snapshot(self, path: str) -> None:
        """Backup of all tables and views to a folder."""
        self.store.save(path, self.view_texts)

    def restore_snapshot(self, path: str) -> None:
        if self._saved:
            raise DialectError("a transaction is open")
        self.view_texts = self.store.restore(path)

    # statements

    def execute(self, sql: str, params=None) -> DataFrame | int:
        """A query's rows, the rows a RETURNING or a SHOW gives, or how many rows a change touched."""
        r = self._rewriter(sql, params)
        head = r.now.up
        if head in ("SELECT", "WITH", "VALUES", "("):
            return self.query(sql, params)
        handler = getattr(self, f"_do_{head.lower()}", None) if r.now.kind == "id" else None
        if handler is None:
            return self.query([Token("id", "SELECT"), *r.t], params)
        r.p += 1
        return handler(r)

    def _find(self, name: str) -> Table:
        if name.strip("`").lower() not in self.store.tables:
            raise DialectError(f"no table {name}")
        return self.store.tables[name.strip("`").lower()]

    def _sql(self, sql: str) -> DataFrame:
        return self.spark.sql(sql)

    def _named(self, df: DataFrame, stem: str) -> str:
        name = f"_quern_{stem}_{id(self) & 0xFFFFFF:x}_{self._next()}"
        df.createOrReplaceTempView(name)
        return name

    def _do_create(self, r: Rewriter):
        unique = r.take("UNIQUE")
        if r.take("INDEX"):
            return self._create_index(r, unique)
        replace = r.seq("OR", "REPLACE")
        if r.take("VIEW"):
            skip = r.seq("IF", "NOT", "EXISTS")
            name = r.name().strip("`").lower()
            r.need("AS")
            if name in self.view_texts and skip:
                return 0
            if name in self.view_texts and not replace or name in self.store.tables:
                raise DialectError(f"{name} exists")
            text = " ".join(t.text for t in r.t[r.p : -1]).rstrip("; ")
            if any(t.kind == "par" for t in r.t[r.p :]):
                raise DialectError("a view has no parameters")
            self._sql(r.query())
            r.done()
            self.view_texts[name] = text
            return 0
        r.need("TABLE")
        skip = r.seq("IF", "NOT", "EXISTS")
        name = r.name().strip("`")
        if name.lower() in self.store.tables or name.lower() in self.view_texts:
            if skip:
                return 0
            raise DialectError(f"{name} exists")
        if r.take("AS"):
            df = self._sql(r.query())
            table = Table(name.lower(), [ColumnDef(f.name, f.dataType.simpleString()) for f in df.schema])
            self.store.commit(table, self.store.stage(table, df)[1])
            self.store.tables[name.lower()] = table
            return 0
        table = Table(name.lower(), [])
        r.need("(")
        while True:
            if r.take("CONSTRAINT"):
                r.name()
            if r.is_("PRIMARY", "UNIQUE") and (r.is_("(", ahead=1) or r.is_("(", ahead=2)):
                r.p += 1
                r.take("KEY")
                table.keys.append(tuple(self._names(r)))
            elif r.is_("CHECK") and r.is_("(", ahead=1):
                r.p += 1
                table.checks.append(r.primary())
            elif r.is_("FOREIGN"):
                r.seq("FOREIGN", "KEY")
                column = self._names(r)[0]
                next(c for c in table.columns if c.name.lower() == column.lower()).references = self._references(r)
            else:
                table.columns.append(table.number(self._column(r)))
            if not r.take(","):
                break
        r.need(")")
        r.done()
        for c in table.columns:
            if c.references:
                parent = table if c.references[0] == table.name else self._find(c.references[0])
                if c.references[1].lower() not in [x.name.lower() for x in parent.columns]:
                    raise DialectError(f"{parent.name} has no column {c.references[1]}")
        self.store.tables[name.lower()] = table
        return 0

    def _names(self, r: Rewriter) -> list[str]:
        r.need("(")
        out = [n.strip("`") for n in r.listed(r.name)]
        r.need(")")
        return out

    def _references(self, r: Rewriter) -> tuple[str, str, str, str]:
        r.need("REFERENCES")
        table = r.name().strip("`").lower()
        column = self._names(r)[0] if r.is_("(") else "id"
        actions = {"DELETE": "RESTRICT", "UPDATE": "RESTRICT"}
        while r.take("ON"):
            what = r.need("DELETE", "UPDATE")
            actions[what] = "SET NULL" if r.seq("SET", "NULL") else "NO ACTION" if r.seq("NO", "ACTION") else r.need("CASCADE", "RESTRICT")
        return table, column, actions["DELETE"], actions["UPDATE"]

    def _column(self, r: Rewriter) -> ColumnDef:
        c = ColumnDef(r.name().strip("`"), r.type_())
        while not r.is_(",", ")") and r.now.kind != "end":
            if r.seq("NOT", "NULL"):
                c.not_null = True
            elif r.take("NULL"):
                pass
            elif r.seq("PRIMARY", "KEY"):
                c.primary = c.not_null = True
            elif r.take("UNIQUE"):
                c.unique = True
            elif r.take("AUTO_INCREMENT", "AUTOINCREMENT"):
                c.auto = True
            elif r.take("DEFAULT"):
                c.default = r.sum_()
            elif r.take("CHECK"):
                c.check = r.primary()
            elif r.is_("REFERENCES"):
                c.references = self._references(r)
            else:
                raise DialectError(f"unexpected {r.now.text!r}")
        return c

    def _create_index(self, r: Rewriter, unique: bool):
        r.seq("IF", "NOT", "EXISTS")
        name = r.name().lower()
        r.need("ON")
        table = self._find(r.name())
        columns = tuple(self._names(r))
        kind = r.name().upper() if r.take("USING") else "BTREE"
        if unique:
            self._check_keys(table, self.store.read(table), [columns])
        table.indexes[name] = columns, unique, kind
        return 0

    def _do_drop(self, r: Rewriter):
        kind = r.need("TABLE", "VIEW", "INDEX")
        skip = r.seq("IF", "EXISTS")
        name = r.name().strip("`").lower()
        if kind == "TABLE":
            if name not in self.store.tables and not skip:
                raise DialectError(f"no table {name}")
            if name in self.store.tables:
                self._unreferenced(self.store.tables[name])
                for child, c in self._children(name):
                    if child.name != name:
                        c.references = None
                del self.store.tables[name]
        elif kind == "VIEW":
            if name not in self.view_texts and not skip:
                raise DialectError(f"no view {name}")
            self.view_texts.pop(name, None)
        else:
            owner = [t for t in self.store.tables.values() if name in t.indexes]
            if not owner and not skip:
                raise DialectError(f"no index {name}")
            for t in owner:
                del t.indexes[name]
        return 0

    def _do_alter(self, r: Rewriter):
        r.need("TABLE")
        table = self._find(r.name())
        find = lambda n: next(c for c in table.columns if c.name.lower() == n.strip("`").lower())
        before = table.copy()
        try:
            self._alter(r, table, find)
        except Exception:
            self.store.tables = {k: before if t is table else t for k, t in self.store.tables.items()}
            raise
        return 0

    def _alter(self, r: Rewriter, table: Table, find) -> None:
        rows = self.store.read(table)
        if r.take("ADD"):
            r.take("COLUMN")
            c = table.number(self._column(r))
            if c.name.lower() in [x.name.lower() for x in table.columns]:
                raise DialectError(f"column {c.name} exists")
            table.columns.append(c)
            if c.default is None and not c.not_null and not c.check:  # files without it read as NULL
                return self.store.commit(table, table.files)
            rows = rows.withColumn(c.name, F.expr(f"CAST({c.default or 'NULL'} AS {c.type})"))
        elif r.take("DROP"):
            r.take("COLUMN")
            table.columns.remove(find(r.name()))
            return self.store.commit(table, table.files)
        elif r.take("MODIFY"):
            r.take("COLUMN")
            c = table.number(self._column(r))
            old = find(c.name)
            table.columns[table.columns.index(old)] = c
            rows = rows.withColumn(c.name, F.col(f"`{old.name}`").try_cast(c.type))
        else:
            r.need("RENAME")
            if r.take("TO"):
                old, new = table.name, r.name().strip("`").lower()
                if new in self.store.tables or new in self.view_texts:
                    raise DialectError(f"{new} exists")
                self.store.tables[new] = self.store.tables.pop(old)
                table.name = new
                for _, c in self._children(old):
                    c.references = (new, *c.references[1:])
                return None
            r.take("COLUMN")
            c = find(r.name())
            r.need("TO")
            old, c.name = c.name, r.name().strip("`")
            fresh = lambda e: re.sub(rf"(?i)\b{re.escape(old)}\b", c.name, e)
            same = lambda k: tuple(c.name if x.lower() == old.lower() else x for x in k)
            table.keys, table.checks = [same(k) for k in table.keys], [fresh(e) for e in table.checks]
            table.indexes = {n: (same(k), u, kind) for n, (k, u, kind) in table.indexes.items()}
            c.check = fresh(c.check) if c.check else None
            for _, child in self._children(table.name):
                if child.references[1].lower() == old.lower():
                    child.references = (child.references[0], c.name, *child.references[2:])
            return self.store.commit(table, table.files)
        staged, files = self.store.stage(table, rows)
        self._check_rows(table, staged)
        self._check_keys(table, staged, table.unique_keys())
        return self.store.commit(table, files)

    # changes

    def _check_rows(self, table: Table, rows: DataFrame) -> None:
        rules = [(f"{c.name} is NULL", F.col(f"`{c.name}`").isNull()) for c in table.columns if c.not_null]
        rules += [(f"CHECK {e}", F.expr(f"NOT coalesce({e}, true)")) for e in [*table.checks, *(c.check for c in table.columns if c.check)]]
        if not rules:
            return
        counts = rows.agg(*[F.count(F.when(broken, 1)).alias(f"r{i}") for i, (_, broken) in enumerate(rules)]).first()
        for (what, _), n in zip(rules, counts, strict=True):
            if n:
                raise ConstraintError(f"{table.name}: {what} in {n} rows")

    def _check_keys(self, table: Table, rows: DataFrame, keys: list[tuple[str, ...]], others: DataFrame | None = None) -> None:
        """No two of the rows, and none of them and of the others, share a key. Rows with a NULL in the key don't collide."""
        for key in dict.fromkeys(keys):
            whole = rows.select(*key).na.drop()
            twice = whole.groupBy(*key).count().filter("count > 1").select(*key).head()
            if twice is None and others is not None:
                twice = whole.join(others.select(*key), list(key), "left_semi").head()
            if twice:
                raise ConstraintError(f"{table.name}: more than one row with {dict(zip(key, twice, strict=False))}")

    def _check_references(self, table: Table, rows: DataFrame, columns: set[str] | None = None) -> None:
        """Rows refer to rows; those of the own table are as they will be: the snapshot's and `rows`."""
        for c in table.columns:
            if c.references and c.references[0] in self.store.tables and (columns is None or c.name.lower() in columns):
                parent = self.store.tables[c.references[0]]
                known = self.store.read(parent).select(F.col(f"`{c.references[1]}`").alias("k"))
                if parent is table:
                    known = known.union(rows.select(F.col(f"`{c.references[1]}`").alias("k")))
                if not rows.select(F.col(f"`{c.name}`").alias("k")).filter("k is not null").join(known, "k", "left_anti").isEmpty():
                    raise ConstraintError(f"{table.name}: {c.name} refers to no row of {parent.name}")

    def _children(self, name: str) -> list[tuple[Table, ColumnDef]]:
        """The tables and columns that refer to a table."""
        return [(t, c) for t in self.store.tables.values() for c in t.columns if c.references and c.references[0] == name]

    def _unreferenced(self, table: Table) -> None:
        for child, c in self._children(table.name):
            if child is not table and not self.store.read(child).filter(F.col(f"`{c.name}`").isNotNull()).isEmpty():
                raise ConstraintError(f"rows of {child.name} refer to {table.name}")

    def _returning(self, r: Rewriter, rows: DataFrame) -> DataFrame | None:
        if not r.take("RETURNING"):
            return None
        view = self._named(rows, "returning")
        r.relation = view
        items = r.listed(r.item)
        return self._sql(f"SELECT {', '.join(f'{e} AS {a}' if a else e for e, a in items)} FROM {view}")

    def _do_insert(self, r: Rewriter):
        r.need("INTO")
        table = self._find(r.name())
        names = self._names(r) if r.is_("(") and not r.is_("SELECT", ahead=1) else [c.name for c in table.columns]
        if r.is_("VALUES"):
            r.p += 1
            rows = r.listed(self._value_row(r, table, names))
            incoming = self._sql("SELECT * FROM VALUES " + ", ".join(f"{x[:-1]}, {i}L)" for i, x in enumerate(rows)))
            given = len(incoming.columns) - 1
        else:
            incoming = self._sql(r.query())
            given = len(incoming.columns)
            incoming = incoming.toDF(*[f"_{i}" for i in range(given)]).withColumn("_ord", F.monotonically_increasing_id())
        if given != len(names):
            raise DialectError(f"{given} values for {len(names)} columns")
        return self._insert(r, table, incoming.toDF(*names, "_ord"))

    def _insert(self, r: Rewriter, table: Table, incoming: DataFrame):
        """incoming: some of the table's columns, and _ord, the order of the rows."""
        given = {c.lower() for c in incoming.columns}
        filled = incoming.select(*[F.col(f"`{c.name}`").cast(c.type).alias(c.name) if c.name.lower() in given else F.expr(f"CAST({c.default or 'NULL'} AS {c.type})").alias(c.name) for c in table.columns], "_ord")
        before = table.copy()
        staged, files = self.store.stage(table, filled, "_ord")
        try:
            for c in table.columns:
                if c.auto or c.primary and c.type == "BIGINT" and c.name.lower() not in given:
                    staged, old = self._numbered(table, staged, c), files
                    staged, files = self.store.stage(table, staged, "_ord")
                    self.store.discard(old)
            keys = table.unique_keys()
            update = r.seq("ON", "DUPLICATE", "KEY", "UPDATE")
            if r.seq("ON", "CONFLICT"):
                if r.is_("("):
                    keys = [tuple(self._names(r))]
                update = r.seq("DO", "UPDATE", "SET")
                if not update:
                    r.need("DO")
                    r.need("NOTHING")
                    old = files
                    staged, files = self.store.stage(table, self._unmatched(table, staged, keys))
                    self.store.discard(old)
            if update:
                out = self._upsert(r, table, staged, keys)
                self.store.discard(files)
                return out
            self._check_rows(table, staged)
            self._check_keys(table, staged, table.unique_keys(), self.store.read(table) if table.files else None)
            self._check_references(table, staged)
            n = staged.count()
            self.store.commit(table, [*table.files, *files])
        except Exception:
            self.store.discard(files)
            self.store.tables[table.name] = before
            raise
        out = self._returning(r, staged)
        return out if out is not None else n

    def _numbered(self, table: Table, staged: DataFrame, c: ColumnDef) -> DataFrame:
        """NULLs of a column become numbers after all that were given or met before, in the order of the rows.

        Rows are numbered within the partition that wrote them; the driver holds a count for each partition.
        """
        column, part = F.col(f"`{c.name}`"), F.shiftright("_ord", 33)
        most = staged.agg(F.max(column)).first()[0]
        if not table.counter and table.files:
            table.counter = self.store.read(table).agg(F.max(column)).first()[0] or 0
        table.counter = max(table.counter, most or 0)
        offsets = []
        for x in staged.filter(column.isNull()).groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
            offsets.append((x["part"], table.counter))
            table.counter += x["n"]
        if not offsets:
            return staged
        first = self.spark.createDataFrame(offsets, "_part bigint, _first bigint")
        place = F.row_number().over(Window.partitionBy("_part", column.isNull()).orderBy("_ord"))
        return staged.withColumn("_part", part).join(F.broadcast(first), "_part", "left").withColumn(c.name, F.coalesce(column, place + F.col("_first"))).drop("_part", "_first")

    def _unmatched(self, table: Table, incoming: DataFrame, keys: list[tuple[str, ...]]) -> DataFrame:
        """The incoming rows that share no key with a row of the table or one before them; NULLs in a key match nothing."""
        now = self.store.read(table)
        for key in keys:
            incoming = incoming.join(now.select(*key), list(key), "left_anti").select(*incoming.columns)
            null = F.lit(False)
            for k in key:
                null = null | F.col(f"`{k}`").isNull()
            row = F.struct(*[F.col(f"`{x}`") for x in incoming.columns])
            first = incoming.filter(~null).groupBy(*[F.col(f"`{k}`") for k in key]).agg(F.min_by(row, "_ord").alias("_r")).select("_r.*")
            incoming = first.unionByName(incoming.filter(null))
        return incoming

    def _value_row(self, r: Rewriter, table: Table, names: list[str]):
        defaults = {c.name.lower(): c.default or "NULL" for c in table.columns}
        kinds = {c.name.lower(): c.type for c in table.columns}

        def row() -> str:
            r.need("(")
            out = []
            for n in names:
                out.append(f"CAST({defaults[n.lower()] if r.take('DEFAULT') else r.expr()} AS {kinds[n.lower()]})")
                if not r.take(","):
                    break
            r.need(")")
            return f"({', '.join(out)})"

        return row

    def _upsert(self, r: Rewriter, table: Table, incoming: DataFrame, keys: list[tuple[str, ...]]):
        """Rows of a known key take the assignments: bare columns are the row's own, EXCLUDED the incoming one's.

        Incoming rows meet the table in their order: all that fall on one row, of the table or the first of a new
        key, are applied one after the other, as a fold over the few rows that share a key.
        """
        t, names = table.name, [c.name for c in table.columns]
        now = self.store.read(table, places=True)
        whole = lambda columns: F.struct(*[F.col(f"`{c}`") for c in columns])
        rows = incoming.select(whole([*names, "_ord"]).alias("_new"), F.lit(None).cast(now.select(whole(now.columns)).schema[0].dataType).alias("_old"))
        for i, key in enumerate(keys):
            there = now.select(*[F.col(f"`{k}`").alias(f"_k{j}") for j, k in enumerate(key)], whole(now.columns).alias(f"_m{i}"))
            met = F.col("_old").isNull()
            for j, k in enumerate(key):
                met = met & (F.col(f"_new.`{k}`") == F.col(f"_k{j}"))
            rows = rows.join(there, met, "left").select("_new", F.coalesce("_old", f"_m{i}").alias("_old"))
        own = F.to_json(F.struct(*[F.col(f"_new.`{k}`").alias(f"k{j}") for j, k in enumerate(keys[0])])) if keys else F.lit(None)
        null = F.lit(not keys)
        for k in keys[0] if keys else ():
            null = null | F.col(f"_new.`{k}`").isNull()
        at = F.when(F.col("_old").isNotNull(), F.struct(F.col("_old._file").alias("a"), F.col("_old._row").alias("b")))
        at = F.coalesce(at, F.when(null, F.struct(F.lit("?").alias("a"), F.col("_new._ord").alias("b"))), F.struct(own.alias("a"), F.lit(-1).cast("bigint").alias("b")))
        groups = rows.groupBy(at.alias("_at")).agg(F.any_value("_old").alias("_old"), F.sort_array(F.collect_list(F.struct(F.col("_new._ord").alias("o"), F.col("_new").alias("r")))).alias("_all"))

        a, b = self._named(now.drop("_file", "_row"), "old"), self._named(incoming.drop("_ord"), "new")
        r.relation = f"{a} AS {t} JOIN {b} AS excluded"
        changes = dict(r.listed(self._assignment(r, {n.lower() for n in names}, t)))
        r.relation = ""
        row = lambda of: "named_struct(" + ", ".join(f"'{c.name}', CAST({of(c)} AS {c.type})" for c in table.columns) + ")"
        if any("(SELECT" in e for e in changes.values()):
            # subqueries have no place in a fold: one incoming row for each row of the table
            if not groups.filter("size(_all) > 1").isEmpty():
                raise DialectError("assignments with subqueries take each key once")
            made = self._named(groups.select(F.col("_old").alias(t), F.col("_all")[0]["r"].alias("excluded")), "met")
            folded = self._sql(f"SELECT CASE WHEN {t} IS NULL THEN {row(lambda c: f'excluded.`{c.name}`')} ELSE {row(lambda c: changes.get(c.name.lower(), f'{t}.`{c.name}`'))} END AS _r, {t} AS _old FROM {made}")
        else:
            made = self._named(groups, "met")
            first = f"CASE WHEN _old IS NULL THEN {row(lambda c: f'_all[0].r.`{c.name}`')} ELSE {row(lambda c: f'_old.`{c.name}`')} END"
            rest = "CASE WHEN _old IS NULL THEN slice(_all, 2, size(_all)) ELSE _all END"
            step = row(lambda c: changes.get(c.name.lower(), f"{t}.`{c.name}`"))
            folded = self._sql(f"SELECT aggregate(transform({rest}, x -> x.r), {first}, ({t}, excluded) -> {step}) AS _r, _old FROM {made}")
        changed, kept = self.store.stage(table, folded.select("_r.*", F.col("_old._file").alias("_file"), F.col("_old._row").alias("_row")), "_file", "_row")
        met = changed.filter("_file is not null").select("_file", "_row")
        hit = [x["_file"] for x in met.select("_file").distinct().collect()]  # a row a file
        files = list(kept)
        rest = self.store.read(table, files=self.store.others(table, hit))
        try:
            if hit:
                stay, more = self.store.stage(table, self._of_files(table, hit).join(met, ["_file", "_row"], "left_anti"))
                files += more
                rest = rest.unionByName(stay)
            self._check_rows(table, changed)
            self._check_keys(table, changed.drop("_file", "_row"), table.unique_keys(), rest)
            self._check_references(table, changed)
            self._replaced(table, hit, files)
        except Exception:
            self.store.discard(files)
            raise
        out = self._returning(r, changed.drop("_file", "_row"))
        return out if out is not None else changed.count()

    def _of_files(self, table: Table, files: list[str]) -> DataFrame:
        """The rows, with their places, of some of the table's files."""
        others = set(self.store.others(table, files))
        return self.store.read(table, files=[f for f in table.files if f not in others], places=True)

    def _replaced(self, table: Table, hit: list[str], files: list[str]) -> None:
        self.store.commit(table, [*self.store.others(table, hit), *files])

    def _assignment(self, r: Rewriter, columns: set[str], owner: str):
        def one() -> tuple[str, str]:
            name = r.name().strip("`").lower()
            r.need("=")
            if name not in columns:
                raise DialectError(f"no column {name}")
            start = r.p
            # qualify bare columns, so that both sides of the join may have them
            r.aliases = {c: f"{owner}.`{c}`" for c in columns}
            e = r.expr()
            r.aliases = {}
            return name, e if r.p > start else "NULL"

        return one

    def _hits(self, table: Table, view: str, where: str) -> tuple[list[str], int]:
        """(files with rows that meet a condition, how many rows do)."""
        found = self._sql(f"SELECT _file, count(*) AS n FROM {view} AS {table.name} WHERE {where} GROUP BY _file").collect()  # a row a file
        return [x["_file"] for x in found], sum(x["n"] for x in found)

    def _restored(self, change):
        """What change() gives; if it raises, all tables are as before."""
        saved = {k: t.copy() for k, t in self.store.tables.items()}
        try:
            return change()
        except Exception:
            self.store.tables = saved
            raise

    def _do_update(self, r: Rewriter):
        table = self._find(r.name())
        r.need("SET")
        view = self._named(self.store.read(table, places=True), "update")
        r.relation = f"{view} AS {table.name}"
        changes = dict(r.listed(self._assignment(r, {c.name.lower() for c in table.columns}, table.name)))
        where = r.expr() if r.take("WHERE") else "true"
        if fixed := [c.name for c in table.columns if c.primary and c.name.lower() in changes]:
            raise ConstraintError(f"{table.name}: the primary key {fixed[0]} can't be updated")
        hit, n = self._hits(table, view, where)
        if not hit:
            out = self._returning(r, self.store.read(table).limit(0))
            return out if out is not None else 0
        some = self._named(self._of_files(table, hit), "update")
        columns = ", ".join(f"CASE WHEN _hit THEN CAST({changes[c.name.lower()]} AS {c.type}) ELSE `{c.name}` END AS `{c.name}`" if c.name.lower() in changes else f"`{c.name}`" for c in table.columns)
        referred = {c.references[1].lower() for _, c in self._children(table.name)} & set(changes)
        old = "".join(f", {table.name}.`{c}` AS `_old_{c}`" for c in sorted(referred))
        rows = self._sql(f"SELECT {columns}{old}, _hit FROM (SELECT *, coalesce({where}, false) AS _hit FROM {some} AS {table.name}) AS {table.name}")
        staged, files = self.store.stage(table, rows, *[f"_old_{c}" for c in sorted(referred)], "_hit")
        after = staged.filter("_hit")

        def change():
            self._check_rows(table, after)
            keys = [k for k in table.unique_keys() if {x.lower() for x in k} & set(changes)]
            rest = self.store.read(table, files=self.store.others(table, hit)).unionByName(staged.filter("not _hit").select(*[F.col(f"`{c.name}`") for c in table.columns]))
            self._check_keys(table, after, keys, rest)
            self._check_references(table, after, set(changes))
            self._replaced(table, hit, files)
            for c in sorted(referred):
                moved = after.select(F.col(f"`_old_{c}`").alias("_from"), F.col(f"`{c}`").alias("_to")).filter("_from is not null and not (_from <=> _to)").distinct()
                self._after_update(table, c, moved, 1)

        self._restored(change)
        out = self._returning(r, after.select(*[F.col(f"`{c.name}`") for c in table.columns]))
        return out if out is not None else n

    def _do_delete(self, r: Rewriter):
        r.need("FROM")
        table = self._find(r.name())
        view = self._named(self.store.read(table, places=True), "delete")
        r.relation = f"{view} AS {table.name}"
        where = r.expr() if r.take("WHERE") else "true"
        hit, n = self._hits(table, view, where)
        gone = self._sql(f"SELECT * FROM {r.relation} WHERE {where}").drop("_file", "_row")

        def change():
            if hit:
                some = self._named(self._of_files(table, hit), "delete")
                rest = self._sql(f"SELECT * FROM {some} AS {table.name} WHERE NOT coalesce({where}, false)")
                self._replaced(table, hit, self.store.stage(table, rest)[1])
                self._after_delete(table, gone, 1)

        self._restored(change)
        out = self._returning(r, gone)
        return out if out is not None else n

    def _lost(self, child: Table, c: ColumnDef, keys: DataFrame) -> tuple[list[str], DataFrame]:
        """(files, rows with their places) of a child whose reference is among the keys."""
        lost = self.store.read(child, places=True).join(keys, F.col(f"`{c.name}`").eqNullSafe(F.col("_from")), "left_semi")
        return [x["_file"] for x in lost.select("_file").distinct().collect()], lost

    def _after_delete(self, table: Table, gone: DataFrame, depth: int) -> None:
        """What the references to deleted rows ask for."""
        for child, c in self._children(table.name):
            keys = gone.select(F.col(f"`{c.references[1]}`").alias("_from")).filter("_from is not null").distinct()
            hit, lost = self._lost(child, c, keys)
            if not hit:
                continue
            if depth > CASCADE_DEPTH or c.references[2] not in ("CASCADE", "SET NULL"):
                raise ConstraintError(f"{child.name}.{c.name} still refers to {table.name}")
            some = self._of_files(child, hit)
            rest = some.join(keys, F.col(f"`{c.name}`").eqNullSafe(F.col("_from")), "left_anti")
            if c.references[2] == "SET NULL":
                rest = rest.unionByName(lost.withColumn(c.name, F.lit(None).cast(c.type)))
            staged, files = self.store.stage(child, rest)
            self._check_rows(child, staged)
            self._replaced(child, hit, files)
            if c.references[2] == "CASCADE":
                self._after_delete(child, lost.drop("_file", "_row"), depth + 1)

    def _after_update(self, table: Table, column: str, moved: DataFrame, depth: int) -> None:
        """What the references to changed values ask for; moved: _from, _to."""
        for child, c in self._children(table.name):
            if c.references[1].lower() != column.lower():
                continue
            hit, _ = self._lost(child, c, moved)
            if not hit:
                continue
            action = c.references[3]
            if depth > CASCADE_DEPTH or action not in ("CASCADE", "SET NULL"):
                raise ConstraintError(f"{child.name}.{c.name} still refers to {table.name}")
            to = moved if action == "CASCADE" else moved.select("_from", F.lit(None).cast(c.type).alias("_to"))
            rows = self._of_files(child, hit).join(to.withColumn("_moved", F.lit(True)), F.col(f"`{c.name}`") == F.col("_from"), "left")
            rows = rows.withColumn(c.name, F.when(F.col("_moved"), F.col("_to")).otherwise(F.col(f"`{c.name}`")))
            staged, files = self.store.stage(child, rows, "_moved")
            self._check_rows(child, staged)
            keys = [k for k in child.unique_keys() if c.name.lower() in {x.lower() for x in k}]
            self._check_keys(child, staged, keys, self.store.read(child, files=self.store.others(child, hit)))
            self._replaced(child, hit, files)
            if any(x.references[1].lower() == c.name.lower() for _, x in self._children(child.name)):
                self._after_update(child, c.name, to, depth + 1)

    def _do_truncate(self, r: Rewriter):
        r.take("TABLE")
        table = self._find(r.name())
        self._unreferenced(table)
        n = self.store.read(table).count()
        self.store.commit(table, [])
        return n

    def _do_copy(self, r: Rewriter):
        table = self._find(r.name())
        columns = [(c.name, c.type) for c in table.columns]
        if r.is_("("):
            wanted = {n.lower() for n in self._names(r)}
            columns = [c for c in columns if c[0].lower() in wanted]
        r.need("FROM")
        path = r.primary()[1:-1]
        options = {}
        if r.take("WITH"):
            r.need("(")
            while not r.take(")"):
                k = r.name().upper()
                r.take("=")
                if r.is_(",", ")"):
                    options[k] = "true"
                else:
                    options[k] = r.now.text.strip("'")
                    r.p += 1
                r.take(",")
        form = options.get("FORMAT", "json" if path.endswith("json") else "csv").lower()
        if form == "json":
            rows = read_json(self.spark, path, columns)
        else:
            rows = read_csv(self.spark, path, columns, options.get("HEADER", "true").lower() == "true", options.get("DELIMITER", ","), options.get("NULL", ""))
        return self._insert(r, table, rows.withColumn("_ord", F.monotonically_increasing_id()))

    # transactions

    def _do_begin(self, r: Rewriter):
        if self._saved:
            raise DialectError("a transaction is open")
        self._save("")
        return 0

    def _save(self, name: str) -> None:
        self._saved.append((name, {k: t.copy() for k, t in self.store.tables.items()}, dict(self.view_texts)))

    def _do_commit(self, r: Rewriter):
        if not self._saved:
            raise DialectError("no transaction is open")
        self._saved.clear()
        return 0

    def _do_rollback(self, r: Rewriter):
        if not self._saved:
            raise DialectError("no transaction is open")
        k = 0
        if r.take("TO"):
            r.take("SAVEPOINT")
            k = self._savepoint(r.name())
        _, self.store.tables, self.view_texts = self._saved[k]
        if k:
            self.store.tables = {n: t.copy() for n, t in self.store.tables.items()}
            del self._saved[k + 1 :]
        else:
            self._saved.clear()
        return 0

    def _savepoint(self, name: str) -> int:
        for k in range(len(self._saved) - 1, 0, -1):
            if self._saved[k][0] == name.lower():
                return k
        raise DialectError(f"no savepoint {name}")

    def _do_savepoint(self, r: Rewriter):
        if not self._saved:
            raise DialectError("no transaction is open")
        self._save(r.name().lower())
        return 0

    def _do_release(self, r: Rewriter):
        r.take("SAVEPOINT")
        del self._saved[self._savepoint(r.name()) :]
        return 0

    # the catalog

    def _frame(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def _do_show(self, r: Rewriter):
        what = r.need("TABLES", "VIEWS", "CREATE", "INDEXES")
        if what == "TABLES":
            return self._frame([(n,) for n in sorted(self.store.tables)], "table_name string")
        if what == "VIEWS":
            return self._frame([(n,) for n in sorted(self.view_texts)], "view_name string")
        if what == "INDEXES":
            r.need("FROM")
            t = self._find(r.name())
            return self._frame([(t.name, n, ", ".join(c), k, u) for n, (c, u, k) in sorted(t.indexes.items())], "table_name string, index_name string, column_name string, index_type string, is_unique boolean")
        if r.need("TABLE", "VIEW") == "VIEW":
            n = r.name().lower()
            return self._frame([(n, f"CREATE VIEW {n} AS {self.view_texts[n]}")], "view_name string, create_statement string")
        t = self._find(r.name())
        parts = [f"{c.name} {c.type}" + " PRIMARY KEY" * c.primary + " NOT NULL" * (c.not_null and not c.primary) + " UNIQUE" * c.unique + " AUTO_INCREMENT" * c.auto + (f" DEFAULT {c.default}" if c.default else "") + (f" CHECK {c.check}" if c.check else "") for c in t.columns]
        parts += [f"UNIQUE ({', '.join(k)})" for k in t.keys] + [f"CHECK {c}" for c in t.checks]
        return self._frame([(t.name, f"CREATE TABLE {t.name} ({', '.join(parts)})")], "table_name string, create_statement string")

    def _do_describe(self, r: Rewriter):
        r.take("TABLE")
        t = self._find(r.name())
        return self._frame([(c.name, c.type, "NO" if c.not_null else "YES", "PRI" if c.primary else "UNI" if c.unique else "", c.default, "auto_increment" if c.auto else "") for c in t.columns], "field string, type string, nullable string, key string, default string, extra string")

    _do_desc = _do_describe

    def _do_explain(self, r: Rewriter):
        """The plan; with ANALYZE the query is run, and its operators come with the rows and times they took."""
        measured = r.take("ANALYZE")
        text = r.query()
        if not measured:
            lines = self.spark.sql(f"EXPLAIN FORMATTED {text}").first()[0].split("\n")
            return self._frame([(line,) for line in lines], "plan string")
        run = self._sql(text)._jdf.queryExecution()
        start = time.perf_counter()
        n = run.toRdd().count()
        lines = [f"{n} rows in {(time.perf_counter() - start) * 1000:.1f} ms"]

        def walk(node, depth: int) -> None:
            if node.nodeName() == "AdaptiveSparkPlan":
                return walk(node.executedPlan(), depth)
            told, metrics = [], node.metrics().iterator()
            while metrics.hasNext():
                pair = metrics.next()
                if (value := pair._2().value()) > 0 and (pair._1() == "numOutputRows" or "time" in pair._1().lower()):
                    told.append(f"{pair._1()}: {value}")
            lines.append("  " * depth + node.nodeName() + (f" ({', '.join(sorted(told))})" if told else ""))
            if hasattr(node, "plan") and "QueryStage" in node.nodeName():
                walk(node.plan(), depth + 1)
            children = node.children().iterator()
            while children.hasNext():
                walk(children.next(), depth + 1)

        walk(run.executedPlan(), 0)
        return self._frame([(line,) for line in lines], "plan string")

    def _do_analyze(self, r: Rewriter):
        """Row count, and for each column its distinct values, NULLs and bounds."""
        r.take("TABLE")
        rows = self.store.read(self._find(r.name())) if r.now.kind == "id" and r.now.text.lower() in self.store.tables else self.spark.table(r.name())
        plain = [f.name for f in rows.schema if f.dataType.simpleString() not in ("variant",) and not f.dataType.simpleString().startswith(("array", "map", "struct"))]
        found = rows.agg(F.count("*").alias("n"), *[x for i, c in enumerate(plain) for x in (F.count_distinct(f"`{c}`").alias(f"d{i}"), F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"z{i}"), F.min(f"`{c}`").cast("string").alias(f"a{i}"), F.max(f"`{c}`").cast("string").alias(f"b{i}"))]).first()
        return self._frame([(c, found["n"], found[f"d{i}"], found[f"z{i}"], found[f"a{i}"], found[f"b{i}"]) for i, c in enumerate(plain)], "column_name string, row_count bigint, distinct_count bigint, null_count bigint, min_value string, max_value string")

    def _do_vacuum(self, r: Rewriter):
        if self._saved:
            raise DialectError("a transaction is open")
        return self._frame([(self.store.vacuum(),)], "snapshots_removed bigint")

    def _do_set(self, r: Rewriter):
        name = r.name().lower()
        r.take("=", "TO")
        self.settings[name] = " ".join(t.text for t in r.t[r.p : -1]).strip("'; ")
        return 0

    def _do_pragma(self, r: Rewriter):
        name = r.name().lower()
        if r.take("="):
            self.settings[name] = r.now.text.strip("'")
        return self._frame([(name, self.settings.get(name))], "name string, value string")


def statements(script: str) -> list[str]:
    """The statements of a script."""
    out, now = [], ""
    for part in re.split(r"('(?:[^']|'')*'|;)", script):
        if part == ";":
            out.append(now)
            now = ""
        else:
            now += part
    return [s.strip() for s in (*out, now) if s.strip()]


__all__ = ["ConstraintError", "DialectError", "Engine", "Token", "statements", "tokens"]
