"""Changes, snapshots, transactions, the catalog and COPY: scripts of the engine whose last statement is the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.engine import ConstraintError, Engine, statements
from quern.queries import engine, naive, query


def script(name: str, text: str, oracle: str | None) -> None:
    def run(spark, sf_dir):
        engine(spark, sf_dir)
        db = Engine(spark)
        for s in statements(text):
            out = db.execute(s)
        return naive(out)

    query(name, oracle)(run)


_ITEMS = "CREATE TABLE items (id INTEGER PRIMARY KEY, name TEXT NOT NULL, qty INTEGER DEFAULT 1); INSERT INTO items SELECT n_nationkey, n_name, n_regionkey FROM nation; "
_ROWS = "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST({} AS BIGINT) AS qty FROM nation"

script("ddl_create_as_select", "CREATE TABLE c AS SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 9000; SELECT * FROM c", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 9000")
script("ddl_alter_table", _ITEMS + "ALTER TABLE items ADD COLUMN note TEXT DEFAULT 'n'; ALTER TABLE items RENAME COLUMN qty TO amount; ALTER TABLE items DROP COLUMN name; ALTER TABLE items RENAME TO things; SELECT * FROM things", "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS amount, 'n' AS note FROM nation")
script("ddl_modify_column", _ITEMS + "ALTER TABLE items MODIFY COLUMN qty TEXT; SELECT id, qty || '!' AS q FROM items", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_regionkey || '!' AS q FROM nation")
script("ddl_view", "CREATE VIEW rich AS SELECT c_custkey FROM customer WHERE c_acctbal > 5000; SELECT COUNT(*) AS n FROM rich", "SELECT count(*) AS n FROM customer WHERE c_acctbal > 5000")
script("dml_insert_select", _ITEMS + "SELECT * FROM items", _ROWS.format("n_regionkey"))
script("dml_insert_defaults", "CREATE TABLE d (id INTEGER PRIMARY KEY AUTO_INCREMENT, v INTEGER DEFAULT 7, s TEXT); INSERT INTO d (s) VALUES ('a'); INSERT INTO d (s, v) VALUES ('b', DEFAULT); SELECT * FROM d", "SELECT * FROM (VALUES (1::BIGINT, 7::BIGINT, 'a'), (2, 7, 'b')) t(id, v, s)")
script("dml_update", _ITEMS + "UPDATE items SET qty = qty * 10 + 1 WHERE id % 2 = 0; SELECT * FROM items", _ROWS.format("CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey * 10 + 1 ELSE n_regionkey END"))
script("dml_delete", _ITEMS + "DELETE FROM items WHERE qty IN (1, 3); SELECT * FROM items", _ROWS.format("n_regionkey") + " WHERE n_regionkey NOT IN (1, 3)")
script("dml_truncate", _ITEMS + "TRUNCATE TABLE items; SELECT COUNT(*) AS n FROM items", "SELECT 0::BIGINT AS n")
script("dml_upsert_update", _ITEMS + "INSERT INTO items VALUES (3, 'x', 5), (99, 'y', 6) ON CONFLICT (id) DO UPDATE SET name = EXCLUDED.name, qty = qty + EXCLUDED.qty; SELECT * FROM items", "SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey = 3 THEN 'x' ELSE n_name END AS name, CAST(CASE WHEN n_nationkey = 3 THEN n_regionkey + 5 ELSE n_regionkey END AS BIGINT) AS qty FROM nation UNION ALL SELECT 99, 'y', 6")
script("dml_on_duplicate_key", _ITEMS + "INSERT INTO items VALUES (4, 'x', 5) ON DUPLICATE KEY UPDATE qty = qty + 100; SELECT * FROM items", _ROWS.format("CASE WHEN n_nationkey = 4 THEN n_regionkey + 100 ELSE n_regionkey END"))
script("dml_upsert_nothing", _ITEMS + "INSERT INTO items VALUES (3, 'x', 5), (99, 'y', 6) ON CONFLICT DO NOTHING; SELECT * FROM items", _ROWS.format("n_regionkey") + " UNION ALL SELECT 99, 'y', 6")
script("dml_returning", _ITEMS + "UPDATE items SET qty = 0 WHERE id < 3 RETURNING id, qty, name", _ROWS.format("0") + " WHERE n_nationkey < 3")
script("dml_foreign_key_cascade", _ITEMS + "CREATE TABLE subs (k INTEGER, item INTEGER REFERENCES items(id) ON DELETE CASCADE); INSERT INTO subs SELECT s_suppkey, s_nationkey FROM supplier; DELETE FROM items WHERE id < 10; SELECT k, item FROM subs", "SELECT CAST(s_suppkey AS BIGINT) AS k, CAST(s_nationkey AS BIGINT) AS item FROM supplier WHERE s_nationkey >= 10")
script("asof_transaction", _ITEMS + "UPDATE items SET qty = 50; DELETE FROM items; SELECT id, qty FROM items AS OF TRANSACTION 2", "SELECT CAST(n_nationkey AS BIGINT) AS id, 50::BIGINT AS qty FROM nation")
script("asof_timestamp", _ITEMS + "UPDATE items SET qty = 50; SELECT id, qty FROM items AS OF TIMESTAMP '2100-01-01 00:00:00'", "SELECT CAST(n_nationkey AS BIGINT) AS id, 50::BIGINT AS qty FROM nation")
script("txn_rollback", _ITEMS + "BEGIN; DELETE FROM items; ROLLBACK; SELECT COUNT(*) AS n FROM items", "SELECT count(*) AS n FROM nation")
script("txn_savepoint", _ITEMS + "BEGIN; DELETE FROM items WHERE id < 5; SAVEPOINT a; DELETE FROM items; ROLLBACK TO SAVEPOINT a; COMMIT; SELECT COUNT(*) AS n FROM items", "SELECT count(*) AS n FROM nation WHERE n_nationkey >= 5")
script("txn_current_id", _ITEMS + "SELECT CURRENT_TRANSACTION_ID() AS t", "SELECT 1 AS t")
script("show_tables", _ITEMS + "SHOW TABLES", "SELECT 'items' AS table_name")
script("show_create_table", _ITEMS + "SHOW CREATE TABLE items", "SELECT 'items' AS table_name, 'CREATE TABLE items (id BIGINT PRIMARY KEY, name STRING NOT NULL, qty BIGINT DEFAULT 1)' AS create_statement")
script("show_indexes", _ITEMS + "CREATE UNIQUE INDEX by_name ON items (name) USING HASH; SHOW INDEXES FROM items", "SELECT 'items' AS table_name, 'by_name' AS index_name, 'name' AS column_name, 'HASH' AS index_type, true AS is_unique")
script("describe_table", _ITEMS + "DESCRIBE items", "SELECT * FROM (VALUES ('id', 'BIGINT', 'NO', 'PRI', NULL, ''), ('name', 'STRING', 'NO', '', NULL, ''), ('qty', 'BIGINT', 'YES', '', '1', '')) t(field, type, nullable, key, \"default\", extra)")
script(
    "analyze_table",
    _ITEMS + "ANALYZE items",
    "SELECT 'id' AS column_name, count(*) AS row_count, count(DISTINCT n_nationkey) AS distinct_count, 0::BIGINT AS null_count, min(n_nationkey)::TEXT AS min_value, max(n_nationkey)::TEXT AS max_value FROM nation"
    " UNION ALL SELECT 'name', count(*), count(DISTINCT n_name), 0, min(n_name), max(n_name) FROM nation UNION ALL SELECT 'qty', count(*), count(DISTINCT n_regionkey), 0, min(n_regionkey)::TEXT, max(n_regionkey)::TEXT FROM nation",
)
script("view_after_insert", "CREATE TABLE t (id INTEGER); INSERT INTO t SELECT n_nationkey FROM nation; CREATE VIEW high AS SELECT id FROM t WHERE id > 20; INSERT INTO t VALUES (100), (101); DELETE FROM t WHERE id = 24; SELECT id FROM high", "SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation WHERE n_nationkey > 20 AND n_nationkey <> 24 UNION ALL SELECT 100 UNION ALL SELECT 101")
script("view_rolled_back", "CREATE TABLE t (id INTEGER); BEGIN; CREATE VIEW v AS SELECT id FROM t; ROLLBACK; CREATE VIEW w AS SELECT id FROM t; SHOW VIEWS", "SELECT 'w' AS view_name")
script("asof_after_rename", _ITEMS + "ALTER TABLE items RENAME COLUMN qty TO amount; ALTER TABLE items DROP COLUMN name; SELECT * FROM items AS OF TRANSACTION 1", _ROWS.format("n_regionkey"))
script("upsert_null_key", "CREATE TABLE t (k INTEGER UNIQUE, v INTEGER); INSERT INTO t VALUES (NULL, 1), (NULL, 2), (7, 3), (7, 4) ON CONFLICT DO NOTHING; INSERT INTO t VALUES (NULL, 5), (7, 6) ON CONFLICT (k) DO UPDATE SET v = v + EXCLUDED.v; SELECT k, v FROM t", "SELECT * FROM (VALUES (NULL::BIGINT, 1::BIGINT), (NULL, 2), (NULL, 5), (7, 9)) t(k, v)")
script("upsert_repeated_key", "CREATE TABLE t (id INTEGER PRIMARY KEY, s TEXT); INSERT INTO t VALUES (1, 'x'); INSERT INTO t VALUES (1, 'p'), (2, 'r'), (1, 'q'), (2, 'u') ON CONFLICT (id) DO UPDATE SET s = s || EXCLUDED.s; SELECT id, s FROM t", "SELECT * FROM (VALUES (1::BIGINT, 'xpq'), (2, 'ru')) t(id, s)")
script("upsert_second_key", "CREATE TABLE t (id INTEGER PRIMARY KEY, u INTEGER UNIQUE, s TEXT); INSERT INTO t VALUES (1, 10, 'x'), (2, 20, 'y'); INSERT INTO t VALUES (5, 20, 'z'), (6, 30, 'w') ON DUPLICATE KEY UPDATE s = CONCAT(s, EXCLUDED.s); SELECT * FROM t", "SELECT * FROM (VALUES (1::BIGINT, 10::BIGINT, 'x'), (2, 20, 'yz'), (6, 30, 'w')) t(id, u, s)")
script("fk_update_cascade", "CREATE TABLE p (id INTEGER PRIMARY KEY, code INTEGER UNIQUE); CREATE TABLE c (k INTEGER, pc INTEGER UNIQUE REFERENCES p(code) ON UPDATE CASCADE); CREATE TABLE g (k INTEGER, pc INTEGER REFERENCES c(pc) ON UPDATE SET NULL); INSERT INTO p VALUES (1, 100), (2, 200); INSERT INTO c VALUES (1, 100), (2, 200); INSERT INTO g VALUES (1, 100), (2, 200); UPDATE p SET code = 300 WHERE id = 1; SELECT c.k, c.pc AS pc, g.pc AS gpc FROM c JOIN g ON g.k = c.k", "SELECT * FROM (VALUES (1::BIGINT, 300::BIGINT, NULL::BIGINT), (2, 200, 200)) t(k, pc, gpc)")
script("auto_increment_after_delete", "CREATE TABLE t (id INTEGER PRIMARY KEY AUTO_INCREMENT, s TEXT); INSERT INTO t (s) VALUES ('a'), ('b'); DELETE FROM t WHERE id = 2; INSERT INTO t (s) VALUES ('c'); INSERT INTO t (s) SELECT n_name FROM nation; SELECT MAX(id) AS m, COUNT(DISTINCT id) AS n, MIN(CASE WHEN s = 'c' THEN id END) AS c FROM t", "SELECT count(*) + 3 AS m, count(*) + 2 AS n, 3::BIGINT AS c FROM nation")
script("vacuum", _ITEMS + "UPDATE items SET qty = 1 WHERE id < 5; DELETE FROM items WHERE id > 20; VACUUM", "SELECT 2::BIGINT AS snapshots_removed")


def refused(name: str, text: str, last: str, oracle: str) -> None:
    """The last statement must fail, and the tables must be as before it: the rows of `last`, and that it was refused."""

    def run(spark, sf_dir):
        engine(spark, sf_dir)
        db = Engine(spark)
        *first, bad = statements(text)
        for s in first:
            db.execute(s)
        try:
            db.execute(bad)
            failed = False
        except ConstraintError:
            failed = True
        return naive(db.query(last)).withColumn("refused", F.lit(failed))

    query(name, oracle)(run)


_FAMILY = "CREATE TABLE p (id INTEGER PRIMARY KEY, code INTEGER UNIQUE); CREATE TABLE c (k INTEGER, pid INTEGER REFERENCES p(id), pc INTEGER REFERENCES p(code)); INSERT INTO p VALUES (1, 10), (2, 20); INSERT INTO c VALUES (1, 1, 10); "
_PARENTS = "SELECT * FROM (VALUES (1::BIGINT, 10::BIGINT, true), (2, 20, true)) t(id, code, refused)"
refused("fk_truncate_refused", _FAMILY + "TRUNCATE TABLE p", "SELECT id, code FROM p", _PARENTS)
refused("fk_drop_refused", _FAMILY + "DROP TABLE p", "SELECT id, code FROM p", _PARENTS)
refused("fk_update_refused", _FAMILY + "UPDATE p SET code = 11 WHERE id = 1", "SELECT id, code FROM p", _PARENTS)
refused("pk_update_refused", _FAMILY + "UPDATE p SET id = 9 WHERE id = 2", "SELECT id, code FROM p", _PARENTS)
refused("insert_refused_whole", _FAMILY + "INSERT INTO p VALUES (3, 30), (1, 40)", "SELECT id, code FROM p", _PARENTS)


@query("explain_plan", "SELECT true AS scans, true AS aggregates")
def _explain(spark, sf_dir):
    return engine(spark, sf_dir).execute("EXPLAIN SELECT COUNT(*) FROM orders WHERE o_orderkey > 5").agg(F.bool_or(F.contains("plan", F.lit("Scan parquet"))).alias("scans"), F.bool_or(F.contains("plan", F.lit("HashAggregate"))).alias("aggregates"))


@query("explain_analyze", "SELECT '1 rows in' AS result, 'numOutputRows: ' || count(*) AS scanned FROM orders")
def _explain_analyze(spark, sf_dir):
    told = engine(spark, sf_dir).execute("EXPLAIN ANALYZE SELECT SUM(o_totalprice) AS s FROM orders")
    of = lambda p: F.regexp_extract("plan", p, 0)
    return told.agg(F.max(of("^1 rows in")).alias("result"), F.max(F.when(F.contains("plan", F.lit("Scan parquet")), of("numOutputRows: [0-9]+"))).alias("scanned"))


@query("parameters", "SELECT count(*) AS n FROM orders WHERE o_orderkey > 100 AND o_orderstatus = 'O' AND o_totalprice < 250000.5")
def _parameters(spark, sf_dir):
    db = engine(spark, sf_dir)
    assert db.query("SELECT :a + :b AS x", {"a": 1, "b": 2}).head()[0] == db.prepare("SELECT ? + ? AS x")(1, 2).head()[0]
    return db.query("SELECT COUNT(*) AS n FROM orders WHERE o_orderkey > $1 AND o_orderstatus = $2 AND o_totalprice < $3", [100, "O", 250000.5])


@query("snapshot_restore", _ROWS.format("n_regionkey"))
def _restored(spark, sf_dir):
    engine(spark, sf_dir)
    db = Engine(spark)
    for s in statements(_ITEMS + "CREATE VIEW all_items AS SELECT * FROM items"):
        db.execute(s)
    db.create_snapshot(f"{db.store.folder}/backup")
    db.execute("DELETE FROM items")
    db.restore_snapshot(f"{db.store.folder}/backup")
    return db.query("SELECT * FROM all_items")


@query("transaction_block", "SELECT 0::BIGINT AS n")
def _block(spark, sf_dir):
    db = Engine(spark)
    db.execute("CREATE TABLE t (v INTEGER)")
    try:
        with db.transaction():
            db.execute("INSERT INTO t VALUES (1)")
            raise KeyError
    except KeyError:
        return db.query("SELECT COUNT(*) AS n FROM t")


@query("embed_plugged_in", "SELECT n_name AS name, CAST(length(n_name) AS DOUBLE) AS norm FROM nation")
def _embed(spark, sf_dir):
    """EMBED is a function of the caller's: here, a text's length."""
    engine(spark, sf_dir)
    db = Engine(spark)
    db.functions["EMBED"] = lambda text: f"array(CAST(length({text}) AS DOUBLE))"
    return db.query("SELECT n_name AS name, VEC_NORM(EMBED(n_name)) AS norm FROM nation")


script("pragma_set", "SET isolation_level = 'snapshot'; PRAGMA isolation_level", "SELECT 'isolation_level' AS name, 'snapshot' AS value")


def _copied(form: str):
    def run(spark, sf_dir):
        db = Engine(spark)
        db.execute("CREATE TABLE n (n_nationkey INTEGER, n_name TEXT, n_regionkey INTEGER)")
        path = f"{db.store.folder}/copied.{form}"
        rows = spark.read.parquet(f"{sf_dir}/nation.parquet").withColumn("n_name", F.when(F.col("n_nationkey") != 4, F.col("n_name")))
        if form == "csv":
            rows.write.option("header", True).option("nullValue", "NA").csv(path)
        else:
            rows.write.json(path)
        db.execute(f"COPY n FROM '{path}' WITH (FORMAT {form}, HEADER true, NULL 'NA')")
        return db.query("SELECT * FROM n")

    return run


_COPIED = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE WHEN n_nationkey <> 4 THEN n_name END AS n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"
query("copy_csv_roundtrip", _COPIED)(_copied("csv"))
query("copy_json_roundtrip", _COPIED)(_copied("json"))
