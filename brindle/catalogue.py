"""The registered queries of the relational engine, in its own dialect, and the same in DuckDB's SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.errors import EngineError
from brindle.functions import scalar
from brindle.session import Session

TABLES = tuple("region nation customer supplier part orders lineitem events".split())

#: Name: statements before the last, which is the query. SQL of the oracle where it differs from the dialect's.
DIALECT: dict[str, str] = {
    "scan_all": "SELECT * FROM nation;",
    "filter_int_eq": "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey = 10;",
    "filter_int_range": "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey > 10 AND s_suppkey < 20;",
    "filter_float": "SELECT s_name, s_acctbal FROM supplier WHERE s_acctbal < 3000.0;",
    "filter_string": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING';",
    "filter_string_ne": "SELECT s_suppkey FROM supplier WHERE s_name != 'Supplier#000000001';",
    "filter_time": "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= '1997-01-01' AND o_orderdate < '1997-02-01';",
    "filter_col_col": "SELECT n_name FROM nation WHERE n_nationkey > n_regionkey;",
    "filter_qualified": "SELECT nation.n_name FROM nation WHERE nation.n_nationkey >= 5 AND nation.n_nationkey <= 9;",
    "in_list": "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey IN (1, 2);",
    "in_list_string": "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY');",
    "in_subquery": "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1);",
    "in_subquery_bare": "SELECT s_suppkey FROM supplier WHERE s_nationkey IN SELECT n_nationkey FROM nation WHERE n_regionkey = 2;",
    "scalar_subquery": "SELECT s_name FROM supplier WHERE s_acctbal > (SELECT MAX(s_acctbal) FROM supplier WHERE s_nationkey = 1);",
    "scalar_subquery_string": "SELECT n_nationkey FROM nation WHERE n_name > (SELECT MIN(n_name) AS m FROM nation WHERE n_regionkey = 3);",
    "where_before_from": "SELECT n_name WHERE n_regionkey = 1 FROM nation;",
    "unique": "SELECT UNIQUE c_mktsegment FROM customer;",
    "unique_order": "SELECT UNIQUE c_mktsegment FROM customer ORDER BY c_mktsegment;",
    "unique_hidden_order": "SELECT UNIQUE n_regionkey FROM nation ORDER BY n_name DESC;",
    "order_asc": "SELECT * FROM nation ORDER BY n_regionkey;",
    "order_desc": "SELECT n_nationkey, n_name FROM nation ORDER BY n_name DESC;",
    "order_hidden": "SELECT n_name FROM nation ORDER BY n_nationkey;",
    "join_equi_default": "SELECT s_name, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey;",
    "join_equi_nestloop": "SET enable_nestloop = true; SELECT s_name, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey;",
    "join_equi_sortmerge": "SET enable_sortmerge = true; SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey;",
    "join_equi_hash": "SET enable_hashjoin = true; SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey;",
    "join_theta": "SELECT s_suppkey, n_nationkey FROM supplier, nation WHERE s_nationkey < n_nationkey;",
    "join_theta_hash": "SET enable_hashjoin = true; SELECT s_suppkey, n_nationkey FROM supplier, nation WHERE s_nationkey != n_nationkey;",
    "join_mixed_int": "SELECT s_name, n_name FROM supplier, nation WHERE s_suppkey = n_nationkey;",
    "join_mixed_float": "SELECT n_name, l_orderkey, l_linenumber FROM lineitem, nation WHERE l_quantity = n_nationkey;",
    "join_multi_cond": "SELECT s_suppkey, c_custkey FROM supplier, customer WHERE s_nationkey = c_nationkey AND s_suppkey < c_custkey AND s_acctbal > c_acctbal;",
    "join_string_key": "SELECT r_name, n_name FROM region, nation WHERE r_name < n_name AND r_regionkey = n_regionkey;",
    "join_three": "SELECT c_name, o_orderkey, l_linenumber FROM customer, orders, lineitem WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND l_quantity > 45.0;",
    "join_five": "SELECT r_name, n_name, s_name, l_orderkey, l_linenumber, o_orderpriority FROM lineitem, orders, supplier, nation, region"
    " WHERE l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND l_quantity > 40.0;",
    "join_keyword": "SELECT r_name, n_name FROM region JOIN nation WHERE r_regionkey = n_regionkey;",
    "cross": "SELECT r_name, n_nationkey FROM region, nation;",
    "cross_filtered": "SELECT r_name, n_name FROM region JOIN nation WHERE n_name > 'M';",
    "agg_count": "SELECT COUNT(*) AS n FROM lineitem;",
    "agg_count_col": "SELECT COUNT(c_name) AS n FROM customer;",
    "agg_sum": "SELECT SUM(n_nationkey) AS s FROM nation;",
    "agg_max": "SELECT MAX(s_acctbal) AS m, MAX(s_name) AS name FROM supplier;",
    "agg_min": "SELECT MIN(s_acctbal) AS m, MIN(s_name) AS name FROM supplier;",
    "agg_default_names": "SELECT MAX(n_nationkey), COUNT(*) FROM nation;",
    "agg_where": "SELECT COUNT(*) AS n, MAX(l_quantity) AS q FROM lineitem WHERE l_discount > 0.05 AND l_returnflag = 'R';",
    "agg_join": "SELECT COUNT(*) AS n, MAX(o_totalprice) AS top FROM orders, customer WHERE o_custkey = c_custkey AND c_mktsegment = 'BUILDING';",
    "agg_empty": "SELECT COUNT(*) AS n, SUM(s_nationkey) AS s, MIN(s_name) AS m FROM supplier WHERE s_suppkey < 0;",
    "group_by": "SELECT l_returnflag, COUNT(*) AS n, MIN(l_quantity) AS q FROM lineitem GROUP BY l_returnflag;",
    "group_by_two": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_linenumber) AS s FROM lineitem GROUP BY l_returnflag, l_linestatus;",
    "group_by_join": "SELECT n_name, COUNT(*) AS n, MAX(s_acctbal) AS top FROM supplier, nation WHERE s_nationkey = n_nationkey GROUP BY n_name;",
    "group_by_only": "SELECT c_mktsegment FROM customer GROUP BY c_mktsegment;",
    "having": "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey HAVING COUNT(*) > 50;",
    "having_hidden_agg": "SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey HAVING MAX(l_quantity) >= 50.0 AND MIN(l_linenumber) = 1;",
    "order_by_alias": "SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey ORDER BY n DESC;",
    "order_by_group": "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY o_orderpriority;",
    "opt_range": "SELECT s_suppkey FROM supplier WHERE s_suppkey < 30 AND s_suppkey < 20 AND s_suppkey < 10;",
    "opt_contradiction": "SELECT s_suppkey FROM supplier WHERE s_suppkey < 10 AND s_suppkey > 20;",
    "opt_eq_absorb": "SELECT s_suppkey FROM supplier WHERE s_suppkey = 5 AND s_suppkey < 10 AND s_suppkey != 7;",
    "opt_transitive": "SELECT s_name, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey AND s_nationkey < 10 AND n_nationkey > 5;",
    "opt_transitive_empty": "SELECT s_name, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey AND s_nationkey < 5 AND n_nationkey > 10;",
    "optimizer_off": "SET enable_optimizer = false; SELECT s_name, n_name FROM supplier, nation, region"
    " WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND s_suppkey < 30 AND s_suppkey < 20;",
    "optimizer_on": "SELECT s_name, n_name FROM supplier, nation, region WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND s_suppkey < 30 AND s_suppkey < 20;",
}

ORACLE: dict[str, str] = {
    "in_subquery_bare": "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)",
    "where_before_from": "SELECT n_name FROM nation WHERE n_regionkey = 1",
    "unique": "SELECT DISTINCT c_mktsegment FROM customer",
    "unique_order": "SELECT DISTINCT c_mktsegment FROM customer ORDER BY c_mktsegment",
    "unique_hidden_order": "SELECT n_regionkey FROM nation GROUP BY n_regionkey ORDER BY max(n_name) DESC",
    "join_keyword": "SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey",
    "cross_filtered": "SELECT r_name, n_name FROM region, nation WHERE n_name > 'M'",
    "agg_sum": "SELECT CAST(sum(n_nationkey) AS BIGINT) AS s FROM nation",
    "agg_default_names": 'SELECT max(n_nationkey) AS "MAX(n_nationkey)", count(*) AS "COUNT(*)" FROM nation',
    "agg_empty": "SELECT count(*) AS n, CAST(sum(s_nationkey) AS BIGINT) AS s, min(s_name) AS m FROM supplier WHERE s_suppkey < 0",
    "group_by_two": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag, l_linestatus",
}

#: Statements that change a copy of nation (name, key, region), and what it holds then.
CHANGES: dict[str, tuple[str, str]] = {
    "dml_insert": ("INSERT INTO t VALUES (100, 'ATLANTIS', 9);", "SELECT * FROM n UNION ALL SELECT 100, 'ATLANTIS', 9"),
    "dml_delete": ("DELETE FROM t WHERE r = 1;", "SELECT * FROM n WHERE r <> 1"),
    "dml_delete_subquery": ("DELETE FROM t WHERE r IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA');", "SELECT * FROM n WHERE r NOT IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')"),
    "dml_update_where": ("UPDATE t SET name = 'X', r = 7 WHERE k > 20;", "SELECT k, CASE WHEN k > 20 THEN 'X' ELSE name END AS name, CASE WHEN k > 20 THEN 7 ELSE r END AS r FROM n"),
    "dml_update_arith": ("UPDATE t SET r = k + 1, k = k * 2;", "SELECT k * 2 AS k, name, k + 1 AS r FROM n"),
    "dml_update_div": ("UPDATE t SET r = k / 7 WHERE k >= 0;", "SELECT k, name, k // 7 AS r FROM n"),
    "txn_commit": ("BEGIN; DELETE FROM t WHERE k = 3; INSERT INTO t VALUES (50, 'Y', 1); COMMIT;", "SELECT * FROM n WHERE k <> 3 UNION ALL SELECT 50, 'Y', 1"),
    "txn_rollback": ("BEGIN; DELETE FROM t; INSERT INTO t VALUES (50, 'Y', 1); ROLLBACK;", "SELECT * FROM n"),
    "index_unique": ("CREATE INDEX t (k); INSERT INTO t VALUES (60, 'Z', 2);", "SELECT * FROM n UNION ALL SELECT 60, 'Z', 2"),
    "dml_update_subquery": ("UPDATE t SET r = 9 WHERE k > (SELECT MAX(r_regionkey) FROM region);", "SELECT k, name, CASE WHEN k > (SELECT max(r_regionkey) FROM region) THEN 9 ELSE r END AS r FROM n"),
    "index_after_changes": ("CREATE INDEX t (k); INSERT INTO t VALUES (60, 'Z', 2); DELETE FROM t WHERE k = 3; UPDATE t SET r = 8 WHERE k = 4;", "SELECT k, name, CASE WHEN k = 4 THEN 8 ELSE r END AS r FROM n WHERE k <> 3 UNION ALL SELECT 60, 'Z', 2"),
    "checkpoint": ("INSERT INTO t VALUES (70, 'C', 0); CREATE STATIC_CHECKPOINT;", "SELECT * FROM n UNION ALL SELECT 70, 'C', 0"),
}

#: Statements on such a copy whose last is the query, and the SQL of its rows.
READS: dict[str, tuple[str, str]] = {
    "index_scan": ("CREATE INDEX t (k); SELECT * FROM t WHERE k = 7;", "SELECT * FROM n WHERE k = 7"),
    "index_after_insert": ("CREATE INDEX t (k); INSERT INTO t VALUES (60, 'Z', 2); SELECT name, r FROM t WHERE k >= 20;", "SELECT name, r FROM n WHERE k >= 20 UNION ALL SELECT 'Z', 2"),
    "index_merge_join": (
        "CREATE TABLE u (j INT, y INT); INSERT INTO u VALUES (3, 30); INSERT INTO u VALUES (24, 31); CREATE INDEX t (k); CREATE INDEX u (j); INSERT INTO u VALUES (7, 32);"
        " SET enable_sortmerge = true; SELECT name, y FROM t, u WHERE k = j;",
        "SELECT name, y FROM n, (VALUES (3, 30), (24, 31), (7, 32)) AS u(j, y) WHERE k = j",
    ),
    "agg_metadata": ("INSERT INTO t VALUES (80, 'M', 5); SELECT COUNT(*) AS c, MIN(k) AS a, MAX(k) AS b, SUM(r) AS s FROM t;", "SELECT count(*) + 1 AS c, min(k) AS a, 80 AS b, CAST(sum(r) + 5 AS BIGINT) AS s FROM n"),
    "agg_count_after_delete": ("DELETE FROM t WHERE r = 1; SELECT COUNT(*) AS c FROM t;", "SELECT count(*) AS c FROM n WHERE r <> 1"),
    "show_tables": ("SHOW TABLES;", f"SELECT unnest({[*TABLES, 't']}) AS \"Tables\""),
    "drop_table": ("CREATE TABLE u (a INT); DROP TABLE u; SHOW TABLES;", f"SELECT unnest({[*TABLES, 't']}) AS \"Tables\""),
    "describe": ("CREATE INDEX t (k); DESC t;", "SELECT * FROM (VALUES ('k', 'INT', 'YES'), ('name', 'CHAR(25)', 'NO'), ('r', 'INT', 'NO')) AS d(\"Field\", \"Type\", \"Index\")"),
    "show_index": ("CREATE INDEX t (k); CREATE INDEX t (name, k); SHOW INDEX FROM t;", "SELECT * FROM (VALUES ('t', 'unique', '(k)'), ('t', 'unique', '(name,k)')) AS d(\"Table\", \"Kind\", \"Columns\")"),
    "drop_index": ("CREATE INDEX t (k); CREATE INDEX t (name); DROP INDEX t (k); SHOW INDEX FROM t;", "SELECT 't' AS \"Table\", 'unique' AS \"Kind\", '(name)' AS \"Columns\""),
}


def database_folder(spark: SparkSession) -> str:
    """A new folder for a database, in the folder that the cluster shares; a temporary one only where there is no cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise EngineError("spark.checkpoint.dir names no folder that the cluster shares")
        shared = tempfile.mkdtemp(prefix="database-")
    return f"{shared.rstrip('/')}/database-{uuid.uuid4().hex}"


def _select(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Session.over(spark, sf_dir, TABLES).script(text)[-1]

    return run


def _copy_of_nation(spark: SparkSession, sf_dir: str, root: str) -> Session:
    """A database with a table t that was loaded from a delimited file of nation."""
    session = Session(spark, root)
    for name in TABLES:
        session.catalog.attach(name, f"{sf_dir}/{name}.parquet")
    session.execute("CREATE TABLE t (k INT NOT NULL, name CHAR(25), r INT);")
    line = F.concat_ws("|", "n_nationkey", "n_name", "n_regionkey", F.lit(""))
    spark.read.parquet(f"{sf_dir}/nation.parquet").select(line.alias("value")).write.text(f"{root}/nation.tbl")
    session.load(f"{root}/nation.tbl", "t")
    return session


def _changed(statements: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = _copy_of_nation(spark, sf_dir, database_folder(spark))
        session.script(statements)
        return session.query("SELECT * FROM t;")

    return run


def _read(statements: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _copy_of_nation(spark, sf_dir, database_folder(spark)).script(statements)[-1]

    return run


def hash_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per brand, how many hashes its rows have, and whether another brand has the same."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand", scalar.hash_value(F.col("p_brand"), F.lit(1)).alias("h"))
    shared = rows.groupBy("h").agg(F.countDistinct("p_brand").alias("brands"))
    return rows.join(shared, "h").groupBy("p_brand").agg(F.countDistinct("h").alias("hashes"), F.max("brands").alias("brands"))


def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions of the column API over part."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        "p_partkey",
        scalar.modulo(size, F.lit(7)).alias("m"),
        scalar.arithmetic("/", size, F.lit(4), True).cast("int").alias("d"),
        scalar.square_root(size.cast("double")).alias("root"),
        scalar.smaller(size, F.lit(20)).alias("low"),
        scalar.larger(price, F.lit(1000.0)).alias("high"),
        scalar.cast_as(size, "string").alias("text"),
        scalar.same(size, F.lit(None).cast("int")).alias("none"),
    )


SCALAR_SQL = """SELECT p_partkey, p_size % 7 AS m, CAST(p_size // 4 AS INTEGER) AS d, sqrt(CAST(p_size AS DOUBLE)) AS root, least(p_size, 20) AS low,
 greatest(p_retailprice, 1000.0) AS high, CAST(p_size AS VARCHAR) AS text, p_size IS NULL AS none FROM part"""

FLAGSHIP = "SELECT s_name, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey AND s_suppkey < 10 ORDER BY s_name;"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(FLAGSHIP)(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: _select(text) for name, text in DIALECT.items()}
    found |= {name: _changed(statements) for name, (statements, _) in CHANGES.items()}
    return found | {"flagship": flagship, "load_tbl": _changed(""), "scalar_functions": scalar_functions, "hash_function": hash_function} | {name: _read(statements) for name, (statements, _) in READS.items()}


def oracle_sql() -> dict[str, str]:
    nation = "WITH n AS (SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation) "
    found = {name: ORACLE.get(name, text.split(";")[-2].strip()) for name, text in DIALECT.items()}
    found |= {name: nation + sql for name, (_, sql) in (CHANGES | READS).items()}
    found["hash_function"] = "SELECT DISTINCT p_brand, CAST(1 AS BIGINT) AS hashes, CAST(1 AS BIGINT) AS brands FROM part"
    return found | {"flagship": FLAGSHIP.rstrip(";"), "load_tbl": nation + "SELECT * FROM n", "scalar_functions": SCALAR_SQL}
