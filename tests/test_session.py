"""Tables that change: a small school database with hand-computed answers, indexes, transactions, errors, rendering."""

import json

import pytest

from brindle import errors
from brindle.catalogue import TABLES
from brindle.session import Session

SCHOOL = """
CREATE TABLE student (s_id INTEGER NOT NULL, s_name VARCHAR(25) NOT NULL, s_age INTEGER NOT NULL, s_birthday DATETIME);
CREATE TABLE teacher (t_id INTEGER, t_name VARCHAR(25), t_age INTEGER, t_birthday DATETIME);
CREATE TABLE course (c_id INTEGER, c_name VARCHAR(25), c_teacher INTEGER);
CREATE TABLE sc (sc_sid INTEGER, sc_cid INTEGER);
"""
STUDENTS = [(5, "aaa", 21, "1996-01-23"), (1, "bbb", 25, "2001-02-03"), (4, "ccc", 30, "2002-01-23"), (2, "ddd", 22, "1994-08-12"), (3, "eee", 35, "2000-01-23"), (3, "eee", 35, "2000-01-23"), (6, "fff", 35, "1999-01-23")]
TEACHERS = [(1, "aaa", 35, "1999-01-23"), (2, "ddd", 49, "1979-01-23"), (3, "bbb", 50, "1959-01-23"), (4, "ccc", 33, "1993-01-23")]
COURSES = [(1, "math", 1), (2, "english", 2), (3, "dbms", 3)]
TAKEN = [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (1, 2), (3, 2), (5, 2), (2, 3), (4, 3), (5, 3), (6, 3)]


def fill(session, tmp_path):
    session.script(SCHOOL)
    for name, rows in (("student", STUDENTS), ("teacher", TEACHERS), ("course", COURSES), ("sc", TAKEN)):
        path = tmp_path / f"{name}.tbl"
        path.write_text("".join("|".join(map(str, r)) + "|\n" for r in rows))
        session.load(str(path), name)
    session.wait()


@pytest.fixture(scope="module")
def school(spark, tmp_path_factory):
    session = Session(spark, str(tmp_path_factory.mktemp("school") / "db"))
    fill(session, tmp_path_factory.mktemp("files"))
    return session


def values(session, text):
    return [tuple(r) for r in session.query(text).collect()]


def test_school_reads(school):
    assert len(values(school, "SELECT * FROM student;")) == 7
    assert len(values(school, "SELECT UNIQUE * FROM student;")) == 6
    assert len(values(school, "SELECT s_id FROM student WHERE s_age = 35;")) == 3
    assert len(values(school, "SELECT UNIQUE s_id FROM student WHERE s_age = 35;")) == 2
    assert values(school, "SELECT s_birthday FROM student WHERE s_age = 35 ORDER BY s_birthday;") == [("1999-01-23",), ("2000-01-23",), ("2000-01-23",)]
    assert len(values(school, "SELECT s_name, c_name FROM student, sc, course WHERE s_id = sc_sid AND sc_cid = c_id;")) == 14
    assert len(values(school, "SELECT s_id FROM student WHERE s_age IN (SELECT t_age FROM teacher);")) == 3


def test_every_join_strategy_gives_the_same(school):
    text = "SELECT s_name, c_name FROM student, sc, course WHERE s_id = sc_sid AND sc_cid = c_id;"
    expected = sorted(values(school, text))
    for knob in ("enable_nestloop", "enable_sortmerge", "enable_hashjoin"):
        session = Session(school.spark, school.catalog.root)
        session.execute(f"SET {knob} = true;")
        assert sorted(values(session, text)) == expected
        session.execute("SET enable_optimizer = false;")
        assert sorted(values(session, text)) == expected


def test_statistics_follow_a_load(school):
    stats = school.catalog.table("student").statistics
    assert (stats.rows, stats.least["s_age"], stats.most["s_age"], stats.distinct["s_id"]) == (7, 21, 35, 6)


def test_changes_and_transactions(spark, tmp_path):
    session = Session(spark, str(tmp_path / "db"))
    fill(session, tmp_path)
    session.execute("DELETE FROM student WHERE s_id = 6;")
    assert len(values(session, "SELECT * FROM student;")) == 6
    session.script("BEGIN; UPDATE student SET s_age = s_age + 1 WHERE s_id = 1; INSERT INTO student VALUES (9, 'x', 1, '2000-01-01');")
    assert values(session, "SELECT s_age FROM student WHERE s_id = 1;") == [(26,)]
    other = Session(spark, session.catalog.root)
    assert values(other, "SELECT s_age FROM student WHERE s_id = 1;") == [(25,)]
    session.execute("ROLLBACK;")
    assert values(session, "SELECT s_age FROM student WHERE s_id = 1;") == [(25,)]
    # two transactions on one table: the second to commit gives way
    other.script("BEGIN; DELETE FROM sc WHERE sc_sid = 1;")
    session.script("BEGIN; DELETE FROM sc WHERE sc_sid = 2; COMMIT;")
    with pytest.raises(errors.TransactionAbort):
        other.execute("COMMIT;")
    assert len(values(other, "SELECT * FROM sc;")) == 10
    # on different tables both commit
    other.script("BEGIN; DELETE FROM course WHERE c_id = 3;")
    session.execute("DELETE FROM teacher WHERE t_id = 4;")
    other.execute("COMMIT;")
    fresh = Session(spark, session.catalog.root)
    assert (len(values(fresh, "SELECT * FROM course;")), len(values(fresh, "SELECT * FROM teacher;"))) == (2, 3)


def test_unique_index(spark, tmp_path):
    session = Session(spark, str(tmp_path / "db"))
    session.script("CREATE TABLE t (a INT, b FLOAT, c VARCHAR(4)); INSERT INTO t VALUES (1, 2, 'x'); INSERT INTO t VALUES (2, -2.5, 'y'); CREATE INDEX t (a);")
    with pytest.raises(errors.DuplicateKey):
        session.execute("INSERT INTO t VALUES (1, 3.0, 'z');")
    with pytest.raises(errors.DuplicateKey):
        session.execute("UPDATE t SET a = 7;")
    with pytest.raises(errors.IndexExists):
        session.execute("CREATE INDEX t (a);")
    with pytest.raises(errors.IndexNotFound):
        session.execute("DROP INDEX t (b);")
    assert values(session, "SHOW INDEX FROM t;") == [("t", "unique", "(a)")]
    assert values(session, "DESC t;") == [("a", "INT", "YES"), ("b", "FLOAT", "NO"), ("c", "VARCHAR(4)", "NO")]
    assert sorted(values(session, "SELECT * FROM t;")) == [(1, 2.0, "x"), (2, -2.5, "y")]
    session.script("DROP INDEX t (a); INSERT INTO t VALUES (1, 1.0, 'w');")
    with pytest.raises(errors.DuplicateKey):
        session.execute("CREATE INDEX t (a);")
    with pytest.raises(errors.StringTooLong):
        session.execute("INSERT INTO t VALUES (5, 1.0, 'vwxyz');")
    with pytest.raises(errors.ValueCountMismatch):
        session.execute("INSERT INTO t VALUES (5);")
    session.execute("DROP TABLE t;")
    with pytest.raises(errors.TableNotFound):
        session.execute("SELECT * FROM t;")


@pytest.mark.parametrize(
    "text, error",
    [
        ("SELECT * FROM nowhere;", errors.TableNotFound),
        ("SELECT x FROM nation;", errors.ColumnNotFound),
        ("SELECT n_name FROM nation WHERE n_name = 5;", errors.IncompatibleTypes),
        ("SELECT n_name FROM nation WHERE n_nationkey IN (1, 'a');", errors.IncompatibleTypes),
        ("SELECT SUM(n_name) FROM nation;", errors.IncompatibleTypes),
        ("SELECT n_name, COUNT(*) FROM nation;", errors.IllegalAggregation),
        ("SELECT n_name FROM nation WHERE COUNT(*) > 1;", errors.IllegalAggregation),
        ("SELECT n_name FROM nation WHERE n_nationkey > (SELECT n_nationkey FROM nation);", errors.IllegalSubquery),
        ("SELECT n_name FROM nation WHERE n_nationkey > (SELECT n_nationkey FROM nation WHERE n_nationkey < 0);", errors.IllegalSubquery),
        ("SELECT n_name FROM nation WHERE n_nationkey IN (SELECT * FROM nation);", errors.IllegalSubquery),
        ("DELETE FROM nation;", errors.EngineError),
    ],
)
def test_errors(spark, sf_dir, text, error):
    with pytest.raises(error):
        Session.over(spark, sf_dir, TABLES).query(text)


def test_no_strategy_left(spark, sf_dir):
    session = Session.over(spark, sf_dir, TABLES)
    session.script("SET enable_nestloop = false; SET enable_sortmerge = false; SET enable_hashjoin = false;")
    with pytest.raises(errors.NoJoinStrategy):
        session.query("SELECT * FROM region, nation WHERE r_regionkey = n_regionkey;")


@pytest.mark.parametrize("knob, node", [("enable_nestloop", "CartesianProduct"), ("enable_sortmerge", "SortMergeJoin"), ("enable_hashjoin", "ShuffledHashJoin")])
def test_plans_follow_knobs(spark, sf_dir, knob, node):
    session = Session.over(spark, sf_dir, TABLES)
    session.execute(f"SET {knob} = true;")
    plan = session.query("SELECT s_name, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey;")._jdf.queryExecution().executedPlan().toString()
    assert node in plan


def test_plans_push_filters_and_prune(spark, sf_dir):
    session = Session.over(spark, sf_dir, TABLES)
    plan = session.query("SELECT s_name FROM supplier WHERE s_suppkey < 30 AND s_suppkey < 20;")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(s_suppkey,20)" in plan and "s_acctbal" not in plan and "30" not in plan
    plan = session.query("SELECT s_name FROM supplier WHERE s_suppkey < 10 AND s_suppkey > 20;")._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in plan and "<empty>" in plan


def test_rendering(school, tmp_path):
    table = school.shown("SELECT c_id, c_name FROM course ORDER BY c_id;")
    assert "|             c_id |           c_name |" in table and table.endswith("Total record(s): 3\n")
    assert school.shown("SELECT c_id FROM course WHERE c_id > 9;") == "empty set\n"
    assert school.shown("SELECT x FROM course;") == "Column not found: x\n"
    shown = json.loads(school.shown("SELECT c_name FROM course ORDER BY c_name;", as_json=True))
    assert shown["data"] == [["c_name"], ["dbms"], ["english"], ["math"]] and shown["total"] == 3
    session = Session(school.spark, school.catalog.root, output_path=str(tmp_path / "output.txt"))
    session.script("SET output_file = true; SELECT c_id FROM course ORDER BY c_id;")
    assert (tmp_path / "output.txt").read_text() == "| c_id |\n| 1 |\n| 2 |\n| 3 |\n"
    assert "CREATE TABLE" in session.shown("HELP;")


def test_index_merge_join_needs_no_exchange(spark, tmp_path):
    session = Session(spark, str(tmp_path / "db"))
    session.script("CREATE TABLE a (k INT, x INT); CREATE TABLE b (j INT, y INT);")
    for name in "ab":
        (tmp_path / f"{name}.tbl").write_text("".join(f"{i}|{i * 2}|\n" for i in range(500)))
        session.load(str(tmp_path / f"{name}.tbl"), name)
    session.script("CREATE INDEX a (k); CREATE INDEX b (j); SET enable_sortmerge = true;")
    for reader in (session, Session(spark, session.catalog.root)):
        reader.execute("SET enable_sortmerge = true;")
        rows = reader.query("SELECT x, y FROM a, b WHERE k = j;")
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert rows.count() == 500
    # changes keep the layout: joins need no exchange
    session.script("INSERT INTO a VALUES (1000, 1); DELETE FROM a WHERE k = 3; UPDATE a SET x = 0 WHERE k = 4;")
    (tmp_path / "a.tbl").write_text("2000|1|\n2001|2|\n")
    session.load(str(tmp_path / "a.tbl"), "a")
    for _ in range(2):
        rows = session.query("SELECT x, y FROM a, b WHERE k = j;")
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and rows.count() == 499
        assert session.query("SELECT * FROM a;").count() == 502
        looked_up = session.query("SELECT x FROM a WHERE k = 4;")
        assert "EqualTo(k,4)" in looked_up._jdf.queryExecution().executedPlan().toString() and looked_up.first().x == 0
        session.execute("CREATE STATIC_CHECKPOINT;")
        assert session.catalog.table("a").buckets and not session.catalog.table("a").dead
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("brindle_")]


def test_another_sessions_commit_is_seen(spark, tmp_path):
    a = Session(spark, str(tmp_path / "db"))
    a.script("CREATE TABLE t (x INT);")
    b = Session(spark, a.catalog.root)
    assert values(b, "SELECT * FROM t;") == []
    a.execute("INSERT INTO t VALUES (1);")
    assert values(b, "SELECT * FROM t;") == [(1,)]
    # single statements of two sessions follow one another
    b.execute("INSERT INTO t VALUES (2);")
    a.execute("DELETE FROM t WHERE x = 1;")
    assert values(b, "SELECT * FROM t;") == [(2,)]
    # a transaction keeps to what it began with
    b.execute("BEGIN;")
    assert values(b, "SELECT * FROM t;") == [(2,)]
    a.execute("INSERT INTO t VALUES (3);")
    assert values(b, "SELECT * FROM t;") == [(2,)]
    b.execute("COMMIT;")
    assert sorted(values(b, "SELECT * FROM t;")) == [(2,), (3,)]


def test_write_skew_is_refused(spark, tmp_path):
    a = Session(spark, str(tmp_path / "db"))
    a.script("CREATE TABLE t (x INT); CREATE TABLE u (x INT); INSERT INTO t VALUES (1); INSERT INTO u VALUES (1);")
    b = Session(spark, a.catalog.root)
    for session, read, write in ((a, "t", "u"), (b, "u", "t")):
        session.execute("BEGIN;")
        assert values(session, f"SELECT COUNT(*) FROM {read};") == [(1,)]
        session.execute(f"DELETE FROM {write};")
    a.execute("COMMIT;")
    with pytest.raises(errors.TransactionAbort):
        b.execute("COMMIT;")
    assert (values(b, "SELECT * FROM t;"), values(b, "SELECT * FROM u;")) == ([(1,)], [])


def test_changes_rewrite_only_files_with_hits(spark, tmp_path):
    session = Session(spark, str(tmp_path / "db"))
    session.execute("CREATE TABLE t (k INT, x INT);")
    for part in range(3):
        (tmp_path / "t.tbl").write_text("".join(f"{part * 100 + i}|{i}|\n" for i in range(100)))
        session.load(str(tmp_path / "t.tbl"), "t")
        session.wait()
    before = session.catalog.table("t").paths
    session.script("DELETE FROM t WHERE k = 105; UPDATE t SET x = 1000 WHERE k = 107;")
    after = session.catalog.table("t")
    assert after.paths[:2] == (before[0], before[2]) and len(after.paths) == 3 and not after.dead
    assert sorted(values(session, "SELECT * FROM t;")) == [(i, 1000 if i == 107 else i % 100) for i in range(300) if i != 105]
    session.execute("DELETE FROM t;")
    assert values(session, "SELECT COUNT(*) FROM t;") == [(0,)] and not session.catalog.table("t").paths


def test_insertions_are_merged(spark, tmp_path, monkeypatch):
    from brindle.sources import catalog

    monkeypatch.setattr(catalog, "FAN", 3)
    session = Session(spark, str(tmp_path / "db"))
    session.script("CREATE TABLE t (k INT NOT NULL); CREATE INDEX t (k);" + "".join(f"INSERT INTO t VALUES ({i});" for i in range(10)))
    assert len(session.catalog.table("t").paths) == 2
    assert sorted(values(session, "SELECT * FROM t;")) == [(i,) for i in range(10)]
    with pytest.raises(errors.DuplicateKey):
        session.execute("INSERT INTO t VALUES (4);")


def test_aggregates_from_statistics_need_no_scan(school, spark, tmp_path):
    def plan(session, text):
        return session.query(text)._jdf.queryExecution().executedPlan().toString()

    text = "SELECT COUNT(*), MIN(s_age), MAX(s_age), SUM(s_id) FROM student;"
    assert "FileScan" not in plan(school, text) and values(school, text) == [(7, 21, 35, 24)]
    assert "FileScan" in plan(school, "SELECT COUNT(*) FROM student WHERE s_age > 30;") and "FileScan" in plan(school, "SELECT MAX(s_name) FROM student;")
    session = Session(spark, str(tmp_path / "db"))
    session.script("CREATE TABLE t (k INT, f FLOAT); INSERT INTO t VALUES (5, 1.5); INSERT INTO t VALUES (-2, 2.5);")
    (tmp_path / "t.tbl").write_text("9|0.5|\n7|0.25|\n")
    session.load(str(tmp_path / "t.tbl"), "t")
    assert values(session, "SELECT COUNT(*), MIN(k), MAX(k), SUM(k), MAX(f) FROM t;") == [(4, -2, 9, 19, 2.5)]
    assert "FileScan" not in plan(session, "SELECT MIN(k) FROM t;") and "FileScan" in plan(session, "SELECT SUM(f) FROM t;")
    session.execute("DELETE FROM t WHERE k = 9;")
    assert "FileScan" in plan(session, "SELECT MAX(k) FROM t;") and values(session, "SELECT MAX(k) FROM t;") == [(7,)]
    assert "FileScan" not in plan(session, "SELECT COUNT(*) FROM t;") and values(session, "SELECT COUNT(*) FROM t;") == [(3,)]


def test_every_error_of_loads_shows(spark, tmp_path):
    session = Session(spark, str(tmp_path / "db"))
    session.execute("CREATE TABLE t (a INT, b VARCHAR(3) NOT NULL);")
    for name, body in (("one", "x|y|\n"), ("two", "1|long|\n"), ("three", "1|abc|\n")):
        (tmp_path / f"{name}.tbl").write_text(body)
        session.load(str(tmp_path / f"{name}.tbl"), "t")
    with pytest.raises(errors.LoadFault) as found:
        session.execute("SHOW TABLES;")
    assert [type(e) for e in found.value.others] == [errors.StringTooLong]
    assert values(session, "SELECT * FROM t;") == [(1, "abc")]


def test_a_negative_square_root_is_an_error(spark):
    from pyspark.sql import functions as F

    from brindle.functions import scalar

    with pytest.raises(Exception, match="negative"):
        spark.range(1).select(scalar.square_root(F.lit(-1.0))).collect()


def test_clients_over_tcp(spark, tmp_path):
    import socket
    import threading

    from brindle.server import serve

    with serve(spark, str(tmp_path / "db"), 0) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()

        def ask(client, text):
            client.sendall(text.encode())
            got = b""
            while not got.endswith(b"\0"):
                got += client.recv(4096)
            return got[:-1].decode()

        with socket.create_connection(server.server_address) as one, socket.create_connection(server.server_address) as two:
            assert ask(one, "CREATE TABLE t (a INT, b CHAR(3));") == ""
            assert ask(one, "INSERT INTO t VALUES (1, ';');") == "1 row(s)\n"
            assert "Total record(s): 1" in ask(two, "SELECT * FROM t;")
            assert ask(two, "SELECT * FROM nowhere;") == "Table not found: nowhere\n"
        server.shutdown()


def test_load_faults_show_in_the_next_statement(spark, tmp_path):
    session = Session(spark, str(tmp_path / "db"))
    session.execute("CREATE TABLE t (a INT, b VARCHAR(3) NOT NULL);")
    for body, error in (("x|y|\n", errors.LoadFault), ("1|long|\n", errors.StringTooLong), ("1\n", errors.NullViolation)):
        (tmp_path / "t.tbl").write_text(body)
        session.load(str(tmp_path / "t.tbl"), "t")
        with pytest.raises(error):
            session.execute("SHOW TABLES;")
    (tmp_path / "t.csv").write_text("1|a\n-2|b|more\n")
    session.load(str(tmp_path / "t.csv"), "t")
    assert sorted(values(session, "SELECT * FROM t;")) == [(-2, "b"), (1, "a")]
    session.drop_database()
    assert values(session, "SHOW TABLES;") == []
