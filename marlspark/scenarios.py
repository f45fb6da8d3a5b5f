"""What the dialect does beside single SELECTs, as queries: scripts whose lines, errors or last rows show the effect, and their SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from . import errors
from .catalog import Database
from .functions.types import ColumnDef, Kind
from .session import HELP, Session
from .sources import files, storage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _values(rows: Iterable[tuple]) -> str:
    """Rows as a VALUES list."""
    def one(value: object) -> str:
        return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)

    return "values " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def _numbered(want: list[str]) -> str:
    return f"select * from ({_values(enumerate(want))}) q(n, line)"


def _lines(spark: SparkSession, lines: Iterable[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(lines)), "n int, line string")


def _session(spark: SparkSession, sf_dir: str, *tables: str) -> Session:
    session = Session.temporary(spark)
    for name in tables:
        session.register_parquet(name, f"{sf_dir}/{name}.parquet")
    return session


def _script(name: str, text: str, want: list[str] | str, *tables: str) -> None:
    """The lines that a script writes to the result file; ``want`` has them, or is the SQL for them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _lines(spark, _session(spark, sf_dir, *tables).script(text))

    QUERIES[name], SQL[name] = run, want if isinstance(want, str) else _numbered(want)


def _sessions(name: str, steps: list[tuple[int, str]], want: list[str]) -> None:
    """Scripts of several sessions on one database in turn; each line begins with the session's number."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        database = Session.temporary(spark).database
        sessions = {k: Session(database) for k, _ in steps}
        return _lines(spark, [f"{k} {line}" for k, text in steps for line in sessions[k].script(text)])

    QUERIES[name], SQL[name] = run, _numbered(want)


def _query(sql: str) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[run.__name__], SQL[run.__name__] = run, sql
        return run

    return add


# results as text
_script(
    "result_file",
    "select n_nationkey, n_name from nation where n_regionkey = 2 order by n_nationkey;",
    "select 0 n, '| n_nationkey | n_name |' line union all select row_number() over (order by n_nationkey)::int, '| ' || n_nationkey || ' | ' || n_name || ' |' from nation where n_regionkey = 2",
    "nation",
)
_script(
    "result_formats",
    "select o_orderkey, o_orderdate, o_totalprice from orders where o_orderkey < 50 order by o_orderkey, o_custkey, o_totalprice;",
    "select 0 n, '| o_orderkey | o_orderdate | o_totalprice |' line union all select row_number() over (order by o_orderkey, o_custkey, o_totalprice)::int, '| ' || o_orderkey || ' | ' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ' | ' || printf('%.6f', o_totalprice) || ' |' from orders where o_orderkey < 50",
    "orders",
)


@_query(
    """with rule as (select '+' || repeat('-', 18) || '+' || repeat('-', 18) || '+' line),
    body as (select row_number() over (order by r_regionkey)::int i, '| ' || lpad(r_regionkey::varchar, 16, ' ') || ' | ' || lpad(r_name, 16, ' ') || ' |' line from region),
    size as (select count(*)::int n from region)
    select 0 n, line from rule union all select 1, '|      r_regionkey |           r_name |' union all select 2, line from rule
    union all select 2 + i, line from body union all select 3 + n, line from rule, size union all select 4 + n, 'Total record(s): ' || n from size"""
)
def client_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _session(spark, sf_dir, "region").sql("select r_regionkey, r_name from region order by r_regionkey;").table()
    return _lines(spark, text.splitlines())


@_query("select count(*)::int n, true truncated from lineitem")
def client_table_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    *_, mark, total = _session(spark, sf_dir, "lineitem").sql("select * from lineitem;").table().splitlines()
    return spark.createDataFrame([(int(total.rpartition(" ")[2]), mark.endswith("... ..."))], "n int, truncated boolean")


@_query(_numbered(["| tag |", "| here |", "rows 1"]))
def session_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _session(spark, sf_dir)
    first.sql("create table t (tag char(4));")
    first.sql("insert into t values ('here');")
    found = Session(first.database).sql("select tag from t;")
    return _lines(spark, [*found.lines(), f"rows {found.frame.count()}"])


# tables from files
@_query("select n_nationkey, n_name, n_regionkey from nation where n_regionkey >= 2")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.scratch(spark, "csv")
    spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").write.mode("overwrite").csv(path, header=True)
    columns = [ColumnDef("n_nationkey", Kind.INT), ColumnDef("n_name", Kind.STRING), ColumnDef("n_regionkey", Kind.INT)]
    session = _session(spark, sf_dir)
    session.sql("create table n (n_nationkey int, n_name char(30), n_regionkey int);")
    session.insert_frame("n", files.csv_frame(spark, path, columns))
    return session.frame("select n_nationkey, n_name, n_regionkey from n where n_regionkey >= 2;").selectExpr("cast(n_nationkey as bigint) n_nationkey", "n_name", "cast(n_regionkey as bigint) n_regionkey")


SQL["csv_scan"] = "select n_nationkey::bigint n_nationkey, n_name, n_regionkey::bigint n_regionkey from nation where n_regionkey >= 2"


@_query("select o_orderkey, o_orderdate::date d, o_totalprice::decimal(14, 2) amount, o_orderstatus = 'F' done from orders where o_orderdate::date >= date '1996-06-01' and o_totalprice::decimal(14, 2) > 150000.5 and o_orderstatus = 'F'")
def parquet_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.scratch(spark, "types")
    spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey", "cast(o_orderdate as date) d", "cast(o_totalprice as decimal(14, 2)) amount", "o_orderstatus = 'F' done", "array(1) left_out").write.mode("overwrite").parquet(path)
    session = _session(spark, sf_dir)
    session.register_parquet("o", path)
    return session.frame("select * from o where d >= '1996-06-01' and amount > 150000.5 and done = true;")


# names, types and errors
_script(
    "name_errors",
    "select nothing from nation; select nation.r_name from nation, region; select n_name from nation order by nothing; select nation.n_name from nation, nation; select count(*) as n from nowhere; select count(*) as n from region;",
    "select * from (select 0 n, 'failure' line union all select 1, 'failure' union all select 2, 'failure' union all select 3, 'failure' union all select 4, 'failure' union all select 5, '| n |' union all select 6, '| ' || count(*) || ' |' from region)",
    "nation",
    "region",
)
_script("value_count_reject", "create table t (a int, b int); insert into t values (1); insert into t values (1, 2, 3); insert into t values (4, 5); select * from t;", ["failure", "failure", "| a | b |", "| 4 | 5 |"])
_script(
    "insert_coercion_reject",
    "create table t (i int, f float, c char(3), at datetime, b bigint); insert into t values (1.5, 1.0, 'a', '2001-01-01 00:00:00', 1); insert into t values (1, 1, 'a', '2001-01-01 00:00:00', 1); insert into t values (1, 1.0, 2, '2001-01-01 00:00:00', 1); insert into t values (1, 1.0, 'long', '2001-01-01 00:00:00', 1); insert into t values (1, 1.0, 'a', '2001-1-1 00:00:00', 1); insert into t values (4294967296, 1.0, 'a', '2001-01-01 00:00:00', 1); insert into t values (1, 1.25, 'abc', '2001-01-01 00:00:00', 7); select * from t;",
    ["failure"] * 6 + ["| i | f | c | at | b |", "| 1 | 1.250000 | abc | 2001-01-01 00:00:00 | 7 |"],
)
_script("update_coercion", "create table t (i int, b bigint, f float); insert into t values (1, 2, 3.5); update t set i = 7.9, b = 4.9, f = 2; update t set i = 4294967296; update t set f = 'x'; select * from t;", ["failure", "failure", "| i | b | f |", "| 7 | 4 | 2.000000 |"])
_script("float_eq_32", "create table t (id int, v float); insert into t values (1, 1.1); insert into t values (2, 1.25); insert into t values (3, 0.1); select id from t where v = 1.1; select id from t where v > 0.1 order by id; select sum(v) as s from t where v = 1.25;", ["| id |", "| 1 |", "| id |", "| 1 |", "| 2 |", "| s |", "| 1.250000 |"])
_script(
    "float_join_key",
    "create table a (x float, tag char(2)); create table b (y int, z bigint, w float); insert into a values (1.1, 'p'); insert into a values (2.0, 'q'); insert into b values (2, 5, 1.1); insert into b values (7, 2, 9.5); select tag, y from a, b where x = w; select tag, z from a, b where x = y; select tag, y from a, b where x = z;",
    ["| tag | y |", "| p | 2 |", "| tag | z |", "| q | 5 |", "| tag | y |", "| q | 7 |"],
)

_ERRORS = [
    ("create table t (id int);", "TableExistsError"),
    ("select * from nowhere;", "TableNotFoundError"),
    ("select nothing from t;", "ColumnNotFoundError"),
    ("select id from t, u;", "AmbiguousColumnError"),
    ("create index t (id);", "IndexExistsError"),
    ("drop index t (name);", "IndexNotFoundError"),
    ("insert into t values (1);", "InvalidValueCountError"),
    ("insert into t values (2, 'toolong', '2000-01-01 00:00:00');", "StringOverflowError"),
    ("insert into t values ('x', 'a', '2000-01-01 00:00:00');", "IncompatibleTypeError"),
    ("insert into t values (2, 'a', '2000-02-30 00:00:00');", "DatetimeError"),
    ("insert into t values (1, 'b', '2000-01-01 00:00:00');", "DuplicateKeyError"),
    ("insert into t values (2147483648, 'b', '2000-01-01 00:00:00');", "IntegerRangeError"),
    ("create table v (x char(0));", "InvalidColLengthError"),
    ("create table v (x char(513));", "InvalidRecordSizeError"),
    ("select id, max(id) from t;", "InternalError"),
    ("selec id from t;", "ParseError"),
]


@_query(f"select * from ({_values(_ERRORS)}) q(statement, error)")
def error_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    session, found = _session(spark, sf_dir), []
    session.script("create table t (id int, name char(4), at datetime); create table u (id int); create index t (id); insert into t values (1, 'a', '2000-01-01 00:00:00');")
    for text, _ in _ERRORS:
        try:
            session.sql(text)
            found.append((text, "none"))
        except errors.DialectError as error:
            found.append((text, type(error).__name__))
    return spark.createDataFrame(found, "statement string, error string")


# tables, indexes and the database
_script("drop_table", "create table a (x int); insert into a values (1); create index a (x); drop table a; select * from a; show index from a; create table a (y int); select count(*) as n from a; drop table a; drop table a;", ["failure", "failure", "| n |", "| 0 |", "failure"])
_script("show_tables", "create table pear (x int); create table apple (x int); create table fig (x int); drop table pear; show tables;", "select row_number() over (order by o)::int - 1 n, line from (values (0, '| Tables |'), (1, '| apple |'), (2, '| fig |'), (3, '| region |')) q(o, line)", "region")
_script("show_index", "create table t (a int, b char(4), c bigint); create index t (a); create index t (b, c); show index from t; drop index t (a); show index from t;", ["| t | unique | (a) |", "| t | unique | (b,c) |", "| t | unique | (b,c) |"])
_script("drop_index", "create table t (a int); create index t (a); insert into t values (1); insert into t values (1); drop index t (a); insert into t values (1); select count(*) as n from t; create index t (a);", ["failure", "| n |", "| 2 |", "failure"])
_script("unique_update_reject", "create table t (k int, v int); insert into t values (1, 1); insert into t values (2, 1); insert into t values (3, 2); create index t (k, v); update t set k = 2 where v = 1; update t set k = 3, v = 2 where k = 1; update t set v = 9; update t set v = 2 where k = 2; select * from t order by k;", ["failure", "failure", "| k | v |", "| 1 | 9 |", "| 2 | 2 |", "| 3 | 9 |"])


@_query(_numbered(["|            Field |             Type |            Index |", "|               id |              INT |               NO |", "|             name |           STRING |               NO |", "|               at |         DATETIME |               NO |", "|                f |            FLOAT |               NO |", "|                b |           BIGINT |               NO |"]))
def desc_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _session(spark, sf_dir)
    session.sql("create table t (id int, name char(9), at datetime, f float, b bigint);")
    return _lines(spark, [x for x in session.sql("desc t;").table().splitlines() if x.startswith("|")])


_STATEMENTS = ["CREATE TABLE", "DROP TABLE", "CREATE INDEX", "DROP INDEX", "SHOW TABLES", "SHOW INDEX", "DESC", "INSERT INTO", "DELETE FROM", "UPDATE", "SELECT", "BEGIN", "COMMIT", "ABORT", "ROLLBACK", "SET ENABLE_NESTLOOP", "SET ENABLE_SORTMERGE"]


@_query(f"select * from ({_values((s, True) for s in _STATEMENTS)}) q(statement, explained)")
def help_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _session(spark, sf_dir).sql("help").message
    return spark.createDataFrame([(s, s in text and text == HELP) for s in _STATEMENTS], "statement string, explained boolean")


_script("exit_and_empty", "create table t (a int); exit; ; insert into t values (1); help; select * from t;", ["| a |", "| 1 |"])


@_query(_numbered(["DatabaseNotFoundError", "created", "DatabaseExistsError", "| a |", "| 5 |", "DatabaseNotFoundError"]))
def database_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, out = f"{storage.scratch(spark, 'lifecycle')}/db", []

    def tried(step: Callable[[], object]) -> None:
        try:
            step()
        except errors.DialectError as error:
            out.append(type(error).__name__)

    tried(lambda: Database.open(spark, path))
    Session(Database.create(spark, path)).script("create table t (a int); insert into t values (5);")
    out.append("created")
    tried(lambda: Database.create(spark, path))
    out += Session(Database.open(spark, path)).script("select * from t;")
    Database.drop(spark, path)
    tried(lambda: Database.open(spark, path))
    return _lines(spark, out)


# transactions
_script(
    "txn_error_abort",
    "create table t (a int); insert into t values (1); begin; insert into t values (2); selec; select count(*) as n from t; insert into t values ('x'); insert into t values (3); abort; select a from t order by a;",
    ["| n |", "| 2 |", "failure", "| a |", "| 1 |", "| 3 |"],
)
_sessions(
    "lock_conflict",
    [(1, "create table t (a int, b int); insert into t values (1, 10); insert into t values (2, 20); insert into t values (3, 30); begin; delete from t where a = 3;"), (2, "select * from t;"), (3, "insert into t values (4, 40);"), (2, "begin; update t set b = 0 where a = 1; select b from t where a = 1; abort;"), (1, "commit;"), (2, "select sum(b) as s from t;")],
    # after its abort session 2 is out of its transaction: the SELECT that follows is one of its own, and conflicts too
    ["2 abort", "3 abort", "2 abort", "2 abort", "2 | s |", "2 | 30 |"],
)
_sessions(
    "lock_shared",
    [(1, "create table t (a int); insert into t values (7); begin; select a from t;"), (2, "begin; select max(a) as m from t;"), (3, "insert into t values (8);"), (1, "commit;"), (3, "insert into t values (8);"), (2, "commit;"), (3, "insert into t values (8); select count(*) as n from t;")],
    ["1 | a |", "1 | 7 |", "2 | m |", "2 | 7 |", "3 abort", "3 abort", "3 | n |", "3 | 2 |"],
)
_sessions(
    "lock_upgrade",
    [(1, "create table t (a int); insert into t values (1); begin; select a from t;"), (1, "update t set a = 2; select a from t;"), (2, "select a from t;"), (1, "commit; begin; select a from t;"), (2, "begin; select a from t;"), (1, "update t set a = 3;"), (2, "update t set a = 4; commit; select a from t;")],
    ["1 | a |", "1 | 1 |", "1 | a |", "1 | 2 |", "2 abort", "1 | a |", "1 | 2 |", "2 | a |", "2 | 2 |", "1 abort", "2 | a |", "2 | 4 |"],
)
_sessions(
    "lock_inserters",
    [(1, "create table t (a int); create index t (a); begin; insert into t values (1);"), (2, "begin; insert into t values (2);"), (3, "begin; insert into t values (1);"), (2, "commit;"), (1, "commit;"), (3, "commit;"), (4, "select a from t order by a;")],
    ["3 failure", "4 | a |", "4 | 1 |", "4 | 2 |"],
)
_sessions(
    "phantom_guard",
    [(1, "create table t (a int); insert into t values (1); begin; select count(*) as n from t where a > 5;"), (2, "insert into t values (9);"), (1, "select count(*) as n from t where a > 5; commit;"), (2, "insert into t values (9);"), (1, "select count(*) as n from t where a > 5;")],
    ["1 | n |", "1 | 0 |", "2 abort", "1 | n |", "1 | 0 |", "1 | n |", "1 | 1 |"],
)
_sessions(
    "isolation",
    [(1, "create table t (a int); insert into t values (1); begin; insert into t values (2); select count(*) as n from t; rollback;"), (2, "begin; insert into t values (3);"), (1, "begin; insert into t values (4); commit;"), (2, "commit; select a from t order by a;")],
    ["1 | n |", "1 | 2 |", "2 | a |", "2 | 1 |", "2 | 3 |", "2 | 4 |"],
)


@_query("select o_orderkey, o_custkey, case when o_orderkey = 3 then 1.5 else o_totalprice end o_totalprice from orders where o_orderkey < 500 and o_orderkey <> 7")
def crash_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two commits, then a crash in the middle of a transaction; a new session finds the commits and nothing of the rest."""
    path = f"{storage.scratch(spark, 'recovery')}/db"
    session = Session(Database.create(spark, path))
    session.register_parquet("orders", f"{sf_dir}/orders.parquet")
    session.script("delete from orders where o_orderkey >= 500; begin; update orders set o_totalprice = 1.5 where o_orderkey = 3; delete from orders where o_orderkey = 7; commit; begin; update orders set o_custkey = 0; delete from orders where o_orderkey < 400; crash")
    return Session(Database.open(spark, path)).frame("select o_orderkey, o_custkey, o_totalprice from orders;")


@_query(_numbered(["| a |", "| 2 |", "InternalError", "parts 1"]))
def commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was committed is there after reopening, who had the database open before cannot commit any more, and no part is left over."""
    path = f"{storage.scratch(spark, 'log')}/db"
    old = Session(Database.create(spark, path))
    old.script("create table t (a int);")
    old.insert_frame("t", spark.range(0, 1, 1, 1).selectExpr("cast(1 as int) a"))
    old.script("update t set a = 2; begin; update t set a = 3;")
    out = Session(Database.open(spark, path)).script("select a from t;")
    try:
        old.sql("commit;")
    except errors.DialectError as error:
        out.append(type(error).__name__)
    parts = [x for x in storage.children(spark, path) if x != "manifest.json"]
    return _lines(spark, [*out, f"parts {len(parts)}"])
