"""The dialect against golden scripts and worked-out results."""

import pytest

from marlspark import errors as E
from marlspark.catalog import Database
from marlspark.plans import parser
from marlspark.plans.statements import Aggregate, ColumnRef, Control, Select
from marlspark.session import HELP, Session
from marlspark.sources import files
from marlspark.functions.types import ColumnDef, Kind

@pytest.fixture
def s(spark):
    from marlspark.sources import storage

    return Session(Database.create(spark, storage.scratch(spark, "test")))


SCRIPTS = [
    (
        """create table m (id int, val float, tag char(8));
        insert into m values (2, 6.5, 'p'); insert into m values (4, 3.5, 'q'); insert into m values (6, 3.5, 'r');
        select SUM(id) as s from m; select sum(val) as s from m; select MAX(id) as hi from m; select MIN(val) as lo from m;
        select COUNT(*) as n from m; select count(tag) as n from m where val = 3.5; select max(tag) as t from m;""",
        ["| s |", "| 12 |", "| s |", "| 13.500000 |", "| hi |", "| 6 |", "| lo |", "| 3.500000 |", "| n |", "| 3 |", "| n |", "| 2 |", "| t |", "| r |"],
    ),
    (
        """create table o (who char(10), num int);
        insert into o values ('AB', 7); insert into o values ('AC', 9); insert into o values ('AD', 9); insert into o values ('B', 1);
        select who, num from o order by num, who; select who, num from o order by num desc, who asc limit 2; select who from o order by who desc limit 1;""",
        ["| who | num |", "| B | 1 |", "| AB | 7 |", "| AC | 9 |", "| AD | 9 |", "| who | num |", "| AC | 9 |", "| AD | 9 |", "| who |", "| B |"],
    ),
    (
        """create table l (id int, n char(8)); create table r (k int, v float);
        insert into l values (1, 'x'); insert into l values (2, 'y'); insert into r values (1, 10.5); insert into r values (2, 20.5); insert into r values (3, 30.5);
        select * from l, r where l.id = r.k order by l.id; select n, v from l, r where l.id < r.k and r.k < 3;""",
        ["| id | n | k | v |", "| 1 | x | 1 | 10.500000 |", "| 2 | y | 2 | 20.500000 |", "| n | v |", "| x | 20.500000 |"],
    ),
    (
        """create table stock (part int, bin char(4), held int);
        insert into stock values (11, 'a1', 5); insert into stock values (12, 'b7', 0); insert into stock values (13, 'c2', 8);
        begin; update stock set held = 1 where held > 4; insert into stock values (14, 'd9', 2); select sum(held) as t from stock; rollback;
        select part, held from stock where held > 0 order by part desc;
        begin; delete from stock where bin = 'b7'; update stock set bin = 'zz' where part = 13; commit; select bin from stock order by bin;""",
        ["| t |", "| 4 |", "| part | held |", "| 13 | 8 |", "| 11 | 5 |", "| bin |", "| a1 |", "| zz |"],
    ),
]


@pytest.mark.parametrize("text, want", SCRIPTS)
def test_scripts(s, text, want):
    assert s.script(text) == want


def test_parser():
    assert parser.parse("SeLeCt a, t.b FROM t JOIN u WHERE a<-3 AND b = 'x--y' ORDER BY a DESC, b LIMIT 2;") == Select(
        ["t", "u"], [ColumnRef("a"), ColumnRef("b", "t")],
        [parser.Condition(ColumnRef("a"), "<", parser.Literal(-3)), parser.Condition(ColumnRef("b"), "=", parser.Literal("x--y"))],
        [parser.OrderKey(ColumnRef("a"), True), parser.OrderKey(ColumnRef("b"))], 2,
    )
    assert parser.parse("select count(*) as n, sum(a) from t; -- rest").columns == [Aggregate("COUNT", None, "n"), Aggregate("SUM", ColumnRef("a"))]
    assert parser.parse("/* x */ help") == Control("HELP") and parser.parse(" ") == Control("EMPTY")
    assert parser.parse("select # a from t;") == parser.parse("select a from t;")
    assert parser.parse("select a from t where b = 3.;").where[0].right == parser.Literal(3.0)
    for bad in ("select a from t", "select a from t where 1 = a;", "select from t;", "create table t (count int);", "select a, sum( from t;", "insert into t (a) values (1);", "select a from t where a = 1 or b = 2;", "select a from t group by a;", "select distinct a from t;"):
        with pytest.raises(E.ParseError):
            parser.parse(bad)
    # "!" is no token of the dialect, and such characters are skipped
    assert parser.parse("select a from t where a != 1;").where[0].op == "="
    with pytest.raises(E.IntegerRangeError):
        parser.parse("select a from t where a = 9223372036854775808;")


def test_errors(s):
    s.sql("create table t (id int, name char(4), f float, at datetime, b bigint);")
    s.sql("create table u (id int, g float);")
    for text, error in (
        ("create table t (id int);", E.TableExistsError),
        ("create table v (x char(0));", E.InvalidColLengthError),
        ("create table v (x char(600));", E.InvalidRecordSizeError),
        ("select * from nowhere;", E.TableNotFoundError),
        ("select nothing from t;", E.ColumnNotFoundError),
        ("select u.name from t, u;", E.ColumnNotFoundError),
        ("select id from t, u;", E.AmbiguousColumnError),
        ("select t.id from t, t;", E.AmbiguousColumnError),
        ("select name from t order by nothing;", E.ColumnNotFoundError),
        ("select id, sum(f) from t;", E.InternalError),
        ("select sum(f), id from t;", E.InternalError),
        ("select sum(at) from t;", E.IncompatibleTypeError),
        ("select id from t where name = 3;", E.IncompatibleTypeError),
        ("select id from t where id = 'x';", E.IncompatibleTypeError),
        ("select id from t where name = id;", E.IncompatibleTypeError),
        ("select id from t where name = 'toolong';", E.StringOverflowError),
        ("select id from t where at = '2023-2-3 00:00:00';", E.DatetimeError),
        ("insert into t values (1, 'a', 1.0, '2000-01-01 00:00:00');", E.InvalidValueCountError),
        ("insert into t values (1, 'a', 1, '2000-01-01 00:00:00', 1);", E.IncompatibleTypeError),
        ("insert into t values (1.0, 'a', 1.0, '2000-01-01 00:00:00', 1);", E.IncompatibleTypeError),
        ("insert into t values (3000000000, 'a', 1.0, '2000-01-01 00:00:00', 1);", E.IntegerRangeError),
        ("insert into t values (1, 'ééé', 1.0, '2000-01-01 00:00:00', 1);", E.StringOverflowError),
        ("update t set id = 3000000000;", E.IntegerRangeError),
        ("update t set nothing = 1;", E.ColumnNotFoundError),
        ("drop index t (id);", E.IndexNotFoundError),
        ("create index t (nothing);", E.ColumnNotFoundError),
        ("drop table nowhere;", E.TableNotFoundError),
    ):
        with pytest.raises(error):
            s.sql(text)
    for bad in ("1999-13-07 12:30:00", "1999-02-30 12:30:00", "0999-01-01 00:00:00", "1999-01-01 24:00:00", "1999-01-01 00:60:00", "1900-02-29 00:00:00", "1999-01-01 1a:00:00", "1999-01-01"):
        with pytest.raises(E.DatetimeError):
            s.sql(f"insert into t values (1, 'a', 1.0, '{bad}', 1);")


def test_coercion(s):
    s.script("create table t (i int, b bigint, f float); insert into t values (2, 5000000000, 1.1); insert into t values (3, 2, 2.5); insert into t values (-2, -1, 0.1);")

    def ids(where):
        return sorted(r[0] for r in s.frame(f"select i from t where {where};").collect())

    assert ids("f = 1.1") == [2]  # in 32 bits
    assert ids("i >= 2.5") == [2, 3]  # the fraction is cut off
    assert ids("i > -2.9") == [2, 3]
    assert ids("b < 2.5") == [-2, 3] and ids("b = 5000000000") == [2]
    assert ids("i < 5000000000") == [-2, 2, 3] and ids("f < 2") == [-2, 2]
    assert ids("i > f") == [2, 3] and ids("i = b") == [] and ids("b < i") == [3]
    s.script("update t set i = 7.9, f = 4 where b = 2; update t set b = 1.5 where i = 2;")
    assert sorted(map(tuple, s.frame("select i, b from t;").collect())) == [(-2, -1), (2, 1), (7, 2)]


def test_aggregates_over_nothing(s):
    s.sql("create table t (i int, f float, c char(4));")
    assert s.script("select count(*), sum(i), sum(f), max(i), min(c) from t;") == ["|  | i | f | i | c |", "| 0 | 0 | 0.000000 |  |  |"]
    s.script("insert into t values (2147483647, 1.5, ''); insert into t values (2147483647, 2.5, 'a');")
    assert s.script("select sum(i) as s, min(c) as c, max(f) as m from t limit 0;")[1] == "| 4294967294 |  | 2.500000 |"


def test_limits_and_order(s):
    s.script("create table t (a int, c char(3)); insert into t values (1, 'b'); insert into t values (2, 'a'); insert into t values (3, 'b');")
    assert s.script("select a from t order by c desc, a limit 2;") == ["| a |", "| 1 |", "| 3 |"]
    assert len(s.script("select a from t limit 0;")) == len(s.script("select a from t limit -1;")) == 4
    assert s.script("select a, a from t where a > 10 and a < 5;") == ["| a | a |"]


def test_joins(s):
    s.script("create table a (x int, p char(2)); create table b (y int, x int); create table c (z float);")
    s.script("insert into a values (1, 'a'); insert into a values (2, 'b'); insert into b values (1, 10); insert into b values (2, 20); insert into c values (1.0); insert into c values (2.5);")

    def rows(text):
        return sorted(map(tuple, s.frame(text).collect()))

    assert rows("select p, y from a, b where a.x = b.y;") == [("a", 1), ("b", 2)]
    assert rows("select a.x, z from a join c where a.x = z;") == [(1, 1.0)]
    assert rows("select a.x, z from a, c where z > a.x;") == [(1, 2.5), (2, 2.5)]
    assert len(rows("select * from a, b, c;")) == 8
    assert rows("select p from a, b where b.x > b.y and b.y = 1;") == [("a",), ("b",)]
    assert rows("select p, z from a, b, c where a.x = y and y <= z and z <> 1.0;") == [("a", 2.5), ("b", 2.5)]
    s.script("set enable_nestloop = false;")
    with pytest.raises(E.InternalError):
        s.sql("select p from a, b where a.x = b.y;")
    s.script("set enable_sortmerge = true;")
    frame = s.frame("select p, y from a, b where a.x = b.y;")
    assert "SortMergeJoin" in frame._jdf.queryExecution().toString() and len(frame.collect()) == 2


def test_large_product_is_streamed(spark):
    """join_bushy beyond Spark's broadcasts: no side of the product is held as a whole, and all cores take part."""
    from marlspark import queries

    sf, kept = "/root/testdata/sf0.1", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        frame = queries.QUERIES["join_bushy"](spark, sf)
        assert frame.rdd.getNumPartitions() >= 4
        counted = frame.selectExpr("count(*)", "sum(hash(r_name, n_name) % 1000 * (s_suppkey + 7 * c_custkey % 13))")
        (n, total), plan = counted.collect()[0], counted._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" in plan
    # the sides' own sums: the product is of all rows of the one with all rows of the other
    region, nation, supplier, customer = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("region", "nation", "supplier", "customer"))
    a = region.join(nation, region.r_regionkey == nation.n_regionkey).selectExpr("count(*)", "sum(hash(r_name, n_name) % 1000)").first()
    b = supplier.join(customer, supplier.s_nationkey == customer.c_nationkey).selectExpr("count(*)", "sum(s_suppkey + 7 * c_custkey % 13)").first()
    assert (n, total) == (a[0] * b[0], a[1] * b[1])


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_products_of_any_size(s, spark, monkeypatch, threshold):
    """The same rows as from small products: of joined groups in any order, single tables, empty ones, with and without broadcasts."""
    from marlspark.operators import join

    s.script("create table a (x int, p char(2)); create table b (y int, x int); create table c (z float); create table d (w int, v int); create table e (u int);")
    s.script("insert into a values (1, 'a'); insert into a values (2, 'b'); insert into b values (1, 10); insert into b values (2, 20); insert into b values (2, 30); insert into c values (1.0); insert into c values (2.5); insert into d values (10, 1); insert into d values (20, 2);")
    texts = ["select * from a, c;", "select * from c, a, d;", "select * from a, b, c where a.x = y;", "select * from c, a, b, d where a.x = y;", "select p, b.x, z, v from c, d, a, b where a.x < y and z > v;", "select * from a, d, e;", "select count(*) as n, sum(w) as t from a, d;", "select p, z from a, c order by p desc, z limit 3;"]
    want = [sorted(map(tuple, s.frame(t).collect())) for t in texts]
    assert list(map(len, want)) == [4, 8, 6, 12, 4, 0, 1, 3]
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(join, "LARGE_PRODUCT", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        assert [sorted(map(tuple, s.frame(t).collect())) for t in texts] == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_unique_indexes(s):
    s.script("create table w (id int, k char(4), v int); create index w (id); create index w (k, v);")
    out = s.script("insert into w values (1, 'a', 1); insert into w values (2, 'a', 2); insert into w values (1, 'z', 9); insert into w values (3, 'a', 2); update w set id = 2 where id = 1; update w set v = 2; select * from w order by id; show index from w;")
    assert out == ["failure"] * 4 + ["| id | k | v |", "| 1 | a | 1 |", "| 2 | a | 2 |", "| w | unique | (id) |", "| w | unique | (k,v) |"]
    assert s.script("create index w (id); drop index w (v,k); drop index w (id); insert into w values (1, 'q', 1); create index w (id); show index from w;") == ["failure", "failure", "failure", "| w | unique | (k,v) |"]
    # setting every column of a composite key changes the row in place
    assert s.script("update w set k = 'n', v = 7 where id = 2; select k, v from w where id = 2;") == ["| k | v |", "| n | 7 |"]


def test_bulk_insert(s, spark):
    s.script("create table t (id int, name char(3)); create index t (id);")
    s.insert_frame("t", spark.createDataFrame([("a", 1), ("b", 2)], "name string, id long"))
    with pytest.raises(E.DuplicateKeyError):
        s.insert_frame("t", spark.createDataFrame([("c", 3), ("d", 2)], "name string, id long"))
    with pytest.raises(E.InvalidValueCountError):
        s.insert_frame("t", spark.createDataFrame([(3,)], "id long"))
    assert s.script("select * from t order by id;") == ["| id | name |", "| 1 | a |", "| 2 | b |"]


def test_many_single_inserts_are_settled(s):
    from marlspark import catalog

    s.sql("create table t (id int);")
    s.script("begin;" + "".join(f"insert into t values ({i});" for i in range(catalog.ROW_BUFFER + 5)) + "commit;")
    table = s.database.table("t")
    assert len(table.parts) == 1 and not table.rows
    assert s.script("select count(*) as n, sum(id) as t from t;")[1] == "| 505 | 127260 |"


def test_show_desc_help(s):
    s.script("create table b (x int, y char(3)); create table a (z datetime);")
    assert s.script("show tables;") == ["| Tables |", "| a |", "| b |"]
    assert s.script("desc b;") == []
    rule = ("+" + "-" * 18) * 3 + "+\n"
    assert s.sql("desc b;").table() == rule + "|            Field |             Type |            Index |\n" + rule + "|                x |              INT |               NO |\n|                y |           STRING |               NO |\n" + rule
    assert s.sql("help").message == HELP and s.sql("exit;").lines() == []


def test_client_table(s):
    s.script("create table t (c char(40), f float); insert into t values ('a text of more than sixteen', 1.5);")
    rule = ("+" + "-" * 18) * 2 + "+\n"
    assert s.sql("select * from t;").table() == rule + "|                c |                f |\n" + rule + "| a text of mor... |         1.500000 |\n" + rule + "Total record(s): 1\n"
    s.script("begin;" + "insert into t values ('x', 1.0);" * 300 + "commit;")
    text = s.sql("select * from t;").table()
    assert len(text) < 8192 and text.endswith("... ...\nTotal record(s): 301\n")


def test_transactions(s):
    s.script("create table t (a int); insert into t values (1);")
    assert s.script("begin; insert into t values (2); update t set a = 5 where a = 1; select a from t order by a;") == ["| a |", "| 2 |", "| 5 |"]
    assert s.script("rollback; select a from t;") == ["| a |", "| 1 |"]
    # an error ends the whole transaction, a syntax error does not
    assert s.script("begin; insert into t values (3); selec; select a from t where a = 3; insert into t values ('x'); commit; select a from t;") == ["| a |", "| 3 |", "failure", "| a |", "| 1 |"]
    assert s.script("commit; abort; begin; begin; insert into t values (4); commit; select count(*) as n from t;") == ["| n |", "| 2 |"]


# by what they do to a table: its lock, and a statement that takes it
DEEDS = {"read": ("S", "select count(*) as n from {};"), "add": ("IX", "insert into {} values (5);"), "change": ("SIX", "update {} set a = a0 where a = 1;".replace("a0", "6"))}


@pytest.mark.parametrize("first", DEEDS)
@pytest.mark.parametrize("second", DEEDS)
def test_no_waiting(s, first, second):
    """Each pair of deeds on one table: the second is aborted unless both read or both add, and nothing of it stays."""
    other, name = Session(s.database), f"t_{first}_{second}"
    s.script(f"create table {name} (a int); insert into {name} values (1); create table free (a int); insert into free values (1);")
    s.script(f"begin; {DEEDS[first][1].format(name)}")
    together = DEEDS[first][0] == DEEDS[second][0] != "SIX"
    got = other.script(f"begin; {DEEDS[second][1].format(name)}")
    assert ("abort" not in got) == together
    # other tables are free meanwhile
    assert "abort" not in Session(s.database).script(DEEDS[second][1].format("free"))
    s.script("commit;")
    other.script("commit;" if together else f"begin; {DEEDS[second][1].format(name)} commit;")
    rows = 1 + (first == "add") + (second == "add")
    assert s.script(f"select count(*) as n from {name};") == ["| n |", f"| {rows} |"]


def test_concurrent_inserters_keep_keys_unique(s):
    other = Session(s.database)
    s.script("create table c (id int); create index c (id);")
    s.script("begin; insert into c values (3);")
    other.script("begin; insert into c values (3);")
    s.script("commit;")
    assert other.script("commit;") == ["failure"]
    assert s.script("select count(*) as n from c;")[1] == "| 1 |"


def test_recovery(s, spark):
    s.script("create table t1 (id int, num int); begin; insert into t1 values (1, 1); commit;")
    s.script("begin; insert into t1 values (2, 2); update t1 set num = 7;")  # and no commit
    again = Session(Database.open(spark, s.database.path))
    assert again.script("select * from t1;") == ["| id | num |", "| 1 | 1 |"]
    from marlspark.sources import storage

    assert storage.children(spark, s.database.path) == ["manifest.json"]
    with pytest.raises(E.DatabaseExistsError):
        Database.create(spark, s.database.path)
    Database.drop(spark, s.database.path)
    with pytest.raises(E.DatabaseNotFoundError):
        Database.open(spark, s.database.path)


def test_typed_rows_survive_reopening(s, spark):
    s.script("create table t (a bigint, f float, at datetime, c char(9)); insert into t values (5000000000, 1.1, '1999-07-07 12:30:00', 'it|s');")
    want = ["| a | f | at | c |", "| 5000000000 | 1.100000 | 1999-07-07 12:30:00 | it|s |"]
    assert s.script("select * from t where f = 1.1;") == want
    assert Session(Database.open(spark, s.database.path)).script("select * from t where f = 1.1;") == want


def test_csv_tables(s, spark, tmp_path):
    (tmp_path / "orders.csv").write_text("o_id,o_entry_d,o_amount\n1,2020-02-03 04:05:06,1.5\n2,2021-02-03 04:05:06,2.5\n")
    columns = [ColumnDef("o_id", Kind.INT), ColumnDef("o_entry_d", Kind.DATETIME), ColumnDef("o_amount", Kind.FLOAT)]
    s.sql("create table orders (o_id int, o_entry_d datetime, o_amount float);")
    s.insert_frame("orders", files.csv_frame(spark, str(tmp_path / "orders.csv"), columns))
    assert s.script("select o_id from orders where o_entry_d > '2020-12-31 00:00:00';") == ["| o_id |", "| 2 |"]


def test_plans_push_down(spark, tmp_path):
    s = Session.temporary(spark)
    spark.range(100).selectExpr("id", "id % 7 as k", "'x' as unused").write.parquet(str(tmp_path / "t"))
    s.register_parquet("t", str(tmp_path / "t"))
    plan = s.frame("select id from t where k = 3;")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(k), EqualTo(k,3)]" in plan and "unused" not in plan
    assert "TakeOrderedAndProject" in s.frame("select id from t order by k limit 3;")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("op", ["=", "<>", "<", "<=", ">", ">="])
def test_literals_are_folded(spark, tmp_path, op):
    import operator

    s, values = Session.temporary(spark), [-9, 0, 6, 7, 8, 2**60, None]
    spark.createDataFrame([(v, v if v is None or v < 2**31 else 3) for v in values], "b long, i int").write.parquet(str(tmp_path / "t"))
    s.register_parquet("t", str(tmp_path / "t"))
    compare = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}[op]
    for literal in ("7.5", "7.0", "-9.25", "1152921504606846976", "99999999999999999999999.0", "-99999999999999999999999.5"):
        frame = s.frame(f"select b from t where b {op} {literal};")
        exact = float(literal) if "." in literal else int(literal)
        assert sorted(r.b for r in frame.collect()) == sorted(v for v in values if v is not None and compare(v, exact)), literal
        assert "cast(b" not in frame._jdf.queryExecution().executedPlan().toString()
    for literal in ("3000000000", "-3000000000"):
        got = s.frame(f"select i from t where i {op} {literal};").count()
        assert got == (6 if compare(0, int(literal)) else 0)
    plan = s.frame("select b from t where b < 7.5;")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(b,7)" in plan


def test_all_plain_types_of_files(spark, tmp_path):
    s = Session.temporary(spark)
    rows = "select 1 as i, date '2020-02-03' as d, timestamp '2020-02-03 04:05:06' as t, cast(12.50 as decimal(8, 2)) as m, true as b, array(1) as a union all select 2, date '2021-02-03', timestamp '2021-02-03 04:05:06', cast(99 as decimal(8, 2)), false, null"
    spark.sql(rows).coalesce(1).write.parquet(str(tmp_path / "t"))
    s.register_parquet("t", str(tmp_path / "t"))
    assert s.script("select * from t where i = 1;") == ["| i | d | t | m | b |", "| 1 | 2020-02-03 | 2020-02-03 04:05:06 | 12.50 | true |"]
    for where, want in (("d = '2020-02-03'", 1), ("d < '2021-02-03 00:00:01'", 2), ("d >= '2021-02-03 00:00:01'", 0), ("t > '2020-12-31 00:00:00'", 1), ("m = 12.5", 1), ("m >= 12", 2), ("b = false", 1), ("b <> false and m < 13", 1), ("d < t", 2)):
        assert s.frame(f"select i from t where {where};").count() == want, where
    assert s.script("select sum(m) as s, max(d) as d, min(t) as t from t;")[1] == "| 111.50 | 2021-02-03 | 2020-02-03 04:05:06 |"
    s.script("update t set m = 7.126, d = '1999-12-31', b = true where i = 2; insert into t values (3, '2001-01-01', '2001-01-01 00:00:00', 1, false);")
    assert s.script("select i, d, m, b from t order by i;")[2:] == ["| 2 | 1999-12-31 | 7.13 | true |", "| 3 | 2001-01-01 | 1.00 | false |"]
    for bad in ("b = 1", "d = 5", "m = 'x'", "b < true", "d = '2020-2-3'"):
        with pytest.raises(E.DialectError):
            s.sql(f"select i from t where {bad};")
    plan = s.frame("select i from t where d = '2020-02-03';")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan


def files_of(s, name):
    table = s.database.table(name)
    return {f for p in table.parts for f in s.database.files_of(table, p)}


def test_changes_write_only_files_they_touch(spark, tmp_path):
    from marlspark.sources import storage

    s = Session(Database.create(spark, str(tmp_path / "db")))
    spark.range(0, 1000, 1, 10).selectExpr("id", "id % 7 as k").write.parquet(str(tmp_path / "t"))
    s.register_parquet("t", str(tmp_path / "t"))
    before = files_of(s, "t")
    s.script("update t set k = 100 where id = 250;")
    after = files_of(s, "t")
    assert len(before & after) == 9 and spark.read.parquet(*[f for f in after - before]).count() == 100
    s.script("delete from t where id >= 900; update t set k = 3 where id = 5000;")
    assert len(before & files_of(s, "t")) == 8 and files_of(s, "t") >= after - {f for f in after if f in before}
    assert s.script("select count(*) as n, max(id) as m, max(k) as k from t;")[1] == "| 900 | 899 | 100 |"
    assert Session(Database.open(spark, s.database.path)).script("select count(*) as n, max(k) as k from t where id >= 200;")[1] == "| 700 | 100 |"
    # what commits no longer name goes after a few more of them
    s = Session(Database.open(spark, s.database.path))
    for k in range(20):
        s.script(f"update t set k = {k} where id = 250;")
    parts = [c for c in storage.children(spark, s.database.path) if c != "manifest.json"]
    assert len(parts) <= 12 and s.script("select k from t where id = 250;")[1] == "| 19 |"
    s.database.vacuum()
    assert len([c for c in storage.children(spark, s.database.path) if c != "manifest.json"]) <= 3
    assert s.script("delete from t; select count(*) as n from t;") == ["| n |", "| 0 |"]


def test_key_checks_do_not_shuffle_the_table(spark, tmp_path, monkeypatch):
    spark.range(5000).selectExpr("cast(id as int) as id", "id % 7 as k").write.parquet(str(tmp_path / "t"))
    s = Session.temporary(spark)
    s.register_parquet("t", str(tmp_path / "t"))
    s.script("create index t (id);")
    plans, kind = [], type(spark.range(1))
    inner = kind.isEmpty
    monkeypatch.setattr(kind, "isEmpty", lambda f: (plans.append(f._jdf.queryExecution().executedPlan().toString()), inner(f))[1])
    assert s.script("insert into t values (77, 1); insert into t values (5000, 1);") == ["failure"]
    assert len(plans) == 2 and all("Exchange" not in p and "EqualTo(id" in p for p in plans)
    plans.clear()
    s.insert_frame("t", spark.createDataFrame([(6000 + i, 1) for i in range(50)], "id int, k long"))
    assert "BroadcastHashJoin" in plans[-1] and "Exchange hashpartitioning" not in plans[-1]
    plans.clear()
    assert s.script("update t set id = 9 where id = 10;") == ["failure"]
    assert "EqualTo(id,9)" in plans[-1]


def test_an_index_prunes(spark, tmp_path):
    spark.range(200_000).selectExpr("cast((id * 7919) % 200000 as int) as id", "id as v").write.parquet(str(tmp_path / "t"))
    s = Session.temporary(spark)
    s.sql("create table t (id int, v bigint);")
    s.insert_frame("t", spark.read.parquet(str(tmp_path / "t")))

    def rows_read():
        frame = s.frame("select v from t where id >= 1000 and id < 1200;")
        assert len(frame.collect()) == 200
        node = frame._jdf.queryExecution().executedPlan()
        while node.children().size() or "AdaptiveSparkPlan" in node.nodeName():
            node = node.executedPlan() if "AdaptiveSparkPlan" in node.nodeName() else node.children().head()
        return node.metrics().apply("numOutputRows").value()

    assert rows_read() > 150_000
    s.sql("create index t (id);")
    assert rows_read() <= 40_000
    # rows that come later are clustered among themselves
    s.insert_frame("t", spark.range(200_000, 300_000).selectExpr("cast(id as int) as id", "id as v"))
    assert rows_read() <= 40_000


def test_client_fetches_what_it_shows(spark, tmp_path, monkeypatch):
    s, kind, fetched = Session.temporary(spark), type(spark.range(1)), []
    spark.range(100_000).write.parquet(str(tmp_path / "t"))
    s.register_parquet("t", str(tmp_path / "t"))
    inner = kind.collect
    monkeypatch.setattr(kind, "collect", lambda f: (rows := inner(f), fetched.append(len(rows)))[0])
    assert s.sql("select id from t;").table().endswith("... ...\nTotal record(s): 100000\n") and max(fetched) < 500


def test_drop_table_and_its_parts(spark, tmp_path):
    from marlspark.sources import storage

    s = Session(Database.create(spark, str(tmp_path / "db")))
    s.sql("create table t (a int);")
    s.insert_frame("t", spark.range(5).selectExpr("cast(id as int) as a"))
    s.script("create index t (a); drop table t;")
    assert s.script("select * from t; show tables;") == ["failure", "| Tables |"]
    s.database.vacuum()
    assert storage.children(spark, s.database.path) == ["manifest.json"]


def test_crash_and_takeover(spark, tmp_path):
    s = Session(Database.create(spark, str(tmp_path / "db")))
    assert s.script("create table t (a int); insert into t values (1); begin; insert into t values (2); crash; select * from t;") == []
    with pytest.raises(E.InternalError):
        s.sql("select * from t;")
    again = Session(Database.open(spark, str(tmp_path / "db")))
    assert again.script("select * from t;") == ["| a |", "| 1 |"]
    (tmp_path / "db" / "notes.txt").write_text("not of the database")
    third = Session(Database.open(spark, str(tmp_path / "db")))
    assert (tmp_path / "db" / "notes.txt").exists()
    assert again.script("insert into t values (3);") == ["failure"] and third.script("insert into t values (4); select count(*) as n from t;") == ["| n |", "| 2 |"]


def test_a_neighbour_folder_is_not_the_databases(spark, tmp_path):
    s = Session(Database.create(spark, str(tmp_path / "wh")))
    spark.range(3).write.parquet(str(tmp_path / "wh2" / "t"))
    s.register_parquet("t", str(tmp_path / "wh2" / "t"))
    assert s.script("select count(*) as n, max(id) as m from t; delete from t where id = 1; select count(*) as n from t;") == ["| n | m |", "| 3 | 2 |", "| n |", "| 2 |"]
    s.database.vacuum()
    assert spark.read.parquet(str(tmp_path / "wh2" / "t")).count() == 3


def test_scratch_folders_can_be_released(spark):
    from marlspark.sources import storage

    with storage.scope(spark):
        inner = storage.scratch(spark, "test")
        with storage.scope(spark):
            innermost = storage.scratch(spark, "test")
        assert not storage.exists(spark, innermost) and storage.exists(spark, inner)
    path = storage.scratch(spark, "test")
    assert not storage.exists(spark, inner) and storage.exists(spark, path)
    assert storage.release(spark) >= 1 and not storage.exists(spark, path) and storage.release(spark) == 0


def test_streams(spark, tmp_path):
    from marlspark.streaming.continuous import continuous

    spark.range(20).selectExpr("cast(id as int) as id", "id % 3 as k").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, k long").parquet(str(tmp_path / "in"))
    names = spark.createDataFrame([(0, "zero"), (1, "one")], "n long, name string")
    query = continuous("select id, name from s, names where k = n and id > 10;", {"s": stream, "names": names}).writeStream.format("memory").queryName("dialect_stream").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(tuple(r) for r in spark.table("dialect_stream").collect()) == [(12, "zero"), (13, "one"), (15, "zero"), (16, "one"), (18, "zero"), (19, "one")]
    with pytest.raises(E.InternalError):
        continuous("delete from s;", {"s": stream})
