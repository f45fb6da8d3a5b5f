"""The dialect's operators as queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import scenarios
from .session import Session

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# name: (statements, the last one a SELECT; column names; SQL)
_Q: dict[str, tuple[str, list[str], str]] = {}


def _add(name: str, text: str, columns: str, sql: str | None = None) -> None:
    """Without ``sql`` the last statement is the SQL too, its columns renamed."""
    names = columns.split()
    body = sql or text.strip().rstrip(";").rpartition(";")[2]
    _Q[name] = (text, names, f"select * from ({body}) q({', '.join(names)})")


# scans, columns and filters
_add("scan_star", "select * from nation;", "n_nationkey n_name n_regionkey")
_add("project_cols", "select o_orderkey, o_totalprice from orders;", "o_orderkey o_totalprice")
_add("project_repeat", "select n_name, n_nationkey, n_name from nation;", "name_a n_nationkey name_b")
_add("project_qualified", "select nation.n_name, nation.n_regionkey from nation;", "n_name n_regionkey")
_add("filter_eq_str", "select c_custkey, c_mktsegment from customer where c_mktsegment = 'BUILDING';", "c_custkey c_mktsegment")
_add("filter_lt_str", "select c_custkey, c_mktsegment from customer where c_mktsegment < 'C';", "c_custkey c_mktsegment")
_add("filter_ne", "select event_id, event_type from events where event_type <> 'click';", "event_id event_type")
_add("filter_lt", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity < 10.0;", "l_orderkey l_linenumber l_quantity")
_add("filter_le", "select p_partkey, p_size from part where p_size <= 10;", "p_partkey p_size")
_add("filter_gt", "select l_orderkey, l_quantity from lineitem where l_quantity > 45.0;", "l_orderkey l_quantity")
_add("filter_ge", "select p_partkey, p_size from part where p_size >= 40;", "p_partkey p_size")
_add("filter_and", "select l_orderkey, l_linenumber, l_extendedprice from lineitem where l_quantity >= 10.0 and l_discount > 0.05 and l_returnflag = 'R';", "l_orderkey l_linenumber l_extendedprice")
_add("filter_datetime_range", "select o_orderkey, o_orderdate from orders where o_orderdate >= '1996-01-01 00:00:00' and o_orderdate < '1997-01-01 00:00:00';", "o_orderkey o_orderdate")
_add("filter_col_col", "select l_orderkey, l_linenumber, l_discount, l_tax from lineitem where l_discount < l_tax;", "l_orderkey l_linenumber l_discount l_tax")
_add("filter_col_col_mixed", "select p_partkey, p_size from part where p_size > p_partkey;", "p_partkey p_size")
_add("filter_int_trunc", "select p_partkey, p_size from part where p_size >= 2.5;", "p_partkey p_size", "select p_partkey, p_size from part where p_size >= 2")
_add("filter_bigint_lit", "select o_orderkey, o_custkey from orders where o_custkey = 7;", "o_orderkey o_custkey")
_add("filter_bigint_float", "select o_orderkey, o_custkey from orders where o_custkey < 7.5;", "o_orderkey o_custkey")
_add("filter_int_big_literal", "select p_partkey, p_size from part where p_size < 3000000000;", "p_partkey p_size")
_add("filter_contradiction", "select p_partkey from part where p_size > 10 and p_size < 5;", "p_partkey")

# indexes: the same filters, with a unique key in the catalog
_add("index_point", "create index events (event_id); select event_id, event_type from events where event_id = 42;", "event_id event_type")
_add("index_range", "create index orders (o_orderkey); select o_orderkey, o_custkey from orders where o_orderkey >= 100 and o_orderkey < 300;", "o_orderkey o_custkey")
_add("index_prefix", "create index part (p_partkey, p_size); select p_partkey, p_size, p_name from part where p_partkey = 17 and p_size > 0;", "p_partkey p_size p_name")
_add("index_full_order", "create index nation (n_nationkey); select n_nationkey, n_name from nation order by n_nationkey;", "n_nationkey n_name")

# joins
_add("join_equi", "select n_name, s_suppkey, s_name from nation, supplier where n_nationkey = s_nationkey;", "n_name s_suppkey s_name")
_add("join_keyword", "select n_name, s_suppkey from nation join supplier where n_nationkey = s_nationkey;", "n_name s_suppkey", "select n_name, s_suppkey from nation, supplier where n_nationkey = s_nationkey")
_add("join_theta", "select n_nationkey, s_suppkey from nation, supplier where n_nationkey < s_nationkey;", "n_nationkey s_suppkey")
_add("join_ne", "select r_regionkey, n_nationkey from region, nation where r_regionkey <> n_regionkey;", "r_regionkey n_nationkey")
_add("join_cross", "select r_name, n_name from region, nation;", "r_name n_name")
_add("join_three", "select c_custkey, o_orderkey, l_linenumber, l_quantity from customer, orders, lineitem where c_custkey = o_custkey and o_orderkey = l_orderkey;", "c_custkey o_orderkey l_linenumber l_quantity")
_add("join_four", "select n_name, o_orderkey, l_linenumber, l_extendedprice from nation, customer, orders, lineitem where n_nationkey = c_nationkey and c_custkey = o_custkey and o_orderkey = l_orderkey;", "n_name o_orderkey l_linenumber l_extendedprice")
_add("join_bushy", "select r_name, n_name, s_suppkey, c_custkey from region, nation, supplier, customer where r_regionkey = n_regionkey and s_nationkey = c_nationkey;", "r_name n_name s_suppkey c_custkey")
_add("join_mixed_type", "select n_nationkey, c_custkey from nation, customer where n_nationkey = c_custkey;", "n_nationkey c_custkey")
_add("join_equi_theta", "select o_orderkey, l_linenumber, l_extendedprice from orders, lineitem where o_orderkey = l_orderkey and o_totalprice < l_extendedprice;", "o_orderkey l_linenumber l_extendedprice")
_add("join_merge_knob", "set enable_nestloop = false; set enable_sortmerge = true; select c_custkey, o_orderkey from customer, orders where c_custkey = o_custkey;", "c_custkey o_orderkey")
_add("join_same_table_pred", "select n_name, s_suppkey from nation, supplier where n_nationkey = s_nationkey and s_suppkey > s_nationkey;", "n_name s_suppkey")
_add("join_star", "select * from region, nation where r_regionkey = n_regionkey;", "r_regionkey r_name n_nationkey n_name n_regionkey")

# aggregates
_add("agg_sum_int", "select sum(p_size) as total from part;", "total", "select cast(sum(p_size) as bigint) total from part")
_add("agg_sum_bigint", "select sum(o_custkey) as total from orders;", "total", "select cast(sum(o_custkey) as bigint) total from orders")
_add("agg_sum_float", "select sum(l_quantity) as total from lineitem;", "total")
_add("agg_max", "select max(o_totalprice) as top from orders;", "top")
_add("agg_min", "select min(p_size) as low from part;", "low")
_add("agg_minmax_str", "select min(c_mktsegment) as low, max(c_mktsegment) as top from customer;", "low top")
_add("agg_minmax_bigint", "select min(o_orderkey) as low, max(o_orderkey) as top from orders;", "low top")
_add("agg_minmax_dt", "select min(o_orderdate) as low, max(o_orderdate) as top from orders;", "low top")
_add("agg_count_star", "select count(*) as n from lineitem;", "n")
_add("agg_count_col", "select count(l_orderkey) as n from lineitem;", "n")
_add("agg_filtered", "select count(*) as n, sum(l_quantity) as total from lineitem where l_returnflag = 'R' and l_quantity < 25.0;", "n total")
_add("agg_multi", "select count(*) as n, min(l_quantity) as low, max(l_quantity) as top, sum(l_linenumber) as total from lineitem;", "n low top total", "select count(*), min(l_quantity), max(l_quantity), cast(sum(l_linenumber) as bigint) from lineitem")
_add("agg_empty", "select count(*) as n, sum(p_size) as total, max(p_size) as top from part where p_size > 1000;", "n total top", "select count(*), cast(coalesce(sum(p_size), 0) as bigint), max(p_size) from part where p_size > 1000")
_add("agg_join", "select count(*) as n, max(o_totalprice) as top from customer, orders where c_custkey = o_custkey and c_mktsegment = 'MACHINERY';", "n top")
_add("agg_limit", "select count(*) as n from part limit 1;", "n")

# order and limit
_add("sort_multi", "select c_mktsegment, c_custkey from customer order by c_mktsegment desc, c_custkey asc;", "c_mktsegment c_custkey")
_add("sort_unprojected", "select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 50;", "o_orderkey")
_add("topk", "select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey limit 100;", "l_orderkey l_linenumber l_extendedprice")
_add("limit_zero", "select n_nationkey, n_name from nation limit 0;", "n_nationkey n_name", "select n_nationkey, n_name from nation")
_add("sort_join", "select n_name, s_suppkey from nation, supplier where n_nationkey = s_nationkey order by supplier.s_suppkey limit 20;", "n_name s_suppkey")

# changes: on the database's own version of a table
_add("insert_rows", "insert into nation values (100, 'ATLANTIS', 9); insert into nation values (101, 'LEMURIA', 9); select * from nation;", "n_nationkey n_name n_regionkey", "select n_nationkey, n_name, n_regionkey from nation union all values (100, 'ATLANTIS', 9), (101, 'LEMURIA', 9)")
_add("update_rows", "update part set p_size = 99, p_brand = 'NONE' where p_size < 10 and p_retailprice > 1000.0; select p_partkey, p_size, p_brand from part;", "p_partkey p_size p_brand", "select p_partkey, case when p_size < 10 and p_retailprice > 1000 then 99 else p_size end, case when p_size < 10 and p_retailprice > 1000 then 'NONE' else p_brand end from part")
_add("delete_rows", "delete from orders where o_totalprice < 100000.0 and o_orderstatus = 'F'; select o_orderkey, o_totalprice from orders;", "o_orderkey o_totalprice", "select o_orderkey, o_totalprice from orders where not (o_totalprice < 100000 and o_orderstatus = 'F')")
_add("delete_all", "delete from nation; select count(*) as n from nation;", "n", "select 0::bigint")
_add("txn_commit", "begin; insert into region values (50, 'NOWHERE'); update region set r_name = 'EVERYWHERE' where r_regionkey = 50; commit; select * from region;", "r_regionkey r_name", "select r_regionkey, r_name from region union all values (50, 'EVERYWHERE')")
_add("txn_abort", "begin; insert into region values (50, 'NOWHERE'); delete from region where r_regionkey < 3; abort; select * from region;", "r_regionkey r_name")
_add("txn_rollback", "begin; update nation set n_regionkey = 0; rollback; select * from nation;", "n_nationkey n_name n_regionkey")
_add("unique_reject", "create index nation (n_nationkey); insert into nation values (3, 'TWICE', 0); update nation set n_nationkey = 4 where n_nationkey = 5; select * from nation;", "n_nationkey n_name n_regionkey")
_add("ddl_round_trip", "create table t (id int, name char(8), at datetime, big bigint, val float); insert into t values (1, 'a', '2020-02-29 12:30:00', 5000000000, 1.5); insert into t values (2, 'b', '1999-07-07 12:30:00', 7, 2.25); insert into t values (3, 'toolongtext', '2020-01-01 00:00:00', 1, 1.0); update t set val = 3 where id = 2; select * from t where val >= 1.5;", "id name at_time big val", "values (1, 'a', timestamp '2020-02-29 12:30:00', 5000000000::bigint, 1.5::float), (2, 'b', timestamp '1999-07-07 12:30:00', 7::bigint, 3::float)")


def _runs(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text, names, _ = _Q[name]
        session = Session.temporary(spark)
        for table in TABLES:
            if table in text:
                session.register_parquet(table, f"{sf_dir}/{table}.parquet")
        *before, last = [f"{s.strip()};" for s in text.split(";") if s.strip()]
        session.script(" ".join(before))
        return session.frame(last).toDF(*names)

    run.__name__ = name
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _runs(name) for name in _Q} | scenarios.QUERIES
SQL: dict[str, str] = {name: q[2] for name, q in _Q.items()} | scenarios.SQL
FLAGSHIP = "join_three"
