"""Registered queries over the test tables, each with its DuckDB counterpart.

Outputs keep the dialect's column names. Sums and averages of fractions are rounded on both sides, as the order of addition is free.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog
from .functions.expressions import quoted
from .session import Engine
from .sources.manifest import Config

#: Key of each table that has a unique whole-number column.
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "lineitem": None}


def engine(spark: SparkSession, sf_dir: str, *tables: str) -> Engine:
    catalog = Catalog(spark)
    for t in tables:
        catalog.register_parquet(t, f"{sf_dir}/{t}.parquet", KEYS.get(t))
    return Engine(spark, catalog=catalog)


@dataclass(frozen=True)
class Query:
    #: Statement of the dialect.
    sql: str
    oracle: str
    #: Output columns to round, with the digits.
    rounded: tuple[tuple[str, int], ...] = ()

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        from .sql.grammar import parse

        df = engine(spark, sf_dir, parse(self.sql).table).sql(self.sql)
        for name, digits in self.rounded:
            df = df.withColumn(name, F.round(quoted(name), digits))
        return df


#: A small table with nulls; rows are out of key order, and one is replaced.
_CREW = """
CREATE TABLE crew (id INT64 KEY, nick STRING NULL, grade INT64, pay DOUBLE NULL);
INSERT INTO crew (id, grade, pay) VALUES (12, 28, 2750.0);
INSERT INTO crew (pay, grade, nick, id) VALUES (6100.75, 31, 'Milo', 30);
INSERT INTO crew (id, nick, grade, pay) VALUES (7, 'Zoe', 99, 1.0);
INSERT INTO crew (id, nick, grade) VALUES (11, 'Juro', 45);
INSERT INTO crew (id, nick, grade, pay) VALUES (7, 'Ika', 31, 1210.5);
INSERT INTO crew (nick, id, pay, grade) VALUES ('Lene', 15, 1480.25, 31);
"""
_CREW_ROWS = "(VALUES (7::BIGINT, 'Ika', 31::BIGINT, 1210.5::DOUBLE), (11, 'Juro', 45, NULL), (12, NULL, 28, 2750.0), (15, 'Lene', 31, 1480.25), (30, 'Milo', 31, 6100.75)) AS crew(id, nick, grade, pay)"


def _root(spark: SparkSession) -> str:
    """A folder of the session for tables: in the shared folder, or a temporary one if there is none and all runs on this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{shared.rstrip('/')}/tables-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="quern-tables-")


def _crew(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark, _root(spark))
        e.run(_CREW)
        return e.sql(sql)

    return run


_G = "crew"

_QUERIES: dict[str, Query] = {
    "flagship": Query(
        "SELECT o_orderpriority, COUNT(o_orderkey), SUM(o_totalprice), AVG(o_totalprice), MIN(o_totalprice), MAX(o_totalprice) FROM orders WHERE o_totalprice >= 1000.0 GROUP BY o_orderpriority ORDER BY o_orderpriority;",
        'SELECT o_orderpriority, count(o_orderkey) AS "count(o_orderkey)", round(sum(o_totalprice), 2) AS "sum(o_totalprice)", round(avg(o_totalprice), 4) AS "avg(o_totalprice)", min(o_totalprice) AS "min(o_totalprice)", max(o_totalprice) AS "max(o_totalprice)" FROM orders WHERE o_totalprice >= 1000.0 GROUP BY 1',
        (("sum(o_totalprice)", 2), ("avg(o_totalprice)", 4)),
    ),
    "scan_star": Query("SELECT * FROM region;", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, * EXCLUDE (r_regionkey) FROM region"),
    "scan_full": Query("SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_discount >= 0.05;", "SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, l_extendedprice FROM lineitem WHERE l_discount >= 0.05"),
    "project_cols": Query("SELECT o_orderkey, o_totalprice FROM orders;", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_totalprice FROM orders"),
    "star_plus_item": Query("SELECT *, r_name IS NULL FROM region;", 'SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, * EXCLUDE (r_regionkey), r_name IS NULL AS "expression{n}" FROM region'),
    "literal_item": Query("SELECT c_custkey, 1, 'x', 2.5 FROM customer;", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, 1::BIGINT AS expression2, 'x' AS expression3, 2.5::DOUBLE AS expression4 FROM customer"),
    "bool_item": Query("SELECT o_orderkey, o_totalprice > 1000.0 FROM orders;", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_totalprice > 1000.0 AS expression2 FROM orders"),
    "key_ordered": Query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey;", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name FROM customer ORDER BY 1"),
    "point_lookup": Query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42;", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name FROM customer WHERE c_custkey = 42"),
    "point_residual": Query("SELECT c_custkey FROM customer WHERE c_custkey = 42 AND c_acctbal > -10000.0;", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey FROM customer WHERE c_custkey = 42 AND c_acctbal > -10000"),
    "point_contradiction": Query("SELECT c_custkey FROM customer WHERE c_custkey = 1 AND c_custkey = 2;", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey FROM customer WHERE false"),
    "range_contradiction": Query("SELECT c_custkey FROM customer WHERE c_custkey >= 5 AND c_custkey < 3;", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey FROM customer WHERE false"),
    "range_closed_open": Query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200;", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200"),
    "range_open_low": Query("SELECT o_orderkey FROM orders WHERE o_orderkey <= 50;", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey FROM orders WHERE o_orderkey <= 50"),
    "range_open_high": Query("SELECT o_orderkey FROM orders WHERE o_orderkey > 900;", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey FROM orders WHERE o_orderkey > 900"),
    "range_literal_left": Query("SELECT o_orderkey FROM orders WHERE 10 < o_orderkey AND 20 >= o_orderkey;", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey FROM orders WHERE o_orderkey > 10 AND o_orderkey <= 20"),
    "range_fraction": Query("SELECT o_orderkey FROM orders WHERE o_orderkey > 5.5 AND o_orderkey <= 9.5;", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey FROM orders WHERE o_orderkey BETWEEN 6 AND 9"),
    **{
        f"filter_{name}": Query(f"SELECT o_orderkey FROM orders WHERE o_totalprice {op} 150000.0;", f"SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey FROM orders WHERE o_totalprice {op} 150000.0")
        for name, op in (("eq", "="), ("ne", "!="), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="))
    },
    **{
        f"filter_string_{name}": Query(f"SELECT o_orderkey FROM orders WHERE o_orderpriority {op} '3-MEDIUM';", f"SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey FROM orders WHERE o_orderpriority {op} '3-MEDIUM'")
        for name, op in (("eq", "="), ("ne", "!="), ("lt", "<"), ("ge", ">="))
    },
    "filter_and": Query("SELECT o_orderkey FROM orders WHERE o_totalprice > 1000.0 AND o_orderstatus = 'F';", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'F'"),
    "filter_or": Query("SELECT o_orderkey FROM orders WHERE o_totalprice < 20000.0 OR o_orderstatus = 'O';", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey FROM orders WHERE o_totalprice < 20000 OR o_orderstatus = 'O'"),
    "filter_not": Query("SELECT o_orderkey FROM orders WHERE NOT o_orderstatus = 'O';", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey FROM orders WHERE NOT o_orderstatus = 'O'"),
    "filter_nested": Query(
        "SELECT o_orderkey FROM orders WHERE NOT (o_totalprice < 50000.0 OR o_orderstatus = 'O') AND (o_orderpriority = '1-URGENT' OR o_custkey <= 100);",
        "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey FROM orders WHERE NOT (o_totalprice < 50000 OR o_orderstatus = 'O') AND (o_orderpriority = '1-URGENT' OR o_custkey <= 100)",
    ),
    "filter_bool_cmp": Query("SELECT o_orderkey FROM orders WHERE (o_totalprice > 100000.0) = (o_orderstatus = 'F');", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey FROM orders WHERE (o_totalprice > 100000) = (o_orderstatus = 'F')"),
    "filter_columns": Query("SELECT l_orderkey FROM lineitem WHERE l_tax > l_discount;", "SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey FROM lineitem WHERE l_tax > l_discount"),
    "int_vs_double": Query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_orderkey > 5.5;", "SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_quantity AS DOUBLE) AS l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_orderkey > 5.5"),
    "agg_count": Query("SELECT COUNT(l_orderkey) FROM lineitem;", 'SELECT count(l_orderkey) AS "count(l_orderkey)" FROM lineitem'),
    "agg_sum_int": Query("SELECT SUM(o_custkey) FROM orders;", 'SELECT CAST(sum(o_custkey) AS BIGINT) AS "sum(o_custkey)" FROM orders'),
    "agg_sum_double": Query("SELECT SUM(l_extendedprice) FROM lineitem;", 'SELECT round(sum(l_extendedprice), 2) AS "sum(l_extendedprice)" FROM lineitem', (("sum(l_extendedprice)", 2),)),
    "agg_avg_int": Query("SELECT AVG(o_custkey) FROM orders;", 'SELECT round(avg(o_custkey), 6) AS "avg(o_custkey)" FROM orders', (("avg(o_custkey)", 6),)),
    "agg_avg_double": Query("SELECT AVG(l_discount) FROM lineitem;", 'SELECT round(avg(l_discount), 6) AS "avg(l_discount)" FROM lineitem', (("avg(l_discount)", 6),)),
    "agg_min": Query("SELECT MIN(o_custkey), MIN(o_totalprice) FROM orders;", 'SELECT CAST(min(o_custkey) AS BIGINT) AS "min(o_custkey)", min(o_totalprice) AS "min(o_totalprice)" FROM orders'),
    "agg_max": Query("SELECT MAX(o_custkey), MAX(o_totalprice) FROM orders;", 'SELECT CAST(max(o_custkey) AS BIGINT) AS "max(o_custkey)", max(o_totalprice) AS "max(o_totalprice)" FROM orders'),
    "agg_multi": Query(
        "SELECT COUNT(l_orderkey), SUM(l_extendedprice), AVG(l_discount), MIN(l_tax), MAX(l_tax) FROM lineitem WHERE l_quantity < 24;",
        'SELECT count(l_orderkey) AS "count(l_orderkey)", round(sum(l_extendedprice), 2) AS "sum(l_extendedprice)", round(avg(l_discount), 6) AS "avg(l_discount)", min(l_tax) AS "min(l_tax)", max(l_tax) AS "max(l_tax)" FROM lineitem WHERE l_quantity < 24',
        (("sum(l_extendedprice)", 2), ("avg(l_discount)", 6)),
    ),
    "agg_empty": Query("SELECT COUNT(o_orderkey), SUM(o_custkey), AVG(o_totalprice) FROM orders WHERE o_orderkey = 1 AND o_orderkey = 2;", 'SELECT 0::BIGINT AS "count(o_orderkey)", NULL::BIGINT AS "sum(o_custkey)", NULL::DOUBLE AS "avg(o_totalprice)"'),
    "agg_count_expr": Query("SELECT COUNT(c_name IS NULL), COUNT(NULL) FROM customer;", 'SELECT count(*) AS "count(expression1)", 0::BIGINT AS "count(expression2)" FROM customer'),
    "agg_limit0": Query("SELECT COUNT(c_custkey) FROM customer LIMIT 0;", 'SELECT count(c_custkey) AS "count(c_custkey)" FROM customer LIMIT 0'),
    "agg_order_ignored": Query("SELECT COUNT(c_custkey) FROM customer ORDER BY c_name;", 'SELECT count(c_custkey) AS "count(c_custkey)" FROM customer'),
    "group_one": Query("SELECT l_returnflag, COUNT(l_orderkey) FROM lineitem GROUP BY l_returnflag;", 'SELECT l_returnflag, count(l_orderkey) AS "count(l_orderkey)" FROM lineitem GROUP BY 1'),
    "group_two": Query(
        "SELECT l_returnflag, l_linestatus, COUNT(l_orderkey), SUM(l_extendedprice) FROM lineitem GROUP BY l_returnflag, l_linestatus;",
        'SELECT l_returnflag, l_linestatus, count(l_orderkey) AS "count(l_orderkey)", round(sum(l_extendedprice), 2) AS "sum(l_extendedprice)" FROM lineitem GROUP BY 1, 2',
        (("sum(l_extendedprice)", 2),),
    ),
    "group_where": Query("SELECT c_mktsegment, MAX(c_acctbal) FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment;", 'SELECT c_mktsegment, max(c_acctbal) AS "max(c_acctbal)" FROM customer WHERE c_acctbal > 0 GROUP BY 1'),
    "group_expr": Query("SELECT o_totalprice >= 150000.0, COUNT(o_orderkey) FROM orders GROUP BY o_totalprice >= 150000.0;", 'SELECT o_totalprice >= 150000.0 AS expression1, count(o_orderkey) AS "count(o_orderkey)" FROM orders GROUP BY 1'),
    "group_literal": Query("SELECT COUNT(o_orderkey) FROM orders GROUP BY 9;", 'SELECT count(o_orderkey) AS "count(o_orderkey)" FROM orders'),
    "group_distinct": Query("SELECT o_orderpriority FROM orders GROUP BY o_orderpriority;", "SELECT DISTINCT o_orderpriority FROM orders"),
    "group_order_limit": Query("SELECT o_custkey, COUNT(o_orderkey) FROM orders GROUP BY o_custkey ORDER BY o_custkey DESC LIMIT 10;", 'SELECT CAST(o_custkey AS BIGINT) AS o_custkey, count(o_orderkey) AS "count(o_orderkey)" FROM orders GROUP BY o_custkey ORDER BY o_custkey DESC LIMIT 10'),
    "group_order_expr": Query(
        "SELECT o_custkey, COUNT(o_orderkey) FROM orders GROUP BY o_custkey ORDER BY o_custkey > 50, o_custkey;",
        'SELECT CAST(o_custkey AS BIGINT) AS o_custkey, count(o_orderkey) AS "count(o_orderkey)" FROM orders GROUP BY o_custkey ORDER BY o_custkey > 50, o_custkey',
    ),
    "group_order_first_row": Query(
        "SELECT o_orderpriority, COUNT(o_orderkey) FROM orders GROUP BY o_orderpriority ORDER BY o_custkey, o_orderpriority;",
        'SELECT o_orderpriority, count(o_orderkey) AS "count(o_orderkey)" FROM orders GROUP BY o_orderpriority ORDER BY arg_min(o_custkey, o_orderkey), o_orderpriority',
    ),
    "order_asc": Query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey;", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey"),
    "order_desc": Query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey;", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey"),
    "order_multi": Query("SELECT c_custkey FROM customer ORDER BY c_mktsegment DESC, c_acctbal ASC, c_custkey;", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey FROM customer ORDER BY c_mktsegment DESC, c_acctbal, c_custkey"),
    "order_nonselected": Query("SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey;", "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey"),
    "order_bool": Query("SELECT c_custkey FROM customer ORDER BY c_acctbal > 0.0, c_custkey;", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey FROM customer ORDER BY c_acctbal > 0, c_custkey"),
    "order_literal": Query("SELECT c_custkey FROM customer ORDER BY 2, c_custkey;", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey FROM customer ORDER BY c_custkey"),
    "limit_topk": Query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 100;", "SELECT CAST(event_id AS BIGINT) AS event_id, CAST(value AS DOUBLE) AS value FROM events ORDER BY value DESC, event_id LIMIT 100"),
    "limit_large": Query("SELECT c_custkey, c_name FROM customer LIMIT 5000000000;", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name FROM customer"),
    "filter_nonassociative": Query("SELECT o_orderkey FROM orders WHERE ((o_totalprice > 100000.0) = (o_orderstatus = 'F')) = (o_custkey > 50);", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey FROM orders WHERE ((o_totalprice > 100000) = (o_orderstatus = 'F')) = (o_custkey > 50)"),
    "filter_precedence": Query("SELECT o_orderkey FROM orders WHERE o_custkey < 40 OR NOT o_orderstatus = 'O' AND o_totalprice > 120000.0;", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey FROM orders WHERE o_custkey < 40 OR ((NOT o_orderstatus = 'O') AND o_totalprice > 120000)"),
    "limit_zero": Query("SELECT c_custkey FROM customer LIMIT 0;", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey FROM customer LIMIT 0"),
    "where_order_limit": Query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice, o_orderkey LIMIT 10;", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice, o_orderkey LIMIT 10"),
    "skip_numeric": Query("SELECT COUNT(l_orderkey) FROM lineitem WHERE l_extendedprice > 90000.0;", 'SELECT count(l_orderkey) AS "count(l_orderkey)" FROM lineitem WHERE l_extendedprice > 90000'),
    "skip_and": Query("SELECT COUNT(l_orderkey) FROM lineitem WHERE l_extendedprice >= 20000.0 AND l_extendedprice < 40000.0;", 'SELECT count(l_orderkey) AS "count(l_orderkey)" FROM lineitem WHERE l_extendedprice >= 20000 AND l_extendedprice < 40000'),
    "time_column": Query("SELECT event_id, ts FROM events WHERE event_type = 'click';", "SELECT CAST(event_id AS BIGINT) AS event_id, epoch_us(ts) AS ts FROM events WHERE event_type = 'click'"),
}

#: Over a keyed table made by statements, with nulls: (statement, counterpart).
_CREW_QUERIES = {
    "filter_is_null": (f"SELECT id FROM {_G} WHERE nick IS NULL;", f"SELECT id FROM {_CREW_ROWS} WHERE nick IS NULL"),
    "filter_is_not_null": (f"SELECT id FROM {_G} WHERE pay IS NOT NULL;", f"SELECT id FROM {_CREW_ROWS} WHERE pay IS NOT NULL"),
    "filter_3vl": (f"SELECT id FROM {_G} WHERE NOT (pay > 1300.0 AND nick != 'Juro') OR nick = NULL;", f"SELECT id FROM {_CREW_ROWS} WHERE NOT (pay > 1300 AND nick <> 'Juro') OR nick = NULL"),
    "item_3vl": (f"SELECT id, pay > 1300.0, NOT nick = 'Ika', nick IS NULL FROM {_G};", f"SELECT id, pay > 1300 AS expression2, NOT nick = 'Ika' AS expression3, nick IS NULL AS expression4 FROM {_CREW_ROWS}"),
    "agg_nulls": (f"SELECT COUNT(id), COUNT(pay), SUM(pay), AVG(pay), MIN(pay), MAX(grade) FROM {_G};", f'SELECT count(id) AS "count(id)", count(pay) AS "count(pay)", sum(pay) AS "sum(pay)", avg(pay) AS "avg(pay)", min(pay) AS "min(pay)", max(grade) AS "max(grade)" FROM {_CREW_ROWS}'),
    "group_nulls": (f"SELECT nick, COUNT(id), SUM(pay) FROM {_G} GROUP BY nick;", f'SELECT nick, count(id) AS "count(id)", sum(pay) AS "sum(pay)" FROM {_CREW_ROWS} GROUP BY nick'),
    "order_nulls_asc": (f"SELECT id FROM {_G} ORDER BY pay, id;", f"SELECT id FROM {_CREW_ROWS} ORDER BY pay NULLS LAST, id"),
    "order_nulls_desc": (f"SELECT id FROM {_G} ORDER BY pay DESC, id;", f"SELECT id FROM {_CREW_ROWS} ORDER BY pay DESC NULLS FIRST, id"),
    "insert_select": (f"SELECT * FROM {_G};", f"SELECT * FROM {_CREW_ROWS}"),
}


def _orders_table(spark: SparkSession, sf_dir: str, config: Config) -> tuple[Engine, str]:
    """A keyed table of orders, written in three overlapping appends: the later ones replace a third and a fifth of the rows."""
    root = _root(spark)
    e = Engine(spark, root, config)
    e.sql("CREATE TABLE kept (id INT64 KEY, price DOUBLE NULL, status STRING NULL);")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    table = e.catalog.table("kept")
    table.append(orders)
    table.append(orders.filter("id % 3 = 0").withColumn("price", F.col("price") + 1).withColumn("status", F.lit("again")))
    table.append(orders.filter("id % 5 = 0").withColumn("price", F.lit(None).cast("double")))
    return e, root


_KEPT = "SELECT CAST(o_orderkey AS BIGINT) AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 3 = 0 THEN 'again' ELSE o_orderstatus END AS status FROM orders"


def _upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_table(spark, sf_dir, Config(level0_runs=100))[0].sql("SELECT * FROM kept;")


def _compacted(spark: SparkSession, sf_dir: str, sql: str = "SELECT * FROM kept;") -> DataFrame:
    e, _ = _orders_table(spark, sf_dir, Config(level0_runs=2))
    e.catalog.table("kept").compact()
    return e.sql(sql)


def _mixed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate on a value, over a large run, two that overlap it, frozen and buffered rows."""
    e, _ = _orders_table(spark, sf_dir, Config(level0_runs=100, buffer_rows=2))
    for k in (1, 2, 4):
        e.sql(f"INSERT INTO kept (id, price, status) VALUES ({k}, 999999.5, 'held');")
    return e.sql("SELECT id, price, status FROM kept WHERE price > 150000.0;")


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read made before later writes and compactions."""
    e, _ = _orders_table(spark, sf_dir, Config(level0_runs=100))
    before = e.sql("SELECT * FROM kept;")
    table = e.catalog.table("kept")
    table.append(before.withColumn("price", F.lit(0.0)).select("id", "price", "status"))
    e.sql("INSERT INTO kept (id, price, status) VALUES (1, -1.0, 'late');")
    table.compact()
    return before


def _beside_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows inserted while flushes and compactions run on the table's thread."""
    e = Engine(spark, _root(spark), Config(buffer_rows=20, level0_runs=2, background=True))
    e.sql("CREATE TABLE counted (id INT64 KEY, twice INT64);")
    for k in range(100):
        e.sql(f"INSERT INTO counted (id, twice) VALUES ({k % 70}, {2 * k});")
    e.catalog.wait_for_compaction("counted")
    return e.sql("SELECT * FROM counted;")


def _frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a full buffer that is not written yet, under newer ones in the buffer."""
    e = Engine(spark, _root(spark), Config(buffer_rows=1000))
    e.sql("CREATE TABLE counted (id INT64 KEY, twice INT64);")
    table = e.catalog.table("counted")
    for k in range(5):
        e.sql(f"INSERT INTO counted (id, twice) VALUES ({k}, {2 * k});")
    table._freeze()
    e.sql("INSERT INTO counted (id, twice) VALUES (3, 100);")
    return e.sql("SELECT * FROM counted WHERE twice > 2;")


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tables there are, and the columns of one."""
    e = engine(spark, sf_dir, "nation")
    rows = [(t, e.catalog.table_exists(t), ",".join(e.catalog.schema_of(t).names) if e.catalog.table_exists(t) else None) for t in ("nation", "region")]
    return spark.createDataFrame(rows, "name string, there boolean, columns string")


def _sorted_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in ascending order where the statement gives none: the places show it."""
    e = engine(spark, sf_dir, "orders")
    e.sorted_groups = True
    rows = e.sql("SELECT o_orderpriority, COUNT(o_orderkey) FROM orders GROUP BY o_orderpriority;").collect()  # a row a priority
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "place int, priority string, n long")


def _any_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit without order gives any rows, so many of them."""
    e = engine(spark, sf_dir, "orders")
    return e.sql("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' LIMIT 7;").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("different"))


def _reloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, root = _orders_table(spark, sf_dir, Config())
    e.sql("INSERT INTO kept (id, price, status) VALUES (-1, 0.5, 'late');")
    e.close()
    again = Engine(spark, root)
    again.catalog.open_table("kept")
    return again.sql("SELECT id, price, status FROM kept;")


_STORAGE = {
    "upsert_latest": (_upsert_latest, _KEPT),
    "flush_compact_roundtrip": (_compacted, _KEPT),
    "compacted_range": (
        lambda spark, d: _compacted(spark, d, "SELECT id, price FROM kept WHERE id >= 100 AND id < 5000 AND price > 50000.0;"),
        f"SELECT id, price FROM ({_KEPT}) WHERE id >= 100 AND id < 5000 AND price > 50000",
    ),
    "restart_reload": (_reloaded, f"{_KEPT} UNION ALL SELECT -1, 0.5, 'late'"),
    "mixed_runs_filter": (_mixed_runs, f"SELECT * FROM ({_KEPT}) WHERE price > 150000 AND id NOT IN (1, 2, 4) UNION ALL SELECT unnest([1, 2, 4])::BIGINT, 999999.5, 'held'"),
    "snapshot_read": (_snapshot, _KEPT),
    "beside_compaction": (_beside_compaction, "SELECT max(k) % 70 AS id, 2 * max(k) AS twice FROM range(100) AS r(k) GROUP BY k % 70"),
    "frozen_buffer": (_frozen, "SELECT k AS id, CASE WHEN k = 3 THEN 100 ELSE 2 * k END AS twice FROM range(2, 5) AS r(k)"),
    "tables_described": (_described, "SELECT 'nation' AS name, true AS there, 'n_nationkey,n_name,n_regionkey' AS columns UNION ALL SELECT 'region', false, NULL"),
    "group_sorted": (_sorted_groups, "SELECT (row_number() OVER (ORDER BY o_orderpriority) - 1)::INT AS place, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY o_orderpriority"),
    "limit_any": (_any_rows, "SELECT least(count(*), 7) AS n, least(count(*), 7) AS different FROM orders WHERE o_orderstatus = 'F'"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q.run for k, q in _QUERIES.items()} | {k: _crew(s) for k, (s, _) in _CREW_QUERIES.items()} | {k: f for k, (f, _) in _STORAGE.items()}


def oracle_sql() -> dict[str, str]:
    out = {k: q.oracle for k, q in _QUERIES.items()} | {k: o for k, (_, o) in _CREW_QUERIES.items()} | {k: o for k, (_, o) in _STORAGE.items()}
    out["star_plus_item"] = out["star_plus_item"].replace("{n}", "3")
    return out
