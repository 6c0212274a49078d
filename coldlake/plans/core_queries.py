"""All queries over the archive engine's own operators."""

from __future__ import annotations

import json
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldlake.session import ArchiveSession
from coldlake.sources.datasource import register_format
from coldlake.sources.files import Files
from coldlake.api import copy_archive
from coldlake.functions import transforms as tr
from coldlake.operators import catalog as cat
from coldlake.operators import profile as prof
from coldlake.operators.contract import Contract, Field, evolve, schema_diff
from coldlake.operators.detect import field_census, flatten, tabular, top_tokens
from coldlake.operators.diff import diff_positional, diff_tables
from coldlake.operators.filters import apply_filter
from coldlake.operators.jobs import JobRunner
from coldlake.operators.rangejoin import interval_join
from coldlake.operators.recipes import parse_recipe, run_recipe
from coldlake.plans.catalogue import ORACLES, QUERIES, query
from coldlake.plans.sqlfront import SqlFront
from coldlake.plans.tables import scratch, table, views
from coldlake.sources.archive import (
    append_archive,
    compact,
    peek,
    read_archive,
    read_manifest,
    row_numbers,
    verify_files,
    write_archive,
)
from coldlake.sources.codecs import quantise
from coldlake.sources.export import write_file
from coldlake.sources.readers import RangeSource, read_archives, read_source
from coldlake.sources.cache import ArchiveCache
from coldlake.sources.keys import EnvelopeKey, SparkKeyService, generate_key
from coldlake.streaming.ingest import sessions, stream_to_table, tumbling

__all__ = ["ORACLES", "QUERIES"]


def _money(col: str):
    """Exact sums of two-place doubles: summed as decimals, given as double."""
    return F.sum(F.col(col).cast("decimal(18,2)")).cast("double")


# ---- scans, filters, projections


@query("scan_full_orders", "SELECT * FROM orders")
def scan_full_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


@query(
    "filtered_join_agg",
    """SELECT o_orderpriority, COUNT(*) AS n,
              CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       WHERE l_returnflag IN ('A', 'R') GROUP BY o_orderpriority""",
)
def filtered_join_agg(spark, sf_dir):
    lines = apply_filter(table(spark, sf_dir, "lineitem"), {"l_returnflag": ["A", "R"]})
    orders = table(spark, sf_dir, "orders")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderpriority").agg(F.count("*").alias("n"), _money("l_extendedprice").alias("revenue"))


def _filter_query(name: str, spec: dict, where: str):
    sql = f"SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag FROM lineitem WHERE {where}"

    @query(name, sql)
    def run(spark, sf_dir):
        found = apply_filter(table(spark, sf_dir, "lineitem"), spec)
        return found.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")

    return run


_filter_query("filter_eq", {"l_returnflag": "R"}, "l_returnflag = 'R'")
_filter_query("filter_in", {"l_linenumber": [1, 3, 7]}, "l_linenumber IN (1, 3, 7)")
_filter_query("filter_range", {"l_quantity": (10, 12)}, "l_quantity BETWEEN 10 AND 12")
_filter_query(
    "filter_and",
    {"l_returnflag": ["A", "N"], "l_quantity": (5, 9), "l_linenumber": 2},
    "l_returnflag IN ('A', 'N') AND l_quantity BETWEEN 5 AND 9 AND l_linenumber = 2",
)
_filter_query("filter_unknown_ignored", {"l_returnflag": "A", "no_such_column": 1}, "l_returnflag = 'A'")
_filter_query("filter_empty_result", {"l_quantity": (1000, 2000)}, "l_quantity BETWEEN 1000 AND 2000")


@query(
    "project_scalars",
    """SELECT p_partkey, upper(p_brand) AS brand, CAST(length(p_name) AS BIGINT) AS name_len,
              CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class,
              p_retailprice * 2 AS double_price, p_type LIKE '%BRASS%' AS is_brass, nullif(p_size, 1) AS size_or_null
       FROM part""",
)
def project_scalars(spark, sf_dir):
    size = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.upper("p_brand").alias("brand"),
        F.length("p_name").cast("long").alias("name_len"),
        size.alias("size_class"),
        (F.col("p_retailprice") * 2).alias("double_price"),
        F.col("p_type").like("%BRASS%").alias("is_brass"),
        F.nullif(F.col("p_size"), F.lit(1)).alias("size_or_null"),
    )


# ---- archives


def _round_trip(df: DataFrame, label: str, **options) -> tuple[str, DataFrame]:
    path = scratch(df.sparkSession, label)
    write_archive(df, path, **options)
    return path, read_archive(df.sparkSession, path)


@query("roundtrip_lineitem", "SELECT * FROM lineitem")
def roundtrip_lineitem(spark, sf_dir):
    return _round_trip(table(spark, sf_dir, "lineitem"), "lineitem", codec="zstd")[1]


@query("roundtrip_events_us", "SELECT * FROM events")
def roundtrip_events_us(spark, sf_dir):
    return _round_trip(table(spark, sf_dir, "events"), "events", codec="snappy")[1]


@query("roundtrip_encrypted", "SELECT * FROM customer")
def roundtrip_encrypted(spark, sf_dir):
    path, key = scratch(spark, "sealed"), b"0123456789abcdef"
    write_archive(table(spark, sf_dir, "customer"), path, key=key)
    return read_archive(spark, path, key=key)


@query(
    "row_range_orders",
    """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders)
       WHERE rn BETWEEN 100 AND 1234""",
)
def row_range_orders(spark, sf_dir):
    path = scratch(spark, "ranges")
    write_archive(table(spark, sf_dir, "orders"), path, partition_by="o_orderkey", chunk_rows=1000)
    return read_archive(spark, path, row_range=(100, 1234))


@query(
    "row_range_and_filter",
    """SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders)
       WHERE rn BETWEEN 500 AND 3000 AND o_orderstatus = 'F'""",
)
def row_range_and_filter(spark, sf_dir):
    path = scratch(spark, "ranges")
    write_archive(table(spark, sf_dir, "orders"), path, partition_by="o_orderkey", chunk_rows=700)
    found = read_archive(spark, path, row_range=(500, 3000), filter={"o_orderstatus": "F"})
    return found.select("o_orderkey", "o_orderstatus")


@query(
    "partition_pruned_year",
    "SELECT *, CAST(year(l_shipdate) AS INTEGER) AS ship_year FROM lineitem WHERE year(l_shipdate) = 1999",
)
def partition_pruned_year(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("ship_year", F.year("l_shipdate"))
    path = scratch(spark, "years")
    write_archive(lines, path, partition_by="ship_year")
    return read_archive(spark, path, filter={"ship_year": 1999})


@query("append_orders", "SELECT * FROM orders")
def append_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    even = F.col("o_orderkey") % 2 == 0
    path = scratch(spark, "append")
    write_archive(orders.where(even), path)
    append_archive(orders.where(~even), path)
    return read_archive(spark, path, verify=True)


@query(
    "chunk_index_stats",
    """SELECT (rn - 1) // 1000 AS chunk_id, COUNT(*) AS n, MIN(o_orderkey) AS low, MAX(o_orderkey) AS high
       FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) GROUP BY 1""",
)
def chunk_index_stats(spark, sf_dir):
    path = scratch(spark, "index")
    write_archive(table(spark, sf_dir, "orders"), path, partition_by="o_orderkey")
    chunk = F.floor(F.col("row_number") / 1000)
    rows = row_numbers(spark, path).groupBy(chunk.cast("long").alias("chunk_id"))
    return rows.agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))


@query("audit_rows", "SELECT COUNT(*) AS n_rows, 6 AS n_columns FROM orders")
def audit_rows(spark, sf_dir):
    path, _ = _round_trip(table(spark, sf_dir, "orders"), "audit")
    m = read_manifest(spark, path)  # no data file is read
    return spark.createDataFrame([(m.rows, len(m.columns))], "n_rows long, n_columns int")


@query("peek_batches", "SELECT CAST(n // 400 AS BIGINT) AS batches, n % 400 AS last_rows FROM (SELECT COUNT(*) - 1 AS n FROM supplier)")
def peek_batches(spark, sf_dir):
    path, _ = _round_trip(table(spark, sf_dir, "supplier"), "peek")
    sizes = [len(b) for b in peek(spark, path, batch_size=400)]
    return spark.createDataFrame([(len(sizes) - 1, sizes[-1] - 1)], "batches long, last_rows long")


@query("integrity_check", "SELECT 'OK' AS status, TRUE AS complete")
def integrity_check(spark, sf_dir):
    path, _ = _round_trip(table(spark, sf_dir, "part"), "verify")
    found = verify_files(spark, path)
    status = ",".join(sorted({f["status"] for f in found}))
    return spark.createDataFrame([(status, len(found) > 0)], "status string, complete boolean")


# ---- SQL over archives


def _sql_query(name: str, sql: str, tables: tuple[str, ...], oracle: str | None = None):
    """A statement over archives; ``{table}`` in it stands for the archive's quoted path."""

    @query(name, oracle or sql.replace("{", "").replace("}", ""))
    def run(spark, sf_dir):
        paths = {}
        for t in tables:
            paths[t] = f"{scratch(spark, 'sql')}/{t}"
            write_archive(table(spark, sf_dir, t), paths[t], sha256=False)
        return SqlFront(spark).query(sql.format(**{t: f"'{p}'" for t, p in paths.items()}))

    return run


_sql_query(
    "sql_join_agg",
    """SELECT n_name, COUNT(*) AS n, CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance
       FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY n_name""",
    ("customer", "nation"),
)
_sql_query(
    "sql_join_where",
    """SELECT c.c_custkey, o.o_orderkey, o.o_totalprice FROM {customer} c JOIN {orders} o ON c.c_custkey = o.o_custkey
       WHERE c.c_mktsegment = 'BUILDING' AND o.o_totalprice > 150000""",
    ("customer", "orders"),
)
_sql_query(
    "sql_self_join_path",
    """SELECT a.s_suppkey AS left_key, b.s_suppkey AS right_key FROM {supplier} a JOIN {supplier} b
       ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey""",
    ("supplier",),
)
_sql_query("sql_or_predicate", "SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'F' OR o_orderstatus = 'O'", ("orders",))
_sql_query(
    "sql_case_no_filter",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS done FROM {orders}",
    ("orders",),
)
_sql_query(
    "sql_in_subquery",
    "SELECT o_orderkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'MACHINERY')",
    ("orders", "customer"),
)
_sql_query("sql_count", "SELECT COUNT(*) AS n FROM {lineitem}", ("lineitem",))
_sql_query(
    "sql_cte_having",
    """WITH per AS (SELECT o_custkey, COUNT(*) AS n FROM {orders} GROUP BY o_custkey HAVING COUNT(*) > 12)
       SELECT c_name, n FROM per, {customer} WHERE c_custkey = o_custkey""",
    ("orders", "customer"),
)

# ---- joins


def _keys(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns)


@query(
    "join_left",
    "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000",
)
def join_left(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 300000")
    return table(spark, sf_dir, "customer").join(orders, F.expr("c_custkey = o_custkey"), "left").select("c_custkey", "o_orderkey")


@query(
    "join_right",
    "SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000",
)
def join_right(spark, sf_dir):
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 5000")
    return rich.join(table(spark, sf_dir, "nation"), F.expr("s_nationkey = n_nationkey"), "right").select("s_suppkey", "n_name")


@query(
    "join_full",
    """SELECT s_suppkey, c_custkey FROM (SELECT * FROM supplier WHERE s_acctbal > 0) s
       FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 9000) c ON s_suppkey = c_custkey""",
)
def join_full(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 0")
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000")
    return s.join(c, F.expr("s_suppkey = c_custkey"), "full_outer").select("s_suppkey", "c_custkey")


@query("join_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join_semi(spark, sf_dir):
    pending = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return table(spark, sf_dir, "customer").join(pending, F.expr("c_custkey = o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("join_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.expr("c_custkey = o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("join_cross_small", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross_small(spark, sf_dir):
    # two dimension tables of fixed size
    return table(spark, sf_dir, "region").crossJoin(table(spark, sf_dir, "nation")).select("r_name", "n_name")


@query(
    "join_range",
    """SELECT e.event_id, b.lo FROM events e JOIN (SELECT range AS lo, range + 10 AS hi FROM range(0, 100, 10)) b
       ON e.value >= b.lo AND e.value < b.hi""",
)
def join_range(spark, sf_dir):
    """A range join with bands of equal width as an equi-join on the band's number."""
    events = table(spark, sf_dir, "events").where("value >= 0 AND value < 100")
    bands = spark.range(0, 100, 10).withColumnRenamed("id", "lo")
    return events.join(F.broadcast(bands), (F.floor(F.col("value") / 10) * 10) == F.col("lo")).select("event_id", "lo")


@query(
    "join_asof",
    """SELECT e.event_id, o.o_orderdate AS last_order FROM events e
       LEFT JOIN (SELECT o_custkey, o_orderdate FROM orders) o ON FALSE WHERE FALSE
       UNION ALL
       SELECT e.event_id, (SELECT MAX(o_orderdate) FROM orders WHERE o_custkey = e.user_id AND o_orderdate <= e.ts) FROM events e""",
)
def join_asof(spark, sf_dir):
    """The newest order at or before each event: one window over the union of both sides, not a join
    of all pairs of a key."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), F.col("ts").alias("at"), F.lit(1).alias("side"), "event_id", F.lit(None).cast("timestamp_ntz").alias("order_date")
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("event_id"), F.col("o_orderdate").alias("order_date")
    )
    before = Window.partitionBy("key").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = events.unionByName(orders).withColumn("last_order", F.last("order_date", ignorenulls=True).over(before))
    return both.where("side = 1").select("event_id", "last_order")


# ---- aggregation


@query(
    "agg_group",
    """SELECT l_returnflag, l_linestatus, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty,
              CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price, MIN(l_shipdate) AS first_ship,
              MAX(l_shipdate) AS last_ship, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def agg_group(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        _money("l_quantity").alias("qty"), _money("l_extendedprice").alias("price"),
        F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"), F.count("*").alias("n"),
    )


@query("agg_having", "SELECT l_suppkey, COUNT(*) AS n FROM lineitem WHERE l_discount > 0.02 GROUP BY l_suppkey HAVING COUNT(*) > 400")
def agg_having(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_discount > 0.02")
    return lines.groupBy("l_suppkey").agg(F.count("*").alias("n")).where("n > 400")


@query("agg_distinct", "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS customers, COUNT(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY o_orderstatus")
def agg_distinct(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(
        F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderpriority").alias("priorities")
    )


def _plain_sql(name: str, sql: str, tables: tuple[str, ...], oracle: str | None = None):
    """A statement that both engines read alike, over views of the tables."""

    @query(name, oracle or sql)
    def run(spark, sf_dir):
        views(spark, sf_dir, *tables)
        return spark.sql(sql)

    return run


_plain_sql(
    "agg_filter",
    """SELECT event_type, COUNT(*) FILTER (WHERE value > 50) AS high, COUNT(*) FILTER (WHERE value <= 50) AS low
       FROM events GROUP BY event_type""",
    ("events",),
)
_plain_sql(
    "agg_cube",
    """SELECT c_mktsegment, c_nationkey, COUNT(*) AS n, CAST(GROUPING(c_mktsegment) AS INTEGER) AS all_segments
       FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)""",
    ("customer",),
)
_plain_sql(
    "agg_rollup",
    """SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders
       GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""",
    ("orders",),
)
_plain_sql(
    "agg_grouping_sets",
    """SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem
       GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())""",
    ("lineitem",),
)
_plain_sql(
    "agg_median",
    """SELECT event_type, CAST(median(value) AS DOUBLE) AS middle,
              CAST(percentile_cont(0.9) WITHIN GROUP (ORDER BY value) AS DOUBLE) AS p90 FROM events GROUP BY event_type""",
    ("events",),
)

# ---- windows


@query(
    "win_share",
    """SELECT n_regionkey, SUM(c) AS customers, 100.0::DOUBLE * SUM(c) / SUM(SUM(c)) OVER () AS share
       FROM (SELECT n_regionkey, CAST(1 AS BIGINT) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey)
       GROUP BY n_regionkey""".replace("SUM(c) AS customers", "CAST(SUM(c) AS BIGINT) AS customers"),
)
def win_share(spark, sf_dir):
    regions = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
    counts = regions.groupBy("n_regionkey").agg(F.count("*").alias("customers"))
    # the window sees one row a region
    share = F.lit(100.0) * F.col("customers") / F.sum("customers").over(Window.partitionBy())
    return counts.select("n_regionkey", "customers", share.alias("share"))


@query(
    "win_rank",
    """SELECT o_custkey, o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS INTEGER) AS r
       FROM orders""",
)
def win_rank(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.rank().over(w).alias("r"))


@query(
    "win_lag_delta",
    "SELECT o_orderkey, o_orderkey - coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0) AS delta FROM orders",
)
def win_lag_delta(spark, sf_dir):
    delta = tr.lag_delta(F.col("o_orderkey"), [F.col("o_orderkey")], [F.col("o_custkey")])
    return table(spark, sf_dir, "orders").select("o_orderkey", delta.alias("delta"))


@query("win_prefix_sum", "SELECT o_orderkey, o_orderkey AS restored FROM orders")
def win_prefix_sum(spark, sf_dir):
    order, within = [F.col("o_orderkey")], [F.col("o_custkey")]
    deltas = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", tr.lag_delta(F.col("o_orderkey"), order, within).alias("d"))
    return deltas.select("o_orderkey", tr.prefix_sum(F.col("d"), order, within).alias("restored"))


@query(
    "win_moving_avg",
    """SELECT event_id, SUM(CAST(value AS DECIMAL(18,6))) OVER (PARTITION BY user_id ORDER BY ts, event_id
              ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::DOUBLE AS sum3 FROM events""",
)
def win_moving_avg(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    total = F.sum(F.col("value").cast("decimal(18,6)")).over(w).cast("double")
    return table(spark, sf_dir, "events").select("event_id", total.alias("sum3"))


@query("win_ntile", "SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS INTEGER) AS quarter FROM customer")
def win_ntile(spark, sf_dir):
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.ntile(4).over(w).alias("quarter"))


# ---- order, limits, sets


@query("topk_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("limit_offset", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 15 OFFSET 30")
def limit_offset(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").orderBy("c_custkey").offset(30).limit(15)


@query("sorted_distinct", "SELECT array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS priorities FROM orders")
def sorted_distinct(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("priorities"))


@query("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    return c.unionAll(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf_dir):
    return union_all(spark, sf_dir).distinct()


@query("intersect", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def intersect(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return c.intersect(table(spark, sf_dir, "orders").select("o_custkey"))


@query("except_all", "SELECT s_nationkey AS k FROM supplier EXCEPT ALL SELECT n_nationkey FROM nation")
def except_all(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return s.exceptAll(table(spark, sf_dir, "nation").select("n_nationkey"))


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("dedup_lineitem", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def dedup_lineitem(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").dropDuplicates()


@query(
    "union_by_name_missing",
    "SELECT r_name, NULL::INTEGER AS n_nationkey FROM region UNION ALL SELECT n_name, n_nationkey FROM nation",
)
def union_by_name_missing(spark, sf_dir):
    regions = table(spark, sf_dir, "region").select("r_name")
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("r_name"), "n_nationkey")
    return regions.unionByName(nations, allowMissingColumns=True)


# ---- diff: version 2 of customer deletes every 10th, edits every 7th, and adds moved keys

_V2_SQL = """(SELECT c_custkey, c_name, c_nationkey,
                CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal,
                CASE WHEN c_custkey % 21 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment
              FROM customer WHERE c_custkey % 10 <> 0
              UNION ALL SELECT c_custkey + 10000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 50 = 1)"""
_DIFF_SQL = f"""SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, a.c_custkey IS NULL AS ins, b.c_custkey IS NULL AS del,
    a.c_acctbal AS b1, b.c_acctbal AS b2, a.c_mktsegment AS m1, b.c_mktsegment AS m2,
    a.c_name AS n1, b.c_name AS n2, a.c_nationkey AS k1, b.c_nationkey AS k2,
    CASE WHEN a.c_custkey IS NULL THEN 'inserted' WHEN b.c_custkey IS NULL THEN 'deleted'
         WHEN abs(a.c_acctbal - b.c_acctbal) <= 1e-8 + 1e-9 * abs(b.c_acctbal) AND a.c_mktsegment = b.c_mktsegment THEN 'unchanged'
         ELSE 'changed' END AS _diff
    FROM customer a FULL JOIN {_V2_SQL} b ON a.c_custkey = b.c_custkey"""


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v1 = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    v2 = v1.where(key % 10 != 0).withColumns(
        {
            "c_acctbal": F.when(key % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")),
            "c_mktsegment": F.when(key % 21 == 0, "MOVED").otherwise(F.col("c_mktsegment")),
        }
    )
    return v1, v2.unionByName(v1.where(key % 50 == 1).withColumn("c_custkey", key + 10000000))


@query(
    "diff_rows",
    f"""SELECT _diff, c_custkey, CASE WHEN del THEN n1 ELSE n2 END AS c_name, CASE WHEN del THEN k1 ELSE k2 END AS c_nationkey,
        CASE WHEN del THEN b1 ELSE b2 END AS c_acctbal, CASE WHEN del THEN m1 ELSE m2 END AS c_mktsegment
        FROM ({_DIFF_SQL}) WHERE _diff <> 'unchanged'""",
)
def diff_rows(spark, sf_dir):
    return diff_tables(*_versions(spark, sf_dir), "c_custkey").frame()


@query("diff_summary", f"SELECT _diff, COUNT(*) AS n FROM ({_DIFF_SQL}) GROUP BY _diff")
def diff_summary(spark, sf_dir):
    return diff_tables(*_versions(spark, sf_dir), "c_custkey").summary_frame()


@query(
    "diff_changed_cols",
    f"""SELECT c_custkey, b1 AS c_acctbal_v1, b2 AS c_acctbal_v2, m1 AS c_mktsegment_v1, m2 AS c_mktsegment_v2
        FROM ({_DIFF_SQL}) WHERE _diff = 'changed'""",
)
def diff_changed_cols(spark, sf_dir):
    return diff_tables(*_versions(spark, sf_dir), "c_custkey").changed(changed_columns_only=True)


@query("diff_inserted", f"SELECT c_custkey, n2 AS c_name, k2 AS c_nationkey, b2 AS c_acctbal, m2 AS c_mktsegment FROM ({_DIFF_SQL}) WHERE ins")
def diff_inserted(spark, sf_dir):
    return diff_tables(*_versions(spark, sf_dir), "c_custkey").inserted


@query("diff_deleted", f"SELECT c_custkey, n1 AS c_name, k1 AS c_nationkey, b1 AS c_acctbal, m1 AS c_mktsegment FROM ({_DIFF_SQL}) WHERE del")
def diff_deleted(spark, sf_dir):
    return diff_tables(*_versions(spark, sf_dir), "c_custkey").deleted


@query(
    "diff_multikey",
    """SELECT 'changed' AS _diff, conv_id, turn, upper(role) AS role FROM conversations WHERE turn % 2 = 1 AND upper(role) <> role""",
)
def diff_multikey(spark, sf_dir):
    v1 = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    v2 = v1.withColumn("role", F.when(F.col("turn") % 2 == 1, F.upper("role")).otherwise(F.col("role")))
    return diff_tables(v1, v2, ["conv_id", "turn"]).frame()


@query(
    "diff_positional",
    """WITH a AS (SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_suppkey) - 1 AS p FROM supplier),
            b AS (SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_suppkey) - 1 AS p FROM supplier WHERE s_suppkey > 3)
       SELECT CASE WHEN b.p IS NULL THEN 'deleted' ELSE 'changed' END AS _diff, a.p AS row_number,
              CASE WHEN b.p IS NULL THEN a.s_suppkey ELSE b.s_suppkey END AS s_suppkey,
              CASE WHEN b.p IS NULL THEN a.s_acctbal ELSE b.s_acctbal END AS s_acctbal
       FROM a LEFT JOIN b ON a.p = b.p""",
)
def diff_positional_query(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    sides = []
    for df in (supplier, supplier.where("s_suppkey > 3")):
        path = scratch(spark, "positions")
        write_archive(df, path, partition_by="s_suppkey")
        sides.append(row_numbers(spark, path))
    return diff_positional(*sides, "row_number").frame()


# ---- contracts, evolution, documents


@query(
    "contract_apply",
    """SELECT c_custkey AS id, c_name AS full_name, CAST(c_acctbal AS FLOAT) AS balance, CAST('none' AS VARCHAR) AS note,
              CAST(c_nationkey AS VARCHAR) AS nation FROM customer""",
)
def contract_apply(spark, sf_dir):
    contract = Contract(
        {
            "id": Field("bigint", required=True, renamed_from="c_custkey"),
            "full_name": Field("string", renamed_from="c_name"),
            "balance": Field("float", renamed_from="c_acctbal"),
            "note": Field("string", default="none"),
            "nation": Field("string", renamed_from="c_nationkey"),
        }
    )
    path, _ = _round_trip(table(spark, sf_dir, "customer"), "contract")
    return read_archive(spark, path, schema=contract)


@query("evolve_schema", "SELECT CAST(p_size AS BIGINT) AS p_size, p_name, NULL::DOUBLE AS weight, CAST(0 AS INTEGER) AS stock FROM part")
def evolve_schema(spark, sf_dir):
    target = T.StructType().add("p_size", "long").add("p_name", "string")
    part = evolve(table(spark, sf_dir, "part"), target.add("weight", "double"))
    wider = T.StructType(list(part.schema.fields)).add("stock", "integer")
    return evolve(part, wider, int_fill_zero=True)


@query(
    "schema_diff",
    """SELECT * FROM (VALUES ('added', 'weight'), ('removed', 'p_type'), ('type_changed', 'p_size'), ('unchanged', 'p_name'),
                             ('unchanged', 'p_retailprice'), ('removed', 'p_partkey'), ('removed', 'p_brand')) t(change, column_name)""",
)
def schema_diff_query(spark, sf_dir):
    target = T.StructType().add("p_name", "string").add("p_size", "string").add("p_retailprice", "float").add("weight", "double")
    found = schema_diff(table(spark, sf_dir, "part").schema, target)
    rows = [(k, c) for k, columns in found.items() for c in columns]
    return spark.createDataFrame(rows, "change string, column_name string")


@query("json_flatten_events", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_flatten_events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    documents = events.select(F.to_json(F.struct("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))).alias("value"))
    return flatten(documents).df.select("event_id", "k")


@query(
    "json_presence",
    "SELECT 'k' AS name, COUNT(*) AS n FROM events UNION ALL SELECT 'high', COUNT(*) FROM events WHERE value > 50",
)
def json_presence(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    high = F.when(F.col("value") > 50, F.lit(True))  # absent where NULL
    documents = events.select(F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k"), high.alias("high"))).alias("doc"))
    return field_census(documents, "doc")


@query(
    "token_topk",
    """SELECT token, COUNT(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS token FROM part)
       GROUP BY token ORDER BY n DESC, token LIMIT 10""",
)
def token_topk(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.split("p_type", " ").alias("tokens"))
    return top_tokens(parts, "tokens", 10)


# ---- transforms, profiles


@query(
    "tr_delta_zigzag",
    """SELECT o_orderkey, CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS coded, d AS decoded
       FROM (SELECT o_orderkey, o_custkey - coalesce(lag(o_custkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey), 0) AS d FROM orders)""",
)
def tr_delta_zigzag(spark, sf_dir):
    d = tr.lag_delta(F.col("o_custkey"), [F.col("o_orderkey")], [F.col("o_orderpriority")])
    coded = table(spark, sf_dir, "orders").select("o_orderkey", tr.zigzag(d).alias("coded"))
    return coded.withColumn("decoded", tr.unzigzag(F.col("coded")))


@query("tr_category_code", "SELECT o_orderkey, o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code FROM orders")
def tr_category_code(spark, sf_dir):
    return tr.category_codes(table(spark, sf_dir, "orders"), "o_orderpriority").select("o_orderkey", "o_orderpriority", "code")


@query(
    "tr_ts_delta",
    """SELECT event_id, s - coalesce(lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS delta
       FROM (SELECT *, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s FROM events)""",
)
def tr_ts_delta(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("s", tr.epoch_seconds(F.col("ts")))
    delta = tr.lag_delta(F.col("s"), [F.col("ts"), F.col("event_id")], [F.col("user_id")])
    return events.select("event_id", delta.alias("delta"))


@query(
    "tr_scaled_delta",
    "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents FROM orders",
)
def tr_scaled_delta(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", tr.scaled(F.col("o_totalprice"), 2).alias("cents"))


@query("tr_float32_error", "SELECT MAX(abs(l_extendedprice - CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE))) AS err FROM lineitem")
def tr_float32_error(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(tr.float32_error(F.col("l_extendedprice")).alias("err"))


@query("tr_quant_high", "SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE) AS l_extendedprice FROM lineitem")
def tr_quant_high(spark, sf_dir):
    return quantise(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), 1)[0]


@query("tr_json_keys", "SELECT DISTINCT unnest(json_keys(props)) AS key FROM events")
def tr_json_keys(spark, sf_dir):
    return tr.json_keys(table(spark, sf_dir, "events"), "props")


@query("tr_json_compact", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS v0 FROM events")
def tr_json_compact(spark, sf_dir):
    coded = tr.compact_json(table(spark, sf_dir, "events"), "props", ["k"])
    return coded.select("event_id", F.element_at("compact", F.lit(0)).alias("v0"))


@query(
    "profile_lineitem",
    """WITH cv AS (
         SELECT unnest([stddev(l_quantity) / avg(abs(l_quantity)), stddev(l_extendedprice) / avg(abs(l_extendedprice)),
                        stddev(l_discount) / avg(abs(l_discount)), stddev(l_tax) / avg(abs(l_tax))]) AS x FROM lineitem)
       SELECT COUNT(*) AS n_rows, 11 AS n_cols, round(4 / 11.0::DOUBLE, 6) AS floats, round(4 / 11.0::DOUBLE, 6) AS ints,
              round(2 / 11.0::DOUBLE, 6) AS texts, round(1 / 11.0::DOUBLE, 6) AS times,
              round((COUNT(DISTINCT l_returnflag) + COUNT(DISTINCT l_linestatus)) / 2.0::DOUBLE / COUNT(*), 6) AS cardinality,
              round((SELECT avg(least(10, x)) FROM cv), 5) AS variation
       FROM lineitem""",
)
def profile_lineitem(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    p = prof.profile_table(lines, sample_size=lines.count())
    ratios = [round(r, 6) for r in (p.float_col_ratio, p.int_col_ratio, p.str_col_ratio, p.ts_col_ratio, p.str_cardinality_mean)]
    return spark.createDataFrame(
        [(p.n_rows, p.n_cols, *ratios, round(p.float_cv_mean, 5))],
        "n_rows bigint, n_cols int, floats double, ints double, texts double, times double, cardinality double, variation double",
    )


@query("auto_codec_reason", "SELECT 'lzma2' AS codec, 0 AS quant")
def auto_codec_reason(spark, sf_dir):
    found = prof.auto_select(table(spark, sf_dir, "orders"), order_by=["o_orderkey"])
    return spark.createDataFrame([(found["codec"], found["quant"])], "codec string, quant int")


# ---- catalogue, over archives of the tables


def _catalogue(spark, sf_dir) -> cat.Catalog:
    """Archives with different codecs, precision, clustering and tags, registered under their names."""
    root, orders = scratch(spark, "catalogue"), table(spark, sf_dir, "orders")
    catalog = cat.Catalog(spark, f"{root}/entries")
    made = {
        "orders_all": (orders, {"codec": "lzma2", "partition_by": "o_orderstatus", "primary_key": "o_orderkey"}, ["hot"]),
        "orders_open": (orders.where("o_orderstatus = 'O'"), {}, ["hot", "part"]),
        "supplier_cold": (table(spark, sf_dir, "supplier"), {"codec": "vault", "quant": 2}, ["cold"]),
        "nation": (table(spark, sf_dir, "nation"), {"partition_by": "n_regionkey"}, []),
    }
    for name, (df, options, tags) in made.items():
        write_archive(df, f"{root}/{name}", **options)
        catalog.register(f"{root}/{name}", tags=tags)
    return catalog


@query(
    "catalog_search",
    """SELECT * FROM (SELECT 'orders_all' AS name, 'lzma2' AS codec, COUNT(*) AS rows FROM orders
         UNION ALL SELECT 'orders_open', 'zstd', COUNT(*) FROM orders WHERE o_orderstatus = 'O')
       WHERE rows >= (SELECT COUNT(*) // 4 FROM orders)""",
)
def catalog_search(spark, sf_dir):
    least = table(spark, sf_dir, "orders").count() // 4
    found = _catalogue(spark, sf_dir).search(name="orders", lossless_only=True, min_rows=least, columns_contain="o_totalprice")
    return found.select("name", "codec", "rows")


@query(
    "catalog_stats",
    """WITH n AS (SELECT (SELECT COUNT(*) FROM orders) AS o, (SELECT COUNT(*) FROM orders WHERE o_orderstatus = 'O') AS p,
                         (SELECT COUNT(*) FROM supplier) AS s, (SELECT COUNT(*) FROM nation) AS t)
       SELECT 4::BIGINT AS total_datasets, o + p + s + t AS total_rows, 3::BIGINT AS distinct_codecs, 2::BIGINT AS distinct_partitions,
              3::BIGINT AS lossless_count, 1::BIGINT AS vault_count, true AS mb_add_up FROM n""",
)
def catalog_stats(spark, sf_dir):
    catalog = _catalogue(spark, sf_dir)
    stored = catalog.search().agg(F.sum("mb")).first()[0]
    total = F.abs(F.col("total_mb") - F.lit(stored)) < 1e-6
    return cat.dataset_stats(catalog.datasets).select(
        "total_datasets", "total_rows", "distinct_codecs", "distinct_partitions", "lossless_count", "vault_count", total.alias("mb_add_up")
    )


@query(
    "catalog_cost",
    """SELECT unnest(['orders_all', 'orders_open', 'supplier_cold', 'nation']) AS name, 0.004::DOUBLE AS usd_a_gb,
              unnest(['lossless', 'lossless', 'medium', 'lossless']) AS quant""",
)
def catalog_cost(spark, sf_dir):
    catalog = _catalogue(spark, sf_dir)
    costs = cat.cost_report(catalog.datasets, "glacier").select("name", "cost_monthly_usd", "quant")
    sizes = catalog.search().select("name", "mb")
    rate = F.round(F.col("cost_monthly_usd") / F.col("mb") * 1024, 6)
    return costs.join(sizes, "name").select("name", rate.alias("usd_a_gb"), "quant")


@query("catalog_versions", "SELECT 'nation' AS name, 'n_regionkey' AS partition_col, COUNT(*) AS rows FROM nation")
def catalog_versions(spark, sf_dir):
    catalog = _catalogue(spark, sf_dir)
    entries = cat.dataset_versions(catalog.datasets, "nation").select("id", "name")
    return entries.join(catalog.search(), ["id", "name"]).select("name", "partition_col", "rows")


@query("catalog_after_append", "SELECT 'growing' AS name, 2 * COUNT(*) AS rows FROM supplier")
def catalog_after_append(spark, sf_dir):
    lake, supplier = ArchiveSession(spark, scratch(spark, "growing")), table(spark, sf_dir, "supplier")
    lake.freeze(supplier, "growing")
    lake.append(supplier, "growing")
    return lake.catalog.search(name="growing").select("name", "rows")


@query("catalog_registered", "SELECT 'nation' AS name, COUNT(*) AS rows FROM nation UNION ALL SELECT 'region', COUNT(*) FROM region")
def catalog_registered(spark, sf_dir):
    root = scratch(spark, "catalog")
    catalog = cat.Catalog(spark, f"{root}/entries")
    for name in ("nation", "region"):
        write_archive(table(spark, sf_dir, name), f"{root}/{name}")
        catalog.register(f"{root}/{name}")
        catalog.register(f"{root}/{name}")
    return catalog.search().select("name", "rows")


# ---- event time


@query(
    "stream_window_tumbling",
    """SELECT time_bucket(INTERVAL '1 hour', ts) AS hour_start, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2""",
)
def stream_window_tumbling(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    counts = tumbling(events, "ts", "1 hour", ["event_type"]).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("hour_start"), "event_type", "n")


@query(
    "session_window",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events
                  WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
            s AS (SELECT user_id, ts, SUM(new) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM g)
       SELECT user_id, MIN(ts) AS session_start, COUNT(*) AS n FROM s GROUP BY user_id, no""",
)
def session_window(spark, sf_dir):
    counts = sessions(table(spark, sf_dir, "events"), "ts", "6 hours", ["user_id"]).agg(F.count("*").alias("n"))
    return counts.select("user_id", F.col("session.start").cast("timestamp_ntz").alias("session_start"), "n")


@query("manifest_schema", "SELECT 'r_name' AS column_name, 'string' AS column_type UNION ALL SELECT 'r_regionkey', 'integer'")
def manifest_schema(spark, sf_dir):
    path, _ = _round_trip(table(spark, sf_dir, "region"), "schema")
    fields = read_manifest(spark, path).schema["fields"]
    return spark.createDataFrame([(f["name"], json.dumps(f["type"]).strip('"')) for f in fields], "column_name string, column_type string")


# ---- sources, sinks and recipes


@query("source_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def source_csv(spark, sf_dir):
    path = scratch(spark, "csv") + "/customer.csv"
    customer = table(spark, sf_dir, "customer")
    write_file(customer, path)
    return read_source(spark, path, customer.schema)


@query("source_jsonl", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def source_jsonl(spark, sf_dir):
    path = scratch(spark, "jsonl") + "/nation.jsonl"
    write_file(table(spark, sf_dir, "nation"), path)
    return read_source(spark, path)


@query("source_parquet", "SELECT * FROM part")
def source_parquet(spark, sf_dir):
    path = scratch(spark, "parquet") + "/part.parquet"
    write_file(table(spark, sf_dir, "part"), path)
    return read_source(spark, path)


@query("source_row_range", "SELECT 50 AS n")
def source_row_range(spark, sf_dir):
    rows = RangeSource(spark, f"{sf_dir.rstrip('/')}/customer.parquet").rows(10, 60)
    return rows.agg(F.count("*").cast("int").alias("n"))


@query("archives_union", "SELECT * FROM nation")
def archives_union(spark, sf_dir):
    root, nation = scratch(spark, "union"), table(spark, sf_dir, "nation")
    for k in range(3):
        write_archive(nation.where(F.col("n_nationkey") % 3 == k), f"{root}/part{k}")
    return read_archives(spark, f"{root}/part*")


@query("format_read", "SELECT * FROM supplier WHERE s_nationkey = 3")
def format_read(spark, sf_dir):
    """Rows through ``spark.read.format``."""
    path, _ = _round_trip(table(spark, sf_dir, "supplier"), "format", partition_by="s_nationkey")
    register_format(spark)
    return spark.read.format("coldlake").load(path).where("s_nationkey = 3")


@query("format_write", "SELECT * FROM supplier UNION ALL SELECT * FROM supplier WHERE s_nationkey < 9")
def format_write(spark, sf_dir):
    """Rows written, and appended to, through ``df.write.format``; files are checked before they are read."""
    register_format(spark)
    path, supplier = scratch(spark, "format-write"), table(spark, sf_dir, "supplier")
    supplier.repartition(3).write.format("coldlake").mode("overwrite").save(path)
    supplier.where("s_nationkey < 9").write.format("coldlake").mode("append").save(path)
    return read_archive(spark, path, verify=True)


@query("row_range_many_files", "SELECT c_custkey FROM customer WHERE c_custkey BETWEEN 101 AND 110")
def row_range_many_files(spark, sf_dir):
    """A task that writes more than 1000 files numbers them past three digits."""
    path = scratch(spark, "many")
    write_archive(spark.range(1, 1101).coalesce(1).withColumnRenamed("id", "c_custkey"), path, chunk_rows=1, sha256=False)
    return read_archive(spark, path, row_range=(100, 109))


@query("prune_nan", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS x FROM orders WHERE o_orderkey % 7 <> 0 AND o_totalprice BETWEEN 1000 AND 90000")
def prune_nan(spark, sf_dir):
    """Files that also hold NaN are not pruned away; NaN itself lies above the range."""
    x = F.when(F.col("o_orderkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    path, _ = _round_trip(table(spark, sf_dir, "orders").select("o_orderkey", x.alias("x")), "nan", chunk_rows=100)
    return read_archive(spark, path, filter={"x": (1000.0, 90000.0)})


@query("prune_decimal", "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS x FROM orders WHERE o_totalprice BETWEEN 9500.5 AND 100000")
def prune_decimal(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("x"))
    path, _ = _round_trip(orders, "decimal", chunk_rows=100)
    return read_archive(spark, path, filter={"x": (Decimal("9500.50"), Decimal("100000.00"))})


@query(
    "compact_row_range",
    """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders)
       WHERE rn BETWEEN 50 AND 333""",
)
def compact_row_range(spark, sf_dir):
    path, _ = _round_trip(table(spark, sf_dir, "orders"), "compact-range", partition_by="o_orderkey", chunk_rows=70)
    compact(spark, path, 400)
    return read_archive(spark, path, row_range=(50, 333), verify=True)


@query("roundtrip_encrypted_ts", "SELECT event_id, epoch_us(ts) AS micros FROM events")
def roundtrip_encrypted_ts(spark, sf_dir):
    """Instants written under one time zone and read under another."""
    path, key = scratch(spark, "sealed-ts"), b"0123456789abcdef"
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        micros = F.unix_micros(F.col("ts").cast("timestamp"))
        instants = table(spark, sf_dir, "events").select("event_id", F.timestamp_micros(micros).alias("ts"))
        instants = spark.createDataFrame(instants.toArrow())  # fixed before the zone changes
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        write_archive(instants, path, key=key)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    return read_archive(spark, path, key=key).select("event_id", F.unix_micros("ts").alias("micros"))


@query("source_csv_quoted", "SELECT n_nationkey, n_name || ' \"q\"' || chr(10) || 'x,y' AS n_name FROM nation")
def source_csv_quoted(spark, sf_dir):
    path = scratch(spark, "csv-quoted") + "/nation.csv"
    name = F.concat("n_name", F.lit(' "q"\nx,y')).alias("n_name")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", name)
    write_file(nation, path)
    return read_source(spark, path, nation.schema)


@query("source_json", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region")
def source_json(spark, sf_dir):
    """A list of documents laid out over several lines."""
    path = scratch(spark, "json") + "/region.json"
    rows = [r.asDict() for r in table(spark, sf_dir, "region").collect()]
    Files(spark).write_text(path, json.dumps(rows, indent=2))
    return read_source(spark, path)


@query("recipe_run", "SELECT COUNT(*) AS n, COUNT(DISTINCT r_name) AS names FROM region")
def recipe_run(spark, sf_dir):
    out = scratch(spark, "recipe")
    run_recipe(spark, parse_recipe({"name": "r", "source": f"{sf_dir.rstrip('/')}/region.parquet", "output": out, "codec": "lzma2"}))
    return read_archive(spark, out).agg(F.count("*").alias("n"), F.count_distinct("r_name").alias("names"))


@query("copy_between_stores", "SELECT * FROM region")
def copy_between_stores(spark, sf_dir):
    source, target = scratch(spark, "copy-from"), scratch(spark, "copy-to")
    write_archive(table(spark, sf_dir, "region"), source)
    copy_archive(source, target)
    return read_archive(spark, target, verify=True)


@query("tr_quant_medium", "SELECT o_orderkey, round_even(o_totalprice, 0) AS o_totalprice, o_orderdate FROM orders")
def tr_quant_medium(spark, sf_dir):
    return quantise(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate"), 2)[0]


@query("detect_kind", "SELECT 'tabular' AS kind, 6 AS n_fields, 0 AS nullable_fields")
def detect_kind(spark, sf_dir):
    found = tabular(table(spark, sf_dir, "part"))
    row = (found.kind.value, len(found.fields), sum(f.nullable for f in found.fields))
    return spark.createDataFrame([row], "kind string, n_fields int, nullable_fields int")


@query("compacted", "SELECT * FROM supplier")
def compacted(spark, sf_dir):
    path, _ = _round_trip(table(spark, sf_dir, "supplier"), "compact", chunk_rows=7)
    compact(spark, path, 1000)
    return read_archive(spark, path, verify=True)


# ---- joins over ranges and correlated subqueries, functions, jobs, streams, caches and wrapped keys


@query(
    "join_interval",
    """SELECT s_suppkey, COUNT(*) AS n, MIN(event_id) AS first_event FROM events JOIN supplier
       ON value >= s_suppkey % 90 AND value < s_suppkey % 90 + s_suppkey % 7 + 0.5 GROUP BY s_suppkey""",
)
def join_interval(spark, sf_dir):
    """A range join with intervals of unequal widths."""
    start = (F.col("s_suppkey") % 90).cast("double")
    spans = table(spark, sf_dir, "supplier").select("s_suppkey", start.alias("start"), (start + F.col("s_suppkey") % 7 + 0.5).alias("stop"))
    events = table(spark, sf_dir, "events").select("event_id", "value")
    found = interval_join(events, spans, "value", "start", "stop")
    return found.groupBy("s_suppkey").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


_LATERAL = """SELECT c_custkey, t.o_orderkey, t.o_totalprice FROM customer, LATERAL (
       SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t"""


@query("join_lateral", _LATERAL)
def join_lateral(spark, sf_dir):
    """The two dearest orders of each customer."""
    views(spark, sf_dir, "customer", "orders")
    return spark.sql(_LATERAL)


@query(
    "fn_text_time",
    """SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month_start, CAST(month(o_orderdate) AS INTEGER) AS month_no, COUNT(*) AS n,
              COUNT(*) FILTER (o_orderpriority ILIKE '%urg%') AS urgent, AVG(length(o_orderpriority)) AS mean_length
       FROM orders GROUP BY ALL""",
)
def fn_text_time(spark, sf_dir):
    date = F.col("o_orderdate")
    months = table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", date).cast("timestamp_ntz").alias("month_start"), F.month(date).alias("month_no"))
    urgent = F.count_if(F.col("o_orderpriority").ilike("%urg%")).alias("urgent")
    return months.agg(F.count("*").alias("n"), urgent, F.avg(F.length("o_orderpriority")).alias("mean_length"))


@query(
    "fn_array_map",
    """SELECT vec_id, len(embedding) AS dims, CAST(list_max(embedding) AS DOUBLE) AS top, list_position(embedding, list_max(embedding))::BIGINT AS top_at,
              len(list_filter(embedding, lambda x: x > 0)) AS positive, CAST(embedding[2] AS DOUBLE) AS second,
              list_contains(map_keys(MAP {'a': label, 'b': 1}), 'b') AS has_b, (MAP {'a': label, 'b': 1})['a'] AS a
       FROM embeddings""",
)
def fn_array_map(spark, sf_dir):
    vector, top = F.col("embedding"), F.array_max("embedding")
    pairs = F.create_map(F.lit("a"), F.col("label"), F.lit("b"), F.lit(1))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.size(vector).cast("long").alias("dims"),
        top.cast("double").alias("top"),
        F.array_position(vector, top).alias("top_at"),
        F.size(F.filter(vector, lambda x: x > 0)).cast("long").alias("positive"),
        F.try_element_at(vector, F.lit(2)).cast("double").alias("second"),
        F.array_contains(F.map_keys(pairs), "b").alias("has_b"),
        F.element_at(pairs, "a").alias("a"),
    )


@query("tr_json_expand", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def tr_json_expand(spark, sf_dir):
    """Keys found, replaced by numbers and brought back."""
    events = table(spark, sf_dir, "events")
    keys = tr.key_list(events, "props")
    back = tr.expand_json(tr.compact_json(events, "props", keys, typed=True), "compact", keys)
    return back.select("event_id", F.get_json_object("json", "$.k").alias("k"))


@query(
    "json_late_types",
    """SELECT event_id, CASE WHEN event_id % 1000 = 999 THEN event_id + 0.5 ELSE event_id END::DOUBLE AS x,
              CASE WHEN event_id % 1000 = 998 THEN 'text' ELSE '7' END AS y FROM events""",
)
def json_late_types(spark, sf_dir):
    """Fields whose type a sample of documents need not show."""
    number = F.expr("IF(event_id % 1000 = 999, event_id + 0.5, event_id)").cast("double")
    shown = F.when(number == F.floor(number), number.cast("long").cast("string")).otherwise(number.cast("string"))
    y = F.expr("IF(event_id % 1000 = 998, '\"text\"', '7')")
    doc = F.concat(F.lit('{"event_id":'), "event_id", F.lit(',"x":'), shown, F.lit(',"y":'), y, F.lit("}"))
    found = flatten(table(spark, sf_dir, "events").select(doc.alias("value"))).df
    return found.select("event_id", F.col("x").cast("double").alias("x"), F.col("y").cast("string").alias("y"))


@query("job_run", "SELECT 'done' AS state, 1.0::DOUBLE AS progress, COUNT(*) AS n FROM orders")
def job_run(spark, sf_dir):
    runner = JobRunner(spark)
    number = runner.submit(lambda: table(spark, sf_dir, "orders").count(), "count")
    n = runner.wait(number)
    status = runner.status(number)
    return spark.createDataFrame([(status["state"], status["progress"], n)], "state string, progress double, n long")


@query(
    "stream_late_data",
    """SELECT time_bucket(INTERVAL '1 hour', ts) AS hour_start, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2
       HAVING time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' <= (SELECT MAX(ts) FROM events) - INTERVAL '2 hours'""",
)
def stream_late_data(spark, sf_dir):
    """A stream with a watermark: it gives the hours that can get no more rows and holds the later ones back."""
    schema = table(spark, sf_dir, "events").schema
    path = scratch(spark, "stream")
    table(spark, sf_dir, "events").coalesce(1).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{path}/in").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = tumbling(stream, "ts", "1 hour", ["event_type"], late="2 hours").agg(F.count("*").alias("n"))
    closed = counts.select(F.col("window.start").alias("hour_start"), "event_type", "n")
    stream_to_table(closed, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    found = spark.read.schema(closed.schema).parquet(f"{path}/out")
    return found.withColumn("hour_start", F.col("hour_start").cast("timestamp_ntz"))


@query("cached_archive", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def cached_archive(spark, sf_dir):
    """Read from a copy that was renewed after the archive grew."""
    path, suppliers = scratch(spark, "far"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    write_archive(suppliers.where("s_suppkey % 2 = 0"), path)
    cache = ArchiveCache(spark, scratch(spark, "cache"), ttl=0)
    cache.fetch(path)
    append_archive(suppliers.where("s_suppkey % 2 = 1"), path)
    return read_archive(spark, cache.fetch(path), verify=True)


@query("roundtrip_envelope", "SELECT n_nationkey, n_name FROM nation")
def roundtrip_envelope(spark, sf_dir):
    """Encrypted with a data key that is kept wrapped; the reader unwraps it."""
    path, service = scratch(spark, "envelope"), SparkKeyService(spark, generate_key())
    made = EnvelopeKey.create(service)
    write_archive(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path, key=made.key())
    return read_archive(spark, path, key=EnvelopeKey(service, made.wrapped).key())
