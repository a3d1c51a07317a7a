"""Queries: readers and writers, as round trips of the given tables through the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from aisle.plans.registry import query
from aisle.session import scratch_path
from aisle.sources import readers, writers
from aisle.streaming import incremental

_ORDER_SCHEMA = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, order_date date"
_BY_STATUS = """SELECT o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS value, max(CAST(o_orderdate AS DATE)) AS last
FROM orders GROUP BY 1"""


def _dated(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("order_date"))


def _by_status(df):
    return df.groupBy("o_orderstatus").agg(
        F.count("o_orderkey").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("value"),
        F.max("order_date").alias("last"))


def _table_name():
    return f"aisle_{uuid.uuid4().hex}"


@query("src01_read_csv", _BY_STATUS)
def read_csv(t):
    path = scratch_path(t.spark, "csv")
    _dated(t).write.options(header=True, sep="|").csv(path)
    return _by_status(readers.read_csv(t.spark, path, _ORDER_SCHEMA, sep="|"))


@query("src02_read_month", """
SELECT o_orderstatus, count(*) AS orders FROM orders WHERE date_trunc('month', o_orderdate) = DATE '2000-03-01' GROUP BY 1
""")
def read_month(t):
    path = scratch_path(t.spark, "months")
    monthly = _dated(t).withColumn("month", F.date_format("order_date", "yyyy-MM"))
    writers.write_partitions(monthly, path, "month")
    return readers.read_month(t.spark, path, "2000-03").groupBy("o_orderstatus").agg(F.count("o_orderkey").alias("orders"))


@query("src03_latest_snapshot", "SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def latest_snapshot(t):
    path = scratch_path(t.spark, "snapshots")
    version = F.when(F.col("o_orderstatus") == "O", 3).when(F.col("o_orderstatus") == "F", 2).otherwise(1)
    t.orders.select("o_custkey", "o_orderkey", version.alias("version")).write.partitionBy("version").parquet(path)
    return readers.read_latest_snapshot(t.spark, path)


@query("src04_read_table", "SELECT p_type, count(*) AS products FROM part GROUP BY 1")
def read_table(t):
    name = _table_name()
    writers.save_table(t.part, name, path=scratch_path(t.spark, "table"))
    return readers.read_table(t.spark, name).groupBy("p_type").agg(F.count("p_partkey").alias("products"))


@query("src05_read_many", """
SELECT source, count(*) AS rows, round(sum(value), 2) AS value FROM (
  SELECT 'orders' AS source, o_totalprice AS value FROM orders UNION ALL SELECT 'customers', c_acctbal FROM customer) x GROUP BY 1
""")
def read_many(t):
    """Two good folders, one of another format and one that is not there."""
    base = scratch_path(t.spark, "many")
    t.orders.select(F.lit("orders").alias("source"), F.col("o_totalprice").alias("value"), "o_orderkey").write.parquet(f"{base}/a")
    t.customer.select(F.lit("customers").alias("source"), F.col("c_acctbal").alias("value")).write.parquet(f"{base}/b")
    t.nation.select("n_name").write.text(f"{base}/c")
    merged, _ = readers.read_files(t.spark, *[f"{base}/{x}" for x in ("a", "b", "c", "missing")])
    return merged.groupBy("source").agg(F.count("source").alias("rows"), F.round(F.sum("value"), 2).alias("value"))


@query("src06_promote_header", "SELECT CAST(c_custkey AS VARCHAR) AS outlet_code, c_name AS outlet_name FROM customer")
def promote_header(t):
    top = t.spark.createDataFrame(
        [(-3, "Outlet report", None), (-2, None, None), (-1, "outlet_code", "outlet_name")], "line bigint, _c0 string, _c1 string")
    raw = top.union(t.customer.select("c_custkey", F.col("c_custkey").cast("string"), "c_name"))
    return readers.promote_header(raw, "line", 2)


@query("src07_tag_source", "SELECT o_orderkey, o_orderstatus AS shop FROM orders")
def tag_source(t):
    path = scratch_path(t.spark, "shops")
    writers.write_by_group(t.orders.select("o_orderkey", F.col("o_orderstatus").alias("shop")), path, "shop")
    return readers.tag_source(t.spark.read.parquet(f"{path}/*"), "shop=([A-Z])", "shop")


@query("src08_report_range", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS report_start, CAST(o_orderdate AS DATE) + 6 AS report_end FROM orders
""")
def report_range(t):
    start = F.to_date("o_orderdate")
    text = F.concat(F.lit("Shop "), F.col("o_custkey").cast("string"), F.lit(" report "), start.cast("string"),
                    F.lit(" ~ "), F.date_add(start, 6).cast("string"), F.lit(" (local)"))
    return t.orders.select("o_orderkey", *readers.parse_report_range(text))


@query("snk01_write_parquet", "SELECT 3 AS files, count(*) AS rows FROM orders")
def write_parquet(t):
    path = scratch_path(t.spark, "files")
    writers.write_parquet(t.orders, path, 3)
    stored = t.spark.read.parquet(path)
    return stored.agg(F.count_distinct("_metadata.file_name").cast("int").alias("files"), F.count("o_orderkey").alias("rows"))


@query("snk02_save_table", "SELECT c_mktsegment, count(*) AS outlets, max(c_nationkey) AS last_nation FROM customer GROUP BY 1")
def save_table(t):
    name, path = _table_name(), scratch_path(t.spark, "table")
    writers.save_table(t.customer.select("c_custkey", "c_mktsegment"), name, path=path)
    writers.save_table(t.customer.select("c_custkey", "c_mktsegment", "c_nationkey"), name, "c_mktsegment", path=path)
    return t.spark.read.table(name).groupBy("c_mktsegment").agg(
        F.count("c_custkey").alias("outlets"), F.max("c_nationkey").alias("last_nation"))


@query("snk03_write_partitions", """
SELECT o_orderstatus, count(*) AS orders, round(sum(CASE WHEN o_orderstatus = 'F' THEN 2 * o_totalprice ELSE o_totalprice END), 2)
       AS value FROM orders GROUP BY 1
""")
def write_partitions(t):
    path = scratch_path(t.spark, "partitions")
    orders = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    writers.write_partitions(orders, path, "o_orderstatus")
    doubled = orders.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    writers.write_partitions(doubled, path, "o_orderstatus")
    return t.spark.read.parquet(path).groupBy("o_orderstatus").agg(
        F.count("o_orderkey").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("value"))


@query("snk04_append_new", "SELECT l_orderkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1")
def append_new(t):
    path = scratch_path(t.spark, "append")
    lines = t.lineitem.select("l_orderkey", "l_partkey")
    first = lines.join(t.orders.where("o_orderstatus = 'F'").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    incremental.append_new(first, path, ["l_orderkey"], ["l_partkey"])
    incremental.append_new(lines, path, ["l_orderkey"], ["l_partkey"])
    return t.spark.read.parquet(path)


@query("snk05_write_by_group", "SELECT p_type, p_partkey, p_name FROM part")
def write_by_group(t):
    path = scratch_path(t.spark, "groups")
    writers.write_by_group(t.part.select("p_type", "p_partkey", "p_name"), path, "p_type")
    return t.spark.read.parquet(path).select("p_type", "p_partkey", "p_name")


@query("snk06_register_csv", "SELECT s_nationkey, count(*) AS sites, round(sum(s_acctbal), 2) AS balance FROM supplier GROUP BY 1")
def register_csv(t):
    name, path = _table_name(), scratch_path(t.spark, "csv")
    t.supplier.write.options(header=True).csv(path)
    writers.register_csv(t.spark, name, path)
    return t.spark.read.table(name).groupBy("s_nationkey").agg(
        F.count("s_suppkey").alias("sites"), F.round(F.sum("s_acctbal"), 2).alias("balance"))
