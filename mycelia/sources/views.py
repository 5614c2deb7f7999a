"""Graphs in the test tables. Each view gives (vertices, edges); edges have one direction and ids run from 0 without gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mycelia.operators.normalize import dense_ids
from mycelia.session import checkpoint_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _long(name: str) -> Column:
    return F.col(name).cast("long")


def _ids(df: DataFrame, id_: Column) -> DataFrame:
    return df.select(id_.alias("id"))


def _edges(df: DataFrame, src: Column, dst: Column) -> DataFrame:
    return df.select(src.alias("src"), dst.alias("dst"))


def region_nation(spark: SparkSession, sf_dir: str):
    region, nation = _table(spark, sf_dir, "region"), _table(spark, sf_dir, "nation")
    own = _long("n_nationkey") + region.count()
    return _ids(region, _long("r_regionkey")).union(_ids(nation, own)), _edges(nation, own, _long("n_regionkey"))


def conversation_chain(spark: SparkSession, sf_dir: str):
    checkpoint_dir(spark)
    turns = dense_ids(_table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn")
    later = F.lead("id").over(Window.partitionBy("conv_id").orderBy("turn"))
    return turns.select("id"), turns.select(F.col("id").alias("src"), later.alias("dst")).dropna()


def _order_part(spark: SparkSession, sf_dir: str, lines: DataFrame):
    orders, parts = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "part")
    n = orders.count()
    return _ids(orders, _long("o_orderkey")).union(_ids(parts, _long("p_partkey") + n)), _edges(lines, _long("l_orderkey"), _long("l_partkey") + n)


def order_part(spark: SparkSession, sf_dir: str):
    return _order_part(spark, sf_dir, _table(spark, sf_dir, "lineitem").filter("l_quantity = 50"))


def part_supplier(spark: SparkSession, sf_dir: str):
    parts, suppliers = _table(spark, sf_dir, "part"), _table(spark, sf_dir, "supplier")
    n = parts.count()
    return _ids(parts, _long("p_partkey")).union(_ids(suppliers, _long("s_suppkey") + n)), _edges(_table(spark, sf_dir, "lineitem"), _long("l_partkey"), _long("l_suppkey") + n)


def customer_orders(spark: SparkSession, sf_dir: str):
    orders, customers = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    n = orders.count()
    return _ids(orders, _long("o_orderkey")).union(_ids(customers, _long("c_custkey") + n)), _edges(orders, _long("o_orderkey"), _long("o_custkey") + n)


def _next_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _table(spark, sf_dir, "events").select("event_id", "ts", F.lead("event_id").over(by_user).alias("next_id"), F.lead("ts").over(by_user).alias("next_ts"))


def event_sessions(spark: SparkSession, sf_dir: str):
    near = _next_events(spark, sf_dir).filter(F.col("next_ts") <= F.col("ts") + F.expr("INTERVAL 6 HOURS"))
    return _ids(_table(spark, sf_dir, "events"), _long("event_id")), _edges(near, _long("event_id"), _long("next_id"))


def event_chain(spark: SparkSession, sf_dir: str):
    return _ids(_table(spark, sf_dir, "events"), _long("event_id")), _edges(_next_events(spark, sf_dir).filter("next_id IS NOT NULL"), _long("event_id"), _long("next_id"))


def document_copies(spark: SparkSession, sf_dir: str):
    docs = _table(spark, sf_dir, "documents").select(_long("doc_id").alias("id"), F.sha2("text", 256).alias("digest"))
    first = docs.groupBy("digest").agg(F.min("id").alias("first"))
    return docs.select("id"), docs.join(first, "digest").select(F.col("first").alias("src"), F.col("id").alias("dst"))


VIEWS = {"g1": region_nation, "g2": conversation_chain, "g3": order_part, "g4": part_supplier, "g5": customer_orders, "g6": event_sessions, "g7": event_chain, "g8": document_copies}

_EVENTS_SQL = "SELECT event_id, ts, lead(event_id) OVER w AS next_id, lead(ts) OVER w AS next_ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
_TURNS_SQL = "SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS id FROM conversations"
#: The same in SQL: vertices, edges.
VIEWS_SQL = {
    "g1": ("SELECT CAST(r_regionkey AS BIGINT) AS id FROM region UNION ALL SELECT n_nationkey + (SELECT count(*) FROM region) FROM nation", "SELECT n_nationkey + (SELECT count(*) FROM region) AS src, CAST(n_regionkey AS BIGINT) AS dst FROM nation"),
    "g2": (f"SELECT id FROM ({_TURNS_SQL})", f"SELECT * FROM (SELECT id AS src, lead(id) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM ({_TURNS_SQL})) WHERE dst IS NOT NULL"),
    "g3": ("SELECT o_orderkey AS id FROM orders UNION ALL SELECT p_partkey + (SELECT count(*) FROM orders) FROM part", "SELECT l_orderkey AS src, l_partkey + (SELECT count(*) FROM orders) AS dst FROM lineitem WHERE l_quantity = 50"),
    "g4": ("SELECT p_partkey AS id FROM part UNION ALL SELECT s_suppkey + (SELECT count(*) FROM part) FROM supplier", "SELECT l_partkey AS src, l_suppkey + (SELECT count(*) FROM part) AS dst FROM lineitem"),
    "g5": ("SELECT o_orderkey AS id FROM orders UNION ALL SELECT c_custkey + (SELECT count(*) FROM orders) FROM customer", "SELECT o_orderkey AS src, o_custkey + (SELECT count(*) FROM orders) AS dst FROM orders"),
    "g6": ("SELECT event_id AS id FROM events", f"SELECT event_id AS src, next_id AS dst FROM ({_EVENTS_SQL}) WHERE next_ts <= ts + INTERVAL 6 HOUR"),
    "g7": ("SELECT event_id AS id FROM events", f"SELECT event_id AS src, next_id AS dst FROM ({_EVENTS_SQL}) WHERE next_id IS NOT NULL"),
    "g8": ("SELECT doc_id AS id FROM documents", "SELECT min(doc_id) OVER (PARTITION BY text) AS src, doc_id AS dst FROM documents"),
}
