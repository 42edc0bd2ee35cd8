"""Graphs, logs and snapshots that stand in the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def successor_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts, linked to the part on the next line of an order: nodes(id), edges(src, dst)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    edges = lines.join(after, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("src"), "dst").where("src <> dst").distinct()
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), edges


SUCCESSOR_SQL = """
se AS (
  SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a
  JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey
), sn AS (SELECT p_partkey AS id FROM part)"""


def trade_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations, each linked to every other one whose suppliers its customers buy from."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("src"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    edges = lines.join(orders, "l_orderkey").join(customer, "o_custkey").join(supplier, "l_suppkey").where("src <> dst").select("src", "dst").distinct()
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")), edges


TRADE_SQL = """
te AS (
  SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey
), tn AS (SELECT n_nationkey AS id FROM nation)"""


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commits: (commit_hash, ts, path, added, deleted)."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("commit_hash"),
        F.unix_timestamp("ts").alias("ts"),
        F.concat_ws("/", F.concat(F.lit("u"), F.col("user_id").cast("string")), "event_type").alias("path"),
        F.floor(F.coalesce("value", F.lit(0.0))).cast("long").alias("added"),
        F.lit(0).cast("long").alias("deleted"),
    )


LOG_SQL = """
log AS (
  SELECT event_id, floor(epoch(ts))::BIGINT AS ts, 'u' || user_id || '/' || event_type AS path, floor(coalesce(value, 0))::BIGINT AS added FROM events
)"""


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Python sources: (id, language, source)."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("python").alias("language"), F.col("text").alias("source"))


def log_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the commits of a version log: (block). Each is a commit of one file; an event
    without a value is a binary change."""
    value = F.floor("value").cast("long")
    head = F.concat(F.lower(F.lpad(F.hex("event_id"), 8, "0")), F.lit("\t"), F.unix_timestamp("ts").cast("string"))
    path = F.concat_ws("/", F.concat(F.lit("u"), F.col("user_id").cast("string")), "event_type")
    row = F.concat(F.coalesce(value.cast("string"), F.lit("-")), F.lit("\t"), F.coalesce((value % 7).cast("string"), F.lit("-")), F.lit("\t"), path)
    return table(spark, sf_dir, "events").select(F.concat(head, F.lit("\n\n"), row, F.lit("\n")).alias("block"))
