"""Domain tables over the Parquet inputs: which input column plays which part of the evidence model.

Every query goes through these projections, so a deployment replaces this module by its own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Fixed clocks in place of now().
EVIDENCE_NOW, EVENTS_NOW = "2002-01-01 00:00:00", "2024-01-31 00:00:00"


#: Half-lives in days of the categories that have their own; None: evidence does not age.
HALF_LIVES: dict[str, float | None] = {"1-URGENT": 180.0, "5-LOW": None}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence rows: one per line item, claim by order, independence group by supplier."""
    li = read(spark, sf_dir, "lineitem")
    tier = F.pmod(F.round(F.col("l_tax") * 100).cast("int"), F.lit(5))
    return li.select(
        F.col("l_orderkey").alias("claim_id"),
        F.col("l_partkey").alias("observation_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_suppkey").alias("grp"),
        F.when(F.col("l_returnflag") == "R", "contradicts").otherwise("supports").alias("stance"),
        tier.alias("tier"),
        (F.col("l_linestatus") == "O").alias("active"),
        (F.col("l_discount") < 0.05).alias("quote_verified"),
        F.col("l_shipdate").alias("evidence_at"),
        F.when(F.col("l_linenumber") >= 6, F.col("l_linenumber")).alias("audience"),
        (F.col("l_extendedprice") < 20000.0).alias("human"),
        F.when(F.col("l_linenumber") % 4 == 3, F.col("l_quantity") > 25).alias("version_match"),
    )


EVIDENCE_SQL = """SELECT l_orderkey AS claim_id, l_partkey AS observation_id, l_linenumber AS line, l_suppkey AS grp,
  CASE WHEN l_returnflag = 'R' THEN 'contradicts' ELSE 'supports' END AS stance,
  CAST(round(l_tax * 100) AS INT) % 5 AS tier, l_linestatus = 'O' AS active, l_discount < 0.05::DOUBLE AS quote_verified,
  l_shipdate AS evidence_at, CASE WHEN l_linenumber >= 6 THEN l_linenumber END AS audience,
  l_extendedprice < 20000.0::DOUBLE AS human, CASE WHEN l_linenumber % 4 = 3 THEN l_quantity > 25 END AS version_match
FROM lineitem"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims: one per order, category by priority."""
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("claim_id"),
        F.col("o_custkey").alias("author_id"),
        F.col("o_orderpriority").alias("category"),
        F.when(F.col("o_orderstatus") == "F", "retracted").otherwise("active").alias("lifecycle"),
        (F.col("o_orderkey") % 29 == 0).alias("human_verified"),
        (F.col("o_orderkey") % 23 == 0).alias("open_conflict"),
        F.col("o_orderdate").alias("created_at"),
    )


CLAIMS_SQL = """SELECT o_orderkey AS claim_id, o_custkey AS author_id, o_orderpriority AS category,
  CASE WHEN o_orderstatus = 'F' THEN 'retracted' ELSE 'active' END AS lifecycle,
  o_orderkey % 29 = 0 AS human_verified, o_orderkey % 23 = 0 AS open_conflict, o_orderdate AS created_at
FROM orders"""
