"""The property graph read from the order tables: deployables, observations and environment-scoped edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweft.functions.ranks import confidence_rank, provenance_rank
from depweft.runtime import table


def deployables(spark: SparkSession, d: str) -> DataFrame:
    """``id, repo_id, name, kind``: one per supplier; the repository is region:nation/supplier."""
    supplier, nation, region = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"),
            F.concat(F.lower("r_name"), F.lit(":"), F.lower("n_name"), F.lit("/"), F.col("s_name")).alias("repo_id"),
            F.col("s_name").alias("name"),
            F.lit("service").alias("kind"),
        )
    )


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Every 'supplier a depends on supplier b' seen between neighbouring lines of an order."""
    lines = table(spark, d, "lineitem")
    a = lines.filter(F.col("l_quantity") >= 48).select("l_orderkey", F.col("l_linenumber").alias("ln"), F.col("l_suppkey").alias("src_key"), "l_returnflag")
    b = lines.filter(F.col("l_quantity") >= 40).select("l_orderkey", (F.col("l_linenumber") - 1).alias("ln"), F.col("l_suppkey").alias("dst_key"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    flag, status, priority = F.col("l_returnflag"), F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    return (
        a.join(b, ["l_orderkey", "ln"])
        .filter(F.col("src_key") != F.col("dst_key"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            "src_key", "dst_key", "o_orderkey", "ln", flag.alias("flag"),
            F.when(status == "F", "prod").when(status == "O", "staging").otherwise("dev").alias("env"),
            F.when(flag == "A", "high").when(flag == "N", "medium").otherwise("low").alias("confidence"),
            F.when(priority.isin("1", "2"), "declared").when(priority == "3", "injected").when(priority == "4", "observed").otherwise("llm-judged").alias("provenance"),
            F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("deployed_ref"),
        )
    )


def winners(observed: DataFrame) -> DataFrame:
    """One edge per (from_id, to_id, env): the lowest (order, line, confidence, provenance)."""
    order = F.struct("o_orderkey", "ln", confidence_rank(F.col("confidence")).alias("c"), provenance_rank(F.col("provenance")).alias("p"), "confidence", "provenance", "deployed_ref")
    return observed.groupBy("from_id", "to_id", "env").agg(F.min(order).alias("w")).select(
        "from_id", "to_id", "env", "w.confidence", "w.provenance", "w.deployed_ref"
    )


def supplier_observations(spark: SparkSession, d: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("s"), F.col(c).cast("string"))
    return observations(spark, d).withColumn("from_id", name("src_key")).withColumn("to_id", name("dst_key"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Supplier-grain edges."""
    return winners(supplier_observations(spark, d))


def nation_edges(spark: SparkSession, d: str) -> DataFrame:
    """Nation-grain edges: dense and cyclic, with pairs shared between environments."""
    nations = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("n"))
    obs = observations(spark, d)
    obs = obs.join(nations.withColumnRenamed("n", "from_id"), obs["src_key"] == F.col("s_suppkey")).drop("s_suppkey")
    obs = obs.join(nations.withColumnRenamed("n", "to_id"), obs["dst_key"] == F.col("s_suppkey")).drop("s_suppkey")
    return winners(obs.filter(F.col("from_id") != F.col("to_id")))
