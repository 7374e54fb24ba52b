"""Registered queries of problems 1, 6, 7 and 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweft.functions.text import strip_space
from depweft.llm import canonical, leakage, mixing, sentences
from depweft.runtime import table

_ENV_ID = r"^Environments-\d+$"


def _typed_names(spark: SparkSession, d: str) -> DataFrame:
    """Every typed environment name as ``src, row_key, pos, name``; environment ids and whole-row duplicates left out."""
    environments = table(spark, d, "environments").select(
        F.lit("environments.name").alias("src"), F.col("env_row").alias("row_key"), F.lit(0).cast("bigint").alias("pos"), "name"
    )
    preview = table(spark, d, "variable_preview").select("preview_row", F.posexplode("scope.environment").alias("p", "name")).select(
        F.lit("variable_preview.environment").alias("src"), F.col("preview_row").alias("row_key"), (F.col("p") + 1).cast("bigint").alias("pos"), "name"
    )
    return environments.unionByName(preview).filter(~strip_space(F.col("name")).rlike(_ENV_ID)).distinct()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    mapped = canonical.map_rows(_typed_names(spark, d), "name", table(spark, d, "env_reference"))
    return mapped.select("src", "row_key", "pos", "canon_id")


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    mapped = canonical.map_rows(_typed_names(spark, d), "name", table(spark, d, "env_reference"))
    return mapped.filter(F.col("canon_id") == 0).groupBy("src", "name").agg(F.count(F.lit(1)).alias("n"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(p6_found(spark, d), table(spark, d, "eval_items"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(*mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(spark, d, "documents"))


def queries() -> dict:
    return {
        "p1_found": p1_found,
        "p1_unmatched": p1_unmatched,
        "p6_found": p6_found,
        "p6_report": p6_report,
        "p7_mixture": p7_mixture,
        "p7_report": p7_report,
        "p8_found": p8_found,
    }


def oracle_sql() -> dict[str, str]:
    return {}
