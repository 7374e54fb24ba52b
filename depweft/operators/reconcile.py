"""Declared edges compared with observed traffic: confirmed, static-only and runtime-only sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweft.functions.ranks import confidence_label, confidence_rank
from depweft.functions.tokens import redact_evidence
from depweft.runtime import placed

KEY = ["from_id", "to_id"]


def capability_confidence(edges: DataFrame) -> DataFrame:
    """Adds ``confidence``: high for apm and rum or from two samples on, else medium."""
    strong = F.col("capability").isin("apm", "rum") | (F.col("sample_count") > 1)
    return edges.withColumn("confidence", F.when(strong, "high").otherwise("medium"))


def deduplicated(observed: DataFrame) -> DataFrame:
    """One observed edge per (from_id, to_id, env): evidence in order (kept with repeats), strongest confidence, first reference.

    ``observed`` has ``evidence`` (array of source_type, locator), ``deployed_ref`` and ``ord``. Evidence is aggregated
    per locator before it is gathered, so a pair seen in most rows gathers distinct locators with their counts.
    """
    flat = observed.withColumn("e", F.explode_outer("evidence"))
    per_locator = flat.groupBy(*KEY, "env", "e").agg(
        F.count(F.lit(1)).alias("n"), F.max(confidence_rank(F.col("confidence"))).alias("c"),
        F.min(F.when(F.col("deployed_ref").isNotNull(), F.struct("ord", "deployed_ref"))).alias("r"),
    )
    return per_locator.groupBy(*KEY, "env").agg(
        F.array_sort(F.collect_list(F.when(F.col("e").isNotNull(), F.struct("e.source_type", "e.locator", "n")))).alias("evidence"),
        confidence_label(F.max("c")).alias("confidence"),
        F.min("r").getField("deployed_ref").alias("deployed_ref"),
    )


def three_way(static: DataFrame, runtime: DataFrame, redact: bool = True) -> DataFrame:
    """``from_id, to_id, status``: one full outer join of the two sets of pairs; edges observed before are no static ones."""
    s = static.filter(F.col("provenance") != "observed") if "provenance" in static.columns else static
    s = s.select(*KEY).distinct().withColumn("__s", F.lit(True))
    columns = [c for c in ("evidence", "confidence") if c in runtime.columns]
    # One row of a pair as a whole: the earliest if there is an order, else the least, never an arbitrary one.
    order = [c for c in ("ord",) if c in runtime.columns]
    picked = [F.min(F.struct(*order, *columns)).alias("__one")] if columns else []
    r = runtime.groupBy(*KEY).agg(F.lit(True).alias("__r"), *picked).select(*KEY, "__r", *[F.col(f"__one.{c}").alias(c) for c in columns])
    out = s.join(r, KEY, "full_outer")
    if redact and "evidence" in columns and dict(runtime.dtypes)["evidence"] == "array<string>":
        out = out.withColumn("evidence", redact_evidence(F.col("evidence")))
    status = F.when(F.col("__s") & F.col("__r"), "confirmed").when(F.col("__s"), "static-only").otherwise("runtime-only")
    return out.withColumn("status", status).drop("__s", "__r")


def in_order(report: DataFrame) -> DataFrame:
    """The report with ``place``: its rows by status, then by both ends."""
    return placed(report, ["status", *KEY])


def unknown_services(resolved: DataFrame, env: str) -> DataFrame:
    """Services that no repository answers for, once each."""
    return resolved.filter(F.col("reason").isNotNull()).select("service", F.lit(env).alias("env"), "reason").distinct()


def counts(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
