"""Look-ups, differences and set operations on edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweft.functions.ranks import at_least
from depweft.functions.tokens import evidence_list
from depweft.runtime import broadcast_if_small, placed

KEY = ["from_id", "to_id"]


def outbound(edges: DataFrame, frontier: DataFrame, env: str) -> DataFrame:
    """Edges that leave the nodes of ``frontier`` (``node``)."""
    return edges.filter(F.col("env") == env).join(broadcast_if_small(frontier.select(F.col("node").alias("from_id"))), "from_id", "left_semi")


def inbound(edges: DataFrame, frontier: DataFrame, env: str) -> DataFrame:
    return edges.filter(F.col("env") == env).join(broadcast_if_small(frontier.select(F.col("node").alias("to_id"))), "to_id", "left_semi")


def neighbours(edges: DataFrame, node: str, env: str | None = None, min_confidence: str = "low") -> DataFrame:
    """Both directions; the confidence bound is applied."""
    rows = edges.filter((F.col("from_id") == node) | (F.col("to_id") == node)).filter(at_least(F.col("confidence"), min_confidence))
    rows = rows if env is None else rows.filter(F.col("env") == env)
    out = F.col("from_id") == node
    return rows.select(F.when(out, F.col("to_id")).otherwise(F.col("from_id")).alias("node"), F.when(out, "out").otherwise("in").alias("direction"), "env", "confidence")


def edge_at(edges: DataFrame, from_id: str, to_id: str, env: str) -> DataFrame:
    return edges.filter((F.col("from_id") == from_id) & (F.col("to_id") == to_id) & (F.col("env") == env))


def node_ids(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """``ref`` resolved to a node id: the smallest id of that repository, else the reference itself."""
    by_repo = nodes.groupBy("repo_id").agg(F.min("id").alias("__id"))
    return wanted.join(by_repo, wanted["ref"] == by_repo["repo_id"], "left").select("ref", F.coalesce("__id", "ref").alias("id"))


def repo_ids(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """The inverse: a node id's repository, else the id."""
    return wanted.join(nodes.select("id", "repo_id"), wanted["ref"] == F.col("id"), "left").select("ref", F.coalesce("repo_id", "ref").alias("repo_id"))


def environment_diff(edges: DataFrame, node: str | None, env_a: str, env_b: str) -> DataFrame:
    """What differs between two environments: ``from_id, to_id, change, confidence_a, confidence_b``; one outer join.

    Only confidence decides 'changed'; for one node only its outbound edges are compared.
    """
    pick = edges if node is None else edges.filter(F.col("from_id") == node)
    a = pick.filter(F.col("env") == env_a).select(*KEY, F.col("confidence").alias("confidence_a"))
    b = pick.filter(F.col("env") == env_b).select(*KEY, F.col("confidence").alias("confidence_b"))
    both = a.join(b, KEY, "full_outer")
    change = F.when(F.col("confidence_b").isNull(), "removed").when(F.col("confidence_a").isNull(), "added").when(F.col("confidence_a") != F.col("confidence_b"), "changed")
    return both.withColumn("change", change).filter(F.col("change").isNotNull()).select(*KEY, "change", "confidence_a", "confidence_b")


def diff_in_order(diff: DataFrame) -> DataFrame:
    """A difference with ``place``: its rows by kind of change, then by both ends."""
    return placed(diff, ["change", *KEY])


def union_of(edges: DataFrame, env_a: str, env_b: str) -> DataFrame:
    return edges.filter(F.col("env").isin(env_a, env_b)).select(*KEY).distinct()


def intersection_of(edges: DataFrame, env_a: str, env_b: str) -> DataFrame:
    part = lambda e: edges.filter(F.col("env") == e).select(*KEY)
    return part(env_a).intersect(part(env_b))


def difference_of(edges: DataFrame, env_a: str, env_b: str) -> DataFrame:
    part = lambda e: edges.filter(F.col("env") == e).select(*KEY)
    return part(env_a).join(part(env_b), KEY, "left_anti").distinct()


def explain(edges: DataFrame, from_id: str, to_id: str, env: str, traces: DataFrame | None = None) -> DataFrame:
    """One edge with its evidence as rows, and its reasoning trace if traces are given."""
    row = edge_at(edges, from_id, to_id, env)
    row = row.withColumn("locator", F.explode_outer(evidence_list(F.col("evidence"))))
    if traces is not None:
        row = row.join(traces.select("trace_id", "reasoning"), row["llm_trace"] == F.col("trace_id"), "left").drop("trace_id")
    return row


def latest_deployed(deployed: DataFrame) -> DataFrame:
    """Each node's latest reference by deploy time: ``node, sha``; ties: the larger reference."""
    return deployed.groupBy("node").agg(F.max(F.struct("at", "sha")).alias("m")).select("node", F.col("m.sha").alias("sha"))


def summary(edges: DataFrame) -> DataFrame:
    return edges.groupBy("env", "confidence", "provenance").agg(F.count(F.lit(1)).alias("n"))
