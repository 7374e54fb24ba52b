"""The graph build: references of all repositories resolved and projected at once, then cut to what the anchor reaches.

An edge depends on its own repository's files, stores and deployments and on the global index alone, so all edges can be
computed in one set-based pass; the walk from the anchor only decides which of them belong to the build.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweft.functions.ranks import pairwise_weakest
from depweft.operators.identity import project
from depweft.operators.traversal import reachable_build


def candidate_edges(refs: DataFrame, index: DataFrame, deployed: DataFrame) -> DataFrame:
    """Edges of resolved references: ``from_id, to_id, env, provenance, confidence, deployed_ref, ambiguous, expands``.

    ``refs``: ref_id, repo, env, value, injected, confidence. References through placeholders are 'injected' and lead the
    build on; literal ones are 'declared', are looked up without the host alone, and do not lead on.
    """
    through = refs.filter("injected")
    literal = refs.filter("not injected")
    columns = ["ref_id", "value", "env"]
    hits = project(through.select(*columns), index).unionByName(project(literal.select(*columns), index, host_fallback=False))
    many = hits.groupBy("ref_id").agg((F.countDistinct("repo") > 1).alias("ambiguous"))
    joined = refs.join(hits.select("ref_id", F.col("repo").alias("to_id"), F.col("confidence").alias("id_confidence")), "ref_id").join(many, "ref_id")
    joined = joined.join(deployed.select(F.col("repo").alias("__r"), F.col("env").alias("__e"), "sha"), (F.col("repo") == F.col("__r")) & (F.col("env") == F.col("__e")), "left")
    return joined.select(
        F.col("repo").alias("from_id"), "to_id", "env", F.when(F.col("injected"), "injected").otherwise("declared").alias("provenance"),
        pairwise_weakest(F.coalesce("confidence", F.lit("high")), F.col("id_confidence")).alias("confidence"),
        F.col("sha").alias("deployed_ref"), (F.col("ambiguous") & F.col("injected")).alias("ambiguous"), F.col("injected").alias("expands"), "ref_id",
    )


def built_graph(edges: DataFrame, anchor: str, env: str) -> DataFrame:
    """Edges of the build that starts at ``anchor``, one per pair, the strongest reading first."""
    reached = reachable_build(edges, anchor, env)
    pick = F.min(F.struct("hop", "ref_id", "provenance", "confidence", "deployed_ref", "ambiguous")).alias("m")
    return reached.groupBy("from_id", "to_id", "env").agg(pick).select("from_id", "to_id", "env", "m.provenance", "m.confidence", "m.deployed_ref", "m.ambiguous", "m.hop")
