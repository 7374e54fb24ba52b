"""Bounded breadth-first traversal over environment-scoped edges, one set-based step per level.

Ties are settled by the smallest path, compared element by element; since all candidates of a level have paths of the
same length, that is first-in-first-out order with neighbours in order of their ids.

A traversal of few levels over edges counted to be few is one plan: every level is the least walk of its length to each
node, and a node's least (length, walk) is its breadth-first path, since the prefix of a least shortest walk is one. Its
levels share their exchanges. Otherwise each level's new nodes are written to the shared folder, so lineage does not grow
and a lost executor costs no more than its part; nodes seen before are left out, a frontier counted to be small is
broadcast, and the driver only learns how large a level is. Both ways give the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweft.functions.ranks import at_least, least_trusted, weakest
from depweft.runtime import BROADCAST_ROWS, cut, small

MAX_RELEVANT_HOPS = 3
MAX_IMPACT_HOPS = 5
#: Levels and edges up to which a traversal is one plan.
PLAN_HOPS = 6
PLAN_EDGES = 1_000_000


def scoped(edges: DataFrame, env: str | None, min_confidence: str = "low") -> DataFrame:
    """The edges that a traversal may use."""
    out = edges if env is None else edges.filter(F.col("env") == env)
    return out if min_confidence == "very-low" else out.filter(at_least(F.col("confidence"), min_confidence))


def _step(level: DataFrame, pairs: DataFrame) -> DataFrame:
    """The least paths one edge further: ``node, path``."""
    return (
        level.join(pairs, level["node"] == pairs["src"])
        .select(F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"))
        .groupBy("node").agg(F.min("path").alias("path"))
    )


def breadth_first(pairs: DataFrame, seeds: DataFrame, max_hops: int | None, target: str | None = None) -> DataFrame:
    """Every node reached from ``seeds`` (``node``) over ``pairs`` (``src, dst``): ``node, hop, path``.

    ``pairs`` is read at every level, so it should be a stored table. ``path`` starts with the seed. Without ``max_hops``
    it runs until nothing new is found or ``target`` is reached.
    """
    pairs = pairs.select("src", "dst")
    start = seeds.select("node").distinct().select("node", F.array("node").alias("path"))
    if max_hops is not None and max_hops <= PLAN_HOPS and small(pairs, PLAN_EDGES):
        walks = [start]
        for _ in range(max_hops):
            walks.append(_step(walks[-1], pairs))
        every = reduce(DataFrame.unionByName, [w.withColumn("hop", F.lit(h)) for h, w in enumerate(walks)])
        return every.groupBy("node").agg(F.min(F.struct("hop", "path")).alias("w")).select("node", "w.hop", "w.path")
    level = cut(start.withColumn("hop", F.lit(0)))
    levels = [level]
    size, hop = level.count(), 0
    while size and (max_hops is None or hop < max_hops):
        hop += 1
        seen = reduce(DataFrame.unionByName, levels).select("node")
        frontier = F.broadcast(level) if size <= BROADCAST_ROWS else level
        level = cut(_step(frontier, pairs).join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)))
        counts = level.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("node") == F.lit(target)).alias("hit")).first()
        size = counts["n"]
        levels.append(level)
        if counts["hit"]:
            break
    return reduce(DataFrame.unionByName, levels).select("node", "hop", "path")


def _own_refs(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("from_id").alias("node")).agg(F.min("deployed_ref").alias("own_ref"))


def find_relevant(nodes: DataFrame, edges: DataFrame, task: str, env: str, max_hops: int = MAX_RELEVANT_HOPS, min_confidence: str = "low") -> DataFrame:
    """Repositories whose name or id contains the task text, and what they depend on: ``id, repo_id, hop, path, deployed_ref, confidence, provenance``.

    A node's own deployed reference counts before that of the edge that led to it.
    """
    edges = cut(edges.filter(F.col("env") == env))
    usable = scoped(edges, env, min_confidence)
    word = F.lower(F.lit(task))
    seeds = nodes.filter(F.lower("name").contains(word) | F.lower("id").contains(word)).select(F.col("id").alias("node"))
    reached = breadth_first(usable.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")), seeds, max_hops)
    inbound = usable.select(F.col("from_id").alias("via"), F.col("to_id").alias("node"), F.col("deployed_ref").alias("in_ref"))
    out = reached.withColumn("via", F.try_element_at("path", F.lit(-2))).join(inbound, ["via", "node"], "left")
    out = out.join(_own_refs(edges), "node", "left").join(nodes.select(F.col("id").alias("node"), "repo_id"), "node", "left")
    return out.select(
        F.col("node").alias("id"), "repo_id", "hop", F.array_join("path", " > ").alias("path"),
        F.coalesce("own_ref", "in_ref").alias("deployed_ref"), F.lit("high").alias("confidence"), F.lit("declared").alias("provenance"),
    )


def impact(edges: DataFrame, target: str, env: str, min_confidence: str = "low", max_hops: int = MAX_IMPACT_HOPS) -> DataFrame:
    """Everything that depends on ``target``: ``id, hop, path, confidence, provenance, deployed_ref``; paths run from the nearest dependent."""
    usable = cut(scoped(edges, env, min_confidence))
    seeds = edges.sparkSession.createDataFrame([(target,)], "node string")
    reached = breadth_first(usable.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst")), seeds, max_hops)
    rows = reached.filter(F.col("hop") > 0).withColumn("next", F.try_element_at("path", F.lit(-2)))
    edge = usable.select(F.col("from_id").alias("node"), F.col("to_id").alias("next"), "confidence", "provenance", "deployed_ref")
    return rows.join(edge, ["node", "next"]).select(
        F.col("node").alias("id"), "hop", F.array_join(F.slice("path", 2, 1 << 30), " > ").alias("path"), "confidence", "provenance", "deployed_ref"
    )


def shortest_path(edges: DataFrame, from_id: str, to_id: str, env: str | None) -> DataFrame:
    """The edges of a shortest path in order: ``step, from_id, to_id, confidence, provenance, deployed_ref``; from = to has none."""
    usable = cut(edges if env is None else edges.filter(F.col("env") == env))
    seeds = edges.sparkSession.createDataFrame([(from_id,)], "node string")
    reached = breadth_first(usable.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")), seeds, None, target=to_id)
    path = reached.filter((F.col("node") == to_id) & (F.col("hop") > 0))
    hops = path.select("path", F.posexplode(F.slice("path", 2, 1 << 30)).alias("i", "to_id")).select(
        (F.col("i") + 1).alias("step"), F.try_element_at("path", F.col("i") + 1).alias("from_id"), "to_id"
    )
    best = usable.groupBy("from_id", "to_id").agg(F.min(F.struct("confidence", "provenance", "deployed_ref")).alias("e"))
    return hops.join(best, ["from_id", "to_id"]).select("step", "from_id", "to_id", "e.*")


def reachable_build(edges: DataFrame, anchor: str, env: str) -> DataFrame:
    """Edges of all repositories that a build from ``anchor`` visits: only edges with ``expands`` lead on, all count."""
    usable = cut(edges.filter(F.col("env") == env))
    seeds = edges.sparkSession.createDataFrame([(anchor,)], "node string")
    walk = usable.filter(F.col("expands")).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    visited = breadth_first(walk, seeds, None)
    return usable.join(visited.select(F.col("node").alias("from_id"), "hop"), "from_id")


def envelope(rows: DataFrame) -> DataFrame:
    """Number of rows, weakest confidence and least trusted provenance of a result."""
    return rows.agg(F.count(F.lit(1)).alias("n"), weakest(F.col("confidence")).alias("confidence"), least_trusted(F.col("provenance")).alias("provenance"))
