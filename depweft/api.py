"""The engine's five queries with their result envelope, over a store's tables."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweft.functions.ranks import CONFIDENCE
from depweft.operators import edges as E
from depweft.operators import traversal

#: Rows that an envelope carries, and that its deployed_refs come from; the frame form is whole.
SHOWN = 10_000


@dataclass
class QueryResult:
    operation: str
    env: str
    results: list[dict]
    confidence: str = "high"
    provenance: str = "declared"
    deployed_refs: dict[str, str] = field(default_factory=dict)
    unknowns: list[dict] = field(default_factory=list)
    metadata: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, sort_keys=True)


def _checked(min_confidence: str) -> str:
    if min_confidence not in CONFIDENCE:
        raise ValueError(f"min_confidence must be one of {', '.join(CONFIDENCE)}")
    return min_confidence


class QueryEngine:
    """Queries over node and edge frames. Each method gives an envelope of at most ``SHOWN`` rows, or of all if ``whole``; ``*_frame`` is its frame form, whole."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, whole: bool = False) -> None:
        self.nodes, self.edges, self.whole = nodes, edges, whole

    def _envelope(self, operation: str, env: str, rows: DataFrame, node: str, empty: str) -> QueryResult:
        rows = rows.cache()
        try:
            head = rows.orderBy(*[c for c in ("hop", "step", "path", "from_id", "to_id") if c in rows.columns])
            results = [r.asDict(recursive=True) for r in (head if self.whole else head.limit(SHOWN)).collect()]
            if not results:
                return QueryResult(operation, env, [], unknowns=[{"kind": empty, "ref": node, "env": env}])
            total = traversal.envelope(rows).first() if {"confidence", "provenance"} <= set(rows.columns) else None
            refs = {r.get("id") or r.get("to_id"): r["deployed_ref"] for r in results if r.get("deployed_ref")}
            out = QueryResult(operation, env, results, deployed_refs=refs, metadata={"shown": len(results), "rows": total["n"] if total else rows.count()})
            if total:
                out.confidence, out.provenance = total["confidence"], total["provenance"]
            return out
        finally:
            rows.unpersist()

    def _id(self, ref: str) -> str:
        row = self.nodes.filter(F.col("repo_id") == ref).agg(F.min("id").alias("i")).first()
        return row["i"] or ref

    def find_relevant_repos_frame(self, task: str, env: str, max_hops: int = traversal.MAX_RELEVANT_HOPS, min_confidence: str = "low") -> DataFrame:
        return traversal.find_relevant(self.nodes, self.edges, task, env, max_hops, _checked(min_confidence))

    def find_relevant_repos(self, task: str, env: str, max_hops: int = traversal.MAX_RELEVANT_HOPS, min_confidence: str = "low") -> QueryResult:
        rows = self.find_relevant_repos_frame(task, env, max_hops, min_confidence)
        return self._envelope("find_relevant_repos", env, rows, task, "no-match")

    def impact_analysis_frame(self, repo: str, env: str, min_confidence: str = "low") -> DataFrame:
        return traversal.impact(self.edges, self._id(repo), env, _checked(min_confidence))

    def impact_analysis(self, repo: str, env: str, min_confidence: str = "low") -> QueryResult:
        return self._envelope("impact_analysis", env, self.impact_analysis_frame(repo, env, min_confidence), repo, "no-match")

    def dependency_path_frame(self, from_repo: str, to_repo: str, env: str) -> DataFrame:
        return traversal.shortest_path(self.edges, self._id(from_repo), self._id(to_repo), env)

    def dependency_path(self, from_repo: str, to_repo: str, env: str) -> QueryResult:
        return self._envelope("dependency_path", env, self.dependency_path_frame(from_repo, to_repo, env), f"{from_repo}->{to_repo}", "no-source")

    def env_diff_frame(self, repo: str, env_a: str, env_b: str) -> DataFrame:
        return E.environment_diff(self.edges, self._id(repo), env_a, env_b)

    def env_diff(self, repo: str, env_a: str, env_b: str) -> QueryResult:
        return self._envelope("env_diff", f"{env_a}:{env_b}", self.env_diff_frame(repo, env_a, env_b), repo, "no-difference")

    def explain_edge_frame(self, from_repo: str, to_repo: str, env: str, traces: DataFrame | None = None) -> DataFrame:
        edges = self.edges if "evidence" in self.edges.columns else self.edges.withColumn("evidence", F.lit(None).cast("string")).withColumn("llm_trace", F.lit(None).cast("string"))
        return E.explain(edges, self._id(from_repo), self._id(to_repo), env, traces)

    def explain_edge(self, from_repo: str, to_repo: str, env: str, traces: DataFrame | None = None) -> QueryResult:
        return self._envelope("explain_edge", env, self.explain_edge_frame(from_repo, to_repo, env, traces), f"{from_repo}->{to_repo}", "no-source")
