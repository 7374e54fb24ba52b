"""Queries on the property graph read from the order tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweft.functions.ranks import least_trusted, pairwise_weakest, weakest
from depweft.operators import edges as E
from depweft.operators import projection, reconcile, traversal
from depweft.runtime import cut
from depweft.sinks.store import inserted, upserted

RANK_SQL = "CASE {c} WHEN 'very-low' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'very-high' THEN 4 ELSE 1 END"
PROV_SQL = "CASE {c} WHEN 'llm-judged' THEN 0 WHEN 'observed' THEN 1 WHEN 'injected' THEN 2 WHEN 'declared' THEN 3 ELSE 0 END"
_LABEL = "CASE {c} WHEN 0 THEN 'very-low' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'very-high' END"
_PLABEL = "CASE {c} WHEN 0 THEN 'llm-judged' WHEN 1 THEN 'observed' WHEN 2 THEN 'injected' ELSE 'declared' END"

DEPLOYABLE = """deployable AS (
  SELECT 's' || s_suppkey AS id, lower(r_name) || ':' || lower(n_name) || '/' || s_name AS repo_id, s_name AS name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
OBSERVATION = """observation AS (
  SELECT a.l_suppkey AS src_key, b.l_suppkey AS dst_key, o_orderkey, a.l_linenumber AS ln, a.l_returnflag AS flag,
    CASE o_orderstatus WHEN 'F' THEN 'prod' WHEN 'O' THEN 'staging' ELSE 'dev' END AS env,
    CASE a.l_returnflag WHEN 'A' THEN 'high' WHEN 'N' THEN 'medium' ELSE 'low' END AS confidence,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'declared' WHEN '2' THEN 'declared' WHEN '3' THEN 'injected'
      WHEN '4' THEN 'observed' ELSE 'llm-judged' END AS provenance,
    'o' || o_orderkey AS deployed_ref
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  JOIN orders ON a.l_orderkey = o_orderkey
  WHERE a.l_suppkey <> b.l_suppkey AND a.l_quantity >= 48 AND b.l_quantity >= 40)"""


def _winner_sql(source: str, name: str) -> str:
    order = f"o_orderkey, ln, {RANK_SQL.format(c='confidence')}, {PROV_SQL.format(c='provenance')}"
    return f"""{name} AS (SELECT from_id, to_id, env, confidence, provenance, deployed_ref FROM (
  SELECT *, row_number() OVER (PARTITION BY from_id, to_id, env ORDER BY {order}) AS rn FROM {source}) WHERE rn = 1)"""


EDGE = f"""{OBSERVATION},
sup_obs AS (SELECT *, 's' || src_key AS from_id, 's' || dst_key AS to_id FROM observation),
{_winner_sql("sup_obs", "edge")}"""
NATION_EDGE = f"""{OBSERVATION},
nat_obs AS (SELECT o.*, 'n' || a.s_nationkey AS from_id, 'n' || b.s_nationkey AS to_id FROM observation o
  JOIN supplier a ON a.s_suppkey = src_key JOIN supplier b ON b.s_suppkey = dst_key WHERE a.s_nationkey <> b.s_nationkey),
{_winner_sql("nat_obs", "nedge")}"""

NODE, OTHER, FAR = "n9", "n2", "n17"
TASK = "0001"


def _impact_seed(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("env") == "prod").groupBy("to_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "to_id").limit(1)


def impact(spark: SparkSession, d: str) -> DataFrame:
    """Everything that depends, over at most five hops, on the service with most dependents in prod."""
    edges = cut(projection.edges(spark, d))
    top = _impact_seed(edges).collect()
    return traversal.impact(edges, top[0]["to_id"] if top else "", "prod")


def relevant(spark: SparkSession, d: str) -> DataFrame:
    return traversal.find_relevant(projection.deployables(spark, d), projection.edges(spark, d), TASK, "prod")


def relevant_medium(spark: SparkSession, d: str) -> DataFrame:
    return traversal.find_relevant(projection.deployables(spark, d), projection.edges(spark, d), TASK, "prod", min_confidence="medium")


def path(spark: SparkSession, d: str) -> DataFrame:
    return traversal.shortest_path(projection.nation_edges(spark, d), NODE, FAR, "prod")


def path_any_env(spark: SparkSession, d: str) -> DataFrame:
    hops = traversal.shortest_path(projection.nation_edges(spark, d), OTHER, FAR, None)
    return hops.select("step", "from_id", "to_id")


def nation_reach(spark: SparkSession, d: str) -> DataFrame:
    edges = cut(projection.nation_edges(spark, d).filter(F.col("env") == "prod"))
    seeds = spark.createDataFrame([(NODE,)], "node string")
    reached = traversal.breadth_first(edges.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")), seeds, 3)
    return reached.select(F.col("node").alias("id"), "hop", F.array_join("path", " > ").alias("path"))


def build_reach(spark: SparkSession, d: str) -> DataFrame:
    """Edges of a build from one anchor: only injected ones lead on."""
    edges = projection.nation_edges(spark, d).withColumn("expands", F.col("provenance") == "injected")
    return traversal.reachable_build(edges, NODE, "prod").select("from_id", "to_id", "hop", "provenance")


def outbound(spark: SparkSession, d: str) -> DataFrame:
    frontier = spark.createDataFrame([(NODE,), (OTHER,)], "node string")
    return E.outbound(projection.nation_edges(spark, d), frontier, "prod").select("from_id", "to_id", "env", "confidence")


def inbound(spark: SparkSession, d: str) -> DataFrame:
    frontier = spark.createDataFrame([(NODE,), (OTHER,)], "node string")
    return E.inbound(projection.nation_edges(spark, d), frontier, "prod").select("from_id", "to_id", "env", "confidence")


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    return E.neighbours(projection.nation_edges(spark, d), NODE, "staging", "medium")


def env_diff(spark: SparkSession, d: str) -> DataFrame:
    return E.environment_diff(projection.nation_edges(spark, d), NODE, "prod", "staging")


def env_diff_all(spark: SparkSession, d: str) -> DataFrame:
    return E.environment_diff(projection.nation_edges(spark, d), None, "prod", "staging")


def edges_union(spark: SparkSession, d: str) -> DataFrame:
    return E.union_of(projection.edges(spark, d), "prod", "staging")


def edges_intersect(spark: SparkSession, d: str) -> DataFrame:
    return E.intersection_of(projection.nation_edges(spark, d), "prod", "staging")


def edges_except(spark: SparkSession, d: str) -> DataFrame:
    return E.difference_of(projection.nation_edges(spark, d), "prod", "dev")


def edge_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.summary(projection.edges(spark, d))


def edge_sorted(spark: SparkSession, d: str) -> DataFrame:
    return projection.edges(spark, d).orderBy("from_id", "to_id", "env")


def edge_explain(spark: SparkSession, d: str) -> DataFrame:
    """One edge with the locators of all observations behind it."""
    obs = projection.supplier_observations(spark, d)
    first = obs.select("from_id", "to_id", "env").orderBy("from_id", "to_id", "env").limit(1)
    key = ["from_id", "to_id", "env"]
    some = obs.join(F.broadcast(first), key)
    evidence = some.groupBy(*key).agg(F.to_json(F.array_sort(F.collect_set(F.concat(F.lit("order:"), "deployed_ref")))).alias("evidence"))
    row = projection.winners(some).join(evidence, key).withColumn("llm_trace", F.lit(None).cast("string"))
    top = row.collect()
    if not top:
        return row.select(*key, "confidence", F.lit(None).cast("string").alias("locator"))
    return E.explain(row, top[0]["from_id"], top[0]["to_id"], top[0]["env"]).select(*key, "confidence", "locator")


def resolve_ids(spark: SparkSession, d: str) -> DataFrame:
    nodes = projection.deployables(spark, d)
    wanted = nodes.select(F.col("repo_id").alias("ref")).unionByName(nodes.select(F.concat(F.lit("x"), "id").alias("ref")))
    return E.node_ids(wanted, nodes)


def resolve_repos(spark: SparkSession, d: str) -> DataFrame:
    nodes = projection.deployables(spark, d)
    return E.repo_ids(projection.edges(spark, d).select(F.col("to_id").alias("ref")).distinct(), nodes)


def weakest_links(spark: SparkSession, d: str) -> DataFrame:
    return projection.edges(spark, d).groupBy("from_id").agg(weakest(F.col("confidence")).alias("confidence"), least_trusted(F.col("provenance")).alias("provenance"))


def pairwise_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Confidence of two-hop chains: the weaker of both edges, by pairs of labels."""
    e = projection.edges(spark, d).filter(F.col("env") == "prod")
    a = e.select("from_id", F.col("to_id").alias("via"), F.col("confidence").alias("c1"))
    b = e.select(F.col("from_id").alias("via"), "to_id", F.col("confidence").alias("c2"))
    both = a.join(b, "via").withColumn("confidence", pairwise_weakest(F.col("c1"), F.col("c2")))
    return both.groupBy("c1", "c2", "confidence").agg(F.count(F.lit(1)).alias("n"))


def result_envelope(spark: SparkSession, d: str) -> DataFrame:
    return traversal.envelope(impact(spark, d))


def confident_edges(spark: SparkSession, d: str) -> DataFrame:
    return traversal.scoped(projection.edges(spark, d), "prod", "medium")


def three_way(spark: SparkSession, d: str) -> DataFrame:
    obs = projection.supplier_observations(spark, d).filter(F.col("env") == "prod")
    static = obs.filter(F.col("flag").isin("A", "N")).select("from_id", "to_id")
    runtime = obs.filter(F.col("flag").isin("N", "R")).select("from_id", "to_id")
    return reconcile.three_way(static, runtime)


def three_way_in_order(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.in_order(three_way(spark, d))


def env_diff_in_order(spark: SparkSession, d: str) -> DataFrame:
    return E.diff_in_order(env_diff_all(spark, d))


def three_way_counts(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.counts(three_way(spark, d))


def observed_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Observed edges once per pair and environment, strongest confidence, first reference, evidence in order."""
    obs = projection.supplier_observations(spark, d).select(
        "from_id", "to_id", "env", "confidence", "deployed_ref", F.struct("o_orderkey", "ln").alias("ord"),
        F.array(F.struct(F.lit("order").alias("source_type"), F.col("deployed_ref").alias("locator"))).alias("evidence"),
    )
    out = reconcile.deduplicated(obs)
    return out.select("from_id", "to_id", "env", "confidence", "deployed_ref", F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["source_type"], e["locator"], e["n"].cast("string"))), ",").alias("evidence"))


def capability_confidence(spark: SparkSession, d: str) -> DataFrame:
    obs = projection.supplier_observations(spark, d)
    edges = obs.groupBy("from_id", "to_id", "env", F.when(F.col("flag") == "A", "apm").otherwise("logs").alias("capability")).agg(F.count(F.lit(1)).alias("sample_count"))
    return reconcile.capability_confidence(edges)


def latest_deployed(spark: SparkSession, d: str) -> DataFrame:
    obs = projection.supplier_observations(spark, d)
    return E.latest_deployed(obs.select(F.col("from_id").alias("node"), F.col("o_orderkey").alias("at"), F.col("deployed_ref").alias("sha")))


def node_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Services merged with a partial update of their names."""
    nodes = projection.deployables(spark, d).select("id", "repo_id", "name")
    update = nodes.filter(F.col("id").endswith("7")).select("id", F.upper("name").alias("name"))
    extra = nodes.filter(F.col("id").endswith("3")).select(F.concat(F.lit("new-"), "id").alias("id"), F.lit("fresh").alias("name"))
    return upserted(nodes, update.unionByName(extra), ["id"])


def edge_insert(spark: SparkSession, d: str) -> DataFrame:
    """Staging edges added to the prod ones: the key includes the environment; edges without both nodes are left out."""
    columns = ["from_id", "to_id", "env", "confidence"]
    edges = projection.edges(spark, d).select(*columns)
    nodes = projection.deployables(spark, d).filter(~F.col("id").endswith("5"))
    return inserted(edges.filter(F.col("env") == "prod"), edges.filter(F.col("env") == "staging"), nodes)


def queries() -> dict:
    return {
        "g1_relevant": relevant, "g1_relevant_medium": relevant_medium, "g2_impact": impact, "g3_path": path,
        "g4_path_any_env": path_any_env, "g5_build_reach": build_reach, "g_reach": nation_reach, "g_envelope": result_envelope,
        "j9_outbound": outbound, "j10_inbound": inbound, "j11_neighbours": neighbours, "j13_resolve_ids": resolve_ids,
        "j13_resolve_repos": resolve_repos, "j14_three_way": three_way, "t2_report_in_order": three_way_in_order, "t3_diff_in_order": env_diff_in_order, "j15_env_diff": env_diff, "j15_env_diff_all": env_diff_all,
        "j21_latest_deployed": latest_deployed, "a1_weakest_links": weakest_links, "a3_pairwise": pairwise_confidence,
        "a5_observed_dedupe": observed_dedupe, "a10_edge_summary": edge_summary, "a10_three_way_counts": three_way_counts,
        "a15_capability_confidence": capability_confidence, "pred2_confident_edges": confident_edges, "t1_edges_sorted": edge_sorted,
        "set_union": edges_union, "set_intersect": edges_intersect, "set_except": edges_except, "g9_explain": edge_explain,
        "k2_node_upsert": node_upsert, "k3_edge_insert": edge_insert,
    }


def _bfs_sql(pairs: str, seeds: str, hops: int) -> str:
    """Reach by levels with the smallest path among the shortest."""
    return f"""pairs AS ({pairs}), seeds AS ({seeds}),
walk AS (SELECT node, 0 AS hop, [node] AS path FROM seeds
  UNION SELECT p.dst, w.hop + 1, list_append(w.path, p.dst) FROM walk w JOIN pairs p ON p.src = w.node
  WHERE w.hop < {hops} AND NOT list_contains(w.path, p.dst)),
reached AS (SELECT node, hop, min(path) AS path FROM walk w
  WHERE hop = (SELECT min(hop) FROM walk v WHERE v.node = w.node) GROUP BY node, hop)"""


def _relevant_sql(bound: str) -> str:
    usable = f"usable AS (SELECT * FROM edge WHERE env = 'prod'{bound})"
    bfs = _bfs_sql("SELECT DISTINCT from_id AS src, to_id AS dst FROM usable", f"SELECT id AS node FROM deployable WHERE contains(lower(name), '{TASK}') OR contains(lower(id), '{TASK}')", 3)
    return f"""WITH RECURSIVE {DEPLOYABLE}, {EDGE}, {usable}, {bfs},
own AS (SELECT from_id, min(deployed_ref) AS r FROM edge WHERE env = 'prod' GROUP BY from_id)
SELECT r.node AS id, d.repo_id, r.hop, array_to_string(r.path, ' > ') AS path, coalesce(own.r, u.deployed_ref) AS deployed_ref,
  'high' AS confidence, 'declared' AS provenance
FROM reached r LEFT JOIN deployable d ON d.id = r.node LEFT JOIN own ON own.from_id = r.node
LEFT JOIN usable u ON u.to_id = r.node AND u.from_id = r.path[-2]"""


_IMPACT = f"""{EDGE}, usable AS (SELECT * FROM edge WHERE env = 'prod'),
{_bfs_sql("SELECT DISTINCT to_id AS src, from_id AS dst FROM usable", "SELECT node FROM (SELECT to_id AS node, count(*) AS n FROM usable GROUP BY to_id ORDER BY n DESC, node LIMIT 1)", 5)},
impact AS (SELECT r.node AS id, r.hop, array_to_string(r.path[2:], ' > ') AS path, u.confidence, u.provenance, u.deployed_ref
  FROM reached r JOIN usable u ON u.from_id = r.node AND u.to_id = r.path[-2] WHERE r.hop > 0)"""


def _path_sql(source: str, target: str, where: str, columns: str) -> str:
    """Levels are sets (union drops repeats), so the dense graph is walked, not its paths; parents are the smallest paths."""
    return f"""WITH RECURSIVE {NATION_EDGE}, pairs AS (SELECT DISTINCT from_id AS src, to_id AS dst FROM nedge {where}),
l1 AS (SELECT dst AS node, min(['{source}', dst]) AS path FROM pairs WHERE src = '{source}' AND dst <> '{source}' GROUP BY dst),
l2 AS (SELECT p.dst AS node, min(list_append(l.path, p.dst)) AS path FROM l1 l JOIN pairs p ON p.src = l.node
  WHERE p.dst <> '{source}' AND p.dst NOT IN (SELECT node FROM l1) GROUP BY p.dst),
l3 AS (SELECT p.dst AS node, min(list_append(l.path, p.dst)) AS path FROM l2 l JOIN pairs p ON p.src = l.node
  WHERE p.dst <> '{source}' AND p.dst NOT IN (SELECT node FROM l1 UNION SELECT node FROM l2) GROUP BY p.dst),
l4 AS (SELECT p.dst AS node, min(list_append(l.path, p.dst)) AS path FROM l3 l JOIN pairs p ON p.src = l.node
  WHERE p.dst <> '{source}' AND p.dst NOT IN (SELECT node FROM l1 UNION SELECT node FROM l2 UNION SELECT node FROM l3) GROUP BY p.dst),
found AS (SELECT path FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3 UNION ALL SELECT * FROM l4) WHERE node = '{target}'),
steps AS (SELECT unnest(range(1, len(path))) AS step, path FROM found)
SELECT CAST(step AS INT) AS step, path[step] AS from_id, path[step + 1] AS to_id{columns}"""


_SETS = "SELECT DISTINCT from_id, to_id FROM {t} WHERE env = '{e}'"


_THREE_WAY = f"""WITH {OBSERVATION}, s AS (SELECT DISTINCT 's' || src_key AS f, 's' || dst_key AS t FROM observation WHERE env = 'prod' AND flag IN ('A', 'N')),
          r AS (SELECT DISTINCT 's' || src_key AS f, 's' || dst_key AS t FROM observation WHERE env = 'prod' AND flag IN ('N', 'R'))
          SELECT coalesce(s.f, r.f) AS from_id, coalesce(s.t, r.t) AS to_id,
            CASE WHEN r.f IS NULL THEN 'static-only' WHEN s.f IS NULL THEN 'runtime-only' ELSE 'confirmed' END AS status
          FROM s FULL OUTER JOIN r ON s.f = r.f AND s.t = r.t"""


def oracle_sql() -> dict[str, str]:
    conf = RANK_SQL.format(c="confidence")
    return {
        "g1_relevant": _relevant_sql(""),
        "g1_relevant_medium": _relevant_sql(f" AND {conf} >= 2"),
        "g2_impact": f"WITH RECURSIVE {_IMPACT} SELECT * FROM impact",
        "g_envelope": f"""WITH RECURSIVE {_IMPACT} SELECT count(*) AS n, coalesce({_LABEL.format(c=f"min({conf})")}, 'high') AS confidence,
          coalesce({_PLABEL.format(c=f"min({PROV_SQL.format(c='provenance')})")}, 'declared') AS provenance FROM impact""",
        "g3_path": _path_sql(NODE, FAR, "WHERE env = 'prod'", ", e.confidence, e.provenance, e.deployed_ref")
        + " FROM steps JOIN nedge e ON e.env = 'prod' AND e.from_id = path[step] AND e.to_id = path[step + 1]",
        "g4_path_any_env": _path_sql(OTHER, FAR, "", "") + " FROM steps",
        "g_reach": f"""WITH RECURSIVE {NATION_EDGE}, {_bfs_sql("SELECT DISTINCT from_id AS src, to_id AS dst FROM nedge WHERE env = 'prod'", f"SELECT '{NODE}' AS node", 3)}
          SELECT node AS id, hop, array_to_string(path, ' > ') AS path FROM reached""",
        "g5_build_reach": f"""WITH RECURSIVE {NATION_EDGE}, walk AS (SELECT '{NODE}' AS node, 0 AS hop
          UNION SELECT e.to_id, w.hop + 1 FROM walk w JOIN nedge e ON e.from_id = w.node AND e.env = 'prod' AND e.provenance = 'injected' WHERE w.hop < 30),
          first AS (SELECT node, min(hop) AS hop FROM walk GROUP BY node)
          SELECT e.from_id, e.to_id, f.hop, e.provenance FROM nedge e JOIN first f ON f.node = e.from_id WHERE e.env = 'prod'""",
        "j9_outbound": f"WITH {NATION_EDGE} SELECT from_id, to_id, env, confidence FROM nedge WHERE env = 'prod' AND from_id IN ('{NODE}', '{OTHER}')",
        "j10_inbound": f"WITH {NATION_EDGE} SELECT from_id, to_id, env, confidence FROM nedge WHERE env = 'prod' AND to_id IN ('{NODE}', '{OTHER}')",
        "j11_neighbours": f"""WITH {NATION_EDGE} SELECT CASE WHEN from_id = '{NODE}' THEN to_id ELSE from_id END AS node,
          CASE WHEN from_id = '{NODE}' THEN 'out' ELSE 'in' END AS direction, env, confidence FROM nedge
          WHERE env = 'staging' AND '{NODE}' IN (from_id, to_id) AND {conf} >= 2""",
        "j13_resolve_ids": f"""WITH {DEPLOYABLE}, ids AS (SELECT repo_id, min(id) AS id FROM deployable GROUP BY repo_id),
          wanted AS (SELECT repo_id AS ref FROM deployable UNION ALL SELECT 'x' || id FROM deployable)
          SELECT ref, coalesce(ids.id, ref) AS id FROM wanted LEFT JOIN ids ON ref = repo_id""",
        "j13_resolve_repos": f"""WITH {DEPLOYABLE}, {EDGE}, wanted AS (SELECT DISTINCT to_id AS ref FROM edge)
          SELECT ref, coalesce(repo_id, ref) AS repo_id FROM wanted LEFT JOIN deployable ON id = ref""",
        "j14_three_way": _THREE_WAY,
        "t2_report_in_order": f"SELECT *, row_number() OVER (ORDER BY status, from_id, to_id) AS place FROM ({_THREE_WAY})",
        "t3_diff_in_order": f"SELECT *, row_number() OVER (ORDER BY change, from_id, to_id) AS place FROM ({_diff_sql('')})",
        "a10_three_way_counts": f"""WITH {OBSERVATION}, s AS (SELECT DISTINCT src_key AS f, dst_key AS t FROM observation WHERE env = 'prod' AND flag IN ('A', 'N')),
          r AS (SELECT DISTINCT src_key AS f, dst_key AS t FROM observation WHERE env = 'prod' AND flag IN ('N', 'R'))
          SELECT CASE WHEN r.f IS NULL THEN 'static-only' WHEN s.f IS NULL THEN 'runtime-only' ELSE 'confirmed' END AS status, count(*) AS n
          FROM s FULL OUTER JOIN r ON s.f = r.f AND s.t = r.t GROUP BY 1""",
        "j15_env_diff": _diff_sql(f"AND from_id = '{NODE}'"),
        "j15_env_diff_all": _diff_sql(""),
        "j21_latest_deployed": f"""WITH {OBSERVATION} SELECT 's' || src_key AS node, max_by(deployed_ref, o_orderkey) AS sha FROM observation GROUP BY src_key""",
        "a1_weakest_links": f"""WITH {EDGE} SELECT from_id, {_LABEL.format(c=f"min({conf})")} AS confidence,
          {_PLABEL.format(c=f"min({PROV_SQL.format(c='provenance')})")} AS provenance FROM edge GROUP BY from_id""",
        "a3_pairwise": f"""WITH {EDGE}, e AS (SELECT * FROM edge WHERE env = 'prod')
          SELECT a.confidence AS c1, b.confidence AS c2, {_LABEL.format(c=f"least({RANK_SQL.format(c='a.confidence')}, {RANK_SQL.format(c='b.confidence')})")} AS confidence, count(*) AS n
          FROM e a JOIN e b ON a.to_id = b.from_id GROUP BY 1, 2, 3""",
        "a5_observed_dedupe": f"""WITH {OBSERVATION}, l AS (SELECT 's' || src_key AS from_id, 's' || dst_key AS to_id, env, deployed_ref, count(*) AS n,
            max({conf}) AS c, min((o_orderkey, ln)) AS o FROM observation GROUP BY ALL)
          SELECT from_id, to_id, env, {_LABEL.format(c="max(c)")} AS confidence, min_by(deployed_ref, o) AS deployed_ref,
            string_agg('order:' || deployed_ref || ':' || n, ',' ORDER BY deployed_ref) AS evidence FROM l GROUP BY from_id, to_id, env""",
        "a10_edge_summary": f"WITH {EDGE} SELECT env, confidence, provenance, count(*) AS n FROM edge GROUP BY ALL",
        "a15_capability_confidence": f"""WITH {OBSERVATION}, c AS (SELECT 's' || src_key AS from_id, 's' || dst_key AS to_id, env,
            CASE WHEN flag = 'A' THEN 'apm' ELSE 'logs' END AS capability, count(*) AS sample_count FROM observation GROUP BY ALL)
          SELECT *, CASE WHEN capability = 'apm' OR sample_count > 1 THEN 'high' ELSE 'medium' END AS confidence FROM c""",
        "pred2_confident_edges": f"WITH {EDGE} SELECT * FROM edge WHERE env = 'prod' AND {conf} >= 2",
        "t1_edges_sorted": f"WITH {EDGE} SELECT * FROM edge ORDER BY from_id, to_id, env",
        "set_union": f"WITH {EDGE} {_SETS.format(t='edge', e='prod')} UNION {_SETS.format(t='edge', e='staging')}",
        "set_intersect": f"WITH {NATION_EDGE} {_SETS.format(t='nedge', e='prod')} INTERSECT {_SETS.format(t='nedge', e='staging')}",
        "set_except": f"WITH {NATION_EDGE} {_SETS.format(t='nedge', e='prod')} EXCEPT {_SETS.format(t='nedge', e='dev')}",
        "g9_explain": f"""WITH {EDGE}, k AS (SELECT from_id, to_id, env FROM edge ORDER BY 1, 2, 3 LIMIT 1)
          SELECT DISTINCT e.from_id, e.to_id, e.env, e.confidence, 'order:' || o.deployed_ref AS locator FROM edge e JOIN k USING (from_id, to_id, env)
          JOIN sup_obs o USING (from_id, to_id, env)""",
        "k2_node_upsert": f"""WITH {DEPLOYABLE} SELECT id, repo_id, CASE WHEN id LIKE '%7' THEN upper(name) ELSE name END AS name FROM deployable
          UNION ALL SELECT 'new-' || id, NULL, 'fresh' FROM deployable WHERE id LIKE '%3'""",
        "k3_edge_insert": f"""WITH {EDGE} SELECT from_id, to_id, env, confidence FROM edge WHERE env = 'prod'
          OR env = 'staging' AND from_id NOT LIKE '%5' AND to_id NOT LIKE '%5'""",
    }


def _diff_sql(where: str) -> str:
    return f"""WITH {NATION_EDGE}, a AS (SELECT * FROM nedge WHERE env = 'prod' {where}), b AS (SELECT * FROM nedge WHERE env = 'staging' {where})
      SELECT coalesce(a.from_id, b.from_id) AS from_id, coalesce(a.to_id, b.to_id) AS to_id,
        CASE WHEN b.confidence IS NULL THEN 'removed' WHEN a.confidence IS NULL THEN 'added' ELSE 'changed' END AS change,
        a.confidence AS confidence_a, b.confidence AS confidence_b
      FROM a FULL OUTER JOIN b ON a.from_id = b.from_id AND a.to_id = b.to_id
      WHERE a.confidence IS NULL OR b.confidence IS NULL OR a.confidence <> b.confidence"""
