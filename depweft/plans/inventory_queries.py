"""Queries of the remaining operators of the inventory, on rows made from the supplier and order tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweft.functions import ranks
from depweft.functions import tokens as T
from depweft.functions import urls as U
from depweft.operators import attribution, extract, judge, projection, reconcile, resolve
from depweft.plans.domain_queries import _facts, _index, _items
from depweft.plans.graph_queries import EDGE, OBSERVATION
from depweft.runtime import table
from depweft.sinks.store import cached, evidence_json, inserted, report_json
from depweft.sources import cicd, vcs

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    """Registers a query with its SQL twin."""

    def put(f):  # noqa: ANN001, ANN202
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def _name(prefix: str):  # noqa: ANN202
    return F.concat(F.lit(prefix), "s_suppkey")


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier")


@query(
    "s1_github_listing",
    """SELECT 'github' AS provider, coalesce(owner.login, CASE WHEN full_name IS NOT NULL THEN split_part(full_name, '/', 1) END) AS org, name, clone_url AS url, coalesce(nullif(default_branch, ''), 'main') AS default_branch FROM repos""",
)
def github_listing(spark: SparkSession, d: str) -> DataFrame:
    """The table of repositories written as the pages that the service lists, with null parts left out, and read again."""
    r = F.struct("name", "full_name", "owner", "clone_url", "default_branch")
    pages = table(spark, d, "repos").groupBy(F.pmod("id", F.lit(32)).alias("page")).agg(F.to_json(F.collect_list(r)).alias("body"))
    return vcs.github_repos(pages)


@query("s2_bitbucket_listing", "SELECT 'bitbucket-dc' AS provider, 'P' || s_nationkey AS org, 's' || s_suppkey AS name, 'https://git.test/' || s_suppkey AS url, 'main' AS default_branch FROM supplier")
def bitbucket_listing(spark: SparkSession, d: str) -> DataFrame:
    link = lambda n, p: F.struct(F.lit(n).alias("name"), F.concat(F.lit(p), "s_suppkey").alias("href"))
    r = F.struct(
        _name("s").alias("slug"), F.struct(F.concat(F.lit("P"), "s_nationkey").alias("key")).alias("project"),
        F.struct(F.array(link("ssh", "ssh://git.test/"), link("http", "https://git.test/")).alias("clone")).alias("links"),
    )
    pages = _suppliers(spark, d).groupBy(F.pmod("s_suppkey", F.lit(32)).alias("page")).agg(F.to_json(F.struct(F.collect_list(r).alias("values"))).alias("body"))
    return vcs.bitbucket_repos(pages)


@query("s3_trees", "SELECT 'r' || s_suppkey AS repo, 'src/' || s_nationkey || '.cs' AS path, 'file' AS type, s_suppkey AS size FROM supplier UNION ALL SELECT 'r' || s_suppkey, 'src', 'tree', 0 FROM supplier")
def trees(spark: SparkSession, d: str) -> DataFrame:
    entry = lambda p, t, s: F.struct(p.alias("path"), F.lit(t).alias("type"), s.alias("size"))
    tree = F.array(entry(F.lit("src"), "tree", F.lit(None).cast("bigint")), entry(F.concat(F.lit("src/"), "s_nationkey", F.lit(".cs")), "blob", F.col("s_suppkey")))
    return vcs.github_tree(_suppliers(spark, d).select(_name("r").alias("repo"), F.to_json(F.struct(tree.alias("tree"))).alias("body"))).withColumn("size", F.coalesce("size", F.lit(0)))


@query("s5_contents", "SELECT 'r' || doc_id AS repo, source AS path, text AS content FROM documents WHERE text IS NOT NULL")
def contents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as the service hands out files: base64 of UTF-8, in all languages and line ends."""
    body = F.struct(F.col("source").alias("path"), F.lit("base64").alias("encoding"), F.base64(F.encode("text", "utf-8")).alias("content"))
    docs = table(spark, d, "documents").filter(F.col("text").isNotNull())
    return vcs.github_content(docs.select(F.concat(F.lit("r"), "doc_id").alias("repo"), F.to_json(body).alias("body")))


@query("s9_deploy_projects", "SELECT 'P' || s_suppkey AS project, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'https://git.test/' || s_suppkey END AS persistence_url FROM supplier")
def deploy_projects(spark: SparkSession, d: str) -> DataFrame:
    url = F.when(F.col("s_suppkey") % 2 == 0, F.struct(F.concat(F.lit("https://git.test/"), "s_suppkey").alias("Url")))
    item = F.struct(_name("P").alias("Id"), F.col("s_name").alias("Name"), url.alias("PersistenceSettings"))
    pages = _suppliers(spark, d).groupBy(F.pmod("s_suppkey", F.lit(32)).alias("page")).agg(F.to_json(F.struct(F.collect_list(item).alias("Items"))).alias("body"))
    return cicd.deploy_projects(pages)


@query(
    "s11_scoped_variables",
    """SELECT ownerid AS owner, row_number() OVER (PARTITION BY ownerid ORDER BY var_row, version) - 1 AS ord, name AS key, CASE WHEN NOT (coalesce(issensitive, false) OR coalesce(vartype = 'Sensitive', false)) THEN value END AS value,
      coalesce(issensitive, false) OR coalesce(vartype = 'Sensitive', false) AS is_secret, array_to_string(scope.environment, ',') AS envs FROM variables WHERE ownerid IS NOT NULL""",
)
def scoped_variables(spark: SparkSession, d: str) -> DataFrame:
    """Each project's variables as the payload of its variable set, in order of their rows."""
    v = F.struct(
        "var_row", "version", F.col("name").alias("Name"), F.col("value").alias("Value"), F.col("issensitive").alias("IsSensitive"), F.col("vartype").alias("Type"),
        F.when(F.col("scope").isNotNull(), F.struct(F.col("scope.environment").alias("Environment"), F.col("scope.role").alias("Role"))).alias("Scope"),
    )
    bodies = table(spark, d, "variables").filter(F.col("ownerid").isNotNull()).groupBy("ownerid").agg(F.array_sort(F.collect_list(v)).alias("v"))
    return cicd.scoped_variables(bodies.select(F.to_json(F.struct(F.col("ownerid").alias("OwnerId"), F.col("v").alias("Variables"))).alias("body"))).select(
        "owner", "ord", "key", "value", "is_secret", F.array_join("scope.environment", ",").alias("envs")
    )


@query(
    "s13_vars_and_secrets",
    """WITH p AS (SELECT buildtypeid AS owner, name, coalesce(bool_or(contains(lower(ptype), 'password')), false) AS secret, max(value) AS value FROM parameters WHERE buildtypeid IS NOT NULL AND name IS NOT NULL GROUP BY ALL)
      SELECT owner, 'prod' AS env, name AS key, CASE WHEN secret THEN '[MASKED]' ELSE value END AS value, secret AS is_secret FROM p WHERE secret OR value IS NOT NULL""",
)
def vars_and_secrets(spark: SparkSession, d: str) -> DataFrame:
    """Parameters of each build as one environment's variables and names of secrets."""
    p = table(spark, d, "parameters").filter(F.col("buildtypeid").isNotNull() & F.col("name").isNotNull())
    p = p.groupBy("buildtypeid", "name").agg(F.coalesce(F.bool_or(F.lower("ptype").contains("password")), F.lit(False)).alias("secret"), F.max("value").alias("value"))
    plain = F.collect_list(F.when(~F.col("secret") & F.col("value").isNotNull(), F.struct("name", "value")))
    body = F.struct(F.map_from_entries(plain).alias("vars"), F.collect_list(F.when(F.col("secret"), F.col("name"))).alias("secrets"))
    return cicd.vars_and_secrets(p.groupBy(F.col("buildtypeid").alias("owner"), F.lit("prod").alias("env")).agg(F.to_json(body).alias("body")))


_YAML = "SELECT 'r' || s_suppkey AS repo, 'go' || s_nationkey AS pipeline, 'deploy' AS role, CASE WHEN s_suppkey % 2 = 0 THEN 'prod' ELSE 'dev' END AS env FROM supplier WHERE s_suppkey % 5 <> 0 UNION ALL SELECT 'r' || s_suppkey, '', 'build', NULL FROM supplier WHERE s_suppkey % 5 = 0"


@query("s15_workflows", _YAML)
def workflows(spark: SparkSession, d: str) -> DataFrame:
    env = F.when(F.col("s_suppkey") % 2 == 0, "prod").otherwise("{name: dev}")
    text = F.when(F.col("s_suppkey") % 5 == 0, "jobs: [").otherwise(F.concat(F.lit("jobs:\n  go"), "s_nationkey", F.lit(":\n    environment: "), env, F.lit("\n")))
    files = _suppliers(spark, d).select(_name("r").alias("repo"), F.lit(".github/workflows/x.yml").alias("path"), text.alias("content"))
    return cicd.workflow_bindings(files).select("repo", "pipeline", "role", "env")


@query("s16_pipelines", "SELECT 'r' || s_suppkey AS repo, 'branches:b' || s_nationkey AS pipeline, 'deploy' AS role, 'prod' AS env FROM supplier UNION ALL SELECT 'r' || s_suppkey, 'default', 'build', NULL FROM supplier")
def pipelines(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("pipelines:\n  default:\n    - step: {script: [x]}\n  branches:\n    b"), "s_nationkey", F.lit(":\n      - step: {deployment: prod}\n"))
    files = _suppliers(spark, d).select(_name("r").alias("repo"), F.lit("bitbucket-pipelines.yml").alias("path"), text.alias("content"))
    return cicd.pipeline_bindings(files).select("repo", "pipeline", "role", "env")


@query("k4_evidence_json", f"WITH {OBSERVATION} SELECT src_key, dst_key, '[\"order:' || min(deployed_ref) || '\"]' AS evidence FROM observation GROUP BY ALL")
def evidence_as_json(spark: SparkSession, d: str) -> DataFrame:
    low = projection.observations(spark, d).groupBy("src_key", "dst_key").agg(F.min("deployed_ref").alias("ref"))
    return low.select("src_key", "dst_key", evidence_json(F.array(F.struct(F.lit("order").alias("source_type"), F.col("ref").alias("locator")))).alias("evidence"))


@query("k6_runtime_edges", f"""WITH {OBSERVATION}, s AS (SELECT DISTINCT 's' || src_key AS f, 's' || dst_key AS t, env FROM observation WHERE flag IN ('A', 'N')),
  r AS (SELECT DISTINCT 's' || src_key AS f, 's' || dst_key AS t, env FROM observation WHERE flag = 'R')
  SELECT f AS from_id, t AS to_id, env, 'declared' AS provenance FROM s UNION ALL SELECT f, t, env, 'observed' FROM (SELECT * FROM r EXCEPT SELECT * FROM s)""")
def runtime_edges(spark: SparkSession, d: str) -> DataFrame:
    """Observed edges added where their pair is not there yet in that environment."""
    obs = projection.supplier_observations(spark, d)
    pick = lambda c, p: obs.filter(c).select("from_id", "to_id", "env", F.lit(p).alias("provenance")).distinct()
    return inserted(pick(F.col("flag").isin("A", "N"), "declared"), pick(F.col("flag") == "R", "observed"))


@query("k7_cache", "SELECT 'k' || s_suppkey AS cache_key, CASE WHEN s_suppkey % 2 = 0 THEN 'old' ELSE 'new' END AS answer FROM supplier")
def response_cache(spark: SparkSession, d: str) -> DataFrame:
    s = _suppliers(spark, d)
    put = lambda c, a: s.filter(c).select(_name("k").alias("cache_key"), F.lit(a).alias("answer"))
    return cached(put(F.col("s_suppkey") % 2 == 0, "old"), put(F.lit(True), "new"))


@query("k9_report", "SELECT '{\"id\":\"s' || s_suppkey || '\",\"gone\":null}' AS json FROM supplier")
def report(spark: SparkSession, d: str) -> DataFrame:
    return report_json(_suppliers(spark, d).select(_name("s").alias("id"), F.lit(None).cast("string").alias("gone")))


@query("pred4_repo_kinds", "SELECT 'r' || s_suppkey AS repo, s_suppkey % 3 = 0 AS markup, s_suppkey % 3 = 1 AS dotnet, s_suppkey % 3 = 2 AS script FROM supplier")
def repo_kinds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    path = F.when(k == 0, "web/Home.ASPX").when(k == 1, "a/appsettings.dev.json").otherwise("package.json")
    return extract.repo_kinds(_suppliers(spark, d).select(_name("r").alias("repo"), path.alias("path")))


@query("pred5_static_assets", "SELECT s_suppkey, s_suppkey % 4 = 0 AS static FROM supplier")
def static_assets(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    v = F.when(k == 0, "x/app.JS?v=1").when(k == 1, "{cdn}/app.js").when(k == 2, "https://h.test/api").otherwise("page.html")
    return _suppliers(spark, d).select("s_suppkey", extract.is_static_asset(v).alias("static"))


@query("pred14_contracts", "SELECT s_suppkey, s_suppkey % 4 = 0 OR s_suppkey % 4 = 3 AS valid, CASE s_suppkey % 4 WHEN 0 THEN 'c' || s_suppkey END AS proposal FROM supplier")
def contracts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    none = F.lit(None).cast("string")
    decision = F.when(k == 0, "ground-to-candidate").when(k == 1, "guess").when(k == 2, "ground-to-candidate").otherwise("keep-ambiguous")
    v = judge.verdict(F.lit("ambiguous-match"), decision, F.when(k == 0, _name("c")), none, none, F.lit("r"))
    return _suppliers(spark, d).select("s_suppkey", v.alias("v")).select("s_suppkey", "v.valid", "v.proposal")


@query("j6_facts_first", """WITH f AS (SELECT 'r' || l_suppkey AS repo, 'k' || (l_partkey % 20) AS name, 'v' || l_partkey AS value, 'f' || l_partkey || '.json' AS source, 1 + l_linenumber % 2 AS layer,
    CASE WHEN l_returnflag = 'A' THEN 'prod.eu' WHEN l_returnflag = 'N' THEN 'prod' END AS condition FROM lineitem),
  w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, name ORDER BY layer DESC, coalesce(length(condition) - length(replace(condition, '.', '')), 0) DESC, source, value, condition NULLS FIRST) AS n FROM f) WHERE n = 1)
  SELECT 'r' || s_suppkey AS repo, 'k' || s_nationkey AS name, w.value AS fact, CASE WHEN w.value IS NOT NULL THEN 0 ELSE -1 END AS rung FROM supplier LEFT JOIN w ON w.repo = 'r' || s_suppkey AND w.name = 'k' || s_nationkey""")
def facts_first(spark: SparkSession, d: str) -> DataFrame:
    wanted = _suppliers(spark, d).select(_name("r").alias("repo"), F.concat(F.lit("k"), "s_nationkey").alias("name"))
    return resolve.facts_first(wanted, _facts(spark, d)).select("repo", "name", "fact", F.coalesce("rung", F.lit(-1)).alias("rung"))


@query("j12_point_lookup", f"WITH {EDGE}, k AS (SELECT from_id, to_id FROM edge WHERE env = 'prod' ORDER BY 1, 2 LIMIT 1) SELECT e.from_id, e.to_id, e.confidence FROM edge e JOIN k USING (from_id, to_id) WHERE env = 'prod'")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    from depweft.operators.edges import edge_at
    from depweft.runtime import cut

    edges = cut(projection.edges(spark, d))
    first = edges.filter(F.col("env") == "prod").orderBy("from_id", "to_id").limit(1).collect()
    key = (first[0]["from_id"], first[0]["to_id"]) if first else ("", "")
    return edge_at(edges, *key, "prod").select("from_id", "to_id", "confidence")


@query("j18_project_repos", "SELECT 'P' || s_suppkey AS project, 'o/s' || s_suppkey AS repo FROM supplier WHERE s_suppkey % 3 < 2")
def project_repos(spark: SparkSession, d: str) -> DataFrame:
    s = _suppliers(spark, d)
    k = F.col("s_suppkey") % 3
    url = F.concat(F.lit("https://git.test/O/S"), "s_suppkey", F.lit(".git"))
    projects = s.select(_name("P").alias("project"), F.when(k == 0, url).alias("persistence_url"), F.when(k == 1, F.array(F.lit("x"), url)).when(k == 2, F.array(*[F.lit("x")] * 5, url)).alias("build_urls"))
    return attribution.projects_of_slugs(projects, s.select(F.concat(F.lit("o/s"), "s_suppkey").alias("full_name")))


@query("j19_merged_providers", "SELECT 'r' || s_suppkey AS repo, 'gh' AS provider, CASE WHEN s_suppkey % 2 = 0 THEN 'build,deploy' ELSE 'build' END AS roles FROM supplier UNION ALL SELECT 'r' || s_suppkey, 'tc', 'deploy' FROM supplier WHERE s_suppkey % 3 = 0")
def merged_providers(spark: SparkSession, d: str) -> DataFrame:
    s = _suppliers(spark, d)
    put = lambda c, p, r: s.filter(c).select(_name("r").alias("repo"), F.lit(p).alias("provider"), F.array(F.lit(r)).alias("roles"))
    outer = put(F.col("s_suppkey") % 2 == 0, "gh", "deploy").unionByName(put(F.col("s_suppkey") % 3 == 0, "tc", "deploy"))
    return attribution.merged_providers(put(F.lit(True), "gh", "build"), outer).select("repo", "provider", F.array_join("roles", ",").alias("roles"))


@query("a7_unknown_services", "SELECT 'u' || s_nationkey AS service, 'prod' AS env, 'no-match' AS reason FROM supplier GROUP BY ALL")
def unknown_services(spark: SparkSession, d: str) -> DataFrame:
    from depweft.operators.identity import resolve_services

    names = _suppliers(spark, d).select(F.concat(F.lit("u"), "s_nationkey").alias("service"))
    return reconcile.unknown_services(resolve_services(names, _index(spark, d)), "prod")


@query("a8_index_size", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT s_suppkey) AS BIGINT) AS owners FROM supplier")
def index_size(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("owner").alias("owners"))


@query("a11_roles", "SELECT 'r' || s_suppkey AS repo, 'gh' AS provider, CASE WHEN s_suppkey % 2 = 0 THEN 'build' ELSE 'build,deploy' END AS roles FROM supplier UNION ALL SELECT 'r' || s_suppkey, 'octo', 'deploy' FROM supplier WHERE s_suppkey % 2 = 0")
def roles(spark: SparkSession, d: str) -> DataFrame:
    s = _suppliers(spark, d)
    mixed = s.select(_name("r").alias("repo"), F.lit("gh").alias("provider"), F.array(F.lit("build"), F.lit("deploy")).alias("roles"))
    only = s.filter(F.col("s_suppkey") % 2 == 0).select(_name("r").alias("repo"), F.lit("octo").alias("provider"), F.array(F.lit("deploy")).alias("roles"))
    return attribution.resolved_roles(mixed.unionByName(only)).select("repo", "provider", F.array_join("roles", ",").alias("roles"))


@query("a14_value_sets", """WITH f AS (SELECT DISTINCT 'r' || l_suppkey AS repo, 'k' || (l_partkey % 20) AS key, 'v' || l_partkey AS value, 1 + l_linenumber % 2 AS layer, 'f' || l_partkey || '.json' AS source,
    CASE WHEN l_returnflag = 'A' THEN 'prod.eu' WHEN l_returnflag = 'N' THEN 'prod' END AS condition FROM lineitem)
  SELECT repo, key, string_agg(value || '@' || layer, ',' ORDER BY layer DESC, value, source, condition NULLS FIRST) AS entries FROM f GROUP BY ALL""")
def value_sets(spark: SparkSession, d: str) -> DataFrame:
    sets = extract.value_sets(_facts(spark, d))
    return sets.select("repo", "key", F.array_join(F.transform("entries", lambda e: F.concat(e["value"], F.lit("@"), e["layer"].cast("string"))), ",").alias("entries"))


@query("e11_static_values", """SELECT 'r' || l_suppkey AS repo, 'prod' AS env, 'k' || l_linenumber AS name, max_by('v' || l_partkey, (l_orderkey, 'v' || l_partkey)) AS value
  FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY l_suppkey, l_linenumber""")
def static_values(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "lineitem").select(
        F.concat(F.lit("r"), "l_suppkey").alias("repo"), F.lit("prod").alias("env_hint"), F.concat(F.lit("k"), "l_linenumber").alias("name"),
        F.concat(F.when(F.col("l_partkey") % 3 == 0, "{t}").otherwise("v"), "l_partkey").alias("raw_value"), F.col("l_orderkey").alias("ord"),
    )
    return resolve.static_values(refs)


@query("e17_machine_identities", """SELECT 'r' || s_suppkey AS repo, 'deploy' AS identity_class, 'https://m' || s_suppkey AS value, 'prod' AS env FROM supplier
  UNION ALL SELECT 'r' || s_suppkey, 'network', 'host' || s_suppkey, 'prod' FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'r' || s_suppkey, 'logical', 'tenant' || s_nationkey, NULL FROM supplier""")
def machine_identities(spark: SparkSession, d: str) -> DataFrame:
    s = _suppliers(spark, d)
    machines = s.select(_name("r").alias("repo"), F.when(F.col("s_suppkey") % 2 == 0, _name("host")).otherwise(" ").alias("name"), _name("https://m").alias("uri"), F.array(F.lit("prod")).alias("envs"))
    return extract.machine_identities(machines, s.select(_name("r").alias("repo"), F.concat(F.lit("tenant"), "s_nationkey").alias("name")))


@query("e19_unresolved", "SELECT 't' || s_suppkey AS ref_id, CASE s_suppkey % 4 WHEN 0 THEN 'secret' WHEN 1 THEN 'no-value' ELSE 'no-match' END AS reason FROM supplier WHERE s_suppkey % 4 < 3")
def unresolved(spark: SparkSession, d: str) -> DataFrame:
    s = _suppliers(spark, d)
    k = F.col("s_suppkey") % 4
    t = s.select(_name("t").alias("ref_id"), F.when(k == 0, resolve.UNREADABLE).when(k == 1, resolve.EXHAUSTED).otherwise("v").alias("value"), (k > 1).alias("resolved"))
    return extract.unresolved(t, t, s.filter(k == 3).select(_name("t").alias("ref_id")))


@query("f6_substituted", "SELECT 't' || s_suppkey AS ref_id, 'https://h' || s_suppkey || '/x' AS resolved_value FROM supplier WHERE s_suppkey % 2 = 0")
def substituted(spark: SparkSession, d: str) -> DataFrame:
    s = _suppliers(spark, d)
    refs = s.select(_name("t").alias("ref_id"), F.lit("#{base.url}/x").alias("raw_value"), F.lit("base.url").alias("name"))
    values = s.select(_name("t").alias("ref_id"), _name("https://h").alias("value"), (F.col("s_suppkey") % 2 == 0).alias("resolved"))
    return resolve.substituted(refs, values).select("ref_id", "resolved_value")


@query("f12_evidence_lists", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'a,b' || s_suppkey WHEN 1 THEN 'plain' || s_suppkey ELSE '' END AS locators FROM supplier")
def evidence_lists(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    raw = F.when(k == 0, F.concat(F.lit('["a","b'), "s_suppkey", F.lit('"]'))).when(k == 1, _name("plain"))
    return _suppliers(spark, d).select("s_suppkey", F.array_join(T.evidence_list(raw), ",").alias("locators"))


@query("f17_class_confidence", "SELECT * FROM (VALUES ('network', 'high'), ('logical', 'medium'), ('deploy', 'high'), ('artifact', 'high'), ('async', 'medium'), ('data', 'low'), ('service-tag', 'high'), ('odd', 'medium')) t(identity_class, confidence)")
def class_confidence(spark: SparkSession, d: str) -> DataFrame:
    df = spark.createDataFrame([(c,) for c in (*judge.IDENTITY_CLASSES, "odd")], "identity_class string")
    return df.select("identity_class", ranks.class_confidence(F.col("identity_class")).alias("confidence"))


@query("f19_endpoints", "SELECT s_suppkey, 'https://h' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN ':8443' ELSE '' END || '/a' AS url, CAST(s_suppkey % 3 AS INT) AS dots FROM supplier")
def endpoints(spark: SparkSession, d: str) -> DataFrame:
    url = U.endpoint_url(F.lit(None).cast("string"), _name("h"), F.when(F.col("s_suppkey") % 2 == 0, 8443), F.lit("/a"))
    condition = F.array_join(F.array_repeat(F.lit("x"), (F.col("s_suppkey") % 3 + 1).cast("int")), ".")
    return _suppliers(spark, d).select("s_suppkey", url.alias("url"), T.specificity(condition).alias("dots"))


@query("l3_prompts", """SELECT 'i' || s_suppkey AS ref_id, 'Task: UNRESOLVED_REF:i' || s_suppkey || chr(10) || 'Choices:' || chr(10) || '- c' || chr(10) || 'Evidence:' || chr(10) || '- a:1' || chr(10) || '- f:' || s_suppkey || chr(10)
  || 'Answer with a JSON object of: resolved_value, reasoning' AS prompt FROM supplier""")
def prompts(spark: SparkSession, d: str) -> DataFrame:
    text = judge.prompt(F.col("kind"), judge.goal_of(F.col("kind"), F.col("ref_id")), F.array(F.lit("c")), F.col("locators"))
    return _items(spark, d).select("ref_id", text.alias("prompt"))


@query("k8_traces", "SELECT 'i' || s_suppkey AS ref_id, sha256('k' || s_suppkey || '|i' || s_suppkey || '|why') AS trace_id FROM supplier")
def traces(spark: SparkSession, d: str) -> DataFrame:
    s = _suppliers(spark, d)
    done = s.select(_name("i").alias("ref_id"), _name("k").alias("cache_key"), F.lit("edge").alias("disposition"))
    return judge.traces(done, s.select(_name("k").alias("cache_key"), F.lit("why").alias("reasoning"))).select("ref_id", "trace_id")


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
