"""Queries of operators over the domain's own tables, whole, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweft.operators import extract, projection, resolve, shred
from depweft.plans.data_quality import OBJECTS
from depweft.plans.graph_queries import OBSERVATION
from depweft.runtime import table
from depweft.sources import telemetry

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):  # noqa: ANN201
    """Registers a query with its SQL twin."""

    def put(f):  # noqa: ANN001, ANN202
        Q[name], SQL[name] = f, sql
        return f

    return put


# Build configurations


@query(
    "s10_build_configs",
    f"""{OBJECTS} SELECT bt_row, j->>'id' AS id, j->>'name' AS name, j->>'projectId' AS project_id, j->>'projectName' AS project_name, j->>'href' AS href FROM r WHERE json_type(j) = 'OBJECT'""",
)
def build_configs(spark: SparkSession, d: str) -> DataFrame:
    fields = {"id": "id", "name": "name", "project_id": "projectId", "project_name": "projectName", "href": "href"}
    return shred.record_fields(table(spark, d, "build_types"), "bt_row", "payload", fields, "buildType").withColumnRenamed("row_key", "bt_row")


# Telemetry

_PAGE = 40


@query(
    "s20_truncated_pages",
    f"""WITH {OBSERVATION}, p AS (SELECT *, o_orderkey % 8 AS page, row_number() OVER (PARTITION BY env, o_orderkey % 8 ORDER BY o_orderkey, ln, src_key, dst_key) AS n, count(*) OVER (PARTITION BY env, o_orderkey % 8) AS total FROM observation)
      SELECT 'svc' || src_key AS from_service, 'svc' || dst_key AS to_service, env, total > {_PAGE} AS truncated, count(*) AS sample_count FROM p WHERE n <= {_PAGE} GROUP BY ALL""",
)
def truncated_pages(spark: SparkSession, d: str) -> DataFrame:
    """Service maps of which a page holds more rows than a call returns: the first ones stay and the page says so."""
    obs = projection.supplier_observations(spark, d)
    row = F.struct(F.concat(F.lit("svc"), "src_key").alias("from_service"), F.concat(F.lit("svc"), "dst_key").alias("to_service"), F.col("env").alias("env"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "ln", "src_key", "dst_key", row.alias("d")))), lambda x: x["d"])
    bodies = obs.groupBy("env", (F.col("o_orderkey") % 8).alias("page")).agg(F.to_json(F.struct(listed.alias("data"))).alias("body"))
    edges = telemetry.service_map(bodies.select("env", "body"), _PAGE)
    return edges.groupBy("from_service", "to_service", "env", "truncated").agg(F.count(F.lit(1)).alias("sample_count"))


# Scopes


_LISTED = "list_transform(list_filter(coalesce(scope.{0}, []), lambda e: e IS NOT NULL), lambda e: lower(trim(e, ' ')))"


@query(
    "pred7_scope_fits",
    f"""SELECT preview_row, projectid, name FROM variable_preview WHERE scope IS NULL OR (
      (coalesce(len(scope.environment), 0) = 0 OR list_contains({_LISTED.format("environment")}, 'production europe'))
      AND (coalesce(len(scope.role), 0) = 0 OR list_contains({_LISTED.format("role")}, 'web-server'))
      AND (coalesce(len(scope.channel), 0) = 0 OR list_contains({_LISTED.format("channel")}, 'channels-2')))""",
)
def scope_fits(spark: SparkSession, d: str) -> DataFrame:
    """Variables that count for one environment, role and channel at once."""
    v = table(spark, d, "variable_preview")
    return v.filter(resolve.fits(F.col("scope"), environment="Production Europe", role="web-server", channel="Channels-2")).select("preview_row", "projectid", "name")


# Files made of documents: the repository is the document's, its path the document's id


_DOCS = "docs AS (SELECT coalesce(repo, '') AS repo, doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL)"
_KEY = r"""^\s*(?:export\s+)?([A-Za-z_][\w\-]*(?:\.[\w\-]+)+)\s*(?:=|:\s)\s*["'']?([^"'']*)["'']?\s*$"""


def _files(spark: SparkSession, d: str, suffix: str = "") -> DataFrame:
    docs = table(spark, d, "documents").filter(F.col("text").isNotNull())
    return docs.select(F.coalesce("repo", F.lit("")).alias("repo"), F.concat(F.col("doc_id").cast("string"), F.lit(suffix)).alias("path"), F.col("text").alias("content"))


@query(
    "j3_declaration_places",
    rf"""WITH {_DOCS}, k AS (SELECT repo, regexp_extract(line, '{_KEY}', 1) AS name, doc_id, n FROM docs),
      j AS (SELECT repo, name, doc_id || ':' || n AS place, doc_id, n FROM k WHERE name <> '')
      SELECT repo, name, arg_min(place, (doc_id, n)) AS first_in, count(DISTINCT place) AS n_places, min(place) AS least, max(place) AS greatest FROM j GROUP BY ALL""",
)
def declaration_places(spark: SparkSession, d: str) -> DataFrame:
    """Where each name that a repository's texts set is declared: its first place and all of them."""
    settings = extract.settings_lines(extract.lines(_files(spark, d)))
    uses = settings.select("repo", F.col("key").alias("name"))
    ordinal = F.struct(F.col("path").cast("bigint").alias("doc"), "line_no")
    decls = settings.select("repo", F.col("key").alias("name"), ordinal.alias("ord"), F.concat_ws(":", "path", F.col("line_no").cast("string")).alias("declared_in"))
    found = resolve.declarations(uses, decls)
    return found.select("repo", "name", "first_in", F.size("places").cast("bigint").alias("n_places"), F.array_min("places").alias("least"), F.array_max("places").alias("greatest"))


@query(
    "j5_log_values",
    rf"""WITH {_DOCS}, t AS (SELECT DISTINCT repo, lower(regexp_extract(line, '{_KEY}', 1)) AS name FROM docs WHERE regexp_extract(line, '{_KEY}', 1) <> ''),
      l AS (SELECT repo, doc_id, n, trim(line, ' ') AS line FROM docs),
      v AS (SELECT repo, doc_id, n, lower(substr(line, 1, instr(line, '=') - 1)) AS name, trim(substr(line, instr(line, '=') + 1), ' ') AS value FROM l WHERE instr(line, '=') > 1)
      SELECT repo || '/' || name AS ref_id, arg_min(value, (doc_id, n)) AS value FROM t JOIN v USING (repo, name) WHERE value <> '' GROUP BY ALL""",
)
def log_values(spark: SparkSession, d: str) -> DataFrame:
    """Values of keys that the documents of a repository, read as deploy logs, print: the first line of the first log."""
    files = _files(spark, d)
    keys = extract.settings_lines(extract.lines(files)).select("repo", F.lower("key").alias("name")).distinct()
    tokens = keys.select(F.concat_ws("/", "repo", "name").alias("ref_id"), "repo", "name", F.lit("prod").alias("env"))
    logs = files.select("repo", F.lit("prod").alias("env"), F.col("content").alias("log"), F.col("path").cast("bigint").alias("ord"))
    return resolve.from_logs(tokens, logs)


@query(
    "e8_dotenv",
    rf"""WITH {_DOCS}, m AS (SELECT repo, doc_id, regexp_extract(line, '^\s*(?:export\s+)?([A-Za-z_][\w.]*)\s*=(.*)$', ['key', 'value']) AS m FROM docs WHERE regexp_matches(line, '^\s*(?:export\s+)?[A-Za-z_][\w.]*\s*=')),
      v AS (SELECT repo, doc_id || '.env' AS path, m.key AS key, regexp_replace(trim(m.value, ' '), '^["'']|["'']$', '', 'g') AS value FROM m)
      SELECT repo, path, key, value, count(*) AS n FROM v WHERE regexp_matches(value, 'https?://[a-zA-Z0-9._-]+(?:\.[a-zA-Z]{{2,}})(?::\d+)?(?:/[^\s"''<>,;}}\]]*)?') GROUP BY ALL""",
)
def dotenv(spark: SparkSession, d: str) -> DataFrame:
    return extract.dotenv_values(extract.lines(_files(spark, d, ".env"))).groupBy("repo", "path", "key", "value").agg(F.count(F.lit(1)).alias("n"))


# Settings files made of build records: payloads as JSON, parameters as XML


_NAMED = "CASE bt_row % 3 WHEN 0 THEN 'a/appsettings.json' WHEN 1 THEN 'appsettings.prod.json' ELSE 'appsettings.prod.eu.json' END"


@query(
    "e12_settings_facts",
    f"""WITH a AS (SELECT bt_row, CAST(ltrim(payload, chr(65279)) AS JSON) AS j FROM build_types WHERE json_valid(ltrim(payload, chr(65279)))),
      t AS (SELECT bt_row, x.key AS key, x.value AS value, x.type AS type, x.atom AS atom, x.path AS path, x.fullkey AS fullkey FROM a, json_tree(a.j) AS x WHERE json_type(j) = 'OBJECT'),
      v AS (SELECT bt_row, replace(replace(replace(fullkey, '$.', ''), '"', ''), '.', ':') AS key, CASE type WHEN 'NULL' THEN '' WHEN 'VARCHAR' THEN atom->>'$' WHEN 'ARRAY' THEN CAST(value AS VARCHAR) ELSE CAST(atom AS VARCHAR) END AS value
        FROM t WHERE type <> 'OBJECT' AND NOT contains(fullkey, '['))
      SELECT 'b' || bt_row AS repo, key, value, {_NAMED} AS source, nullif(regexp_extract({_NAMED}, '[^/]*$'), 'appsettings.json') AS condition, 1 AS layer, 1 + bt_row % 3 AS rank FROM v""",
)
def settings_facts(spark: SparkSession, d: str) -> DataFrame:
    """Every leaf of a settings file, whatever its type, with its file's place in the order of base and environments."""
    at = F.col("bt_row") % 3
    path = F.when(at == 0, "a/appsettings.json").when(at == 1, "appsettings.prod.json").otherwise("appsettings.prod.eu.json")
    files = table(spark, d, "build_types").select(F.concat(F.lit("b"), "bt_row").alias("repo"), path.alias("path"), F.col("payload").alias("content"))
    return extract.file_facts(files)


_TEXT = "regexp_replace({0}, '[^ -~]', '', 'g')"


@query(
    "e13_first_section",
    f"""SELECT buildtypeid AS repo, {_TEXT.format("name")} AS key, {_TEXT.format("value")} AS value, count(*) AS n FROM parameters WHERE buildtypeid IS NOT NULL AND name IS NOT NULL AND value IS NOT NULL AND param_row % 2 = 0 GROUP BY ALL""",
)
def first_section(spark: SparkSession, d: str) -> DataFrame:
    """Parameters written as web.config files of two appSettings sections each, of which only the first counts."""

    def escaped(c: str):  # noqa: ANN202
        out = F.regexp_replace(c, "[^ -~]", "")
        for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            out = F.replace(out, F.lit(sign), F.lit(entity))
        return out

    p = table(spark, d, "parameters").filter(F.col("buildtypeid").isNotNull() & F.col("name").isNotNull())
    add = F.when(F.col("value").isNull(), F.concat(F.lit('<add key="'), escaped("name"), F.lit('"/>'))).otherwise(F.concat(F.lit('<add key="'), escaped("name"), F.lit('" value="'), escaped("value"), F.lit('"/>')))
    section = lambda odd: F.array_join(F.collect_list(F.when(F.col("param_row") % 2 == odd, add)), "")
    content = F.concat(F.lit("<configuration><x><appSettings>"), section(0), F.lit("</appSettings></x><appSettings>"), section(1), F.lit("</appSettings></configuration>"))
    files = p.groupBy(F.col("buildtypeid").alias("repo")).agg(content.alias("content")).withColumn("path", F.lit("web/Web.config"))
    return extract.file_facts(files).groupBy("repo", "key", "value").agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
