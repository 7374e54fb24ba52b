"""Queries of extraction, resolution, attribution, safety and sources on the domain tables, with their SQL twins.

Where the tables hold no files or payloads of a kind, these are composed from the supplier and order tables, so that the
expected rows follow in SQL from the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweft.functions import tokens as T
from depweft.functions import urls as U
from depweft.operators import attribution, build, extract, identity, judge, projection, resolve
from depweft.plans.graph_queries import OBSERVATION
from depweft.runtime import table
from depweft.sources import cicd, telemetry
from depweft.streaming import observed

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


# Sources


@query(
    "s1_repositories",
    """SELECT DISTINCT provider, owner.login AS org, name, clone_url AS url, coalesce(nullif(default_branch, ''), 'main') AS default_branch,
      provider || ':' || owner.login || '/' || name AS full_name FROM repos""",
)
def repositories(spark: SparkSession, d: str) -> DataFrame:
    from depweft.sources.vcs import default_branch, with_full_name

    r = table(spark, d, "repos")
    return with_full_name(r.select("provider", F.col("owner.login").alias("org"), "name", F.col("clone_url").alias("url"), default_branch(F.col("default_branch")).alias("default_branch"))).distinct()


@query(
    "s12_parameter_store",
    """SELECT buildtypeid AS owner, param_row AS ord, name, CASE WHEN NOT coalesce(contains(lower(ptype), 'password'), false) THEN value END AS value,
      coalesce(contains(lower(ptype), 'password'), false) AS is_secret FROM parameters""",
)
def parameter_store(spark: SparkSession, d: str) -> DataFrame:
    return cicd.parameter_rows(table(spark, d, "parameters"))


@query(
    "s17_effective_value",
    """SELECT projectid, name, CASE WHEN NOT coalesce(issensitive, false) THEN value END AS value, coalesce(issensitive, false) AS is_secret,
      array_to_string(scope.environment, ',') AS envs FROM variable_preview WHERE name = 'Http.Port'""",
)
def effective_value(spark: SparkSession, d: str) -> DataFrame:
    return cicd.effective_value(table(spark, d, "variable_preview"), "Http.Port").select("projectid", "name", "value", "is_secret", F.array_join("scope.environment", ",").alias("envs"))


def _payloads(spark: SparkSession, d: str, item) -> DataFrame:  # noqa: ANN001
    """Telemetry pages of at most some hundred rows: ``env, body``."""
    obs = projection.supplier_observations(spark, d)
    rows = obs.select("env", F.pmod(F.xxhash64("o_orderkey", "ln"), F.lit(64)).alias("page"), item.alias("d"))
    return rows.groupBy("env", "page").agg(F.to_json(F.struct(F.collect_list("d").alias("data"))).alias("body")).select("env", "body")


_SAMPLED = f"""WITH {OBSERVATION} SELECT 'svc' || src_key AS from_service, 'svc' || dst_key AS to_service, env, '{{c}}' AS capability, count(*) AS sample_count
  FROM observation {{w}} GROUP BY ALL"""


@query("s21_service_map", _SAMPLED.format(c="apm", w=""))
def service_map(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct(F.concat(F.lit("svc"), "src_key").alias("from_service"), F.concat(F.lit("svc"), "dst_key").alias("to_service"), F.col("env").alias("env"))
    return telemetry.sampled(telemetry.service_map(_payloads(spark, d, item), 1 << 20))


@query("s22_span_edges", _SAMPLED.format(c="traces", w="WHERE flag <> 'R'"))
def span_edges(spark: SparkSession, d: str) -> DataFrame:
    peer = F.concat(F.lit("svc"), "dst_key")
    a = F.struct(
        F.concat(F.lit("svc"), "src_key").alias("service"), F.when(F.col("flag") == "R", "server").otherwise("client").alias("span_kind"),
        F.when(F.col("flag") == "A", peer).otherwise("").alias("peer_service"), F.when(F.col("flag") != "A", peer).alias("out_host"),
    )
    return telemetry.sampled(telemetry.span_edges(_payloads(spark, d, F.struct(a.alias("attributes"))), 1 << 20))


@query("s23_log_edges", _SAMPLED.format(c="logs", w=""))
def log_edges(spark: SparkSession, d: str) -> DataFrame:
    peer = F.concat(F.lit("svc"), "dst_key")
    inner = F.when(F.col("flag") == "A", F.create_map(F.lit("peer.service"), peer)).otherwise(F.create_map(F.lit("http.url"), F.concat(F.lit("https://"), peer, F.lit(".example.com/x"))))
    a = F.struct(F.concat(F.lit("svc"), "src_key").alias("service"), inner.alias("attributes"), F.lit("called").alias("message"))
    return telemetry.sampled(telemetry.log_edges(_payloads(spark, d, F.struct(a.alias("attributes"))), 1 << 20))


@query("s24_browser_edges", _SAMPLED.format(c="rum", w=""))
def browser_edges(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.lit("https://svc"), "dst_key", F.lit(".example.com:8443/a?b=c"))
    a = F.struct(F.concat(F.lit("svc"), "src_key").alias("service"), F.struct(url.alias("url")).alias("resource"))
    return telemetry.sampled(telemetry.browser_edges(_payloads(spark, d, F.struct(a.alias("attributes"))), 1 << 20))


# Scalar functions


@query(
    "f1_normalised_urls",
    """SELECT DISTINCT homepage, regexp_replace(lower(regexp_extract(homepage, '^(?:[A-Za-z]+://)?([^:/]*)', 1)), '^www\\.', '') ||
      coalesce(nullif(regexp_replace(regexp_extract(homepage, '^(?:[A-Za-z]+://)?[^/]*(/.*)?$', 1), '/+$', ''), ''), '/') AS norm FROM repos WHERE homepage IS NOT NULL""",
)
def normalised_urls(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "repos").filter(F.col("homepage").isNotNull())
    return r.select("homepage", U.normalise_url(F.col("homepage")).alias("norm")).distinct()


@query(
    "f4_hosts",
    """SELECT DISTINCT homepage, lower(nullif(regexp_extract(homepage, '^[A-Za-z]+://([^:/]*)', 1), '')) AS host,
      split_part(lower(nullif(regexp_extract(homepage, '^[A-Za-z]+://([^:/]*)', 1), '')), '.', 1) AS label FROM repos""",
)
def hosts(spark: SparkSession, d: str) -> DataFrame:
    h = U.host_of(F.col("homepage"))
    return table(spark, d, "repos").select("homepage", h.alias("host"), U.first_label(h).alias("label")).distinct()


_ALIASES = ", ".join(f"('{a}', '{env}')" for env, names in U.ENVIRONMENTS.items() for a in (env, *names))


@query(
    "f7_environments",
    f"""SELECT name, coalesce(a.env, name) AS env, a.env IS NOT NULL AS env_known, count(*) AS n FROM environments
      LEFT JOIN (VALUES {_ALIASES}) a(alias, env) ON lower(trim(name, ' ')) = alias GROUP BY ALL""",
)
def environments(spark: SparkSession, d: str) -> DataFrame:
    out = U.canonical_environment(table(spark, d, "environments").select("name"), "name")
    return out.groupBy("name", "env", "env_known").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f8_kebab_names",
    """SELECT DISTINCT name, lower(regexp_replace(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\\1-\\2', 'g'), '([a-z0-9])([A-Z])', '\\1-\\2', 'g')) AS kebab FROM variables WHERE name IS NOT NULL""",
)
def kebab_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "variables").filter(F.col("name").isNotNull()).select("name", T.camel_to_kebab(F.col("name")).alias("kebab")).distinct()


@query(
    "f9_key_kinds",
    """SELECT DISTINCT name, regexp_matches(lower(name), 'url|endpoint|address|host') AS is_url, CASE WHEN contains(lower(name), 'connection') THEN 'connection-string'
      WHEN regexp_matches(lower(name), 'url|baseaddress|endpoint|host|api') THEN 'http-client' ELSE 'other' END AS kind,
      regexp_matches(lower(name), 'password|secret|token|apikey|api_key|connectionstring') AS secret FROM variables WHERE name IS NOT NULL""",
)
def key_kinds(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("name")
    return table(spark, d, "variables").filter(n.isNotNull()).select("name", T.is_url_key(n).alias("is_url"), T.reference_kind(n).alias("kind"), T.is_secret_key(n).alias("secret")).distinct()


@query(
    "f10_full_names",
    """SELECT DISTINCT full_name, provider AS p, split_part(full_name, '/', 1) AS org, split_part(full_name, '/', 2) AS name FROM repos""",
)
def full_names(spark: SparkSession, d: str) -> DataFrame:
    parts = U.full_name_parts(F.concat("provider", F.lit(":"), "full_name"))
    return table(spark, d, "repos").select("full_name", parts.alias("x")).select("full_name", F.col("x.provider").alias("p"), "x.org", "x.name").distinct()


@query(
    "f13_redacted",
    r"""WITH v AS (SELECT var_row, 'GET /' || name || '?api_key=' || value || '&token=' || value || '&key=x Authorization: ' || CASE WHEN var_row % 2 = 0 THEN 'Bearer ' ELSE 'Basic ' END || value AS x FROM variables WHERE name IS NOT NULL AND value IS NOT NULL)
      SELECT var_row, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, 'Bearer\s+\S+', 'Bearer [REDACTED]', 'g'), 'Basic\s+\S+', 'Basic [REDACTED]', 'g'),
        '(api_key=)[^&\s]+', '\1[REDACTED]', 'g'), '(token=)[^&\s]+', '\1[REDACTED]', 'g'), '(key=)[^&\s]+', '\1[REDACTED]', 'g') AS line FROM v""",
)
def redacted(spark: SparkSession, d: str) -> DataFrame:
    """Requests made of every variable's name and value, whatever stands in them."""
    value = F.col("value")
    scheme = F.when(F.col("var_row") % 2 == 0, "Bearer ").otherwise("Basic ")
    raw = F.concat(F.lit("GET /"), "name", F.lit("?api_key="), value, F.lit("&token="), value, F.lit("&key=x Authorization: "), scheme, value)
    return table(spark, d, "variables").filter(F.col("name").isNotNull() & value.isNotNull()).select("var_row", T.redact(raw).alias("line"))


@query(
    "f14_evidence",
    """SELECT s_suppkey, 'log:' || s_suppkey || '?key=[REDACTED]' AS kept, 1 AS n FROM supplier""",
)
def evidence(spark: SparkSession, d: str) -> DataFrame:
    raw = F.array(F.concat(F.lit("log:"), "s_suppkey", F.lit("?key=abc")), F.concat(F.lit("mail:ops"), "s_suppkey", F.lit("@example.com")), F.lit("call 555-123-4567"), F.lit(T.REDACTED))
    kept = T.redact_evidence(raw)
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(kept, ",").alias("kept"), F.size(kept).alias("n"))


@query(
    "f15_secrets",
    """SELECT DISTINCT name, CASE WHEN regexp_matches(lower(name), 'password|secret|token|apikey|api_key|connectionstring') THEN '[REDACTED]'
      ELSE replace(replace(value, 'stable', '[REDACTED]'), 'Debug', '[REDACTED]') END AS shown FROM variables WHERE name IS NOT NULL AND value IS NOT NULL""",
)
def secrets(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "variables").filter(F.col("name").isNotNull() & F.col("value").isNotNull())
    return v.select("name", T.redact_secrets(F.col("name"), F.col("value"), F.array(F.lit("stable"), F.lit("Debug"))).alias("shown")).distinct()


@query(
    "f16_locators",
    """SELECT DISTINCT event_type, 'telemetry:' || event_type || ':prod:/api/unknown/' || event_type || '@2024-01-01T00:00:00Z' AS locator, false AS valid FROM events
      UNION ALL SELECT 'apm', 'telemetry:apm:prod:/api/v1/service_dependencies@2024-01-01T00:00:00Z', true""",
)
def locators(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "events").select("event_type").distinct().unionByName(spark.createDataFrame([("apm",)], "event_type string"))
    loc = T.evidence_locator("telemetry", F.col("event_type"), F.lit("prod"), F.lit("2024-01-01T00:00:00Z"))
    return kinds.select("event_type", loc.alias("locator")).withColumn("valid", T.valid_locator("telemetry", F.col("locator")))


@query(
    "f11_log_values",
    """SELECT s_suppkey, 'v' || s_suppkey AS value FROM supplier WHERE s_suppkey % 3 <> 0""",
)
def log_values(spark: SparkSession, d: str) -> DataFrame:
    log = F.concat(F.lit("start\nOther=1\n"), F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("  base_url=v"), "s_suppkey", F.lit(" \nBASE_URL=later"))).otherwise("none"))
    out = table(spark, d, "supplier").select("s_suppkey", T.value_from_logs(log, F.lit("Base_Url")).alias("value"))
    return out.filter(F.col("value").isNotNull())


@query(
    "pred12_residency",
    """SELECT coalesce(CASE WHEN regexp_matches(text, '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}') THEN 'email'
      WHEN regexp_matches(text, '\\b(\\+?1[-.\\s]?)?\\(?\\d{3}\\)?[-.\\s]?\\d{3}[-.\\s]?\\d{4}\\b') THEN 'phone' END, 'none') AS reason, count(*) AS n
      FROM documents WHERE text IS NOT NULL GROUP BY ALL""",
)
def residency(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter(F.col("text").isNotNull())
    why = T.residency_trigger(F.lit("CHECK"), F.lit(None).cast("string"), F.col("text"))
    return docs.groupBy(F.coalesce(why, F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# Extraction


def _document_files(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter(F.col("text").isNotNull())
    return docs.select(F.col("doc_id").cast("string").alias("repo"), F.lit("README.md").alias("path"), F.col("text").alias("content"))


@query(
    "e2_tokens",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line FROM documents WHERE text IS NOT NULL),
      n AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(line, '#\{([a-zA-Z][a-zA-Z0-9_.-]*)\}', 1), regexp_extract_all(line, '\$\{([a-zA-Z][a-zA-Z0-9_.-]*)\}', 1),
        regexp_extract_all(line, '(?:^|[^#$])\{([a-zA-Z][a-zA-Z0-9_.-]*)\}', 1), regexp_extract_all(line, '%\(([a-zA-Z][a-zA-Z0-9_.-]*)\)%', 1))) AS name FROM l)
      SELECT CAST(doc_id AS VARCHAR) AS repo, name, count(*) AS n FROM n GROUP BY ALL""",
)
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return extract.token_uses(extract.lines(_document_files(spark, d))).groupBy("repo", "name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "e8_settings_lines",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line FROM documents WHERE text IS NOT NULL),
      m AS (SELECT doc_id, regexp_extract(line, '^\s*(?:export\s+)?([A-Za-z_][\w\-]*(?:\.[\w\-]+)+)\s*(?:=|:\s)\s*["'']?([^"'']*)["'']?\s*$', ['key', 'value']) AS m FROM l)
      SELECT CAST(doc_id AS VARCHAR) AS repo, m.key AS key, trim(m.value) AS value, count(*) AS n FROM m WHERE m.key <> '' GROUP BY ALL""",
)
def settings(spark: SparkSession, d: str) -> DataFrame:
    return extract.settings_lines(extract.lines(_document_files(spark, d))).groupBy("repo", "key", "value").agg(F.count(F.lit(1)).alias("n"))


def _supplier_files(spark: SparkSession, d: str, path, content) -> DataFrame:  # noqa: ANN001
    return table(spark, d, "supplier").select(F.concat(F.lit("r"), "s_suppkey").alias("repo"), path.alias("path"), content.alias("content"))


@query(
    "e1_markup",
    """SELECT 'r' || s_suppkey AS repo, 'iframe' AS kind, 'https://h' || s_nationkey || '.example.com/a' AS raw_value, '' AS tokens, 'home.aspx:2' AS evidence FROM supplier
      UNION ALL SELECT 'r' || s_suppkey, 'script', '{base-' || s_nationkey || '}/x.js', 'base-' || s_nationkey, 'home.aspx:3' FROM supplier""",
)
def markup(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(
        F.lit("<html>\n<IFRAME class=x src='https://h"), "s_nationkey", F.lit(".example.com/a'></iframe>\n<script src=\"{base-"), "s_nationkey",
        F.lit("}/x.js\"></script>\n<link href=\"site.css?v=1\" rel=x>\n<script src='lib/app.js'></script>"),
    )
    refs = extract.markup_references(extract.lines(_supplier_files(spark, d, F.lit("home.aspx"), text)))
    return refs.select("repo", "kind", "raw_value", F.array_join("tokens", ",").alias("tokens"), "evidence")


def _json_files(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(
        F.lit('{"Services":{"OrderApi":{"BaseUrl":"https://o'), "s_nationkey", F.lit('.example.com/v1","Key":"#{Order.Key'), "s_suppkey",
        F.lit('}"},"Name":"'), "s_name", F.lit('","List":["https://skip.example.com"]},"endpoint":"plain"}'),
    )
    bad = F.col("s_suppkey") % 7 == 0
    return _supplier_files(spark, d, F.lit("appsettings.prod.json"), F.when(bad, "{broken").otherwise(text))


@query(
    "e4_json_settings",
    """WITH s AS (SELECT * FROM supplier WHERE s_suppkey % 7 <> 0)
      SELECT 'r' || s_suppkey AS repo, 'Services.OrderApi.BaseUrl' AS place, 'https://o' || s_nationkey || '.example.com/v1' AS value, true AS is_ref, 'http-client' AS kind, 'base-url' AS declares, false AS injected, 'prod' AS env_hint FROM s
      UNION ALL SELECT 'r' || s_suppkey, 'Services.OrderApi.Key', '#{Order.Key' || s_suppkey || '}', true, 'other', 'Order.Key' || s_suppkey, true, 'prod' FROM s
      UNION ALL SELECT 'r' || s_suppkey, 'Services.Name', s_name, false, NULL, '', false, 'prod' FROM s
      UNION ALL SELECT 'r' || s_suppkey, 'endpoint', 'plain', true, 'http-client', 'endpoint', false, 'prod' FROM s""",
)
def json_settings(spark: SparkSession, d: str) -> DataFrame:
    out = extract.classified(extract.json_settings(_json_files(spark, d)))
    return out.select("repo", "place", "value", "is_ref", "kind", F.array_join("declares", ",").alias("declares"), "injected", "env_hint")


@query(
    "e6_xml_settings",
    """SELECT 'r' || s_suppkey AS repo, 'appSettings' AS place, 'ApiUrl' AS key, 'https://x' || s_nationkey || '.example.com' AS value FROM supplier WHERE s_suppkey % 5 <> 0
      UNION ALL SELECT 'r' || s_suppkey, 'connectionString', 'db', 'Server=' || s_suppkey FROM supplier WHERE s_suppkey % 5 <> 0
      UNION ALL SELECT 'r' || s_suppkey, 'package', 'Lib', '1.' || s_nationkey FROM supplier WHERE s_suppkey % 5 <> 0""",
)
def xml_settings(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(
        F.lit("<configuration><location><appSettings><add key='ApiUrl' value='https://x"), "s_nationkey", F.lit(".example.com'/></appSettings></location><connectionStrings><add name='db' connectionString='Server="),
        "s_suppkey", F.lit("'/></connectionStrings><ItemGroup><PackageReference Include='Lib' Version='1."), "s_nationkey", F.lit("'/></ItemGroup></configuration>"),
    )
    broken = F.when(F.col("s_suppkey") % 5 == 0, "<configuration><add").otherwise(text)
    return extract.xml_settings(_supplier_files(spark, d, F.lit("web.config"), broken)).select("repo", "place", "key", "value")


@query(
    "e7_packages",
    """SELECT 'r' || s_suppkey AS repo, 'artifact' AS identity_class, 'nuget:Lib@1.' || s_nationkey AS value, CAST(NULL AS VARCHAR) AS env FROM supplier""",
)
def packages(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("<Project><PackageReference Include='Lib' Version='1."), "s_nationkey", F.lit("'/></Project>"))
    return extract.package_identities(extract.xml_settings(_supplier_files(spark, d, F.lit("a.csproj"), text)))


@query(
    "e14_constants",
    """SELECT 'r' || s_suppkey AS repo, 'Base' AS key, 'https://c' || s_nationkey AS value, 'src/A.cs:2' AS source, 2 AS layer FROM supplier
      UNION ALL SELECT 'r' || s_suppkey, 'Mode', 'x' || s_suppkey, 'src/A.cs:3', 2 FROM supplier""",
)
def constants(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("class A {\n  public const string Base = \"https://c"), "s_nationkey", F.lit("\";\n  public string Mode { get; set; } = \"x"), "s_suppkey", F.lit("\";\n}"))
    return extract.constants(_supplier_files(spark, d, F.lit("src/A.cs"), text))


@query(
    "e18_homepage_index",
    """SELECT DISTINCT full_name AS owner, full_name AS repo, 'network' AS identity_class, homepage AS value, e.env, 'high' AS confidence
      FROM repos, (VALUES ('prod'), ('staging')) e(env) WHERE homepage IS NOT NULL""",
)
def homepage_index(spark: SparkSession, d: str) -> DataFrame:
    return identity.build_index(identity.homepage_identities(table(spark, d, "repos"), ["prod", "staging"])).drop("norm")


# Identity and projection


def _index(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    env = F.when(F.col("s_suppkey") % 3 == 0, "prod").when(F.col("s_suppkey") % 3 == 2, "staging")
    url = F.concat(F.lit("https://"), F.when(F.col("s_suppkey") % 2 == 0, "www.").otherwise(""), F.lit("H"), "s_suppkey", F.lit(".example.com"), F.when(F.col("s_suppkey") % 2 == 1, "/").otherwise(""))
    name = F.concat(F.lit("r"), "s_suppkey")
    return identity.build_index(s.select(name.alias("owner"), name.alias("repo"), F.lit("network").alias("identity_class"), url.alias("value"), env.alias("env")))


def _refs(spark: SparkSession, d: str) -> DataFrame:
    obs = projection.observations(spark, d)
    host = F.concat(F.lit("H"), "dst_key", F.lit(".example.com"))
    value = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("https://"), host, F.lit("/"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("http://"), host, F.lit(":81/api?x=1"))).otherwise(F.concat(F.lit("https://u"), host))
    return obs.select(
        F.concat_ws("-", "o_orderkey", "ln", "src_key", "dst_key", "flag").alias("ref_id"), F.concat(F.lit("r"), "src_key").alias("repo"), value.alias("value"), "env",
        (F.col("flag") == "A").alias("injected"), F.col("confidence"),
    ).dropDuplicates(["ref_id"])


_REF = f"""{OBSERVATION}, idx AS (SELECT 'r' || s_suppkey AS owner, 'https://' || CASE WHEN s_suppkey % 2 = 0 THEN 'www.' ELSE '' END || 'H' || s_suppkey || '.example.com' ||
    CASE WHEN s_suppkey % 2 = 1 THEN '/' ELSE '' END AS value, 'h' || s_suppkey || '.example.com/' AS norm,
    CASE s_suppkey % 3 WHEN 0 THEN 'prod' WHEN 2 THEN 'staging' END AS env FROM supplier),
  ref AS (SELECT DISTINCT o_orderkey || '-' || ln || '-' || src_key || '-' || dst_key || '-' || flag AS ref_id, env, src_key, flag, confidence,
    CASE o_orderkey % 3 WHEN 0 THEN 'https://H' || dst_key || '.example.com/' WHEN 1 THEN 'http://H' || dst_key || '.example.com:81/api?x=1' ELSE 'https://uH' || dst_key || '.example.com' END AS value,
    CASE o_orderkey % 3 WHEN 0 THEN 'h' || dst_key || '.example.com/' WHEN 1 THEN 'h' || dst_key || '.example.com/api' ELSE 'uh' || dst_key || '.example.com/' END AS norm,
    CASE WHEN o_orderkey % 3 < 2 THEN 'h' || dst_key || '.example.com/' ELSE 'uh' || dst_key || '.example.com/' END AS host_norm FROM observation),
  hit AS (SELECT ref_id, owner, ref.env AS ref_env, idx.env AS id_env, 0 AS tier FROM ref JOIN idx ON ref.value = idx.value
    UNION ALL SELECT ref_id, owner, ref.env, idx.env, 1 FROM ref JOIN idx ON ref.norm = idx.norm
    UNION ALL SELECT ref_id, owner, ref.env, idx.env, 3 FROM ref JOIN idx ON host_norm = idx.norm),
  ranked AS (SELECT *, CASE WHEN ref_env = id_env THEN 0 WHEN id_env IS NULL THEN 1 ELSE 2 END AS env_tier FROM hit),
  best AS (SELECT DISTINCT ref_id, owner, tier, env_tier FROM (SELECT *, rank() OVER (PARTITION BY ref_id ORDER BY tier, env_tier) AS r FROM ranked) WHERE r = 1)"""


@query("j1_projection", f"WITH {_REF} SELECT ref_id, owner, owner AS repo, tier, env_tier, 'high' AS confidence FROM best")
def projected(spark: SparkSession, d: str) -> DataFrame:
    return identity.project(_refs(spark, d), _index(spark, d))


@query("j1_projection_strict", f"WITH {_REF} SELECT ref_id, owner, owner AS repo, tier, env_tier, 'high' AS confidence FROM best WHERE env_tier < 2")
def projected_strict(spark: SparkSession, d: str) -> DataFrame:
    return identity.project(_refs(spark, d), _index(spark, d), strict_env=True)


@query("e19_unmatched", f"WITH {_REF} SELECT ref_id, value, env, 'no-match' AS reason FROM ref WHERE ref_id NOT IN (SELECT ref_id FROM best)")
def unmatched(spark: SparkSession, d: str) -> DataFrame:
    refs = _refs(spark, d)
    return identity.unmatched(refs.select("ref_id", "value", "env"), identity.project(refs, _index(spark, d)))


@query(
    "g5_candidate_edges",
    f"""WITH {_REF}, h AS (SELECT * FROM best JOIN ref USING (ref_id) WHERE flag = 'A' OR tier < 2)
      SELECT 'r' || src_key AS from_id, owner AS to_id, env, CASE WHEN flag = 'A' THEN 'injected' ELSE 'declared' END AS provenance, confidence, count(*) AS n FROM h GROUP BY ALL""",
)
def candidate_edges(spark: SparkSession, d: str) -> DataFrame:
    none = spark.createDataFrame([], "repo string, env string, sha string")
    edges = build.candidate_edges(_refs(spark, d), _index(spark, d), none)
    return edges.groupBy("from_id", "to_id", "env", "provenance", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j8_services",
    """SELECT 'h' || s_suppkey AS service, CASE WHEN s_suppkey % 2 = 1 OR s_suppkey % 2 = 0 THEN 'r' || s_suppkey END AS repo, CAST(NULL AS VARCHAR) AS reason FROM supplier
      UNION ALL SELECT 'gone' || n_nationkey, NULL, 'no-match' FROM nation""",
)
def services(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "supplier").select(F.concat(F.lit("h"), "s_suppkey").alias("service"))
    gone = table(spark, d, "nation").select(F.concat(F.lit("gone"), "n_nationkey").alias("service"))
    return identity.resolve_services(names.unionByName(gone), _index(spark, d))


@query("j20_grounded", "SELECT 'p' || s_suppkey AS ref_id, 'r' || s_suppkey AS owner FROM supplier WHERE s_suppkey % 4 <> 0")
def grounded(spark: SparkSession, d: str) -> DataFrame:
    value = F.concat(F.when(F.col("s_suppkey") % 4 == 0, "https://nowhere").otherwise("http://h"), "s_suppkey", F.lit(".example.com/deep/path"))
    return identity.grounded(table(spark, d, "supplier").select(F.concat(F.lit("p"), "s_suppkey").alias("ref_id"), value.alias("value"), F.lit("prod").alias("env")), _index(spark, d))


# Resolution


_NAME_KEY = "lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g'))"


@query(
    "a6_best_scoped",
    f"""WITH v AS (SELECT DISTINCT ownerid, {_NAME_KEY} AS k, var_row, value, version, scope.environment AS env, scope.role AS role FROM variables WHERE name IS NOT NULL AND ownerid IS NOT NULL),
      r AS (SELECT *, coalesce(len(env), 0) > 0 AS e, coalesce(len(role), 0) > 0 AS o FROM v),
      s AS (SELECT *, CASE WHEN NOT e OR list_contains(list_transform(env, lambda x: lower(trim(x))), 'environments-2') THEN 2 WHEN NOT e AND NOT o THEN 1 ELSE 0 END AS g,
        CASE WHEN e THEN 4 WHEN o THEN 3 ELSE 0 END AS p, e::int + o::int AS n FROM r),
      t AS (SELECT *, rank() OVER (PARTITION BY ownerid, k ORDER BY g DESC, p DESC, n DESC) AS rk FROM s)
      SELECT ownerid, k, var_row, value, count(*) OVER (PARTITION BY ownerid, k) > 1 AS ambiguous FROM t WHERE rk = 1""",
)
def best_scoped(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "variables").filter(F.col("name").isNotNull() & F.col("ownerid").isNotNull())
    v = v.select("ownerid", F.lower(F.regexp_replace("name", "[^A-Za-z0-9]", "")).alias("k"), "var_row", "value", "version", "scope").distinct()
    return resolve.best_scoped(v, ["ownerid", "k"], "Environments-2").select("ownerid", "k", "var_row", "value", "ambiguous")


@query(
    "j4_store_values",
    """WITH t AS (SELECT DISTINCT ownerid, lower(trim(name, ' ')) AS n FROM variables WHERE name IS NOT NULL AND ownerid IS NOT NULL),
      s AS (SELECT ownerid, lower(trim(name, ' ')) AS n, value, coalesce(issensitive, false) AS is_secret, var_row, version, list_transform(list_filter(coalesce(scope.environment, []), lambda e: e IS NOT NULL), lambda e: lower(e)) AS envs
        FROM variables WHERE name IS NOT NULL),
      f AS (SELECT t.ownerid || '/' || t.n AS ref_id, s.*, row_number() OVER (PARTITION BY t.ownerid, t.n ORDER BY version NULLS FIRST, var_row) AS r
        FROM t JOIN s ON t.ownerid = s.ownerid AND t.n = s.n WHERE len(envs) = 0 OR list_contains(envs, 'environments-1'))
      SELECT ref_id, CASE WHEN NOT is_secret THEN value END AS value, is_secret FROM f WHERE r = 1""",
)
def store_values(spark: SparkSession, d: str) -> DataFrame:
    """Variables of each project as its store: the first entry whose environments fit or are absent, by version and row."""
    v = table(spark, d, "variables").filter(F.col("name").isNotNull() & F.col("ownerid").isNotNull())
    name = F.lower(F.trim("name"))
    tokens = v.select(F.concat("ownerid", F.lit("/"), name).alias("ref_id"), F.col("ownerid").alias("owner"), name.alias("name"), F.lit("Environments-1").alias("env")).distinct()
    store = v.select(
        F.col("ownerid").alias("owner"), name.alias("key"), "value", F.col("scope.environment").alias("env"), F.coalesce("issensitive", F.lit(False)).alias("is_secret"),
        F.col("version").alias("store_ord"), F.col("var_row").alias("ord"),
    )
    return resolve.from_store(tokens, store)


@query(
    "j5_ladder",
    """SELECT 't' || s_suppkey AS ref_id, CASE WHEN s_suppkey % 2 = 0 THEN 'static' || s_suppkey WHEN s_suppkey % 3 = 0 THEN '<secret>' WHEN s_suppkey % 5 = 0 THEN 'log' || s_suppkey ELSE '<unresolved>' END AS value,
      CASE WHEN s_suppkey % 2 = 0 THEN 1 WHEN s_suppkey % 3 = 0 THEN 2 WHEN s_suppkey % 5 = 0 THEN 4 ELSE 5 END AS rung, s_suppkey % 2 = 0 OR (s_suppkey % 3 <> 0 AND s_suppkey % 5 = 0) AS resolved FROM supplier""",
)
def ladder(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("t"), "s_suppkey").alias("ref_id"))
    rung = lambda n, label: t.filter(F.col("s_suppkey") % n == 0).select("ref_id", F.concat(F.lit(label), "s_suppkey").alias("value"))
    hidden = t.filter(F.col("s_suppkey") % 3 == 0).select("ref_id", F.lit(None).cast("string").alias("value"), F.lit(True).alias("is_secret"))
    return resolve.ladder(t, [rung(2, "static"), hidden, rung(1 << 30, "p").limit(0), rung(5, "log")])


@query(
    "j7_deployed_refs",
    """WITH x AS (SELECT DISTINCT trim(projectid, ' ') AS repo, trim(environmentid, ' ') AS env, vcscommitnumber AS sha, loaded_at, id FROM deployments
        WHERE projectid IS NOT NULL AND environmentid IS NOT NULL AND trim(vcscommitnumber, ' ') <> '')
      SELECT repo, env, arg_min(sha, (loaded_at, id, sha)) AS sha FROM x GROUP BY repo, env""",
)
def deployed(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "deployments").filter(F.col("projectid").isNotNull() & F.col("environmentid").isNotNull())
    x = x.select(F.trim("projectid").alias("repo"), F.trim("environmentid").alias("env"), F.col("vcscommitnumber").alias("sha"), F.struct("loaded_at", "id").alias("ord"))
    return resolve.deployed_refs(x).select("repo", "env", "sha")


@query(
    "j3_declarations",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL),
      u AS (SELECT doc_id, n, unnest(regexp_extract_all(line, '#\{([a-zA-Z][a-zA-Z0-9_.-]*)\}', 1)) AS name FROM l)
      SELECT CAST(doc_id AS VARCHAR) AS repo, name, 'README.md:' || min(n) AS declared_in FROM u GROUP BY ALL""",
)
def first_declarations(spark: SparkSession, d: str) -> DataFrame:
    return extract.first_declarations(extract.token_uses(extract.lines(_document_files(spark, d))))


@query(
    "a12_winning_facts",
    """WITH f AS (SELECT 'r' || l_suppkey AS repo, 'k' || (l_partkey % 20) AS key, 'v' || l_partkey AS value, 'f' || l_partkey || '.json' AS source, 1 + l_linenumber % 2 AS layer,
        CASE WHEN l_returnflag = 'A' THEN 'prod.eu' WHEN l_returnflag = 'N' THEN 'prod' END AS condition FROM lineitem),
      r AS (SELECT *, row_number() OVER (PARTITION BY repo, key ORDER BY layer DESC, coalesce(length(condition) - length(replace(condition, '.', '')), 0) DESC, source, value, condition NULLS FIRST) AS n FROM f)
      SELECT repo, key, value, source, condition, layer FROM r WHERE n = 1""",
)
def winning_facts(spark: SparkSession, d: str) -> DataFrame:
    return resolve.winning_facts(_facts(spark, d))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("r"), "l_suppkey").alias("repo"), F.concat(F.lit("k"), F.col("l_partkey") % 20).alias("key"), F.concat(F.lit("v"), "l_partkey").alias("value"),
        F.concat(F.lit("f"), "l_partkey", F.lit(".json")).alias("source"), (1 + F.col("l_linenumber") % 2).cast("int").alias("layer"),
        F.when(F.col("l_returnflag") == "A", "prod.eu").when(F.col("l_returnflag") == "N", "prod").alias("condition"),
    )


@query(
    "a13_truncated_facts",
    """WITH f AS (SELECT 'r' || l_suppkey AS repo, 'k' || (l_partkey % 20) AS key, 'v' || l_partkey AS value FROM lineitem),
      b AS (SELECT repo, sum(octet_length(encode(value))) > 10000000 AS truncated FROM f GROUP BY repo),
      k AS (SELECT repo, key, count(*) AS n, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, key) AS r, count(*) OVER (PARTITION BY repo) AS c FROM f GROUP BY repo, key)
      SELECT repo, key, n, truncated FROM k JOIN b USING (repo) WHERE NOT truncated OR r <= c // 2""",
)
def truncated_facts(spark: SparkSession, d: str) -> DataFrame:
    return resolve.truncated_facts(_facts(spark, d)).groupBy("repo", "key", "truncated").agg(F.count(F.lit(1)).alias("n"))


# Attribution


_PATHS = "CASE s_suppkey % 4 WHEN 0 THEN '.github/workflows/ci.yml' WHEN 1 THEN 'Jenkinsfile' WHEN 2 THEN 'bitbucket-pipelines.yml' ELSE 'src/x.txt' END"


def _ci_files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    path = F.when(k == 0, ".github/workflows/ci.yml").when(k == 1, "Jenkinsfile").when(k == 2, "bitbucket-pipelines.yml").otherwise("src/x.txt")
    step = F.when(F.col("s_nationkey") % 2 == 0, "run: kubectl apply -f x").otherwise("uses: OctopusDeploy/deploy-release-action@v3")
    return _supplier_files(spark, d, path, step)


@query("pred9_intrinsic", "SELECT 'r' || s_suppkey AS repo, CASE s_suppkey % 4 WHEN 0 THEN 'github-actions' WHEN 1 THEN 'jenkins' ELSE 'bitbucket-pipelines' END AS provider FROM supplier WHERE s_suppkey % 4 < 3")
def intrinsic(spark: SparkSession, d: str) -> DataFrame:
    return attribution.intrinsic(_ci_files(spark, d))


@query(
    "e10_deploy_steps",
    f"""SELECT 'r' || s_suppkey AS repo, CASE WHEN s_nationkey % 2 = 0 THEN 'kubernetes' ELSE 'octopus' END AS provider,
      CASE WHEN s_nationkey % 2 = 0 THEN 'kubectl apply' ELSE 'OctopusDeploy/deploy-release-action' END AS pattern, {_PATHS} AS path FROM supplier WHERE s_suppkey % 4 < 3""",
)
def deploy_steps(spark: SparkSession, d: str) -> DataFrame:
    return attribution.deploy_steps(_ci_files(spark, d))


@query(
    "e16_profiles",
    """WITH p AS (SELECT 'r' || s_suppkey AS repo, CASE s_suppkey % 4 WHEN 0 THEN 'github-actions' WHEN 1 THEN 'jenkins' ELSE 'bitbucket-pipelines' END AS provider, 'build' AS roles FROM supplier WHERE s_suppkey % 4 < 3
        UNION ALL SELECT 'r' || s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 'kubernetes' ELSE 'octopus' END, 'deploy' FROM supplier WHERE s_suppkey % 4 < 3
        UNION ALL SELECT 'r' || s_suppkey, 'teamcity', CASE WHEN s_suppkey % 4 < 3 THEN 'build' ELSE 'build,deploy' END FROM supplier WHERE s_suppkey % 2 = 1)
      SELECT *, CASE provider WHEN 'github-actions' THEN 'github-environments' WHEN 'octopus' THEN 'octopus-environments' WHEN 'teamcity' THEN 'teamcity-parameters'
        WHEN 'bitbucket-pipelines' THEN 'bitbucket-deployments' ELSE '' END AS scoping FROM p""",
)
def profiles(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    repos = s.select(F.concat(F.lit("r"), "s_suppkey").alias("repo"))
    outer = s.filter(F.col("s_suppkey") % 2 == 1).select(F.concat(F.lit("r"), "s_suppkey").alias("repo"), F.lit("teamcity").alias("provider"), F.array(F.lit("build"), F.lit("deploy")).alias("roles"))
    out = attribution.profiles(_ci_files(spark, d), outer, repos)
    return out.select("repo", "provider", F.array_join("roles", ",").alias("roles"), "scoping")


@query("a4_profile_confidence", "SELECT 'r' || s_suppkey AS repo, CASE s_suppkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence FROM supplier")
def profile_confidence(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    name = F.concat(F.lit("r"), "s_suppkey").alias("repo")
    k = F.col("s_suppkey") % 4
    part = lambda label, cond: s.filter(cond).select(name, F.lit(label).alias("confidence"))
    rows = part("high", k.isin(1, 2, 3)).unionByName(part("medium", k == 2)).unionByName(part("low", k == 3))
    return attribution.profile_confidence(rows, s.select(name))


def _roots(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "vcs_roots").select(F.col("vr_row").cast("string").alias("root_id"), F.explode("properties.property").alias("p"))
    return p.filter(F.col("p.name") == "url").select("root_id", F.col("p.value").alias("url"))


_GIT = r"""lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(url), '/+$', ''), '\.git$', ''), '^(?i:https?://|ssh://)(?:[^@/]*@)?|^git@', ''), '^([^/:]+):\d+/', '\1/'), '^([^/:]+):', '\1/'))"""


@query("e9_git_urls", f"WITH u AS (SELECT vr_row, unnest(properties.property) AS p FROM vcs_roots), x AS (SELECT CAST(vr_row AS VARCHAR) AS root_id, p.value AS url FROM u WHERE p.name = 'url') SELECT root_id, {_GIT} AS norm FROM x WHERE url IS NOT NULL")
def git_urls(spark: SparkSession, d: str) -> DataFrame:
    return _roots(spark, d).filter(F.col("url").isNotNull()).select("root_id", U.normalise_git_url(F.col("url")).alias("norm"))


@query(
    "j17_bindings",
    f"""WITH u AS (SELECT vr_row, name, unnest(properties.property) AS p FROM vcs_roots), x AS (SELECT CAST(vr_row AS VARCHAR) AS root_id, p.value AS url FROM u WHERE p.name = 'url'),
      r AS (SELECT DISTINCT 'millrace/' || name AS repo FROM vcs_roots WHERE name IS NOT NULL)
      SELECT DISTINCT root_id, repo FROM x JOIN r ON ends_with('/' || {_GIT}, '/' || lower(repo)) AND {_GIT} <> lower(repo) WHERE url IS NOT NULL""",
)
def bindings(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "vcs_roots").filter(F.col("name").isNotNull()).select(F.concat(F.lit("millrace/"), "name").alias("full_name")).distinct()
    return attribution.repository_bindings(_roots(spark, d), names)


@query(
    "pred10_deploy_hints",
    """SELECT var_row, name, value FROM (SELECT DISTINCT var_row, name, value, coalesce(issensitive, false) AS is_secret FROM variables) WHERE value IS NOT NULL AND NOT is_secret
      AND len(list_intersect(regexp_split_to_array(lower(name), '[._ ]+'), ['host', 'url', 'endpoint', 'address', 'target', 'server'])) > 0""",
)
def deploy_hints(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "variables").select("var_row", "name", "value", F.coalesce("issensitive", F.lit(False)).alias("is_secret")).distinct()
    return attribution.deploy_hints(v).select("var_row", "name", "value")


# Judge and sinks


def _items(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        F.concat(F.lit("i"), k).alias("ref_id"), F.lit("unresolved-ref").alias("kind"), F.lit("1").alias("version"), F.concat(F.lit("r"), k).alias("from_id"), F.lit("prod").alias("env"),
        (k % 11 == 0).alias("is_secret"), F.lit("base.url").alias("key"), F.when(k % 7 == 0, "ask ops@example.com").otherwise("x").alias("value"),
        F.array(F.concat(F.lit("f:"), k), F.lit("a:1")).alias("locators"),
    )


@query(
    "k7_cache_keys",
    """SELECT 'i' || s_suppkey AS ref_id, sha256('{"goal":"UNRESOLVED_REF:i' || s_suppkey || '","locators":["a:1","f:' || s_suppkey || '"],"version":"1"}') AS cache_key FROM supplier""",
)
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    i = _items(spark, d)
    return i.select("ref_id", judge.cache_key(judge.goal_of(F.col("kind"), F.col("ref_id")), F.col("locators"), F.col("version")).alias("cache_key"))


@query(
    "l1_judged",
    """SELECT 'i' || s_suppkey AS ref_id, CASE WHEN s_suppkey % 11 = 0 THEN 'secret' WHEN s_suppkey % 7 = 0 THEN 'held-back' WHEN s_suppkey % 5 = 0 THEN 'unanswered' WHEN s_suppkey % 3 = 0 THEN 'malformed'
        WHEN s_suppkey % 2 = 0 THEN 'ungrounded' ELSE 'edge' END AS disposition,
      CASE WHEN s_suppkey % 11 <> 0 AND s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0 AND s_suppkey % 3 <> 0 AND s_suppkey % 2 = 1 THEN 'r' || s_suppkey END AS owner FROM supplier""",
)
def judged(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    n = F.substring("ref_id", 2, 20).cast("bigint")
    keys = items.select("ref_id", judge.cache_key(judge.goal_of(F.col("kind"), F.col("ref_id")), F.col("locators"), F.col("version")).alias("cache_key"))
    answers = keys.filter(n % 5 != 0).select(
        "cache_key", F.lit(None).cast("string").alias("decision"), F.lit(None).cast("string").alias("candidate"),
        F.concat(F.when(n % 2 == 0, "https://none").otherwise("https://h"), n, F.lit(".example.com/q")).alias("value"), F.lit(None).cast("string").alias("identity_class"),
        F.when(n % 3 != 0, "because").otherwise(" ").alias("reasoning"),
    )
    return judge.judged(items, answers, _index(spark, d)).select("ref_id", "disposition", "owner")


@query(
    "pred13_budget",
    """SELECT l_orderkey, count(*) <= 3 AS within FROM lineitem GROUP BY l_orderkey""",
)
def budget(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.concat(F.lit("l:"), "l_linenumber")).alias("e"))
    return e.select("l_orderkey", judge.within_budget(F.col("e"), files=3).alias("within"))


# Streaming


@query(
    "stream_hourly",
    """SELECT 'u' || (user_id % 50) AS from_id, event_type AS to_id, 'prod' AS env, date_trunc('hour', ts) AS window_start, count(*) AS sample_count FROM events GROUP BY ALL""",
)
def stream_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream of observed edges counted in hourly windows; the batches go to the shared folder."""
    from uuid import uuid4

    from depweft.runtime import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid4().hex}"
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    edges = stream.select(F.concat(F.lit("u"), F.col("user_id") % 50).alias("from_id"), F.col("event_type").alias("to_id"), F.lit("prod").alias("env"), F.col("ts").cast("timestamp").alias("at"))
    counted = observed.windowed_counts(edges, "1 hour", late="2 hours").select("from_id", "to_id", "env", "window_start", "sample_count")
    observed.into(counted, lambda b: b.write.mode("append").parquet(f"{root}/out"), f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query(
    "stream_last_seen",
    """SELECT 'u' || (user_id % 50) AS from_id, event_type AS to_id, 'prod' AS env, max(ts) AS last_seen, count(*) AS sample_count, max(ts) < TIMESTAMP '2024-01-15 00:00:00' AS stale FROM events GROUP BY ALL""",
)
def last_seen(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id") % 50).alias("from_id"), F.col("event_type").alias("to_id"), F.lit("prod").alias("env"), F.col("ts").cast("timestamp").alias("at"))
    return observed.stale(observed.last_seen(e), "2024-01-16 00:00:00", "24 hours")


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
