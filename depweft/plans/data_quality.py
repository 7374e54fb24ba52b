"""Queries of the general data problems 2 to 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweft.operators import moments, orphans, pivot, shred
from depweft.plans.moments_sql import found_sql, report_sql
from depweft.runtime import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    register = table(spark, d, "key_register")
    kind = lambda k: register.filter(F.col("kind") == k).select("id", "isdeleted", "loaded_at")
    parents = {
        "projectid": kind("project"),
        "releaseid": kind("release"),
        "environmentid": table(spark, d, "environments").select("id", "isdeleted", "loaded_at"),
    }
    return orphans.orphan_references(table(spark, d, "deployments"), parents)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select(
        "field", F.col("ref_id").alias("dep_id"), "status", F.date_format("loaded_at", "yyyy-MM").alias("load_month")
    )


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d), "deployments")


def _nested(spark: SparkSession, d: str) -> DataFrame:
    builds = shred.build_type_rows(table(spark, d, "build_types")).withColumn("tbl", F.lit("build_types"))
    roots = shred.vcs_root_rows(table(spark, d, "vcs_roots")).withColumn("tbl", F.lit("vcs_roots"))
    return builds.unionByName(roots)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _nested(spark, d).select("tbl", "row_key", "path", "parent_pos", "pos", shred.child().alias("child"))


def p3_properties(spark: SparkSession, d: str) -> DataFrame:
    leaf = F.col("leaves")
    return _nested(spark, d).filter(F.col("path").endswith("property")).select(
        "tbl", "row_key", "path", "parent_pos", "pos", leaf["name"].alias("name"), leaf["value"].alias("value"), leaf["raw_type"].alias("raw_type")
    )


def p3_steps(spark: SparkSession, d: str) -> DataFrame:
    return shred.flat_table(shred.build_type_rows(table(spark, d, "build_types")), shred.BUILD_TYPE_TABLES[3])


def p3_entries(spark: SparkSession, d: str) -> DataFrame:
    return shred.flat_table(shred.build_type_rows(table(spark, d, "build_types")), shred.BUILD_TYPE_TABLES[2])


def p3_levels(spark: SparkSession, d: str) -> DataFrame:
    leaves = [leaf for t in shred.BUILD_TYPE_TABLES for leaf in t.leaves]
    return shred.level_columns(table(spark, d, "build_types"), "bt_row", "payload", leaves, "buildType")


def _wide(spark: SparkSession, d: str, name: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    attrs = pivot.catalogue(table(spark, d, "param_catalog"), name)
    rows = (pivot.parameter_rows if name == "parameters" else pivot.variable_rows)(table(spark, d, name))
    return pivot.wide_table(rows, pivot.ENTITIES[name], attrs, pivot.ORDER), attrs


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for name in ("parameters", "variables"):
        wide, attrs = _wide(spark, d, name)
        cells = pivot.filled_cells(wide, pivot.ENTITIES[name], attrs)
        cells = cells if "env_id" in cells.columns else cells.withColumn("env_id", F.lit(""))
        parts.append(cells.select(F.lit(name).alias("tbl"), *pivot.ENTITY, "attr", "val"))
    return parts[0].unionByName(parts[1])


def _written(spark: SparkSession, d: str, name: str) -> DataFrame:
    wide, attrs = _wide(spark, d, name)
    return wide.select(*pivot.ENTITIES[name], *[pivot.written(F.col(f"`{a}`"), kind).alias(a) for a, kind in attrs])


def p4_parameters_typed(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d, "parameters")[0]


def p4_variables_typed(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d, "variables")[0]


def p4_parameters_wide(spark: SparkSession, d: str) -> DataFrame:
    """The wide table with its cells as text, for comparison."""
    return _written(spark, d, "parameters")


def p4_variables_wide(spark: SparkSession, d: str) -> DataFrame:
    return _written(spark, d, "variables")


def _stamped(spark: SparkSession, d: str) -> DataFrame:
    deployments = table(spark, d, "deployments")
    return moments.stamped(
        [
            (deployments, "deployments.created", "id", "created"),
            (deployments, "deployments.queuetime", "id", "queuetime"),
            (table(spark, d, "environments"), "environments.lastmodifiedon", "id", "lastmodifiedon"),
            (table(spark, d, "repos"), "repos.pushed_at", "full_name", "pushed_at"),
        ]
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    us = F.col("utc_us")
    return (
        moments.normalised(_stamped(spark, d), table(spark, d, "spaces"))
        .filter((F.col("status") == "ok") & (us >= 1_577_836_800_000_000) & (us < 1_893_456_000_000_000))
        .select("field", "rec_id", "utc_us")
    )


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    out = moments.normalised(_stamped(spark, d), table(spark, d, "spaces"))
    return out.groupBy("field", "spaceid", "status", F.coalesce("fmt", F.lit("none")).alias("fmt")).agg(
        F.count(F.lit(1)).alias("n")
    )


def p5_mixture(spark: SparkSession, d: str) -> DataFrame:
    read = moments.read_values(_stamped(spark, d), table(spark, d, "spaces"))
    return moments.format_posteriors(read).select(
        "field", "spaceid", "sig", "n", "choice", F.round("posterior", 9).alias("posterior")
    )


def queries() -> dict:
    return {
        "p2_found": p2_found,
        "p2_report": p2_report,
        "p3_found": p3_found,
        "p3_properties": p3_properties,
        "p3_steps": p3_steps,
        "p3_entries": p3_entries,
        "p3_levels": p3_levels,
        "p4_found": p4_found,
        "p4_parameters_typed": p4_parameters_typed,
        "p4_variables_typed": p4_variables_typed,
        "p4_parameters_wide": p4_parameters_wide,
        "p4_variables_wide": p4_variables_wide,
        "p5_found": p5_found,
        "p5_report": p5_report,
        "p5_mixture": p5_mixture,
    }


_SPACES = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^{_SPACES}+|{_SPACES}+$', '', 'g')"


_ORPHANS = f"""WITH k AS (SELECT CASE kind WHEN 'project' THEN 'projectid' ELSE 'releaseid' END AS field, nullif(lower({_trim("id")}), '') AS key, loaded_at AS t0, coalesce(isdeleted, false) AS gone
    FROM key_register WHERE kind IN ('project', 'release')
    UNION ALL SELECT 'environmentid', nullif(lower({_trim("id")}), ''), loaded_at, coalesce(isdeleted, false) FROM environments),
  s AS (SELECT field, key, t0, bool_and(gone) AS gone FROM k WHERE key IS NOT NULL GROUP BY ALL),
  f AS (SELECT {_trim("id")} AS id, loaded_at, nullif(lower({_trim("projectid")}), '') AS p, nullif(lower({_trim("releaseid")}), '') AS r, nullif(lower({_trim("environmentid")}), '') AS e,
    row_number() OVER (PARTITION BY {_trim("id")} ORDER BY loaded_at, p NULLS FIRST, r NULLS FIRST, e NULLS FIRST) AS n FROM deployments WHERE id IS NOT NULL AND loaded_at IS NOT NULL),
  d AS (SELECT 'projectid' AS field, id, loaded_at AS t0, p AS key FROM f WHERE n = 1 UNION ALL SELECT 'releaseid', id, loaded_at, r FROM f WHERE n = 1 UNION ALL SELECT 'environmentid', id, loaded_at, e FROM f WHERE n = 1),
  j AS (SELECT d.field, d.id, d.key, d.t0, count(s.key) AS states, min(s.t0) AS first_at, arg_max(s.gone, s.t0) FILTER (s.t0 <= d.t0) AS gone
    FROM d LEFT JOIN s ON d.field = s.field AND d.key = s.key WHERE d.key IS NOT NULL GROUP BY ALL),
  o AS (SELECT field, id, key, t0, CASE WHEN states = 0 THEN 'missing' WHEN first_at > t0 THEN 'later' WHEN gone THEN 'deleted' END AS status FROM j)"""



def _slots(v: str) -> str:
    """A JSON value as a list: its elements, itself if it is no list, nothing if it is null."""
    return f"CASE WHEN coalesce(json_type({v}), 'NULL') = 'NULL' THEN [] WHEN json_type({v}) = 'ARRAY' THEN json_extract({v}, '$[*]') ELSE [{v}] END"


_DECODED = """CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(ltrim(j->>'$', chr(65279) || e' \\t\\r\\n')) THEN CAST(ltrim(j->>'$', chr(65279) || e' \\t\\r\\n') AS JSON) END ELSE j END"""

OBJECTS = f"""WITH a0 AS (SELECT bt_row, CASE WHEN json_valid(ltrim(payload, chr(65279) || e' \\t\\r\\n')) THEN CAST(ltrim(payload, chr(65279) || e' \\t\\r\\n') AS JSON) END AS j FROM build_types),
  a1 AS (SELECT bt_row, {_DECODED} AS j FROM a0), a2 AS (SELECT bt_row, {_DECODED} AS j FROM a1),
  w AS (SELECT bt_row, CASE WHEN json_exists(j, '$.buildType') THEN json_extract(j, '$.buildType') ELSE j END AS j FROM a2),
  r AS (SELECT bt_row, unnest({_slots("j")}) AS j FROM w),
  top AS (SELECT bt_row, path, unnest(slots) AS o, generate_subscripts(slots, 1) AS pos FROM (SELECT bt_row, v.path, {_slots("v.v")} AS slots
    FROM (SELECT bt_row, unnest([{{'path': 'settings.property', 'v': json_extract(j, '$.settings.property')}}, {{'path': 'parameters.property', 'v': json_extract(j, '$.parameters.property')}},
      {{'path': 'vcs-root-entries.vcs-root-entry', 'v': json_extract(j, '$."vcs-root-entries"."vcs-root-entry"')}}, {{'path': 'steps.step', 'v': json_extract(j, '$.steps.step')}}]) AS v FROM r WHERE json_type(j) = 'OBJECT'))),
  inner_ AS (SELECT bt_row, step, unnest(slots) AS o, generate_subscripts(slots, 1) AS pos FROM (SELECT bt_row, pos AS step, {_slots("json_extract(o, '$.properties.property')")} AS slots FROM top WHERE path = 'steps.step')),
  o AS (SELECT bt_row, path, 0 AS parent_pos, pos, o FROM top WHERE json_type(o) = 'OBJECT' UNION ALL SELECT bt_row, 'steps.step.properties.property', step, pos, o FROM inner_ WHERE json_type(o) = 'OBJECT'),
  v AS (SELECT vr_row, unnest(properties.property) AS p, generate_subscripts(properties.property, 1) AS pos FROM vcs_roots)"""

_READ = """CASE kind
    WHEN 'text' THEN nullif(v, '')
    WHEN 'bool' THEN CASE WHEN lower(v) IN ('true', 'yes', 'y', 'on', '1', 'enabled', 't') THEN 'true' WHEN lower(v) IN ('false', 'no', 'n', 'off', '0', 'disabled', 'f') THEN 'false' END
    WHEN 'int' THEN CASE WHEN regexp_matches(i, '^[+-]?[0-9]+(\\.0*)?$') THEN CAST(TRY_CAST(regexp_replace(i, '\\.0*$', '') AS BIGINT) AS VARCHAR) END
    WHEN 'decimal' THEN CASE WHEN regexp_matches(m, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]{1,2})?$') THEN CAST(CAST(round(TRY_CAST(m AS DECIMAL(38,12)), 2) AS DECIMAL(38,2)) AS VARCHAR) END
    ELSE strftime(coalesce(TRY_CAST(regexp_extract(v, '^([0-9]{4}-[0-9]{2}-[0-9]{2})(?:[T ][0-9].*)?$', 1) AS DATE), CAST(try_strptime(v, ['%Y/%m/%d', '%d.%m.%Y', '%d %b %Y']) AS DATE),
      CASE WHEN length(v) = 8 THEN CAST(try_strptime(v, '%Y%m%d') AS DATE) END), '%Y-%m-%d') END"""

_CELLS = f"""WITH x AS (SELECT 'parameters' AS tbl, buildtypeid AS entity_id, '' AS env_id, name, value, version, loaded_at, param_row AS n FROM parameters
    UNION ALL SELECT 'variables', ownerid, unnest(CASE WHEN len(list_filter(scope.environment, lambda e: e IS NOT NULL)) > 0 THEN list_distinct(scope.environment) ELSE [''] END), name, value, version, loaded_at, var_row FROM variables),
  c AS (SELECT attr, kind, used_in, lower(regexp_replace(attr, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')) AS k FROM param_catalog),
  w AS (SELECT tbl, entity_id, env_id, attr, kind, value, row_number() OVER (PARTITION BY tbl, entity_id, env_id, attr ORDER BY version DESC NULLS LAST, loaded_at DESC NULLS LAST, n DESC, value DESC NULLS LAST) AS r
    FROM x JOIN c ON used_in = tbl AND lower(regexp_replace(name, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')) = k WHERE entity_id IS NOT NULL),
  t AS (SELECT *, {_trim("value")} AS v FROM w WHERE r = 1),
  p AS (SELECT *, regexp_replace(regexp_replace(v, '([0-9])(?:[,_]|{_SPACES})([0-9])', '\\1\\2', 'g'), '([0-9])(?:[,_]|{_SPACES})([0-9])', '\\1\\2', 'g') AS i, replace(v, ',', '.') AS m FROM t)
  SELECT tbl, entity_id, env_id, attr, {_READ} AS val FROM p"""


#: The catalogue's columns. Fixed values.
_WIDE = {
    "parameters": [
        "build.timeout.minutes", "build.retry.count", "agent.min.memory.mb", "artifact.keep.days", "build.clean.checkout", "tests.run.parallel", "publish.enabled", "notify.on.failure",
        "coverage.threshold", "flaky.test.ratio", "licence.expires", "toolchain.frozen.until", "artifact.channel", "solution.file", "image.base.name", "owner.team",
    ],
    "variables": [
        "Gateway.BaseAddress", "Cache.Ttl.Seconds", "Queue.Max.Depth", "Http.Port", "Feature.NewLogin", "Audit.Enabled", "Sampling.Rate", "Price.Margin", "Certificate.ValidUntil",
        "Search.Host", "Log.Level", "Upload.Limit.Mb",
    ],
}


def _wide_sql(name: str) -> str:
    entity = ", ".join(pivot.ENTITIES[name])
    columns = ", ".join(f"""max(CASE WHEN attr = '{a}' THEN val END) AS "{a}" """ for a in _WIDE[name])
    return f"SELECT {entity}, {columns} FROM ({_CELLS}) WHERE tbl = '{name}' GROUP BY {entity}"


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": found_sql(_SPACES, _trim("value")),
        "p5_report": report_sql(_SPACES, _trim("value")),
        "p4_parameters_wide": _wide_sql("parameters"),
        "p4_variables_wide": _wide_sql("variables"),
        "p2_found": f"{_ORPHANS} SELECT field, id AS dep_id, status, strftime(t0, '%Y-%m') AS load_month FROM o WHERE status IS NOT NULL",
        "p2_report": f"""{_ORPHANS} SELECT 'deployments' AS tbl, field, strftime(t0, '%Y-%m') AS load_month, status, count(*) AS n_refs, count(DISTINCT key) AS n_keys
          FROM o WHERE status IS NOT NULL GROUP BY ALL""",
        "p3_found": f"""{OBJECTS} SELECT 'build_types' AS tbl, bt_row AS row_key, path, CAST(parent_pos AS BIGINT) AS parent_pos, pos, coalesce(CASE WHEN path IN ('vcs-root-entries.vcs-root-entry', 'steps.step') THEN o->>'id' ELSE o->>'name' END, '') AS child FROM o
          UNION ALL SELECT 'vcs_roots', vr_row, 'properties.property', 0, pos, coalesce(p.name, '') FROM v WHERE p IS NOT NULL""",
        "p3_properties": f"""{OBJECTS} SELECT 'build_types' AS tbl, bt_row AS row_key, path, CAST(parent_pos AS BIGINT) AS parent_pos, pos, o->>'name' AS name, o->>'value' AS value, o->'type'->>'rawValue' AS raw_type FROM o WHERE path LIKE '%property'
          UNION ALL SELECT 'vcs_roots', vr_row, 'properties.property', 0, pos, p.name, p.value, p.type.rawvalue FROM v WHERE p IS NOT NULL""",
        "p3_steps": f"""{OBJECTS} SELECT bt_row AS row_key, CAST(0 AS BIGINT) AS parent_pos, pos, o->>'id' AS id, o->>'name' AS name, o->>'type' AS type FROM o WHERE path = 'steps.step'""",
        "p3_entries": f"""{OBJECTS} SELECT bt_row AS row_key, CAST(0 AS BIGINT) AS parent_pos, pos, o->>'id' AS id, o->>'checkout-rules' AS checkout_rules, o->'vcs-root'->>'id' AS root_id, o->'vcs-root'->>'name' AS root_name
          FROM o WHERE path = 'vcs-root-entries.vcs-root-entry'""",
        "p4_found": f"SELECT * FROM ({_CELLS}) WHERE val IS NOT NULL",
    }
