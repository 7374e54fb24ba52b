"""URLs, hosts, repository names and environment names as column expressions inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depweft.runtime import broadcast_if_small

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^:/?#]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"

#: Environment names and their aliases. Fixed values.
ENVIRONMENTS = {
    "prod": ["production", "prd", "live", "release"],
    "staging": ["stage", "stg", "uat", "pre-prod", "preprod"],
    "dev": ["development", "develop", "sandbox"],
    "test": ["testing", "qa", "quality"],
}


def host_of(url: Column) -> Column:
    """Lower-case host of a URL with a scheme; null otherwise."""
    host = F.lower(F.regexp_extract(url, _AUTHORITY, 1))
    return F.when(host != "", host)


def first_label(host: Column) -> Column:
    label = F.split_part(host, F.lit("."), F.lit(1))
    return F.when(label != "", label)


def normalise_url(url: Column) -> Column:
    """Host and path: no scheme, user, port, query or fragment; host in lower case without www. and end dot; path kept."""
    full = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(full, _AUTHORITY, 1)), r"\.+$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(full, _PATH, 1), "/+$", "")
    return F.concat(host, F.when(path == "", "/").otherwise(path))


def normalise_identity(value: Column, identity_class: Column) -> Column:
    """An identity by its class: URLs for networks, case kept for service tags, else lower case."""
    return (
        F.when(identity_class == "network", normalise_url(value))
        .when(identity_class == "service-tag", F.trim(value))
        .otherwise(F.lower(F.trim(value)))
    )


def normalise_lookup(value: Column) -> Column:
    return F.when(value.contains("://") | value.contains("."), normalise_url(value)).otherwise(F.lower(F.trim(value)))


def normalise_git_url(url: Column) -> Column:
    """host/org/repo of a clone address in any of the usual forms."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "/+$", ""), r"\.git$", "")
    bare = F.regexp_replace(bare, r"^(?i:https?://|ssh://)(?:[^@/]*@)?|^git@", "")
    bare = F.regexp_replace(bare, r"^([^/:]+):\d+/", "$1/")
    return F.lower(F.regexp_replace(bare, r"^([^/:]+):", "$1/"))


def full_name_parts(full_name: Column) -> Column:
    """provider:org/name as a struct; fields are null where the form does not fit."""
    pattern = r"^([^:]+):([^/]+)/(.+)$"
    part = lambda n: F.when(full_name.rlike(pattern), F.regexp_extract(full_name, pattern, n))
    return F.struct(part(1).alias("provider"), part(2).alias("org"), part(3).alias("name"))


def endpoint_url(scheme: Column, host: Column, port: Column, path: Column) -> Column:
    shown = F.when(port.isNull(), "").otherwise(F.concat(F.lit(":"), port.cast("string")))
    return F.concat(F.coalesce(scheme, F.lit("https")), F.lit("://"), host, shown, F.coalesce(path, F.lit("")))


def environment_aliases(spark: SparkSession, extra: dict[str, list[str]] | None = None) -> DataFrame:
    """``alias, env``: every canonical name and alias in lower case."""
    table = ENVIRONMENTS | (extra or {})
    rows = sorted({(a.lower(), env) for env, aliases in table.items() for a in (env, *aliases)})
    return spark.createDataFrame(rows, "alias string, env string")


def canonical_environment(df: DataFrame, column: str, aliases: DataFrame | None = None) -> DataFrame:
    """Adds ``env`` (canonical where an alias is known, else the value itself) and ``env_known``."""
    names = broadcast_if_small(aliases if aliases is not None else environment_aliases(df.sparkSession))
    joined = df.join(names.select(F.col("alias").alias("__alias"), F.col("env").alias("__env")), F.lower(F.trim(df[column])) == F.col("__alias"), "left")
    return joined.withColumn("env", F.coalesce("__env", F.col(column))).withColumn("env_known", F.col("__env").isNotNull()).drop("__alias", "__env")
