"""The identity index and the projection join: values of references looked up among identities.

The look-up is a cascade: exact value, normalised value, exact host, normalised host. Each tier is an equi-join; their
candidates are united with the tier as a number and the lowest tier of each reference wins, inside it the candidates of
the reference's environment, else those of any environment, else all others. No condition joins with OR. The index is
broadcast after a count, else values that many references name, such as a gateway's host, are salted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depweft.functions.ranks import class_confidence
from depweft.functions.urls import host_of, normalise_identity, normalise_lookup
from depweft.runtime import hot_keys, salted_join, small


def build_index(identities: DataFrame) -> DataFrame:
    """Adds ``norm`` and ``confidence`` to ``owner, repo, identity_class, value, env`` and keeps distinct rows."""
    return (
        identities.filter(F.col("value").isNotNull() & (F.trim("value") != ""))
        .withColumn("norm", normalise_identity(F.col("value"), F.col("identity_class")))
        .withColumn("confidence", class_confidence(F.col("identity_class")))
        .distinct()
    )


def homepage_identities(repos: DataFrame, envs: list[str]) -> DataFrame:
    """One network identity per repository homepage and environment; the environments are a literal list."""
    return repos.filter(F.col("homepage").isNotNull()).select(
        F.col("full_name").alias("owner"), F.col("full_name").alias("repo"), F.lit("network").alias("identity_class"),
        F.col("homepage").alias("value"), F.explode(F.array(*map(F.lit, envs))).alias("env"),
    )


def project(refs: DataFrame, index: DataFrame, host_fallback: bool = True, strict_env: bool = False) -> DataFrame:
    """``refs`` (``ref_id, value, env``) joined to the index: ``ref_id, owner, repo, tier, env_tier, confidence``.

    Tiers: 0 exact, 1 normalised, 2 host exact, 3 host normalised. Environment tiers: 0 equal, 1 an identity without
    environment, 2 another environment (left out if ``strict_env``). Several rows of a reference are an ambiguity.
    """
    keys = [(0, F.col("value"), "value"), (1, normalise_lookup(F.col("value")), "norm")]
    if host_fallback:
        host = host_of(F.col("value"))
        keys += [(2, host, "value"), (3, normalise_lookup(host), "norm")]
    probe = F.array(*[F.struct(F.lit(t).alias("tier"), k.alias("key"), F.lit(on).alias("on")) for t, k, on in keys])
    probes = refs.select("ref_id", F.col("env").alias("ref_env"), F.explode(probe).alias("p")).select("ref_id", "ref_env", "p.*").filter(F.col("key").isNotNull())
    sides = index.select(
        "owner", "repo", "confidence", F.col("env").alias("id_env"),
        F.explode(F.array(F.struct(F.lit("value").alias("on"), F.col("value").alias("key")), F.struct(F.lit("norm").alias("on"), F.col("norm").alias("key")))).alias("k"),
    ).select("owner", "repo", "confidence", "id_env", F.col("k.on").alias("on"), F.col("k.key").alias("key"))
    env_tier = F.when(F.lower("ref_env") == F.lower("id_env"), 0).when(F.col("id_env").isNull(), 1).otherwise(2)
    sides = sides.distinct()
    if small(sides):
        hits = probes.join(F.broadcast(sides), ["on", "key"])
    else:
        hot = hot_keys(probes.groupBy("on", "key").agg(F.count(F.lit(1)).alias("__n")), ["on", "key"])
        hits = salted_join(probes, sides, ["on", "key"], hot, ["ref_id"])
    hits = hits.withColumn("env_tier", env_tier)
    best = Window.partitionBy("ref_id")
    hits = hits.withColumn("__t", F.min("tier").over(best)).filter(F.col("tier") == F.col("__t"))
    hits = hits.withColumn("__e", F.min("env_tier").over(best)).filter(F.col("env_tier") == F.col("__e"))
    hits = hits.filter(F.col("env_tier") < 2) if strict_env else hits
    return hits.select("ref_id", "owner", "repo", "tier", "env_tier", "confidence").distinct()


def unmatched(refs: DataFrame, hits: DataFrame) -> DataFrame:
    """References without a candidate, with the reason."""
    return refs.join(hits.select("ref_id").distinct(), "ref_id", "left_anti").withColumn("reason", F.lit("no-match"))


def resolve_services(services: DataFrame, index: DataFrame) -> DataFrame:
    """Service names to repositories: ``service, repo, reason``.

    A unique service tag wins; else network identities whose host is the name or begins with 'name.'. The latter is an
    equi-join, since every host is expanded to its prefixes of whole labels. Several repositories are ambiguous.
    """
    tags = index.filter(F.col("identity_class") == "service-tag").select(F.col("norm").alias("service"), "repo", F.lit(0).alias("tier"))
    labels = F.split(F.split_part("norm", F.lit("/"), F.lit(1)), r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, 1, n), "."))
    hosts = index.filter(F.col("identity_class") == "network").select(F.explode(prefixes).alias("service"), "repo", F.lit(1).alias("tier"))
    by_tier = services.select("service").distinct().join(tags.unionByName(hosts).distinct(), "service", "left")
    counted = by_tier.groupBy("service", "tier").agg(F.countDistinct("repo").alias("n"), F.min("repo").alias("repo"))
    usable = counted.filter(F.col("tier").isNull() | (F.col("tier") == 1) | (F.col("n") == 1))
    first = usable.groupBy("service").agg(F.min(F.struct("tier", "n", "repo")).alias("m"))
    reason = F.when(F.col("m.tier").isNull(), "no-match").when(F.col("m.n") > 1, "ambiguous")
    return first.select("service", F.when(reason.isNull(), F.col("m.repo")).alias("repo"), reason.alias("reason"))


def grounded(proposals: DataFrame, index: DataFrame) -> DataFrame:
    """Proposed values that the index knows, with the first owner: ``ref_id, owner``."""
    hits = project(proposals, index)
    return hits.groupBy("ref_id").agg(F.min("owner").alias("owner"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Concatenation of extractors' or capabilities' results by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
