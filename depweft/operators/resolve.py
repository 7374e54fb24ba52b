"""Tokens resolved per environment: declarations, variable stores, scopes and the ladder of sources.

'First match' always goes by explicit ordinals, kept since the file or list was read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweft.functions.tokens import substitute

UNREADABLE, EXHAUSTED = "<secret>", "<unresolved>"
RUNGS = ("static", "store", "preview", "deploy-log")


def declarations(tokens: DataFrame, decls: DataFrame) -> DataFrame:
    """Each token's first declaration and the places of all of them: ``repo, name, first_in, places``."""
    joined = tokens.select("repo", "name").distinct().join(decls, ["repo", "name"])
    return joined.groupBy("repo", "name").agg(
        F.min(F.struct("ord", "declared_in")).getField("declared_in").alias("first_in"),
        F.array_sort(F.collect_set("declared_in")).alias("places"),
    )


def from_store(tokens: DataFrame, store: DataFrame) -> DataFrame:
    """First entry in list order whose key is the token (any case) and whose environment fits or is absent.

    ``tokens``: ref_id, name, env. ``store``: key, value, env (a name, or an array of them), is_secret, store_ord, ord. An
    entry without environment that stands before a fitting one wins, as in list order. A secret stops the search without
    a value. With an ``owner`` on both sides only the owner's own store counts. Of entries that agree in key, owner and
    environment only the first can win, so each side is folded before the join: a key that every project has stays small.
    """
    by = ["__k", *(["owner"] if "owner" in tokens.columns and "owner" in store.columns else [])]
    envs = F.col("env") if dict(store.dtypes)["env"].startswith("array") else F.when(F.col("env").isNotNull(), F.array("env"))
    each = store.select(*by[1:], F.lower("key").alias("__k"), F.explode_outer(F.transform(F.filter(envs, lambda e: e.isNotNull()), lambda e: F.lower(e))).alias("__env"), "value", "is_secret", "store_ord", "ord")
    first = each.groupBy(*by, "__env").agg(F.min(F.struct("store_ord", "ord", "value", "is_secret")).alias("m"))
    asked = tokens.withColumn("__k", F.lower("name"))
    fitting = asked.withColumn("__env", F.lower("env")).join(first, [*by, "__env"]).select("ref_id", "m")
    unscoped = asked.join(first.filter(F.col("__env").isNull()).drop("__env"), by).select("ref_id", "m")
    return fitting.unionByName(unscoped).groupBy("ref_id").agg(F.min("m").alias("m")).select(
        "ref_id", F.when(F.col("m.is_secret"), F.lit(None)).otherwise(F.col("m.value")).alias("value"), F.coalesce("m.is_secret", F.lit(False)).alias("is_secret")
    )


def ladder(tokens: DataFrame, rungs: list[DataFrame]) -> DataFrame:
    """The lowest rung that has a value: ``ref_id, value, rung, resolved``; a secret on a rung ends the search.

    Each rung is ``ref_id, value`` with optional ``is_secret``; they are united and aggregated once.
    """
    parts = [
        r.select("ref_id", "value", F.lit(n + 1).alias("rung"), (F.col("is_secret") if "is_secret" in r.columns else F.lit(False)).alias("is_secret"))
        for n, r in enumerate(rungs)
    ]
    found = reduce(DataFrame.unionByName, parts).filter(F.col("value").isNotNull() | F.col("is_secret"))
    best = found.groupBy("ref_id").agg(F.min(F.struct("rung", "is_secret", "value")).alias("m"))
    out = tokens.select("ref_id").distinct().join(best, "ref_id", "left")
    return out.select(
        "ref_id",
        F.when(F.col("m").isNull(), EXHAUSTED).when(F.col("m.is_secret"), UNREADABLE).otherwise(F.col("m.value")).alias("value"),
        F.coalesce("m.rung", F.lit(len(rungs) + 1)).alias("rung"),
        F.coalesce(~F.col("m.is_secret"), F.lit(False)).alias("resolved"),
    )


def from_logs(tokens: DataFrame, logs: DataFrame) -> DataFrame:
    """Values that deploy logs print as KEY=VALUE: ``ref_id, value``; the first line that has one, by log and line.

    Lines are taken apart first, so logs and tokens meet by an equi-join on repository, environment and key.
    """
    line = logs.select("repo", "env", "ord", F.posexplode(F.split("log", r"\r?\n")).alias("n", "line")).withColumn("line", F.trim("line"))
    at = F.instr("line", "=")
    given = line.filter(at > 1).select("repo", "env", "ord", "n", F.lower(F.substr("line", F.lit(1), at - 1)).alias("__k"), F.trim(F.substr("line", at + 1)).alias("value"))
    first = given.filter(F.col("value") != "").groupBy("repo", "env", "__k").agg(F.min(F.struct("ord", "n", "value")).alias("m"))
    return tokens.withColumn("__k", F.lower("name")).join(first, ["repo", "env", "__k"]).select("ref_id", "m.value")


def static_values(refs: DataFrame) -> DataFrame:
    """Values that files of the repository give for an environment: the last literal one."""
    literal = refs.filter(F.col("env_hint").isNotNull() & ~F.col("raw_value").startswith("{"))
    return literal.groupBy("repo", F.col("env_hint").alias("env"), F.col("name")).agg(F.max(F.struct("ord", "raw_value")).getField("raw_value").alias("value"))


def substituted(refs: DataFrame, values: DataFrame) -> DataFrame:
    """References with one token replaced by its resolved value."""
    return refs.join(values.filter("resolved").select("ref_id", "value"), "ref_id").withColumn("resolved_value", substitute(F.col("raw_value"), F.col("name"), F.col("value")))


def scope_fits(scope: Column, dimension: str, wanted: str) -> Column:
    """A dimension that is absent fits everything; else it must list the wanted value, in any case."""
    listed = scope.getField(dimension)
    return listed.isNull() | (F.size(listed) <= 0) | F.coalesce(F.exists(listed, lambda x: F.lower(F.trim(x)) == wanted.lower()), F.lit(False))


def fits(scope: Column, **wanted: str) -> Column:
    """Whether a scope is compatible with what is wanted of each dimension (environment, role, tenant, channel)."""
    return reduce(lambda a, b: a & b, [scope_fits(scope, dimension, value) for dimension, value in wanted.items()], F.lit(True))


def best_scoped(rows: DataFrame, key: list[str], env: str, dimensions: tuple[str, ...] = ("environment", "role", "tenant", "channel")) -> DataFrame:
    """The best-scoped rows of each key for an environment; equal ranks are all kept and marked ``ambiguous``.

    Compatible rows count, else unscoped ones, else all; by the highest scoped dimension (environment before role,
    tenant, channel), then by the number of dimensions. The ranks are aggregated per key and joined back, so a key with
    many rows is never gathered.
    """
    have = [d for d in dimensions if d in rows.schema["scope"].dataType.names]
    weight = {d: 4 - n for n, d in enumerate(dimensions)}
    filled = {d: F.coalesce(F.size(F.col("scope").getField(d)) > 0, F.lit(False)) for d in have}
    priority = F.greatest(F.lit(0), F.lit(0), *[F.when(filled[d], weight[d]).otherwise(0) for d in have])
    number = reduce(lambda a, b: a + b, [filled[d].cast("int") for d in have], F.lit(0))
    group = F.when(scope_fits(F.col("scope"), "environment", env), 2).when(number == 0, 1).otherwise(0)
    ranked = rows.withColumn("__rank", F.struct(group.alias("g"), priority.alias("p"), number.alias("n")))
    top = ranked.groupBy(*key, "__rank").agg(F.count(F.lit(1)).alias("n")).groupBy(*key).agg(F.max(F.struct("__rank", "n")).alias("m"))
    top = top.select(*key, F.col("m.__rank").alias("__rank"), (F.col("m.n") > 1).alias("ambiguous"))
    return ranked.join(top, [*key, "__rank"]).drop("__rank")


def deployed_refs(deployments: DataFrame) -> DataFrame:
    """First record of each (repo, env) that has a commit: ``repo, env, sha, ord``; environments must be canonical."""
    has = deployments.filter(F.col("sha").isNotNull() & (F.trim("sha") != ""))
    return has.groupBy("repo", "env").agg(F.min(F.struct("ord", "sha")).alias("m")).select("repo", "env", "m.sha", "m.ord")


def facts_first(candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """Values that facts about the code itself give, before any ladder: ``ref_id, value, rung`` 0 where they exist."""
    winner = winning_facts(facts).select("repo", F.col("key").alias("name"), F.col("value").alias("fact"))
    return candidates.join(winner, ["repo", "name"], "left").withColumn("rung", F.when(F.col("fact").isNotNull(), F.lit(0)))


def winning_facts(facts: DataFrame) -> DataFrame:
    """One value per (repo, key): highest layer, most specific condition, smallest source."""
    dots = F.length("condition") - F.length(F.replace("condition", F.lit("."), F.lit("")))
    order = F.struct((-F.col("layer")).alias("l"), (-F.coalesce(dots, F.lit(0))).alias("s"), "source", "value", "condition", "layer")
    return facts.groupBy("repo", "key").agg(F.min(order).alias("m")).select("repo", "key", "m.value", "m.source", "m.condition", "m.layer")


def truncated_facts(facts: DataFrame, limit: int = 10_000_000) -> DataFrame:
    """Per repository over ``limit`` bytes of values only the half of its keys with most rows; ``truncated`` says so."""
    size = facts.groupBy("repo").agg(F.sum(F.coalesce(F.octet_length("value"), F.lit(0))).alias("bytes"))
    keys = facts.groupBy("repo", "key").agg(F.count(F.lit(1)).alias("n"))
    ranked = keys.withColumn("r", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("n"), "key"))).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("repo")))
    kept = ranked.join(size, "repo").withColumn("truncated", F.col("bytes") > limit).filter(~F.col("truncated") | (F.col("r") <= F.floor(F.col("k") / 2)))
    return facts.join(kept.select("repo", "key", "truncated"), ["repo", "key"])
