"""Which build and deploy systems a repository uses: intrinsic files, deploy steps, external bindings, roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweft.functions.urls import normalise_git_url

#: Systems and the directory or file that shows them. Fixed values.
DETECTORS = [
    ("github-actions", ".github/workflows/"),
    ("teamcity", ".teamcity/"),
    ("octopus", ".octopus/"),
    ("circleci", ".circleci/config.yml"),
    ("bitbucket-pipelines", "bitbucket-pipelines.yml"),
    ("azure-devops", "azure-pipelines.yml"),
    ("jenkins", "Jenkinsfile"),
]
#: Signatures of deploy steps: system, kind of match, pattern, where the environment stands. Fixed values.
SIGNATURES = [
    ("octopus", "action_id", "OctopusDeploy/create-release-action", "inputs.environment"),
    ("octopus", "action_id", "OctopusDeploy/deploy-release-action", "inputs.environment"),
    ("octopus", "step_name_pattern", "octo deploy-release", "--deployTo"),
    ("octopus", "step_name_pattern", "octo create-release.*--deployTo", "--deployTo"),
    ("kubernetes", "step_name_pattern", "kubectl apply", "--namespace"),
    ("kubernetes", "step_name_pattern", "helm upgrade", "--namespace"),
    ("kubernetes", "action_id", "azure/k8s-deploy", "inputs.namespace"),
    ("aws", "step_name_pattern", "aws deploy", None),
    ("aws", "step_name_pattern", "aws s3 sync", None),
    ("aws", "action_id", "aws-actions/amazon-ecs-deploy-task-definition", None),
    ("terraform", "step_name_pattern", "terraform apply", "-var-file"),
    ("terraform", "action_id", "hashicorp/setup-terraform", None),
    ("azure", "task_type", "AzureWebApp", "slot"),
    ("azure", "task_type", "AzureRmWebAppDeployment", "SlotName"),
]
#: Where a system keeps what it scopes by environment. Fixed values.
SCOPING = {
    "github-actions": "github-environments",
    "octopus": "octopus-environments",
    "teamcity": "teamcity-parameters",
    "circleci": "circleci-contexts",
    "bitbucket-pipelines": "bitbucket-deployments",
}
#: Words in a parameter's name that hint at an address. Fixed values.
HINT_WORDS = ["host", "url", "endpoint", "target", "server", "address"]


def intrinsic(files: DataFrame) -> DataFrame:
    """Systems that a repository's paths show: ``repo, provider``. The detectors are one expression per row, no join."""
    hits = F.array(*[F.when(F.col("path").startswith(p) if p.endswith("/") else F.col("path") == p, F.lit(name)) for name, p in DETECTORS])
    return files.select("repo", F.explode(F.array_compact(hits)).alias("provider")).distinct()


def signature_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SIGNATURES, "provider string, match_type string, pattern string, env_hint string")


def deploy_steps(files: DataFrame) -> DataFrame:
    """Signatures in workflow files: ``repo, provider, pattern, path``, the first path of each.

    The signatures are a fixed list, so each file is tested by one expression; no product of files and signatures is made.
    """
    tests = [
        F.when(F.contains("content", F.lit(p)) if kind == "action_id" else F.col("content").rlike(p), F.struct(F.lit(name).alias("provider"), F.lit(p).alias("pattern")))
        for name, kind, p, _ in SIGNATURES
    ]
    prefix = F.lit(False)
    for _, p in DETECTORS:
        prefix = prefix | (F.col("path").startswith(p.split("/")[0] + "/") if "/" in p else F.col("path") == p)
    hits = files.filter(prefix).select("repo", "path", F.explode(F.array_compact(F.array(*tests))).alias("s"))
    return hits.groupBy("repo", F.col("s.provider").alias("provider"), F.col("s.pattern").alias("pattern")).agg(F.min("path").alias("path"))


def repository_bindings(vcs_urls: DataFrame, repos: DataFrame) -> DataFrame:
    """External roots matched to repositories by the end of their address: ``root_id, repo``.

    The address without its host is org/name, the same key that a repository has, so the match of ends is an equi-join;
    deeper paths are matched by each of their suffixes of whole segments.
    """
    parts = F.split(normalise_git_url(F.col("url")), "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i + 1, 1 << 20), "/"))
    roots = vcs_urls.filter(F.col("url").isNotNull()).select("root_id", F.explode(suffixes).alias("slug"))
    return roots.join(repos.select(F.lower("full_name").alias("slug"), F.col("full_name").alias("repo")), "slug").select("root_id", "repo").distinct()


def projects_of_slugs(projects: DataFrame, repos: DataFrame) -> DataFrame:
    """Deploy projects whose persistence address or one of whose first five build records holds a repository's slug."""
    texts = F.array_compact(F.concat(F.array("persistence_url"), F.slice(F.coalesce("build_urls", F.array().cast("array<string>")), 1, 5)))
    urls = projects.select("project", F.explode(texts).alias("url")).withColumn("root_id", F.col("project"))
    return repository_bindings(urls.select("root_id", "url"), repos).select(F.col("root_id").alias("project"), "repo")


def merged_providers(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Roles of each provider from files and from bindings united: ``repo, provider, roles``."""
    both = inner.select("repo", "provider", F.col("roles").alias("a")).join(outer.select("repo", "provider", F.col("roles").alias("b")), ["repo", "provider"], "full_outer")
    none = F.array().cast("array<string>")
    return both.select("repo", "provider", F.array_sort(F.array_union(F.coalesce("a", none), F.coalesce("b", none))).alias("roles"))


def resolved_roles(providers: DataFrame) -> DataFrame:
    """Where one provider only deploys, the mixed ones lose that role."""
    dedicated = providers.groupBy("repo").agg(F.bool_or(F.col("roles") == F.array(F.lit("deploy"))).alias("__dedicated"))
    mixed = F.col("__dedicated") & (F.size("roles") > 1)
    return providers.join(dedicated, "repo").withColumn("roles", F.when(mixed, F.array_remove("roles", "deploy")).otherwise(F.col("roles"))).drop("__dedicated")


def profile_confidence(providers: DataFrame, repos: DataFrame) -> DataFrame:
    """Confidence of each repository's profile: low without providers or with a low one, high if all are, else medium."""
    agg = providers.groupBy("repo").agg(F.bool_and(F.col("confidence") == "high").alias("all_high"), F.bool_or(F.col("confidence") == "low").alias("any_low"))
    label = F.when(F.col("all_high").isNull(), "low").when(F.col("all_high"), "high").when(F.col("any_low"), "low").otherwise("medium")
    return repos.select("repo").distinct().join(agg, "repo", "left").select("repo", label.alias("confidence"))


def profiles(files: DataFrame, outer: DataFrame, repos: DataFrame) -> DataFrame:
    """The assembled profile: ``repo, provider, roles, scoping``; deploy steps give builders the deploy role too."""
    steps = deploy_steps(files).select("repo", "provider").distinct()
    builds = intrinsic(files).withColumn("roles", F.array(F.lit("build")))
    deploys = steps.withColumn("roles", F.array(F.lit("deploy")))
    inner = builds.unionByName(deploys).select("repo", "provider", F.explode("roles").alias("r")).groupBy("repo", "provider").agg(F.array_sort(F.collect_set("r")).alias("roles"))
    scope = F.lit("")
    for name, label in SCOPING.items():
        scope = F.when(F.col("provider") == name, F.lit(label)).otherwise(scope)
    merged = resolved_roles(merged_providers(inner, outer))
    return repos.select("repo").distinct().join(merged, "repo", "inner").withColumn("scoping", scope)


def deploy_hints(parameters: DataFrame) -> DataFrame:
    """Readable parameters whose name speaks of an address."""
    words = F.split(F.lower("name"), r"[._ ]+")
    return parameters.filter(F.arrays_overlap(words, F.array(*map(F.lit, HINT_WORDS))) & F.col("value").isNotNull() & ~F.col("is_secret"))
