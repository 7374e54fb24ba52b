"""Build and deploy systems: projects, variables, parameters, workflow files, logs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweft.runtime import map_batches

_PAGED = "struct<Items:array<struct<Id:string,Name:string,Slug:string,PersistenceSettings:struct<Url:string>>>>"
_BUILDS = "struct<buildType:array<struct<id:string,name:string,projectName:string,projectId:string>>>"
_SCOPE = "struct<Environment:array<string>,Role:array<string>,Tenant:array<string>,Channel:array<string>>"
_VARIABLES = f"struct<OwnerId:string,Version:bigint,Variables:array<struct<Id:string,Name:string,Value:string,Scope:{_SCOPE},Type:string,IsSensitive:boolean>>>"
_PARAMETERS = "struct<property:array<struct<name:string,value:string,own:boolean,type:string>>>"
VARIABLE_ENTRY = "owner string, ord int, key string, value string, is_secret boolean, scope struct<environment:array<string>,role:array<string>,tenant:array<string>,channel:array<string>>"
SINCE = (2021, 1)


def deploy_projects(bodies: DataFrame) -> DataFrame:
    """``project, name, persistence_url`` from paged lists."""
    return bodies.select(F.inline(F.from_json("body", _PAGED).getField("Items"))).select(F.col("Id").alias("project"), F.col("Name").alias("name"), F.col("PersistenceSettings.Url").alias("persistence_url"))


def build_configs(bodies: DataFrame) -> DataFrame:
    return bodies.select(F.inline(F.from_json("body", _BUILDS).getField("buildType")))


def scoped_variables(bodies: DataFrame) -> DataFrame:
    """Variable sets in one form: ``owner, ord, key, value, is_secret, scope``; secret values are null."""
    v = bodies.select(F.from_json("body", _VARIABLES).alias("b")).select(F.col("b.OwnerId").alias("owner"), F.posexplode("b.Variables").alias("ord", "v"))
    scope = F.struct(*[F.col(f"v.Scope.{n}").alias(n.lower()) for n in ("Environment", "Role", "Tenant", "Channel")])
    secret = F.coalesce("v.IsSensitive", F.lit(False)) | (F.col("v.Type") == "Sensitive")
    secret = F.coalesce(secret, F.lit(False))
    return v.select("owner", "ord", F.col("v.Name").alias("key"), F.when(~secret, F.col("v.Value")).alias("value"), secret.alias("is_secret"), scope.alias("scope"))


def parameters(bodies: DataFrame) -> DataFrame:
    """Build parameters; a type that says password hides the value, whether it is a text or an object."""
    p = bodies.select("owner", F.posexplode(F.from_json("body", _PARAMETERS).getField("property")).alias("ord", "p"))
    secret = F.coalesce(F.lower("p.type").contains("password"), F.lit(False))
    return p.select("owner", "ord", F.col("p.name").alias("key"), F.when(~secret, F.col("p.value")).alias("value"), secret.alias("is_secret"))


def parameter_rows(table: DataFrame) -> DataFrame:
    """The same from rows of a parameters table."""
    secret = F.coalesce(F.lower("ptype").contains("password"), F.lit(False))
    return table.select(F.col("buildtypeid").alias("owner"), F.col("param_row").alias("ord"), "name", F.when(~secret, F.col("value")).alias("value"), secret.alias("is_secret"))


def vars_and_secrets(bodies: DataFrame) -> DataFrame:
    """Variables and names of secrets of one environment: secrets come masked."""
    b = bodies.select("owner", "env", F.from_json("body", "struct<vars:map<string,string>,secrets:array<string>>").alias("b"))
    plain = b.select("owner", "env", F.explode("b.vars").alias("key", "value"), F.lit(False).alias("is_secret"))
    hidden = b.select("owner", "env", F.explode("b.secrets").alias("key"), F.lit("[MASKED]").alias("value"), F.lit(True).alias("is_secret"))
    return plain.unionByName(hidden)


def empty_store(spark: SparkSession) -> DataFrame:
    """A store of a system that keeps no readable variables."""
    return spark.createDataFrame([], VARIABLE_ENTRY)


def effective_value(preview: DataFrame, name: str, owner: str | None = None) -> DataFrame:
    """Rows of a preview with exactly this name; secrets without value."""
    rows = preview.filter(F.col("name") == name)
    rows = rows if owner is None else rows.filter(F.col("projectid") == owner)
    secret = F.coalesce("issensitive", F.lit(False))
    return rows.select("projectid", "name", F.when(~secret, F.col("value")).alias("value"), secret.alias("is_secret"), "scope")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def supported(version: str) -> bool:
    """Whether a server's version is recent enough, compared by its numbers."""
    numbers = tuple(int(x) for x in version.replace("-", ".").split(".") if x.isdigit())[:2]
    return numbers >= SINCE


_BINDING = "repo string, path string, pipeline string, role string, env string"


def _workflow(text: str) -> Iterator[tuple[str, str, str | None]]:
    """(pipeline, role, env) of a workflow file with jobs; without environments, or unreadable: one build."""
    import yaml

    try:
        doc = yaml.safe_load(text)
    except yaml.YAMLError:
        doc = None
    found = False
    for name, job in ((doc.get("jobs") or {}).items() if isinstance(doc, dict) and isinstance(doc.get("jobs") or {}, dict) else ()):
        env = job.get("environment") if isinstance(job, dict) else None
        env = env.get("name") if isinstance(env, dict) else env
        if isinstance(env, str) and env:
            found = True
            yield str(name), "deploy", env
    if not found:
        yield "", "build", None


def _pipelines(text: str) -> Iterator[tuple[str, str, str | None]]:
    """(pipeline, role, env) of a pipelines file: steps below branches, pull-requests, custom and default."""
    import yaml

    try:
        doc = yaml.safe_load(text)
    except yaml.YAMLError:
        doc = None
    top = (doc or {}).get("pipelines") if isinstance(doc, dict) else None
    found = False

    def steps(name: str, node: object) -> Iterator[tuple[str, str, str | None]]:
        for entry in node if isinstance(node, list) else []:
            if not isinstance(entry, dict):
                continue
            if isinstance(entry.get("parallel"), list):
                yield from steps(name, entry["parallel"])
            step = entry.get("step")
            if isinstance(step, dict):
                env = step.get("deployment")
                yield name, "deploy" if env else "build", env if isinstance(env, str) else None

    for section in ("branches", "pull-requests", "custom"):
        for name, node in ((top or {}).get(section) or {}).items() if isinstance(top, dict) else ():
            for row in steps(f"{section}:{name}", node):
                found = True
                yield row
    for row in steps("default", (top or {}).get("default") if isinstance(top, dict) else None):
        found = True
        yield row
    if not found:
        yield "", "build", None


def _bindings(files: DataFrame, read) -> DataFrame:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(repo, path, *b) for repo, path, text in zip(*(c.to_pylist() for c in batch.columns)) for b in read(text or "")]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["repo", "path", "pipeline", "role", "env"])

    return map_batches(files.select("repo", "path", "content"), run, _BINDING)


def workflow_bindings(files: DataFrame) -> DataFrame:
    """Bindings of workflow files with jobs (YAML has no reader in Spark, so batches go through Python)."""
    return _bindings(files.filter(F.col("path").rlike(r"^\.github/workflows/[^/]+\.ya?ml$")), _workflow)


def pipeline_bindings(files: DataFrame) -> DataFrame:
    return _bindings(files.filter(F.col("path") == "bitbucket-pipelines.yml"), _pipelines)
