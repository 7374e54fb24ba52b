"""The graph kept as Parquet: node and edge tables, upserts as new versions of whole tables.

Every write makes a new version folder, which counts once it is complete, so a reader never sees half a write; two
versions are kept. Edges are partitioned by environment, which prunes scans of one environment, and within it sorted by
ranges of their keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the persisted node tables and of the edge tables beyond from_id, to_id. Fixed values.
NODES = {
    "Repo": "id string, provider string, org string, name string, default_branch string, url string",
    "Deployable": "id string, repo_id string, kind string, name string",
    "Environment": "id string, name string, aliases array<string>",
    "Endpoint": "id string, scheme string, host string, port bigint, path string, env string",
    "ServiceIdentity": "id string, identity_class string, value string, env string",
    "ConfigVar": "id string, name string, injected boolean",
    "DeployedRef": "id string, sha string, branch string, env string, deployed_at string, at timestamp",
    "Pipeline": "id string, provider string, roles array<string>, env string",
    "CICDProvider": "id string, provider string, roles array<string>",
    "VariableStore": "id string, kind string, owner string",
}
_EDGE = "env string, provenance string, confidence string, evidence string, discovered_at string, deployed_ref string, ambiguous boolean, stale boolean, llm_trace string"
EDGES = {
    n: f"from_id string, to_id string, {_EDGE}"
    for n in (
        "DEPENDS_ON", "PRODUCES", "EXPOSES", "CONSUMES", "RESOLVES_TO", "BUILT_BY", "DEPLOYED_BY", "RESOLVES_VARS_FROM", "BUILDS",
        "DEPLOYS", "INJECTED_INTO", "DEPLOYED_AS",
    )
}
KEY = ["from_id", "to_id", "env"]


def last(rows: DataFrame, key: list[str], columns: list[str], ordinal: str = "ord", first: bool = False) -> DataFrame:
    """One row per key: the last (or first) by the ordinal, if there is one, and by the columns themselves."""
    order = [*([ordinal] if ordinal in rows.columns else []), *columns]
    if not order:
        return rows.select(*key).distinct()
    pick = (F.min if first else F.max)(F.struct(*order)).alias("__one")
    return rows.groupBy(*key).agg(pick).select(*key, *[F.col(f"__one.{c}").alias(c) for c in columns])


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows merged with new ones by key: new values win, columns that new rows lack or leave null keep the old.

    Of new rows with one key the last by ``ord`` wins, without it the greatest.
    """
    rest = [c for c in old.columns if c not in key]
    renamed = last(new, key, [c for c in rest if c in new.columns]).select(*key, *[F.col(c).alias(f"__{c}") for c in rest if c in new.columns])
    joined = old.join(renamed, key, "full_outer")
    return joined.select(*key, *[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in new.columns else F.col(c) for c in rest])


def inserted(old: DataFrame, new: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Old edges and those new ones whose (from, to, env) is not there yet and whose end nodes exist.

    Of new edges with one key the first by ``ord`` counts, without it the least.
    """
    fresh = last(new, KEY, [c for c in old.columns if c not in KEY and c in new.columns], first=True).join(old.select(*KEY), KEY, "left_anti")
    if nodes is not None:
        ids = nodes.select("id").distinct()
        fresh = fresh.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return old.unionByName(fresh.select(*[F.col(c) if c in fresh.columns else F.lit(None).cast(t).alias(c) for c, t in old.dtypes]))


def evidence_json(evidence):  # noqa: ANN001, ANN201
    """Evidence as the JSON list of type:locator."""
    return F.to_json(F.transform(evidence, lambda e: F.concat_ws(":", e["source_type"], e["locator"])))


class GraphStore:
    """Tables under one folder that the cluster shares."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _version(self, name: str) -> int:
        fs_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = fs_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return 0
        done = [s.getPath() for s in fs.listStatus(fs_path)]
        numbers = [int(p.getName()[1:]) for p in done if p.getName()[0] == "v" and fs.exists(self._child(p, "_SUCCESS"))]
        return max(numbers, default=0)

    def _child(self, parent, name: str):  # noqa: ANN001, ANN202
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(parent, name)

    def initialise(self) -> None:
        """Creates what is not there yet; calling it again changes nothing."""
        for name, schema in (NODES | EDGES).items():
            if not self._version(name):
                self._write(name, self.spark.createDataFrame([], schema))

    def _write(self, name: str, df: DataFrame) -> None:
        """A new version; edges by environment and, within it, by ranges of their keys, so no task has a whole environment.

        The version before stays for readers that began on it; older ones are removed.
        """
        version = self._version(name) + 1
        out = df.repartitionByRange(*["env", *KEY[:2]]).sortWithinPartitions(*KEY).write.partitionBy("env") if name in EDGES else df.write
        out.parquet(f"{self.root}/{name}/v{version}")
        for old in range(max(1, version - 3), version - 1):
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/v{old}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def read(self, name: str) -> DataFrame:
        schema = (NODES | EDGES)[name]
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/v{self._version(name)}")

    def upsert_nodes(self, name: str, rows: DataFrame) -> None:
        self._write(name, upserted(self.read(name), rows, ["id"]))

    def insert_edges(self, name: str, rows: DataFrame, nodes: DataFrame | None = None) -> None:
        self._write(name, inserted(self.read(name), rows, nodes))

    def persist_build(self, edges: DataFrame) -> None:
        """Edges of a build in order of (from, to, env); end nodes that are missing are created."""
        ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
        self.upsert_nodes("Deployable", ends.select("id", F.col("id").alias("repo_id"), F.lit("service").alias("kind"), F.col("id").alias("name")))
        self.insert_edges("DEPENDS_ON", edges)

    def write_runtime(self, runtime_only: DataFrame) -> None:
        """Runtime-only edges as observed ones, unless the pair is there in that environment."""
        self.insert_edges("DEPENDS_ON", runtime_only.withColumn("provenance", F.lit("observed")))


def cached(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """A response cache with new answers put in; the first answer to a key stays, by ``ord`` if there is one."""
    columns = [c for c in cache.columns if c != "cache_key"]
    return cache.unionByName(last(answers, ["cache_key"], columns, first=True).join(cache.select("cache_key"), "cache_key", "left_anti").select(*cache.columns))


def report_json(report: DataFrame) -> DataFrame:
    """One JSON document per row, nulls kept."""
    return report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
