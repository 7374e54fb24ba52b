"""Repository listings, trees and files from recorded payloads or a local checkout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_GITHUB = "array<struct<name:string,full_name:string,owner:struct<login:string>,html_url:string,clone_url:string,default_branch:string>>"
_BITBUCKET = "struct<isLastPage:boolean,nextPageStart:int,values:array<struct<slug:string,project:struct<key:string>,links:struct<clone:array<struct<name:string,href:string>>>>>>"
_TREE = "struct<sha:string,tree:array<struct<path:string,mode:string,type:string,sha:string,size:bigint>>>"


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as ``path, body``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def default_branch(c):  # noqa: ANN001, ANN201
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("main"))


def github_repos(bodies: DataFrame) -> DataFrame:
    """``provider, org, name, url, default_branch`` from repository lists."""
    r = bodies.select(F.explode(F.from_json("body", _GITHUB)).alias("r"))
    return r.select(
        F.lit("github").alias("provider"), F.coalesce("r.owner.login", F.split_part("r.full_name", F.lit("/"), F.lit(1))).alias("org"),
        F.col("r.name").alias("name"), F.coalesce("r.clone_url", "r.html_url").alias("url"), default_branch(F.col("r.default_branch")).alias("default_branch"),
    )


def bitbucket_repos(bodies: DataFrame) -> DataFrame:
    """The same from paged lists; the clone link named http is taken. Pages are rows, so paging is a union."""
    r = bodies.select(F.explode(F.from_json("body", _BITBUCKET).getField("values")).alias("r"))
    http = F.filter("r.links.clone", lambda x: x["name"] == "http")
    return r.select(
        F.lit("bitbucket-dc").alias("provider"), F.col("r.project.key").alias("org"), F.col("r.slug").alias("name"),
        F.try_element_at(http, F.lit(1)).getField("href").alias("url"), F.lit("main").alias("default_branch"),
    )


def with_full_name(repos: DataFrame) -> DataFrame:
    return repos.withColumn("full_name", F.concat("provider", F.lit(":"), "org", F.lit("/"), "name"))


def github_tree(bodies: DataFrame) -> DataFrame:
    """``repo, path, type, size`` from ``repo, body``; 'blob' is a file."""
    t = bodies.select("repo", F.explode(F.from_json("body", _TREE).getField("tree")).alias("t"))
    return t.select("repo", "t.path", F.when(F.col("t.type") == "blob", "file").otherwise(F.col("t.type")).alias("type"), "t.size")


def path_list_tree(bodies: DataFrame) -> DataFrame:
    """The same from plain or paged lists of paths."""
    paths = F.coalesce(F.from_json("body", "array<string>"), F.from_json("body", "struct<values:array<string>>").getField("values"))
    return bodies.select("repo", F.explode(paths).alias("path"), F.lit("file").alias("type"), F.lit(None).cast("bigint").alias("size"))


def github_content(bodies: DataFrame) -> DataFrame:
    """``repo, path, content`` of base64 payloads."""
    c = bodies.select("repo", F.from_json("body", "struct<path:string,encoding:string,content:string>").alias("c"))
    plain = F.when(F.col("c.encoding") == "base64", F.decode(F.unbase64(F.regexp_replace("c.content", r"\s", "")), "utf-8")).otherwise(F.col("c.content"))
    return c.select("repo", F.col("c.path").alias("path"), plain.alias("content"))


def file_map(bodies: DataFrame) -> DataFrame:
    """``repo, path, content`` of payloads that map paths to contents; read as a map, so paths become rows, not columns."""
    return bodies.select("repo", F.explode(F.from_json("body", "map<string,string>")).alias("path", "content"))


def local_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files of a checkout as ``path, content``."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return b.select("path", F.decode("content", "utf-8").alias("content"), F.col("length").alias("size"))
