"""Command line: ``python -m depweft.cli --store FOLDER query impact REPO --env prod`` and siblings."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from depweft.api import QueryEngine
from depweft.plugins import Registry
from depweft.runtime import stages
from depweft.sinks.store import GraphStore


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="depweft")
    p.add_argument("--store", required=True, help="folder of the graph's tables")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init", help="create the tables that are missing")
    sub.add_parser("providers", help="list installed plug-ins")
    load = sub.add_parser("load", help="persist edges from a Parquet folder")
    load.add_argument("edges")
    q = sub.add_parser("query").add_subparsers(dest="query", required=True)
    for name, args in (("find", ["task"]), ("impact", ["repo"]), ("path", ["from_repo", "to_repo"]), ("explain", ["from_repo", "to_repo"]), ("env-diff", ["repo", "env_a", "env_b"])):
        one = q.add_parser(name)
        for a in args:
            one.add_argument(a)
        one.add_argument("--out", help="new folder for all rows as Parquet; the output shows the first ones only")
        if name != "env-diff":
            one.add_argument("--env", default="prod")
        if name in ("find", "impact"):
            one.add_argument("--min-confidence", default="low")
        if name == "find":
            one.add_argument("--max-hops", type=int, default=3)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    store = GraphStore(spark, a.store)
    if a.command == "init":
        store.initialise()
        return 0
    if a.command == "providers":
        registry = Registry()
        registry.discover()
        for row in registry.rows():
            print(*row)
        return 0
    if a.command == "load":
        store.initialise()
        store.persist_build(spark.read.parquet(a.edges))
        return 0
    engine = QueryEngine(store.read("Deployable"), store.read("DEPENDS_ON"))
    method, args = {
        "find": lambda: ("find_relevant_repos", (a.task, a.env, a.max_hops, a.min_confidence)),
        "impact": lambda: ("impact_analysis", (a.repo, a.env, a.min_confidence)),
        "path": lambda: ("dependency_path", (a.from_repo, a.to_repo, a.env)),
        "explain": lambda: ("explain_edge", (a.from_repo, a.to_repo, a.env)),
        "env-diff": lambda: ("env_diff", (a.repo, a.env_a, a.env_b)),
    }[a.query]()
    with stages(spark):
        if a.out:
            getattr(engine, f"{method}_frame")(*args).write.parquet(a.out)
        result = getattr(engine, method)(*args)
    print(result.to_json())
    return 0 if result.results else 1


if __name__ == "__main__":
    raise SystemExit(main())
