"""Queries over facts see every line of the table: brute force models on a small fixture."""

from collections import Counter, defaultdict

import pytest

from conftest import rows
from depweft.operators import resolve
from depweft.plans import domain_queries, inventory_queries

QUERIES = domain_queries.queries() | inventory_queries.queries()
SQL = domain_queries.oracle_sql() | inventory_queries.oracle_sql()
#: l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity, l_returnflag: winners and most entries have small quantities.
LINES = [
    (1, 1, 1, 21, 3.0, "A"), (1, 2, 1, 41, 50.0, "N"), (2, 1, 1, 61, 10.0, "R"), (2, 3, 1, 21, 3.0, "N"), (2, 3, 1, 21, 3.0, "N"),
    (3, 2, 1, 2, 44.0, "R"), (4, 1, 2, 1, 45.0, "N"), (5, 1, 2, 1, 44.99, "A"), (6, 1, 3, 9, 1.0, "R"), (7, 1, 1, 25, 7.0, "A"),
]


@pytest.fixture(scope="module")
def few(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("facts"))
    lines = spark.createDataFrame(LINES, "l_orderkey bigint, l_linenumber bigint, l_suppkey bigint, l_partkey bigint, l_quantity double, l_returnflag string")
    lines.write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "s_suppkey bigint, s_nationkey bigint").write.parquet(f"{d}/supplier.parquet")
    return d


def facts():
    for _, number, supplier, part, _, flag in LINES:
        yield f"r{supplier}", f"k{part % 20}", f"v{part}", f"f{part}.json", 1 + number % 2, {"A": "prod.eu", "N": "prod"}.get(flag)


def winners():
    best = {}
    for repo, key, value, source, layer, condition in facts():
        rank = (-layer, -(condition or "").count("."), source, value, condition or "")
        if (repo, key) not in best or rank < best[repo, key][0]:
            best[repo, key] = rank, (value, source, condition, layer)
    return {k: v for k, (_, v) in best.items()}


def test_winning_facts(spark, few):
    got = QUERIES["a12_winning_facts"](spark, few).select("repo", "key", "value", "source", "condition", "layer")
    assert rows(got) == sorted(((*k, *v) for k, v in winners().items()), key=repr)


def test_facts_first(spark, few):
    won = winners()
    want = [(f"r{s}", "k1", won[f"r{s}", "k1"][0] if (f"r{s}", "k1") in won else None, 0 if (f"r{s}", "k1") in won else -1) for s in (1, 2, 3)]
    assert rows(QUERIES["j6_facts_first"](spark, few).select("repo", "name", "fact", "rung")) == sorted(want, key=repr)


def test_truncated_facts(spark, few):
    n = Counter((repo, key) for repo, key, *_ in facts())
    got = QUERIES["a13_truncated_facts"](spark, few).select("repo", "key", "n", "truncated")
    assert rows(got) == sorted(((*k, c, False) for k, c in n.items()), key=repr)


def test_truncation(spark):
    """Above the limit the half of the keys with most rows stays; up to it all do."""
    many = [("big", k, "v" * 10) for k, n in (("a", 1), ("b", 3), ("c", 4), ("d", 2), ("e", 6)) for _ in range(n)]
    df = spark.createDataFrame([*many, *[("even", "x", "v" * 75), ("even", "y", "v" * 75)]], "repo string, key string, value string")
    got = resolve.truncated_facts(df, 150).groupBy("repo", "key", "truncated").count()
    assert rows(got) == [("big", "c", True, 4), ("big", "e", True, 6), ("even", "x", False, 1), ("even", "y", False, 1)]


def test_truncated_query_keeps_repositories_below_the_limit(spark, data):
    got = QUERIES["a13_truncated_facts"](spark, data)
    assert got.filter("truncated").count() == 0 and got.count() > 0


def test_value_sets(spark, few):
    sets = defaultdict(set)
    for repo, key, value, source, layer, condition in facts():
        sets[repo, key].add((-layer, value, source, condition or ""))
    want = [(*k, ",".join(f"{v}@{-layer}" for layer, v, _, _ in sorted(s))) for k, s in sets.items()]
    assert rows(QUERIES["a14_value_sets"](spark, few).select("repo", "key", "entries")) == sorted(want, key=repr)


def test_static_values(spark, few):
    last = {}
    for order, number, supplier, part, *_ in LINES:
        if part % 3:
            k = f"r{supplier}", "prod", f"k{number}"
            last[k] = max(last.get(k, (0, "")), (order, f"v{part}"))
    want = sorted((*k, v) for k, (_, v) in last.items())
    assert rows(QUERIES["e11_static_values"](spark, few).select("repo", "env", "name", "value")) == want
