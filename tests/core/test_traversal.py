import random
from collections import deque

import pytest

from conftest import rows
from depweft.operators import edges as E
from depweft.operators import traversal

SCHEMA = "from_id string, to_id string, env string, confidence string, provenance string, deployed_ref string, path string"


def graph(spark, pairs, confidence="high"):
    out = []
    for n, p in enumerate(pairs):
        a, b, *rest = p
        out.append((a, b, rest[0] if rest else "prod", rest[1] if len(rest) > 1 else confidence, "declared", f"r{n}", "clash"))
    return spark.createDataFrame(out, SCHEMA)


def model(pairs, seeds, hops):
    """First in, first out, neighbours in order of their ids."""
    near = {}
    for a, b in set(pairs):
        near.setdefault(a, []).append(b)
    found = {s: (0, (s,)) for s in sorted(seeds)}
    queue = deque(sorted(seeds))
    while queue:
        x = queue.popleft()
        if hops is not None and found[x][0] >= hops:
            continue
        for y in sorted(near.get(x, [])):
            if y not in found:
                found[y] = (found[x][0] + 1, (*found[x][1], y))
                queue.append(y)
    return sorted((n, h, " > ".join(p)) for n, (h, p) in found.items())


@pytest.mark.parametrize("one_plan", [True, False])
@pytest.mark.parametrize("seed", range(4))
def test_breadth_first_against_a_model(spark, seed, one_plan, monkeypatch):
    monkeypatch.setattr(traversal, "PLAN_EDGES", 1_000_000 if one_plan else 0)
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(rng.randrange(5, 30))]
    seeds = sorted({f"n{rng.randrange(12)}" for _ in range(2)})
    frame = spark.createDataFrame(pairs, "src string, dst string")
    start = spark.createDataFrame([(s,) for s in seeds], "node string")
    hops = rng.choice([1, 2, 3, None])
    out = traversal.breadth_first(frame, start, hops)
    assert sorted((r["node"], r["hop"], " > ".join(r["path"])) for r in out.collect()) == model(pairs, seeds, hops)


def test_impact_excludes_the_target_and_bounds_hops(spark):
    g = graph(spark, [("a", "t"), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("f", "e"), ("t", "t"), ("t", "a"), ("x", "t", "staging"), ("y", "t", "prod", "low")])
    out = {r["id"]: (r["hop"], r["path"]) for r in traversal.impact(g, "t", "prod", "medium").collect()}
    assert out == {"a": (1, "a"), "b": (2, "a > b"), "c": (3, "a > b > c"), "d": (4, "a > b > c > d"), "e": (5, "a > b > c > d > e")}


def test_shortest_path(spark):
    g = graph(spark, [("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("d", "e")])
    assert [(r["step"], r["from_id"], r["to_id"]) for r in traversal.shortest_path(g, "a", "e", "prod").orderBy("step").collect()] == [(1, "a", "b"), (2, "b", "d"), (3, "d", "e")]
    assert traversal.shortest_path(g, "a", "a", "prod").count() == 0
    assert traversal.shortest_path(g, "e", "a", "prod").count() == 0
    assert traversal.shortest_path(g.limit(0), "a", "e", "prod").count() == 0


def test_find_relevant(spark):
    g = graph(spark, [("s1", "s2"), ("s2", "s3"), ("s3", "s4"), ("s4", "s5")])
    nodes = spark.createDataFrame([(f"s{n}", f"repo{n}", "Web_App 100%" if n == 1 else f"svc{n}") for n in range(1, 6)], "id string, repo_id string, name string")
    out = rows(traversal.find_relevant(nodes, g, "app 100%", "prod").select("repo_id", "hop", "deployed_ref"))
    assert out == [("repo1", 0, "r0"), ("repo2", 1, "r1"), ("repo3", 2, "r2"), ("repo4", 3, "r3")]
    assert traversal.find_relevant(nodes, g, "_%x", "prod").count() == 0


def test_build_walks_only_edges_that_expand(spark):
    g = spark.createDataFrame([("a", "b", "prod", True), ("b", "c", "prod", False), ("c", "d", "prod", True), ("a", "a", "prod", True)], "from_id string, to_id string, env string, expands boolean")
    assert [r[:2] for r in rows(traversal.reachable_build(g, "a", "prod").select("from_id", "to_id"))] == [("a", "a"), ("a", "b"), ("b", "c")]


def test_diff_and_neighbours(spark):
    g = graph(spark, [("a", "b"), ("a", "c"), ("a", "b", "staging", "low"), ("a", "d", "staging"), ("z", "a")])
    out = rows(E.environment_diff(g, "a", "prod", "staging").select("to_id", "change"))
    assert out == [("b", "changed"), ("c", "removed"), ("d", "added")]
    assert rows(E.environment_diff(g, "a", "prod", "prod")) == []
    assert rows(E.neighbours(g, "a", "prod").select("node", "direction")) == [("b", "out"), ("c", "out"), ("z", "in")]
    with pytest.raises(ValueError):
        E.neighbours(g, "a", "prod", "sure")


def test_envelope_of_nothing(spark):
    g = graph(spark, [("a", "b")]).limit(0)
    assert tuple(traversal.envelope(g).first()) == (0, "high", "declared")
