import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from depweft import plugins
from depweft.api import QueryEngine
from depweft.cli import main
from depweft.sinks.store import GraphStore, cached, evidence_json, report_json
from depweft.sources import cicd, config, telemetry, vcs
from depweft.sources.datasource import register
from depweft.streaming import observed


def bodies(spark, *rs, columns="repo string, body string"):
    return spark.createDataFrame([(r[0], json.dumps(r[1]) if not isinstance(r[1], str) else r[1]) for r in rs], columns)


def test_vcs(spark, tmp_path):
    gh = [{"name": "a", "full_name": "o/a", "owner": {"login": "o"}, "clone_url": "https://h/o/a.git", "default_branch": ""}]
    bb = {"isLastPage": True, "values": [{"slug": "b", "project": {"key": "P"}, "links": {"clone": [{"name": "ssh", "href": "s"}, {"name": "http", "href": "h"}]}}]}
    assert rows(vcs.with_full_name(vcs.github_repos(bodies(spark, ("x", gh))))) == [("github", "o", "a", "https://h/o/a.git", "main", "github:o/a")]
    assert rows(vcs.bitbucket_repos(bodies(spark, ("x", bb), ("x", "{bad")))) == [("bitbucket-dc", "P", "b", "h", "main")]
    tree = {"sha": "1", "tree": [{"path": "d", "type": "tree"}, {"path": "d/f", "type": "blob", "size": 3}]}
    assert rows(vcs.github_tree(bodies(spark, ("r", tree)))) == [("r", "d", "tree", None), ("r", "d/f", "file", 3)]
    assert rows(vcs.path_list_tree(bodies(spark, ("r", ["x"]), ("q", {"values": ["y"]})))) == [("q", "y", "file", None), ("r", "x", "file", None)]
    assert rows(vcs.github_content(bodies(spark, ("r", {"path": "f", "encoding": "base64", "content": "w6Q=\n"})))) == [("r", "f", "ä")]
    assert rows(vcs.file_map(bodies(spark, ("r", {"a.b": "1", "c": "2"})))) == [("r", "a.b", "1"), ("r", "c", "2")]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.txt").write_text("hello")
    assert rows(vcs.local_files(spark, str(tmp_path)).select("content", "size")) == [("hello", 5)]
    register(spark)
    (tmp_path / "p1.json").write_text(json.dumps({"values": [{"a": 1}, {"a": 2}]}))
    assert rows(spark.read.format("pages").load(str(tmp_path)).select("ord", "body")) == [(0, '{"a": 1}'), (1, '{"a": 2}')]


def test_cicd(spark):
    variables = {"OwnerId": "P", "Variables": [{"Name": "n", "Value": "v", "Scope": {"Environment": ["E"]}, "Type": "String", "IsSensitive": False}, {"Name": "s", "Value": "x", "Type": "Sensitive"}]}
    assert [(r["ord"], r["key"], r["value"], r["is_secret"]) for r in cicd.scoped_variables(bodies(spark, ("x", variables))).collect()] == [(0, "n", "v", False), (1, "s", None, True)]
    params = {"property": [{"name": "a", "value": "1", "type": {}}, {"name": "b", "value": "2", "type": {"rawValue": "PASSWORD x"}}, {"name": "c", "value": "3", "type": "password"}]}
    assert [r[2:] for r in rows(cicd.parameters(bodies(spark, ("o", params), columns="owner string, body string")))] == [("a", "1", False), ("b", None, True), ("c", None, True)]
    both = spark.createDataFrame([("o", "e", json.dumps({"vars": {"A": "1"}, "secrets": ["B"]}))], "owner string, env string, body string")
    assert rows(cicd.vars_and_secrets(both)) == [("o", "e", "A", "1", False), ("o", "e", "B", "[MASKED]", True)]
    assert cicd.empty_store(spark).count() == 0
    assert cicd.supported("2021.1.3") and cicd.supported("2023.11") and not cicd.supported("2020.2")
    projects = {"Items": [{"Id": "P1", "Name": "n", "PersistenceSettings": {"Url": "u"}}, {"Id": "P2", "Name": "m"}]}
    assert rows(cicd.deploy_projects(bodies(spark, ("x", projects)))) == [("P1", "n", "u"), ("P2", "m", None)]


def test_workflows(spark):
    yaml = pytest.importorskip("yaml")
    assert yaml
    files = spark.createDataFrame(
        [
            ("r", ".github/workflows/a.yml", "jobs:\n  d1:\n    environment: prod\n  d2:\n    environment:\n      name: dev\n  b: {}\n"),
            ("r", ".github/workflows/bad.yaml", "jobs: [\n"), ("r", ".github/workflows/none.yml", ""), ("r", "docs/a.yml", "jobs: {}"),
            ("r", "bitbucket-pipelines.yml", "pipelines:\n  default:\n    - step: {name: x}\n  branches:\n    main:\n      - step: {deployment: prod}\n      - parallel:\n          - step: {deployment: dev}\n"),
        ],
        "repo string, path string, content string",
    )
    assert [r[1:] for r in rows(cicd.workflow_bindings(files))] == [
        (".github/workflows/a.yml", "d1", "deploy", "prod"), (".github/workflows/a.yml", "d2", "deploy", "dev"), (".github/workflows/bad.yaml", "", "build", None), (".github/workflows/none.yml", "", "build", None),
    ]
    assert [r[2:] for r in rows(cicd.pipeline_bindings(files))] == [("branches:main", "deploy", "dev"), ("branches:main", "deploy", "prod"), ("default", "build", None)]


def test_telemetry(spark):
    page = lambda data: bodies(spark, ("prod", {"data": data}), columns="env string, body string")
    log = {"attributes": {"service": "a", "attributes": {"http.url": "https://b.x/y"}}}
    assert [r[:2] for r in rows(telemetry.log_edges(page([log, {"attributes": {"service": "a", "attributes": {}}}, {"attributes": {"service": "a", "attributes": {"peer.service": " ", "out.host": "c"}}}])))] == [("a", "b"), ("a", "c")]
    span = lambda k, **kw: {"attributes": {"service": "a", "span_kind": k, **kw}}
    assert [r[:2] for r in rows(telemetry.span_edges(page([span("client", peer_service="", out_host="h"), span("server", peer_service="x")])))] == [("a", "h")]
    cut = telemetry.service_map(page([{"from_service": "a", "to_service": str(n)} for n in range(5)]), most=3).collect()
    assert [r["to_service"] for r in cut] == ["0", "1", "2"] and all(r["truncated"] for r in cut)
    assert rows(telemetry.capabilities(page([]))) == [("prod", False, False, False, False)]
    assert telemetry.no_edges(spark).count() == 0


def test_store_api_cli(spark, tmp_path, capsys):
    store = GraphStore(spark, str(tmp_path / "g"))
    store.initialise()
    store.initialise()
    edges = spark.createDataFrame([("a", "b", "prod", "declared", "high"), ("b", "c", "prod", "injected", "medium"), ("a", "b", "dev", "declared", "low")], "from_id string, to_id string, env string, provenance string, confidence string")
    store.persist_build(edges)
    store.persist_build(edges)
    assert store.read("DEPENDS_ON").count() == 3 and store.read("Deployable").count() == 3
    store.upsert_nodes("Deployable", spark.createDataFrame([("a", "Renamed")], "id string, name string"))
    assert rows(store.read("Deployable").filter("id = 'a'").select("repo_id", "name")) == [("a", "Renamed")]
    store.insert_edges("DEPENDS_ON", edges.limit(1).withColumn("to_id", F.lit("nowhere")), store.read("Deployable"))
    assert store.read("DEPENDS_ON").count() == 3
    engine = QueryEngine(store.read("Deployable"), store.read("DEPENDS_ON"))
    result = engine.impact_analysis("c", "prod")
    assert [(r["id"], r["hop"]) for r in result.results] == [("b", 1), ("a", 2)] and (result.confidence, result.provenance) == ("medium", "injected")
    assert engine.impact_analysis("zzz", "prod").unknowns[0]["kind"] == "no-match"
    assert [r["change"] for r in engine.env_diff("a", "prod", "dev").results] == ["changed"]
    assert engine.explain_edge("a", "b", "prod").results[0]["confidence"] == "high"
    with pytest.raises(ValueError):
        engine.find_relevant_repos("x", "prod", min_confidence="sure")
    assert main(["--store", str(tmp_path / "g"), "query", "path", "a", "c"], spark) == 0
    assert [r["step"] for r in json.loads(capsys.readouterr().out)["results"]] == [1, 2]
    assert main(["--store", str(tmp_path / "g"), "query", "impact", "zzz"], spark) == 1


def test_whole_frames_beyond_the_envelope(spark, tmp_path, capsys, monkeypatch):
    store = GraphStore(spark, str(tmp_path / "g"))
    store.initialise()
    edges = [(a, b, "prod", "declared", "high") for a, b in [("web1", "mid"), ("web2", "mid"), ("web3", "mid"), ("mid", "db"), ("mid", "mq")]]
    store.persist_build(spark.createDataFrame(edges, "from_id string, to_id string, env string, provenance string, confidence string"))
    monkeypatch.setattr("depweft.api.SHOWN", 1)
    queries = {"impact": (["mid"], 3), "find": (["mid"], 3), "path": (["web1", "db"], 2), "explain": (["mid", "db"], 1), "env-diff": (["mid", "prod", "dev"], 2)}
    for query, (args, n) in queries.items():
        out = str(tmp_path / query)
        assert main(["--store", str(tmp_path / "g"), "query", query, *args, "--out", out], spark) == 0
        shown = json.loads(capsys.readouterr().out)
        assert (len(shown["results"]), shown["metadata"]["rows"], spark.read.parquet(out).count()) == (1, n, n), query


def test_sinks_helpers(spark):
    ev = spark.createDataFrame([([("file", "a:1")],)], "e array<struct<source_type:string,locator:string>>")
    assert ev.select(evidence_json(F.col("e"))).first()[0] == '["file:a:1"]'
    cache = spark.createDataFrame([("k", "old")], "cache_key string, answer string")
    assert rows(cached(cache, spark.createDataFrame([("k", "new"), ("n", "x")], "cache_key string, answer string"))) == [("k", "old"), ("n", "x")]
    assert report_json(spark.createDataFrame([("a", None)], "x string, y string")).first()[0] == '{"x":"a","y":null}'


def test_streaming(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame([("a", "b", "prod", t0 + dt.timedelta(minutes=m), i) for i, m in enumerate([0, 10, 70, 71, 200])], "from_id string, to_id string, env string, at timestamp, event_id int")
    events.unionByName(events.limit(2)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    done = observed.into(observed.windowed_counts(observed.once(stream), late=None), lambda b: b.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "c"), mode="append")
    done.awaitTermination()
    out = rows(spark.read.parquet(str(tmp_path / "out")).select("window_start", "sample_count"))
    assert out == [(t0, 2)], "later windows are still open under the watermark"
    assert [r["sample_count"] for r in observed.session_counts(events).orderBy("window_start").collect()] == [2, 2, 1]
    assert observed.stale(observed.last_seen(events), "2024-01-05 00:00:00").first()["stale"]


def test_plugins_and_config(tmp_path, monkeypatch):
    m = plugins.read_manifest({"name": "n", "family": "vcs", "contract_version": "1.2.3"})
    assert plugins.compatible(m) and not plugins.compatible(plugins.read_manifest({"name": "n", "family": "vcs", "contract_version": "0.1.0"}))
    for bad in ({}, {"name": "n", "family": "x", "contract_version": "1.0.0"}, {"name": "n", "family": "vcs", "contract_version": "1"}):
        with pytest.raises(ValueError):
            plugins.read_manifest(bad)

    class Mine(plugins.LlmPlugin):
        name = "mine"

        def answer(self, requests):
            return requests

    registry = plugins.Registry()
    registry.add(Mine())
    registry.discover()
    assert registry.rows()[0][:2] == ("llm", "mine") and isinstance(registry.get("llm", "mine"), Mine)
    (tmp_path / config.FILE).write_text("[llm]\nfiles = 7\n")
    assert config.setting("files", "llm", 20, str(tmp_path)) == 7
    monkeypatch.setenv("DEPWEFT_LLM_FILES", "9")
    assert config.setting("files", "llm", 20, str(tmp_path)) == 9 and config.setting("none", "llm", "d", str(tmp_path)) == "d"


def test_chat_completions(spark):
    """A live provider over HTTP: answers become columns, faults are named, equal keys are asked once."""
    import http.server
    import json
    import threading

    asked = []

    class Endpoint(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            prompt = body["messages"][0]["content"]
            asked.append(prompt)
            if prompt == "busy":
                self.send_error(429)
                return
            content = json.dumps({"resolved_value": "v-" + prompt, "reasoning": "seen"}) if prompt != "odd" else "no json"
            reply = json.dumps({"choices": [{"message": {"content": content}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(reply)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Endpoint)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        plugin = plugins.ChatCompletions(f"http://127.0.0.1:{server.server_port}", "m", timeout=5)
        requests = spark.createDataFrame([("k1", "a"), ("k1", "a"), ("k2", "busy"), ("k3", "odd")], "cache_key string, prompt string")
        out = plugin.answer(requests).select("cache_key", "value", "reasoning", "error").collect()
        assert sorted(map(tuple, out)) == [("k1", "v-a", "seen", None), ("k2", None, None, "rate-limited"), ("k3", None, None, "malformed")]
        assert sorted(asked) == ["a", "busy", "odd"]
        gone = plugins.ChatCompletions("http://127.0.0.1:9", "m", timeout=2)
        assert gone.ask("x") == ({}, "endpoint-error")
    finally:
        server.shutdown()


def test_versions_and_winners(spark, tmp_path):
    """Of rows with one key the last by its order wins among nodes, the first among edges; old versions go."""
    store = GraphStore(spark, str(tmp_path / "s"))
    store.initialise()
    rows_ = [("a", "r1", 2), ("a", "r2", 5), ("a", "r3", 1)]
    store.upsert_nodes("Deployable", spark.createDataFrame([(i, r, "service", i, o) for i, r, o in rows_], "id string, repo_id string, kind string, name string, ord int"))
    assert [r["repo_id"] for r in store.read("Deployable").collect()] == ["r2"]
    edge = "from_id string, to_id string, env string, confidence string, ord int"
    store.insert_edges("DEPENDS_ON", spark.createDataFrame([("a", "b", "prod", "low", 7), ("a", "b", "prod", "high", 3)], edge))
    assert [r["confidence"] for r in store.read("DEPENDS_ON").collect()] == ["high"]
    for n in range(4):
        store.insert_edges("DEPENDS_ON", spark.createDataFrame([(f"x{n}", "b", "prod", "low", 7)], edge))
    assert store.read("DEPENDS_ON").count() == 5
    assert sorted(p.name for p in (tmp_path / "s" / "DEPENDS_ON").iterdir() if p.name[0] == "v") == ["v5", "v6"]


def test_operators_bring_their_package(tmp_path):
    """From another folder, on frames read without any helper of the package: workers get it from the operator itself."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from depweft.operators import shred
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.driver.memory", "1g").getOrCreate()
df = spark.createDataFrame([(1, '{{"settings": {{"property": {{"name": "x"}}}}}}')], "bt_row bigint, payload string")
assert shred.build_type_rows(df).count() == 1
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
