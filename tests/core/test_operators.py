from pyspark.sql import functions as F

from conftest import rows
from depweft.functions import tokens as T
from depweft.functions import urls as U
from depweft.operators import attribution, build, extract, identity, judge, reconcile, resolve


def col(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


def test_urls(spark):
    cases = {
        "HTTPS://user@WWW.Example.com.:8443/A/b/?q=1#x": "example.com/A/b", "example.com": "example.com/", "http://h/": "h/", "https://{tok}/x y": "{tok}/x y", "": "/",
    }
    assert {k: col(spark, k, U.normalise_url) for k in cases} == cases
    for url in ("https://Git.x/a/B.git", "git@git.x:a/b.git", "ssh://git@git.x:7999/a/b", "http://git.x/a/b/"):
        assert col(spark, url, U.normalise_git_url) == "git.x/a/b"
    assert col(spark, "no-scheme/x", U.host_of) is None
    assert tuple(col(spark, "p:o/n/m", U.full_name_parts)) == ("p", "o", "n/m")
    assert tuple(col(spark, "bad", U.full_name_parts)) == (None, None, None)


def test_tokens(spark):
    text = "{a} #{b-1} ${c.d} %(e)% <%$ AppSettings: f %> {1x} {}"
    assert sorted(col(spark, text, T.tokens_in)) == ["a", "b-1", "c.d", "e", "f"]
    assert col(spark, "x #{t} {t} ${t}", lambda c: T.substitute(c, F.lit("t"), F.lit("V$1"))) == "x V$1 V$1 V$1"
    assert col(spark, "HTTPServerBaseUrl2X", T.camel_to_kebab) == "http-server-base-url2-x"
    assert col(spark, "token=abc&key=x Basic QQ==", T.redact) == "token=[REDACTED]&key=[REDACTED] Basic [REDACTED]"
    assert col(spark, 'a\n Key = no\nKEY=v=1 \nkey=w', lambda c: T.value_from_logs(c, F.lit("key"))) == "v=1"
    assert col(spark, '["a","b"]', T.evidence_list) == ["a", "b"] and col(spark, "plain", T.evidence_list) == ["plain"] and col(spark, None, T.evidence_list) == []


def test_residency_order(spark):
    trigger = lambda g, k, v: spark.createDataFrame([(g, k, v)], "g string, k string, v string").select(T.residency_trigger(F.col("g"), F.col("k"), F.col("v"))).first()[0]
    assert trigger("x", "email", "a@b.co 555-123-4567") == "email"
    assert trigger("x", "k", "555-123-4567") == "phone"
    assert trigger("x", "Email", None) == "field:email"
    assert trigger("find the owner", "k", "v") == "goal"
    assert trigger("ownership", "k", None) is None


def index(spark, ids):
    return identity.build_index(spark.createDataFrame([(r, r, c, v, e) for r, c, v, e in ids], "owner string, repo string, identity_class string, value string, env string"))


def refs(spark, rs):
    return spark.createDataFrame(rs, "ref_id string, value string, env string")


def test_projection_tiers(spark):
    ix = index(
        spark,
        [
            ("exact", "network", "https://a.x/p", "prod"), ("norm", "network", "http://WWW.a.x:80/p/", "prod"), ("host", "network", "https://b.x", "prod"),
            ("any", "network", "https://c.x", None), ("other", "network", "https://c.x", "dev"), ("lone", "network", "https://d.x", "dev"), ("tag", "service-tag", "Svc", None),
        ],
    )
    rs = refs(spark, [("1", "https://a.x/p", "prod"), ("2", "http://a.x/p?q", "prod"), ("3", "https://b.x/deep", "PROD"), ("4", "https://c.x", "prod"), ("5", "https://d.x/z", "prod"), ("6", "https://no.x", "prod"), ("7", None, "prod")])
    out = [r[:2] + r[3:5] for r in rows(identity.project(rs, ix))]
    assert out == [("1", "exact", 0, 0), ("2", "exact", 1, 0), ("2", "norm", 1, 0), ("3", "host", 3, 0), ("4", "any", 0, 1), ("5", "lone", 3, 2)]
    assert {r[0] for r in rows(identity.project(rs, ix, strict_env=True))} == {"1", "2", "3", "4"}
    assert {r[0] for r in rows(identity.project(rs, ix, host_fallback=False))} == {"1", "2", "4"}


def test_services(spark):
    ix = index(spark, [("r1", "service-tag", "Web", None), ("r2", "network", "https://api.x.y", None), ("r3", "network", "https://dup.x", "prod"), ("r4", "network", "https://dup.z", None), ("r5", "network", "https://api.x.y", "prod")])
    names = spark.createDataFrame([(s,) for s in ("Web", "web", "api", "api.x", "dup", "none")], "service string")
    out = {r["service"]: (r["repo"], r["reason"]) for r in identity.resolve_services(names, ix).collect()}
    assert out["Web"] == ("r1", None) and out["web"] == (None, "no-match") and out["none"] == (None, "no-match")
    assert out["api"][1] == out["api.x"][1] == out["dup"][1] == "ambiguous"


def test_store_order_and_secrets(spark):
    tokens = spark.createDataFrame([("1", "Key", "prod"), ("2", "Only", "prod"), ("3", "sec", "prod")], "ref_id string, name string, env string")
    store = spark.createDataFrame(
        [("key", "plain", None, False, 0, 0), ("KEY", "scoped", "prod", False, 0, 1), ("only", "dev", "dev", False, 0, 2), ("sec", "hidden", "PROD", True, 0, 3), ("sec", "later", None, False, 1, 0)],
        "key string, value string, env string, is_secret boolean, store_ord int, ord int",
    )
    assert rows(resolve.from_store(tokens, store)) == [("1", "plain", False), ("3", None, True)]
    out = {r["ref_id"]: (r["value"], r["rung"], r["resolved"]) for r in resolve.ladder(tokens, [spark.createDataFrame([("2", None)], "ref_id string, value string"), resolve.from_store(tokens, store)]).collect()}
    assert out == {"1": ("plain", 2, True), "2": (resolve.EXHAUSTED, 3, False), "3": (resolve.UNREADABLE, 2, False)}


def test_best_scoped(spark):
    schema = "k string, value string, scope struct<environment:array<string>,role:array<string>>"
    df = spark.createDataFrame(
        [("a", "none", None), ("a", "prod", (["Prod "], None)), ("a", "dev", (["dev"], ["web"])), ("b", "x", (["prod"], [])), ("b", "y", (["PROD"], None)), ("c", "only-dev", (["dev"], None)), ("d", "u", ([], [])), ("d", "dev", (["dev"], None))], schema
    )
    out = rows(resolve.best_scoped(df, ["k"], "prod").select("k", "value", "ambiguous"))
    assert out == [("a", "prod", False), ("b", "x", True), ("b", "y", True), ("c", "only-dev", False), ("d", "u", False)]


def test_reconcile(spark):
    pair = lambda ps: spark.createDataFrame(ps, "from_id string, to_id string")
    out = rows(reconcile.three_way(pair([("a", "b"), ("a", "c")]), pair([("a", "b"), ("a", "b"), ("x", "y")])))
    assert out == [("a", "b", "confirmed"), ("a", "c", "static-only"), ("x", "y", "runtime-only")]
    seen = spark.createDataFrame(
        [("a", "b", "prod", "medium", None, 1, [("t", "2")]), ("a", "b", "prod", "high", "r2", 2, [("t", "1"), ("t", "2")]), ("a", "b", "prod", "low", "r3", 3, None)],
        "from_id string, to_id string, env string, confidence string, deployed_ref string, ord int, evidence array<struct<source_type:string,locator:string>>",
    )
    row = reconcile.deduplicated(seen).first()
    assert (row["confidence"], row["deployed_ref"], [(e["locator"], e["n"]) for e in row["evidence"]]) == ("high", "r2", [("1", 1), ("2", 2)])


def test_extraction(spark):
    files = spark.createDataFrame(
        [
            ("r", "a/home.aspx", "<p>\n<iframe id=1 SRC=\"{base-url}/x\"/><script src='a.js'></script>\n<link href='#{cdn}/s.css'>"),
            ("r", ".env.prod", "# A=https://no.example.com\nexport A='https://a.example.com/x'\nB=plain\nC=http://c.example.com"),
            ("r", "package.json", "{}"), ("q", "x.cs", None), ("q", "web.config", "<bad"), ("q", "appsettings.json", '{"A":{"BaseUrl":"x","N":1}}'),
        ],
        "repo string, path string, content string",
    )
    text = extract.lines(files)
    assert rows(extract.markup_references(text).select("kind", "raw_value", "tokens", "evidence")) == [("iframe", "{base-url}/x", ["base-url"], "a/home.aspx:2"), ("link", "#{cdn}/s.css", ["cdn"], "a/home.aspx:3")]
    assert rows(extract.dotenv_values(text).select("key", "value")) == [("A", "https://a.example.com/x"), ("C", "http://c.example.com")]
    assert rows(extract.repo_kinds(files)) == [("q", False, True, False), ("r", True, False, True)]
    assert rows(extract.xml_settings(files)) == []
    assert [r[2:] for r in rows(extract.json_settings(files))] == [("A.BaseUrl", "BaseUrl", "x")]
    assert rows(extract.file_facts(files).select("key", "value", "condition")) == [("A:BaseUrl", "x", None), ("A:N", "1", None)]


def test_attribution(spark):
    providers = spark.createDataFrame([("r", "gh", ["build", "deploy"]), ("r", "octo", ["deploy"]), ("q", "gh", ["build", "deploy"])], "repo string, provider string, roles array<string>")
    assert rows(attribution.resolved_roles(providers)) == [("q", "gh", ["build", "deploy"]), ("r", "gh", ["build"]), ("r", "octo", ["deploy"])]
    urls = spark.createDataFrame([("1", "ssh://git@h:7/scm/Org/App.git"), ("2", "https://h/org/other"), ("3", None), ("4", "https://h/xorg/app")], "root_id string, url string")
    repos = spark.createDataFrame([("Org/app",)], "full_name string")
    assert rows(attribution.repository_bindings(urls, repos)) == [("1", "Org/app")]
    projects = spark.createDataFrame([("p", None, ["https://h/a/b", "https://h/org/app"]), ("q", "https://h/org/app.git", None), ("s", None, ["x"] * 5 + ["https://h/org/app"])], "project string, persistence_url string, build_urls array<string>")
    assert rows(attribution.projects_of_slugs(projects, repos)) == [("p", "Org/app"), ("q", "Org/app")]


def test_build_edges(spark):
    ix = index(spark, [("ui", "network", "https://ui.x", "prod")])
    rs = spark.createDataFrame([("1", "web", "https://ui.x/a", "prod", True, None), ("2", "web", "https://ui.x/a", "prod", False, None), ("3", "web", "https://ui.x", "prod", False, "low")], "ref_id string, repo string, value string, env string, injected boolean, confidence string")
    deployed = spark.createDataFrame([("web", "prod", "abc")], "repo string, env string, sha string")
    out = build.candidate_edges(rs, ix, deployed)
    assert rows(out.select("ref_id", "to_id", "provenance", "confidence", "deployed_ref", "expands")) == [("1", "ui", "injected", "high", "abc", True), ("3", "ui", "declared", "low", "abc", False)]
    assert rows(build.built_graph(out, "web", "prod").select("from_id", "to_id", "provenance", "deployed_ref")) == [("web", "ui", "injected", "abc")]


def test_judge_dispositions(spark):
    ix = index(spark, [("ui", "network", "https://ui.x", "prod")])
    kinds = [("1", "ambiguous-match"), ("2", "ambiguous-match"), ("3", "unresolved-ref"), ("4", "identity-class"), ("5", "odd")]
    items = spark.createDataFrame([(i, k, "1", "web", "prod", False, "k", "v", ["a"]) for i, k in kinds] + [("6", "unresolved-ref", "1", "web", "prod", False, "k", "v", ["a"] * 21)], "ref_id string, kind string, version string, from_id string, env string, is_secret boolean, key string, value string, locators array<string>")
    keys = {r["ref_id"]: r["k"] for r in items.select("ref_id", judge.cache_key(judge.goal_of(F.col("kind"), F.col("ref_id")), F.col("locators"), F.col("version")).alias("k")).collect()}
    answers = spark.createDataFrame(
        [(keys["1"], "ground-to-candidate", "https://ui.x", None, None, "yes"), (keys["2"], "ground-to-candidate", None, None, None, "yes"), (keys["3"], None, None, None, None, "none"), (keys["4"], None, None, None, "network", "is"), (keys["5"], None, None, "x", None, "r")],
        "cache_key string, decision string, candidate string, value string, identity_class string, reasoning string",
    )
    out = judge.judged(items, answers, ix)
    assert [r[:2] for r in rows(out.select("ref_id", "disposition"))] == [("1", "edge"), ("2", "malformed"), ("3", "no-proposal"), ("4", "no-proposal"), ("5", "malformed"), ("6", "over-budget")]
    assert rows(judge.judged_edges(out)) == [("web", "ui", "prod", "llm-judged", "low")]
    assert judge.mode(None, "hybrid") == "hybrid" and judge.mode(None) == "structured"


def test_hot_identity_is_salted(spark, monkeypatch):
    """A gateway that most references name: the same candidates as by broadcast, with its rows copied for salts only."""
    ids = [("r1", "network", "gw.example.com", "prod"), ("r2", "network", "gw.example.com", None), ("r3", "network", "api.example.com", "prod")]
    asked = [(f"x{i}", "https://gw.example.com/a", "prod") for i in range(60)] + [("y", "https://api.example.com/b", "dev")]
    want = rows(identity.project(refs(spark, asked), index(spark, ids)))
    seen = []
    join = identity.salted_join
    monkeypatch.setattr(identity, "small", lambda df: False)
    monkeypatch.setattr("depweft.runtime.HOT_ROWS", 20)
    monkeypatch.setattr(identity, "salted_join", lambda a, b, keys, hot, by: seen.append(len(hot)) or join(a, b, keys, hot, by))
    assert rows(identity.project(refs(spark, asked), index(spark, ids))) == want
    assert seen and seen[0] > 0 and len(want) == 61


def test_salted_join_keeps_nulls_and_all_rows(spark):
    from depweft.runtime import salted_join

    left = spark.createDataFrame([("a", i) for i in range(40)] + [("b", 99), (None, 100), ("c", 101)], "k string, n int")
    right = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), (None, "w")], "k string, v string")
    hot = [r for r in right.select("k").distinct().collect() if r["k"] == "a"]
    for how in ("inner", "left"):
        assert rows(salted_join(left, right, ["k"], hot, ["n"], how)) == rows(left.join(right, ["k"], how))


def test_store_folds_before_it_joins(spark):
    """A key that every owner has: the store meets the tokens by owner, in list order, over all environments of a scope."""
    store = spark.createDataFrame(
        [("o1", "Url", "one", ["Prod", "dev"], False, 1, 1), ("o1", "url", "later", ["prod"], False, 1, 2), ("o2", "URL", "any", None, False, 1, 1), ("o2", "url", "p", ["prod"], False, 0, 9), ("o3", "url", "s", [], True, 1, 1), ("o4", "url", "x", ["qa"], False, 1, 1)],
        "owner string, key string, value string, env array<string>, is_secret boolean, store_ord int, ord int",
    )
    asked = spark.createDataFrame([(f"t{i}", f"o{i}", "url", "PROD") for i in range(1, 5)], "ref_id string, owner string, name string, env string")
    assert rows(resolve.from_store(asked, store)) == [("t1", "one", False), ("t2", "p", False), ("t3", None, True)]


def test_logs_are_taken_apart_before_they_join(spark):
    logs = spark.createDataFrame([("r", "prod", "x\n URL=\nurl = no\r\nUrl=first=1 \nURL=second", 1), ("r", "prod", "URL=zero", 0), ("q", "prod", "=v\nNAME=n", 0)], "repo string, env string, log string, ord int")
    asked = spark.createDataFrame([("t1", "r", "url", "prod"), ("t2", "q", "Name", "prod"), ("t3", "q", "Name", "dev")], "ref_id string, repo string, name string, env string")
    assert rows(resolve.from_logs(asked, logs)) == [("t1", "zero"), ("t2", "n")]
    assert rows(resolve.from_logs(asked, logs.filter("ord > 0"))) == [("t1", "first=1")]


def test_file_facts_order_and_forms(spark):
    files = spark.createDataFrame(
        [
            ("r", "b/appsettings.prod.eu.json", '{"A": {"n": 1.50, "t": true, "z": null, "l": [1, {"x": 2}]}}'), ("r", "appsettings.prod.json", '{"A": {"n": 1e2}}'),
            ("r", "a/AppSettings.json", '\ufeff{"A": {"n": "base"}}'), ("r", "x/appsettings.json", "{bad"),
            ("r", "Web.config", '<c><appSettings><add key="k" value="1"/><add key="n"/></appSettings><appSettings><add key="k" value="2"/></appSettings></c>'),
        ],
        "repo string, path string, content string",
    )
    out = [tuple(r) for r in extract.file_facts(files).orderBy("rank", "source", "key").select("source", "key", "value", "condition", "rank").collect()]
    assert out == [
        ("Web.config", "k", "1", None, 1), ("a/AppSettings.json", "A:n", "base", None, 1), ("appsettings.prod.json", "A:n", "1e2", "appsettings.prod.json", 2),
        ("b/appsettings.prod.eu.json", "A:l", '[1,{"x":2}]', "appsettings.prod.eu.json", 3), ("b/appsettings.prod.eu.json", "A:n", "1.50", "appsettings.prod.eu.json", 3),
        ("b/appsettings.prod.eu.json", "A:t", "true", "appsettings.prod.eu.json", 3), ("b/appsettings.prod.eu.json", "A:z", "", "appsettings.prod.eu.json", 3),
    ]


def test_static_assets(spark):
    for value, static in (("/a/b.WOFF2?v=1", True), ("/a.jpeg", False), ("/{x}.css", False)):
        assert col(spark, value, extract.is_static_asset) is static
