import random

import pytest

from conftest import rows
from depweft.llm import canonical as k

ENTRIES = [
    (1, "Production", ["live", "prd"]), (2, "Production Europe", ["live eu"]), (3, "Pre-Production", ["preprod"]), (4, "Staging", ["stg"]),
    (5, "Feature Test 1", ["ft1"]), (6, "Feature Test 2", ["ft2"]), (7, "Canary", []), (8, "Quality Assurance", ["qa"]), (9, "Hotfix", ["hf"]),
]
ENTRY = "canon_id bigint, canon_name string, aliases array<string>"
CASES = [
    ("production", 1), (" PRODUCTION!! ", 1), ("01 - PRODUCTIОN", 1), ("Ｐｒｏｄｕｃｔｉｏｎ", 1), ("​production", 1), ("producción", 1), ("[prod]", 1), ("env: prd", 1),
    ("the Porduction environment", 1), ("production (продакшн)", 1), ("Europe, Production", 2), ("prod-eu", 2), ("LIVE/EU", 2), ("ProductionEurope", 2),
    ("pre prd", 3), ("pe-poduction", 3), ("stging", 4), ("stage", 4), ("feature-test #2", 6), ("FEATIRE TEST 1", 5), ("canaries", 7), ("cary", 7), ("q.a.", 8),
    ("quality assur.", 8), ("hot-fixes", 9), ("htfxi", 9), ("Productivity suite", 0), ("test", 0), ("-", 0), ("???", 0), ("x", 0), ("feature test", 0), ("p" * 100_000, 0),
]


@pytest.fixture(scope="module")
def meant(spark):
    df = spark.createDataFrame([(v,) for v, _ in CASES], "v string")
    return {r["name"]: r["canon_id"] for r in k.map_names(df, spark.createDataFrame(ENTRIES, ENTRY)).collect()}


@pytest.mark.parametrize("value, entry", CASES)
def test_meanings(meant, value, entry):
    assert meant[value] == entry



def damerau(a, b):
    """Shortest path over single edits, breadth first, as a model."""
    alphabet, seen, level, n = set(b), {a}, {a}, 0
    while b not in level:
        nxt = set()
        for w in level:
            for i in range(len(w) + 1):
                nxt |= {w[:i] + c + w[i:] for c in alphabet}
                if i < len(w):
                    nxt.add(w[:i] + w[i + 1 :])
                    nxt |= {w[:i] + c + w[i + 1 :] for c in alphabet}
                if i + 1 < len(w):
                    nxt.add(w[:i] + w[i + 1] + w[i] + w[i + 2 :])
        level, n = {w for w in nxt - seen if len(w) <= 6}, n + 1
        seen |= level
    return n


def test_distance_is_the_fewest_edits_and_a_metric():
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(14)]
    for a in words:
        for b in words:
            d = k.distance(a, b)
            assert d == (damerau(a, b) if a != b else 0) == k.distance(b, a)
            assert all(d <= k.distance(a, c) + k.distance(c, b) for c in words)


def test_tree_returns_every_entry_within():
    rng = random.Random(2)
    keys = {"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 8))) for _ in range(300)}
    tree = k.BKTree(keys)
    for q in list(keys)[:40] + ["zzzz", "a"]:
        for radius in (0, 1, 2):
            assert sorted(tree.within(q, radius)) == sorted((k.distance(q, x), x) for x in keys if k.distance(q, x) <= radius)
    assert k.BKTree().within("a", 2) == []


def test_frames(spark, monkeypatch):
    ref = spark.createDataFrame([(*e, "clash") for e in ENTRIES], "canon_id bigint, canon_name string, aliases array<string>, name string")
    typed = ["Production", "Production", "stging", "", "  ", None, "nothing like it", "Europe Production"]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(typed)], "row bigint, v string, dist int")
    expected = [(0, 1), (1, 1), (2, 4), (6, 0), (7, 2)]
    assert rows(k.map_rows(df, "v", ref).select("row", "canon_id")) == expected
    monkeypatch.setattr(k, "small", lambda *_: False)
    monkeypatch.setattr(k, "hot_keys", lambda counts, keys: [r for r in counts.select(*keys).collect() if r[0] == "Production"])
    monkeypatch.setattr(k, "SHARD_VARIANTS", 40)
    assert rows(k.map_rows(df, "v", ref).select("row", "canon_id")) == expected, "shards and the salted join give the same"
    assert rows(k.map_rows(df, "v", ref.limit(0)).select("row", "canon_id")) == [(r, 0) for r, _ in expected]
    assert rows(k.map_rows(df.limit(0), "v", ref)) == []


def test_null_reference_parts(spark):
    ref = spark.createDataFrame([(1, "Production", None), (2, None, ["x"]), (None, "Lost", None)], "canon_id bigint, canon_name string, aliases array<string>")
    df = spark.createDataFrame([("production",), ("lost",)], "v string")
    assert rows(k.map_names(df, ref).select("name", "canon_id")) == [("lost", 0), ("production", 1)]


MANY = ENTRIES + [
    (10, "Prod", []), (11, "Pipeline", []), (12, "Pipelane", []), (13, "Canaries", []), (14, "Blue Green", ["bg"]), (15, "Green Blue", []),
    (16, "Hotfixes", []), (17, "Twins", []), (18, "Twins", []), (19, "Twinsy", []), (20, "Sandbox", ["sbx"]), (21, "Sandbox Asia", ["sbx as"]), (22, "Asia", []),
]


def typed_of(entries, seed):
    rng = random.Random(seed)
    typed = {"prod", "prd eu", "live europe", "asia sbx", "sandbox as", "prod europe", "twins", "twin", "twinsy", "pipelne", "pipelime", "pipel", "canary", "canarie", "bluegreen", "green", "blue gren", "STAGING US", "PROD EU", "test"}
    for _, name, aliases in entries:
        for v in [name, *aliases]:
            typed |= {v, v[:5], v[::-1], " ".join(v.split()[::-1])}
            for _ in range(4):
                i = rng.randrange(len(v))
                typed.add(v[:i] + rng.choice(["", v[i] + "e", "x"]) + v[i + 1 :])
    return sorted(typed)


def test_any_number_of_shards_gives_one_answer(spark, data, monkeypatch):
    canon = [tuple(r) for r in spark.read.parquet(f"{data}/env_reference.parquet").select("canon_id", "canon_name", "aliases").collect()]
    for entries in (MANY, canon):
        ref = spark.createDataFrame(entries, ENTRY)
        df = spark.createDataFrame([(v,) for v in typed_of(entries, 3)], "v string")
        monkeypatch.setattr(k, "SHARD_VARIANTS", 10**6)
        want = rows(k.map_names(df, ref))
        n = k.variants(ref).count()
        if entries is MANY:
            assert {(n, i) for n, i, _ in want} >= {("prod", 10), ("prd eu", 2), ("asia sbx", 21), ("twins", 0)}
        assert len({i for _, i, _ in want}) > 10
        for shards in (2, 7):
            monkeypatch.setattr(k, "SHARD_VARIANTS", -(-n // shards))
            assert rows(k.map_names(df, ref)) == want


def test_look_up_equals_a_scan_of_all_variants(spark):
    """Brute force: every variant of the reference compared with every value, without tree, shards or aggregation."""
    ref = spark.createDataFrame(MANY, ENTRY)
    known = [tuple(r) for r in k.variants(ref).select("key", "id", "allowed", "name").collect()]
    typed = typed_of(MANY, 5)

    def scan(value):
        words, key = " ".join(k.words_of(value)), k.key_of(value)
        d = k.distances(*k._codes([key] * len(known), -1), *k._codes([v for v, *_ in known], -2))
        near = [(x, i, n) for x, (_, i, most, n) in zip(map(int, d), known) if key and x <= most]
        least = min((d for d, _, _ in near), default=None)
        tied = sorted({(k.distance(words, n) if d else 0, i) for d, i, n in near if d == least})
        ids = {i for away, i in tied if away == tied[0][0]}
        return (value, ids.pop(), least) if len(ids) == 1 else (value, 0, None)

    assert rows(k.map_names(spark.createDataFrame([(v,) for v in typed], "v string"), ref)) == sorted(map(scan, typed), key=repr)


def test_long_names_have_orders_and_cut_forms(spark):
    ref = spark.createDataFrame([(1, "Alpha Bravo Charlie Delta Echo Foxtrot", []), (2, "Alpha Bravo", None)], ENTRY)
    typed = ["bravo charlie delta echo foxtrot alpha", "foxtrot bravo charlie delta echo alpha", "alpha bravo charl delta echo foxtrot", "Alpha Bravo Chralie Delta Echo Foxtrto", "alpha brav"]
    got = {r["name"]: r["canon_id"] for r in k.map_names(spark.createDataFrame([(v,) for v in typed], "v string"), ref).collect()}
    assert got == dict(zip(typed, [1, 1, 1, 1, 2]))
    assert len(k.variants_of(tuple(f"word{c}" for c in "abcdefghij"), [], [])) < 10 * 60 * 8, "variants grow with the square of the words"
