import json

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import rows
from pyspark.sql import functions as F

from depweft.operators import shred as module
from depweft.operators.shred import BUILD_TYPE_TABLES, Flat, Leaf, build_type_rows, child, flat_rows, flat_table, level_columns, read_records, rebuild, shred, vcs_root_rows

DEEP = Leaf("steps.step*.properties.property*", "name")
FLAT = Leaf("settings.property*", "name")


def named(df):
    return df.select("row_key", "path", "parent_pos", "pos", child().alias("child"))


def plain(records, leaf):
    """Brute force: walks the documents themselves."""
    out = []
    listed = lambda v: v if isinstance(v, list) else [v]
    for n, r in enumerate(records):
        if leaf is FLAT:
            box = r.get("settings")
            for i, x in enumerate(listed(box.get("property")) if isinstance(box, dict) else [], 1):
                if isinstance(x, dict):
                    out.append((n, 0, i, x.get("name")))
        else:
            box = r.get("steps")
            for i, s in enumerate(listed(box.get("step")) if isinstance(box, dict) else [], 1):
                inner = s.get("properties") if isinstance(s, dict) else None
                for j, x in enumerate(listed(inner.get("property")) if isinstance(inner, dict) else [], 1):
                    if isinstance(x, dict):
                        out.append((n, i, j, x.get("name")))
    return out


def through_levels(records, leaf):
    reps, defs, values = shred(records, leaf)
    r = rebuild(leaf, reps, defs)
    return [(int(a), int(b), int(c), values[e]) for a, b, c, e in zip(r["record"], r["parent_pos"], r["pos"], r["entry"])]


thing = st.recursive(st.none() | st.integers(0, 3) | st.text("ab", max_size=2), lambda x: st.lists(x, max_size=3), max_leaves=3)
prop = st.fixed_dictionaries({}, optional={"name": thing, "value": thing})
many = lambda s: st.none() | s | st.lists(s | thing, max_size=4)
step = st.fixed_dictionaries({}, optional={"id": thing, "properties": thing | st.fixed_dictionaries({}, optional={"property": many(prop)})})
record = st.fixed_dictionaries(
    {},
    optional={
        "settings": thing | st.fixed_dictionaries({}, optional={"property": many(prop)}),
        "steps": thing | st.fixed_dictionaries({}, optional={"step": many(step)}),
    },
)


@settings(max_examples=300, deadline=None)
@given(st.lists(record, max_size=5))
def test_round_trip(records):
    for leaf in (FLAT, DEEP):
        assert through_levels(records, leaf) == plain(records, leaf)


def test_levels_of_a_known_document():
    doc = {"steps": {"step": [{"properties": {"property": [{"name": "a"}, None, {}]}}, {"properties": {}}, {"properties": {"property": {"name": "b"}}}]}}
    reps, defs, values = shred([doc, {}], DEEP)
    assert reps.tolist() == [0, 2, 2, 1, 1, 0]
    assert defs.tolist() == [7, 5, 6, 4, 7, 0]
    assert values == ["a", None, None, None, "b", None]
    assert DEEP.slot_level(1) == 2 and DEEP.slot_level(2) == 5


def test_unusable_documents():
    for text in (None, "", "  ", "{", "[]", "null", "<html>", '"text"', "[1, 2]", "{'a': 1}", "[" * 100_000):
        assert read_records(text, "buildType") == []
    assert read_records("﻿" + json.dumps({"a": 1})) == [{"a": 1}]
    assert read_records(json.dumps(json.dumps({"a": 1}))) == [{"a": 1}]
    assert read_records('{"count": 1, "buildType": [{"a": 1}]}', "buildType") == [{"a": 1}]


def test_frames(spark):
    good = {"settings": {"property": [{"name": "x"}, {"value": "v"}]}, "steps": {"step": {"id": 7, "properties": {"property": {"name": ""}}}}}
    long = {"settings": {"property": [{"name": "n" * 200_000}]}}
    df = spark.createDataFrame(
        [(1, json.dumps(good), "x"), (2, None, "x"), (3, "{bad", "x"), (4, json.dumps(long), "x"), (1, json.dumps(good), "x")], "bt_row bigint, payload string, path string"
    )
    out = rows(named(build_type_rows(df)))
    one = [
        (1, "settings.property", 0, 1, "x"), (1, "settings.property", 0, 2, ""), (1, "steps.step", 0, 1, "7"),
        (1, "steps.step.properties.property", 1, 1, ""),
    ]
    assert out == sorted([*one, *one, (4, "settings.property", 0, 1, "n" * 200_000)], key=repr)
    assert rows(build_type_rows(df.limit(0))) == []
    levels = level_columns(df.filter("bt_row = 4"), "bt_row", "payload", BUILD_TYPE_TABLES[0].leaves[:1])
    assert [r[:5] for r in rows(levels)] == [(4, "settings.property.name", 0, 0, 4)]
    assert rows(flat_table(build_type_rows(df.limit(1)), BUILD_TYPE_TABLES[0])) == [(1, 0, 1, "x", None, None, None, None), (1, 0, 2, None, "v", None, None, None)]


def test_nested_columns(spark):
    schema = "vr_row bigint, properties struct<count:bigint,property:array<struct<name:string,value:string>>>, entry int"
    df = spark.createDataFrame([(1, (2, [("a", "1"), None, (None, "2")]), 0), (2, None, 0), (3, (0, None), 0), (4, (0, []), 0)], schema)
    assert rows(named(vcs_root_rows(df))) == [(1, "properties.property", 0, 1, "a"), (1, "properties.property", 0, 3, "")]
    assert rows(vcs_root_rows(df).select("pos", F.col("leaves")["value"])) == [(1, "1"), (3, "2")]


def test_three_levels_keep_their_places(spark, monkeypatch):
    """The parent's place counts within the grandparent; every repeated ancestor's place is kept."""
    doc = {"a": [{"b": [{"c": [{"n": 1}, {"n": 2}]}]}, {"b": [{"c": []}, {"c": {"n": 3, "m": {"k": [1, "x"]}}}]}, None, {"b": {"c": [None, {"n": 4}]}}]}
    table = Flat("c", "a*.b*.c*", (("n", "", "n"), ("k", "m", "k")))
    df = spark.createDataFrame([(7, json.dumps(doc))], "key bigint, doc string")
    want = [([1, 1, 1], 1, 1, "1", None), ([1, 1, 2], 1, 2, "2", None), ([2, 2, 1], 2, 1, "3", '[1,"x"]'), ([4, 1, 2], 1, 2, "4", None)]
    for flush in (1, 10**6):
        monkeypatch.setattr(module, "FLUSH", flush)
        got = flat_rows(df.unionByName(df), "key", "doc", [table]).select("places", "parent_pos", "pos", F.col("leaves")["n"], F.col("leaves")["k"])
        assert rows(got) == sorted(want * 2, key=repr)


def test_one_walk_shreds_all_leaves():
    class Counted(dict):
        reads = 0

        def get(self, key, default=None):
            Counted.reads += key == "steps"
            return super().get(key, default)

    shredder = module.Shredder([leaf for t in BUILD_TYPE_TABLES for leaf in t.leaves])
    shredder.add(Counted({"steps": {"step": [{"id": "a", "properties": {"property": {"name": "p", "value": 1}}}]}}))
    assert Counted.reads == 1
    assert [c.values for c in shredder.columns if c.leaf.path.startswith("steps")] == [["a"], [None], [None], ["p"], [1], [None], [None], [None]]


def test_rebuild_of_nothing():
    empty = np.array([], dtype=np.int32)
    assert all(len(v) == 0 for v in rebuild(DEEP, empty, empty).values())
