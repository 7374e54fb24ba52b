import datetime as dt
import random

from conftest import rows
from depweft import runtime
from depweft.operators import orphans

DAY = dt.datetime(2024, 1, 1)
ROW = "id string, p string, e string, loaded_at timestamp, __key string, field string"
PARENT = "id string, isdeleted boolean, loaded_at timestamp, __at int"


def at(n):
    return DAY + dt.timedelta(days=n)


def found(spark, refs, parents_p, parents_e=(), **kw):
    df = spark.createDataFrame([(i, p, e, t, "clash", "clash") for i, p, e, t in refs], ROW)
    make = lambda rs: spark.createDataFrame([(i, g, t, 0) for i, g, t in rs], PARENT)
    out = orphans.orphan_references(df, {"p": make(parents_p), "e": make(parents_e)}, **kw)
    return rows(out.select("field", "ref_id", "status"))


def test_statuses_and_uneven_keys(spark):
    refs = [
        ("d1", " A ", None, at(5)),
        ("d2", "b", "", at(5)),
        ("d3", "C", "  　", at(5)),
        ("d4", "gone", None, at(5)),
        ("d5", "back", None, at(9)),
    ]
    parents = [
        ("a", False, at(1)), ("B", False, at(9)), ("c", False, at(1)), ("c", True, at(3)),
        ("back", True, at(2)), ("back", False, at(8)),
    ]
    assert found(spark, refs, parents) == [("p", "d2", "later"), ("p", "d3", "deleted"), ("p", "d4", "missing")]


def test_redelivery_ties_nulls(spark):
    refs = [
        ("d1", "x", None, at(5)), ("d1", "x", None, at(5)), ("d1", "x", None, at(9)),
        (None, "x", None, at(5)), ("d2", "x", None, None), ("d3", None, None, at(1)),
    ]
    assert found(spark, refs, []) == [("p", "d1", "missing")]
    both = [("x", True, at(2)), ("x", False, at(2)), ("x", None, at(3))]
    assert found(spark, refs, both) == []
    assert found(spark, refs, [("x", None, None)]) == []


def test_empty_tables(spark):
    assert found(spark, [], []) == []
    assert found(spark, [], [("a", False, at(1))]) == []


def test_against_brute_force_with_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(runtime, "HOT_ROWS", 20)
    rng = random.Random(3)
    keys = ["hot"] * 10 + [f"k{i}" for i in range(15)]
    parents = [(rng.choice(keys[9:]), rng.random() < 0.4, at(rng.randrange(80) / 4)) for _ in range(60)] + [("hot", True, at(10))]
    refs = [(f"d{rng.randrange(150)}", rng.choice(keys + [None]), rng.choice(keys), at(rng.randrange(80) / 4)) for _ in range(300)]
    first = {}
    for i, p, e, t in refs:
        first[i] = min(first.get(i, (t, p or "", e)), (t, p or "", e))
    expected = []
    for i, (t, p, e) in first.items():
        for field, key, states in (("p", p, parents), ("e", e, [])):
            own = {}
            for k, gone, s in states:
                if k == key:
                    own[s] = own.get(s, True) and gone
            if not key:
                continue
            if not own:
                expected.append((field, i, "missing"))
            elif min(own) > t:
                expected.append((field, i, "later"))
            elif own[max(s for s in own if s <= t)]:
                expected.append((field, i, "deleted"))
    assert found(spark, refs, parents, salts=4) == sorted(expected, key=repr)


def test_report(spark):
    df = spark.createDataFrame([("p", "d1", "k", "missing", at(1)), ("p", "d2", "k", "missing", at(2))], "field string, ref_id string, ref_key string, status string, loaded_at timestamp")
    assert rows(orphans.orphan_report(df, "t")) == [("t", "p", "2024-01", "missing", 2, 1)]
