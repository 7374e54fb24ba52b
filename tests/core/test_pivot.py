import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import rows
from depweft.operators import pivot

DAY = dt.datetime(2024, 1, 1)
ATTRS = [("a.flag", "bool"), ("b.size", "int"), ("c.rate", "decimal"), ("d.until", "date"), ("e.text", "text")]
SCHEMA = "entity_id string, env_id string, name string, value string, version bigint, loaded_at timestamp, row_no bigint, attr string, val string"


def frame(spark, cells):
    return spark.createDataFrame([(e, "", n, v, ver, DAY, r, "clash", "clash") for r, (e, n, v, ver) in enumerate(cells)], SCHEMA)


def wide(spark, cells, **kw):
    return pivot.wide_table(frame(spark, cells), pivot.ENTITY, ATTRS, pivot.ORDER, **kw)


@pytest.mark.parametrize(
    "kind, text, value",
    [
        ("int", "1 234", 1234), ("int", "1 234", 1234), ("int", "1,234,567", 1234567), ("int", "+7", 7), ("int", "-0012", -12), ("int", "59.0", 59),
        ("int", "5.5", None), ("int", "1e3", None), ("int", "", None), ("int", "9" * 40, None), ("int", "x" * 100_000, None),
        ("bool", " Yes ", True), ("bool", "OFF", False), ("bool", "enabled", True), ("bool", "2", None), ("bool", "auto", None),
        ("decimal", "10,5", Decimal("10.50")), ("decimal", ".18", Decimal("0.18")), ("decimal", "1000e-2", Decimal("10.00")), ("decimal", "0.125", Decimal("0.13")),
        ("decimal", "1,2,3", None), ("decimal", "n/a", None), ("decimal", "-3", Decimal("-3.00")),
        ("date", "2024-03-01", dt.date(2024, 3, 1)), ("date", "20240301", dt.date(2024, 3, 1)), ("date", "2024/3/1", dt.date(2024, 3, 1)),
        ("date", "01.03.2024", dt.date(2024, 3, 1)), ("date", "1 Mar 2024", dt.date(2024, 3, 1)), ("date", "2024-03-01T10:00:00Z", dt.date(2024, 3, 1)),
        ("date", "2024-02-30", None), ("date", "31.02.2024", None), ("date", "soon", None), ("text", "  x y ", "x y"), ("text", "\t", None),
    ],
)
def test_readers(spark, kind, text, value):
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(pivot.READERS[kind](F.col("v"))).first()[0] == value


def test_one_row_per_entity(spark):
    cells = [
        ("x", "A-Flag", "yes", 1), ("x", "aflag", "no", 2), ("x", "B_SIZE", "3", 1), ("x", " e text ", " t ", 1), ("x", "unknown", "1", 9),
        ("y", "a.flag", "yes", 1), ("y", "a.flag", None, 2), ("z", None, "v", 1),
    ]
    for block in (1, 2, 16):
        out = wide(spark, cells, block=block).select("entity_id", *[f"`{a}`" for a, _ in ATTRS])
        assert rows(out) == [("x", False, 3, None, None, "t"), ("y", None, None, None, None, None)]
    assert rows(pivot.filled_cells(wide(spark, cells), ["entity_id"], ATTRS)) == [("x", "a.flag", "false"), ("x", "b.size", "3"), ("x", "e.text", "t")]
    assert rows(pivot.unmatched_names(frame(spark, cells), ATTRS)) == [("unknown", 1)]


def test_blocks_read_their_cells_and_share_one_bucketing(spark):
    """1,000 attributes: no block shuffles, each reads its own partition, the cells are read twice in all."""
    attrs = [(f"attr.{i:04d}", "int") for i in range(1000)]
    cells = [(f"e{e}", f"Attr-{i:04d}", str(e + i), 1) for e in range(6) for i in range(e, 1000, 97)]
    out = pivot.wide_table(frame(spark, cells), pivot.ENTITY, attrs, pivot.ORDER)
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    blocks = -(-1000 // -(-1000 // pivot.MOST_BLOCKS))
    assert "hashpartitioning" not in plan, "neither groupings nor joins shuffle the bucketed cells"
    assert len(scans) == blocks + 1 and sum("__block" in x.split("PartitionFilters: ")[1].split("PushedFilters")[0] for x in scans) == blocks
    got = {r["entity_id"]: {a: r[a] for a, _ in attrs if r[a] is not None} for r in out.collect()}
    assert got == {f"e{e}": {f"attr.{i:04d}": e + i for i in range(e, 1000, 97)} for e in range(6)}


def test_catalogue_spellings(spark):
    """Spellings that mean one attribute make one column; signs that are no decimal digits do not count."""
    df = spark.createDataFrame([("MaxHeap", "int", "t"), ("max_heap", "text", "t"), ("x²", "int", "t"), ("--", "int", "t")], "attr string, kind string, used_in string")
    attrs = pivot.catalogue(df, "t")
    assert attrs == [("MaxHeap", "int"), ("x²", "int")]
    out = pivot.wide_table(frame(spark, [("e", "MAX HEAP", "5", 1), ("e", "X", "7", 1)]), ["entity_id"], attrs, pivot.ORDER)
    assert rows(out) == [("e", 5, 7)]


def test_repeats_ties_nulls_and_empty(spark):
    cells = [("x", "a.flag", "yes", None), ("x", "a.flag", "no", 1), ("x", "a.flag", "no", 1)]
    assert rows(wide(spark, cells).select("`a.flag`")) == [(False,)]
    assert rows(wide(spark, [])) == []
    assert rows(pivot.wide_table(frame(spark, cells), pivot.ENTITY, [], pivot.ORDER)) == []
    assert rows(pivot.filled_cells(pivot.wide_table(frame(spark, cells), pivot.ENTITY, [], pivot.ORDER), pivot.ENTITY, [])) == []


def test_scopes(spark):
    schema = "ownerid string, scope struct<environment:array<string>,role:array<string>>, name string, value string, version bigint, loaded_at timestamp, var_row bigint"
    df = spark.createDataFrame(
        [("p", None, "n", "v", 1, DAY, 1), ("p", ([], None), "n", "v", 1, DAY, 2), ("p", (["a", "a", None, "b"], []), "n", "v", 1, DAY, 3), (None, None, "n", "v", 1, DAY, 4)], schema
    )
    assert [(r["env_id"], r["row_no"]) for r in pivot.variable_rows(df).orderBy("row_no", "env_id").collect()] == [("", 1), ("", 2), ("a", 3), ("b", 3)]


def test_catalogue_bound(spark):
    df = spark.createDataFrame([(f"a{i}", "int", "t") for i in range(5)] + [("z", "odd", "t"), (None, "int", "t")], "attr string, kind string, used_in string")
    assert len(pivot.catalogue(df, "t")) == 5
    with pytest.raises(ValueError):
        pivot.catalogue(df, "t", most=3)
