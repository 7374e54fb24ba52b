import datetime as dt

import pandas as pd
import pytest

from conftest import rows
from depweft.operators import moments

UTC = dt.timezone.utc
LOADED = dt.datetime(2024, 6, 1)
SPACES = [("B", "Europe/Berlin", "DMY"), ("N", "America/New_York", "MDY"), ("U", "Etc/UTC", "YMD"), ("K", "Asia/Kolkata", None), ("X", "Nowhere/Land", "DMY"), ("S", "Australia/Sydney", "DMY")]


def spaces(spark):
    return spark.createDataFrame(SPACES, "spaceid string, timezone string, dateorder string")


def result(spark, values, loaded=LOADED):
    df = spark.createDataFrame([("f", f"r{i}", v, s, loaded, "clash") for i, (v, s) in enumerate(values)], "field string, rec_id string, value string, spaceid string, loaded_at timestamp, text string")
    out = {r["rec_id"]: (r["status"], r["utc_us"]) for r in moments.normalised(df.drop("text"), spaces(spark)).collect()}
    return [out[f"r{i}"] for i in range(len(values))]


def us(*a):
    return int(dt.datetime(*a, tzinfo=UTC).timestamp() * 1_000_000)


CASES = [
    ("2024-01-15T10:00:00Z", "B", us(2024, 1, 15, 10)),
    ("2024-01-15t10:00:00z", "B", us(2024, 1, 15, 10)),
    ("  2024-01-15T10:00:00,123Z ", "B", us(2024, 1, 15, 10, 0, 0, 123000)),
    ("2024-01-15T10:00:00.1234567Z", "B", us(2024, 1, 15, 10, 0, 0, 123456)),
    ("2024-01-15T10:00:00", "B", us(2024, 1, 15, 9)),
    ("2024-07-15 10:00", "B", us(2024, 7, 15, 8)),
    ("2024-03-31T02:30:00", "B", us(2024, 3, 31, 1, 30)),
    ("2024-10-27T02:30:00", "B", us(2024, 10, 27, 0, 30)),
    ("2024-10-27 02:30:00 CET", "B", us(2024, 10, 27, 1, 30)),
    ("2024-10-27 02:30:00 CEST", "B", us(2024, 10, 27, 0, 30)),
    ("2024-07-01 10:00:00 IST", "K", us(2024, 7, 1, 4, 30)),
    ("2024-07-01 10:00:00 EST", "B", None),
    ("2024-01-01 10:00:00 AEDT", "S", us(2023, 12, 31, 23)),
    ("2024-01-15T10:00:00-05", "B", us(2024, 1, 15, 15)),
    ("2024-01-15T10:00:00−08:00", "B", us(2024, 1, 15, 18)),
    ("2024-01-15 10:00:00 +0530", "B", us(2024, 1, 15, 4, 30)),
    ("2024-10-27T02:30:00+01:00[Europe/Berlin]", "U", us(2024, 10, 27, 1, 30)),
    ("Tue, 16 Apr 2024 00:13:37 +0200", "N", us(2024, 4, 15, 22, 13, 37)),
    ("Sun, 14 Jan 2024 23:19:24 GMT", "N", us(2024, 1, 14, 23, 19, 24)),
    ("5 Jul 2024 15:49:33 +10:00", "N", us(2024, 7, 5, 5, 49, 33)),
    ("Jan 4, 2024, 12:04 AM", "U", us(2024, 1, 4, 0, 4)),
    ("Jan 4, 2024, 12:04 PM", "U", us(2024, 1, 4, 12, 4)),
    ("04.01.2024 16:25", "N", us(2024, 1, 4, 21, 25)),
    ("20240122T080256Z", "N", us(2024, 1, 22, 8, 2, 56)),
    ("20240105075321", "U", us(2024, 1, 5, 7, 53, 21)),
    ("2024-060T00:00:00Z", "U", us(2024, 2, 29)),
    ("1705467419", "B", 1705467419_000000),
    ("1714026806.531", "B", 1714026806_531000),
    ("1705404776968", "B", 1705404776968_000),
    ("1707920066363000", "B", 1707920066363000),
    ("/Date(1705657681390+0200)/", "B", 1705657681390_000),
    ("03/04/2024 10:00", "B", us(2024, 4, 3, 8)),
    ("3/4/2024 10:00:05 PM", "N", us(2024, 3, 5, 3, 0, 5)),
    ("2024/03/04 10:00", "U", us(2024, 3, 4, 10)),
    ("05/31/2024 10:00", "B", us(2024, 5, 31, 8)),
    ("05/05/2024 10:00", "U", us(2024, 5, 5, 10)),
    ("12.31.2024 10:00", "U", us(2024, 12, 31, 10)),
    ("13/13/2024 10:00", "B", None),
    ("2025-13-04 08:00:00", "U", None),
    ("30.02.2024 10:00", "U", None),
    ("2024-01-15T25:00:00Z", "U", None),
    ("2024-01-15T10:61:00Z", "U", None),
    ("n/a", "U", None),
    ("", "U", None),
    ("0", "U", None),
    ("9" * 50_000, "U", None),
    ("2024-01-15T10:00:00", "X", None),
    ("2024-01-15T10:00:00", None, None),
    ("2024-01-15T10:00:00Z", None, us(2024, 1, 15, 10)),
]


def test_formats(spark):
    out = result(spark, [(v, s) for v, s, _ in CASES])
    wrong = [(c, o) for c, o in zip(CASES, out) if o[1] != c[2]]
    assert not wrong
    assert out[CASES.index(("2024-01-15T10:00:00", "X", None))][0] == "no_zone"


def test_mixture_learns_an_undeclared_order(spark):
    clear = [(f"{d:02d}/02/2024 10:00", "K") for d in range(13, 28)]
    out = result(spark, [*clear, ("03/04/2024 10:00", "K")], dt.datetime(2024, 3, 1))
    assert all(s == "ok" for s, _ in out)
    assert out[-1][1] == us(2024, 4, 3, 4, 30)


def test_mixture_marks_ambiguity(spark):
    values = [("13/02/2024 10:00", "K"), ("02/13/2024 10:00", "K"), ("03/04/2024 10:00", "K")]
    out = result(spark, values, dt.datetime(2024, 12, 1))
    assert [s for s, _ in out] == ["ok", "ok", "ambiguous"]


def test_expectation_maximisation_counts():
    frame = pd.DataFrame({"field": "f", "spaceid": "s", "dateorder": None, "sig": ["slashed:0:x", "slashed:x:0", "slashed:0:0"], "n": [90, 10, 1]})
    out = moments.mixture(frame)
    assert out["choice"].tolist() == ["dmy", "mdy", "ambiguous"]
    assert out["posterior"].iloc[2] == pytest.approx(0.9, abs=0.02)
    declared = moments.mixture(frame.assign(dateorder="DMY", n=[9, 1, 1]))
    assert declared["choice"].tolist() == ["dmy", "mdy", "dmy"], "what is valid in one order only is read so, declared or not"
    assert 0.95 < declared["posterior"].iloc[2] < 1


def test_evidence_overrules_a_wrong_declaration(spark):
    """The source says day first, its values month first: a few of them change nothing, many do, in between stays open."""
    frame = lambda only: pd.DataFrame({"field": "f", "spaceid": "s", "dateorder": "DMY", "sig": ["slashed:x:0", "slashed:0:x", "slashed:0:0"], "n": [only, 5, 7]})
    assert [moments.mixture(frame(n))["choice"].tolist()[2] for n in (2, 300, 5000)] == ["dmy", "ambiguous", "mdy"]
    assert [moments.mixture(frame(n))["choice"].tolist()[:2] for n in (2, 300, 5000)] == [["mdy", "dmy"]] * 3
    values = [(f"{1 + n % 12}/{13 + n % 15}/{1990 + n // 12} 10:00", "B") for n in range(4000)]
    out = result(spark, [*values, ("3/4/2024 10:00", "B"), ("3/4/2024 10:00", "N")], dt.datetime(2024, 12, 31))
    assert all(s == "ok" for s, _ in out)
    assert out[-2][1] == us(2024, 3, 4, 9) and out[-1][1] == us(2024, 3, 4, 15)


def test_nearness_to_the_load_decides_where_counts_do_not(spark):
    out = result(spark, [("03/04/2024 10:00", "K")] * 1 + [("01/02/2024 10:00", "U")], dt.datetime(2024, 4, 4))
    assert out[0] == ("ok", us(2024, 4, 3, 4, 30))


def test_stamped_leaves_out_canonical_and_repeats(spark):
    schema = "id string, created string, spaceid string, loaded_at timestamp"
    df = spark.createDataFrame(
        [("a", "2024-01-01T00:00:00.000+00:00", "B", LOADED), ("a", "x", "B", LOADED), ("a", "x", "B", LOADED), ("b", None, "B", LOADED), (None, "x", "B", LOADED)], schema
    )
    assert [r[:4] for r in rows(moments.stamped([(df, "f", "id", "created")]))] == [("f", "a", "x", "B")]
    assert rows(moments.normalised(moments.stamped([(df.limit(0), "f", "id", "created")]), spaces(spark))) == []
