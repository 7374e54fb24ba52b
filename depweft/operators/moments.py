"""Mixed timestamp texts and time zones brought to one unambiguous moment in UTC.

1. ``parsed`` parses each text under every format of a fixed grammar. A format yields plain fields (year to fraction, a
   zone if written); most texts fit one format, dates with slashes or dots may be valid day first and month first.
2. Per source (column and space) the mixture of formats is estimated by expectation-maximisation over all its values. A
   value contributes likelihood under each valid parse: how near that parse lies to the time the row was loaded. What is
   declared of a source (its date order for slashes, day first for dots) is a prior of ``DECLARED`` pseudo-counts against
   ``OTHER``: strong, but a source whose values tell otherwise often enough overrules it. Values enter as counts of
   signatures (which parses are valid, how near each is), so the estimate reads all rows and its input per source stays
   bounded.
3. The posterior chooses each value's parse; below ``CERTAIN`` the value is marked ambiguous and gets no moment. A value
   that is valid in one order only is read in that order, declared or not.

Local times use the source's zone: a time that occurs twice is the earlier moment, a skipped one moves on by the gap.
Zone letters are those of the source's own zone; GMT, UTC, UT and Z mean UTC everywhere.

Defined results: null, blank and unreadable texts and impossible dates have status 'unreadable'; texts without a zone
from a source without a known one have 'no_zone'; repeated rows count once; empty tables give no rows.
"""

from __future__ import annotations

import datetime as dt
import zoneinfo
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depweft.functions.text import one_space
from depweft.runtime import broadcast_if_small, cut, ship

CERTAIN = 0.95
ROUNDS = 200
#: Pseudo-counts of a declared order, of its opposite, and of both where none is declared.
DECLARED, OTHER, OPEN = 100.0, 0.01, 0.01
#: Likelihood of a parse by its distance to the load time: within a week, within a quarter, further.
NEARNESS = (1.0, 0.25, 0.02)
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}\+00:00$"

_MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
_ZONE = r"(Z|[A-Z]{2,5}|[+-]\d{2}(?::?\d{2})?)?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"

#: format: (pattern on the cleaned upper-case text, fields as Y|M|D|h|m|s|fraction|half|zone). Fixed values.
GRAMMAR = {
    "iso": (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})[T ]{_CLOCK} ?{_ZONE}(?:\[[A-Z_/+-]+\])?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    "compact": (rf"^(\d{{4}})(\d{{2}})(\d{{2}})T?(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d+))?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    "ordinal": (rf"^(\d{{4}})-(\d{{3}})[T ]{_CLOCK} ?{_ZONE}$", "$1|O|$2|$3|$4|$5|$6||$7"),
    "dotted": (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}) {_CLOCK} ?{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    "mail": (rf"^(?:[A-Z]{{3,9}}, ?)?(\d{{1,2}}) ([A-Z]{{3}})[A-Z]* (\d{{4}}) {_CLOCK} ?{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    "named": (rf"^([A-Z]{{3}})[A-Z]* (\d{{1,2}}), (\d{{4}}),? {_CLOCK} ?(AM|PM)? ?{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
}
_SLASHED = rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}) {_CLOCK} ?(AM|PM)? ?{_ZONE}$"
_EPOCH = r"^(?:\d{9,10}(?:[.,]\d+)?|\d{12,13}|\d{15,16}|\d{18}|/DATE\(-?\d{1,15}(?:[+-]\d{4})?\)/)$"
_SLASHED_YEAR = rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}}) {_CLOCK} ?(AM|PM)? ?{_ZONE}$"
#: Formats whose first two numbers may be day and month in either order, with the names of both readings.
EITHER = {"slashed": ("dmy", "mdy"), "dotted": ("dotted_dmy", "dotted_mdy")}


def cleaned(c: Column) -> Column:
    """Upper case, plain minus signs, white space made single."""
    return F.upper(F.translate(one_space(c), "−–", "--"))


def _offset(zone: Column) -> Column:
    """A written numeric offset as +hh:mm."""
    digits = F.regexp_replace(zone, r"[:+-]", "")
    return F.concat(F.substring(zone, 1, 1), F.substring(digits, 1, 2), F.lit(":"), F.rpad(F.substring(digits, 3, 2), 2, "0"))


def moment_of(p: Column, home: Column, letters: Column) -> Column:
    """Microseconds since 1970 of [Y, M, D, h, m, s, fraction, half, zone]; null if impossible or without a zone."""
    number = lambda i: F.when(p[i].rlike(r"^\d{1,9}$"), p[i]).otherwise("0").cast("int")
    months = F.create_map(*[x for n, m in enumerate(_MONTHS, 1) for x in (F.lit(m), F.lit(n))])
    month = F.when(p[1] == "O", 1).when(p[1].rlike(r"^\d"), number(1)).otherwise(F.try_element_at(months, p[1]))
    day = F.when(p[1] == "O", 1).otherwise(number(2))
    hour = F.when(p[7] == "", number(3)).when(number(3).between(1, 12), number(3) % 12 + F.when(p[7] == "PM", 12).otherwise(0))
    second = F.concat(F.when(p[5] == "", "0").otherwise(p[5]), F.lit("."), F.rpad(F.substring(p[6], 1, 6), 6, "0")).cast("decimal(16,6)")
    zone = (
        F.when(p[8] == "", home)
        .when(p[8].isin("Z", "UTC", "GMT", "UT"), "UTC")
        .when(p[8].rlike(r"^[+-]"), _offset(p[8]))
        .otherwise(F.try_element_at(letters, p[8]))
    )
    valid_zone = F.when(zone.rlike(r"^[+-]") & ~zone.rlike(r"^[+-](0\d|1[0-8]):[0-5]\d$"), None).otherwise(zone)
    made = F.unix_micros(F.try_make_timestamp(number(0), month, day, hour, number(4), second, valid_zone))
    ordinal_day = F.when(p[1] == "O", number(2) - 1).otherwise(0)
    ok = (p[1] != "O") | number(2).between(1, 366)
    return F.when(ok & (number(4) < 60), made + ordinal_day * F.lit(86_400_000_000))


def epoch_micros(text: Column) -> Column:
    """Microseconds of a bare number of seconds, millis or micros, or of a /Date(millis+zone)/ literal."""
    date_literal = F.regexp_extract(text, r"^/DATE\((-?\d{1,15})(?:[+-]\d{4})?\)/$", 1)
    whole = F.when(text.rlike(r"^\d{1,18}$"), text).try_cast("bigint")
    return (
        F.when(date_literal != "", date_literal.try_cast("bigint") * 1000)
        .when(text.rlike(r"^\d{9,10}$"), whole * 1_000_000)
        .when(text.rlike(r"^\d{9,10}[.,]\d+$"), _seconds(text))
        .when(text.rlike(r"^\d{12,13}$"), whole * 1000)
        .when(text.rlike(r"^\d{15,16}$"), whole)
        .when(text.rlike(r"^\d{18}$"), F.floor(whole / 1000))
    )


def _seconds(text: Column) -> Column:
    whole = F.regexp_extract(text, r"^(\d+)[.,]", 1).try_cast("bigint")
    part = F.rpad(F.substring(F.regexp_extract(text, r"[.,](\d+)$", 1), 1, 6), 6, "0").try_cast("bigint")
    return whole * 1_000_000 + part


def parsed(df: DataFrame) -> DataFrame:
    """Adds every valid parse of ``text``: ``fmt`` with ``us_a``, for dates with slashes or dots also ``us_b`` (month first).

    Needs ``text`` (cleaned), ``home`` (zone name) and ``letters`` (map of zone letters to offsets).
    """
    text = F.col("text")
    pattern = {name: p for name, (p, _) in GRAMMAR.items()} | {"epoch": _EPOCH, "slashed": _SLASHED, "ymd": _SLASHED_YEAR}

    def first(*names: str) -> Column:
        """The first format that fits; whether a text may fit at all is told by a character before any pattern is tried."""
        return reduce(lambda chain, n: chain.when(text.rlike(pattern[n]), n), names[1:], F.when(text.rlike(pattern[names[0]]), names[0]))

    fmt = (
        F.when(F.substring(text, 5, 1) == "-", first("iso", "ordinal"))
        .when(F.contains(text, F.lit("/")), first("slashed", "ymd", "epoch"))
        .otherwise(first("epoch", "mail", "dotted", "compact", "named"))
    )
    by_format = F.col("fmt")
    fields = F.when(by_format == "slashed", F.regexp_replace(text, _SLASHED, "$3|$2|$1|$4|$5|$6|$7|$8|$9")).when(
        by_format == "ymd", F.regexp_replace(text, _SLASHED_YEAR, "$1|$2|$3|$4|$5|$6|$7|$8|$9")
    )
    for name, (form, order) in GRAMMAR.items():
        fields = fields.when(by_format == name, F.regexp_replace(text, form, order))
    swapped = F.when(by_format == "slashed", F.regexp_replace(text, _SLASHED, "$3|$1|$2|$4|$5|$6|$7|$8|$9")).when(
        by_format == "dotted", F.regexp_replace(text, GRAMMAR["dotted"][0], "$3|$1|$2|$4|$5|$6|$7||$8")
    )
    home, letters = F.col("home"), F.col("letters")
    return (
        df.withColumn("fmt", fmt)
        .withColumn("__a", F.split(fields, r"\|", -1))
        .withColumn("__b", F.split(swapped, r"\|", -1))
        .withColumn("us_a", F.when(by_format == "epoch", epoch_micros(text)).otherwise(moment_of(F.col("__a"), home, letters)))
        .withColumn("us_b", moment_of(F.col("__b"), home, letters))
        .withColumn("no_zone", F.col("home").isNull() & (F.try_element_at(F.col("__a"), F.lit(9)) == ""))
        .drop("__a", "__b")
    )


def signature(df: DataFrame) -> DataFrame:
    """Adds ``sig``: the format and how near each valid parse lies to the load time ('x' if there is none)."""
    day = 86_400_000_000

    def level(us: Column) -> Column:
        away = F.abs(us - F.unix_micros("loaded_at"))
        return F.when(us.isNull(), "x").when(away <= 7 * day, "0").when(away <= 92 * day, "1").otherwise("2")

    alike = F.col("us_a") == F.col("us_b")  # 03/03: either order, one moment, and no evidence for an order
    named = F.when(alike, "alike").otherwise(F.coalesce("fmt", F.lit("none")))
    return df.withColumn("sig", F.concat_ws(":", named, level(F.col("us_a")), F.when(alike, "x").otherwise(level(F.col("us_b")))))


def _readings(sig: str) -> list[tuple[str, float]]:
    """The parses that a signature allows, with their likelihood."""
    fmt, a, b = sig.split(":")
    return [(n, NEARNESS[int(x)]) for n, x in zip(EITHER.get(fmt, (fmt, "")), (a, b)) if x != "x"]


_POSTERIOR = "field string, spaceid string, sig string, n bigint, choice string, posterior double"


def mixture(counts: pd.DataFrame) -> pd.DataFrame:
    """Expectation-maximisation over one source's signature counts: the choice for each signature and its posterior."""
    declared = {"dotted_dmy": "dotted_mdy"} | {"DMY": {"dmy": "mdy"}, "MDY": {"mdy": "dmy"}}.get(str(counts["dateorder"].iloc[0]).strip().upper(), {})
    readings = [_readings(s) for s in counts["sig"]]
    names = sorted({n for r in readings for n, _ in r})
    prior = np.array([DECLARED if n in declared else OTHER if n in declared.values() else OPEN for n in names])
    weight = np.zeros((len(readings), len(names)))
    for i, r in enumerate(readings):
        for n, likelihood in r:
            weight[i, names.index(n)] = likelihood
    n = counts["n"].to_numpy(dtype=float)
    share = prior / max(prior.sum(), 1.0)
    posterior = np.zeros_like(weight)
    for _ in range(ROUNDS if names else 0):
        posterior = weight * share
        total = posterior.sum(axis=1, keepdims=True)
        posterior = np.divide(posterior, total, out=np.zeros_like(posterior), where=total > 0)
        new = prior + (posterior * n[:, None]).sum(axis=0)
        new = new / new.sum()
        if np.abs(new - share).max(initial=0.0) < 1e-12:
            break
        share = new
    best = posterior.argmax(axis=1) if names else np.zeros(len(readings), dtype=int)
    top = posterior.max(axis=1) if names else np.zeros(len(readings))
    choice = [names[b] if t >= CERTAIN else ("ambiguous" if t > 0 else None) for b, t in zip(best, top)]
    return pd.DataFrame({"field": counts["field"], "spaceid": counts["spaceid"], "sig": counts["sig"], "n": counts["n"], "choice": choice, "posterior": top})


def zone_letters(spark: SparkSession, spaces: DataFrame) -> DataFrame:
    """``spaceid, home, letters, dateorder`` of each space; zone names are bounded by the zone database.

    Of several rows of one space the greatest (timezone, dateorder) counts.
    """
    names = [r[0] for r in spaces.select("timezone").distinct().limit(2001).collect()]
    if len(names) > 2000:
        raise ValueError("more zone names than the zone database has")
    rows = []
    for name in names:
        try:
            zone = zoneinfo.ZoneInfo(name)
        except (ValueError, TypeError, OSError, zoneinfo.ZoneInfoNotFoundError):
            continue
        letters = {}
        for year in range(2020, 2030):
            for month in (1, 7):
                t = dt.datetime(year, month, 15, 12, tzinfo=zone)
                minutes = int(t.utcoffset().total_seconds() // 60)
                letters[t.tzname().upper()] = f"{'-' if minutes < 0 else '+'}{abs(minutes) // 60:02d}:{abs(minutes) % 60:02d}"
        rows.append((name, letters))
    zones = spark.createDataFrame(rows, "timezone string, letters map<string,string>")
    return (
        spaces.groupBy("spaceid").agg(F.max(F.struct("timezone", "dateorder")).alias("s")).select("spaceid", "s.*")
        .join(F.broadcast(zones), "timezone", "left")
        .select("spaceid", F.when(F.col("letters").isNotNull(), F.col("timezone")).alias("home"), "letters", "dateorder")
    )


def stamped(columns: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """Distinct values as ``field, rec_id, value, spaceid, loaded_at`` from (frame, field name, id column, column).

    Texts already in the canonical form are left out before anything is moved.
    """
    rows = [
        df.select(
            F.lit(name).alias("field"), F.col(rec).alias("rec_id"), F.col(col).alias("value"), "spaceid", "loaded_at"
        ).filter(F.col("value").isNotNull() & F.col("rec_id").isNotNull() & ~F.col("value").rlike(CANONICAL))
        for df, name, rec, col in columns
    ]
    union = reduce(DataFrame.unionByName, rows)
    return union.groupBy("field", "rec_id", "value", "spaceid").agg(F.min("loaded_at").alias("loaded_at"))


def read_values(values: DataFrame, spaces: DataFrame) -> DataFrame:
    """Every value with its parses and signature."""
    home = broadcast_if_small(zone_letters(values.sparkSession, spaces))
    return signature(parsed(values.join(home, "spaceid", "left").withColumn("text", cleaned(F.col("value")))))


def format_posteriors(read: DataFrame) -> DataFrame:
    """Per source and signature the chosen format: ``field, spaceid, sig, n, choice, posterior``."""
    counts = read.groupBy("field", "spaceid", "dateorder", "sig").agg(F.count(F.lit(1)).alias("n"))
    ship(read.sparkSession)
    return counts.groupBy("field", "spaceid").applyInPandas(mixture, _POSTERIOR)


def normalised(values: DataFrame, spaces: DataFrame) -> DataFrame:
    """``field, rec_id, value, spaceid, status, fmt, utc_us`` for every value of ``stamped``.

    status: 'ok', 'ambiguous', 'no_zone' or 'unreadable'. The parses are computed once and written to the shared folder;
    the posteriors, a few signatures for each source, are broadcast after a check of their size.
    """
    read = cut(read_values(values, spaces).drop("text", "letters", "loaded_at"))
    chosen = cut(format_posteriors(read).select("field", "spaceid", "sig", "choice"))
    chosen = broadcast_if_small(chosen)
    out = read.join(chosen.withColumnRenamed("spaceid", "__space"), [
        read["field"] == chosen["field"], read["spaceid"].eqNullSafe(F.col("__space")), read["sig"] == chosen["sig"]
    ], "left").drop(chosen["field"]).drop(chosen["sig"])
    month_first = F.col("choice").isin([month for _, month in EITHER.values()])
    us = F.when(F.col("choice") != "ambiguous", F.when(month_first, F.col("us_b")).otherwise(F.col("us_a")))
    status = (
        F.when(F.col("utc_us").isNotNull(), "ok")
        .when(F.col("choice") == "ambiguous", "ambiguous")
        .when(F.col("no_zone"), "no_zone")
        .otherwise("unreadable")
    )
    return out.withColumn("utc_us", us).withColumn("status", status).select(
        "field", "rec_id", "value", "spaceid", "status", "fmt", "utc_us"
    )
