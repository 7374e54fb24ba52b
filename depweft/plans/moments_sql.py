"""The SQL twin of the timestamp queries: the declared order of each space instead of an estimate, and DuckDB's own zones."""

from __future__ import annotations

from depweft.operators.moments import _EPOCH, _SLASHED, _SLASHED_YEAR, CANONICAL, GRAMMAR

#: Zone letters of each space's zone in the years 2020 to 2029, with minutes to UTC. Fixed values.
LETTERS = (
    ("Europe/Berlin", "CET", 60), ("Europe/Berlin", "CEST", 120), ("America/New_York", "EST", -300), ("America/New_York", "EDT", -240), ("Europe/London", "GMT", 0), ("Europe/London", "BST", 60),
    ("America/Los_Angeles", "PST", -480), ("America/Los_Angeles", "PDT", -420), ("Asia/Kolkata", "IST", 330), ("Asia/Tokyo", "JST", 540), ("Australia/Sydney", "AEST", 600), ("Australia/Sydney", "AEDT", 660),
    ("America/Chicago", "CST", -360), ("America/Chicago", "CDT", -300), ("Europe/Helsinki", "EET", 120), ("Europe/Helsinki", "EEST", 180), ("Etc/UTC", "UTC", 0),
)
_DAY = 86_400_000_000


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _fields(form: str, order: str) -> str:
    out = order
    for n in range(9, 0, -1):
        out = out.replace(f"${n}", f"\\{n}")
    return f"regexp_replace(x, {_quoted(form)}, '{out}')"


def _is(*names: str) -> str:
    forms = {n: p for n, (p, _) in GRAMMAR.items()} | {"epoch": _EPOCH, "slashed": _SLASHED, "ymd": _SLASHED_YEAR}
    return "CASE " + " ".join(f"WHEN regexp_matches(x, {_quoted(forms[n])}) THEN '{n}'" for n in names) + " END"


def _offset(us: str) -> str:
    """Microseconds that a zone is ahead of UTC at a moment."""
    return f"(epoch_us(timezone(home, make_timestamptz({us}))) - ({us}))"


def moments_sql(spaces: str, trim: str) -> str:
    """Common table expressions up to ``m``: ``field, rec_id, value, spaceid, fmt, us``; ``trim``: the trimmed ``value``."""
    slashed = " ".join(f"WHEN fmt = 'slashed' AND o {test} THEN {_fields(_SLASHED, order)}" for test, order in (("= 'MDY'", "$3|$1|$2|$4|$5|$6|$7|$8|$9"), ("<> 'MDY'", "$3|$2|$1|$4|$5|$6|$7|$8|$9")))
    plain = " ".join(f"WHEN fmt = '{n}' THEN {_fields(p, order)}" for n, (p, order) in GRAMMAR.items())
    letters = ", ".join(f"('{z}', '{letter}', {m})" for z, letter, m in LETTERS)
    sources = (("deployments.created", "id", "created", "deployments"), ("deployments.queuetime", "id", "queuetime", "deployments"), ("environments.lastmodifiedon", "id", "lastmodifiedon", "environments"), ("repos.pushed_at", "full_name", "pushed_at", "repos"))
    union = " UNION ALL ".join(f"SELECT '{f}' AS field, {i} AS rec_id, {c} AS value, spaceid FROM {t}" for f, i, c, t in sources)
    return f"""WITH v AS (SELECT DISTINCT * FROM ({union}) WHERE value IS NOT NULL AND rec_id IS NOT NULL AND NOT regexp_matches(value, {_quoted(CANONICAL)})),
  l AS (SELECT * FROM (VALUES {letters}) AS l(home, letters, minutes)),
  t AS (SELECT v.*, s.timezone AS home, s.dateorder AS o, upper(translate(regexp_replace({trim}, '{spaces}+', ' ', 'g'), '−–', '--')) AS x FROM v LEFT JOIN spaces s USING (spaceid)),
  f AS (SELECT *, CASE WHEN substr(x, 5, 1) = '-' THEN {_is("iso", "ordinal")} WHEN contains(x, '/') THEN {_is("slashed", "ymd", "epoch")} ELSE {_is("epoch", "mail", "dotted", "compact", "named")} END AS fmt FROM t),
  p AS (SELECT *, string_split(CASE {slashed} WHEN fmt = 'ymd' THEN {_fields(_SLASHED_YEAR, "$1|$2|$3|$4|$5|$6|$7|$8|$9")} {plain} END, '|') AS p FROM f),
  n AS (SELECT *, coalesce(p[2] = 'O', false) AS ord, TRY_CAST(p[1] AS INTEGER) AS yy, CASE WHEN p[2] = 'O' THEN 1 ELSE coalesce(TRY_CAST(p[2] AS INTEGER), list_position(['JAN', 'FEB', 'MAR', 'APR', 'MAY', 'JUN', 'JUL', 'AUG', 'SEP', 'OCT', 'NOV', 'DEC'], p[2])) END AS mm,
      TRY_CAST(p[3] AS INTEGER) AS dd, TRY_CAST(p[4] AS INTEGER) AS hh, TRY_CAST(p[5] AS INTEGER) AS mi, coalesce(TRY_CAST(nullif(p[6], '') AS INTEGER), 0) AS ss, CAST(rpad(substr(coalesce(p[7], ''), 1, 6), 6, '0') AS BIGINT) AS part FROM p),
  h AS (SELECT *, CASE WHEN p[8] = '' THEN hh WHEN hh BETWEEN 1 AND 12 THEN hh % 12 + CASE p[8] WHEN 'PM' THEN 12 ELSE 0 END END AS h24 FROM n),
  w AS (SELECT *, epoch_us(try_strptime(printf('%04d-%02d-%02d %02d:%02d:%02d', yy, mm, CASE WHEN ord THEN 1 ELSE dd END, h24, mi, ss), '%Y-%m-%d %H:%M:%S')) + part + CASE WHEN ord THEN CAST(dd - 1 AS BIGINT) * {_DAY} ELSE 0 END AS wall,
      regexp_replace(p[9], '[:+-]', '', 'g') AS digits FROM h WHERE NOT ord OR dd BETWEEN 1 AND 366),
  z AS (SELECT w.*, CASE WHEN p[9] IN ('Z', 'UTC', 'GMT', 'UT') THEN 0
      WHEN regexp_matches(p[9], '^[+-]') THEN CASE WHEN CAST(substr(digits, 1, 2) AS INTEGER) <= 18 AND CAST(rpad(substr(digits, 3, 2), 2, '0') AS INTEGER) < 60
        THEN (CAST(substr(digits, 1, 2) AS INTEGER) * 60 + CAST(rpad(substr(digits, 3, 2), 2, '0') AS INTEGER)) * CASE WHEN p[9][1] = '-' THEN -1 ELSE 1 END END
      ELSE l.minutes END AS minutes FROM w LEFT JOIN l ON l.home = w.home AND l.letters = p[9]),
  a AS (SELECT *, CASE WHEN p[9] = '' THEN {_offset(f"wall - {_DAY}")} END AS before, CASE WHEN p[9] = '' THEN {_offset(f"wall + {_DAY}")} END AS after FROM z),
  b AS (SELECT *, CASE WHEN {_offset("wall - before")} = before THEN wall - before END AS one, CASE WHEN {_offset("wall - after")} = after THEN wall - after END AS two FROM a),
  e AS (SELECT *, regexp_extract(x, '^/DATE\\((-?\\d{{1,15}})(?:[+-]\\d{{4}})?\\)/$', 1) AS millis, TRY_CAST(x AS BIGINT) AS number FROM f WHERE fmt = 'epoch'),
  m AS (SELECT field, rec_id, value, spaceid, fmt, CASE WHEN p[9] = '' THEN coalesce(least(one, two), wall - before) ELSE wall - CAST(minutes AS BIGINT) * 60000000 END AS us FROM b WHERE fmt IS NOT NULL AND fmt <> 'epoch'
    UNION ALL SELECT field, rec_id, value, spaceid, fmt, CASE WHEN millis <> '' THEN CAST(millis AS BIGINT) * 1000
      WHEN regexp_matches(x, '[.,]') THEN CAST(regexp_extract(x, '^(\\d+)', 1) AS BIGINT) * 1000000 + CAST(rpad(substr(regexp_extract(x, '[.,](\\d+)$', 1), 1, 6), 6, '0') AS BIGINT)
      WHEN length(x) <= 10 THEN number * 1000000 WHEN length(x) <= 13 THEN number * 1000 WHEN length(x) <= 16 THEN number ELSE number // 1000 END FROM e)"""


def found_sql(spaces: str, trim: str) -> str:
    return f"{moments_sql(spaces, trim)} SELECT field, rec_id, us AS utc_us FROM m WHERE us >= 1577836800000000 AND us < 1893456000000000"


def report_sql(spaces: str, trim: str) -> str:
    return f"""{moments_sql(spaces, trim)},
  g AS (SELECT field, rec_id, value, spaceid, max(us) AS us FROM m GROUP BY ALL),
  q AS (SELECT p.field, p.spaceid, coalesce(p.fmt, 'none') AS fmt, CASE WHEN g.us IS NOT NULL THEN 'ok' WHEN p.home IS NULL AND p.p[9] = '' THEN 'no_zone' ELSE 'unreadable' END AS status
    FROM p LEFT JOIN g ON p.field = g.field AND p.rec_id = g.rec_id AND p.value = g.value AND p.spaceid IS NOT DISTINCT FROM g.spaceid)
  SELECT field, spaceid, status, fmt, count(*) AS n FROM q GROUP BY ALL"""
