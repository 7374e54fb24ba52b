"""References, declarations and identities extracted from the files of repositories.

``files`` has ``repo, path, content``; a file is one row, its lines are exploded with their numbers. Regular expressions
run inside code generation; only formats of unknown depth (JSON and XML trees) go through Arrow-batched Python.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweft.functions.tokens import camel_to_kebab, has_token, is_url_key, reference_kind, tokens_in
from depweft.runtime import map_batches

#: File kinds and names of each extractor. Fixed values.
MARKUP_EXTENSIONS = [".aspx", ".ascx", ".master", ".cshtml", ".razor", ".html", ".htm"]
STATIC_ASSETS = [".css", ".js", ".png", ".jpg", ".gif", ".svg", ".ico", ".woff", ".woff2"]
SCRIPT_PACKAGE_FILES = ["package.json", "tsconfig.json"]
DOTNET_EXTENSIONS = [".cs", ".vb", ".csproj", ".vbproj", ".sln"]
LITERAL_KEYS = ["baseurl", "baseaddress", "apiurl", "serviceurl", "endpoint"]
#: An address in a text. Fixed value.
URL = r"https?://[a-zA-Z0-9._-]+(?:\.[a-zA-Z]{2,})(?::\d+)?(?:/[^\s\"'<>,;}\]]*)?"

#: Kind of a markup reference and the pattern that finds it. Fixed values.
MARKUP = {
    "iframe": r"(?i)<iframe\b[^>]*\bsrc\s*=\s*[\"']([^\"']+)[\"']",
    "script": r"(?i)<script\b[^>]*\bsrc\s*=\s*[\"']([^\"']+)[\"']",
    "link": r"(?i)<link\b[^>]*\bhref\s*=\s*[\"']([^\"']+)[\"']",
}


def _ends_with_any(c: Column, ends: list[str]) -> Column:
    return F.lower(c).rlike("(?:" + "|".join(re.escape(e) for e in ends) + ")$")


def repo_kinds(files: DataFrame) -> DataFrame:
    """Which extractors concern a repository: ``repo, markup, dotnet, script``."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    dotnet = _ends_with_any(F.col("path"), DOTNET_EXTENSIONS) | (name == "web.config") | (name.startswith("appsettings") & name.endswith(".json"))
    return files.groupBy("repo").agg(
        F.bool_or(_ends_with_any(F.col("path"), MARKUP_EXTENSIONS)).alias("markup"),
        F.bool_or(dotnet).alias("dotnet"),
        F.bool_or(name.isin(SCRIPT_PACKAGE_FILES)).alias("script"),
    )


def lines(files: DataFrame) -> DataFrame:
    """``repo, path, line_no, line``, numbered from 1."""
    return files.select("repo", "path", F.posexplode(F.split("content", r"\r?\n")).alias("n", "line")).select("repo", "path", (F.col("n") + 1).alias("line_no"), "line")


def is_static_asset(value: Column) -> Column:
    """A file that calls nothing, unless a placeholder stands in its address."""
    return _ends_with_any(F.regexp_replace(value, r"[?#].*$", ""), STATIC_ASSETS) & ~has_token(value)


def markup_references(text_lines: DataFrame, patterns: dict[str, str] = MARKUP) -> DataFrame:
    """References in markup: ``repo, kind, raw_value, tokens, evidence``."""
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("line", F.lit(p), 1).alias("v")) for k, p in patterns.items()])
    out = text_lines.select("repo", "path", "line_no", F.explode(found).alias("f")).select("repo", "path", "line_no", F.col("f.kind").alias("kind"), F.explode("f.v").alias("raw_value"))
    out = out.filter(~is_static_asset(F.col("raw_value")))
    return out.select("repo", "kind", "raw_value", tokens_in(F.col("raw_value")).alias("tokens"), F.concat_ws(":", "path", F.col("line_no").cast("string")).alias("evidence"))


def token_uses(text_lines: DataFrame) -> DataFrame:
    """Every placeholder used: ``repo, name, path, line_no``."""
    return text_lines.select("repo", "path", "line_no", F.explode(tokens_in(F.col("line"))).alias("name"))


def first_declarations(uses: DataFrame) -> DataFrame:
    """First place of each placeholder in a repository: ``repo, name, declared_in``."""
    first = uses.groupBy("repo", "name").agg(F.min(F.struct("path", "line_no")).alias("m"))
    return first.select("repo", "name", F.concat_ws(":", "m.path", F.col("m.line_no").cast("string")).alias("declared_in"))


def dotenv_values(text_lines: DataFrame) -> DataFrame:
    """URL values of .env files: ``repo, path, key, value``; comments and quotes are left out."""
    env = text_lines.filter(F.col("path").rlike(r"(?i)\.env(\.\w+)?$") & F.col("line").rlike(r"^\s*(?:export\s+)?[A-Za-z_][\w.]*\s*=") & ~F.col("line").rlike(r"^\s*#"))
    key = F.regexp_extract("line", r"^\s*(?:export\s+)?([A-Za-z_][\w.]*)\s*=", 1)
    value = F.regexp_replace(F.trim(F.regexp_extract("line", r"=(.*)$", 1)), r"^[\"']|[\"']$", "")
    return env.select("repo", "path", key.alias("key"), value.alias("value")).filter(F.col("value").rlike(URL))


def settings_lines(text_lines: DataFrame) -> DataFrame:
    """key = value, key: value and export lines: ``repo, path, line_no, key, value``."""
    pattern = r"^\s*(?:export\s+)?([A-Za-z_][\w\-]*(?:\.[\w\-]+)+)\s*(?:=|:\s)\s*[\"']?([^\"']*)[\"']?\s*$"
    key = F.regexp_extract("line", pattern, 1)
    return text_lines.withColumn("key", key).filter(F.col("key") != "").withColumn("value", F.trim(F.regexp_extract("line", pattern, 2))).drop("line")


def _json_leaves(node: object, path: tuple[str, ...]) -> Iterator[tuple[str, str, str]]:
    if isinstance(node, dict):
        for key, value in node.items():
            yield from _json_leaves(value, (*path, key))
    elif isinstance(node, str) and path:
        yield ".".join(path), path[-1], node


def _xml_values(text: str) -> Iterator[tuple[str, str, str]]:
    try:
        root = ET.fromstring(text.lstrip("﻿ \t\r\n"))
    except (ET.ParseError, ValueError):
        return
    for node in root.iter():
        tag = node.tag.rsplit("}", 1)[-1].lower()
        if tag == "add" and node.get("connectionString") is not None:
            yield "connectionString", node.get("name") or "", node.get("connectionString") or ""
        elif tag == "add" and node.get("key") is not None:
            yield "appSettings", node.get("key") or "", node.get("value") or ""
        elif tag == "endpoint" and node.get("address"):
            yield "endpoint", "address", node.get("address") or ""
        elif tag == "packagereference" and node.get("Include"):
            yield "package", node.get("Include") or "", node.get("Version") or ""


_TREE = "repo string, path string, place string, key string, value string"


def _walked(files: DataFrame, walk) -> DataFrame:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(repo, path, *leaf) for repo, path, text in zip(*(c.to_pylist() for c in batch.columns)) for leaf in walk(text or "")]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["repo", "path", "place", "key", "value"])

    return map_batches(files.select("repo", "path", "content"), run, _TREE)


def json_settings(files: DataFrame) -> DataFrame:
    """Text leaves of JSON objects at any depth: ``repo, path, place, key, value``; arrays are left out, bad files give none."""

    def walk(text: str) -> Iterator[tuple[str, str, str]]:
        try:
            yield from _json_leaves(json.loads(text.lstrip("﻿")), ())
        except (ValueError, RecursionError):
            return

    return _walked(files, walk)


class _Written(float):
    """A number that keeps how it was written."""

    def __new__(cls, text: str) -> _Written:
        made = super().__new__(cls, text)
        made.text = text
        return made


def _json_values(node: object, path: tuple[str, ...]) -> Iterator[tuple[str, str, str]]:
    if isinstance(node, dict):
        for key, value in node.items():
            yield from _json_values(value, (*path, key))
    elif path:
        text = "" if node is None else node if isinstance(node, str) else node.text if isinstance(node, _Written) else json.dumps(node, ensure_ascii=False, separators=(",", ":"))
        yield ":".join(path), path[-1], text


def json_values(files: DataFrame) -> DataFrame:
    """All leaves of JSON objects with ':' between keys: numbers and booleans as written, null as '', arrays as JSON."""
    def walk(text: str) -> Iterator[tuple[str, str, str]]:
        try:
            for place, key, value in _json_values(json.loads(text.lstrip("\ufeff"), parse_float=_Written), ()):
                yield place, key, value
        except (ValueError, RecursionError):
            return

    return _walked(files, walk)


def web_config_values(files: DataFrame) -> DataFrame:
    """Keys and values of the first appSettings section of each XML file; later sections do not count."""

    def walk(text: str) -> Iterator[tuple[str, str, str]]:
        try:
            root = ET.fromstring(text.lstrip("\ufeff \t\r\n"))
        except (ET.ParseError, ValueError):
            return
        section = next((n for n in root.iter("appSettings") if n is not root), None)
        for add in section.findall("add") if section is not None else ():
            if add.get("key") is not None and add.get("value") is not None:
                yield "appSettings", add.get("key"), add.get("value")

    return _walked(files, walk)


def xml_settings(files: DataFrame) -> DataFrame:
    """Settings, connection strings, endpoints and package references of XML files; bad files give none."""
    return _walked(files, _xml_values)


def environment_hint(path: Column) -> Column:
    """Environment in the name of a settings file at the root: appsettings.<env>.json."""
    hint = F.regexp_extract(path, r"^(?i:appsettings)\.([^./]+)\.json$", 1)
    return F.when(hint != "", F.lower(hint))


def classified(settings: DataFrame) -> DataFrame:
    """What each setting is: adds ``tokens, is_ref, kind, declares, injected, env_hint``.

    Placeholders make a reference and injected declarations; an address-like key with a value declares its name in
    kebab case; an address in the value, or one of a few keys, makes a reference.
    """
    tokens = tokens_in(F.col("value"))
    injected = F.size(tokens) > 0
    literal = is_url_key(F.col("key")) & (F.col("value") != "")
    is_ref = injected | F.col("value").rlike(URL) | (F.lower("key").isin(LITERAL_KEYS) & (F.col("value") != ""))
    kind = F.when(injected | F.col("value").rlike(URL), reference_kind(F.col("key"))).otherwise(F.lit("http-client"))
    declares = F.when(injected, tokens).when(literal, F.array(camel_to_kebab(F.col("key")))).otherwise(F.array().cast("array<string>"))
    return settings.select(
        "*", tokens.alias("tokens"), is_ref.alias("is_ref"), F.when(is_ref, kind).alias("kind"), declares.alias("declares"), injected.alias("injected"), environment_hint(F.col("path")).alias("env_hint")
    )


def package_identities(xml: DataFrame) -> DataFrame:
    """Artifact identities of package references."""
    return xml.filter(F.col("place") == "package").select(
        "repo", F.lit("artifact").alias("identity_class"), F.concat(F.lit("nuget:"), "key", F.lit("@"), "value").alias("value"), F.lit(None).cast("string").alias("env")
    )


_LITERAL = r'"([^"\\\r\n]*+(?:\\.[^"\\\r\n]*+)*+)"'
_OTHERS = r'[^;",]*+(?:' + _LITERAL.replace("([^", "(?:[^", 1) + r'[^;",]*+|,(?!\s*\w+\s*=\s*")[^;",]*+)*+,\s*'
#: One declarator and all text before it from the end of the last one on: text before, name, literal. \G stops retries.
DECLARATOR = (
    r'\G((?<=")' + _OTHERS + r'|[\s\S]*?\b(?:const\s+string\s+(?:' + _OTHERS + r')??|string\s+(?=\w+\s*\{[^}]*\}\s*=)))'
    r'(\w+)(?:\s*\{[^}]*\})?\s*=\s*' + _LITERAL
)


def constants(files: DataFrame) -> DataFrame:
    """String constants and property defaults of C# sources, found by patterns (an approximation of a parser).

    Every declarator of a statement counts, also over several lines; its line is that of its name.
    """
    part = lambda n: F.regexp_extract_all("content", F.lit(DECLARATOR), F.lit(n))
    breaks = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    found = files.filter(F.lower("path").endswith(".cs")).select("repo", "path", F.arrays_zip(part(0).alias("whole"), part(1).alias("before"), part(2).alias("key"), part(3).alias("value")).alias("d"))
    each = found.select("repo", "path", "d", F.posexplode("d").alias("n", "one"))
    line = 1 + breaks(F.array_join(F.slice(F.col("d.whole"), F.lit(1), F.col("n")), "")) + breaks(F.col("one.before"))
    return each.select("repo", F.col("one.key").alias("key"), F.col("one.value").alias("value"), F.concat_ws(":", "path", line.cast("string")).alias("source"), F.lit(2).alias("layer"))


def file_facts(files: DataFrame) -> DataFrame:
    """Layer-1 facts of settings files: ``repo, key, value, source, condition, layer, rank``.

    Base files come before those of an environment and these by the number of parts in their name, then by path: that
    order is ``(rank, source)``. The condition is the name of a file that is no base file, null for web.config.
    """
    name = F.element_at(F.split("path", "/"), -1)
    settings = json_values(files.filter(F.lower("path").rlike(r"(^|/)appsettings[^/]*\.json$")))
    parts = F.size(F.filter(F.split(F.regexp_replace(name, r"\.[^.]*$", ""), r"\."), lambda x: x != ""))
    condition = F.when(F.lower(name) != "appsettings.json", name)
    json_facts = settings.select("repo", F.col("place").alias("key"), "value", F.col("path").alias("source"), condition.alias("condition"), F.lit(1).alias("layer"), parts.alias("rank"))
    config = web_config_values(files.filter(F.lower("path").rlike(r"(^|/)web\.config$")))
    return json_facts.unionByName(config.select("repo", "key", "value", F.col("path").alias("source"), F.lit(None).cast("string").alias("condition"), F.lit(1).alias("layer"), F.lit(1).alias("rank")))


def unresolved(tokens: DataFrame, resolved: DataFrame, hits: DataFrame) -> DataFrame:
    """Tokens without a value, secrets, and values that no identity matches: ``ref_id, reason``."""
    state = tokens.select("ref_id").distinct().join(resolved.select("ref_id", "value", "resolved"), "ref_id", "left")
    state = state.join(hits.select("ref_id", F.lit(True).alias("hit")).distinct(), "ref_id", "left")
    reason = F.when(F.col("value") == "<secret>", "secret").when(~F.coalesce("resolved", F.lit(False)), "no-value").when(F.col("hit").isNull(), "no-match")
    return state.select("ref_id", reason.alias("reason")).filter(F.col("reason").isNotNull())


def machine_identities(machines: DataFrame, tenants: DataFrame) -> DataFrame:
    """Identities that deploy targets and tenants give: their address (deploy), name (network) and tenant name (logical).

    ``machines``: repo, name, uri, envs (array). ``tenants``: repo, name. Blank values give none.
    """
    each = machines.select("repo", "name", "uri", F.explode_outer("envs").alias("env"))
    kinds = F.array(F.struct(F.lit("deploy").alias("identity_class"), F.col("uri").alias("value")), F.struct(F.lit("network").alias("identity_class"), F.col("name").alias("value")))
    targets = each.select("repo", F.explode(kinds).alias("k"), "env").select("repo", "k.identity_class", "k.value", "env")
    logical = tenants.select("repo", F.lit("logical").alias("identity_class"), F.col("name").alias("value"), F.lit(None).cast("string").alias("env"))
    return targets.unionByName(logical).filter(F.trim("value") != "").distinct()


def value_sets(facts: DataFrame) -> DataFrame:
    """All values of each (repo, key) with where they come from, highest layer first, repeats once."""
    entry = F.struct((-F.col("layer")).alias("order"), "value", "source", "condition")
    sets = facts.groupBy("repo", "key").agg(F.array_sort(F.collect_set(entry)).alias("entries"))
    return sets.select("repo", "key", F.transform("entries", lambda e: F.struct(e["value"].alias("value"), e["source"].alias("source"), e["condition"].alias("condition"), (-e["order"]).alias("layer"))).alias("entries"))
