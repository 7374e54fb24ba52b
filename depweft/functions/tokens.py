"""Tokens, keys, secrets and personal data in texts: column expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAME = r"([a-zA-Z][a-zA-Z0-9_.-]*)"
#: Forms of a placeholder; the look-behind keeps {t} from matching inside #{t} and ${t}. Fixed values.
TOKEN_FORMS = {
    "curly": r"(?<![#$])\{" + _NAME + r"\}",
    "hash-curly": r"#\{" + _NAME + r"\}",
    "dollar-curly": r"\$\{" + _NAME + r"\}",
    "percent": r"%\(" + _NAME + r"\)%",
    "asp-appsettings": r"<%\$\s*AppSettings:\s*" + _NAME + r"\s*%>",
}
#: Parts of key names that mark a secret. Fixed values.
SECRET_PARTS = ["password", "secret", "token", "apikey", "api_key", "connectionstring"]
#: Field names that hold personal data. Fixed values.
PERSONAL_FIELDS = [
    "user", "author", "owner", "email", "name", "contact", "username", "firstname", "lastname", "fullname",
    "phone", "mobile", "person", "identity",
]
#: Forms of personal data in texts. Fixed values.
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE = r"\b(\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
REDACTED = "[REDACTED]"
#: Parts of key names that hold an address. Fixed values.
URL_KEYS = ("url", "endpoint", "address", "host")
#: Capabilities of a telemetry source and the path each is read from. Fixed values.
CAPABILITY_PATHS = {
    "apm": "/api/v1/service_dependencies",
    "traces": "/api/v2/spans/events/search",
    "logs": "/api/v2/logs/events/search",
    "rum": "/api/v2/rum/events/search",
}


def tokens_in(text: Column) -> Column:
    """Array of the placeholders in a text, by form, in order within each form."""
    return F.concat(*[F.regexp_extract_all(text, F.lit(p), 1) for p in TOKEN_FORMS.values()])


def has_token(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in TOKEN_FORMS.values()])


def substitute(text: Column, token: Column, value: Column) -> Column:
    """Every form of one placeholder replaced by its value, as literal text."""
    out = text
    for left, right in (("#{", "}"), ("${", "}"), ("{", "}"), ("%(", ")%")):
        out = F.replace(out, F.concat(F.lit(left), token, F.lit(right)), value)
    return out


def camel_to_kebab(c: Column) -> Column:
    """Words of a camel-case name with hyphens between; both patterns are fixed values."""
    c = F.regexp_replace(c, r"([A-Z]+)([A-Z][a-z])", "$1-$2")
    return F.lower(F.regexp_replace(c, r"([a-z\d])([A-Z])", "$1-$2"))


def is_url_key(key: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(key).contains(k) for k in URL_KEYS])


def reference_kind(key: Column) -> Column:
    """What a key refers to, by parts of its name; these are fixed values."""
    low = F.lower(key)
    http = reduce(lambda a, b: a | b, [low.contains(k) for k in ("url", "baseaddress", "endpoint", "host", "api")])
    return F.when(low.contains("connection"), "connection-string").when(http, "http-client").otherwise("other")


def is_secret_key(key: Column, extra: tuple[str, ...] = ()) -> Column:
    low = F.lower(key)
    return reduce(lambda a, b: a | b, [low.contains(p.lower()) for p in (*SECRET_PARTS, *extra)])


def redact(text: Column) -> Column:
    """Credentials in headers and query parameters replaced, in this order."""
    for pattern, with_ in (
        (r"Bearer\s+\S+", f"Bearer {REDACTED}"),
        (r"Basic\s+\S+", f"Basic {REDACTED}"),
        (r"(api_key=)[^&\s]+", f"$1{REDACTED}"),
        (r"(token=)[^&\s]+", f"$1{REDACTED}"),
        (r"(key=)[^&\s]+", f"$1{REDACTED}"),
    ):
        text = F.regexp_replace(text, pattern, with_)
    return text


def redact_evidence(locators: Column) -> Column:
    """Redacted locators; those that still hold an e-mail or phone, or are nothing but redacted, are left out."""
    return F.filter(
        F.transform(locators, redact), lambda x: ~x.rlike(EMAIL) & ~x.rlike(PHONE) & (x != F.lit(REDACTED))
    )


def redact_secrets(key: Column, value: Column, secrets: Column) -> Column:
    """The value of a secret key as a whole, and known secret values wherever they occur."""
    hidden = F.aggregate(F.coalesce(secrets, F.array()), value, lambda acc, s: F.when(F.length(s) > 0, F.replace(acc, s, F.lit(REDACTED))).otherwise(acc))
    return F.when(is_secret_key(key), F.lit(REDACTED)).otherwise(hidden)


def residency_trigger(goal: Column, key: Column, value: Column) -> Column:
    """The first reason why an item must not leave: e-mail, phone or a personal field; null if there is none."""
    words = F.regexp_extract_all(F.lower(goal), F.lit(r"(\w+)"), 1)
    fields = F.array(*map(F.lit, PERSONAL_FIELDS))
    any_of = lambda p: goal.rlike(p) | F.coalesce(key.rlike(p), F.lit(False)) | F.coalesce(value.rlike(p), F.lit(False))
    return (
        F.when(any_of(EMAIL), "email")
        .when(any_of(PHONE), "phone")
        .when(F.lower(key).isin(PERSONAL_FIELDS), F.concat(F.lit("field:"), F.lower(key)))
        .when(F.arrays_overlap(words, fields), "goal")
    )


def value_from_logs(log: Column, key: Column) -> Column:
    """Value of the first line KEY=VALUE, whatever the key's case."""
    lines = F.transform(F.split(log, r"\r?\n"), lambda x: F.trim(x))
    hit = F.filter(lines, lambda x: (F.lower(F.split_part(x, F.lit("="), F.lit(1))) == F.lower(key)) & (F.instr(x, "=") > 0))
    line = F.try_element_at(hit, F.lit(1))
    value = F.trim(F.substr(line, F.instr(line, "=") + F.lit(1)))
    return F.when(value != "", value)


def evidence_list(text: Column) -> Column:
    """A JSON list of locators, or the text itself as a list of one."""
    return F.coalesce(F.from_json(text, "array<string>", {"mode": "PERMISSIVE"}), F.when(text.isNotNull() & (text != ""), F.array(text)), F.array().cast("array<string>"))


def evidence_locator(source: str, capability: Column, env: Column, at: Column) -> Column:
    path = F.lit(None).cast("string")
    for name, p in CAPABILITY_PATHS.items():
        path = F.when(capability == name, F.lit(p)).otherwise(path)
    path = F.coalesce(path, F.concat(F.lit("/api/unknown/"), capability))
    return F.concat(F.lit(f"{source}:"), capability, F.lit(":"), env, F.lit(":"), path, F.lit("@"), at)


def valid_locator(source: str, locator: Column) -> Column:
    return locator.rlike(rf"^{source}:[a-z]+:[a-zA-Z0-9_-]+:/api/v[12]/[a-z0-9_/]+@\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}Z$")


def specificity(condition: Column) -> Column:
    """Number of dots."""
    return F.length(condition) - F.length(F.replace(condition, F.lit("."), F.lit("")))
