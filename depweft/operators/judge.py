"""The offline judge: unresolved items gated, keyed, answered from a table of responses, validated and grounded.

Every item gets one disposition; nothing is called from here. A live provider is a function over batches that fills the
responses table beforehand (``mapInPandas`` in user code).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweft.functions.tokens import residency_trigger
from depweft.operators.identity import grounded

MOST_FILES, MOST_BYTES = 20, 50_000
MODES = ("structured", "hybrid", "agentic")
DECISIONS = ("keep-ambiguous", "ground-to-candidate")
IDENTITY_CLASSES = ("network", "logical", "deploy", "artifact", "async", "data", "service-tag")


def mode(requested: str | None, configured: str | None = None) -> str:
    """The mode asked for, else the configured one, else structured."""
    chosen = requested or configured or "structured"
    if chosen not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    return chosen


def within_budget(evidence: Column, files: int = MOST_FILES, size: int = MOST_BYTES) -> Column:
    """At most so many evidence items and bytes of their JSON."""
    return (F.size(evidence) <= files) & (F.octet_length(F.to_json(evidence)) <= size)


def cache_key(goal: Column, locators: Column, version: Column) -> Column:
    """SHA-256 of the goal, the sorted locators and the contract's version."""
    return F.sha2(F.to_json(F.struct(goal.alias("goal"), F.array_sort(locators).alias("locators"), version.alias("version"))), 256)


def goal_of(kind: Column, ref: Column) -> Column:
    return F.concat(F.upper(F.replace(kind, F.lit("-"), F.lit("_"))), F.lit(":"), ref)


def verdict(kind: Column, decision: Column, candidate: Column, value: Column, identity_class: Column, reasoning: Column) -> Column:
    """(valid, proposal) of one response under its contract: a reasoning always, then what the kind of item needs."""
    text = lambda c: c.isNotNull() & (F.trim(c) != "")
    ok = text(reasoning) & (
        F.when(kind == "ambiguous-match", decision.isin(*DECISIONS) & ((decision != "ground-to-candidate") | text(candidate)))
        .when(kind == "unresolved-ref", F.lit(True))
        .when(kind == "identity-class", identity_class.isin(*IDENTITY_CLASSES))
        .otherwise(F.lit(False))
    )
    proposal = F.when(kind == "ambiguous-match", F.when(decision == "ground-to-candidate", candidate)).when(kind == "unresolved-ref", value)
    ok = F.coalesce(ok, F.lit(False))
    return F.struct(ok.alias("valid"), F.when(ok, proposal).alias("proposal"))


def judged(items: DataFrame, responses: DataFrame, index: DataFrame) -> DataFrame:
    """One disposition per item: ``ref_id, disposition, cache_key, owner``.

    ``items``: ref_id, kind, version, from_id, env, is_secret, key, value, locators. ``responses``: cache_key, decision,
    candidate, value, identity_class, reasoning. In order: secret, over-budget, held-back (personal data), unanswered,
    malformed, no-proposal, ungrounded, edge.
    """
    goal = goal_of(F.col("kind"), F.col("ref_id"))
    keyed = items.withColumn("cache_key", cache_key(goal, F.col("locators"), F.col("version"))).withColumn("__trigger", residency_trigger(goal, F.col("key"), F.col("value")))
    answer = responses.groupBy("cache_key").agg(F.max(F.struct("decision", "candidate", "value", "identity_class", "reasoning")).alias("a"))
    keyed = keyed.join(answer, "cache_key", "left")
    keyed = keyed.withColumn("v", verdict(F.col("kind"), F.col("a.decision"), F.col("a.candidate"), F.col("a.value"), F.col("a.identity_class"), F.col("a.reasoning")))
    owners = grounded(keyed.filter("v.proposal is not null").select("ref_id", F.col("v.proposal").alias("value"), "env"), index)
    out = keyed.join(owners, "ref_id", "left")
    disposition = (
        F.when(F.col("is_secret"), "secret")
        .when(~within_budget(F.col("locators")), "over-budget")
        .when(F.col("__trigger").isNotNull(), "held-back")
        .when(F.col("a").isNull(), "unanswered")
        .when(~F.col("v.valid"), "malformed")
        .when(F.col("v.proposal").isNull(), "no-proposal")
        .when(F.col("owner").isNull(), "ungrounded")
        .otherwise("edge")
    )
    return out.select("ref_id", "from_id", "env", disposition.alias("disposition"), "cache_key", F.when(disposition == "edge", F.col("owner")).alias("owner"))


def judged_edges(dispositions: DataFrame) -> DataFrame:
    return dispositions.filter(F.col("disposition") == "edge").select(
        "from_id", F.col("owner").alias("to_id"), "env", F.lit("llm-judged").alias("provenance"), F.lit("low").alias("confidence")
    )


def traces(dispositions: DataFrame, responses: DataFrame) -> DataFrame:
    """Reasoning traces with an id made from their content."""
    joined = dispositions.join(responses.select("cache_key", "reasoning"), "cache_key")
    return joined.select(F.sha2(F.concat_ws("|", "cache_key", "ref_id", "reasoning"), 256).alias("trace_id"), "ref_id", "cache_key", "disposition", "reasoning")


#: What each kind of item asks for, as the fields of a JSON answer. Fixed values.
ANSWER_FIELDS = {
    "ambiguous-match": ("decision", "candidate_id", "reasoning"),
    "unresolved-ref": ("resolved_value", "reasoning"),
    "identity-class": ("identity_class", "reasoning"),
}


def prompt(kind: Column, goal: Column, candidates: Column, locators: Column) -> Column:
    """The request of one item: what is asked, what may be chosen from, the evidence, and the form of the answer."""
    form = F.lit("")
    for name, fields in ANSWER_FIELDS.items():
        form = F.when(kind == name, F.lit(", ".join(fields))).otherwise(form)
    listed = lambda label, c: F.concat(F.lit(f"{label}:"), F.array_join(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit("\n- "), x)), ""))
    return F.concat_ws("\n", F.concat(F.lit("Task: "), goal), listed("Choices", candidates), listed("Evidence", F.array_sort(locators)), F.concat(F.lit("Answer with a JSON object of: "), form))
