"""Ordered labels: confidence and provenance as ranks, weakest-link aggregates and their labels.

One five-level order of confidence serves every operator; unknown, null and empty labels count as low.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONFIDENCE = ("very-low", "low", "medium", "high", "very-high")
PROVENANCE = ("llm-judged", "observed", "injected", "declared")
#: Confidence that an identity's class gives. Fixed values.
CLASS_CONFIDENCE = {
    "deploy": "high", "artifact": "high", "network": "high", "service-tag": "high",
    "logical": "medium", "async": "medium", "data": "low",
}


def _rank(c: Column, labels: tuple[str, ...], default: int) -> Column:
    out = F.lit(default)
    for n, label in enumerate(labels):
        out = F.when(c == label, F.lit(n)).otherwise(out)
    return out


def _label(c: Column, labels: tuple[str, ...]) -> Column:
    return F.try_element_at(F.array(*map(F.lit, labels)), c + 1)


def confidence_rank(c: Column) -> Column:
    return _rank(c, CONFIDENCE, 1)


def confidence_label(c: Column) -> Column:
    return _label(c, CONFIDENCE)


def provenance_rank(c: Column) -> Column:
    return _rank(c, PROVENANCE, 0)


def provenance_label(c: Column) -> Column:
    return _label(c, PROVENANCE)


def at_least(c: Column, minimum: str) -> Column:
    """The confidence predicate; ``minimum`` must be a label."""
    if minimum not in CONFIDENCE:
        raise ValueError(f"confidence must be one of {', '.join(CONFIDENCE)}")
    return confidence_rank(c) >= CONFIDENCE.index(minimum)


def weakest(c: Column) -> Column:
    """Aggregate: the weakest confidence; high where nothing is aggregated."""
    return F.coalesce(confidence_label(F.min(confidence_rank(c))), F.lit("high"))


def least_trusted(c: Column) -> Column:
    """Aggregate: the least trusted provenance; declared where nothing is aggregated."""
    return F.coalesce(provenance_label(F.min(provenance_rank(c))), F.lit("declared"))


def pairwise_weakest(a: Column, b: Column) -> Column:
    """The weaker of two confidences; medium where either is no label."""
    known = a.isin(*CONFIDENCE) & b.isin(*CONFIDENCE)
    return F.when(known, confidence_label(F.least(confidence_rank(a), confidence_rank(b)))).otherwise(F.lit("medium"))


def class_confidence(c: Column) -> Column:
    out = F.lit("medium")
    for name, label in CLASS_CONFIDENCE.items():
        out = F.when(c == name, F.lit(label)).otherwise(out)
    return out
