"""References to records that do not exist, per table and period.

Distinct non-null foreign keys are anti-joined with the parents' keys; the parents' states are folded to one row per
key (first load, deleted intervals), first within each day and then over the days, so that a parent with very many states
is spread; both are joined back to the referring rows. A key may be hot on the referring
side: keys are counted with their earliest use, those with more than a thousandth of all references (at most a thousand
keys, so their list is small by proof) are salted in that join, the others are not multiplied.

Defined results: null and blank references give no row; ids are equal apart from letter case and surrounding white
space; repeated referring rows count once, at their earliest load (ties: the smallest references); parent rows with
the same load time count as deleted only if all of them are; a null ``isdeleted`` means not deleted; a parent row
without load time only proves that the key exists; empty tables on either side work (without parents every reference
is missing). Columns beyond those named are ignored, whatever they are called.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depweft.functions.text import fold_key, strip_space
from depweft.runtime import SALTS, cut, hot_keys, salted_join


def first_deliveries(rows: DataFrame, row_id: str, loaded_at: str, fields: list[str]) -> DataFrame:
    """One row per id with its references at the earliest load: ``__id, __loaded, <fields>`` (keys folded)."""
    picked = rows.select(
        strip_space(F.col(row_id)).alias("__id"),
        F.struct(F.col(loaded_at).alias("__loaded"), *[fold_key(F.col(f)).alias(f) for f in fields]).alias("__s"),
    ).filter(F.col("__id").isNotNull() & F.col("__s.__loaded").isNotNull())
    return picked.groupBy("__id").agg(F.min("__s").alias("__s")).select("__id", "__s.*")


def references(first: DataFrame, fields: list[str]) -> DataFrame:
    """Unpivots the reference columns to ``field, __id, __key, __loaded``; null keys are no reference."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("__key")) for f in fields])
    return (
        first.select("__id", "__loaded", F.explode(F.filter(pairs, lambda p: p["__key"].isNotNull())).alias("p"))
        .select(F.col("p.field").alias("field"), "__id", F.col("p.__key").alias("__key"), "__loaded")
    )


def parent_states(parents: dict[str, DataFrame]) -> DataFrame:
    """Folds each field's parent rows (``id, isdeleted, loaded_at``) to ``field, __key, __first, __deleted``.

    ``__deleted`` lists the half-open intervals during which the key's latest row is deleted.
    """
    states = reduce(
        DataFrame.unionByName,
        [
            p.select(
                F.lit(field).alias("field"),
                fold_key(F.col("id")).alias("__key"),
                F.col("loaded_at").alias("__at"),
                F.coalesce(F.col("isdeleted"), F.lit(False)).alias("__gone"),
            ).filter(F.col("__key").isNotNull())
            for field, p in parents.items()
        ],
    )
    states = states.groupBy("field", "__key", "__at").agg(F.min("__gone").alias("__gone"))
    # Within a day first: a parent loaded again and again is spread over its days, and only its turns go on.
    day = Window.partitionBy("field", "__key", F.to_date("__at")).orderBy("__at")
    line = Window.partitionBy("field", "__key").orderBy("__at")
    turns = states.withColumn("__before", F.lag("__gone").over(day)).filter(F.col("__before").isNull() | (F.col("__before") != F.col("__gone")))
    turns = turns.withColumn("__until", F.lead("__at").over(line))
    gone = F.when(F.col("__gone") & F.col("__at").isNotNull(), F.struct(F.col("__at").alias("a"), F.col("__until").alias("b")))
    return turns.groupBy("field", "__key").agg(F.min("__at").alias("__first"), F.collect_list(gone).alias("__deleted"))


def orphan_references(
    rows: DataFrame, parents: dict[str, DataFrame], row_id: str = "id", loaded_at: str = "loaded_at", salts: int = SALTS
) -> DataFrame:
    """Orphan references as ``field, ref_id, ref_key, status, loaded_at``.

    ``parents`` maps a reference column of ``rows`` to a frame with ``id, isdeleted, loaded_at``. ``status`` is
    'missing' (no row of that kind at all), 'later' (first row loaded after the reference) or 'deleted' (the latest
    row up to the reference is deleted).
    """
    fields = list(parents)
    first = cut(first_deliveries(rows, row_id, loaded_at, fields))
    refs = references(first, fields)
    states = parent_states(parents)
    earliest = cut(refs.groupBy("field", "__key").agg(F.min("__loaded").alias("__min_loaded"), F.count(F.lit(1)).alias("__n")))
    hot = hot_keys(earliest, ["field", "__key"])
    missing = earliest.join(states, ["field", "__key"], "left_anti").select(
        "field", "__key", F.lit(None).cast("timestamp").alias("__first"),
        F.lit(None).cast("array<struct<a:timestamp,b:timestamp>>").alias("__deleted"), F.lit(True).alias("__missing"),
    )
    suspect = (
        states.join(earliest, ["field", "__key"])
        .filter((F.col("__first") > F.col("__min_loaded")) | (F.size("__deleted") > 0))
        .select("field", "__key", "__first", "__deleted", F.lit(False).alias("__missing"))
    )
    problem = missing.unionByName(suspect)
    at = F.col("__loaded")
    status = (
        F.when(F.col("__missing"), "missing")
        .when(F.col("__first") > at, "later")
        .when(F.exists("__deleted", lambda i: (i["a"] <= at) & (i["b"].isNull() | (i["b"] > at))), "deleted")
    )
    return (
        salted_join(refs, problem, ["field", "__key"], hot, ["__id"], salts=salts)
        .withColumn("status", status)
        .filter(F.col("status").isNotNull())
        .select("field", F.col("__id").alias("ref_id"), F.col("__key").alias("ref_key"), "status", at.alias("loaded_at"))
    )


def orphan_report(orphans: DataFrame, table_name: str) -> DataFrame:
    """Counts per table, field, month and status, with the number of distinct keys behind them."""
    per_key = orphans.groupBy(
        "field", "status", F.date_format("loaded_at", "yyyy-MM").alias("load_month"), "ref_key"
    ).agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy(F.lit(table_name).alias("tbl"), "field", "load_month", "status").agg(
        F.sum("n").alias("n_refs"), F.count(F.lit(1)).alias("n_keys")
    )
