"""Attribute-value rows into wide tables with typed columns, by column blocks.

1. Every (entity, attribute) cell keeps the row of its highest version; this aggregates before the shuffle, so an entity
   or attribute that holds a third of the rows reaches no single task as raw rows.
2. The catalogue's attributes are cut into blocks, and each cell carries the number of its block. The cells are shuffled
   by entity once and written as a table bucketed by entity and partitioned by block.
3. Each block reads its own cells only, is pivoted by a grouping on the entity columns, and the blocks are joined to the
   entities on them: all share that bucketing, so neither groupings nor joins shuffle again. The width of one aggregation
   stays bounded, and cells are read twice (by their block, and once more for the list of entities) however many
   attributes exist.

Defined results: names mean an attribute if their letters and digits agree, ignoring case; other names are dropped from
the wide table (``unmatched_names`` reports them); of several spellings of one attribute in the catalogue the smallest is the
column; without attributes there are no cells and no entities; the highest version wins even if it leaves the cell empty (ties: the
latest load, then the larger row number and value; a null version is the lowest); null, blank and unreadable values are empty cells;
entities without a filled cell keep a row of nulls; repeated rows change nothing; empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweft.functions.text import SPACE_CLASS, strip_space
from depweft.runtime import bucketed

#: Attributes in a block, at least, and blocks at most: more attributes make wider blocks.
BLOCK = 8
MOST_BLOCKS = 24

_TRUE = ["true", "yes", "y", "on", "1", "enabled", "t"]
_FALSE = ["false", "no", "n", "off", "0", "disabled", "f"]
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

SPARK_TYPES = {"int": "bigint", "bool": "boolean", "decimal": "decimal(38,2)", "date": "date", "text": "string"}


def name_key(c: Column) -> Column:
    """Letters and digits of a name, in lower case."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{Nd}]", ""))


def read_int(c: Column) -> Column:
    """Whole numbers; commas, blanks and underscores only group digits, a zero fraction is dropped."""
    plain = F.regexp_replace(strip_space(c), rf"(?<=\d)(?:[,_]|{SPACE_CLASS})(?=\d)", "")
    return F.when(plain.rlike(r"^[+-]?\d+(\.0*)?$"), F.regexp_replace(plain, r"\.0*$", "")).try_cast("bigint")


def read_bool(c: Column) -> Column:
    word = F.lower(strip_space(c))
    return F.when(word.isin(_TRUE), F.lit(True)).when(word.isin(_FALSE), F.lit(False))


def read_decimal(c: Column) -> Column:
    """Decimals with point or comma as the mark, exponents allowed; rounded half up to two places."""
    plain = F.regexp_replace(strip_space(c), ",", ".")
    number = F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,2})?$"), plain)
    return F.round(number.try_cast("decimal(38,12)"), 2).cast("decimal(38,2)")


def read_date(c: Column) -> Column:
    """Dates as year-month-day (also with slashes, compact or with a time), day.month.year or day month-name year."""
    v = strip_space(c)
    ymd = F.regexp_replace(v, r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[T ]\d.*)?$", "$1-$2-$3")
    ymd = F.regexp_replace(ymd, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    ymd = F.regexp_replace(ymd, r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", "$3-$2-$1")
    named = F.regexp_replace(F.lower(v), r"^(\d{1,2})\.? ([a-z]{3})[a-z]*\.?,? (\d{4})$", "$3-$2-$1")
    for n, month in enumerate(_MONTHS, 1):
        named = F.regexp_replace(named, f"-{month}-", f"-{n}-")
    given = F.when(ymd.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), ymd).when(named.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), named)
    return given.try_cast("date")


def read_text(c: Column) -> Column:
    text = strip_space(c)
    return F.when(text != "", text)


READERS = {"int": read_int, "bool": read_bool, "decimal": read_decimal, "date": read_date, "text": read_text}


def catalogue(param_catalog: DataFrame, used_in: str, most: int = 20_000) -> list[tuple[str, str]]:
    """(attr, kind) of one table, in order; the catalogue names columns, so its size is bounded and checked."""
    given = param_catalog.filter((F.col("used_in") == used_in) & F.col("kind").isin(list(READERS)) & (name_key(F.col("attr")) != ""))
    rows = given.select("attr", "kind", name_key(F.col("attr")).alias("key")).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the catalogue names more than {most} columns")
    first: dict[str, tuple[str, str]] = {}
    for r in sorted(rows, reverse=True):
        first[r["key"]] = (r["attr"], r["kind"])
    return sorted(first.values())


def _blocks(attrs: list[tuple[str, str]], block: int | None) -> list[list[tuple[str, str]]]:
    size = block or max(BLOCK, -(-len(attrs) // MOST_BLOCKS))
    return [attrs[i : i + size] for i in range(0, len(attrs), size)]


def winning_cells(rows: DataFrame, entity: list[str], attrs: list[tuple[str, str]], order: list[str], block: int | None = None) -> DataFrame:
    """One row per (entity, attribute): ``<entity>, __attr, __block, __value``. ``rows``: entity columns, name, value, order."""
    named = [(a, n) for n, part in enumerate(_blocks(attrs, block)) for a, _ in part]
    names = rows.sparkSession.createDataFrame(named, "__attr string, __block int").withColumn("__key", name_key(F.col("__attr")))
    newest = F.max(F.struct(*[F.col(c) for c in order], F.col("value").alias("__value"))).alias("__top")
    return (
        rows.withColumn("__key", name_key(F.col("name")))
        .join(F.broadcast(names), "__key")
        .groupBy(*entity, "__attr", "__block")
        .agg(newest)
        .select(*entity, "__attr", "__block", F.col("__top.__value").alias("__value"))
    )


def wide_table(
    rows: DataFrame, entity: list[str], attrs: list[tuple[str, str]], order: list[str], block: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """One row per entity with a typed column per attribute."""
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = bucketed(winning_cells(rows, entity, attrs, order, block), n, entity, "__block")
    pivoted = [
        cells.filter(F.col("__block") == number).groupBy(*entity).agg(
            *[READERS[kind](F.max(F.when(F.col("__attr") == a, F.col("__value")))).alias(a) for a, kind in part]
        )
        for number, part in enumerate(_blocks(attrs, block))
    ]
    return reduce(lambda left, right: left.join(right, entity, "left"), pivoted, cells.select(*entity).distinct())


def written(c: Column, kind: str) -> Column:
    """A typed cell as text: plain digits, true or false, two places, yyyy-MM-dd, trimmed text."""
    return F.date_format(c, "yyyy-MM-dd") if kind == "date" else c.cast("string")


def filled_cells(wide: DataFrame, entity: list[str], attrs: list[tuple[str, str]]) -> DataFrame:
    """Unpivots a wide table to one row per filled cell: ``<entity>, attr, val``."""
    if not attrs:
        return wide.select(*entity, F.lit("").alias("attr"), F.lit("").alias("val")).limit(0)
    cells = F.array(*[F.struct(F.lit(a).alias("attr"), written(F.col(f"`{a}`"), k).alias("val")) for a, k in attrs])
    return wide.select(*entity, F.inline(F.filter(cells, lambda x: x["val"].isNotNull())))


def parameter_rows(parameters: DataFrame) -> DataFrame:
    return parameters.filter(F.col("buildtypeid").isNotNull()).select(
        F.col("buildtypeid").alias("entity_id"), "name", "value", "version", "loaded_at",
        F.col("param_row").alias("row_no"),
    )


def variable_rows(variables: DataFrame) -> DataFrame:
    """One row per environment in scope ('' if it lists none); null and repeated entries count once."""
    envs = F.array_distinct(F.filter(F.coalesce(F.col("scope.environment"), F.array()), lambda e: e.isNotNull()))
    envs = F.when(F.size(envs) > 0, envs).otherwise(F.array(F.lit("")))
    return variables.filter(F.col("ownerid").isNotNull()).select(
        F.col("ownerid").alias("entity_id"), F.explode(envs).alias("env_id"), "name", "value", "version", "loaded_at",
        F.col("var_row").alias("row_no"),
    )


ORDER = ["version", "loaded_at", "row_no"]
ENTITY = ["entity_id", "env_id"]
#: Entity columns of each table. A constant column would be folded away and break the shared partitioning.
ENTITIES = {"parameters": ["entity_id"], "variables": ENTITY}


def unmatched_names(rows: DataFrame, attrs: list[tuple[str, str]]) -> DataFrame:
    """Names that mean no attribute of the catalogue, with their number of rows."""
    names = rows.sparkSession.createDataFrame([(a,) for a, _ in attrs], "__attr string").select(name_key(F.col("__attr")).alias("__key"))
    return (
        rows.filter(F.col("name").isNotNull()).withColumn("__key", name_key(F.col("name")))
        .join(F.broadcast(names), "__key", "left_anti")
        .groupBy(F.col("name"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
