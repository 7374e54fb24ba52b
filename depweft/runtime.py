"""Session helpers shared by the operators: table access, lineage cutting, checked broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast only when it was counted and holds at most this many rows.
BROADCAST_ROWS = 200_000
#: A key is hot with more than this share of all rows, and more rows than HOT_ROWS; at most 1 / HOT_SHARE keys are.
HOT_SHARE = 0.001
HOT_ROWS = 20_000
SALTS = 16


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once per application, so that Python workers need no shared installation."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="depweft-")) / "depweft.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))


def map_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with a function of this package: the executors are given the package first."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Points the context at the folder the session names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; a cluster without one is an error, since a
    machine-local folder would be lost with the machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local[") or context.master == "local":
        context.setCheckpointDir(tempfile.mkdtemp(prefix="depweft-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


_folders: dict[str, str] = {}
_open: list[list[str]] = []


def _scratch(spark: SparkSession) -> str:
    """This application's folder for written tables below the shared one; removed when the driver ends."""
    ensure_checkpoint_dir(spark)
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _folders[app])
    return _folders[app]


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001, S110 - the session may be gone already
        pass


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a table written to the shared folder and read again.

    It survives the loss of executors, is computed once (a checkpoint of the same rows computes them twice), and the
    planner knows its size.
    """
    spark = df.sparkSession
    path = stage_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_path(spark: SparkSession) -> str:
    """A new folder for one written stage."""
    path = f"{_scratch(spark)}/{uuid.uuid4().hex}"
    for made in _open:
        made.append(path)
    return path


def bucketed(df: DataFrame, n: int, keys: list[str], part: str) -> DataFrame:
    """A stage written as a table of ``n`` buckets by ``keys``, partitioned by ``part``: groupings and joins on the keys
    need no shuffle, and a filter on ``part`` reads its files only."""
    spark = df.sparkSession
    name = f"depweft_{uuid.uuid4().hex}"
    writer = df.repartition(n, *keys).write.format("parquet").partitionBy(part).bucketBy(n, *keys).sortBy(*keys)
    writer.option("path", stage_path(spark)).saveAsTable(name)
    atexit.register(_drop, spark, name)
    return spark.table(name)


def _drop(spark: SparkSession, name: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def placed(df: DataFrame, order: list[str], place: str = "place") -> DataFrame:
    """``df`` with each row's place (from 1) in an order, which should be total: ranges are sorted by their tasks, and the
    rows before a range come from one count for each, so no task holds the whole."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = ranged.withColumn("__range", F.shiftright("__id", 33))
    before = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = part.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    at = F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return part.join(F.broadcast(counts), "__range").withColumn(place, at).drop("__range", "__before", "__id")


@contextlib.contextmanager
def stages(spark: SparkSession) -> Iterator[None]:
    """Removes the stages written inside when it ends; results must have been written or fetched by then.

    Without it they stay until the driver ends, since a frame that reads them may still be used.
    """
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            _remove(spark, path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` holds at most ``limit`` rows; reads no more than ``limit + 1`` of them."""
    return df.limit(limit + 1).count() <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks ``df`` for broadcast after its size was checked; a larger one is left to shuffle joins."""
    return F.broadcast(df) if small(df, limit) else df


def hot_keys(counts: DataFrame, keys: list[str], n: str = "__n") -> list[Row]:
    """The hot keys of a frame of counts per key: at most ``1 / HOT_SHARE`` rows reach the driver, by proof."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.filter(F.col(n) > max(HOT_ROWS, HOT_SHARE * total)).select(*keys).collect()


def is_hot(hot: list[Row], keys: list[str]) -> Column:
    """Whether a row's key is in the short list."""
    by_first: dict[object, list] = {}
    for k in hot:
        by_first.setdefault(tuple(k[c] for c in keys[:-1]), []).append(k[keys[-1]])
    tests = [reduce(lambda a, b: a & b, [F.col(c) == v for c, v in zip(keys, first)], F.col(keys[-1]).isin(last)) for first, last in sorted(by_first.items(), key=repr)]
    return F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))


def salted_join(rows: DataFrame, other: DataFrame, keys: list[str], hot: list[Row], spread: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Equi-join in which rows of hot keys are spread over ``salts`` tasks by a hash of the columns ``spread``; only the
    other side's rows of these keys are copied. ``how``: inner or left."""
    if not hot:
        return rows.join(other, keys, how)
    salt = F.when(is_hot(hot, keys), F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(0)
    copies = F.when(is_hot(hot, keys), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("__salt", salt).join(other.withColumn("__salt", F.explode(copies)), [*keys, "__salt"], how).drop("__salt")
