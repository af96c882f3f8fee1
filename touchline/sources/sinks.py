"""Sinks: tables that are replaced season by season, logs that are appended once, and writes that are skipped when nothing changed."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from collections.abc import Callable, Sequence
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.operators import store
from touchline.operators.aggregates import fingerprint


#: Spark's setting by which a query deletes its shuffled files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Scratch tables written within the innermost ``distilled``.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table, if it is there."""
    system, where = _files(spark, path)
    system.delete(where, True)


def recover(spark: SparkSession, path: str) -> None:
    """Finish or undo a replacement that stopped half way: of ``path`` and ``path.old`` one stays, as ``path``."""
    system, where = _files(spark, path)
    old = _files(spark, f"{path}.old")[1]
    if not system.exists(old):
        return
    if system.exists(where):
        system.delete(old, True)
    elif not system.rename(old, where):
        raise OSError(f"cannot move {path}.old back")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a table; one that a stopped replacement moved away is moved back first."""
    recover(spark, path)
    system, where = _files(spark, path)
    return system.exists(where)


def checked_read(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame | None:
    """The table at ``path``, None if there is none; raises where it lacks a column, so that nothing is built on half a table."""
    if not exists(spark, path):
        return None
    table = spark.read.parquet(path)
    lacking = [c for c in columns if c not in table.columns]
    if lacking:
        raise ValueError(f"{path} lacks {', '.join(lacking)}")
    return table


def replace_table(df: DataFrame, path: str) -> None:
    """Write beside ``path``, then move the old table away and the new one in.

    A failed write changes nothing.  A stop between the two moves leaves the old table as
    ``path.old``; every function here that opens ``path`` moves it back first, and it is deleted
    only once the new table stands.  One writer at a time is taken for granted.
    """
    spark, fresh, old = df.sparkSession, f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").parquet(fresh)
    present = exists(spark, path)
    system, where = _files(spark, path)
    new, gone = _files(spark, fresh)[1], _files(spark, old)[1]
    if present and not system.rename(where, gone):
        raise OSError(f"cannot move {path} away")
    if not system.rename(new, where):
        recover(spark, path)
        raise OSError(f"cannot move the new table to {path}")
    system.delete(gone, True)


def _rows_hash(df: DataFrame) -> dict:
    row = fingerprint(df, sorted(df.columns)).first().asDict()
    return {k: str(v) for k, v in row.items()}


def write_if_changed(df: DataFrame, path: str) -> bool:
    """Replace the table unless it already has the same columns and rows, in any order; whether it was written."""
    spark = df.sparkSession
    if exists(spark, path):
        present = spark.read.parquet(path)
        if dict(present.dtypes) == dict(df.dtypes) and _rows_hash(present) == _rows_hash(df):
            return False
    replace_table(df, path)
    return True


def merge_seasons(df: DataFrame, path: str, columns: Sequence[str], season: str = "Season") -> None:
    """Replace the seasons that ``df`` has; others stay as they are.  An empty ``df`` changes nothing."""
    spark = df.sparkSession
    checked_read(spark, path, [*columns, season])
    df.select(*columns, season).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(season).parquet(path)


def append_predictions(predictions: DataFrame, path: str, key: Sequence[str] = store.KEY) -> None:
    """Append those predictions whose key the log lacks; null keys count as equal.

    Of rows of one key, the first in the order of their other columns as JSON is taken.
    """
    spark = predictions.sparkSession
    log = checked_read(spark, path, key)
    fresh = store.with_competition(predictions)
    rest = F.to_json(F.struct(*[c for c in fresh.columns if c not in key]), {"ignoreNullFields": "false"}) if set(fresh.columns) - set(key) else F.lit(0)
    fresh = fresh.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy(rest))).filter("_place = 1").drop("_place")
    if log is not None:
        fresh = store.new_predictions(log, fresh, key).select(*log.columns)
    fresh.write.mode("append").parquet(path)


def settle_log(path: str, results: DataFrame, on: Sequence[str]) -> None:
    """Fill the log's blanks from results and replace it."""
    spark = results.sparkSession
    recover(spark, path)
    log = spark.read.parquet(path)
    replace_table(store.settle(log, results, on).select(*log.columns), path)


def save_stamped(spark: SparkSession, values: dict[str, float], stamp: str, path: str) -> None:
    """A small mapping with the version it was fitted for."""
    spark.createDataFrame([(stamp, json.dumps(values, sort_keys=True))], "stamp string, body string").coalesce(1).write.mode("overwrite").json(path)


def load_stamped(spark: SparkSession, path: str, stamp: str) -> dict[str, float]:
    """The mapping; raises if it has no stamp or another one."""
    row = spark.read.schema("stamp string, body string").json(path).first()
    if row is None or row["stamp"] != stamp:
        raise ValueError(f"{path} was not made for {stamp}")
    return json.loads(row["body"])


def partitioned_editions(df: DataFrame, path: str, edition: str = "Season") -> None:
    """One folder of CSV files an edition."""
    df.repartition(F.col(edition)).write.mode("overwrite").option("header", True).partitionBy(edition).csv(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share, removed when the driver's Python ends."""
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not known:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="touchline-"))
        known = context.getCheckpointDir()
    path = f"{known.rstrip('/')}/touchline-{name}-{uuid.uuid4().hex}"
    atexit.register(_discard, spark, path)
    return path


def _discard(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # noqa: BLE001  the session may already have ended
        pass


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to a scratch path and read back, and that path: cuts the lineage, and outlives lost executors.

    Spark deletes the shuffled files of the write as it ends, not once the driver's memory is collected.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    passing = _PASSING.get()
    if passing is not None:
        passing.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def distilled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, written; the scratch tables that it wrote on its way are deleted then."""
    passing: list[str] = []
    token = _PASSING.set(passing)
    try:
        df = make()
    finally:
        _PASSING.reset(token)
    table, _ = written(df, name)
    for path in passing:
        delete(spark, path)
    return table
