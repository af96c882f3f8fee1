"""Tables that are built part by part and can go on where a stopped job left off.

Every part (a matchday, a season) is kept with a fingerprint of the rows it was made from.  A part
whose rows have changed, or that is not there, is built; the others stay.  Parts are written in
groups, each group's parts before their entry in the manifest: a stop in between builds that group
again, and never leaves half a part that counts as whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.aggregates import fingerprint
from touchline.sources import sinks

#: Parts of a group.
EVERY = 25


def part_fingerprints(inputs: DataFrame, part: str) -> DataFrame:
    """(part, mark): a hash of each part's rows in any order; one aggregation."""
    columns = sorted(inputs.columns)
    marks = fingerprint(inputs, columns, [part])
    return marks.select(F.col(part).cast("string").alias("part"), F.concat_ws("/", F.col("rows").cast("string"), F.col("hash_sum").cast("string"), F.col("hash_xor").cast("string")).alias("mark"))


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    where = f"{path}/manifest"
    known = spark.read.schema("part string, mark string, at long").parquet(where) if sinks.exists(spark, where) else spark.createDataFrame([], "part string, mark string, at long")
    return known.groupBy("part").agg(F.max_by("mark", "at").alias("mark"))


def stale_parts(inputs: DataFrame, path: str, part: str) -> list[tuple[str, str]]:
    """(part, mark) of the parts that must be built, in order.  The driver holds a line a part."""
    known = _manifest(inputs.sparkSession, path).withColumnRenamed("mark", "known")
    now = part_fingerprints(inputs, part).filter("part is not null").join(known, "part", "left")
    return [(r["part"], r["mark"]) for r in now.filter("known is null or known <> mark").orderBy("part").collect()]


def resume(inputs: DataFrame, path: str, part: str, build: Callable[[list[str]], DataFrame], every: int = EVERY, most: int | None = None) -> int:
    """Build what is stale; returns how many parts were built.

    ``inputs`` are the rows that a part depends on, marked with it (null parts are ignored); ``build``
    gets the names of a group's parts and returns their rows, with a column ``part``.  ``most`` stops
    after so many parts, as a time limit would.
    """
    spark = inputs.sparkSession
    todo = stale_parts(inputs, path, part)[:most]
    for start in range(0, len(todo), every):
        group = todo[start : start + every]
        for name, _ in group:  # a part whose rows are gone must not keep its old ones
            sinks.delete(spark, f"{path}/rows/part={name}")
        build([name for name, _ in group]).write.mode("append").partitionBy("part").parquet(f"{path}/rows")
        at = int(spark.range(1).select(F.unix_micros(F.current_timestamp())).first()[0])
        spark.createDataFrame([(name, mark, at) for name, mark in group], "part string, mark string, at long").coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return len(todo)


def load(spark: SparkSession, path: str, schema: str, inputs: DataFrame | None = None, part: str = "part") -> DataFrame:
    """The parts that are whole; with ``inputs``, those of them that are not stale.  ``schema`` is that of the rows, without the part."""
    whole = _manifest(spark, path)
    if inputs is not None:
        whole = whole.join(part_fingerprints(inputs, part), ["part", "mark"], "left_semi")
    if not sinks.exists(spark, f"{path}/rows"):
        return spark.createDataFrame([], f"{schema}, part string")
    return spark.read.schema(f"{schema}, part string").parquet(f"{path}/rows").join(whole.select("part"), "part", "left_semi")


def clear(spark: SparkSession, path: str) -> None:
    sinks.delete(spark, path)
