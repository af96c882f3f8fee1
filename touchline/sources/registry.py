"""Versions of a fitted model: a folder each, with what is needed to interpret it, and a pointer to the latest.

Everything is written through Spark's file system, so a registry lives wherever tables do.
"""

from __future__ import annotations

import datetime
import json
import re

from pyspark.sql import DataFrame, SparkSession

from touchline.sources import sinks

LATEST = "latest"
_SCHEMA = "version string, trained_at string, meta string, body string"


def make_version(trained_through: datetime.date, now: datetime.datetime | None = None) -> str:
    """The last day of the data and the time of the build: the same window fitted again is another version."""
    now = now or datetime.datetime.now(datetime.UTC)
    return f"{trained_through:%Y%m%d}-{now:%Y%m%dT%H%M%S%f}Z"


def save(spark: SparkSession, root: str, version: str, model: dict, meta: dict, trained_at: datetime.datetime | None = None, mark_latest: bool = True) -> None:
    """Write a version, and point to it unless told not to.

    A version is never written twice.  The pointer moves only after the version stands, so a stop in
    between leaves the one before it.
    """
    if not re.fullmatch(r"[A-Za-z0-9._-]+", version) or version == LATEST:
        raise ValueError(f"{version!r} is no name for a version")
    if sinks.exists(spark, f"{root}/{version}"):
        raise FileExistsError(f"version {version} exists")
    at = (trained_at or datetime.datetime.now(datetime.UTC)).isoformat()
    spark.createDataFrame([(version, at, json.dumps(meta, sort_keys=True), json.dumps(model))], _SCHEMA).coalesce(1).write.json(f"{root}/{version}")
    if mark_latest:
        sinks.replace_table(spark.createDataFrame([(version,)], "version string").coalesce(1), f"{root}/{LATEST}")


def latest(spark: SparkSession, root: str) -> str | None:
    if not sinks.exists(spark, f"{root}/{LATEST}"):
        return None
    row = spark.read.schema("version string").parquet(f"{root}/{LATEST}").first()
    return row["version"] if row else None


def load(spark: SparkSession, root: str, version: str = LATEST) -> tuple[dict, dict]:
    """(model, meta) of a version; raises where there is none."""
    name = latest(spark, root) if version == LATEST else version
    if name is None or not sinks.exists(spark, f"{root}/{name}"):
        raise FileNotFoundError(f"{root} has no version {name or LATEST}")
    row = spark.read.schema(_SCHEMA).json(f"{root}/{name}").first()
    if row is None or row["version"] != name:
        raise ValueError(f"{root}/{name} is not whole")
    return json.loads(row["body"]), json.loads(row["meta"])


def list_versions(spark: SparkSession, root: str) -> DataFrame:
    """(version, trained_at, meta), the newest first; empty where there is no registry."""
    system, where = sinks._files(spark, root)
    names = [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []
    paths = [f"{root}/{n}" for n in names if n != LATEST and not n.startswith((LATEST + ".", "_", "."))]
    if not paths:
        return spark.createDataFrame([], "version string, trained_at string, meta string")
    return spark.read.schema(_SCHEMA).json(paths).select("version", "trained_at", "meta").orderBy("trained_at", "version", ascending=False)
