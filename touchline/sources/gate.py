"""A gate before a second source: only whole rows pass, and what it cannot complete is parked.

A match that a working source cannot complete is written to a dead-letter table with the number of
attempts and the date of the last one, and is left alone until ``RETRY_DAYS`` have gone by.  Matches
that have arrived from any source leave the table.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.sources import sinks

KEY = ("League", "Season", "Date", "HomeTeam", "AwayTeam")
RETRY_DAYS = 7
_PARKED = "League string, Season string, Date date, HomeTeam string, AwayTeam string, attempts int, last_attempt date"


def _without(rows: DataFrame, other: DataFrame, on: Sequence[str], how: str = "left_anti") -> DataFrame:
    """Rows whose key is not (or is: left_semi) in ``other``; null keys count as equal."""
    known = other.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(on)]).distinct()
    match = F.lit(True)
    for i, k in enumerate(on):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(known, match, how)


def missing_matches(schedule: DataFrame, history: DataFrame) -> DataFrame:
    """Matches of the schedule whose home side has no row in the history (one row a team and match)."""
    there = history.select("League", "Season", "Date", F.col("Team").alias("HomeTeam"))
    return _without(schedule, there, ["League", "Season", "Date", "HomeTeam"])


def load_parked(spark: SparkSession, path: str, history: DataFrame | None = None) -> DataFrame:
    """The dead-letter table without what has arrived since; empty where there is none.

    A table that lacks a column, and rows without date or attempts, count as absent: that costs one
    wasted attempt.
    """
    try:
        table = sinks.checked_read(spark, path, [*KEY, "attempts", "last_attempt"])
    except ValueError:
        table = None
    if table is None:
        return spark.createDataFrame([], _PARKED)
    kinds = [part.split() for part in _PARKED.split(", ")]
    rows = table.select(*[F.col(n).cast(t).alias(n) for n, t in kinds]).filter("Date is not null and attempts is not null and last_attempt is not null")
    return rows if history is None else missing_matches(rows, history)


def eligible(missing: DataFrame, parked: DataFrame, today: datetime.date, retry_days: int = RETRY_DAYS) -> DataFrame:
    """Missing matches that are not within their time of rest."""
    resting = parked.filter(F.col("last_attempt") > F.date_sub(F.lit(today).cast("date"), retry_days))
    return _without(missing, resting, KEY)


def split_complete(fetched: DataFrame, needed: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(whole rows, rows that lack one of the ``needed`` columns)."""
    lacks = F.lit(False)
    for c in needed:
        lacks = lacks | F.col(c).isNull()
    return fetched.filter(~lacks), fetched.filter(lacks)


def park(refused: DataFrame, whole: DataFrame, wanted: DataFrame, parked: DataFrame, today: datetime.date) -> DataFrame:
    """The dead-letter table after this attempt.

    Only matches that the attempt was for, in leagues where it brought at least one whole row: a
    league without any is a source that did not work, which says nothing about a match.
    """
    worked = whole.select("League").distinct()
    failed = _without(_without(refused, worked, ["League"], "left_semi"), wanted, KEY, "left_semi").select(*KEY).distinct()
    now = failed.withColumn("attempts", F.lit(1)).withColumn("last_attempt", F.lit(today).cast("date"))
    return parked.unionByName(now).groupBy(*KEY).agg(F.sum("attempts").cast("int").alias("attempts"), F.max("last_attempt").alias("last_attempt"))


def run_gate(schedule: DataFrame, history: DataFrame, fetch, needed: Sequence[str], path: str, today: datetime.date, retry_days: int = RETRY_DAYS) -> DataFrame | None:
    """Whole rows for the history; None if there is nothing worth fetching.

    ``fetch(wanted)`` returns rows with the key and the needed columns, for the wanted matches' leagues;
    others than the wanted ones are not passed on.  The dead-letter table at ``path`` is replaced.
    """
    spark = schedule.sparkSession
    parked, parked_path = sinks.written(load_parked(spark, path, history), "parked")
    wanted, _ = sinks.written(eligible(missing_matches(schedule.select(*KEY).distinct(), history), parked, today, retry_days), "wanted")
    if wanted.isEmpty():
        sinks.replace_table(parked, path)
        sinks.delete(spark, parked_path)
        return None
    fetched, _ = sinks.written(fetch(wanted), "fetched")
    whole, refused = split_complete(fetched, needed)
    sinks.replace_table(park(refused, whole, wanted, parked, today), path)
    sinks.delete(spark, parked_path)
    return _without(whole, wanted, KEY, "left_semi")
