"""The prediction log: append once, settle later."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.joins import checked_join

KEY = ("model_version", "League", "competition", "Date", "HomeTeam", "AwayTeam")


def with_competition(df: DataFrame) -> DataFrame:
    """``domestic`` where the competition is absent, null or empty."""
    if "competition" not in df.columns:
        return df.withColumn("competition", F.lit("domestic"))
    return df.withColumn("competition", F.coalesce(F.nullif(F.col("competition"), F.lit("")), F.lit("domestic")))


def new_predictions(log: DataFrame, predictions: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The predictions whose key the log lacks; null keys count as equal."""
    known = with_competition(log).select(*[F.col(k).alias(f"_log_{k}") for k in key]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_log_{k}")) for k in key])
    return with_competition(predictions).join(known, same, "left_anti")


def settle(log: DataFrame, results: DataFrame, on: Sequence[str]) -> DataFrame:
    """Fill in results where they are still blank; settled rows never change.

    Running it fails if ``results`` repeats a key.
    """
    other = results.select(*on, *[F.col(c).alias(f"_{c}") for c in ("FTHG", "FTAG", "FTR")])
    blank = F.col("actual_result").isNull() & F.col("_FTR").isNotNull()
    filled = {f"actual_{n}": F.when(blank, F.col(f"_{c}")).otherwise(F.col(f"actual_{n}")) for n, c in (("home", "FTHG"), ("away", "FTAG"), ("result", "FTR"))}
    return checked_join(log, other, on).withColumns(filled).drop("_FTHG", "_FTAG", "_FTR")


def stranded(log: DataFrame, today, days: int) -> DataFrame:
    """Predictions of matches that should long have a result."""
    return log.filter(F.col("actual_result").isNull() & (F.datediff(F.lit(today).cast("date"), "Date") > days))
