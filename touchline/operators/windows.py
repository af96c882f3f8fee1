"""Leak-safe windows: a row sees only what came before it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.joins import asof_latest


def prev_window(keys: Sequence[str], order: Sequence[str], size: int):
    """The ``size`` rows before the current one within ``keys``."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-size, -1)


def with_form(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, metrics: Mapping[str, str], suffix: str) -> DataFrame:
    """Mean or sum of each metric over the previous ``size`` rows, and how many there were.

    All metrics share one window specification, so they cost one exchange and one sort.  Without
    any earlier row a metric is null, never zero.
    """
    frame = prev_window(keys, order, size)
    how = {"mean": F.avg, "sum": F.sum, "count": F.count}
    columns = {f"{m}_{suffix}": how[f](m).over(frame) for m, f in metrics.items()}
    return df.withColumns(columns | {f"matches_used_{suffix}": F.count(F.lit(1)).over(frame)})


def frozen_form(fixtures: DataFrame, history: DataFrame, key: str, fixture_time: str, time: str, tie: Sequence[str], size: int, metrics: Sequence[str], suffix: str) -> DataFrame:
    """To each fixture, its team's means over its last ``size`` matches strictly before, and how many there were.

    Form stays frozen at the last played match: other fixtures of the team do not push it out.  One
    window over the history and one as-of union; a team without history gets nulls.
    """
    recent = Window.partitionBy(key).orderBy(time, *tie).rowsBetween(1 - size, 0)
    means = [F.avg(m).over(recent).alias(f"{m}_{suffix}") for m in metrics]
    rows = history.select(key, time, *tie, *means, F.count(F.lit(1)).over(recent).alias(f"matches_used_{suffix}"))
    return asof_latest(fixtures, rows, [key], fixture_time, time, [f"{m}_{suffix}" for m in metrics] + [f"matches_used_{suffix}"], tie=tie)


def days_since_last(keys: Sequence[str], date: str, order: Sequence[str]) -> Column:
    return F.datediff(F.col(date), F.lag(date).over(Window.partitionBy(*keys).orderBy(*order)))


def trailing_count(keys: Sequence[str], date: str, days: int) -> Column:
    """Rows of the same key in the ``days`` days before the row's own date."""
    number = F.datediff(F.col(date), F.lit("1970-01-01").cast("date")).cast("long")
    return F.count(F.lit(1)).over(Window.partitionBy(*keys).orderBy(number).rangeBetween(-days, -1))


def recent_and_total(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, value: str) -> DataFrame:
    """Per key: sum of the latest ``n`` values, and of all."""
    latest = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return latest.groupBy(*keys).agg(F.sum(F.when(F.col("_n") <= n, F.col(value))).alias(f"{value}_last_{n}"), F.sum(value).alias(f"{value}_total"), F.count(F.lit(1)).alias("played"))
