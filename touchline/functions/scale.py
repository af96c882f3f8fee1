"""Percentiles, scales, shrinkage and weighted blends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentile_within(metric: str, by: Sequence[str], higher_is_better: bool = True) -> Column:
    """Average rank over the number of non-null values of the group; null for a null value."""
    group = Window.partitionBy(*by)
    order = group.orderBy(F.asc_nulls_last(metric))
    ties = F.count(metric).over(Window.partitionBy(*by, metric))
    share = (F.rank().over(order) + (ties - 1) / 2) / F.count(metric).over(group)
    return F.when(F.col(metric).isNotNull(), share if higher_is_better else 1 - share)


def scale_map(x: Column, anchors: Sequence[tuple[float, float]]) -> Column:
    """Piecewise linear through ``anchors``, level beyond both ends; null stays null."""
    out = F.lit(float(anchors[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(anchors, anchors[1:], strict=False))):
        out = F.when(x <= F.lit(float(x1)), F.lit(float(y0)) + (x - F.lit(float(x0))) * F.lit((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(x.isNotNull(), F.when(x <= F.lit(float(anchors[0][0])), F.lit(float(anchors[0][1]))).otherwise(out))


def shrink_toward_mean(value: str, weight: str, by: Sequence[str], k: float) -> Column:
    """(weight * value + k * group mean) / (weight + k)."""
    mean = F.avg(value).over(Window.partitionBy(*by))
    return (F.col(weight) * F.col(value) + F.lit(float(k)) * mean) / (F.col(weight) + F.lit(float(k)))


def weighted_present(weights: dict[str, float], max_missing: float = 0.5) -> Column:
    """Weighted mean of the columns that are present; null if more than ``max_missing`` of the
    weight is absent.  A negative weight counts ``1 - value``."""
    total = sum(abs(w) for w in weights.values())
    value = held = None
    for name, w in weights.items():
        c = F.col(name)
        part = F.coalesce((c if w >= 0 else 1 - c) * F.lit(abs(float(w))), F.lit(0.0))
        own = F.when(c.isNotNull(), F.lit(abs(float(w)))).otherwise(F.lit(0.0))
        value, held = (part, own) if value is None else (value + part, held + own)
    return F.when((held > 0) & (held >= F.lit(total * (1 - max_missing))), value / held)


def weighted_mean(value: str, weight: str) -> Column:
    """Aggregate: mean by weight, or the plain mean where the weights sum to nothing."""
    total = F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))
    return F.when(total > 0, F.sum(F.col(value) * F.col(weight)) / total).otherwise(F.avg(value))


def guarded(numerator: Column, denominator: Column) -> Column:
    """A ratio, or null where the denominator is not positive."""
    return F.when(denominator > 0, numerator / denominator)


def coverage_gate(df: DataFrame, weights: dict[str, float], by: Sequence[str], least: float = 0.5) -> DataFrame:
    """Null out a metric in the pools where fewer than ``least`` of the rows have it."""
    pool = Window.partitionBy(*by)
    return df.withColumns({m: F.when(F.avg(F.col(m).isNotNull().cast("double")).over(pool) >= least, F.col(m)) for m in weights})
