"""Percentiles within pools of any size: a pool is cut into slices of values, and slices are ranked side by side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.sources.sinks import written

#: Rows of a slice, about; more only where so many share one value.
SLICE_ROWS = 100_000


def join_small(df: DataFrame, small: DataFrame, by: Sequence[str], broadcast: bool = True) -> DataFrame:
    """``df`` with the columns of its row of ``small``, one row a key; null keys count as equal."""
    other = small.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], *[c for c in small.columns if c not in by])
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)])
    return df.join(F.broadcast(other) if broadcast else other, match, "left").drop(*[f"_k{i}" for i in range(len(by))])


def with_totals(df: DataFrame, by: Sequence[str], **totals: Column) -> DataFrame:
    """Adds aggregates of each group: one row a group goes back to all its rows, none of which move.  ``df`` is read twice."""
    return join_small(df, df.groupBy(*by).agg(*[c.alias(n) for n, c in totals.items()]), by)


def with_standardised(df: DataFrame, by: Sequence[str], metrics: Mapping[str, str], least: int = 10) -> DataFrame:
    """Adds the z-score (sample deviation) of each column within its stratum, under its name; null in strata below ``least`` values.

    ``df`` is a written table, read twice: no stratum is brought together, only its moments go back to its rows.
    """
    totals = {}
    for i, c in enumerate(metrics.values()):
        totals |= {f"_c{i}": F.count(c), f"_m{i}": F.avg(c), f"_s{i}": F.stddev_samp(c)}
    scores = {out: F.when(F.col(f"_c{i}") >= least, (F.col(c) - F.col(f"_m{i}")) / F.nullif(F.col(f"_s{i}"), F.lit(0.0))) for i, (out, c) in enumerate(metrics.items())}
    return with_totals(df, by, **totals).withColumns(scores).drop(*totals)


def _ranked(df: DataFrame, by: Sequence[str], value: str, weight: Column) -> DataFrame:
    """Adds ``_share``: the average rank of ``value``, of which a row stands for ``weight``, over the weight of its group.

    ``df`` is a written table, read three times; its values are not null.
    """
    most = df.groupBy(*by).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0
    slices = -(-most // SLICE_ROWS)
    if slices > 1:
        shares = [i / slices for i in range(1, slices)]
        bounds = df.groupBy(*by).agg(F.percentile_approx(value, shares, 20 * slices).alias("_bounds"))
        sliced = join_small(df, bounds, by).withColumn("_slice", F.size(F.filter("_bounds", lambda b: b < F.col(value)))).drop("_bounds")
    else:
        sliced = df.withColumn("_slice", F.lit(0))
    inner = [*by, "_slice"]
    sums = sliced.groupBy(*inner).agg(F.sum(weight).alias("_in"))
    group = Window.partitionBy(*by)
    before = sums.select(*inner, (F.sum("_in").over(group.orderBy("_slice")) - F.col("_in")).alias("_before"), F.sum("_in").over(group).alias("_total"))
    ties = F.sum(weight).over(Window.partitionBy(*inner, value))
    upto = F.sum(weight).over(Window.partitionBy(*inner).orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = join_small(sliced.withColumns({"_ties": ties, "_upto": upto}), before, inner)
    rank = F.col("_before") + F.col("_upto") - F.col("_ties") + 1
    return numbered.withColumn("_share", (rank + (F.col("_ties") - 1) / 2) / F.col("_total")).drop("_slice", "_ties", "_upto", "_before", "_total")


def with_percentiles(df: DataFrame, by: Sequence[str], metrics: Mapping[str, tuple[str, bool]]) -> DataFrame:
    """Adds ``scale.percentile_within`` of each metric under its name: (column, whether higher is better).

    For metrics whose values repeat: each distinct value is counted once, ranked, and goes back by equal keys;
    Spark broadcasts the values where they are few.  ``df`` is a written table, read twice.
    """
    cells = F.array(*[F.struct(F.lit(name).alias("_metric"), F.col(c).cast("double").alias("_x")) for name, (c, _) in metrics.items()])
    values = df.select(*by, F.explode(cells).alias("_c")).select(*by, "_c.*").filter("_x is not null")
    counted, _ = written(values.groupBy(*by, "_metric", "_x").agg(F.count(F.lit(1)).alias("_n")), "values")
    ranked, _ = written(_ranked(counted, [*by, "_metric"], "_x", F.col("_n")), "ranks")
    for name, (column, up) in metrics.items():
        own = ranked.filter(F.col("_metric") == name).select(*by, "_x", (F.col("_share") if up else 1 - F.col("_share")).alias(name))
        keyed = df.withColumn("_x", F.col(column).cast("double"))
        df = join_small(keyed, own, [*by, "_x"], broadcast=False).drop("_x")
    return df


def with_percentile(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Adds ``scale.percentile_within`` of a value that hardly repeats: the rows move once, to their slices.

    ``df`` is a written table.
    """
    ranked = _ranked(df.filter(F.col(value).isNotNull()), by, value, F.lit(1)).withColumnRenamed("_share", out)
    return ranked.unionByName(df.filter(F.col(value).isNull()).withColumn(out, F.lit(None).cast("double")))
