"""How much a club's rating hangs on a selection: quotas by line, and the club without its best player."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.ranking import top_n_per_group


def quota_squad(df: DataFrame, by: Sequence[str], line: str, quota: dict[str, int] | None, total: int, order: Sequence[Column]) -> DataFrame:
    """The ``total`` rows of a group under a floor for each line: its own best first, then the best of the rest.

    A floor is no cap, and a line with fewer rows than its floor gives what it has.  Without a quota it is
    the best ``total``.  ``order`` must end in a unique key.
    """
    if not quota:
        return top_n_per_group(df, by, order, total)
    floor = F.lit(0)
    for name, n in quota.items():
        floor = F.when(F.col(line) == name, F.lit(n)).otherwise(floor)
    in_line = F.row_number().over(Window.partitionBy(*by, line).orderBy(*order))
    marked = df.withColumn("_reserved", in_line <= floor)
    taken = F.sum(F.col("_reserved").cast("int")).over(Window.partitionBy(*by))
    place = F.row_number().over(Window.partitionBy(*by, "_reserved").orderBy(*order))
    return marked.withColumns({"_taken": taken, "_place": place}).filter(F.col("_reserved") | (F.col("_place") <= F.lit(total) - F.col("_taken"))).drop("_reserved", "_taken", "_place")


def without_best(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """All rows but the first of each group."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_place", place).filter("_place > 1").drop("_place")


def strength_drops(full: DataFrame, without: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, drop): what each club's value loses; clubs that one of the tables lacks are left out."""
    other = without.select(*keys, F.col(value).alias("_without"))
    return full.join(other, list(keys)).withColumn("drop", F.col(value) - F.col("_without")).filter("drop is not null").select(*keys, value, "drop")


def drop_summary(drops: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: n, quartiles of the drop and the club that loses most; the first by its keys of a tie."""
    top = drops.agg(F.max("drop").alias("_most"))
    first = drops.join(F.broadcast(top), F.col("drop") == F.col("_most")).agg(F.min(F.struct(*keys)).alias("_worst"))
    sums = drops.agg(F.count(F.lit(1)).alias("n"), F.percentile("drop", 0.25).alias("q1_drop"), F.percentile("drop", 0.5).alias("median_drop"), F.percentile("drop", 0.75).alias("q3_drop"), F.max("drop").alias("max_drop"))
    return sums.crossJoin(F.broadcast(first)).select("n", "q1_drop", "median_drop", "q3_drop", "max_drop", *[F.col("_worst")[k].alias(f"max_{k}") for k in keys])


def publishable_seasons(clubs: DataFrame, season: str = "Season", share: float = 0.75) -> DataFrame:
    """(season, clubs): the seasons with at least ``share`` of a typical season's clubs.

    The typical one is the median over the seasons but the last by label, which would else be measured
    against itself; a lone season is its own measure.
    """
    counts = clubs.filter(F.col(season).isNotNull()).groupBy(season).agg(F.count(F.lit(1)).alias("clubs"))
    marks = counts.agg(F.max(season).alias("_last"), F.count(F.lit(1)).alias("_n"))
    marked = counts.crossJoin(F.broadcast(marks))
    typical = marked.agg(F.expr(f"percentile(if({season} <> _last or _n = 1, clubs, null), 0.5)").alias("_typical"))
    return marked.crossJoin(F.broadcast(typical)).filter(F.col("clubs") >= share * F.col("_typical")).select(season, "clubs")


def default_season(rows: DataFrame, season: str = "Season", share: float = 0.5) -> DataFrame:
    """(season): the last with at least ``share`` of the rows of the largest."""
    counts = rows.groupBy(season).agg(F.count(F.lit(1)).alias("n"))
    most = counts.agg((F.max("n") * share).alias("_least"))
    return counts.join(F.broadcast(most), F.col("n") >= F.col("_least")).agg(F.max(season).alias(season)).filter(F.col(season).isNotNull())
