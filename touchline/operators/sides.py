"""Wide matches to two rows a match, and back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def result(goals_for: Column, goals_against: Column) -> Column:
    """W, D or L; null while a score is missing."""
    return F.when(goals_for > goals_against, "W").when(goals_for < goals_against, "L").when(goals_for == goals_against, "D")


def unpivot_sides(matches: DataFrame, keys: Sequence[str], sides: Mapping[str, tuple[str, str]], home: str = "HomeTeam", away: str = "AwayTeam") -> DataFrame:
    """Two rows per match in one scan.

    ``sides`` maps a column of the result to (its source for the home side, for the away side).
    """

    def side(team: str, other: str, venue: str, at: int) -> Column:
        values = [F.col(pair[at]).alias(name) for name, pair in sides.items()]
        return F.struct(F.col(team).alias("Team"), F.col(other).alias("Opponent"), F.lit(venue).alias("Venue"), *values)

    both = F.explode(F.array(side(home, away, "Home", 0), side(away, home, "Away", 1)))
    long = matches.select(*keys, both.alias("side")).select(*keys, "side.*")
    return long.withColumn("Result", result(F.col("GoalsFor"), F.col("GoalsAgainst"))) if {"GoalsFor", "GoalsAgainst"} <= set(sides) else long


def prepare(tmh: DataFrame) -> DataFrame:
    """Per-match values that windows average: points stay null without a result, the flags are 0."""
    flags = {name: F.coalesce((F.col("Result") == r).cast("double"), F.lit(0.0)) for name, r in (("Win", "W"), ("Draw", "D"), ("Loss", "L"))}
    points = F.when(F.col("Result") == "W", 3.0).when(F.col("Result") == "D", 1.0).when(F.col("Result") == "L", 0.0)
    return tmh.withColumns(
        {
            "Points": points,
            **flags,
            "GoalDiff": F.col("GoalsFor") - F.col("GoalsAgainst"),
            "ShotAccuracy": F.when(F.col("ShotsFor") > 0, F.col("ShotsOnTargetFor") / F.col("ShotsFor")),
            "xGDiff": F.col("xGFor") - F.col("xGAgainst"),
            "xGOver": F.col("GoalsFor") - F.col("xGFor"),
            "xGPerShot": F.when(F.col("ShotsFor") > 0, F.col("xGFor") / F.col("ShotsFor")),
        }
    )


def repivot(long: DataFrame, key: Sequence[str], values: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """One row per match again: each value with ``home_`` and ``away_``; one shuffle, no self-join."""
    picked = [F.max(F.when(F.col("Venue") == venue, F.col(c))).alias(f"{prefix}_{c}") for venue, prefix in (("Home", "home"), ("Away", "away")) for c in values]
    teams = [F.max(F.when(F.col("Venue") == v, F.col("Team"))).alias(n) for v, n in (("Home", "HomeTeam"), ("Away", "AwayTeam"))]
    return long.groupBy(*key, *carry).agg(*teams, *picked)


def with_diffs(wide: DataFrame, stems: Sequence[str]) -> DataFrame:
    return wide.withColumns({f"{s}_diff": F.col(f"home_{s}") - F.col(f"away_{s}") for s in stems})
