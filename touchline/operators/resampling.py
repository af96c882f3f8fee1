"""Bootstrap, simulation and coalition values.

Draws come from numpy generators seeded by group, so a result does not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.sources.sinks import written

SEED = 7


#: Distinct values of a bucket, on average; so many times 1000 draws are in memory at once.
BUCKET_ROWS = 2000


def paired_bootstrap(diffs: DataFrame, column: str, n_boot: int = 10_000, seed: int = SEED) -> DataFrame:
    """One row: mean difference and its 95 % interval over resampled matches; rows without a difference take no part.

    A resample of n rows gives each row a Poisson count, so m rows of one value have together a Poisson
    count of mean m: equal values are drawn as one, and the work grows with the values that differ.
    They are dealt to buckets of about ``BUCKET_ROWS`` by a hash; it is enough to keep each bucket's
    values in one task and to add up weighted sums by draw.
    """
    x = F.col(column).cast("double").alias("x")
    values, _ = written(diffs.select(x).filter("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("m")), "values")
    row = values.agg((F.sum(F.col("x") * F.col("m")) / F.sum("m")).alias("mean"), F.count(F.lit(1)).alias("n")).first()
    buckets = max(1, -(-row["n"] // BUCKET_ROWS))
    keyed = values.select(F.pmod(F.xxhash64("x"), F.lit(buckets)).alias("bucket"), "x", "m").repartition(buckets, "bucket")

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("x")
        x, m = frame["x"].to_numpy(), frame["m"].to_numpy()
        rng = np.random.default_rng([seed, int(frame["bucket"].iloc[0])])
        total, count = np.zeros(n_boot), np.zeros(n_boot)
        for i in range(0, n_boot, 1000):
            w = rng.poisson(m, size=(min(1000, n_boot - i), len(x)))
            total[i : i + len(w)], count[i : i + len(w)] = w @ x, w.sum(axis=1)
        return pd.DataFrame({"draw": np.arange(n_boot), "total": total, "n": count})

    draws = keyed.groupBy("bucket").applyInPandas(draw, "draw int, total double, n double")
    means = draws.groupBy("draw").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0.0))).alias("m"))
    return means.agg(F.lit(row["mean"]).alias("mean"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), F.count("m").alias("draws"))


def fixture_rates(fixtures: DataFrame, played: DataFrame, tmh: DataFrame, by: str = "League", prior: float = 5.0) -> DataFrame:
    """``fixtures`` with mu_home and mu_away: the league's home and away means times both teams' relative attack and defence.

    A team's ratio is drawn toward 1 by ``prior`` average matches, so that few matches say little.
    """
    mean = played.groupBy(by).agg(F.avg("FTHG").alias("_home"), F.avg("FTAG").alias("_away"))
    teams = tmh.groupBy(by, "Team").agg(F.count(F.lit(1)).alias("_n"), F.sum("GoalsFor").alias("_for"), F.sum("GoalsAgainst").alias("_against")).join(mean, by)
    usual = F.greatest((F.col("_home") + F.col("_away")) / 2, F.lit(1e-6))
    ratio = [((F.col(c) / usual + prior) / (F.col("_n") + prior)).alias(n) for c, n in (("_for", "_attack"), ("_against", "_defence"))]
    teams = teams.select(by, "Team", *ratio)
    out = fixtures.join(mean, by)
    for side, name in (("HomeTeam", "h"), ("AwayTeam", "a")):
        out = out.join(teams.select(by, F.col("Team").alias(side), F.col("_attack").alias(f"_attack_{name}"), F.col("_defence").alias(f"_defence_{name}")), [by, side], "left")
    out = out.withColumn("mu_home", F.col("_home") * F.col("_attack_h") * F.col("_defence_a")).withColumn("mu_away", F.col("_away") * F.col("_attack_a") * F.col("_defence_h"))
    return out.drop("_home", "_away", "_attack_h", "_attack_a", "_defence_h", "_defence_a")


def simulate_season(fixtures: DataFrame, table: DataFrame, by: str, n_sims: int = 10_000, seed: int = SEED, relegation: int = 3) -> DataFrame:
    """Per team of a group: expected points and the chances of the title, the top four and relegation.

    ``fixtures`` has (by, HomeTeam, AwayTeam, mu_home, mu_away), ``table`` (by, Team, points, gd).
    Ties: points, goal difference, then name.  A group is one league's season, a bounded table.
    """

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        teams = sorted(set(right["Team"]) | set(left["HomeTeam"]) | set(left["AwayTeam"]))
        index = {t: i for i, t in enumerate(teams)}
        rng = np.random.default_rng([seed, *map(ord, str(key[0]))])
        points, gd = np.zeros((n_sims, len(teams))), np.zeros((n_sims, len(teams)))
        for r in right.itertuples():
            points[:, index[r.Team]] += r.points
            gd[:, index[r.Team]] += r.gd
        for r in left.sort_values(["HomeTeam", "AwayTeam"]).itertuples():
            h, a = rng.poisson(r.mu_home, n_sims), rng.poisson(r.mu_away, n_sims)
            i, j = index[r.HomeTeam], index[r.AwayTeam]
            points[:, i] += np.where(h > a, 3, np.where(h == a, 1, 0))
            points[:, j] += np.where(a > h, 3, np.where(h == a, 1, 0))
            gd[:, i] += h - a
            gd[:, j] += a - h
        order = np.lexsort((np.broadcast_to(np.arange(len(teams)), points.shape), -gd, -points), axis=1)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.broadcast_to(np.arange(len(teams)), order.shape), axis=1)
        out = {by: key[0], "Team": teams, "expected_points": points.mean(0), "title": (place == 0).mean(0), "top_four": (place < 4).mean(0), "relegation": (place >= len(teams) - relegation).mean(0)}
        return pd.DataFrame(out)

    kind = f"{by} string, Team string, expected_points double, title double, top_four double, relegation double"
    table = table.select(*[F.col(c).alias(c) for c in (by, "Team", "points", "gd")])  # new columns, also where both come from one table
    return fixtures.groupBy(by).cogroup(table.groupBy(by)).applyInPandas(run, kind)


def coalitions(members: list[str]) -> list[tuple[str, ...]]:
    return [c for n in range(len(members) + 1) for c in combinations(members, n)]


def shapley_weight(size: int, players: int) -> float:
    return factorial(size) * factorial(players - size - 1) / factorial(players)


def shapley(value: Callable[[tuple[str, ...]], float], members: list[str]) -> dict[str, float]:
    """Exact contributions; they add up to value(all) - value(none)."""
    worth = {frozenset(c): value(c) for c in coalitions(members)}
    out = {}
    for m in members:
        rest = [x for x in members if x != m]
        out[m] = sum(shapley_weight(len(c), len(members)) * (worth[frozenset(c) | {m}] - worth[frozenset(c)]) for c in coalitions(rest))
    return out


def shapley_column(member: str, members: list[str], worth: Callable[[tuple[str, ...]], Column]) -> Column:
    """A row's exact contribution of a member, from columns that hold what each coalition is worth."""
    rest = [x for x in members if x != member]
    joined = lambda c: tuple(x for x in members if x in c or x == member)
    return sum((F.lit(shapley_weight(len(c), len(members))) * (worth(joined(c)) - worth(c)) for c in coalitions(rest)), F.lit(0.0))


def cluster_bootstrap(df: DataFrame, cluster: str, numerator: str, denominator: str, resamples: int = 1000, seed: int = SEED) -> DataFrame:
    """draw, value: the ratio of two sums over resampled clusters.

    Clusters are reduced to their two sums first; each gets a Poisson weight a draw, so a resample
    is an aggregation and no row reaches the driver.
    """
    sums = df.groupBy(cluster).agg(F.sum(numerator).cast("double").alias("x"), F.sum(denominator).cast("double").alias("y"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y = np.zeros(resamples), np.zeros(resamples)
        for frame in frames:
            for name, a, b in zip(frame[cluster], frame["x"], frame["y"], strict=True):
                w = np.random.default_rng([seed, *str(name).encode()]).poisson(1.0, resamples)
                x += w * a
                y += w * b
        yield pd.DataFrame({"draw": np.arange(resamples), "x": x, "y": y})

    parts = sums.mapInPandas(run, "draw int, x double, y double").groupBy("draw").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    return parts.select("draw", (F.col("x") / F.nullif(F.col("y"), F.lit(0.0))).alias("value"))
