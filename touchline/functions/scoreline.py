"""Scoreline distributions as array columns: ``cells[h][a]`` is the probability of h to a."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_GOALS = 10


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, also where the body repeats it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def poisson(mu: Column, most: int = MAX_GOALS) -> Column:
    """array<double>: P(k goals), k = 0..most, of a Poisson rate."""
    return F.array(*[F.exp(-mu) * F.pow(mu, F.lit(k)) / F.lit(float(math.factorial(k))) for k in range(most + 1)])


def corrected(h: Column, a: Column, mu_home: Column, mu_away: Column, rho: Column) -> Column:
    """Low-score correction of a cell; 1 beyond the four lowest cells."""
    least = F.lit(1e-10)
    return (
        F.when((h == 0) & (a == 0), F.greatest(1 - mu_home * mu_away * rho, least))
        .when((h == 0) & (a == 1), F.greatest(1 + mu_home * rho, least))
        .when((h == 1) & (a == 0), F.greatest(1 + mu_away * rho, least))
        .when((h == 1) & (a == 1), F.greatest(1 - rho, least))
        .otherwise(F.lit(1.0))
    )


def cells(mu_home: Column, mu_away: Column, rho: Column | float = 0.0, most: int = MAX_GOALS) -> Column:
    """array<array<double>> that sums to one: independent Poisson goals with the correction."""
    rho = rho if isinstance(rho, Column) else F.lit(float(rho))

    def grid(goals: Column) -> Column:
        return F.transform(goals["home"], lambda p, h: F.transform(goals["away"], lambda q, a: p * q * corrected(h, a, goals["mh"], goals["ma"], goals["rho"])))

    given = F.struct(poisson(mu_home, most).alias("home"), poisson(mu_away, most).alias("away"), mu_home.alias("mh"), mu_away.alias("ma"), rho.alias("rho"))
    return normalised(let(given, grid))


def normalised(grid: Column) -> Column:
    def total(rows: Column) -> Column:
        return F.aggregate(rows, F.lit(0.0), lambda s, row: s + F.aggregate(row, F.lit(0.0), lambda t, x: t + x))

    def scaled(known: Column) -> Column:
        return F.transform(known["rows"], lambda row: F.transform(row, lambda x: x / known["total"]))

    return let(grid, lambda rows: let(F.struct(rows.alias("rows"), total(rows).alias("total")), scaled))


def flat(grid: Column) -> Column:
    """array<struct<h, a, p>> in row order."""
    return F.flatten(F.transform(grid, lambda row, h: F.transform(row, lambda p, a: F.struct(h.alias("h"), a.alias("a"), p.alias("p")))))


def share(grid: Column, holds) -> Column:
    """The probability of the cells for which ``holds(h, a)``."""
    return F.aggregate(F.filter(flat(grid), lambda c: holds(c["h"], c["a"])), F.lit(0.0), lambda s, c: s + c["p"])


def outcomes(mu_home: Column, mu_away: Column, rho: float = 0.0) -> Column:
    """struct<home, draw, away>: the three probabilities without the grid.

    One fold over the goals adds up both marginals and what of them stands below, so it takes 11
    steps and not 121 cells; the four corrected cells are then set right.
    """

    def poisson(mu: Column) -> Column:
        first = F.exp(-mu)
        return F.transform(F.sequence(F.lit(0), F.lit(MAX_GOALS)), lambda k: first * F.pow(mu, k) / F.factorial(k))

    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("x", "y", "home", "draw", "away")])
    pairs = F.zip_with(poisson(mu_home), poisson(mu_away), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    sums = F.aggregate(
        pairs,
        zero,
        lambda s, p: F.struct(
            (s["x"] + p["x"]).alias("x"),
            (s["y"] + p["y"]).alias("y"),
            (s["home"] + p["x"] * s["y"]).alias("home"),
            (s["draw"] + p["x"] * p["y"]).alias("draw"),
            (s["away"] + p["y"] * s["x"]).alias("away"),
        ),
        lambda s: _corrected(s, mu_home, mu_away, rho),
    )
    return sums


def _corrected(s: Column, m: Column, n: Column, rho: float) -> Column:
    low, least = F.exp(-m - n), F.lit(1e-10)
    d00, d01 = F.greatest(1 - m * n * rho, least) - 1, (F.greatest(1 + m * rho, least) - 1) * n
    d10, d11 = (F.greatest(1 + n * rho, least) - 1) * m, (F.greatest(F.lit(1.0 - rho), least) - 1) * m * n
    home, draw, away = s["home"] + low * d10, s["draw"] + low * (d00 + d11), s["away"] + low * d01
    total = home + draw + away
    return F.struct((home / total).alias("home"), (draw / total).alias("draw"), (away / total).alias("away"))


def home_win(grid: Column) -> Column:
    return share(grid, lambda h, a: h > a)


def draw(grid: Column) -> Column:
    return share(grid, lambda h, a: h == a)


def away_win(grid: Column) -> Column:
    return share(grid, lambda h, a: h < a)


def over(grid: Column, goals: float = 2.5) -> Column:
    return share(grid, lambda h, a: (h + a) > goals)


def both_score(grid: Column) -> Column:
    return share(grid, lambda h, a: (h > 0) & (a > 0))


def top_scores(grid: Column, n: int = 3) -> Column:
    """The ``n`` likeliest cells, likeliest first; ties by fewer home goals, then fewer away goals."""
    key = F.transform(flat(grid), lambda c: F.struct((-c["p"]).alias("minus"), c["h"].alias("h"), c["a"].alias("a")))
    return F.transform(F.slice(F.array_sort(key), 1, n), lambda c: F.struct(c["h"].alias("h"), c["a"].alias("a"), (-c["minus"]).alias("p")))
