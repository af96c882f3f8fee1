"""Scores of three-way forecasts, odds and calibration, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OUTCOMES = ("H", "D", "A")


def hit(actual: Column, outcome: str) -> Column:
    return F.when(actual == outcome, 1.0).otherwise(0.0)


def checked(actual: Column) -> Column:
    """The result, or an error if it is none of H, D, A."""
    return F.when(actual.isin(*OUTCOMES), actual).otherwise(F.raise_error(F.concat(F.lit("unknown result "), F.coalesce(actual, F.lit("null")))))


def rps(home: Column, draw: Column, actual: Column) -> Column:
    """Ranked probability score of one match: half the squared errors of the two cumulated shares."""
    first = home - hit(actual, "H")
    second = home + draw - hit(actual, "H") - hit(actual, "D")
    return (first * first + second * second) / 2


def brier(home: Column, draw: Column, away: Column, actual: Column) -> Column:
    parts = [(p - hit(actual, o)) * (p - hit(actual, o)) for p, o in zip((home, draw, away), OUTCOMES, strict=True)]
    return parts[0] + parts[1] + parts[2]


def log_loss(home: Column, draw: Column, away: Column, actual: Column, floor: float = 1e-15) -> Column:
    given = F.when(actual == "H", home).when(actual == "D", draw).otherwise(away)
    return -F.ln(F.least(F.greatest(given, F.lit(floor)), F.lit(1.0)))


def pick(home: Column, draw: Column, away: Column) -> Column:
    """The likeliest outcome; home before draw before away on ties."""
    return F.when((home >= draw) & (home >= away), "H").when(draw >= away, "D").otherwise("A")


def devig(home: Column, draw: Column, away: Column) -> tuple[Column, Column, Column]:
    """Decimal odds to probabilities that sum to one; null where an odd is missing or not positive."""
    inverse = [F.when(o > 0, 1.0 / o) for o in (home, draw, away)]
    total = inverse[0] + inverse[1] + inverse[2]
    return tuple(x / total for x in inverse)


def temperature(home: Column, draw: Column, away: Column, degree: float) -> tuple[Column, Column, Column]:
    """Sharpen (below 1) or flatten (above 1) a forecast, keeping its order."""
    powers = [F.pow(p, F.lit(1.0 / degree)) for p in (home, draw, away)]
    total = powers[0] + powers[1] + powers[2]
    return tuple(p / total for p in powers)


def league_adjusted(mu_home: Column, mu_away: Column, gap: Column) -> tuple[Column, Column]:
    """Rates of teams from two leagues, moved apart by half their strength gap each."""
    return mu_home * F.exp(gap * 0.5), mu_away * F.exp(gap * -0.5)


def bin_edges(bins: int = 10) -> list[float]:
    """The edges of equal calibration bins, as evenly spaced doubles come out."""
    return [i * (1.0 / bins) for i in range(bins + 1)]


def bin_of(p: Column, bins: int = 10) -> Column:
    """The bin whose edges hold ``p``; compared with the literal edges, as a product with ``bins`` rounds differently."""
    out = F.lit(0)
    for i, edge in enumerate(bin_edges(bins)[1:-1], start=1):
        out = F.when(p >= F.lit(edge), F.lit(i)).otherwise(out)
    return out
