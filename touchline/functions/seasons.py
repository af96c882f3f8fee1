"""Season labels: ``2425`` is the season that starts in July 2024."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _two(number: Column) -> Column:
    return F.lpad((number % 100).cast("string"), 2, "0")


def label_of_start(year: Column) -> Column:
    return F.concat(_two(year), _two(year + 1))


def season_label(date: Column) -> Column:
    """A date's season; the year turns in July."""
    return label_of_start(F.year(date) - F.when(F.month(date) >= 7, 0).otherwise(1))


def shift_season(label: Column, by: int) -> Column:
    """The label ``by`` seasons later, wrapping after 99; null stays null."""
    return label_of_start(F.pmod(F.substring(label, 1, 2).cast("int") + by, F.lit(100)))


def season_start(label: Column) -> Column:
    """The year in which a season starts; 50 to 99 are of the last century.  Seasons sort by this, not by their labels."""
    year = F.substring(label, 1, 2).cast("int")
    return year + F.when(year >= 50, 1900).otherwise(2000)


def next_season(label: Column) -> Column:
    return shift_season(label, 1)


def previous_season(label: Column) -> Column:
    return shift_season(label, -1)


def season_labels(first: int, last: int) -> list[str]:
    """Labels of the seasons that start in the years ``first`` to ``last``."""
    return [f"{y % 100:02d}{(y + 1) % 100:02d}" for y in range(first, last + 1)]
