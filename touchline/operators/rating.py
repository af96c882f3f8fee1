"""The player rating: eligibility, percentiles, sub-ratings, composite, peak, shrinkage, scale, blend."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import scale
from touchline.operators.percentiles import with_percentile, with_percentiles, with_totals
from touchline.operators.ranking import top_n_of_enough
from touchline.sources.sinks import distilled, written

BY = ("role", "Season")
#: Fixed values of the rating: eligibility, weights, shrinkage and blend.
MIN_MINUTES, MIN_POOL, SHRINK_NINETIES, PEAK, EDITION, EDITION_UNMEASURED = 450, 40, 8, 0.15, 0.5, 0.75
SUB_RATINGS = {
    "sub_attack": {"goals_pct": 0.6, "shots_pct": 0.4},
    "sub_build": {"passes_pct": 0.7, "tackles_pct": 0.3},
    "sub_defence": {"tackles_pct": 1.0},
}
COMPOSITE = {"sub_attack": 0.4, "sub_build": 0.3, "sub_defence": 0.27, "cards_pct": 0.03}
LINES = {"defence": ("ECONOMY", "SMALL"), "midfield": ("MEDIUM", "STANDARD")}
LINE_WEIGHTS = {"defence": 4.0, "midfield": 3.0, "attack": 3.0}


def with_eligibility(df: DataFrame) -> DataFrame:
    """Adds ``unrated_reason``; null for those who are rated."""
    pools = with_totals(written(df, "rates")[0], BY, _pool=F.count(F.when(F.col("minutes") >= MIN_MINUTES, 1)))
    return pools.withColumn("unrated_reason", F.when(F.col("minutes") < MIN_MINUTES, "minutes").when(F.col("_pool") < MIN_POOL, "sparse pool")).drop("_pool")


def eligible(df: DataFrame) -> DataFrame:
    return with_eligibility(df).filter("unrated_reason is null").drop("unrated_reason")


def with_sub_ratings(df: DataFrame) -> DataFrame:
    """Percentiles per role and season, then each sub-rating over the metrics that are present."""
    metrics = {"goals": True, "shots": True, "passes": True, "tackles": True, "cards": False}
    df = with_percentiles(df, BY, {f"{m}_pct": (f"{m}_per90", up) for m, up in metrics.items()})
    return df.withColumns({name: scale.weighted_present(weights) for name, weights in SUB_RATINGS.items()})


def with_composite(df: DataFrame) -> DataFrame:
    """Sub-ratings to a base, which a player's best sub-rating then lifts."""
    df = df.withColumn("base", scale.weighted_present(COMPOSITE, 1.0))
    return df.withColumn("composite", F.col("base") * (1 - PEAK) + F.greatest(*SUB_RATINGS) * PEAK)


def _shrunk(df: DataFrame) -> DataFrame:
    """The composite, drawn to the mean of its pool where minutes are few, and the edition's percentile."""
    df = with_composite(with_sub_ratings(eligible(df)))
    mean = with_totals(df, BY, _mean=F.avg("composite"))
    shrunk = (F.col("nineties") * F.col("composite") + F.lit(float(SHRINK_NINETIES)) * F.col("_mean")) / (F.col("nineties") + F.lit(float(SHRINK_NINETIES)))
    return with_percentiles(mean.withColumn("shrunk", F.round(shrunk, 9)).drop("_mean"), BY, {"fifa_pct": ("fifa_overall", True)})


def rated_players(df: DataFrame, anchors: Sequence[tuple[float, float]]) -> DataFrame:
    """All of it: performance rating, the edition on the same scale, and the blend of both."""
    df = distilled(df.sparkSession, lambda: _shrunk(df), "composites")
    df = with_percentile(df, BY, "shrunk", "performance_pct")
    df = df.withColumn("performance_rating", F.round(scale.scale_map(F.col("performance_pct"), anchors), 6)).withColumn("fifa_on_our_scale", F.round(scale.scale_map(F.col("fifa_pct"), anchors), 6))
    weight = F.when(F.col("tackles_per90").isNull(), EDITION_UNMEASURED).otherwise(EDITION)
    return df.withColumn("rating", F.bround((1 - weight) * F.col("performance_rating") + weight * F.col("fifa_on_our_scale"), 0).cast("int"))


def with_line(df: DataFrame) -> DataFrame:
    line = F.lit("attack")
    for name, roles in LINES.items():
        line = F.when(F.col("role").isin(*roles), name).otherwise(line)
    return df.withColumn("line", line)


def _best_first() -> list[Column]:
    return [F.desc("rating"), F.desc("minutes"), F.asc("player")]


def _by_line(chosen: DataFrame, arms: dict[str, Column]) -> DataFrame:
    """Per club and season and arm, which holds the rows of its condition: the rating of each line, by minutes."""
    cells = {f"{arm}_{x}": F.when(held & (F.col("line") == x), F.col("rating")) for arm, held in arms.items() for x in LINE_WEIGHTS}
    return chosen.select("Season", "team", "minutes", *[c.alias(n) for n, c in cells.items()]).groupBy("Season", "team").agg(*[scale.weighted_mean(n, "minutes").alias(n) for n in cells])


def _overall(arm: str) -> Column:
    return scale.weighted_present({f"{arm}_{x}": w for x, w in LINE_WEIGHTS.items()}, 1.0)


def team_strength(rated: DataFrame, best: int, least: int) -> DataFrame:
    """Per club and season: each line's rating over the best players, and the lines' weighted mean."""
    chosen = top_n_of_enough(rated, ["Season", "team"], _best_first(), best, least)
    return _by_line(chosen, {"strength": F.lit(True)}).withColumn("strength_overall", _overall("strength"))


def strength_without_best(rated: DataFrame, best: int, least: int) -> DataFrame:
    """(Season, team, strength_overall, drop): what a club loses without its best player, rebuilt from the next ``best``.

    Clubs that have fewer than ``least`` players without that one are left out.  Both strengths come from one sort.
    """
    chosen = top_n_of_enough(rated, ["Season", "team"], _best_first(), best + 1, least + 1)
    arms = _by_line(chosen, {"full": F.col("_n") <= best, "rest": F.col("_n") > 1})
    both = arms.select("Season", "team", _overall("full").alias("strength_overall"), _overall("rest").alias("_rest"))
    return both.withColumn("drop", F.col("strength_overall") - F.col("_rest")).filter("drop is not null").drop("_rest")
