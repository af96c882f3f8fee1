"""Squad strength: rosters rated from history, or from an edition through curves on our own scale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import scale
from touchline.functions.seasons import season_start
from touchline.operators.percentiles import join_small
from touchline.operators.ranking import top_n_of_enough
from touchline.sources.sinks import written

#: A curve of fewer points gives way to the one of its whole season.
MIN_CURVE_POINTS = 5
#: Values read off curves that are broadcast at most.
BROADCAST_ANSWERS = 200_000
#: Players of a club that a strength is made of.
BEST_N = 15


def curve_points(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """(by, x, y, points): the mean of y at each distinct x, and how many points the curve has; nulls take no part."""
    points = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).cast("double").alias("x")).agg(F.avg(y).alias("y"))
    counts = points.groupBy(*by).agg(F.count(F.lit(1)).alias("points"))
    return points.join(counts, list(by))


def interpolate(df: DataFrame, points: DataFrame, by: Sequence[str], x: str, out: str) -> DataFrame:
    """``df`` with the curve of its group read off at ``x``: straight between points, level beyond both ends.

    Null where the group has no curve, or ``x`` or a key is null.  Only the distinct values that are
    asked for meet the points: both are sorted once per curve, each value takes the nearest point
    below and above it, and the answers go back by equal keys.
    """
    shape = "struct<x: double, y: double>"
    asked = df.select(*by, F.col(x).cast("double").alias("_x")).filter(F.col("_x").isNotNull()).distinct().withColumn("_p", F.lit(None).cast(shape))
    both = asked.unionByName(points.select(*by, F.col("x").alias("_x"), F.struct("x", "y").alias("_p")))
    order = Window.partitionBy(*by).orderBy("_x")  # by range, so that a point at the very value is seen from both sides
    below = F.last("_p", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    above = F.first("_p", ignorenulls=True).over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    met = both.withColumns({"_lo": below, "_hi": above}).filter("_p is null")
    lo, hi = F.coalesce("_lo", "_hi"), F.coalesce("_hi", "_lo")
    slope = (hi["y"] - lo["y"]) / F.nullif(hi["x"] - lo["x"], F.lit(0.0))
    value = lo["y"] + F.coalesce(slope * (F.col("_x") - lo["x"]), F.lit(0.0))
    answers = met.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_x").alias("_kx"), value.alias(out))
    match = F.col(x).cast("double") == F.col("_kx")
    for i, c in enumerate(by):
        match = match & (F.col(c) == F.col(f"_k{i}"))
    return df.join(answers, match, "left").drop(*[f"_k{i}" for i in range(len(by))], "_kx")


def on_our_scale(df: DataFrame, published: DataFrame, x: str, y: str, out: str, least: int = MIN_CURVE_POINTS) -> DataFrame:
    """The edition's ``x`` on our scale: by the curve of (role, Season), or of the Season where that has few points.

    Both curves are read off at the distinct values that are asked for; where these are few, no row of ``df`` moves.
    """
    own = curve_points(published, ["role", "Season"], x, y).filter(F.col("points") >= least)
    pooled = curve_points(published, ["Season"], x, y)
    asked = df.select("role", "Season", F.col(x).cast("double").alias("_x")).filter("_x is not null").distinct()
    both = interpolate(interpolate(asked, own, ["role", "Season"], "_x", "_own"), pooled, ["Season"], "_x", "_pooled")
    answers, _ = written(both.select("role", "Season", "_x", F.coalesce("_own", "_pooled").alias(out)), "answers")
    return join_small(df.withColumn("_x", F.col(x).cast("double")), answers, ["role", "Season", "_x"], answers.count() <= BROADCAST_ANSWERS).drop("_x")


def rosters(edition: DataFrame, history: DataFrame, include_current: bool = False) -> DataFrame:
    """Every entry of an edition rated: by the player's latest season of ours before it, else by the curves.

    ``edition``: League, Season, Team, player, role, fifa_overall.  ``history``: player, Season, role,
    rating, minutes, fifa_overall, fifa_on_our_scale, one row a player and season.  Adds rating,
    minutes (of that season; null without one), from_history and rated.  A season is before another by
    the year it starts in; ``include_current`` takes the season itself, too.

    A row of the history holds until the player's next one, so an entry meets one of them, and an edition
    that is dealt by player does not move.  The entries found are written, as the curves read them again.
    """
    had, start = season_start(F.col("Season")), F.col("_start")
    past = history.filter(F.col("rating").isNotNull()).select(F.col("player").alias("_player"), had.alias("_had"), F.lead(had).over(Window.partitionBy("player").orderBy(had, "Season")).alias("_until"), F.col("rating").cast("double").alias("rating"), F.col("minutes").cast("double").alias("minutes"))
    since, until = (F.col("_had") <= start, start < F.col("_until")) if include_current else (F.col("_had") < start, start <= F.col("_until"))
    asked = edition.withColumn("_start", had)
    found = asked.join(past, (F.col("player") == F.col("_player")) & since & (F.col("_until").isNull() | until), "left")
    found, _ = written(found.withColumn("from_history", F.col("rating").isNotNull()).drop("_start", "_player", "_had", "_until"), "rosters")
    scaled = on_our_scale(found, history, "fifa_overall", "fifa_on_our_scale", "_scaled")
    return scaled.withColumn("rating", F.coalesce("rating", "_scaled")).withColumn("rated", F.col("rating").isNotNull()).drop("_scaled")


def line_weights(roster: DataFrame, line: str = "line") -> DataFrame:
    """Minutes, where unknown the mean of the club's line, else 0: someone without any would not count at all."""
    mean = F.avg("minutes").over(Window.partitionBy("Season", "Team", line))
    return roster.withColumn("minutes", F.coalesce("minutes", mean, F.lit(0.0)))


def squad_strength(roster: DataFrame, lines: dict[str, float], best: int = BEST_N, least: int = 1) -> DataFrame:
    """Per club and season the rating of each line over the best players, and the weighted mean of the lines.

    ``roster`` has line; players without a rating or a line take no part, but their club's line means
    hold their minutes.  Also n_players and n_from_history, of those chosen.  Clubs of fewer than
    ``least`` rated players are left out.  The order is total: rating, minutes, player.
    """
    keys = ["League", "Season", "Team"]
    # dealt by club once, which serves the windows over lines, too
    narrow = roster.select(*keys, "player", "line", "rating", "rated", "minutes", "from_history").repartition("Season", "Team")
    weighed = line_weights(narrow).filter(F.col("rated") & F.col("line").isNotNull())
    chosen = top_n_of_enough(weighed, keys, [F.desc("rating"), F.desc("minutes"), F.asc("player")], best, least)
    counts: list[Column] = [F.count(F.lit(1)).alias("n_players"), F.sum(F.col("from_history").cast("long")).alias("n_from_history")]
    cells = chosen.withColumns({f"squad_{n}": F.when(F.col("line") == n, F.col("rating")) for n in lines})
    joined = cells.groupBy(*keys).agg(*[scale.weighted_mean(f"squad_{n}", "minutes").alias(f"squad_{n}") for n in lines], *counts)
    return joined.withColumn("squad_overall", scale.weighted_present({f"squad_{n}": w for n, w in lines.items()}, 1.0))
