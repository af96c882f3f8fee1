"""The whole table of pre-match features: every form metric over two windows, overall and by venue, for both sides.

For played matches one window specification per grouping serves all metrics; a long table is cut into
slices of time, which hold all teams, so that both sides of a match are met where its windows are
taken and wide rows never move.  There a slice is one group of Arrow batches, as Spark's sliding windows
add up every frame anew, metric by metric.  For fixtures, form is
that of the last matches before them, found by an as-of union; a team may have any number of fixtures,
since fixtures are no rows of the history and cannot push matches out of a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.form_slices import slice_features
from touchline.operators.joins import asof_latest
from touchline.operators.percentiles import join_small
from touchline.operators.sides import prepare, repivot, with_diffs
from touchline.operators.windows import prev_window
from touchline.sources.sinks import written

#: Per-match value, how a window takes it, and the feature's name.
FORM = {
    "Points": ("sum", "points"),
    "Win": ("sum", "wins"),
    "Draw": ("sum", "draws"),
    "Loss": ("sum", "losses"),
    "GoalsFor": ("mean", "goals_for"),
    "GoalsAgainst": ("mean", "goals_against"),
    "GoalDiff": ("mean", "goal_diff"),
    "ShotsFor": ("mean", "shots_for"),
    "ShotsAgainst": ("mean", "shots_against"),
    "ShotsOnTargetFor": ("mean", "shots_on_target_for"),
    "ShotsOnTargetAgainst": ("mean", "shots_on_target_against"),
    "ShotAccuracy": ("mean", "shot_accuracy"),
    "xGFor": ("mean", "xg_for"),
    "xGAgainst": ("mean", "xg_against"),
    "xGDiff": ("mean", "xg_diff"),
    "xGOver": ("mean", "xg_overperformance"),
    "xGPerShot": ("mean", "xg_per_shot"),
    "npxGFor": ("mean", "npxg_for"),
    "npxGAgainst": ("mean", "npxg_against"),
    "npxGDiff": ("mean", "npxg_diff"),
    "PPDAFor": ("mean", "ppda"),
    "DeepCompletionsFor": ("mean", "deep_completions"),
}
#: Windows in matches, days of congestion, and what a match row has that is no input of a
#: model: identifiers, targets, and odds, which a forecast must not read.
WINDOWS = (5, 19)
CONGESTION_DAYS = 14
NOT_INPUTS = ("match_id", "FTHG", "FTAG", "FTR", "HomeTeam", "AwayTeam", "League", "Season", "Date", "B365H", "B365D", "B365A", "AvgH", "AvgD", "AvgA", "MaxH", "MaxD", "MaxA")
#: Rows of a slice of time, about, and days of teams that are broadcast at most.
SLICE_ROWS, BROADCAST_DAYS = 50_000, 1_000_000
#: Stems with a difference of home and away; ``{w}`` is the window.
WINDOWED_DIFFS = (
    "points_last_{w}",
    "points_last_{w}_venue",
    "goal_diff_last_{w}",
    "goal_diff_last_{w}_venue",
    "goals_for_last_{w}",
    "goals_against_last_{w}",
    "shots_on_target_for_last_{w}",
    "shot_accuracy_last_{w}",
    "xg_for_last_{w}",
    "xg_against_last_{w}",
    "xg_diff_last_{w}",
    "xg_diff_last_{w}_venue",
    "xg_overperformance_last_{w}",
    "npxg_diff_last_{w}",
    "ppda_last_{w}",
)
FIXED_DIFFS = ("days_since_last_match",)


def groupings(windows: Sequence[int] = WINDOWS) -> list[tuple[list[str], int, str]]:
    """(keys, window, suffix) of every block of form columns."""
    return [(keys, w, f"last_{w}{tail}") for w in windows for keys, tail in ((["Team"], ""), (["Team", "Venue"], "_venue"))]


def available(df: DataFrame) -> dict[str, tuple[str, str]]:
    """The metrics that the table has values for."""
    return {m: spec for m, spec in FORM.items() if m in df.columns}


def prepared(tmh: DataFrame) -> DataFrame:
    """Per-match values of all metrics; those whose source columns are absent stay absent."""
    lacking = [c for c in ("GoalsFor", "GoalsAgainst", "ShotsFor", "ShotsOnTargetFor", "xGFor", "xGAgainst", "Result") if c not in tmh.columns]
    base = prepare(tmh.withColumns({c: F.lit(None).cast("string" if c == "Result" else "double") for c in lacking}))
    if {"npxGFor", "npxGAgainst"} <= set(tmh.columns):
        base = base.withColumn("npxGDiff", F.col("npxGFor") - F.col("npxGAgainst"))
    of = {"GoalDiff": ("GoalsFor", "GoalsAgainst"), "ShotAccuracy": ("ShotsFor", "ShotsOnTargetFor"), "xGDiff": ("xGFor", "xGAgainst"), "xGOver": ("GoalsFor", "xGFor"), "xGPerShot": ("ShotsFor", "xGFor")}
    return base.drop(*lacking, *[name for name, sources in of.items() if set(sources) & set(lacking)])


def _block(metrics: dict[str, tuple[str, str]], frame, suffix: str) -> dict[str, Column]:
    how = {"mean": F.avg, "sum": F.sum}
    columns = {f"{name}_{suffix}": how[agg](F.col(m).cast("double")).over(frame) for m, (agg, name) in metrics.items()}
    return columns | {f"matches_used_{suffix}": F.count("Points").over(frame)}


def with_forms(long: DataFrame, order: Sequence[str], windows: Sequence[int] = WINDOWS) -> DataFrame:
    """Every block of form of each row, from the rows before it; null where there is none."""
    metrics, columns = available(long), {}
    for keys, w, suffix in groupings(windows):
        columns |= _block(metrics, prev_window(keys, order, w), suffix)
    return long.withColumns(columns)


def feature_names(long: DataFrame, windows: Sequence[int] = WINDOWS) -> list[str]:
    """Discovered form columns, and those of rest, in order."""
    names = [f"{name}_{suffix}" for _, _, suffix in groupings(windows) for name in [n for _, n in available(long).values()] + ["matches_used"]]
    return [*names, "days_since_last_match", "matches_last_14_days"]


def diff_stems(names: Sequence[str], windows: Sequence[int] = WINDOWS) -> list[str]:
    """The stems to difference, as far as the table has them."""
    stems = [s.format(w=w) for w in windows for s in WINDOWED_DIFFS] + list(FIXED_DIFFS)
    return [s for s in stems if s in set(names)]


def model_inputs(df: DataFrame, without: Sequence[str] = NOT_INPUTS) -> list[str]:
    """Numeric columns that are neither identifier nor target, in the table's order."""
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint", "boolean")
    return [c for c, t in df.dtypes if c not in without and (t in numeric or t.startswith("decimal"))]


def match_features(tmh: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """One row per match: ``home_`` and ``away_`` blocks, differences, rest and congestion.

    ``tmh`` has match_id, League, Season, Date, Team, Venue and two rows a match.
    """
    order, key = ["Date", "match_id"], ["match_id", "League", "Season", "Date"]
    base, _ = written(tmh.select(*key, "Team", "Venue", *[c for c in tmh.columns if c in FORM or c == "Result"]), "sides")
    rows, teams = base.agg(F.count(F.lit(1)), F.approx_count_distinct("Team")).first()
    base = _with_congestion(base)
    reach = max(windows)
    if rows > SLICE_ROWS and 2 * reach * teams <= SLICE_ROWS:
        wide = _of_slices(prepared(_in_slices(base, order, reach, -(-rows // SLICE_ROWS))), order, key, windows)
        return with_diffs(wide, diff_stems(feature_names(prepared(base), windows), windows))
    long = with_forms(prepared(base), order, windows)
    long = long.withColumn("days_since_last_match", F.datediff("Date", F.lag("Date").over(Window.partitionBy("Team").orderBy(*order))))
    names = feature_names(long, windows)
    return with_diffs(repivot(long, key, names), diff_stems(names, windows))


def _of_slices(long: DataFrame, order: Sequence[str], key: Sequence[str], windows: Sequence[int]) -> DataFrame:
    """``repivot`` of the forms of each slice, which is one group: its windows are sums of shifted columns."""
    metrics = available(long)
    blocks = [(keys, w, suffix, [(m, how, name) for m, (how, name) in metrics.items()]) for keys, w, suffix in groupings(windows)]
    types = {f"matches_used_{suffix}": "bigint" for _, _, suffix in groupings(windows)} | {"days_since_last_match": "int", "matches_last_14_days": "bigint"}
    kinds = dict(long.dtypes)
    fields = [f"`{c}` {kinds[c]}" for c in key] + ["HomeTeam string", "AwayTeam string"]
    fields += [f"{side}_{n} {types.get(n, 'double')}" for side in ("home", "away") for n in feature_names(long, windows)]
    place, day = F.row_number().over(Window.partitionBy("_slice").orderBy(*order)), F.datediff("Date", F.lit("1970-01-01").cast("date"))
    numbers = [F.col(m).cast("double").alias(m) for m in dict.fromkeys(["Points", *metrics])]
    asked = long.select("_slice", *key, "Team", "Venue", "_own", "matches_last_14_days", place.alias("_order"), day.alias("_day"), *numbers)
    return asked.groupBy("_slice").applyInArrow(lambda table: slice_features(table, key, blocks), ", ".join(fields))


def _with_congestion(base: DataFrame) -> DataFrame:
    """Adds how many matches a team played in the days before: days are counted first, and go back to their rows."""
    day = F.datediff("Date", F.lit("1970-01-01").cast("date")).cast("long")
    before = Window.partitionBy("Team").orderBy(day).rangeBetween(-CONGESTION_DAYS, -1)
    days, _ = written(base.groupBy("Team", "Date").agg(F.count(F.lit(1)).alias("_n")).select("Team", "Date", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("matches_last_14_days")), "days")
    return join_small(base, days, ["Team", "Date"], days.count() <= BROADCAST_DAYS)


def _in_slices(base: DataFrame, order: Sequence[str], reach: int, slices: int) -> DataFrame:
    """``base`` by slices of its order, one partition each or a few, with the rows that windows reach back to.

    Adds _slice and _own, which is false for the copies: of every team and venue the last ``reach`` rows before
    the slice, and thereby the last ``reach`` of the team.  They come from the ends of earlier slices, as the
    one before may have few rows of a team.
    """
    dealt, _ = written(base.repartitionByRange(slices, *order).withColumn("_slice", F.spark_partition_id()), "slices")
    last = dealt.agg(F.max("_slice")).first()[0]
    newest = Window.partitionBy("Team", "Venue", "_slice").orderBy(*[F.desc(c) for c in order])
    ends = dealt.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= reach).drop("_n")
    # a row is out of reach once so many came after it
    until = F.lead("_slice", reach, last).over(Window.partitionBy("Team", "Venue").orderBy("_slice", *order))
    copies = ends.withColumn("_until", until).filter(F.col("_until") > F.col("_slice"))
    copies = copies.withColumn("_slice", F.explode(F.sequence(F.col("_slice") + 1, "_until"))).drop("_until")
    both = dealt.withColumn("_own", F.lit(True)).unionByName(copies.withColumn("_own", F.lit(False)))
    return both.repartition(slices, "_slice")


def upcoming_features(tmh: DataFrame, fixtures: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """The same columns for fixtures that have not been played, from what came strictly before their day.

    ``fixtures``: League, Season, Date, HomeTeam, AwayTeam; those that the history has are left out, and
    rows that repeat a fixture are one.  A team without earlier matches has nulls.  Each fixture keeps
    its own row however often a team appears: its form is frozen at the last match played.
    """
    key = ["League", "Date", "HomeTeam", "AwayTeam"]
    played = tmh.filter("Venue = 'Home'").select("League", "Date", F.col("Team").alias("HomeTeam"), F.col("Opponent").alias("AwayTeam"))
    open_rows = _unplayed(fixtures, played, key).dropDuplicates(key)
    side = lambda own, other, venue: F.struct(F.col(own).alias("Team"), F.col(other).alias("Opponent"), F.lit(venue).alias("Venue"))
    sides = open_rows.select(*key, "Season", F.explode(F.array(side("HomeTeam", "AwayTeam", "Home"), side("AwayTeam", "HomeTeam", "Away"))).alias("s")).select(*key, "Season", "s.*")
    history = prepared(tmh)
    metrics, order = available(history), ["Date", "match_id"]
    for keys in (["Team"], ["Team", "Venue"]):
        columns = {}
        for k, w, suffix in groupings(windows):
            if k == keys:
                columns |= _block(metrics, Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - w, 0), suffix)
        rows = history.withColumns(columns).select(*keys, *order, *columns)
        sides = asof_latest(sides, rows, keys, "Date", "Date", list(columns), tie=["match_id"])
        sides = sides.withColumnRenamed("asof_Date", "_last") if keys == ["Team"] else sides.drop("asof_Date")
        sides = sides.withColumns({c: F.coalesce(c, F.lit(0)) for c in columns if c.startswith("matches_used")})
    sides = sides.withColumn("days_since_last_match", F.datediff("Date", "_last")).drop("_last")
    sides = _congestion(sides, history)
    names = feature_names(history, windows)
    return with_diffs(repivot(sides.drop("HomeTeam", "AwayTeam"), ["_fixture", "League", "Season", "Date"], names).drop("_fixture"), diff_stems(names, windows))


def _unplayed(fixtures: DataFrame, played: DataFrame, key: Sequence[str]) -> DataFrame:
    known = played.select(*[F.col(k).alias(f"_k_{k}") for k in key]).distinct()
    match = F.lit(True)
    for k in key:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return fixtures.select(*key, "Season").join(known, match, "left_anti")


def _congestion(sides: DataFrame, history: DataFrame) -> DataFrame:
    """Adds ``_fixture`` and how many matches a side played in the days before."""
    sides = sides.withColumn("_fixture", F.struct("League", "Date", "HomeTeam", "AwayTeam"))
    asked = sides.select("Team", "Date").distinct().withColumn("_past", F.lit(0))
    both = asked.unionByName(history.select("Team", "Date", F.lit(1).alias("_past")))
    day = F.datediff("Date", F.lit("1970-01-01").cast("date")).cast("long")
    counted = both.withColumn("matches_last_14_days", F.sum("_past").over(Window.partitionBy("Team").orderBy(day).rangeBetween(-CONGESTION_DAYS, -1))).filter("_past = 0")
    counted = counted.select(F.col("Team").alias("_t"), F.col("Date").alias("_d"), F.coalesce("matches_last_14_days", F.lit(0)).alias("matches_last_14_days"))
    return sides.join(counted, F.col("Team").eqNullSafe(F.col("_t")) & F.col("Date").eqNullSafe(F.col("_d")), "left").drop("_t", "_d")
