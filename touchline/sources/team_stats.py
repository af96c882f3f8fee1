"""Team statistics of a second source, in long form; what stays when it is down; ties between leagues, round by round."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.sides import result, unpivot_sides
from touchline.sources import sinks

#: The measures of a side, and what they are called here; the last two are kept for the side itself only.
SIDE_METRICS = {"xg": "xG", "np_xg": "npxG", "ppda": "PPDA", "deep_completions": "DeepCompletions"}
OWN_ONLY = ("PPDA", "DeepCompletions")
#: The columns of a history that hold expected goals.
XG_COLUMNS = ("League", "Season", "Date", "Team", "Opponent", "Venue", "xGFor", "xGAgainst", "npxGFor", "npxGAgainst", "PPDAFor", "DeepCompletionsFor")
#: Rounds by kind.
ROUNDS = {
    "round_robin": ("Group stage", "League phase"),
    "two_legged": ("Round of 32", "Round of 16", "Quarter-finals", "Semi-finals", "Knockout phase play-offs", "Knockout round play-offs", "Play-off round"),
    "neutral": ("Final",),
}
#: How the label of a reserve, youth or academy side ends, one that ends otherwise, and one that is none.
RESERVE = r"(?i)\s(?:B|II|2|U1[6-9]|U2[0-3]|Reserves?|Academy)\s*$"
RESERVE_LABELS, FIRST_TEAM_LABELS = ("Sevilla Atlético", "Sevilla Atletico"), ("Willem II",)


def classify_round(name: Column) -> Column:
    """round_robin, two_legged, neutral, or unclassified for every other name and for null."""
    out = F.lit("unclassified")
    for kind, names in ROUNDS.items():
        out = F.when(name.isin(*names), kind).otherwise(out)
    return out


def is_reserve(label: Column) -> Column:
    """Whether a club label names a reserve, youth or academy side; null for null."""
    text = F.trim(label)
    return ~text.isin(*FIRST_TEAM_LABELS) & (text.isin(*RESERVE_LABELS) | text.rlike(RESERVE))


def resolve_names(df: DataFrame, columns: Sequence[str], aliases: Mapping[str, str]) -> DataFrame:
    """``df`` with trimmed names, and a source's aliases replaced; the aliases are a configuration's handful."""
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else None
    plain = {c: F.trim(F.col(c)) for c in columns}
    return df.withColumns({c: F.coalesce(known[n], n) if known is not None else n for c, n in plain.items()})


def unknown_names(df: DataFrame, columns: Sequence[str], known: DataFrame, name: str) -> DataFrame:
    """(name, rows): names that ``known`` does not have, to be looked at, not guessed."""
    found = df.select(F.explode(F.array(*columns)).alias("name")).filter("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("rows"))
    return found.join(known.select(F.col(name).alias("_known")).distinct(), F.col("name") == F.col("_known"), "left_anti")


def team_statistics(raw: DataFrame, leagues: Mapping[str, str], aliases: Mapping[str, str]) -> DataFrame:
    """Two rows a match: League, Season, Date, Team, Opponent, Venue and each measure For and Against.

    ``raw`` is wide: league, season, date, home_team, away_team and home_ and away_ of every measure; what is
    no number is null, and a measure that it lacks is null throughout.  Leagues without a code go.
    """
    codes = F.create_map(*[F.lit(x) for code, name in leagues.items() for x in (name, code)])
    have = set(raw.columns)
    number = lambda c: F.expr(f"try_cast(trim(cast(`{c}` as string)) as double)") if c in have else F.lit(None).cast("double")
    values = {f"_{side}_{name}": number(f"{side}_{source}") for source, name in SIDE_METRICS.items() for side in ("home", "away")}
    wide = raw.select(codes[F.col("league")].alias("League"), F.col("season").cast("string").alias("Season"), F.to_date("date").alias("Date"), F.col("home_team").alias("HomeTeam"), F.col("away_team").alias("AwayTeam"), *[c.alias(n) for n, c in values.items()])
    wide = resolve_names(wide.filter("League is not null"), ["HomeTeam", "AwayTeam"], aliases)
    sides = {}
    for name in SIDE_METRICS.values():
        sides[f"{name}For"] = (f"_home_{name}", f"_away_{name}")
        if name not in OWN_ONLY:
            sides[f"{name}Against"] = (f"_away_{name}", f"_home_{name}")
    return unpivot_sides(wide, ["League", "Season", "Date"], sides)


def missing_seasons(found: DataFrame, wanted: Sequence[str]) -> list[str]:
    """The wanted seasons that a source had nothing of."""
    have = {r[0] for r in found.select("Season").distinct().filter(F.col("Season").isin(*wanted)).collect()} if wanted else set()
    return sorted(set(wanted) - have)


def published_statistics(spark: SparkSession, path: str) -> DataFrame:
    """The expected goals that a published history already has, for the days on which their source is down.

    Empty, with the right columns, where there is no history or it lacks one of the columns.
    """
    kinds = {"Date": "date", **{c: "string" for c in XG_COLUMNS[:2] + XG_COLUMNS[3:6]}}
    schema = ", ".join(f"{c} {kinds.get(c, 'double')}" for c in XG_COLUMNS)
    try:
        table = sinks.checked_read(spark, path, XG_COLUMNS)
    except ValueError:
        table = None
    if table is None:
        return spark.createDataFrame([], schema)
    return table.select(*[F.col(c).cast(kinds.get(c, "double")).alias(c) for c in XG_COLUMNS]).filter("xGFor is not null")


def with_fallback_statistics(fresh: DataFrame | None, published: DataFrame) -> DataFrame:
    """A source's rows where it answered, and the published ones of the matches that it did not bring."""
    if fresh is None:
        return published
    key = ["League", "Season", "Date", "Team", "Opponent", "Venue"]
    known = fresh.select(*[F.col(k).alias(f"_{k}") for k in key]).distinct()
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key])
    return fresh.select(*XG_COLUMNS).unionByName(published.join(known, match, "left_anti").select(*XG_COLUMNS))


def european_ties(parts: Mapping[tuple[str, str], DataFrame | Exception], clubs: DataFrame, aliases: Mapping[str, str]) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """(played ties between clubs whose leagues are known, the parts that failed).

    ``parts`` maps (competition, season) to its schedule (Date, HomeTeam, AwayTeam, FTHG, FTAG, Round) or to the
    error that reading it raised: one page that fails costs its own season.  ``clubs``: Season, Team, League.
    Rows without a score, and clubs that no league has, go; home_league and away_league are added.
    None where no part could be read.
    """
    failed = [k for k, v in parts.items() if isinstance(v, Exception)]
    frames = [v.select(F.lit(c).alias("League"), F.lit(s).alias("Season"), F.to_date("Date").alias("Date"), "HomeTeam", "AwayTeam", F.col("FTHG").cast("int").alias("FTHG"), F.col("FTAG").cast("int").alias("FTAG"), "Round") for (c, s), v in parts.items() if not isinstance(v, Exception)]
    if not frames:
        return None, failed
    ties = resolve_names(reduce(DataFrame.unionByName, frames), ["HomeTeam", "AwayTeam"], aliases).filter("FTHG is not null and FTAG is not null")
    once = clubs.groupBy("Season", "Team").agg(F.min("League").alias("_league"))
    for side, name in (("HomeTeam", "home_league"), ("AwayTeam", "away_league")):
        other = once.select(F.col("Season").alias("_s"), F.col("Team").alias("_t"), F.col("_league").alias(name))
        ties = ties.join(other, (F.col("Season") == F.col("_s")) & (F.col(side) == F.col("_t"))).drop("_s", "_t")
    outcome = result(F.col("FTHG"), F.col("FTAG"))
    letter = F.when(outcome == "W", "H").when(outcome == "L", "A").when(outcome == "D", "D")
    return ties.withColumns({"FTR": letter, "kind": classify_round(F.col("Round"))}), failed
