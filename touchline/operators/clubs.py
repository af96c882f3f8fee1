"""Which club a player-season belongs to, what a label stands for, and which role a career settles on: votes and evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.names import normalise_name
from touchline.functions.seasons import season_start
from touchline.operators.aggregates import modal

#: Players that must vote within a season, and the share of votes that must agree.
LEAST_VOTES, AGREEMENT = 4, 0.9
#: Counts and their rates, from which minutes divide back out; the first that tells counts.
RATES = ("fouls", "interceptions", "tackles_won", "fouled", "crosses", "saves")


def estimated_minutes(df: DataFrame) -> Column:
    """Minutes behind a row, from any count and its rate per 90; 0 where none tells."""
    parts = [F.when((F.col(f"{c}_per90") > 0) & (F.col(c) > 0), F.col(c) / F.col(f"{c}_per90") * 90) for c in RATES if {c, f"{c}_per90"} <= set(df.columns)]
    return F.coalesce(*parts, F.lit(0.0))


def evidence_keys(norm: Column) -> Column:
    """The keys of a normalised name, the most specific first: whole, first and last word, initial and last word."""
    words = F.split(norm, " ")
    first, last = F.element_at(words, 1), F.element_at(words, -1)
    keys = F.array(norm, F.when(F.size(words) > 2, F.concat_ws(" ", first, last)), F.when(F.size(words) > 1, F.concat_ws(" ", F.substring(first, 1, 1), last)))
    return F.when(norm != "", F.filter(keys, lambda k: k.isNotNull())).otherwise(F.array().cast("array<string>"))


def _canonical(club: Column, aliases: dict[str, str]) -> Column:
    """A club's one name; the aliases are a configuration's handful."""
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else None
    return F.coalesce(known[F.trim(club)], F.trim(club)) if known is not None else F.trim(club)


def club_evidence(stats: DataFrame, aliases: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Where a second source has players: (League, Season, key, club, minutes), and (League, Season, norm, tokens, club, minutes).

    A key that two different names share tells nothing and is left out.
    """
    rows = stats.select("League", "Season", normalise_name(F.col("Player")).alias("norm"), _canonical(F.col("Team"), aliases).alias("club"), estimated_minutes(stats).alias("minutes")).filter("norm <> '' and club is not null")
    rows = rows.groupBy("League", "Season", "norm", "club").agg(F.max("minutes").alias("minutes"))
    keyed = rows.select("League", "Season", "norm", "club", "minutes", F.explode(evidence_keys(F.col("norm"))).alias("key"))
    owners = keyed.groupBy("League", "Season", "key").agg(F.min("norm").alias("_lo"), F.max("norm").alias("_hi")).filter("_lo = _hi").drop("_lo", "_hi")
    by_key = keyed.join(owners, ["League", "Season", "key"]).groupBy("League", "Season", "key", "club").agg(F.max("minutes").alias("minutes"))
    return by_key, rows.withColumn("tokens", F.array_distinct(F.split("norm", " ")))


def _contained(players: DataFrame, known: DataFrame) -> DataFrame:
    """(pid, club, minutes) of players whose tokens hold those of exactly one name of their league and season, or are among them.

    Either way round the smaller name's first token is in the larger one, so it is the key of the join.
    """
    anchored = lambda df: df.withColumn("_token", F.array_min("tokens"))
    spread = lambda df: df.withColumn("_token", F.explode("tokens"))
    on = ["League", "Season", "_token"]
    theirs = known.withColumnRenamed("tokens", "theirs")
    smaller = anchored(players).join(spread(theirs.withColumnRenamed("theirs", "tokens")).withColumnRenamed("tokens", "theirs"), on).filter(F.size(F.array_except("tokens", "theirs")) == 0)
    larger = spread(players).join(anchored(known).withColumnRenamed("tokens", "theirs"), on).filter(F.size(F.array_except("theirs", "tokens")) == 0)
    met = smaller.select("pid", "norm", "club", "minutes").unionByName(larger.select("pid", "norm", "club", "minutes")).distinct()
    alone = met.groupBy("pid").agg(F.min("norm").alias("_lo"), F.max("norm").alias("_hi")).filter("_lo = _hi").select("pid")
    return met.join(alone, "pid").select("pid", "club", "minutes")


def refile(players: DataFrame, stats: DataFrame, candidates: DataFrame, own_aliases: dict[str, str], stats_aliases: dict[str, str]) -> DataFrame:
    """``players`` with Team corrected, and refiled, where a second source never saw a player at the club he is filed under.

    ``players``: pid (unique), League, Season, Player, Team; ``candidates``: pid, club, place - the clubs a
    player-season is listed with, in order; ``stats``: League, Season, Team, Player and counts with their
    rates.  Evidence is that of the first of his name's keys that has any, else of the one name that
    contains his or is contained.  Of the listed clubs with evidence the one with most minutes is taken,
    unless the filed one is among them; the earlier listed of equal ones.  Without evidence, or without a
    listed club in it, nothing moves.
    """
    by_key, known = club_evidence(stats, stats_aliases)
    asked = players.join(candidates.select("pid").distinct(), "pid", "left_semi").select("pid", "League", "Season", "Team", normalise_name(F.col("Player")).alias("_norm"))
    keyed = asked.select("pid", "League", "Season", F.posexplode(evidence_keys(F.col("_norm"))).alias("_place", "key")).join(by_key, ["League", "Season", "key"])
    first = keyed.groupBy("pid").agg(F.min("_place").alias("_first"))
    found = keyed.join(first, "pid").filter("_place = _first").select("pid", "club", "minutes")
    left = asked.join(first, "pid", "left_anti").filter("_norm <> ''").select("pid", "League", "Season", F.array_distinct(F.split("_norm", " ")).alias("tokens"))
    found = found.unionByName(_contained(left, known))
    listed = candidates.select("pid", F.col("club").alias("listed"), "place", _canonical(F.col("club"), own_aliases).alias("club"))
    present = listed.join(found, ["pid", "club"]).join(asked.select("pid", "Team"), "pid")
    best = present.groupBy("pid").agg(F.min_by("listed", F.struct((-F.col("minutes")).alias("m"), "place")).alias("_best"), F.max((F.col("listed") == F.col("Team")).cast("int")).alias("_seen"))
    moved = best.filter("_seen = 0").select("pid", "_best")
    joined = players.join(moved, "pid", "left")
    return joined.withColumns({"refiled": F.col("_best").isNotNull(), "Team": F.coalesce("_best", "Team")}).drop("_best")


def vote_labels(rows: DataFrame, label: str, team: str, least: int = LEAST_VOTES, agreement: float = AGREEMENT) -> DataFrame:
    """(label, team, seasons): what a label stands for, from the players it shares with teams.

    Each season casts one vote for a label, if enough of its players agree; so leavers of many years do
    not add up.  Of the seasons' votes, ``agreement`` must go one way again, one season being enough.
    """
    known = rows.filter(F.col(label).isNotNull() & F.col(team).isNotNull()).select(F.col(label).alias("label"), "Season", F.col(team).alias("team"))
    counts = known.groupBy("label", "Season", "team").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.withColumn("_all", F.sum("n").over(Window.partitionBy("label", "Season"))).filter(F.col("_all") >= least)
    season = modal(whole, ["label", "Season"], "team", F.col("n"), 0, agreement)
    return modal(season.select("label", "team"), ["label"], "team", F.lit(1), 1, agreement).select("label", "team", F.col("votes").cast("long").alias("seasons"))


def settle_roles(df: DataFrame, player: Sequence[str] = ("Player",), positions: str = "fifa_positions") -> DataFrame:
    """``df`` with one role for all of a player's seasons that list the same positions, in whatever order.

    Each season has one vote (the smaller role, if it has two), the most common role wins, and of equal
    ones that of the latest season.  Rows without role or positions stay as they are.
    """
    tokens = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(positions, ","), lambda t: F.upper(F.trim(t))), lambda t: t != "")))
    marked = df.withColumn("_set", F.when(F.size(tokens) > 0, F.array_join(tokens, ",")))
    known = marked.filter("_set is not null and role is not null")
    keys = [*player, "_set"]
    season = known.groupBy(*keys, "Season").agg(F.min("role").alias("_r"))
    votes = season.groupBy(*keys, "_r").agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct(season_start(F.col("Season")), "Season")).alias("_last"))
    settled = votes.groupBy(*keys).agg(F.max_by("_r", F.struct("_n", "_last", "_r")).alias("_settled"))
    match = F.col("_set") == F.col("_s")
    for i, k in enumerate(player):
        match = match & F.col(k).eqNullSafe(F.col(f"_p{i}"))
    named = settled.select(F.col("_set").alias("_s"), *[F.col(k).alias(f"_p{i}") for i, k in enumerate(player)], "_settled")
    joined = marked.join(named, match, "left")
    role = F.when(F.col("role").isNotNull() & F.col("_settled").isNotNull(), F.col("_settled")).otherwise(F.col("role"))
    return joined.withColumn("role", role).select(*df.columns)
