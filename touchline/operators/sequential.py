"""Order-dependent ratings: a fold over matches that every team's rating runs through."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.sources import sinks

#: Matches of a stage: what one task sorts, about.
STAGE_ROWS = 1_000_000
WALKED = "part string, match_id long, Date date, played boolean, Season string, HomeTeam string, AwayTeam string, home_elo double, away_elo double, home_after double, away_after double"
START, K, HOME_ADVANTAGE, SEASON_REGRESSION = 1500.0, 20.0, 60.0, 0.25


def expected(rating: Column, opponent: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (opponent - rating) / 400))


class EloState:
    """Ratings and last seasons of the teams met so far."""

    def __init__(self, k: float = K, home_advantage: float = HOME_ADVANTAGE, regression: float = SEASON_REGRESSION):
        self.k, self.home_advantage, self.regression = k, home_advantage, regression
        self.rating: dict[str, float] = {}
        self.season: dict[str, str] = {}

    def match(self, home: str, away: str, season: str, goals_home: float | None, goals_away: float | None, neutral: bool = False) -> tuple[float, float]:
        """Ratings before the match; afterwards both have moved by the same amount, opposite ways."""
        (a,), (b,), _, _ = self.walk([(home, away, season, goals_home, goals_away, neutral)])
        return a, b

    def walk(self, rows: Iterable[tuple]) -> tuple[list[float], list[float], list[float], list[float]]:
        """``match`` for rows of its arguments: the ratings of both before, and of both after.

        A new season draws the rating that a team brings into a match toward the start.
        """
        rating, last, k, advantage, regression, log1p = self.rating, self.season, self.k, self.home_advantage, self.regression, math.log1p
        out = [], [], [], []
        put_a, put_b, put_home, put_away = [values.append for values in out]
        for home, away, season, x, y, neutral in rows:
            a = rating.get(home, START)
            if last.get(home, season) != season:
                a += (START - a) * regression
            rating[home], last[home] = a, season
            b = rating.get(away, START)
            if last.get(away, season) != season:
                b += (START - b) * regression
            rating[away], last[away] = b, season
            put_a(a)
            put_b(b)
            if x is not None and y is not None and x == x and y == y:
                chance = 1 / (1 + 10 ** ((b - a - (0.0 if neutral else advantage)) / 400))
                score = 1.0 if x > y else 0.0 if x < y else 0.5
                move = k * max(1.0, log1p(abs(x - y))) * (score - chance)
                rating[home], rating[away] = a + move, b - move
            put_home(rating[home])
            put_away(rating[away])
        return out


def walk_batch(ratings: DataFrame, matches: DataFrame, options: dict) -> DataFrame:
    """Ratings first, then matches in order, in one task of a group: a row for each match, then (``played`` null) a row a team with the rating after all.

    A task sorts its matches and holds one Arrow batch and the ratings.
    """
    blank = {n: F.lit(None).cast(t) for n, t in (("match_id", "long"), ("Date", "date"), ("played", "boolean"), ("AwayTeam", "string"), ("h", "double"), ("a", "double"), ("n", "boolean"))}
    known = ratings.select("part", F.lit(0).alias("kind"), F.col("Team").alias("HomeTeam"), F.col("Season"), F.col("rating")).withColumns(blank)
    rows = known.unionByName(matches.withColumn("kind", F.lit(1)).withColumn("rating", F.lit(None).cast("double")))
    columns = [c.split()[0] for c in WALKED.split(", ")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = elo = None

        def after(schema: pa.Schema) -> pa.RecordBatch:
            teams = list(elo.rating)
            known = {"part": [part] * len(teams), "HomeTeam": teams, "Season": [elo.season[t] for t in teams], "home_after": [elo.rating[t] for t in teams]}
            return pa.RecordBatch.from_arrays([pa.array(known.get(f.name, [None] * len(teams)), f.type) for f in schema], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            schema = pa.schema([pa.field(c, batch.schema.field(c).type if c in batch.schema.names else pa.float64()) for c in columns])
            parts, kinds = batch.column("part").to_pandas().to_numpy(), batch.column("kind").to_numpy()
            held = [batch.column(c).to_pandas().tolist() for c in ("HomeTeam", "AwayTeam", "Season", "h", "a", "n")]
            ratings, found = batch.column("rating").to_pandas().tolist(), ([], [], [], [])
            cuts = np.flatnonzero((parts[1:] != parts[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for i, j in zip([0, *cuts], [*cuts, len(kinds)], strict=True):
                if elo is None or parts[i] != part:
                    if elo is not None:
                        yield after(schema)
                    part, elo = parts[i], EloState(**options)
                if kinds[i] == 0:
                    elo.rating.update(zip(held[0][i:j], ratings[i:j], strict=True))
                    elo.season.update(zip(held[0][i:j], held[2][i:j], strict=True))
                else:
                    for values, more in zip(found, elo.walk(zip(*[h[i:j] for h in held], strict=True)), strict=True):
                        values += more
            kept = batch.filter(pa.array(kinds == 1))
            yield pa.RecordBatch.from_arrays([kept.column(c) for c in columns[:-4]] + [pa.array(v, pa.float64()) for v in found], schema=schema)
        if elo is not None:
            yield after(schema)

    ordered = rows.repartition("part").sortWithinPartitions("part", "kind", "Date", "played", "match_id")
    return ordered.mapInArrow(walk, WALKED)


def walk_stages(ratings: DataFrame, matches: DataFrame, options: dict) -> tuple[DataFrame, DataFrame, list[str]]:
    """(walked, ratings after, paths of both): ``walk_batch`` over stages of about ``STAGE_ROWS`` matches, one after the other.

    All cores deal the matches to stages by their order; a stage starts from the ratings that the one before has
    written.  So what a task sorts does not grow with the matches.
    """
    spark, order = matches.sparkSession, ["Date", "played", "match_id"]
    rows, rows_path = sinks.written(matches, "matches")
    stages = max(1, -(-rows.count() // STAGE_ROWS))
    dealt, dealt_path = rows, None
    if stages > 1:
        dealt_path = sinks.scratch(spark, "stages")
        rows.repartitionByRange(stages, *order).withColumn("stage", F.spark_partition_id()).write.partitionBy("stage").parquet(dealt_path)
        dealt = spark.read.parquet(dealt_path)
    paths = []
    for i in range(stages):
        own = dealt.filter(F.col("stage") == i).drop("stage") if stages > 1 else rows
        found, path = sinks.written(walk_batch(ratings, own, options), "walked")
        paths.append(path)
        ratings = found.filter("played is null").select("part", F.col("HomeTeam").alias("Team"), "Season", F.col("home_after").alias("rating"))
    for path in (rows_path, dealt_path):
        if path:
            sinks.delete(spark, path)
    return spark.read.schema(WALKED).parquet(*paths).filter("played is not null"), ratings, paths


def walk_rows(matches: DataFrame, group: str | None) -> DataFrame:
    """The columns that a walk reads, goals as doubles; ``part`` is the group."""
    neutral = F.coalesce(F.col("Neutral"), F.lit(False)) if "Neutral" in matches.columns else F.lit(False)
    goals = F.col("FTHG").cast("double"), F.col("FTAG").cast("double")
    played = goals[0].isNotNull() & goals[1].isNotNull()
    key = F.col(group).cast("string") if group else F.lit("all")
    return matches.select(key.alias("part"), F.col("match_id").cast("long").alias("match_id"), F.col("Date").cast("date").alias("Date"), played.alias("played"), F.col("Season").cast("string").alias("Season"), "HomeTeam", "AwayTeam", goals[0].alias("h"), goals[1].alias("a"), neutral.alias("n"))


def _walked(matches: DataFrame, group: str | None, options: dict) -> DataFrame:
    """match_id, Date, played, teams, ratings before and after of every match."""
    none = matches.sparkSession.createDataFrame([], "part string, Team string, Season string, rating double")
    return walk_stages(none, walk_rows(matches, group), options)[0]


def elo_walk(matches: DataFrame, group: str | None = None, **options) -> DataFrame:
    """match_id, home_elo, away_elo before each match.

    Input: match_id, Date, Season, HomeTeam, AwayTeam, FTHG, FTAG and optionally Neutral.  Within
    a group of connected teams the walk is sequential by nature; ``group`` names a column whose
    values share no team, and groups are walked side by side.  A task sorts ``STAGE_ROWS`` matches and holds
    one batch of short rows and a rating per team, so its memory does not grow with the matches.
    Unplayed matches of a day come before played ones, the id breaks ties.
    """
    return _walked(matches, group, options).select("match_id", "home_elo", "away_elo")


def _by_team(matches: DataFrame, group: str | None, options: dict) -> DataFrame:
    """Two rows per match: Team, elo before, elo after, and when."""
    walked = _walked(matches, group, options)
    sides = [F.struct(F.col(f"{s}Team").alias("Team"), F.col(f"{e}_elo").alias("elo"), F.col(f"{e}_after").alias("after")) for s, e in (("Home", "home"), ("Away", "away"))]
    return walked.select(F.struct("Date", "played", "match_id").alias("at"), F.explode(F.array(*sides)).alias("s")).select("at", "s.*")


def final_ratings(matches: DataFrame, group: str | None = None, **options) -> DataFrame:
    """Team, elo after its last match: the end of the same walk."""
    return _by_team(matches, group, options).groupBy("Team").agg(F.max_by("after", "at").alias("elo"))


def current_and_peak(matches: DataFrame, group: str | None = None, **options) -> DataFrame:
    """Team, its rating before its latest match, and the highest it brought into any."""
    return _by_team(matches, group, options).groupBy("Team").agg(F.max_by("elo", "at").alias("current"), F.max("elo").alias("peak"))


def european_rows(matches: DataFrame) -> DataFrame:
    """Ties of clubs from several leagues as the walk takes them: finals are on neutral ground, and rows without a club or a date go."""
    neutral = F.coalesce(F.lower(F.trim("Round")) == "final", F.lit(False)) if "Round" in matches.columns else F.lit(False)
    return matches.filter("HomeTeam is not null and AwayTeam is not null and Date is not null").withColumn("Neutral", neutral)


def elo_with_extra(matches: DataFrame, extra: DataFrame, group: str | None = None, **options) -> DataFrame:
    """match_id, home_elo, away_elo of ``matches``, from a walk that also learns from ``extra``.

    Extra matches move ratings and get no row.  Ids need only be unique within each table; of one day, a
    table's own matches come in the order of their ids, and between the tables the smaller id comes first,
    ``matches`` before ``extra`` where ids are equal.
    """
    columns = ["Date", "Season", "HomeTeam", "AwayTeam", "FTHG", "FTAG"] + ([group] if group else [])

    def side(df: DataFrame, odd: int) -> DataFrame:
        neutral = F.col("Neutral") if "Neutral" in df.columns else F.lit(False)
        return df.select((F.col("match_id") * 2 + odd).alias("match_id"), *[F.col(c).cast("double").alias(c) if c in ("FTHG", "FTAG") else F.col(c) for c in columns], neutral.alias("Neutral"))

    walked = elo_walk(side(matches, 0).unionByName(side(extra, 1)), group, **options)
    own = walked.filter(F.pmod("match_id", F.lit(2)) == 0)
    return own.select((F.col("match_id") / 2).cast("long").alias("match_id"), "home_elo", "away_elo")


def long_elo(tmh: DataFrame, walked: DataFrame) -> DataFrame:
    """Two rows a match with elo and opponent_elo before it; null where the walk does not have the match."""
    ratings = walked.select("match_id", F.col("home_elo").alias("_h"), F.col("away_elo").alias("_a"))
    joined, home = tmh.join(ratings, "match_id", "left"), F.col("Venue") == "Home"
    return joined.withColumns({"elo": F.when(home, F.col("_h")).otherwise(F.col("_a")), "opponent_elo": F.when(home, F.col("_a")).otherwise(F.col("_h"))}).drop("_h", "_a")
