"""Queries over events, files and sinks: what streams and writes leave behind, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators import joins
from touchline.plans.bridge import MATCHES_SQL, TMH_SQL, matches, table, team_matches
from touchline.sources import files, sinks
from touchline.streaming import elo, events, predictions

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("total", F.round("total", 4))


@query("SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, sf_dir):
    return _rounded(events.tumbling(table(spark, sf_dir, "events"), "1 hour"))


@query("""WITH w AS (SELECT time_bucket(INTERVAL '30 minutes', ts, TIMESTAMP '1970-01-01') - k * INTERVAL '30 minutes' AS start, event_type, value FROM events, (VALUES (0), (1)) t(k))
SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL""")
def events_sliding(spark, sf_dir):
    return _rounded(events.tumbling(table(spark, sf_dir, "events"), "1 hour", slide="30 minutes"))


@query("""WITH g AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events), s AS (SELECT user_id, ts, sum(CASE WHEN gap IS NULL OR gap > INTERVAL '6 hours' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL '6 hours' AS stop, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def events_session(spark, sf_dir):
    return events.sessions(table(spark, sf_dir, "events"), "6 hours")


@query("SELECT DISTINCT user_id, event_type FROM events")
def events_once(spark, sf_dir):
    return events.once(table(spark, sf_dir, "events"), ["user_id", "event_type"]).select("user_id", "event_type")


@query(f"""WITH {MATCHES_SQL} SELECT "League", "Season", "Date", "HomeTeam", "AwayTeam", CAST("FTHG" AS DOUBLE) AS "FTHG", CAST("FTAG" AS DOUBLE) AS "FTAG", CAST("HS" AS DOUBLE) AS "HS", "FTR" FROM matches""")
def matches_from_csv(spark, sf_dir):
    """Matches written as files of a season each, as a feed publishes them, then read by the CSV source."""
    path = sinks.scratch(spark, "csv")
    raw = matches(spark, sf_dir).select(F.col("League").alias("Div"), F.date_format("Date", "dd/MM/yyyy").alias("Date"), "HomeTeam", "AwayTeam", "FTHG", "FTAG", "HS", F.col("Season"))
    raw.write.option("header", True).partitionBy("Season").csv(path)
    found = files.to_matches(files.csv_table(spark, f"{path}/*/*.csv").withColumn("_file", F.regexp_extract("_path", r"Season=(\d{4})", 1)))
    return found.select("League", "Season", "Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "HS", "FTR")


@query(f"""WITH {TMH_SQL}, t AS (SELECT "Season", "Team", sum("GoalsFor")::BIGINT AS goals FROM tmh GROUP BY ALL) SELECT "Team", goals + CASE WHEN "Season" = '9697' THEN 1000 ELSE 0 END AS goals, "Season" FROM t""")
def seasons_replaced(spark, sf_dir):
    """A table of seasons in which one season is fetched again and replaced; the others stay."""
    path = sinks.scratch(spark, "seasons")
    goals = team_matches(spark, sf_dir).groupBy("Season", "Team").agg(F.sum("GoalsFor").alias("goals"))
    sinks.merge_seasons(goals, path, ["Team", "goals"])
    sinks.merge_seasons(goals.filter("Season = '9697'").withColumn("goals", F.col("goals") + 1000), path, ["Team", "goals"])
    return spark.read.option("inferSchema", False).schema("Team string, goals long, Season string").parquet(path)


@query(f"""WITH {MATCHES_SQL}, k AS (SELECT "League", "Date", "HomeTeam", "AwayTeam", count(*) AS c FROM matches GROUP BY ALL), u AS (SELECT m.* FROM matches m JOIN k ON k."League" = m."League" AND k."Date" = m."Date" AND k."HomeTeam" = m."HomeTeam" AND k."AwayTeam" = m."AwayTeam" WHERE c = 1)
SELECT match_id, 'v1' AS model_version, CASE WHEN match_id % 3 = 0 THEN "FTR" END AS actual_result FROM u""")
def log_appended_and_settled(spark, sf_dir):
    """A prediction log written by two overlapping streams, then settled by a stream of results."""
    path, feed = sinks.scratch(spark, "log"), sinks.scratch(spark, "feed")
    key = ["League", "Date", "HomeTeam", "AwayTeam"]
    games = joins.unique_keys(matches(spark, sf_dir), key)
    blank = [F.lit(None).cast(t).alias(n) for n, t in (("actual_home", "int"), ("actual_away", "int"), ("actual_result", "string"))]
    made = games.select("match_id", F.lit("v1").alias("model_version"), *key, F.lit("domestic").alias("competition"), *blank)
    made.write.parquet(f"{feed}/made")
    games.filter("match_id % 3 = 0").select("match_id", "FTHG", "FTAG", "FTR").write.parquet(f"{feed}/results")
    for turn in ("first", "again"):
        stream = spark.readStream.schema(made.schema).parquet(f"{feed}/made")
        predictions.append_stream(stream, path, f"{feed}/{turn}").awaitTermination()
    results = spark.readStream.schema("match_id long, FTHG int, FTAG int, FTR string").parquet(f"{feed}/results")
    predictions.settle_stream(results, path, f"{feed}/settled", ["match_id"]).awaitTermination()
    return spark.read.parquet(path).select("match_id", "model_version", "actual_result")


@query()
def elo_streamed(spark, sf_dir):
    """Ratings before each match from the streamed walk; the tests hold it against the batch walk."""
    feed = sinks.scratch(spark, "matches")
    games = matches(spark, sf_dir).select("match_id", "Date", "Season", "HomeTeam", "AwayTeam", "FTHG", "FTAG")
    games.write.parquet(f"{feed}/in")
    elo.walk_stream(spark.readStream.schema(games.schema).parquet(f"{feed}/in"), f"{feed}/out", f"{feed}/state").awaitTermination()
    found = spark.read.parquet(f"{feed}/out/matches")
    return found.select("match_id", F.round("home_elo", 6).alias("home_elo"), F.round("away_elo", 6).alias("away_elo"))
