"""The Elo walk over a stream of matches: ratings live in the state store, one state a group of connected teams."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from touchline.operators.sequential import EloState, walk_rows, walk_stages
from touchline.sources import sinks


def streamed_elo(matches: DataFrame, group: str | None = None, **options) -> DataFrame:
    """part, match_id, home_elo, away_elo before each match, as matches arrive.

    Within a micro-batch the order is that of the batch walk (date, unplayed first, id); over
    micro-batches it is the order of arrival, so a replay by date gives the batch walk's ratings.
    Ratings and seasons of a group's teams are its state, and a group's rows of a micro-batch are in
    memory at once: for groups that are small.  ``walk_stream`` has no such bound.
    """
    key = F.col(group).cast("string") if group else F.lit("all")
    neutral = F.coalesce(F.col("Neutral"), F.lit(False)) if "Neutral" in matches.columns else F.lit(False)
    rows = matches.select(key.alias("part"), "match_id", "Date", "Season", "HomeTeam", "AwayTeam", F.col("FTHG").cast("double").alias("h"), F.col("FTAG").cast("double").alias("a"), neutral.alias("n"))

    def step(part: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        elo = EloState(**options)
        if state.exists:
            elo.rating, elo.season = json.loads(state.get[0])
        frame = pd.concat(list(frames))
        frame = frame.assign(played=frame["h"].notna() & frame["a"].notna()).sort_values(["Date", "played", "match_id"], kind="stable")
        out = [elo.match(r.HomeTeam, r.AwayTeam, r.Season, r.h, r.a, bool(r.n)) for r in frame.itertuples()]
        state.update((json.dumps([elo.rating, elo.season]),))
        yield pd.DataFrame({"part": part[0], "match_id": frame["match_id"].to_numpy(), "home_elo": [x[0] for x in out], "away_elo": [x[1] for x in out]})

    kind = "part string, match_id long, home_elo double, away_elo double"
    return rows.groupBy("part").applyInPandasWithState(step, kind, "known string", "append", "NoTimeout")


def walk_stream(stream: DataFrame, path: str, checkpoint: str, group: str | None = None, **options) -> StreamingQuery:
    """The walk batch by batch, with the ratings in tables: ``path/matches`` and ``path/ratings``, a folder a batch.

    A micro-batch is walked in stages that Spark sorts, frame by frame, so neither it nor all teams'
    ratings have to fit a state's row.  A batch that is run again reads the ratings of the batch
    before it and replaces its own folders.  The order is that of ``streamed_elo``.
    """
    kind = "part string, Team string, Season string, rating double"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        ratings = spark.createDataFrame([], kind)
        if sinks.exists(spark, f"{path}/ratings"):
            before = spark.read.schema(f"{kind}, batch long").parquet(f"{path}/ratings").filter(F.col("batch") < number)
            last = before.agg(F.max("batch")).first()[0]
            ratings = before.filter(F.col("batch") == last).select("part", "Team", "Season", "rating") if last is not None else ratings
        walked, after, paths = walk_stages(ratings, walk_rows(batch, group), options)
        walked.select("part", "match_id", "home_elo", "away_elo").write.mode("overwrite").parquet(f"{path}/matches/batch={number}")
        after.coalesce(1).write.mode("overwrite").parquet(f"{path}/ratings/batch={number}")
        for own in paths:
            sinks.delete(spark, own)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
