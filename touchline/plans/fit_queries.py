"""Queries over fits with intervals, conditional corrections, gates and resumable tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import scoring, seasons
from touchline.operators import ablation, boosting, conditional_rho, match_features, models, percentiles, ranking, rating, regression, sequential
from touchline.operators.sides import unpivot_sides
from touchline.plans.bridge import KEYS, MATCHES_SQL, SIDES, TMH_SQL, matches, table, team_matches
from touchline.plans.forecast_queries import rates as goal_rates
from touchline.plans.match_queries import rounded
from touchline.plans.player_queries import ANCHORS, rates
from touchline.sources import gate, registry, resumable, sinks
from touchline.streaming import late

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query()
def league_strength_fit(spark, sf_dir):
    """Goals a match between the leagues' clubs, with intervals of 1000 resamples."""
    games = matches(spark, sf_dir).withColumn("home_league", F.col("League"))
    return rounded(regression.league_strength(games, "EUROPE"))


def moves(spark, sf_dir) -> DataFrame:
    """A rated row a player and season, with the next season's standing in the edition where there is one."""
    rated = rating.rated_players(rates(spark, sf_dir), ANCHORS)
    main = ranking.latest(rated, ["player", "Season"], [F.desc("minutes"), F.asc("team")])
    main, _ = sinks.written(main.select("player", "team", "League", "role", "Season", "age", "fifa_overall", "performance_rating"), "main")
    main = percentiles.with_standardised(percentiles.with_standardised(main, ["Season"], {"z_prior": "fifa_overall"}), rating.BY, {"z_perf": "performance_rating"})
    table_, _ = sinks.written(main.select("player", "team", "League", "Season", "age", "z_prior", "z_perf"), "moves")
    later = table_.select("player", seasons.previous_season(F.col("Season")).alias("Season"), F.col("team").alias("next_team"), F.col("z_prior").alias("z_next"))
    joined = table_.filter("z_perf is not null").join(later, ["player", "Season"], "left")
    return joined.withColumns({"outcome": F.col("z_next") - F.col("z_prior"), "mover": F.col("team") != F.col("next_team"), "age_squared": F.col("age") * F.col("age")})


@query()
def rating_travel(spark, sf_dir):
    """Whether a rating tells as much of the next edition's move for players who changed clubs, as seen and weighted for those who left the edition."""
    sample, _ = sinks.written(regression.inverse_probability_weights(moves(spark, sf_dir), F.col("outcome").isNotNull(), ["z_perf", "z_prior", "age"]), "sample")
    out = []
    for name, weight in (("seen", None), ("weighted", "weight")):
        found = regression.travel(sample, "outcome", "z_perf", "mover", ["age", "age_squared"], ["Season", "League"], ["player"], (0.8, 1.25), 400, weight)
        out.append((name, *found.values()))
    kinds = ", ".join(f"{k} {'string' if k == 'verdict' else 'double'}" for k in found)
    return rounded(spark.createDataFrame(out, f"rows string, {kinds}"), 5)


@query()
def rho_by_league(spark, sf_dir):
    """The correction of every league and fold: pooled, own, drawn together, and linear in the goals expected."""
    base = goal_rates(spark, sf_dir).withColumn("start", seasons.season_start(F.col("Season")))
    return rounded(conditional_rho.fold_corrections(base), 5)


@query()
def conditional_rho_arms(spark, sf_dir):
    """Each arm's log-likelihood, RPS and exact scores, season by season, from the second on."""
    base = goal_rates(spark, sf_dir).withColumn("start", seasons.season_start(F.col("Season"))).select("match_id", "League", "Season", "start", "FTHG", "FTAG", "mu_home", "mu_away", "FTR")
    scored = conditional_rho.walk(sinks.written(base, "rates")[0])
    return rounded(scored.groupBy("Season", "arm").agg(F.count(F.lit(1)).alias("n"), F.avg("loglik").alias("loglik"), F.avg("rps").alias("rps"), F.avg(F.col("exact").cast("double")).alias("exact")))


@query()
def elo_head_backtest(spark, sf_dir):
    """Three-way forecasts from the Elo gap alone: a head for each season, fitted on the matches before it."""
    walked, _ = sinks.written(sequential.elo_walk(matches(spark, sf_dir)).select("match_id", "home_elo", "away_elo"), "elo")
    games = matches(spark, sf_dir).select("match_id", "Season", "Date", "FTR").join(walked, "match_id").withColumn("elo_diff", F.col("home_elo") - F.col("away_elo"))
    scored = models.walk_outcome_head(sinks.written(games, "games")[0], ["elo_diff"], least=200)
    return rounded(scored.groupBy("Season").agg(F.count(F.lit(1)).alias("n"), F.avg(scoring.rps(F.col("ph"), F.col("pd"), F.col("FTR"))).alias("rps"), F.avg("ph").alias("ph"), F.avg("pd").alias("pd")), 4)


DAYS = [datetime.date(2002, 1, d) for d in (1, 5, 9)]
GATE_KEY = '"League", "Season", "Date", "HomeTeam", "AwayTeam"'


@query(f"""WITH {MATCHES_SQL}, s AS (SELECT {GATE_KEY}, min(match_id) AS id FROM matches GROUP BY ALL), worked AS (SELECT DISTINCT "League" FROM s WHERE id % 3 <> 0),
known AS (SELECT DISTINCT "League", "Season", "Date", "HomeTeam" FROM s WHERE id % 15 <> 0),
f AS (SELECT s.* FROM s LEFT JOIN known k USING ("League", "Season", "Date", "HomeTeam") JOIN worked USING ("League") WHERE k."League" IS NULL AND id % 5 = 0 AND id % 3 = 0)
SELECT {GATE_KEY}, CAST(2 AS INTEGER) AS attempts, DATE '2002-01-09' AS last_attempt FROM f""")
def results_gate(spark, sf_dir):
    """The dead-letter table after three days of a second source that lacks the shots of every third match."""
    games, _ = sinks.written(matches(spark, sf_dir).groupBy(*gate.KEY).agg(F.min("match_id").alias("id")), "schedule")
    history = games.filter("id % 5 <> 0").select("League", "Season", "Date", F.col("HomeTeam").alias("Team"))
    path = sinks.scratch(spark, "parked")

    def fetch(wanted: DataFrame) -> DataFrame:
        return games.join(wanted.select("League").distinct(), "League", "left_semi").select(*gate.KEY, F.when(F.col("id") % 3 != 0, F.lit(9)).alias("HS"), F.lit(5).alias("AS"))

    for day in DAYS:
        whole = gate.run_gate(games, history, fetch, ["HS", "AS"], path, day)
        if whole is not None:
            history, _ = sinks.written(history.unionByName(whole.select("League", "Season", "Date", F.col("HomeTeam").alias("Team"))).distinct(), "history")
    return spark.read.parquet(path)


@query(f"""WITH {TMH_SQL}, r AS (SELECT "Season" AS part, "Team", CAST(sum("GoalsFor" + CASE WHEN "Season" = '9697' AND "Team" = 'NATION_3' THEN 1 ELSE 0 END) AS BIGINT) AS goals FROM tmh GROUP BY ALL)
SELECT part, "Team", goals, CAST(1 + (SELECT count(DISTINCT part) FROM r) AS INTEGER) AS built FROM r""")
def seasons_resumed(spark, sf_dir):
    """A table built a season at a time, stopped, gone on with, and mended after one season's rows changed; with how many parts were built in all."""
    path = sinks.scratch(spark, "resumable")
    rows, _ = sinks.written(team_matches(spark, sf_dir).select("match_id", "Season", "Team", "GoalsFor"), "goals")
    changed = rows.withColumn("GoalsFor", F.col("GoalsFor") + F.when((F.col("Season") == "9697") & (F.col("Team") == "NATION_3"), 1).otherwise(0))

    def run(inputs: DataFrame, most: int | None = None) -> int:
        build = lambda parts: inputs.filter(F.col("Season").isin(parts)).groupBy(F.col("Season").alias("part"), "Team").agg(F.sum("GoalsFor").alias("goals"))
        return resumable.resume(inputs, path, "Season", build, every=2, most=most)

    built = run(rows, 3) + run(rows) + run(rows) + run(changed)
    return resumable.load(spark, path, "Team string, goals long").withColumn("built", F.lit(built))


@query("""WITH b AS (SELECT *, event_id % 7 // 3 AS batch FROM events), m AS (SELECT batch, max(ts) AS newest FROM b WHERE batch < 2 GROUP BY ALL)
SELECT event_id, CAST(batch AS BIGINT) AS batch FROM b WHERE ts < (SELECT max(newest) FROM m WHERE m.batch < b.batch) - INTERVAL '20 days'""")
def events_parked(spark, sf_dir):
    """Events that reach a stream of three batches too late for its watermark of twenty days."""
    feed = sinks.scratch(spark, "late")
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    for k in range(3):  # what the feed has delivered by each run
        events.filter(F.floor(F.col("event_id") % 7 / 3) == k).coalesce(1).write.mode("append").parquet(f"{feed}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{feed}/in")
        late.split_late(stream, f"{feed}/out", f"{feed}/state", late="20 days").awaitTermination()
    return late.read_part(spark, f"{feed}/out", "late", f"event_id long, ts {dict(events.dtypes)['ts']}").select("event_id", "batch")


@query()
def ablation_families(spark, sf_dir):
    """What Elo, form and expected goals are worth over the last season: the ladder, leave-one-out and shares of the gain."""
    games, _ = sinks.written(matches(spark, sf_dir), "games")
    walked = sequential.elo_walk(games)
    wide = match_features.match_features(unpivot_sides(games, KEYS, SIDES))
    wide = wide.select("match_id", "Season", *[c for c in match_features.model_inputs(wide) if c.endswith("_diff")])
    rated = walked.select("match_id", (F.col("home_elo") - F.col("away_elo")).alias("elo_diff")).join(games.select("match_id", "FTR"), "match_id")
    base = wide.join(rated, "match_id").withColumn("start", seasons.season_start(F.col("Season")))
    columns = [c for c in base.columns if c.endswith("_diff")]
    members = ["elo", "form", "xg"]
    scores = ablation.coalition_scores(base, ablation.classify(columns), members, folds=1)
    null = F.lit(None).cast("double")
    parts = [
        ablation.ladder(scores, members).select(F.lit("ladder").alias("part"), F.col("families").alias("name"), "rps", F.col("gain").alias("value")),
        ablation.leave_one_out(scores, members).select(F.lit("leave one out"), "family", "rps", "loss"),
        ablation.shares(scores, members).select(F.lit("share"), "family", null, "contribution"),
    ]
    return rounded(parts[0].union(parts[1]).union(parts[2]), 4)


@query()
def elo_with_ties(spark, sf_dir):
    """Ratings before the matches within a league, from a walk that also learns from those between leagues."""
    games = matches(spark, sf_dir)
    return rounded(sequential.elo_with_extra(games.filter("League = away_league"), sequential.european_rows(games.filter("League <> away_league"))))


@query()
def model_registry(spark, sf_dir):
    """Two versions of a small goal model, saved and read back: what the registry lists, and what the latest says of the last season."""
    base = goal_rates(spark, sf_dir).withColumn("start", seasons.season_start(F.col("Season"))).select("match_id", "start", "HS", "AS", "HST", "AST", F.col("FTHG").alias("home"), F.col("FTAG").alias("away"))
    root = sinks.scratch(spark, "models")
    for k, columns in enumerate((["HS", "AS"], ["HS", "AS", "HST", "AST"])):
        model = boosting.fit_boosted(base, columns, ["home", "away"], trees=3, rate=0.3, leaves=4, depth=2)
        at = datetime.datetime(2024, 1, 1 + k, tzinfo=datetime.UTC)
        registry.save(spark, root, registry.make_version(datetime.date(2002, 1, 1), at), model.to_dict(), {"features": columns}, at)
    body, meta = registry.load(spark, root)
    mean = boosting.Boosted.from_dict(body).predict(base).agg(F.avg("mu_home").alias("mu_home"), F.avg("mu_away").alias("mu_away"))
    return rounded(registry.list_versions(spark, root).crossJoin(F.broadcast(mean)).withColumn("inputs", F.lit(len(meta["features"]))), 4)
