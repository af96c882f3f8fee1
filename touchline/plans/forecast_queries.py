"""Queries over forecasts: scorelines, scores, calibration, fits, simulation; with SQL where it can say them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import names, scoreline, scoring, seasons
from touchline.operators import aggregates, boosting, forecast_frame, joins, models, resampling, sequential, sides, store, windows
from touchline.plans.bridge import FIRST_SQL, KEYS, MATCHES_SQL, SIDES, first_meetings, matches, start_sql, table
from touchline.plans.match_queries import rounded
from touchline.sources import sinks

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


RHO = -0.05
_FACTORIAL = "CASE k " + " ".join(f"WHEN {k} THEN {float(math.factorial(k))}::DOUBLE" for k in range(11)) + " END"
CELLS_SQL = f"""{MATCHES_SQL}, mu AS (SELECT match_id, "League", away_league, "Season", "Date", "FTHG", "FTAG", "FTR", 0.3::DOUBLE + "HxG" AS mh, 0.3::DOUBLE + "AxG" AS ma FROM matches),
g AS (SELECT CAST(range AS INTEGER) AS k FROM range(11)), hp AS (SELECT match_id, k AS h, exp(-mh) * pow(mh, k) / {_FACTORIAL} AS p FROM mu, g), ap AS (SELECT match_id, k AS a, exp(-ma) * pow(ma, k) / {_FACTORIAL} AS p FROM mu, g),
c0 AS (SELECT m.match_id, h, a, hp.p * ap.p * CASE WHEN h = 0 AND a = 0 THEN greatest(1 - mh * ma * {RHO}, 1e-10) WHEN h = 0 AND a = 1 THEN greatest(1 + mh * {RHO}, 1e-10) WHEN h = 1 AND a = 0 THEN greatest(1 + ma * {RHO}, 1e-10) WHEN h = 1 AND a = 1 THEN greatest(1 - ({RHO}), 1e-10) ELSE 1 END AS p
       FROM mu m JOIN hp ON hp.match_id = m.match_id JOIN ap ON ap.match_id = m.match_id),
cells AS (SELECT match_id, h, a, p / sum(p) OVER (PARTITION BY match_id) AS p FROM c0)"""
PROBS_SQL = f"""{CELLS_SQL}, probs AS (SELECT match_id, sum(CASE WHEN h > a THEN p ELSE 0 END) AS ph, sum(CASE WHEN h = a THEN p ELSE 0 END) AS pd, sum(CASE WHEN h < a THEN p ELSE 0 END) AS pa FROM cells GROUP BY match_id),
fc AS (SELECT mu.*, ph, pd, pa FROM mu JOIN probs USING (match_id))"""


def rates(spark, sf_dir) -> DataFrame:
    return matches(spark, sf_dir).withColumn("mu_home", F.lit(0.3) + F.col("HxG")).withColumn("mu_away", F.lit(0.3) + F.col("AxG"))


def grids(spark, sf_dir) -> DataFrame:
    return rates(spark, sf_dir).withColumn("grid", scoreline.cells(F.col("mu_home"), F.col("mu_away"), RHO))


def forecasts(spark, sf_dir) -> DataFrame:
    return with_outcomes(rates(spark, sf_dir))


def with_outcomes(df: DataFrame, rho: float = RHO) -> DataFrame:
    p = scoreline.outcomes(F.col("mu_home"), F.col("mu_away"), rho)
    return df.withColumn("_p", p).withColumns({"ph": F.col("_p.home"), "pd": F.col("_p.draw"), "pa": F.col("_p.away")}).drop("_p")


@query(f"WITH {CELLS_SQL} SELECT h, a, round(avg(p), 6) AS mean_p, count(*) AS n FROM cells GROUP BY ALL")
def poisson_cells(spark, sf_dir):
    cells = grids(spark, sf_dir).select(F.explode(scoreline.flat(F.col("grid"))).alias("c")).select("c.*")
    return rounded(cells.groupBy("h", "a").agg(F.avg("p").alias("mean_p"), F.count(F.lit(1)).alias("n")))


@query(f"WITH {PROBS_SQL} SELECT match_id, round(ph, 6) AS ph, round(pd, 6) AS pd, round(pa, 6) AS pa FROM fc")
def outcome_probs(spark, sf_dir):
    return rounded(forecasts(spark, sf_dir).select("match_id", "ph", "pd", "pa"))


@query(f"WITH {CELLS_SQL} SELECT match_id, round(sum(CASE WHEN h + a > 2.5 THEN p ELSE 0 END), 6) AS over, round(sum(CASE WHEN h > 0 AND a > 0 THEN p ELSE 0 END), 6) AS btts FROM cells GROUP BY ALL")
def over_under_btts(spark, sf_dir):
    g = F.col("grid")
    return rounded(grids(spark, sf_dir).select("match_id", scoreline.over(g).alias("over"), scoreline.both_score(g).alias("btts")))


@query(f"""WITH {CELLS_SQL}, r AS (SELECT match_id, h, a, p, row_number() OVER (PARTITION BY match_id ORDER BY round(p, 12) DESC, h, a) AS n FROM cells) SELECT match_id, n AS place, h, a, round(p, 6) AS p FROM r WHERE n <= 3""")
def top3_scores(spark, sf_dir):
    framed = forecast_frame.prediction_frame(rates(spark, sf_dir), rho=RHO)
    places = F.array(*[F.struct(F.lit(k + 1).alias("place"), F.col(f"score_{k}_home").alias("h"), F.col(f"score_{k}_away").alias("a"), F.col(f"score_{k}_prob").alias("p")) for k in range(3)])
    return rounded(framed.select("match_id", F.explode(places).alias("s")).select("match_id", "s.*"))


ODDS_SQL = 'CASE WHEN match_id % 13 = 0 THEN 0 ELSE 1.2 + (match_id % 40) / 10.0 END::DOUBLE AS oh, (2.5 + (match_id % 17) / 10.0)::DOUBLE AS od, (1.4 + (match_id % 31) / 10.0)::DOUBLE AS oa'


@query(f"""WITH {MATCHES_SQL}, o AS (SELECT match_id, {ODDS_SQL} FROM matches), i AS (SELECT match_id, CASE WHEN oh > 0 THEN 1 / oh END AS h, 1 / od AS d, 1 / oa AS a FROM o) SELECT match_id, round(h / (h + d + a), 6) AS ph, round(d / (h + d + a), 6) AS pd, round(a / (h + d + a), 6) AS pa FROM i""")
def devig_odds(spark, sf_dir):
    m = F.col("match_id")
    odds = F.when(m % 13 == 0, 0.0).otherwise(1.2 + (m % 40) / 10.0), 2.5 + (m % 17) / 10.0, 1.4 + (m % 31) / 10.0
    return rounded(matches(spark, sf_dir).select("match_id", *[p.alias(n) for n, p in zip(("ph", "pd", "pa"), scoring.devig(*odds), strict=True)]))


@query(f"""WITH {PROBS_SQL}, t AS (SELECT match_id, pow(ph, 1 / 1.3::DOUBLE) AS h, pow(pd, 1 / 1.3::DOUBLE) AS d, pow(pa, 1 / 1.3::DOUBLE) AS a FROM fc) SELECT match_id, round(h / (h + d + a), 6) AS ph, round(d / (h + d + a), 6) AS pd, round(a / (h + d + a), 6) AS pa FROM t""")
def temperature(spark, sf_dir):
    cols = scoring.temperature(F.col("ph"), F.col("pd"), F.col("pa"), 1.3)
    return rounded(forecasts(spark, sf_dir).select("match_id", *[c.alias(n) for n, c in zip(("ph", "pd", "pa"), cols, strict=True)]))


GAPS = {"AFRICA": 0.0, "AMERICA": -0.18, "ASIA": -0.35, "EUROPE": 0.1}


@query(f"""WITH {CELLS_SQL}, o(l, g) AS (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in GAPS.items())}) SELECT match_id, round(mh * exp((coalesce(h.g, 0) - coalesce(a.g, 0)) * 0.5::DOUBLE), 6) AS mu_home, round(ma * exp((coalesce(h.g, 0) - coalesce(a.g, 0)) * -0.5::DOUBLE), 6) AS mu_away FROM mu LEFT JOIN o h ON h.l = "League" LEFT JOIN o a ON a.l = away_league""")
def league_adjust(spark, sf_dir):
    known = F.create_map(*[F.lit(x) for pair in GAPS.items() for x in pair])
    gap = F.coalesce(known[F.col("League")], F.lit(0.0)) - F.coalesce(known[F.col("away_league")], F.lit(0.0))
    home, away = scoring.league_adjusted(F.col("mu_home"), F.col("mu_away"), gap)
    return rounded(rates(spark, sf_dir).select("match_id", home.alias("mu_home"), away.alias("mu_away")))


SCORED_SQL = f"""{PROBS_SQL}, sc AS (SELECT *, (pow(ph - CASE WHEN "FTR" = 'H' THEN 1 ELSE 0 END, 2) + pow(ph + pd - CASE WHEN "FTR" IN ('H', 'D') THEN 1 ELSE 0 END, 2)) / 2 AS rps,
 pow(ph - CASE WHEN "FTR" = 'H' THEN 1 ELSE 0 END, 2) + pow(pd - CASE WHEN "FTR" = 'D' THEN 1 ELSE 0 END, 2) + pow(pa - CASE WHEN "FTR" = 'A' THEN 1 ELSE 0 END, 2) AS brier,
 -ln(least(greatest(CASE "FTR" WHEN 'H' THEN ph WHEN 'D' THEN pd ELSE pa END, 1e-15), 1)) AS loss, CASE WHEN round(ph, 9) >= round(pd, 9) AND round(ph, 9) >= round(pa, 9) THEN 'H' WHEN round(pd, 9) >= round(pa, 9) THEN 'D' ELSE 'A' END AS pick FROM fc)"""


def scored(spark, sf_dir) -> DataFrame:
    p = F.col("ph"), F.col("pd"), F.col("pa")
    return forecasts(spark, sf_dir).withColumns(
        {"rps": scoring.rps(p[0], p[1], F.col("FTR")), "brier": scoring.brier(*p, scoring.checked(F.col("FTR"))), "loss": scoring.log_loss(*p, F.col("FTR")), "pick": scoring.pick(*[F.round(x, 9) for x in p])}  # equal rates give equal chances, but for the last bits
    )


@query(f"""WITH {SCORED_SQL} SELECT "League", "Season", count(*) AS n, round(avg(rps), 6) AS rps, round(avg(brier), 6) AS brier, round(avg(loss), 6) AS log_loss, round(avg(CASE WHEN pick = "FTR" THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy,
 round(avg(abs("FTHG" - mh)), 6) AS goals_mae, round(sqrt(avg(pow("FTHG" - mh, 2))), 6) AS goals_rmse FROM sc GROUP BY GROUPING SETS ((), ("League"), ("League", "Season"))""")
def metric_rollup(spark, sf_dir):
    """The metric bundle overall, by league, by league and season."""
    off = F.col("FTHG") - F.col("mu_home")
    return rounded(
        scored(spark, sf_dir).rollup("League", "Season").agg(
            F.count(F.lit(1)).alias("n"), F.avg("rps").alias("rps"), F.avg("brier").alias("brier"), F.avg("loss").alias("log_loss"), F.avg((F.col("pick") == F.col("FTR")).cast("double")).alias("accuracy"), F.avg(F.abs(off)).alias("goals_mae"), F.sqrt(F.avg(off * off)).alias("goals_rmse")
        )
    )


_EDGES = scoring.bin_edges()
_BIN = "CASE " + " ".join(f"WHEN p >= {e!r}::DOUBLE THEN {i}" for i, e in reversed(list(enumerate(_EDGES[:-1])))) + " ELSE 0 END"
CALIB_SQL = f"""{PROBS_SQL}, pr AS (SELECT ph AS p, CASE WHEN "FTR" = 'H' THEN 1.0::DOUBLE ELSE 0 END AS hit FROM fc UNION ALL SELECT pd, CASE WHEN "FTR" = 'D' THEN 1.0::DOUBLE ELSE 0 END FROM fc UNION ALL SELECT pa, CASE WHEN "FTR" = 'A' THEN 1.0::DOUBLE ELSE 0 END FROM fc),
cal AS (SELECT {_BIN} AS bin, count(*) AS n, avg(p) AS forecast, avg(hit) AS observed FROM pr GROUP BY 1)"""


@query(f"WITH {CALIB_SQL} SELECT bin, n, round(forecast, 6) AS forecast, round(observed, 6) AS observed, round(observed - forecast, 6) AS gap FROM cal")
def calibration_table(spark, sf_dir):
    return rounded(aggregates.calibration_table(forecasts(spark, sf_dir), {"H": "ph", "D": "pd", "A": "pa"}, "FTR"))


@query(f"WITH {CALIB_SQL} SELECT round(sum(abs(observed - forecast) * n) / sum(n), 6) AS ece FROM cal")
def ece(spark, sf_dir):
    return rounded(aggregates.calibration_error(aggregates.calibration_table(forecasts(spark, sf_dir), {"H": "ph", "D": "pd", "A": "pa"}, "FTR")))


@query(f"""WITH {SCORED_SQL}, a AS (SELECT match_id, round(CASE "FTR" WHEN 'H' THEN ph WHEN 'D' THEN pd ELSE pa END, 9) AS p FROM sc WHERE "League" = away_league) SELECT match_id, round(p, 6) AS p FROM a ORDER BY a.p, match_id LIMIT 20""")
def against_the_run(spark, sf_dir):
    """The results that were least likely; a top-20 report."""
    given = F.when(F.col("FTR") == "H", F.col("ph")).when(F.col("FTR") == "D", F.col("pd")).otherwise(F.col("pa"))
    return rounded(forecasts(spark, sf_dir).filter("League = away_league").select("match_id", F.round(given, 9).alias("p")).orderBy("p", "match_id").limit(20))


@query(f"""WITH {CELLS_SQL}, r AS (SELECT match_id, h, a, row_number() OVER (PARTITION BY match_id ORDER BY round(p, 12) DESC, h, a) AS n FROM cells) SELECT "League", round(avg(CASE WHEN h = "FTHG" AND a = "FTAG" THEN 1.0::DOUBLE ELSE 0 END), 6) AS exact_rate, count(*) AS n FROM mu JOIN r USING (match_id) WHERE r.n = 1 GROUP BY ALL""")
def exact_score_rate(spark, sf_dir):
    framed = forecast_frame.prediction_frame(rates(spark, sf_dir), rho=RHO)
    hit = (F.col("modal_score_home") == F.col("FTHG")) & (F.col("modal_score_away") == F.col("FTAG"))
    return rounded(framed.groupBy("League").agg(F.avg(hit.cast("double")).alias("exact_rate"), F.count(F.lit(1)).alias("n")))


LOG_SQL = f"""{MATCHES_SQL}, log AS (SELECT match_id, "League", "Date", "HomeTeam", "AwayTeam", CASE WHEN match_id % 5 = 0 THEN 9 END AS actual_home, CASE WHEN match_id % 5 = 0 THEN 9 END AS actual_away, CASE WHEN match_id % 5 = 0 THEN 'D' END AS actual_result FROM matches),
res AS (SELECT match_id, "FTHG", "FTAG", "FTR" FROM matches WHERE match_id % 3 <> 0)"""


@query(f"""WITH {LOG_SQL} SELECT log.match_id, CASE WHEN actual_result IS NULL AND "FTR" IS NOT NULL THEN "FTHG" ELSE actual_home END AS actual_home, CASE WHEN actual_result IS NULL AND "FTR" IS NOT NULL THEN "FTAG" ELSE actual_away END AS actual_away, coalesce(actual_result, "FTR") AS actual_result FROM log LEFT JOIN res ON log.match_id = res.match_id""")
def settle_predictions(spark, sf_dir):
    base = matches(spark, sf_dir)
    done = F.col("match_id") % 5 == 0
    log = base.select("match_id", F.when(done, 9).alias("actual_home"), F.when(done, 9).alias("actual_away"), F.when(done, "D").alias("actual_result"))
    return store.settle(log, base.filter("match_id % 3 <> 0"), ["match_id"])


@query(f"""WITH {MATCHES_SQL}, p AS (SELECT *, 'v' || CAST(match_id % 2 AS VARCHAR) AS model_version, match_id % 4 = 2 OR (match_id % 4 = 0 AND match_id % 3 = 0) AS logged FROM matches)
SELECT match_id, model_version FROM p WHERE NOT EXISTS (SELECT 1 FROM p l WHERE l.logged AND l.model_version = p.model_version AND l."League" = p."League" AND l."Date" = p."Date" AND l."HomeTeam" = p."HomeTeam" AND l."AwayTeam" = p."AwayTeam")""")
def prediction_dedupe(spark, sf_dir):
    """New predictions whose six-column key the log lacks; an empty competition is ``domestic``."""
    base = matches(spark, sf_dir).withColumn("model_version", F.concat(F.lit("v"), (F.col("match_id") % 2).cast("string")))
    log = base.filter("match_id % 4 = 2 or (match_id % 4 = 0 and match_id % 3 = 0)").withColumn("competition", F.lit("domestic"))
    return store.new_predictions(log, base.withColumn("competition", F.lit(""))).select("match_id", "model_version")


@query("""SELECT p_partkey, trim(regexp_replace(lower(strip_accents(p_name)), '[^a-z0-9]+', ' ', 'g')) AS name FROM part""")
def normalised_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", names.normalise_name(F.col("p_name")).alias("name"))


@query(f"""WITH {FIRST_SQL}, w AS (SELECT "League", "Season", "HomeTeam" AS t, sum("FTHG")::BIGINT AS goals FROM first_m GROUP BY ALL) SELECT "League", "Season", count(*) AS clubs, CAST(sum(goals) AS BIGINT) AS goals FROM w GROUP BY ALL""")
def first_meeting_goals(spark, sf_dir):
    per = first_meetings(spark, sf_dir).groupBy("League", "Season", "HomeTeam").agg(F.sum("FTHG").alias("goals"))
    return per.groupBy("League", "Season").agg(F.count(F.lit(1)).alias("clubs"), F.sum("goals").alias("goals"))


@query()
def elo_walk(spark, sf_dir):
    return rounded(sequential.elo_walk(matches(spark, sf_dir)))


@query()
def elo_final(spark, sf_dir):
    return rounded(sequential.final_ratings(matches(spark, sf_dir)))


@query()
def elo_current_peak(spark, sf_dir):
    """Latest and highest rating of every team."""
    return rounded(sequential.current_and_peak(matches(spark, sf_dir)))


@query()
def rho_fit(spark, sf_dir):
    return spark.createDataFrame([(models.fit_rho(rates(spark, sf_dir)),)], "rho double")


@query()
def temperature_fit(spark, sf_dir):
    return spark.createDataFrame([(models.fit_temperature(forecasts(spark, sf_dir), "ph", "pd", "pa", "FTR"),)], "temperature double")


@query()
def league_offset_fit(spark, sf_dir):
    found = models.league_offsets(rates(spark, sf_dir).filter("League <> away_league"), "EUROPE")
    return spark.createDataFrame(sorted(found.items()), "league string, strength double")


STEMS = ["Points_5", "GoalsFor_5", "GoalsAgainst_5", "xGFor_5"]
FAMILIES = {"results": ["Points_5_diff"], "goals": ["home_GoalsFor_5", "home_GoalsAgainst_5", "away_GoalsFor_5", "away_GoalsAgainst_5"], "xg": ["home_xGFor_5", "away_xGFor_5"]}


def features(games: DataFrame) -> DataFrame:
    """Matches with both teams' form over the five matches before; nothing of the match itself but its result."""
    long = windows.with_form(sides.prepare(sides.unpivot_sides(games, KEYS, SIDES)), ["Team"], ["Date", "match_id"], 5, dict.fromkeys([x[:-2] for x in STEMS], "mean"), "5")
    wide = sides.with_diffs(sides.repivot(long, ["match_id"], STEMS), STEMS).drop("HomeTeam", "AwayTeam")
    return games.select("match_id", "League", "Season", "Date", "FTHG", "FTAG", "FTR").join(wide, "match_id").withColumn("start", seasons.season_start(F.col("Season"))).withColumn("nothing", F.lit(0.0))


#: The inputs of the boosted goal model.
BOOSTED = [f"{side}_{stem}" for side in ("home", "away") for stem in STEMS] + [f"{stem}_diff" for stem in STEMS] + ["nothing_known"]
#: Trees of the registered fits, fewer and faster ones than the operator's own 300 at 0.02.
TREES = {"trees": 12, "rate": 0.2, "leaves": 8, "depth": 4}


def written_features(games: DataFrame) -> DataFrame:
    """``features``, written once: every fit and every fold reads the table and not the windows."""
    table, _ = sinks.written(features(games).withColumn("nothing_known", F.lit(None).cast("double")), "features")
    return table


def boosted_split(spark, sf_dir) -> tuple[boosting.Boosted, DataFrame]:
    """Goal rates fitted on all seasons but the last, and the last."""
    base = written_features(matches(spark, sf_dir))
    last = base.agg(F.max("start")).first()[0]
    train = base.filter(F.col("start") < last).select(*BOOSTED, F.col("FTHG").alias("home"), F.col("FTAG").alias("away"))
    return boosting.fit_boosted(train, BOOSTED, ["home", "away"], **TREES), base.filter(F.col("start") == last)


@query()
def boosted_goals(spark, sf_dir):
    """Expected goals of the last season's matches, from boosted trees on the seasons before it."""
    model, last = boosted_split(spark, sf_dir)
    return rounded(with_outcomes(model.predict(last), 0.0).select("match_id", "Season", "FTR", "mu_home", "mu_away", "ph", "pd", "pa"))


@query()
def goal_drivers(spark, sf_dir):
    """The five inputs that moved each side's expected goals most, for every match of the last season."""
    model, last = boosted_split(spark, sf_dir)
    return rounded(model.drivers(last, ["match_id"], 5))


def walk_forward(base: DataFrame, columns: list[str], first: int = 1) -> DataFrame:
    """Forecasts of every season from the ``first`` on (counted from 0), each by a model of all the seasons before it.

    ``base`` has ``start``, the year in which a season starts; seasons go by it.
    """
    starts = [r[0] for r in base.select("start").distinct().orderBy("start").collect()]
    parts = None
    for start in starts[first:]:
        model = models.fit_goals(base.filter(F.col("start") < start), columns)
        fold = model.predict(base.filter(F.col("start") == start)).select("match_id", "League", "Season", "start", "FTR", "mu_home", "mu_away")
        parts = fold if parts is None else parts.union(fold)
    return with_outcomes(parts, 0.0)


@query()
def walk_forward_backtest(spark, sf_dir):
    """Every season but the first, forecast from form by a model of the seasons before it, scored by season."""
    p = walk_forward(written_features(matches(spark, sf_dir)), ["home_GoalsFor_5", "home_GoalsAgainst_5", "away_GoalsFor_5", "away_GoalsAgainst_5", "Points_5_diff", "xGFor_5_diff"])
    return rounded(p.groupBy("Season").agg(F.count(F.lit(1)).alias("n"), F.avg(scoring.rps(F.col("ph"), F.col("pd"), F.col("FTR"))).alias("rps")))


def base_rates(games: DataFrame) -> DataFrame:
    """League and start of a season, with the shares of results in all the league's seasons before: the base-rate forecast."""
    share = {n: F.sum((F.col("FTR") == r).cast("double")).alias(n) for n, r in (("h", "H"), ("d", "D"), ("a", "A"))}
    by = games.filter("FTR is not null").groupBy("League", seasons.season_start(F.col("Season")).alias("start")).agg(*share.values())
    before = Window.partitionBy("League").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    total = sum((F.sum(n).over(before) for n in "hda"), F.lit(0.0))
    return by.select("League", "start", (F.sum("h").over(before) / total).alias("base_h"), (F.sum("d").over(before) / total).alias("base_d"))


RATE_SQL = f"""{SCORED_SQL}, ls AS (SELECT "League", {start_sql('"Season"')} AS start, sum(CASE "FTR" WHEN 'H' THEN 1 ELSE 0 END) AS h, sum(CASE "FTR" WHEN 'D' THEN 1 ELSE 0 END) AS d, sum(CASE "FTR" WHEN 'A' THEN 1 ELSE 0 END) AS a FROM sc GROUP BY ALL),
br AS (SELECT "League", start, sum(h) OVER w / (sum(h + d + a) OVER w)::DOUBLE AS bh, sum(d) OVER w / (sum(h + d + a) OVER w)::DOUBLE AS bd FROM ls WINDOW w AS (PARTITION BY "League" ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pairs AS (SELECT match_id, "Season", rps, (pow(bh - CASE WHEN "FTR" = 'H' THEN 1 ELSE 0 END, 2) + pow(bh + bd - CASE WHEN "FTR" IN ('H', 'D') THEN 1 ELSE 0 END, 2)) / 2 AS base_rps FROM sc JOIN br ON br."League" = sc."League" AND br.start = {start_sql('sc."Season"')} WHERE bh IS NOT NULL)"""


def paired(spark, sf_dir) -> DataFrame:
    """match_id, Season, rps, base_rps: the model and the base-rate forecast on the same matches, from the second season on."""
    rows = scored(spark, sf_dir).withColumn("start", seasons.season_start(F.col("Season"))).join(base_rates(matches(spark, sf_dir)), ["League", "start"])
    return rows.filter("base_h is not null").select("match_id", "Season", "rps", scoring.rps(F.col("base_h"), F.col("base_d"), F.col("FTR")).alias("base_rps"))


@query(f"""WITH {RATE_SQL} SELECT "Season", count(*) AS n, round(avg(rps), 6) AS rps, round(avg(base_rps), 6) AS base_rps, round(avg(rps - base_rps), 6) AS delta FROM pairs GROUP BY ALL""")
def against_base_rate(spark, sf_dir):
    """The forecast against the base rate of the seasons before, season by season."""
    return rounded(paired(spark, sf_dir).groupBy("Season").agg(F.count(F.lit(1)).alias("n"), F.avg("rps").alias("rps"), F.avg("base_rps").alias("base_rps"), F.avg(F.col("rps") - F.col("base_rps")).alias("delta")))


@query()
def paired_bootstrap(spark, sf_dir):
    """The model's mean gain on the base rate, with the interval of 10,000 resamples of the matches."""
    diffs = paired(spark, sf_dir).select("match_id", (F.col("rps") - F.col("base_rps")).alias("diff"))
    return rounded(resampling.paired_bootstrap(diffs, "diff"))


@query()
def season_simulation(spark, sf_dir):
    """The rest of every league's last season, 10,000 times, from what its teams scored and conceded so far."""
    first = first_meetings(spark, sf_dir)
    last = first.groupBy("League").agg(F.max_by("Season", seasons.season_start(F.col("Season"))).alias("Season"))
    played = first.join(last, ["League", "Season"])
    tmh = sides.unpivot_sides(played, ["League", "Season"], {"GoalsFor": ("FTHG", "FTAG"), "GoalsAgainst": ("FTAG", "FTHG")})
    left = resampling.fixture_rates(joins.round_robin_left(played, ["League"]), played, tmh)
    return rounded(resampling.simulate_season(left, aggregates.league_table(tmh, ["League"]), "League"))


@query()
def shapley_families(spark, sf_dir):
    """What each family of inputs adds to the forecast of the last season: the mean gain in RPS, over all coalitions.

    A model is fitted for each coalition, and a match's gain from a family is the weighted sum of
    the differences of its scores, taken in one aggregation.
    """
    base = written_features(matches(spark, sf_dir))
    joined = None
    for coalition in resampling.coalitions(list(FAMILIES)):
        columns = [c for m in coalition for c in FAMILIES[m]] or ["nothing"]
        scores = walk_forward(base, columns, max(1, base.select("start").distinct().count() - 1)).select("match_id", scoring.rps(F.col("ph"), F.col("pd"), F.col("FTR")).alias("_".join(["rps", *coalition])))
        joined = scores if joined is None else joined.join(scores, "match_id")
    gains = [F.avg(resampling.shapley_column(m, list(FAMILIES), lambda c: -F.col("_".join(["rps", *c])))).alias(m) for m in FAMILIES]
    row = joined.agg(*gains).first()
    return rounded(spark.createDataFrame([(m, row[m]) for m in FAMILIES], "family string, share double"), 8)


@query()
def residual_by_stratum(spark, sf_dir):
    """Per league: how much of the home goals' variance two inputs explain, and by which coefficients."""
    return rounded(models.stratum_fits(rates(spark, sf_dir).withColumn("y", F.col("FTHG").cast("double")), "y", ["HxG", "AxG"], ["League"]))


@query()
def content_fingerprint(spark, sf_dir):
    return aggregates.fingerprint(matches(spark, sf_dir), ["match_id", "FTHG", "FTAG"])
