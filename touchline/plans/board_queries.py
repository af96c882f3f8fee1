"""Queries over what is published: forecast frames, market comparison, boards, search, squads under quotas, the configured rating."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators import forecast_frame, player_rating, rating, search, sensitivity
from touchline.plans.bridge import PLAYERS_SQL, players, table, team_matches
from touchline.plans.forecast_queries import CELLS_SQL, RHO
from touchline.plans.forecast_queries import rates as goal_rates
from touchline.plans.match_queries import rounded
from touchline.plans.player_queries import ANCHORS, LINE_SQL, rates
from touchline.sources import sinks

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


FRAME_SQL = f"""{CELLS_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY p DESC, h, a) AS n FROM cells),
fr AS (SELECT match_id, sum(CASE WHEN h > a THEN p ELSE 0 END) AS ph, sum(CASE WHEN h = a THEN p ELSE 0 END) AS pd, sum(CASE WHEN h < a THEN p ELSE 0 END) AS pa, sum(CASE WHEN h + a > 2 THEN p ELSE 0 END) AS over25, sum(CASE WHEN h > 0 AND a > 0 THEN p ELSE 0 END) AS btts,
       max(CASE WHEN n = 1 THEN p END) AS p0, max(CASE WHEN n = 2 THEN p END) AS p1, max(CASE WHEN n = 3 THEN p END) AS p2, max(CASE WHEN n = 1 THEN h END) AS h0, max(CASE WHEN n = 1 THEN a END) AS a0 FROM rk GROUP BY match_id),
priced AS (SELECT match_id, 1 + ("HS" % 9) / 4.0::DOUBLE + 0.1::DOUBLE AS oh, 2.5::DOUBLE + ("HST" % 3) / 2.0::DOUBLE AS od, 1 + ("AST" % 7) / 3.0::DOUBLE AS oa FROM matches WHERE match_id % 4 <> 0),
mk AS (SELECT match_id, 1 / oh / (1 / oh + 1 / od + 1 / oa) AS mh_, 1 / od / (1 / oh + 1 / od + 1 / oa) AS md_, 1 / oa / (1 / oh + 1 / od + 1 / oa) AS ma_ FROM priced WHERE oh > 1 AND od > 1 AND oa > 1),
full_frame AS (SELECT mu.match_id, "League", "Season", "FTR", mh, ma, ph, pd, pa, over25, btts, p0, p1, p2, h0, a0, CASE WHEN round(ph, 12) >= round(pd, 12) AND round(ph, 12) >= round(pa, 12) THEN 'H' WHEN round(pd, 12) >= round(pa, 12) THEN 'D' ELSE 'A' END AS pick, mh_, md_, ma_ FROM mu JOIN fr USING (match_id) LEFT JOIN mk USING (match_id))"""


def frame(spark, sf_dir) -> DataFrame:
    return forecast_frame.prediction_frame(goal_rates(spark, sf_dir), rho=RHO)


def priced(spark, sf_dir) -> DataFrame:
    """The frame beside prices made from other counts of the match; every fourth match has none."""
    base = frame(spark, sf_dir)
    odds = base.filter("match_id % 4 <> 0").select("match_id", (1 + (F.col("HS") % 9) / 4.0 + 0.1).alias("AvgH"), (2.5 + (F.col("HST") % 3) / 2.0).alias("AvgD"), (1 + (F.col("AST") % 7) / 3.0).alias("AvgA"))
    return forecast_frame.with_market(base, odds, ["match_id"])


@query(f"""WITH {FRAME_SQL} SELECT match_id, round(mh, 6) AS expected_goals_home, round(ma, 6) AS expected_goals_away, round(ph, 6) AS prob_home_win, round(pd, 6) AS prob_draw, round(pa, 6) AS prob_away_win, pick AS predicted_outcome,
round(over25, 6) AS prob_over_2_5, round(btts, 6) AS prob_btts, round(p0, 6) AS score_0_prob, round(p1, 6) AS score_1_prob, round(p2, 6) AS score_2_prob FROM full_frame""")
def prediction_frame(spark, sf_dir):
    """Everything published of a forecast but the scores' own goals, which ties could turn round."""
    return rounded(frame(spark, sf_dir).select("match_id", "expected_goals_home", "expected_goals_away", "prob_home_win", "prob_draw", "prob_away_win", "predicted_outcome", "prob_over_2_5", "prob_btts", "score_0_prob", "score_1_prob", "score_2_prob"))


@query(f"""WITH {FRAME_SQL} SELECT "League", "Season", count(*) AS n_priced, round(avg((pow(ph - ("FTR" = 'H')::INT, 2) + pow(ph + pd - ("FTR" IN ('H', 'D'))::INT, 2)) / 2), 6) AS model_rps,
round(avg((pow(mh_ - ("FTR" = 'H')::INT, 2) + pow(mh_ + md_ - ("FTR" IN ('H', 'D'))::INT, 2)) / 2), 6) AS market_rps FROM full_frame WHERE mh_ IS NOT NULL GROUP BY ALL""")
def market_comparison(spark, sf_dir):
    """Our score and the market's on the matches that have a price."""
    return rounded(forecast_frame.market_scores(priced(spark, sf_dir), ["League", "Season"]))


@query(f"""WITH {FRAME_SQL}, s AS (SELECT "Team", avg("GoalsFor" - "GoalsAgainst") AS strength FROM (SELECT "HomeTeam" AS "Team", "FTHG" AS "GoalsFor", "FTAG" AS "GoalsAgainst" FROM matches UNION ALL SELECT "AwayTeam", "FTAG", "FTHG" FROM matches) GROUP BY ALL),
b AS (SELECT f.*, round(h.strength, 9) AS sh, round(a.strength, 9) AS sa, greatest(ph, pd, pa) AS top FROM full_frame f JOIN matches m USING (match_id) JOIN s h ON h."Team" = m."HomeTeam" JOIN s a ON a."Team" = m."AwayTeam"),
v AS (SELECT 'disagreement' AS board, match_id, pick, round(CASE pick WHEN 'H' THEN ph - mh_ WHEN 'A' THEN pa - ma_ ELSE pd - md_ END, 9) AS value FROM b
      UNION ALL SELECT 'confident', match_id, pick, round(top * 100) FROM b WHERE top >= 0.4
      UNION ALL SELECT 'upset', match_id, pick, CASE pick WHEN 'H' THEN sa - sh WHEN 'A' THEN sh - sa END FROM b WHERE CASE pick WHEN 'H' THEN sa > sh WHEN 'A' THEN sh > sa END),
r AS (SELECT *, row_number() OVER (PARTITION BY board ORDER BY abs(value) DESC, match_id) AS n FROM v WHERE value IS NOT NULL) SELECT board, match_id, pick AS predicted_outcome, round(value, 6) AS value FROM r WHERE n <= 5""")
def discover_boards(spark, sf_dir):
    """The five forecasts furthest from the market, the five surest, and the five that back the weaker side most; a top-five report."""
    strength = team_matches(spark, sf_dir).groupBy("Team").agg(F.round(F.avg(F.col("GoalsFor") - F.col("GoalsAgainst")), 9).alias("s"))
    base = priced(spark, sf_dir).join(strength.select(F.col("Team").alias("HomeTeam"), F.col("s").alias("strength_home")), "HomeTeam").join(strength.select(F.col("Team").alias("AwayTeam"), F.col("s").alias("strength_away")), "AwayTeam")
    nine = base.withColumns({c: F.round(c, 9) for c in ("prob_home_win", "prob_draw", "prob_away_win")})
    return rounded(forecast_frame.discover(nine))


QUOTA = {"defence": 4, "midfield": 3, "attack": 2}


@query(f"""WITH {LINE_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY "Season", team, line ORDER BY rating DESC, minutes DESC, player) AS k FROM lined),
m AS (SELECT *, k <= CASE line WHEN 'defence' THEN 4 WHEN 'midfield' THEN 3 ELSE 2 END AS held FROM o),
p AS (SELECT *, row_number() OVER (PARTITION BY "Season", team, held ORDER BY rating DESC, minutes DESC, player) AS n, sum(held::INT) OVER (PARTITION BY "Season", team) AS taken FROM m)
SELECT "Season", team, player, line, rating FROM p WHERE held OR n <= 11 - taken""")
def quota_squads(spark, sf_dir):
    """Eleven of each club with a floor for every line."""
    rated = rating.with_line(rating.rated_players(rates(spark, sf_dir), ANCHORS))
    order = [F.desc("rating"), F.desc("minutes"), F.asc("player")]
    return sensitivity.quota_squad(rated, ["Season", "team"], "line", QUOTA, 11, order).select("Season", "team", "player", "line", "rating")


@query(f"""WITH {LINE_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY "Season", team ORDER BY rating DESC, minutes DESC, player) AS n, count(*) OVER (PARTITION BY "Season", team) AS c FROM lined),
x AS (SELECT *, 0 AS gone FROM b WHERE n <= 15 AND c >= 5 UNION ALL SELECT *, 1 FROM b WHERE n BETWEEN 2 AND 16 AND c >= 6),
l AS (SELECT gone, "Season", team, line, sum(rating * minutes) / sum(minutes)::DOUBLE AS v FROM x GROUP BY ALL),
w AS (SELECT gone, "Season", team, sum(v * CASE line WHEN 'defence' THEN 4 ELSE 3 END) / sum(CASE line WHEN 'defence' THEN 4 ELSE 3 END) AS s FROM l GROUP BY ALL),
d AS (SELECT a."Season", a.team, round(a.s - b.s, 9) AS lost FROM w a JOIN w b ON a."Season" = b."Season" AND a.team = b.team AND a.gone = 0 AND b.gone = 1),
t AS (SELECT arg_min("Season", (-lost, "Season", team)) AS s, arg_min(team, (-lost, "Season", team)) AS m FROM d)
SELECT count(*) AS n, round(quantile_cont(lost, 0.25), 6) AS q1_drop, round(median(lost), 6) AS median_drop, round(quantile_cont(lost, 0.75), 6) AS q3_drop, round(max(lost), 6) AS max_drop, max(t.s) AS "max_Season", max(t.m) AS max_team FROM d, t""")
def one_player_drop(spark, sf_dir):
    """What a club's rating loses without its best player, rebuilt; quartiles over all clubs."""
    rated = rating.with_line(rating.rated_players(rates(spark, sf_dir), ANCHORS))
    drops, _ = sinks.written(rating.strength_without_best(rated, 15, 5).withColumn("drop", F.round("drop", 9)), "drops")
    return rounded(sensitivity.drop_summary(drops, ["Season", "team"]))


@query(f"""WITH {PLAYERS_SQL}, c AS (SELECT "Season", count(DISTINCT team) AS clubs FROM players GROUP BY ALL), l AS (SELECT max("Season") AS last FROM c), y AS (SELECT median(clubs) AS typical FROM c, l WHERE "Season" <> last)
SELECT "Season", clubs FROM c, y WHERE clubs >= 0.75 * typical""")
def publishable_seasons(spark, sf_dir):
    return sensitivity.publishable_seasons(players(spark, sf_dir).select("Season", "team").distinct())


@query(f"""WITH {PLAYERS_SQL}, n AS (SELECT players.*, p_name FROM players JOIN part ON p_partkey = player)
SELECT player, team, "Season", p_name, role, fifa_overall FROM n WHERE role = 'SMALL' AND "Season" = '9697' AND contains(lower(p_name), 'bolt') AND fifa_overall >= 60 ORDER BY fifa_overall DESC, player, team LIMIT 20 OFFSET 5""")
def player_search(spark, sf_dir):
    """The second page of a search by role, season, part of a name and least overall; a page of twenty."""
    named = players(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("player"), "p_name"), "player")
    page, _ = search.search(named.select("player", "team", "Season", "p_name", "role", "fifa_overall"), {"role": "SMALL", "Season": "9697"}, {"p_name": "BOLT"}, {"fifa_overall": 60}, "fifa_overall", True, ["fifa_overall"], ["player", "team"], 5, 20)
    return page


@query()
def similar_vectors(spark, sf_dir):
    """The ten most alike of all vectors to every subject, on the scale of the pool; the subjects are the ids divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return rounded(search.similar(vectors.filter("vec_id % 20 = 0"), vectors, "vec_id", "embedding", 10))


#: The rating's definition by role; what a metric weighs in a sub-rating, and a sub-rating in the composite.
RATING = {
    "min_minutes": 450,
    "min_group_size": 40,
    "shrinkage_nineties": 8,
    "scale": ANCHORS,
    "positions": {
        **{r: {"sub_ratings": {"defence": {"tackles_per90": 2.0, "cards_per90": -0.5}, "build": {"passes_per90": 1.0}}, "sub_rating_weights": {"defence": 3.0, "build": 1.0}} for r in ("ECONOMY", "SMALL")},
        **{r: {"sub_ratings": {"build": {"passes_per90": 2.0, "tackles_per90": 1.0}, "attack": {"goals_per90": 1.0}}, "sub_rating_weights": {"build": 2.0, "attack": 1.0}} for r in ("MEDIUM", "STANDARD")},
        **{r: {"sub_ratings": {"attack": {"goals_per90": 3.0, "shots_per90": 1.0}, "build": {"passes_per90": 1.0}}, "sub_rating_weights": {"attack": 2.0, "build": 1.0}} for r in ("LARGE", "PROMO")},
    },
    "discipline": {"metrics": {"cards_per90": 1.0}, "weight": 0.03},
    "peak_weight": 0.15,
    "fifa_weight": 0.5,
    "unmatched_shrinkage_nineties": 10,
}


@query()
def configured_rating(spark, sf_dir):
    """The rating with its own metrics for every role, coverage gates, measured shares and refusals."""
    base = rates(spark, sf_dir).withColumn("fifa_overall", F.when(F.col("player") % 5 != 0, F.col("fifa_overall")))
    base = base.select("player", "team", "Season", "role", "minutes", "nineties", "goals_per90", "shots_per90", "passes_per90", "tackles_per90", "cards_per90", "fifa_overall")
    out = player_rating.rate_players(base, RATING, ["player", "team", "Season"])
    return rounded(out.select("player", "team", "Season", "rated", "unrated_reason", "sub_defence", "sub_build", "sub_attack", "measured_share", "performance_rating", "fifa_on_our_scale", "fifa_weight_used", "rating"))


