"""Queries over squads: curves of an edition on our scale, rosters and their strength; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators import rating, ranking, squads
from touchline.plans.bridge import players, start_sql
from touchline.plans.player_queries import ANCHORS, RATING_SQL, rates
from touchline.sources.sinks import distilled

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def steady(df: DataFrame) -> DataFrame:
    """Doubles to six digits.  Means of published values often end in an exact 5 there; a hair more rounds them one way in every engine."""
    return df.select([F.round(F.col(c) + 1e-9, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def history(spark, sf_dir) -> DataFrame:
    """One rated row a player and season: the club of most minutes; the tables of the rating go."""

    def chosen() -> DataFrame:
        rated = rating.rated_players(rates(spark, sf_dir), ANCHORS)
        best = ranking.latest(rated, ["player", "Season"], [F.desc("minutes"), F.asc("team")])
        return best.select("player", "Season", "role", "rating", "minutes", "fifa_overall", "fifa_on_our_scale")

    return distilled(spark, chosen, "history")


def edition(spark, sf_dir) -> DataFrame:
    return players(spark, sf_dir).select("League", "Season", F.col("team").alias("Team"), "player", "role", "fifa_overall")


HISTORY_SQL = f"""{RATING_SQL},
hist AS (SELECT player, "Season", role, rating, minutes, fifa_overall, fifa_on_our_scale, {start_sql('"Season"')} AS start FROM player_rating QUALIFY row_number() OVER (PARTITION BY player, "Season" ORDER BY minutes DESC, team) = 1),
pts AS (SELECT role, "Season", CAST(fifa_overall AS DOUBLE) AS x, avg(fifa_on_our_scale) AS y FROM hist GROUP BY ALL),
own AS (SELECT * FROM pts QUALIFY count(*) OVER (PARTITION BY role, "Season") >= 5),
pooled AS (SELECT "Season", CAST(fifa_overall AS DOUBLE) AS x, avg(fifa_on_our_scale) AS y FROM hist GROUP BY ALL),
asked AS (SELECT DISTINCT role, "Season", CAST(fifa_overall AS DOUBLE) AS v FROM players),
near AS (SELECT a.role, a."Season", v, arg_max(struct_pack(x, y), x) FILTER (x <= v) AS lo, arg_min(struct_pack(x, y), x) FILTER (x >= v) AS hi FROM asked a LEFT JOIN own o ON o.role = a.role AND o."Season" = a."Season" GROUP BY ALL),
near_all AS (SELECT a.role, a."Season", v, arg_max(struct_pack(x, y), x) FILTER (x <= v) AS lo, arg_min(struct_pack(x, y), x) FILTER (x >= v) AS hi FROM asked a LEFT JOIN pooled o ON o."Season" = a."Season" GROUP BY ALL),
both_near AS (SELECT role, "Season", v, 1 AS k, coalesce(lo, hi) AS lo, coalesce(hi, lo) AS hi FROM near UNION ALL SELECT role, "Season", v, 2, coalesce(lo, hi), coalesce(hi, lo) FROM near_all),
vals AS (SELECT role, "Season", v, k, lo.y + coalesce((hi.y - lo.y) / nullif(hi.x - lo.x, 0) * (v - lo.x), 0) AS s FROM both_near),
scaled AS (SELECT role, "Season", v, coalesce(max(CASE WHEN k = 1 THEN s END), max(CASE WHEN k = 2 THEN s END)) AS s FROM vals GROUP BY ALL)"""

ROSTER_SQL = f"""{HISTORY_SQL},
ed AS (SELECT "League", "Season", team AS "Team", player, role, fifa_overall, {start_sql('"Season"')} AS start FROM players),
pr AS (SELECT e.*, h.rating AS prior, CAST(h.minutes AS DOUBLE) AS minutes FROM ed e LEFT JOIN hist h ON h.player = e.player AND h.start < e.start
       QUALIFY row_number() OVER (PARTITION BY e.player, e."Team", e."Season" ORDER BY h.start DESC NULLS LAST) = 1),
roster AS (SELECT "League", pr."Season", "Team", player, pr.role, fifa_overall, coalesce(CAST(prior AS DOUBLE), s) AS rating, minutes, prior IS NOT NULL AS from_history,
                  CASE WHEN pr.role IN ('ECONOMY', 'SMALL') THEN 'defence' WHEN pr.role IN ('MEDIUM', 'STANDARD') THEN 'midfield' ELSE 'attack' END AS line
           FROM pr LEFT JOIN scaled c ON c.role = pr.role AND c."Season" = pr."Season" AND c.v = pr.fifa_overall)"""


@query(f"""WITH {HISTORY_SQL} SELECT role, "Season", CAST(v AS INTEGER) AS fifa_overall, round(s + 1e-9, 6) AS on_our_scale FROM scaled""")
def edition_curves(spark, sf_dir):
    """Every overall that an edition gives, on our scale: by its role's curve, or its season's where that is thin."""
    asked = players(spark, sf_dir).select("role", "Season", "fifa_overall").distinct()
    return steady(squads.on_our_scale(asked, history(spark, sf_dir), "fifa_overall", "fifa_on_our_scale", "on_our_scale"))


@query(f"""WITH {ROSTER_SQL} SELECT "League", "Season", "Team", player, role, fifa_overall, round(rating + 1e-9, 6) AS rating, minutes, from_history, rating IS NOT NULL AS rated FROM roster""")
def edition_rosters(spark, sf_dir):
    """Each edition's squads, rated by the season before or by the curves."""
    return steady(squads.rosters(edition(spark, sf_dir), history(spark, sf_dir)))


@query(f"""WITH {ROSTER_SQL},
wt AS (SELECT * REPLACE (coalesce(minutes, avg(minutes) OVER (PARTITION BY "Season", "Team", line), 0) AS minutes) FROM roster),
b AS (SELECT *, row_number() OVER (PARTITION BY "League", "Season", "Team" ORDER BY rating DESC, minutes DESC, player) AS n FROM wt WHERE rating IS NOT NULL QUALIFY count(*) OVER (PARTITION BY "League", "Season", "Team") >= 11),
s AS (SELECT "League", "Season", "Team", line, CASE WHEN sum(minutes) > 0 THEN sum(rating * minutes) / sum(minutes) ELSE avg(rating) END AS v, count(*) AS c, CAST(sum(CAST(from_history AS INTEGER)) AS BIGINT) AS h FROM b WHERE n <= 15 GROUP BY ALL),
p AS (SELECT "League", "Season", "Team", max(CASE WHEN line = 'defence' THEN v END) AS d, max(CASE WHEN line = 'midfield' THEN v END) AS m, max(CASE WHEN line = 'attack' THEN v END) AS a, CAST(sum(c) AS BIGINT) AS n_players, CAST(sum(h) AS BIGINT) AS n_from_history FROM s GROUP BY ALL)
SELECT "League", "Season", "Team", round(d + 1e-9, 6) AS squad_defence, round(m + 1e-9, 6) AS squad_midfield, round(a + 1e-9, 6) AS squad_attack, n_players, n_from_history,
round((coalesce(4 * d, 0) + coalesce(3 * m, 0) + coalesce(3 * a, 0)) / (CASE WHEN d IS NULL THEN 0 ELSE 4 END + CASE WHEN m IS NULL THEN 0 ELSE 3 END + CASE WHEN a IS NULL THEN 0 ELSE 3 END) + 1e-9, 6) AS squad_overall FROM p""")
def squad_strength(spark, sf_dir):
    """Strength of the squads that an edition places at the clubs, from their best fifteen."""
    roster = rating.with_line(squads.rosters(edition(spark, sf_dir), history(spark, sf_dir)))
    return steady(squads.squad_strength(roster, rating.LINE_WEIGHTS, least=11))
