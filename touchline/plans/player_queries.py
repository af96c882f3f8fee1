"""Queries over player-seasons: rates, ratings, squads, boards; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import scale, seasons
from touchline.operators import aggregates, joins, percentiles, ranking, rating
from touchline.plans.bridge import PLAYERS_SQL, players, start_sql, table
from touchline.plans.match_queries import rounded
from touchline.sources.sinks import written

QUERIES, ORACLE_SQL = {}, {}
KEY = ["player", "team", "Season"]
BY = ["role", "Season"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def pct_sql(metric: str, by: str = 'role, "Season"', table: str = "", better: bool = True) -> str:
    share = f"""(rank() OVER (PARTITION BY {by} ORDER BY {metric} NULLS LAST) + (count({metric}) OVER (PARTITION BY {by}, {metric}) - 1) / 2.0::DOUBLE) / count({metric}) OVER (PARTITION BY {by})"""
    return f"CASE WHEN {metric} IS NOT NULL THEN {share if better else '1 - ' + share} END"


RATES_SQL = f"""{PLAYERS_SQL},
rates AS (SELECT *, CASE WHEN nineties > 0 THEN goals / nineties END AS goals_per90, CASE WHEN nineties > 0 THEN shots / nineties END AS shots_per90, CASE WHEN nineties > 0 THEN passes / nineties END AS passes_per90,
                 CASE WHEN nineties > 0 AND player % 11 <> 0 THEN tackles / nineties END AS tackles_per90, CASE WHEN nineties > 0 THEN cards / nineties END AS cards_per90 FROM players)"""


def rates(spark, sf_dir) -> DataFrame:
    """Per-90 rates; every eleventh player has no tackle data, as a source may lack a metric."""
    df = players(spark, sf_dir)
    per90 = {f"{m}_per90": scale.guarded(F.col(m), F.col("nineties")) for m in ("goals", "shots", "passes", "tackles", "cards")}
    return df.withColumns(per90).withColumn("tackles_per90", F.when(F.col("player") % 11 != 0, F.col("tackles_per90")))


@query(f'WITH {RATES_SQL} SELECT player, team, "Season", round(goals_per90, 6) AS goals_per90, round(tackles_per90, 6) AS tackles_per90, round(cards_per90, 6) AS cards_per90 FROM rates')
def per90(spark, sf_dir):
    return rounded(rates(spark, sf_dir).select(*KEY, "goals_per90", "tackles_per90", "cards_per90"))


@query(f"""WITH {RATES_SQL} SELECT player, team, "Season", round(goals_per90 / nullif(sum(goals) OVER t / sum(nineties) OVER t * 11, 0), 7) AS goals_share,
round(tackles_per90 / nullif(sum(passes) OVER t / sum(nineties) OVER t * 10, 0), 7) AS tackles_padj FROM rates WINDOW t AS (PARTITION BY "League", "Season", team)""")
def team_share(spark, sf_dir):
    """A player's rate against the team's, and tackles against the passes the team plays."""
    team = Window.partitionBy("League", "Season", "team")
    share = F.col("goals_per90") / F.nullif(F.sum("goals").over(team) / F.sum("nineties").over(team) * 11, F.lit(0.0))
    padj = F.col("tackles_per90") / F.nullif(F.sum("passes").over(team) / F.sum("nineties").over(team) * 10, F.lit(0.0))
    return rounded(rates(spark, sf_dir).select(*KEY, share.alias("goals_share"), padj.alias("tackles_padj")), 7)


@query(f'WITH {RATES_SQL} SELECT player, team, "Season", round({pct_sql("tackles_per90")}, 6) AS tackles_pct, round({pct_sql("cards_per90", better=False)}, 6) AS cards_pct FROM rates')
def percentile_within(spark, sf_dir):
    df = rates(spark, sf_dir)
    return rounded(df.select(*KEY, scale.percentile_within("tackles_per90", BY).alias("tackles_pct"), scale.percentile_within("cards_per90", BY, higher_is_better=False).alias("cards_pct")))


ANCHORS = [(0.0, 40.0), (0.1, 55.0), (0.5, 66.0), (0.9, 79.0), (0.99, 88.0), (1.0, 94.0)]


def scale_sql(x: str) -> str:
    parts = [f"WHEN {x} <= {ANCHORS[0][0]}::DOUBLE THEN {ANCHORS[0][1]}::DOUBLE"]
    for (x0, y0), (x1, y1) in zip(ANCHORS, ANCHORS[1:], strict=False):
        parts.append(f"WHEN {x} <= {x1}::DOUBLE THEN {y0}::DOUBLE + ({x} - {x0}::DOUBLE) * {(y1 - y0) / (x1 - x0)!r}::DOUBLE")
    return f"CASE WHEN {x} IS NULL THEN NULL {' '.join(parts)} ELSE {ANCHORS[-1][1]}::DOUBLE END"


@query(f'WITH {RATES_SQL}, p AS (SELECT player, team, "Season", {pct_sql("goals_per90")} AS pct FROM rates) SELECT player, team, "Season", round({scale_sql("pct")}, 6) AS rating FROM p')
def scale_map(spark, sf_dir):
    df = rates(spark, sf_dir).withColumn("pct", scale.percentile_within("goals_per90", BY))
    return rounded(df.select(*KEY, scale.scale_map(F.col("pct"), ANCHORS).alias("rating")))


@query(f'WITH {RATES_SQL} SELECT player, team, "Season", round((nineties * goals_per90 + 8 * avg(goals_per90) OVER (PARTITION BY role, "Season")) / (nineties + 8), 6) AS shrunk FROM rates')
def shrink(spark, sf_dir):
    return rounded(rates(spark, sf_dir).select(*KEY, scale.shrink_toward_mean("goals_per90", "nineties", BY, 8).alias("shrunk")))


@query(f"""WITH {PLAYERS_SQL}, v AS (SELECT player, team, role, sum(minutes) AS m FROM players GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY m DESC, team) AS n, m / sum(m) OVER (PARTITION BY player) AS share FROM v)
SELECT player, team, CAST(m AS BIGINT) AS votes, round(share, 6) AS share FROM r WHERE n = 1 AND m >= 900 AND share >= 0.1""")
def career_club(spark, sf_dir):
    """The club of most minutes, if it has enough of them."""
    top = aggregates.modal(players(spark, sf_dir), ["player"], "team", F.col("minutes"), 900, 0.1)
    return rounded(top.select("player", "team", "votes", "share"))


RATING_SQL = f"""{RATES_SQL},
pool AS (SELECT *, count(*) FILTER (minutes >= 450) OVER (PARTITION BY role, "Season") AS pool_size FROM rates),
elig AS (SELECT *, CASE WHEN minutes < 450 THEN 'minutes' WHEN pool_size < 40 THEN 'sparse pool' END AS unrated_reason FROM pool),
pct AS (SELECT *, {pct_sql("goals_per90")} AS goals_pct, {pct_sql("shots_per90")} AS shots_pct, {pct_sql("passes_per90")} AS passes_pct, {pct_sql("tackles_per90")} AS tackles_pct, {pct_sql("cards_per90", better=False)} AS cards_pct
        FROM elig WHERE unrated_reason IS NULL),
sub AS (SELECT *, (0.6::DOUBLE * goals_pct + 0.4::DOUBLE * shots_pct) AS sub_attack,
        CASE WHEN tackles_pct IS NULL THEN passes_pct ELSE (0.7::DOUBLE * passes_pct + 0.3::DOUBLE * tackles_pct) END AS sub_build,
        tackles_pct AS sub_defence FROM pct),
comp AS (SELECT *, (0.4::DOUBLE * sub_attack + 0.3::DOUBLE * sub_build + coalesce(0.27::DOUBLE * sub_defence, 0) + 0.03::DOUBLE * cards_pct) / (0.4::DOUBLE + 0.3::DOUBLE + CASE WHEN sub_defence IS NULL THEN 0 ELSE 0.27::DOUBLE END + 0.03::DOUBLE) AS base FROM sub),
peak AS (SELECT *, 0.85::DOUBLE * base + 0.15::DOUBLE * greatest(sub_attack, sub_build, coalesce(sub_defence, 0)) AS composite FROM comp),
shr AS (SELECT *, (nineties * composite + 8 * avg(composite) OVER (PARTITION BY role, "Season")) / (nineties + 8) AS shrunk FROM peak),
sr AS (SELECT *, round(shrunk, 9) AS shrunk9 FROM shr),
rk AS (SELECT *, {pct_sql("shrunk9")} AS performance_pct, {pct_sql("fifa_overall")} AS fifa_pct FROM sr),
rated AS (SELECT *, round({scale_sql("performance_pct")}, 6) AS performance_rating, round({scale_sql("fifa_pct")}, 6) AS fifa_on_our_scale FROM rk),
final AS (SELECT *, CASE WHEN tackles_per90 IS NULL THEN 0.75::DOUBLE ELSE 0.5::DOUBLE END AS w FROM rated),
player_rating AS (SELECT *, round_even((1 - w) * performance_rating + w * fifa_on_our_scale, 0)::INTEGER AS rating FROM final)"""


@query(f"""WITH {RATING_SQL} SELECT player, team, "Season", unrated_reason FROM elig""")
def rating_eligibility(spark, sf_dir):
    return rating.with_eligibility(rates(spark, sf_dir)).select(*KEY, "unrated_reason")


@query(f"""WITH {RATING_SQL} SELECT player, team, "Season", round(sub_attack, 6) AS sub_attack, round(sub_build, 6) AS sub_build, round(sub_defence, 6) AS sub_defence FROM sub""")
def sub_ratings(spark, sf_dir):
    return rounded(rating.with_sub_ratings(rating.eligible(rates(spark, sf_dir))).select(*KEY, "sub_attack", "sub_build", "sub_defence"))


@query(f"""WITH {RATING_SQL} SELECT player, team, "Season", round(base, 6) AS base, round(composite, 6) AS composite FROM peak""")
def composite_rating(spark, sf_dir):
    return rounded(rating.with_composite(rating.with_sub_ratings(rating.eligible(rates(spark, sf_dir)))).select(*KEY, "base", "composite"))


@query(f"""WITH {RATING_SQL} SELECT player, team, "Season", performance_rating, fifa_on_our_scale, rating FROM player_rating""")
def player_rating(spark, sf_dir):
    return rating.rated_players(rates(spark, sf_dir), ANCHORS).select(*KEY, "performance_rating", "fifa_on_our_scale", "rating")


LINE_SQL = f"""{RATING_SQL},
lined AS (SELECT *, CASE WHEN role IN ('ECONOMY', 'SMALL') THEN 'defence' WHEN role IN ('MEDIUM', 'STANDARD') THEN 'midfield' ELSE 'attack' END AS line FROM player_rating)"""


@query(f"""WITH {LINE_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY "Season", team ORDER BY rating DESC, minutes DESC, player) AS n, count(*) OVER (PARTITION BY "Season", team) AS c FROM lined),
l AS (SELECT "Season", team, line, sum(rating * minutes) / sum(minutes)::DOUBLE AS v FROM b WHERE n <= 15 AND c >= 11 GROUP BY ALL),
p AS (SELECT "Season", team, max(CASE WHEN line = 'defence' THEN v END) AS d, max(CASE WHEN line = 'midfield' THEN v END) AS m, max(CASE WHEN line = 'attack' THEN v END) AS a FROM l GROUP BY ALL)
SELECT "Season", team, round(d, 6) AS strength_defence, round(m, 6) AS strength_midfield, round(a, 6) AS strength_attack,
round((coalesce(4 * d, 0) + coalesce(3 * m, 0) + coalesce(3 * a, 0)) / (CASE WHEN d IS NULL THEN 0 ELSE 4 END + CASE WHEN m IS NULL THEN 0 ELSE 3 END + CASE WHEN a IS NULL THEN 0 ELSE 3 END), 6) AS strength_overall FROM p""")
def best_n_strength(spark, sf_dir):
    """Club strength by line from the best fifteen, weighted by minutes."""
    rated = rating.with_line(rating.rated_players(rates(spark, sf_dir), ANCHORS))
    return rounded(rating.team_strength(rated, 15, 11))


@query(f"""WITH {LINE_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY "Season", team, line ORDER BY minutes DESC, rating DESC, player) AS k FROM lined),
s AS (SELECT *, k <= CASE line WHEN 'defence' THEN 5 WHEN 'midfield' THEN 3 ELSE 3 END AS starter FROM a), o AS (SELECT *, row_number() OVER (PARTITION BY "Season", team ORDER BY starter DESC, minutes DESC, rating DESC, player) AS place FROM s)
SELECT "Season", team, player, line, starter, place FROM o WHERE place <= 11""")
def formation_eleven(spark, sf_dir):
    rated = rating.with_line(rating.rated_players(rates(spark, sf_dir), ANCHORS))
    order = [F.desc("minutes"), F.desc("rating"), F.asc("player")]
    return ranking.eleven(rated, ["Season", "team"], "line", {"defence": 5, "midfield": 3, "attack": 3}, order).select("Season", "team", "player", "line", "starter", "place")


@query(f"""WITH {RATING_SQL}, g AS (SELECT player, team, "Season", role, performance_rating - fifa_on_our_scale AS gap, minutes FROM player_rating WHERE minutes >= 900),
n AS (SELECT *, row_number() OVER (ORDER BY gap DESC, minutes DESC, player, team, "Season") AS place FROM g) SELECT player, team, "Season", round(gap, 6) AS gap, place FROM n WHERE place <= 25""")
def hidden_gems(spark, sf_dir):
    """Players whom our rating puts furthest above the edition's; a top-25 report."""
    rated = rating.rated_players(rates(spark, sf_dir), ANCHORS).filter("minutes >= 900").withColumn("gap", F.col("performance_rating") - F.col("fifa_on_our_scale"))
    order = [F.desc("gap"), F.desc("minutes"), F.asc("player"), F.asc("team"), F.asc("Season")]
    top = rated.orderBy(*order).limit(25)  # bounded, so that numbering them takes one task
    return rounded(top.withColumn("place", F.row_number().over(Window.orderBy(*order))).select(*KEY, "gap", "place"))


@query(f"""WITH {RATING_SQL}, e AS (SELECT player, team, role, "Season", rating, fifa_overall, lpad(CAST((CAST(substr("Season", 1, 2) AS INTEGER) + 1) % 100 AS VARCHAR), 2, '0') AS y FROM player_rating),
p AS (SELECT player, "Season", max(fifa_overall) AS best FROM players GROUP BY ALL) SELECT e.player, e.team, e."Season", p.best - e.fifa_overall AS ea_move FROM e LEFT JOIN p ON p.player = e.player AND substr(p."Season", 1, 2) = e.y""")
def next_edition_move(spark, sf_dir):
    """How the next edition moved; null where a player is not in it."""
    rated = rating.rated_players(rates(spark, sf_dir), ANCHORS).select(*KEY, "fifa_overall")
    later = players(spark, sf_dir).groupBy("player", seasons.previous_season(F.col("Season")).alias("Season")).agg(F.max("fifa_overall").alias("best"))
    return rated.join(later, ["player", "Season"], "left").select(*KEY, (F.col("best") - F.col("fifa_overall")).alias("ea_move"))


@query(f"""WITH {RATING_SQL}, z AS (SELECT role, "Season", performance_rating AS p, fifa_on_our_scale AS f, count(*) OVER s AS c, avg(performance_rating) OVER s AS pm, stddev_samp(performance_rating) OVER s AS ps, avg(fifa_on_our_scale) OVER s AS fm, stddev_samp(fifa_on_our_scale) OVER s AS fs
FROM player_rating WINDOW s AS (PARTITION BY role, "Season")) SELECT round(corr((p - pm) / ps, (f - fm) / fs), 6) AS agreement, count(*) AS n FROM z WHERE c >= 10""")
def gems_agreement(spark, sf_dir):
    rated = rating.rated_players(rates(spark, sf_dir), ANCHORS)
    pairs, _ = written(rated.select(*BY, "performance_rating", "fifa_on_our_scale"), "pairs")
    z = percentiles.with_standardised(pairs, BY, {"p": "performance_rating", "f": "fifa_on_our_scale"}).filter("p is not null and f is not null")
    return rounded(z.agg(F.corr("p", "f").alias("agreement"), F.count(F.lit(1)).alias("n")))


@query(f"""WITH {RATING_SQL}, a AS (SELECT player, {start_sql('"Season"')} AS y, max(rating) AS r FROM player_rating GROUP BY ALL), x AS (SELECT DISTINCT player, "Season", {start_sql('"Season"')} AS y FROM players)
SELECT x.player, x."Season", a.y AS asof_y, a.r FROM x LEFT JOIN a ON a.player = x.player AND a.y < x.y QUALIFY row_number() OVER (PARTITION BY x.player, x."Season" ORDER BY a.y DESC NULLS LAST) = 1""")
def asof_latest_rating(spark, sf_dir):
    """To each player-season, the latest rating of an earlier season, however old."""
    year = seasons.season_start(F.col("Season")).alias("y")
    rated = rating.rated_players(rates(spark, sf_dir), ANCHORS).groupBy("player", year).agg(F.max("rating").alias("r"))
    seen = players(spark, sf_dir).select("player", "Season", year).distinct()
    return joins.asof_latest(seen, rated, ["player"], "y", "y", ["r"]).select("player", "Season", "asof_y", "r")


@query(f"""WITH {PLAYERS_SQL}, e AS (SELECT player, {start_sql('"Season"')} AS y, CASE WHEN player % 3 <> 0 THEN min(role) || CASE WHEN player % 2 = 0 THEN '' ELSE '*' END END AS role FROM players WHERE (player + {start_sql('"Season"')}) % 4 <> 0 GROUP BY player, {start_sql('"Season"')}),
s AS (SELECT DISTINCT player, {start_sql('"Season"')} AS y FROM players), o(offs, place) AS (VALUES (0, 0), (-1, 1), (1, 2)),
j AS (SELECT s.player, s.y, e.role, place FROM s CROSS JOIN o LEFT JOIN e ON e.player = s.player AND e.y = s.y + offs AND e.role IS NOT NULL)
SELECT player, y, (array_agg(role ORDER BY place) FILTER (WHERE role IS NOT NULL))[1] AS nearest_role FROM j GROUP BY player, y""")
def nearest_season_role(spark, sf_dir):
    """A role carried from the nearest season, one away at most, the earlier on ties."""
    year = seasons.season_start(F.col("Season"))
    base = players(spark, sf_dir).withColumn("y", year)
    known = base.filter((F.col("player") + F.col("y")) % 4 != 0).groupBy("player", "y").agg(F.min("role").alias("role"))
    known = known.withColumn("role", F.when(F.col("player") % 3 != 0, F.concat("role", F.when(F.col("player") % 2 == 0, "").otherwise("*"))))
    return joins.nearest(base.select("player", "y").distinct(), known, ["player"], "y", "y", "role", 1)


@query(f"""WITH {PLAYERS_SQL}, a AS (SELECT DISTINCT player // 20 AS name, age, player, {start_sql('"Season"')} AS y FROM players),
j AS (SELECT a.player, a.y, a.age, b.player AS other, count(*) OVER (PARTITION BY a.player, a.age, a.y) AS n FROM a JOIN a b ON a.name = b.name AND b.y = a.y + 1 AND abs(b.age - (a.age + 1)) <= 1.5) SELECT player, y, age, other FROM j WHERE n = 1""")
def age_band_match(spark, sf_dir):
    """From every season to the next: same name and an age near one year on, kept only where it is the one candidate."""
    year = seasons.season_start(F.col("Season"))
    a = players(spark, sf_dir).select(F.floor(F.col("player") / 20).alias("name"), "age", "player", year.alias("y")).distinct()
    b = a.select(F.col("name").alias("n2"), F.col("age").alias("age2"), F.col("player").alias("other"), (F.col("y") - 1).alias("y2"))
    same = (F.col("name") == F.col("n2")) & (F.col("y") == F.col("y2"))
    return joins.band_match(a, b, same, F.abs(F.col("age2") - (F.col("age") + 1)) <= 1.5, ["player", "age", "y"]).select("player", "y", "age", "other")


@query(f"""WITH {RATES_SQL}, c AS (SELECT role, "Season", goals_per90 AS x, count(goals_per90) OVER (PARTITION BY role, "Season") AS n, rank() OVER (PARTITION BY role, "Season" ORDER BY goals_per90 NULLS LAST) - 1 AS below, player, team FROM rates)
SELECT player, team, "Season", round(below / n::DOUBLE, 6) AS below_share FROM c WHERE n >= 20""")
def stat_percentile(spark, sf_dir):
    df = rates(spark, sf_dir).withColumn("below_share", ranking.bottom_share("goals_per90", BY)).filter("below_share is not null")
    return rounded(df.select(*KEY, "below_share"))


@query(f"""WITH {PLAYERS_SQL}, k AS (SELECT player, team, "Season", minutes FROM players WHERE player % 2 = 0), g AS (SELECT player, team, "Season", goals FROM players WHERE player % 3 = 0)
SELECT coalesce(k.player, g.player) AS player, coalesce(k.team, g.team) AS team, coalesce(k."Season", g."Season") AS "Season", minutes, goals FROM k FULL JOIN g ON k.player = g.player AND k.team = g.team AND k."Season" = g."Season" """)
def keeper_full_outer(spark, sf_dir):
    base = players(spark, sf_dir)
    return base.filter("player % 2 = 0").select(*KEY, "minutes").join(base.filter("player % 3 = 0").select(*KEY, "goals"), KEY, "full")


@query(f"""WITH {PLAYERS_SQL}, c AS (SELECT role, "Season", CAST(round(median(fifa_overall)) AS INTEGER) AS m FROM players GROUP BY ALL)
SELECT p.player, p.team, p."Season", c.m AS filled FROM players p JOIN c ON c.role = p.role AND c."Season" = p."Season" WHERE p.fifa_overall < c.m - 20""")
def below_pool_median(spark, sf_dir):
    base = players(spark, sf_dir)
    pool = base.groupBy("role", "Season").agg(F.round(F.median("fifa_overall")).cast("int").alias("filled"))
    return base.join(pool, BY).filter("fifa_overall < filled - 20").select(*KEY, "filled")


@query(f"""WITH {RATING_SQL}, s AS (SELECT player, team, "Season", row_number() OVER (PARTITION BY player ORDER BY {start_sql('"Season"')} DESC, minutes DESC, team) AS n, rating FROM player_rating) SELECT player, team, "Season", rating FROM s WHERE n = 1""")
def latest_ratings(spark, sf_dir):
    rated = rating.rated_players(rates(spark, sf_dir), ANCHORS)
    return ranking.latest(rated, ["player"], [F.desc(seasons.season_start(F.col("Season"))), F.desc("minutes"), F.asc("team")]).select(*KEY, "rating")


@query("""WITH v AS (SELECT vec_id, embedding FROM embeddings), s AS (SELECT vec_id AS subject, embedding AS e FROM v WHERE vec_id % 20 = 0),
d AS (SELECT subject, vec_id AS neighbour, round(sqrt(list_sum(list_transform(list_zip(e, embedding), lambda p: ((p[1] - p[2])::DOUBLE) * ((p[1] - p[2])::DOUBLE)))), 6) AS distance FROM s JOIN v ON vec_id <> subject),
r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY distance, neighbour) AS place FROM d) SELECT * FROM r WHERE place <= 10""")
def embedding_knn(spark, sf_dir):
    """The ten nearest of all vectors to every subject; the subjects are the ids divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return rounded(ranking.nearest_vectors(vectors.filter("vec_id % 20 = 0"), vectors, "vec_id", "embedding", 10, digits=6))
