"""Queries over matches and team histories, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions import seasons
from touchline.operators import aggregates, joins, ranking, sides, windows
from touchline.plans.bridge import FIRST_SQL, MATCHES_SQL, TMH_SQL, first_meetings, matches, season_sql, start_sql, table, team_matches

ORDER = ["Date", "match_id"]
FORM = {"Points": "mean", "GoalsFor": "mean", "GoalsAgainst": "mean", "xGFor": "mean", "Win": "mean", "ShotAccuracy": "mean"}
QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Published doubles, rounded: sums of doubles depend on their order in the last bits.

    As in the SQL, a double is multiplied, rounded to a whole number and divided; Spark's own ``round`` takes
    the printed decimals, which fall to the other side where the product meets or misses an exact half, and
    takes them through decimals, which is slow on wide rows.  Halves go away from zero.
    """
    times = 10.0**digits

    def nearest(x: Column) -> Column:
        even = F.rint(x)  # differs for exact halves only
        return F.when(F.abs(x - even) == 0.5, x + F.signum(x) * 0.5).otherwise(even) + F.lit(0.0)

    whole = {c: nearest(F.col(c) * times) for c, t in df.dtypes if t == "double"}
    return df.select([F.when(F.abs(whole[c]) < float("inf"), whole[c] / times).otherwise(F.col(c)).alias(c) if c in whole else F.col(c) for c in df.columns])


PREPARED_SQL = f"""{TMH_SQL},
prep AS (SELECT *, CASE "Result" WHEN 'W' THEN 3.0::DOUBLE WHEN 'D' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "Points", CASE WHEN "Result" = 'W' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "Win",
                CASE WHEN "ShotsFor" > 0 THEN "ShotsOnTargetFor" / "ShotsFor"::DOUBLE END AS "ShotAccuracy" FROM tmh)"""


def _form_sql(keys: str, n: int, suffix: str) -> str:
    cols = ", ".join(f'avg("{m}") OVER w AS "{m}_{suffix}"' for m in FORM)
    return f'{cols}, count(*) OVER w AS matches_used_{suffix} FROM prep WINDOW w AS (PARTITION BY {keys} ORDER BY "Date", match_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)'


def _form(spark: SparkSession, sf_dir: str, keys: list[str], n: int, suffix: str) -> DataFrame:
    df = windows.with_form(sides.prepare(team_matches(spark, sf_dir)), keys, ORDER, n, FORM, suffix)
    return rounded(df.select("match_id", "Team", *[f"{m}_{suffix}" for m in FORM], f"matches_used_{suffix}"))


def _form_oracle(keys: str, n: int, suffix: str) -> str:
    cols = ", ".join(f'round("{m}_{suffix}", 6) AS "{m}_{suffix}"' for m in FORM)
    return f'WITH {PREPARED_SQL}, f AS (SELECT match_id, "Team", {_form_sql(keys, n, suffix)}) SELECT match_id, "Team", {cols}, matches_used_{suffix} FROM f'


@query(f"WITH {TMH_SQL} SELECT * FROM tmh")
def team_match_history(spark, sf_dir):
    return team_matches(spark, sf_dir)


@query(_form_oracle('"Team"', 5, "5"))
def form_last_5(spark, sf_dir):
    return _form(spark, sf_dir, ["Team"], 5, "5")


@query(_form_oracle('"Team"', 19, "19"))
def form_last_19(spark, sf_dir):
    return _form(spark, sf_dir, ["Team"], 19, "19")


@query(_form_oracle('"Team", "Venue"', 5, "venue_5"))
def form_last_5_venue(spark, sf_dir):
    return _form(spark, sf_dir, ["Team", "Venue"], 5, "venue_5")


@query(
    f"""WITH {PREPARED_SQL}, f AS (SELECT match_id, "League", "Season", "Date", "Team", "Venue", {_form_sql('"Team"', 5, "5")}),
h AS (SELECT * FROM f WHERE "Venue" = 'Home'), a AS (SELECT * FROM f WHERE "Venue" = 'Away')
SELECT h.match_id, h."League", h."Season", h."Date", h."Team" AS "HomeTeam", a."Team" AS "AwayTeam", round(h."Points_5" - a."Points_5", 6) AS "Points_5_diff",
       round(h."GoalsFor_5" - a."GoalsFor_5", 6) AS "GoalsFor_5_diff", round(h."GoalsAgainst_5" - a."GoalsAgainst_5", 6) AS "GoalsAgainst_5_diff", round(h."xGFor_5" - a."xGFor_5", 6) AS "xGFor_5_diff"
FROM h JOIN a ON h.match_id = a.match_id"""
)
def match_form_diff(spark, sf_dir):
    """The flagship: pre-match form difference of every match."""
    long = windows.with_form(sides.prepare(team_matches(spark, sf_dir)), ["Team"], ORDER, 5, FORM, "5")
    stems = ["Points_5", "GoalsFor_5", "GoalsAgainst_5", "xGFor_5"]
    wide = sides.with_diffs(sides.repivot(long, ["match_id"], stems, ["League", "Season", "Date"]), stems)
    return rounded(wide.select("match_id", "League", "Season", "Date", "HomeTeam", "AwayTeam", *[f"{s}_diff" for s in stems]))


@query(
    """SELECT event_id, user_id, round(sum(value) OVER w, 4) AS value_sum, count(*) OVER w AS used FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"""
)
def event_prev_window(spark, sf_dir):
    w = windows.prev_window(["user_id"], ["ts", "event_id"], 5)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.round(F.sum("value").over(w), 4).alias("value_sum"), F.count(F.lit(1)).over(w).alias("used"))


@query(f"""WITH {TMH_SQL} SELECT match_id, "Team", CAST("Date" - lag("Date") OVER (PARTITION BY "Team" ORDER BY "Date", match_id) AS INTEGER) AS rest_days FROM tmh""")
def rest_days(spark, sf_dir):
    return team_matches(spark, sf_dir).select("match_id", "Team", windows.days_since_last(["Team"], "Date", ORDER).alias("rest_days"))


@query(f"""WITH {TMH_SQL} SELECT match_id, "Team", count(*) OVER (PARTITION BY "Team" ORDER BY "Date" RANGE BETWEEN INTERVAL 14 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING) AS congestion FROM tmh""")
def congestion_14d(spark, sf_dir):
    return team_matches(spark, sf_dir).select("match_id", "Team", windows.trailing_count(["Team"], "Date", 14).alias("congestion"))


LEAGUE_SQL = f"""WITH {TMH_SQL}, t AS (SELECT "League", "Season", "Team", count(*) AS played, sum(CASE "Result" WHEN 'W' THEN 3 WHEN 'D' THEN 1 ELSE 0 END)::BIGINT AS points,
    sum("GoalsFor")::BIGINT AS gf, sum("GoalsAgainst")::BIGINT AS ga FROM tmh GROUP BY ALL)
SELECT *, gf - ga AS gd, row_number() OVER (PARTITION BY "League", "Season" ORDER BY points DESC, gf - ga DESC, gf DESC, "Team") AS place FROM t"""


@query(LEAGUE_SQL)
def league_table(spark, sf_dir):
    return aggregates.league_table(team_matches(spark, sf_dir), ["League", "Season"])


OUTCOMES_SQL = """out AS (SELECT "League", "Season", "Team", count(*) AS played, sum(CASE "Result" WHEN 'W' THEN 3 WHEN 'D' THEN 1 ELSE 0 END)::BIGINT AS pts,
    avg("GoalsFor") AS gf, avg("GoalsAgainst") AS ga FROM tmh GROUP BY ALL HAVING count(*) >= 20)"""


@query(f'WITH {TMH_SQL}, {OUTCOMES_SQL} SELECT "League", "Season", "Team", played, pts, round(gf, 6) AS gf, round(ga, 6) AS ga FROM out')
def season_outcomes(spark, sf_dir):
    return rounded(aggregates.season_outcomes(team_matches(spark, sf_dir)))


@query(f"""WITH {TMH_SQL} SELECT "Season", "Team", round(avg("GoalsAgainst"), 6) AS mean_against, round(avg(CASE WHEN "GoalsAgainst" = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS clean_sheets,
round(avg("xGAgainst"), 6) AS mean_xg_against FROM tmh GROUP BY ALL""")
def team_defence(spark, sf_dir):
    rows = team_matches(spark, sf_dir).groupBy("Season", "Team")
    return rounded(rows.agg(F.avg("GoalsAgainst").alias("mean_against"), F.avg(F.when(F.col("GoalsAgainst") == 0, 1.0).otherwise(0.0)).alias("clean_sheets"), F.avg("xGAgainst").alias("mean_xg_against")))


@query(f"""WITH {FIRST_SQL}, x AS (SELECT "League", "Season", "HomeTeam", "AwayTeam", "Date" + CAST(match_id % 3 AS INTEGER) AS xg_date, "HxG" AS xg FROM first_m WHERE match_id % 4 <> 0)
SELECT match_id, first_m."HomeTeam", first_m."AwayTeam", xg, coalesce(xg_date - "Date" > 1, false) AS drifted FROM first_m LEFT JOIN x USING ("League", "Season", "HomeTeam", "AwayTeam")""")
def xg_merge(spark, sf_dir):
    """A second source joined one to one, with a flag where its date is off by more than a day."""
    base = first_meetings(spark, sf_dir)
    key = ["League", "Season", "HomeTeam", "AwayTeam"]
    xg = base.filter("match_id % 4 <> 0").select(*key, F.date_add("Date", (F.col("match_id") % 3).cast("int")).alias("xg_date"), F.col("HxG").alias("xg"))
    joined = joins.checked_join(base, xg, key, "left", "1:1")
    return joined.select("match_id", "HomeTeam", "AwayTeam", "xg", F.coalesce(F.datediff("xg_date", "Date") > 1, F.lit(False)).alias("drifted"))


@query(f"""WITH {FIRST_SQL}, known AS (SELECT "League", "Date", "HomeTeam", "AwayTeam" FROM first_m WHERE match_id % 2 = 0)
SELECT match_id, "League", "Date", "HomeTeam", "AwayTeam" FROM first_m f WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k."League" = f."League" AND k."Date" = f."Date" AND k."HomeTeam" = f."HomeTeam" AND k."AwayTeam" = f."AwayTeam")""")
def fixtures_not_played(spark, sf_dir):
    base = first_meetings(spark, sf_dir)
    key = ["League", "Date", "HomeTeam", "AwayTeam"]
    return base.join(base.filter("match_id % 2 = 0").select(key), key, "left_anti").select("match_id", *key)


@query(f"""WITH {MATCHES_SQL}, base AS (SELECT match_id, "Season", "FTHG" FROM matches WHERE match_id % 3 <> 0), extra AS (SELECT match_id, "Season", "FTHG" + 100 AS "FTHG" FROM matches WHERE match_id % 3 = 0 OR match_id % 5 = 0)
SELECT * FROM base UNION ALL SELECT * FROM extra WHERE match_id NOT IN (SELECT match_id FROM base)""")
def results_top_up(spark, sf_dir):
    base = matches(spark, sf_dir).select("match_id", "Season", "FTHG")
    extra = base.filter("match_id % 3 = 0 or match_id % 5 = 0").withColumn("FTHG", F.col("FTHG") + 100)
    return joins.anti_append(base.filter("match_id % 3 <> 0"), extra, ["match_id"])


@query(f"""WITH {FIRST_SQL}, t AS (SELECT DISTINCT "League", "Season", unnest(["HomeTeam", "AwayTeam"]) AS team FROM first_m)
SELECT a."League", a."Season", a.team AS "HomeTeam", b.team AS "AwayTeam" FROM t a JOIN t b ON a."League" = b."League" AND a."Season" = b."Season" AND a.team <> b.team
WHERE NOT EXISTS (SELECT 1 FROM first_m m WHERE m."League" = a."League" AND m."Season" = a."Season" AND m."HomeTeam" = a.team AND m."AwayTeam" = b.team)""")
def remaining_fixtures(spark, sf_dir):
    return joins.round_robin_left(first_meetings(spark, sf_dir), ["League", "Season"]).select("League", "Season", "HomeTeam", "AwayTeam")


@query(f"""WITH {MATCHES_SQL}, u AS (SELECT *, count(*) OVER (PARTITION BY "Date", "League", "FTHG", "FTAG") AS c FROM matches),
o0 AS (SELECT "Date", "League", "FTHG", "FTAG", 'FC ' || lower("HomeTeam") AS theirs FROM matches WHERE match_id % 3 <> 1), o AS (SELECT *, count(*) OVER (PARTITION BY "Date", "League", "FTHG", "FTAG") AS c FROM o0)
SELECT u."HomeTeam" AS ours, theirs, count(*) AS votes FROM u JOIN o ON u."Date" = o."Date" AND u."League" = o."League" AND u."FTHG" = o."FTHG" AND u."FTAG" = o."FTAG" WHERE u.c = 1 AND o.c = 1 GROUP BY ALL HAVING count(*) >= 4""")
def alias_votes(spark, sf_dir):
    """Two sources paired on keys that are unique on either side, then votes with an evidence bar."""
    key = ["Date", "League", "FTHG", "FTAG"]
    ours = joins.unique_keys(matches(spark, sf_dir), key)
    second = matches(spark, sf_dir).filter("match_id % 3 <> 1").select(*key, F.concat(F.lit("FC "), F.lower("HomeTeam")).alias("theirs"))  # an incomplete source with names of its own
    theirs = joins.unique_keys(second, key)
    return ours.join(theirs, key).groupBy(F.col("HomeTeam").alias("ours"), "theirs").agg(F.count(F.lit(1)).alias("votes")).filter("votes >= 4")


@query(f"""WITH {TMH_SQL}, f AS (SELECT match_id AS fixture, "Date" AS on_date, "HomeTeam" FROM matches),
r AS (SELECT fixture, t.match_id, t."Result", row_number() OVER (PARTITION BY fixture ORDER BY t."Date" DESC, t.match_id DESC) AS place FROM f JOIN tmh t ON t."Team" = f."HomeTeam" AND t."Date" < f.on_date)
SELECT fixture, match_id, "Result", place FROM r WHERE place <= 5""")
def asof_recent_form(spark, sf_dir):
    """The five latest results of the home team strictly before every fixture."""
    fixtures = matches(spark, sf_dir).select(F.col("match_id").alias("fixture"), F.col("Date").alias("on_date"), F.col("HomeTeam").alias("Team"))
    history = team_matches(spark, sf_dir).select("match_id", "Team", "Date", "Result")
    found = joins.asof_top_n(fixtures, history, ["Team"], "on_date", "Date", ["match_id"], 5)
    return found.select("fixture", "match_id", "Result", F.col("_n").alias("place"))


@query(f"""WITH {MATCHES_SQL}, s AS (SELECT "League" AS a, away_league AS b, "FTHG" AS x, "FTAG" AS y FROM matches WHERE "League" <> away_league UNION ALL SELECT away_league, "League", "FTAG", "FTHG" FROM matches WHERE "League" <> away_league)
SELECT a AS league, b AS opponent, count(*) AS ties, sum(CASE WHEN x > y THEN 1 ELSE 0 END)::BIGINT AS won, sum(CASE WHEN x = y THEN 1 ELSE 0 END)::BIGINT AS drawn, sum(x - y)::BIGINT AS goal_difference FROM s GROUP BY ALL""")
def head_to_head(spark, sf_dir):
    """Record of every league against every other, from both orientations."""
    ties = matches(spark, sf_dir).filter("League <> away_league")
    both = sides.unpivot_sides(ties, ["match_id"], {"GoalsFor": ("FTHG", "FTAG"), "GoalsAgainst": ("FTAG", "FTHG")}, "League", "away_league")
    return both.groupBy(F.col("Team").alias("league"), F.col("Opponent").alias("opponent")).agg(
        F.count(F.lit(1)).alias("ties"), F.sum((F.col("Result") == "W").cast("int")).alias("won"), F.sum((F.col("Result") == "D").cast("int")).alias("drawn"), F.sum(F.col("GoalsFor") - F.col("GoalsAgainst")).alias("goal_difference")
    )


@query(f"""WITH {MATCHES_SQL}, known AS (SELECT DISTINCT "HomeTeam" AS team, "League" FROM matches WHERE "Season" = '9697' AND "League" IN ('EUROPE', 'ASIA'))
SELECT match_id, h.team IS NOT NULL AND a.team IS NOT NULL AS kept, CASE WHEN h.team IS NULL AND a.team IS NULL THEN 'both' WHEN h.team IS NULL THEN 'home' WHEN a.team IS NULL THEN 'away' END AS missing
FROM matches m LEFT JOIN known h ON h.team = m."HomeTeam" LEFT JOIN known a ON a.team = m."AwayTeam" """)
def leagues_only(spark, sf_dir):
    """Ties whose two clubs are in a covered league; the others with the reason."""
    base = matches(spark, sf_dir)
    known = base.filter("Season = '9697' and League in ('EUROPE', 'ASIA')").select(F.col("HomeTeam").alias("team")).distinct()
    home, away = known.withColumnRenamed("team", "h"), known.withColumnRenamed("team", "a")
    joined = base.join(home, F.col("HomeTeam") == F.col("h"), "left").join(away, F.col("AwayTeam") == F.col("a"), "left")
    missing = F.when(F.col("h").isNull() & F.col("a").isNull(), "both").when(F.col("h").isNull(), "home").when(F.col("a").isNull(), "away")
    return joined.select("match_id", (F.col("h").isNotNull() & F.col("a").isNotNull()).alias("kept"), missing.alias("missing"))


@query(f"""WITH {TMH_SQL}, r AS (SELECT "Team", CASE "Result" WHEN 'W' THEN 3 WHEN 'D' THEN 1 ELSE 0 END AS pts, row_number() OVER (PARTITION BY "League", "Season", "Team" ORDER BY "Date" DESC, match_id DESC) AS n, "League", "Season" FROM tmh)
SELECT "League", "Season", "Team", sum(CASE WHEN n <= 5 THEN pts END)::BIGINT AS pts_last_5, sum(pts)::BIGINT AS pts_total, count(*) AS played FROM r GROUP BY ALL""")
def season_form(spark, sf_dir):
    points = F.when(F.col("Result") == "W", 3).when(F.col("Result") == "D", 1).otherwise(0)
    return windows.recent_and_total(team_matches(spark, sf_dir).withColumn("pts", points), ["League", "Season", "Team"], [F.desc("Date"), F.desc("match_id")], 5, "pts")


@query(f"""WITH {MATCHES_SQL} SELECT match_id, "Season", CASE WHEN "League" = away_league THEN 'domestic' ELSE 'cross' END AS competition,
 CASE "League" WHEN 'AFRICA' THEN 0 WHEN 'AMERICA' THEN 1 WHEN 'ASIA' THEN 2 WHEN 'EUROPE' THEN 3 ELSE 4 END AS league_code FROM matches WHERE "Date" BETWEEN DATE '1997-03-01' AND DATE '1997-03-08'""")
def fixture_window(spark, sf_dir):
    """Unplayed fixtures up to a horizon, with the league's fixed code."""
    codes = F.create_map(*[F.lit(x) for pair in zip(("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"), range(5), strict=True) for x in pair])
    rows = matches(spark, sf_dir).filter(F.col("Date").between(F.lit("1997-03-01").cast("date"), F.date_add(F.lit("1997-03-01").cast("date"), 7)))
    return rows.select("match_id", "Season", F.when(F.col("League") == F.col("away_league"), "domestic").otherwise("cross").alias("competition"), codes[F.col("League")].alias("league_code"))


@query(f"""WITH {MATCHES_SQL}, p AS (SELECT match_id, "Date", v AS version, CAST("Date" AS TIMESTAMP) + INTERVAL (match_id % 5 - 3 + v) DAY AS predicted_at, (match_id % 7 + v) / 10.0::DOUBLE AS prob, "FTR" FROM matches, (VALUES (0), (1), (2)) t(v)),
b AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY predicted_at DESC, version DESC) AS n FROM p WHERE predicted_at < "Date")
SELECT match_id, version, prob, "FTR" AS actual FROM b WHERE n = 1""")
def last_before_kickoff(spark, sf_dir):
    """Of several forecasts of a match, the last one made before its day, settled with the result."""
    base = matches(spark, sf_dir).select("match_id", "Date", "FTR", F.explode(F.array(*[F.lit(v) for v in range(3)])).alias("version"))
    made = base.withColumn("predicted_at", F.expr("cast(Date as timestamp) + make_dt_interval(cast(match_id % 5 - 3 + version as int))")).withColumn("prob", (F.col("match_id") % 7 + F.col("version")) / 10.0)
    best = ranking.latest(made.filter("predicted_at < cast(Date as timestamp)"), ["match_id"], [F.desc("predicted_at"), F.desc("version")])
    return best.select("match_id", "version", "prob", F.col("FTR").alias("actual"))


@query(f"""WITH {TMH_SQL}, past AS (SELECT *, row_number() OVER (PARTITION BY "Team" ORDER BY "Date" DESC, match_id DESC) AS n FROM tmh WHERE "Date" < DATE '2001-01-01'),
form AS (SELECT "Team", max("Date") AS last_played, avg("GoalsFor") AS gf, avg("GoalsAgainst") AS ga, count(*) AS used FROM past WHERE n <= 5 GROUP BY ALL)
SELECT f.match_id, f."Team", last_played, round(gf, 6) AS "GoalsFor_5", round(ga, 6) AS "GoalsAgainst_5", used AS matches_used_5 FROM tmh f LEFT JOIN form USING ("Team") WHERE f."Date" >= DATE '2001-01-01' """)
def upcoming_form(spark, sf_dir):
    """Both teams' form before every fixture from a day on, frozen at the last match played before that day."""
    rows, day = team_matches(spark, sf_dir), F.lit("2001-01-01").cast("date")
    upcoming = rows.filter(F.col("Date") >= day).select("match_id", "Team", F.col("Date").alias("on_date"))
    history = rows.filter(F.col("Date") < day).withColumnRenamed("match_id", "played")
    found = windows.frozen_form(upcoming, history, "Team", "on_date", "Date", ["played"], 5, ["GoalsFor", "GoalsAgainst"], "5")
    return rounded(found.select("match_id", "Team", F.col("asof_Date").alias("last_played"), "GoalsFor_5", "GoalsAgainst_5", "matches_used_5"))


@query(f"""WITH {TMH_SQL}, s AS (SELECT "Season", "Team", avg("GoalsFor" - "GoalsAgainst") AS strength FROM tmh GROUP BY ALL),
n AS (SELECT lpad(CAST((CAST(substr("Season", 1, 2) AS INTEGER) + 1) % 100 AS VARCHAR), 2, '0') || lpad(CAST((CAST(substr("Season", 1, 2) AS INTEGER) + 2) % 100 AS VARCHAR), 2, '0') AS for_season, "Team", strength FROM s)
SELECT match_id, round(h.strength, 6) AS home_strength, round(a.strength, 6) AS away_strength FROM matches m LEFT JOIN n h ON h.for_season = m."Season" AND h."Team" = m."HomeTeam" LEFT JOIN n a ON a.for_season = m."Season" AND a."Team" = m."AwayTeam" """)
def season_shifted_strength(spark, sf_dir):
    """Last season's strength on this season's matches, both sides; never the season's own."""
    strength = team_matches(spark, sf_dir).groupBy("Season", "Team").agg(F.avg(F.col("GoalsFor") - F.col("GoalsAgainst")).alias("strength")).select(seasons.next_season(F.col("Season")).alias("for_season"), "Team", "strength")
    base = matches(spark, sf_dir).select("match_id", "Season", "HomeTeam", "AwayTeam")
    for team, name in (("HomeTeam", "home_strength"), ("AwayTeam", "away_strength")):
        other = strength.select(F.col("for_season").alias("Season"), F.col("Team").alias(team), F.col("strength").alias(name))
        base = joins.checked_join(base, other, ["Season", team], "left", "m:1")
    return rounded(base.select("match_id", "home_strength", "away_strength"))


@query(f"""WITH {TMH_SQL}, s AS (SELECT "Season", "Team", {start_sql('"Season"')} AS y, avg("GoalsFor" - "GoalsAgainst") AS strength, count(*) AS n FROM tmh GROUP BY ALL),
o AS (SELECT "Team", y, avg(strength) AS earlier FROM (SELECT a."Team", a.y, b.strength FROM s a JOIN s b ON b."Team" = a."Team" AND b.y = a.y - 2) GROUP BY ALL)
SELECT t."Team", t."Season", round(CASE WHEN m."Team" IS NOT NULL THEN m.strength ELSE o.earlier END, 6) AS strength, m."Team" IS NULL AND o."Team" IS NOT NULL AS strength_is_preseason
FROM s t LEFT JOIN s m ON m."Team" = t."Team" AND m.y = t.y - 1 AND m.n % 3 <> 0 LEFT JOIN o ON o."Team" = t."Team" AND o.y = t.y""")
def strength_with_fallback(spark, sf_dir):
    """Last season's strength where it was measured, else a pre-season one (of the season before that), with a flag."""
    start = seasons.season_start(F.col("Season")).alias("y")
    s = team_matches(spark, sf_dir).groupBy("Season", "Team", start).agg(F.avg(F.col("GoalsFor") - F.col("GoalsAgainst")).alias("strength"), F.count(F.lit(1)).alias("n"))
    measured = s.filter("n % 3 <> 0").select("Team", (F.col("y") + 1).alias("y"), "strength")  # as if some clubs had not been measured
    preseason = s.select("Team", (F.col("y") + 2).alias("y"), "strength")
    found = joins.with_fallback(s.select("Team", "Season", "y"), measured, preseason, ["Team", "y"], ["strength"], "strength_is_preseason")
    return rounded(found.select("Team", "Season", "strength", "strength_is_preseason"))


@query(f"""WITH {TMH_SQL}, {OUTCOMES_SQL}, x AS (SELECT o.*, round(p.ga * 10) AS strength FROM out o JOIN out p ON p."League" = o."League" AND p."Team" = o."Team" AND {start_sql('p."Season"')} + 1 = {start_sql('o."Season"')}),
l AS (SELECT "League", "Season", regr_slope(pts, strength) AS slope, regr_intercept(pts, strength) AS intercept FROM x GROUP BY ALL)
SELECT "League", "Season", "Team", round(intercept + slope * strength, 7) AS expected, round(pts - (intercept + slope * strength), 7) AS residual FROM x JOIN l USING ("League", "Season") WHERE slope IS NOT NULL AND NOT isnan(slope)""")
def achievement_residuals(spark, sf_dir):
    """Points against what a club's strength in the season before predicts, least squares per league and season."""
    rows = aggregates.season_outcomes(team_matches(spark, sf_dir))
    before = rows.select("League", "Team", seasons.next_season(F.col("Season")).alias("Season"), F.round(F.col("ga") * 10).alias("strength"))
    fitted = aggregates.regress_by(rows.join(before, ["League", "Team", "Season"]), ["League", "Season"], "pts", "strength").filter("slope is not null and not isnan(slope)")
    return rounded(fitted.select("League", "Season", "Team", "expected", "residual"), 7)


@query(f"""WITH {TMH_SQL}, {OUTCOMES_SQL}, n AS (SELECT "Team", CAST(substr("Season", 1, 2) AS INTEGER) AS y, pts, ga FROM out)
SELECT round(corr(b.pts, a.pts), 6) AS points_r, round(corr(b.ga, a.ga), 6) AS against_r, count(*) AS pairs FROM n a JOIN n b ON a."Team" = b."Team" AND b.y = (a.y + 1) % 100""")
def next_season_validity(spark, sf_dir):
    """How well a season's numbers predict the same club's next season."""
    rows = aggregates.season_outcomes(team_matches(spark, sf_dir))
    later = rows.select("Team", seasons.previous_season(F.col("Season")).alias("Season"), F.col("pts").alias("later_pts"), F.col("ga").alias("later_ga"))
    return rounded(rows.join(later, ["Team", "Season"]).agg(F.corr("later_pts", "pts").alias("points_r"), F.corr("later_ga", "ga").alias("against_r"), F.count(F.lit(1)).alias("pairs")))


@query(f"""WITH {TMH_SQL}, {OUTCOMES_SQL} SELECT "League", "Season", round(avg(pts), 6) AS mean, median(pts)::DOUBLE AS median, round(coalesce(stddev_pop(pts), 0), 6) AS spread, arg_max("Team", struct_pack(p := pts, t := "Team")) AS strongest, arg_min("Team", struct_pack(p := pts, t := "Team")) AS weakest, count(*) AS clubs FROM out GROUP BY ALL""")
def league_strength_summary(spark, sf_dir):
    rows = aggregates.season_outcomes(team_matches(spark, sf_dir)).groupBy("League", "Season")
    return rounded(
        rows.agg(
            F.avg("pts").alias("mean"), F.median("pts").alias("median"), F.stddev_pop("pts").alias("spread"), F.max_by("Team", F.struct("pts", "Team")).alias("strongest"), F.min_by("Team", F.struct("pts", "Team")).alias("weakest"), F.count(F.lit(1)).alias("clubs")
        )
    )


@query(f"""WITH {TMH_SQL}, t AS (SELECT "Season", "Team", count(*) AS measured FROM tmh WHERE "Venue" = 'Home' AND match_id % 3 <> 0 GROUP BY ALL HAVING count(*) > 60), p AS (SELECT "Season", "Team", count(*) AS projected FROM tmh WHERE "Venue" = 'Away' GROUP BY ALL HAVING count(*) > 70)
SELECT coalesce(t."Season", p."Season") AS "Season", coalesce(t."Team", p."Team") AS "Team", measured, projected FROM t FULL JOIN p ON t."Season" = p."Season" AND t."Team" = p."Team" """)
def team_rows_full_outer(spark, sf_dir):
    tmh = team_matches(spark, sf_dir)
    measured = tmh.filter("Venue = 'Home' and match_id % 3 <> 0").groupBy("Season", "Team").agg(F.count(F.lit(1)).alias("measured")).filter("measured > 60")
    projected = tmh.filter("Venue = 'Away'").groupBy("Season", "Team").agg(F.count(F.lit(1)).alias("projected")).filter("projected > 70")
    return measured.join(projected, ["Season", "Team"], "full")


@query(f"""WITH {MATCHES_SQL}, b AS (SELECT match_id, "Season", "FTHG" AS base, "FTHG" + CASE WHEN match_id % 10 = 0 THEN 1 ELSE 0 END AS arm FROM matches)
SELECT "Season", count(*) AS n, round(avg(arm - base), 6) AS delta, sum(CASE WHEN arm <> base THEN 1 ELSE 0 END)::BIGINT AS moved FROM b GROUP BY ALL HAVING sum(CASE WHEN arm <> base THEN 1 ELSE 0 END) > 0""")
def per_season_deltas(spark, sf_dir):
    """A variant against its baseline by season, without the seasons in which nothing moves."""
    b = matches(spark, sf_dir).select("Season", F.col("FTHG").alias("base"), (F.col("FTHG") + F.when(F.col("match_id") % 10 == 0, 1).otherwise(0)).alias("arm"))
    return rounded(b.groupBy("Season").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("arm") - F.col("base")).alias("delta"), F.sum((F.col("arm") != F.col("base")).cast("int")).alias("moved")).filter("moved > 0"))


@query(f"""WITH {MATCHES_SQL} SELECT match_id, "Date", "HomeTeam" FROM matches ORDER BY "Date" DESC, match_id LIMIT 50 OFFSET 100""")
def matches_page(spark, sf_dir):
    return ranking.page(matches(spark, sf_dir).select("match_id", "Date", "HomeTeam"), [F.desc("Date"), F.asc("match_id")], 100, 50)


@query(f"""WITH {MATCHES_SQL} SELECT "League", "Season", count(*) AS n, round(avg("FTHG"), 6) AS home_goals FROM matches GROUP BY GROUPING SETS ((), ("League"), ("League", "Season"))""")
def grouped_goals(spark, sf_dir):
    """Metrics overall, by league, and by league and season, in one pass."""
    return rounded(matches(spark, sf_dir).rollup("League", "Season").agg(F.count(F.lit(1)).alias("n"), F.avg("FTHG").alias("home_goals")))


@query(f"""WITH {TMH_SQL}, r AS (SELECT "Team", max("Date") AS latest, arg_max("Season", struct_pack(d := "Date", m := match_id)) AS season FROM tmh GROUP BY ALL) SELECT * FROM r""")
def latest_season_of_team(spark, sf_dir):
    return team_matches(spark, sf_dir).groupBy("Team").agg(F.max("Date").alias("latest"), F.max_by("Season", F.struct("Date", "match_id")).alias("season"))


@query(f"""SELECT c AS "Season", count(*) AS orders FROM (SELECT {season_sql("CAST(o_orderdate AS DATE)")} AS c FROM orders) GROUP BY ALL""")
def orders_by_season(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(seasons.season_label(F.to_date("o_orderdate")).alias("Season")).agg(F.count(F.lit(1)).alias("orders"))
