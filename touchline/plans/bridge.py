"""Football-shaped views of the star schema, as DataFrames and as the same SQL.

An order with lines is a match: the customer's nation at home, the nation of its first supplier
away, goals and shots from its lines.  A part sold by a supplier in a season is a player-season.
All numbers are integers or hundredths of integers, so that both engines agree to the last bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions.seasons import season_label
from touchline.operators.sides import unpivot_sides


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("long")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with lines whose two nations differ."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nation = nation.select("n_nationkey", "n_name", "r_name")  # 25 rows by the schema
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_suppkey").alias("supplier"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.count(F.lit(1)).alias("lines"), F.sum(cents("l_extendedprice")).alias("price")
    )
    home = nation.select(F.col("n_nationkey").alias("hk"), F.col("n_name").alias("HomeTeam"), F.col("r_name").alias("League"))
    away = nation.select(F.col("n_nationkey").alias("ak"), F.col("n_name").alias("AwayTeam"), F.col("r_name").alias("away_league"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("Date"))
    rows = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("supplier") == F.col("s_suppkey"))
        .join(F.broadcast(home), F.col("c_nationkey") == F.col("hk"))
        .join(F.broadcast(away), F.col("s_nationkey") == F.col("ak"))
        .filter("HomeTeam <> AwayTeam")
    )
    return rows.select(
        F.col("o_orderkey").alias("match_id"),
        "League",
        "away_league",
        season_label(F.col("Date")).alias("Season"),
        "Date",
        "HomeTeam",
        "AwayTeam",
        (F.col("quantity") % 5).cast("int").alias("FTHG"),
        (F.col("lines") % 4).cast("int").alias("FTAG"),
        (F.col("quantity") % 17 + 4).cast("int").alias("HS"),
        (F.col("lines") * 3 % 13 + 3).cast("int").alias("AS"),
        (F.col("quantity") % 7).cast("int").alias("HST"),
        (F.col("lines") % 6).cast("int").alias("AST"),
        (F.col("price") % 311 / 100.0).alias("HxG"),
        (F.col("price") % 239 / 100.0).alias("AxG"),
    ).withColumn("FTR", F.when(F.col("FTHG") > F.col("FTAG"), "H").when(F.col("FTHG") < F.col("FTAG"), "A").when(F.col("FTHG") == F.col("FTAG"), "D"))


SIDES = {"GoalsFor": ("FTHG", "FTAG"), "GoalsAgainst": ("FTAG", "FTHG"), "ShotsFor": ("HS", "AS"), "ShotsAgainst": ("AS", "HS"), "ShotsOnTargetFor": ("HST", "AST"), "ShotsOnTargetAgainst": ("AST", "HST"), "xGFor": ("HxG", "AxG"), "xGAgainst": ("AxG", "HxG")}
KEYS = ["match_id", "League", "Season", "Date"]


def team_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows per match, seen from either side."""
    return unpivot_sides(matches(spark, sf_dir), KEYS, SIDES)


def first_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches within a league, the first of each ordered pair and season."""
    order = Window.partitionBy("League", "Season", "HomeTeam", "AwayTeam").orderBy("Date", "match_id")
    return matches(spark, sf_dir).filter("League = away_league").withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part, supplier and season, with counters and an edition's overall."""
    line = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", season_label(F.to_date("l_shipdate")).alias("Season"), F.col("l_quantity").cast("long").alias("q"), F.col("l_linenumber").cast("long").alias("n"), cents("l_extendedprice").alias("p"), cents("l_discount").alias("d"), cents("l_tax").alias("t")
    )
    rows = line.groupBy("l_partkey", "l_suppkey", "Season").agg(
        (F.sum("q") * 20).alias("minutes"), F.sum(F.col("q") % 6).alias("goals"), F.sum(F.col("p") % 23).alias("shots"), F.sum(F.col("n") * 7 + F.col("d")).alias("passes"), F.sum(F.col("t") + F.col("q") % 9).alias("tackles"), F.sum(F.col("d") % 3).alias("cards")
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", cents("p_retailprice").alias("retail"), "p_size")
    club = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        rows.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(club.select("s_suppkey", F.col("r_name").alias("League")), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("p_partkey").alias("player"),
            F.col("s_suppkey").alias("team"),
            "League",
            "Season",
            F.split("p_type", " ")[0].alias("role"),
            "minutes",
            (F.col("minutes") / 90.0).alias("nineties"),
            "goals",
            "shots",
            "passes",
            "tackles",
            "cards",
            (F.lit(40) + F.pmod(F.col("retail") + F.col("p_size") + F.substring("Season", 1, 2).cast("int") * 3, F.lit(55))).cast("int").alias("fifa_overall"),
            (F.lit(17) + F.pmod(F.col("p_partkey"), F.lit(18)) + F.pmod(F.substring("Season", 1, 2).cast("int"), F.lit(10))).cast("int").alias("age"),
        )
    )


SEASON_SQL = "lpad(CAST({y} % 100 AS VARCHAR), 2, '0') || lpad(CAST(({y} + 1) % 100 AS VARCHAR), 2, '0')"


def start_sql(label: str) -> str:
    """The year in which a season starts, from its label."""
    year = f"CAST(substr({label}, 1, 2) AS INTEGER)"
    return f"({year} + CASE WHEN {year} >= 50 THEN 1900 ELSE 2000 END)"


def season_sql(date: str) -> str:
    return SEASON_SQL.format(y=f"(year({date}) - CASE WHEN month({date}) >= 7 THEN 0 ELSE 1 END)")


MATCHES_SQL = f"""
lines AS (SELECT l_orderkey, min(l_suppkey) AS supplier, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, count(*) AS lines,
                 CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS price FROM lineitem GROUP BY l_orderkey),
nr AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
m0 AS (SELECT o_orderkey AS match_id, h.r_name AS "League", a.r_name AS away_league, {season_sql("CAST(o_orderdate AS DATE)")} AS "Season",
              CAST(o_orderdate AS DATE) AS "Date", h.n_name AS "HomeTeam", a.n_name AS "AwayTeam",
              CAST(quantity % 5 AS INTEGER) AS "FTHG", CAST(lines % 4 AS INTEGER) AS "FTAG", CAST(quantity % 17 + 4 AS INTEGER) AS "HS", CAST(lines * 3 % 13 + 3 AS INTEGER) AS "AS",
              CAST(quantity % 7 AS INTEGER) AS "HST", CAST(lines % 6 AS INTEGER) AS "AST", (price % 311) / 100.0::DOUBLE AS "HxG", (price % 239) / 100.0::DOUBLE AS "AxG"
       FROM lines JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON supplier = s_suppkey
       JOIN nr h ON c_nationkey = h.n_nationkey JOIN nr a ON s_nationkey = a.n_nationkey WHERE h.n_name <> a.n_name),
matches AS (SELECT *, CASE WHEN "FTHG" > "FTAG" THEN 'H' WHEN "FTHG" < "FTAG" THEN 'A' WHEN "FTHG" = "FTAG" THEN 'D' END AS "FTR" FROM m0)"""

_SIDE = """SELECT match_id, "League", "Season", "Date", "{t}" AS "Team", "{o}" AS "Opponent", '{v}' AS "Venue", {cols},
       CASE WHEN "{gf}" > "{ga}" THEN 'W' WHEN "{gf}" < "{ga}" THEN 'L' ELSE 'D' END AS "Result" FROM matches"""


def _side_sql(home: bool) -> str:
    i = 0 if home else 1
    columns = ", ".join(f'"{pair[i]}" AS "{name}"' for name, pair in SIDES.items())
    t, o = ("HomeTeam", "AwayTeam") if home else ("AwayTeam", "HomeTeam")
    return _SIDE.format(t=t, o=o, v="Home" if home else "Away", cols=columns, gf=SIDES["GoalsFor"][i], ga=SIDES["GoalsAgainst"][i])


TMH_SQL = f"{MATCHES_SQL},\ntmh AS ({_side_sql(True)} UNION ALL {_side_sql(False)})"

FIRST_SQL = f"""{MATCHES_SQL},
first_m AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY "League", "Season", "HomeTeam", "AwayTeam" ORDER BY "Date", match_id) AS n
            FROM matches WHERE "League" = away_league) WHERE n = 1)"""

PLAYERS_SQL = f"""
pl AS (SELECT l_partkey, l_suppkey, {season_sql("CAST(l_shipdate AS DATE)")} AS "Season", CAST(sum(CAST(l_quantity AS BIGINT)) * 20 AS BIGINT) AS minutes,
              CAST(sum(CAST(l_quantity AS BIGINT) % 6) AS BIGINT) AS goals, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) % 23) AS BIGINT) AS shots,
              CAST(sum(l_linenumber * 7 + CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS passes,
              CAST(sum(CAST(round(l_tax * 100) AS BIGINT) + CAST(l_quantity AS BIGINT) % 9) AS BIGINT) AS tackles, CAST(sum(CAST(round(l_discount * 100) AS BIGINT) % 3) AS BIGINT) AS cards
       FROM lineitem GROUP BY ALL),
players AS (SELECT p_partkey AS player, s_suppkey AS team, r_name AS "League", "Season", split_part(p_type, ' ', 1) AS role, minutes, minutes / 90.0::DOUBLE AS nineties,
                   goals, shots, passes, tackles, cards,
                   CAST(40 + (CAST(round(p_retailprice * 100) AS BIGINT) + p_size + CAST(substr("Season", 1, 2) AS INTEGER) * 3) % 55 AS INTEGER) AS fifa_overall,
                   CAST(17 + p_partkey % 18 + CAST(substr("Season", 1, 2) AS INTEGER) % 10 AS INTEGER) AS age
            FROM pl JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
