"""Queries over the whole table of pre-match features, with SQL written out from the same lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators import match_features as mf
from touchline.plans.bridge import TMH_SQL, matches, team_matches
from touchline.plans.match_queries import rounded

QUERIES, ORACLE_SQL = {}, {}
DAY = "2001-01-01"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def history(spark, sf_dir) -> DataFrame:
    """Team matches with stand-ins for the measures that the tables lack."""
    return team_matches(spark, sf_dir).withColumns({"npxGFor": F.col("xGFor") * 0.75, "npxGAgainst": F.col("xGAgainst") * 0.75, "PPDAFor": F.col("ShotsAgainst") + 2.5, "DeepCompletionsFor": F.col("ShotsOnTargetFor") + 1.0})


VALUES_SQL = f"""{TMH_SQL},
v AS (SELECT *, CASE "Result" WHEN 'W' THEN 3.0::DOUBLE WHEN 'D' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "Points", ("Result" = 'W')::INT::DOUBLE AS "Win", ("Result" = 'D')::INT::DOUBLE AS "Draw", ("Result" = 'L')::INT::DOUBLE AS "Loss",
             "GoalsFor" - "GoalsAgainst" AS "GoalDiff", CASE WHEN "ShotsFor" > 0 THEN "ShotsOnTargetFor" / "ShotsFor"::DOUBLE END AS "ShotAccuracy", "xGFor" - "xGAgainst" AS "xGDiff", "GoalsFor" - "xGFor" AS "xGOver",
             CASE WHEN "ShotsFor" > 0 THEN "xGFor" / "ShotsFor" END AS "xGPerShot", "xGFor" * 0.75::DOUBLE AS "npxGFor", "xGAgainst" * 0.75::DOUBLE AS "npxGAgainst", "xGFor" * 0.75::DOUBLE - "xGAgainst" * 0.75::DOUBLE AS "npxGDiff",
             "ShotsAgainst" + 2.5::DOUBLE AS "PPDAFor", "ShotsOnTargetFor" + 1.0::DOUBLE AS "DeepCompletionsFor" FROM tmh)"""
_AGG = {"mean": "avg", "sum": "sum"}


def _wide_sql(key: str, names: list[str], source: str) -> str:
    picked = [f"max(CASE WHEN \"Venue\" = '{venue}' THEN {n} END) AS {prefix}_{n}" for venue, prefix in (("Home", "home"), ("Away", "away")) for n in names]
    teams = ["max(CASE WHEN \"Venue\" = 'Home' THEN \"Team\" END) AS \"HomeTeam\"", "max(CASE WHEN \"Venue\" = 'Away' THEN \"Team\" END) AS \"AwayTeam\""]
    return f"SELECT {key}, {', '.join(teams + picked)} FROM {source} GROUP BY {key}"


def _published_sql(names: list[str], whole: set[str]) -> str:
    sides = [f"{p}_{n}" if n in whole else f"round({p}_{n}, 6) AS {p}_{n}" for p in ("home", "away") for n in names]
    return ", ".join(sides + [f"home_{s} - away_{s} AS {s}_diff" if s in whole else f"round(home_{s} - away_{s}, 6) AS {s}_diff" for s in mf.diff_stems(names)])


COUNTS = {"days_since_last_match", "matches_last_14_days", *[f"matches_used_{s}" for _, _, s in mf.groupings()]}
NAMES = [f"{name}_{suffix}" for _, _, suffix in mf.groupings() for name in [n for _, n in mf.FORM.values()] + ["matches_used"]] + ["days_since_last_match", "matches_last_14_days"]


def _played_sql() -> str:
    columns = []
    for keys, w, suffix in mf.groupings():
        over = f"OVER (PARTITION BY {', '.join(chr(34) + k + chr(34) for k in keys)} ORDER BY \"Date\", match_id ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
        columns += [f'{_AGG[agg]}(CAST("{m}" AS DOUBLE)) {over} AS {name}_{suffix}' for m, (agg, name) in mf.FORM.items()] + [f'count("Points") {over} AS matches_used_{suffix}']
    columns.append('date_diff(\'day\', lag("Date") OVER (PARTITION BY "Team" ORDER BY "Date", match_id), "Date") AS days_since_last_match')
    columns.append('count(*) OVER (PARTITION BY "Team" ORDER BY "Date" RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS matches_last_14_days')
    key = 'match_id, "League", "Season", "Date"'
    return f"""WITH {VALUES_SQL}, f AS (SELECT *, {', '.join(columns)} FROM v), w AS ({_wide_sql(key, NAMES, 'f')})
SELECT {key}, "HomeTeam", "AwayTeam", {_published_sql(NAMES, COUNTS)} FROM w"""


def _upcoming_sql() -> str:
    parts, joins = [], []
    for i, (keys, w, suffix) in enumerate(mf.groupings()):
        names = ", ".join(f'"{k}"' for k in keys)
        values = [f'{_AGG[agg]}(CAST("{m}" AS DOUBLE)) AS {name}_{suffix}' for m, (agg, name) in mf.FORM.items()]
        parts.append(f'p{i} AS (SELECT {names}, {", ".join(values)}, count("Points") AS used FROM (SELECT *, row_number() OVER (PARTITION BY {names} ORDER BY "Date" DESC, match_id DESC) AS n FROM past) WHERE n <= {w} GROUP BY {names})')
        joins.append(f"LEFT JOIN p{i} ON " + " AND ".join(f's."{k}" = p{i}."{k}"' for k in keys))
    columns = [f"p{i}.{name}_{suffix}" for i, (_, _, suffix) in enumerate(mf.groupings()) for _, name in mf.FORM.values()] + [f"coalesce(p{i}.used, 0) AS matches_used_{s}" for i, (_, _, s) in enumerate(mf.groupings())]
    key = '"League", "Season", "Date"'
    group = f'{key}, h, a'
    return f"""WITH {VALUES_SQL}, past AS (SELECT * FROM v WHERE "Date" < DATE '{DAY}'), {', '.join(parts)},
last AS (SELECT "Team", max("Date") AS last_date FROM past GROUP BY ALL),
fx AS (SELECT DISTINCT "League", min("Season") AS "Season", "Date", "HomeTeam" AS h, "AwayTeam" AS a FROM matches WHERE "Date" >= DATE '{DAY}' GROUP BY ALL),
s AS (SELECT *, h AS "Team", 'Home' AS "Venue" FROM fx UNION ALL SELECT *, a, 'Away' FROM fx),
c AS (SELECT h, a, s."League", s."Date", s."Venue", count(past."Date") AS n FROM s LEFT JOIN past ON past."Team" = s."Team" AND past."Date" BETWEEN s."Date" - INTERVAL 14 DAY AND s."Date" - INTERVAL 1 DAY GROUP BY ALL),
f AS (SELECT s.*, {', '.join(columns)}, date_diff('day', last_date, s."Date") AS days_since_last_match, c.n AS matches_last_14_days FROM s {' '.join(joins)} LEFT JOIN last ON last."Team" = s."Team"
      JOIN c ON c.h = s.h AND c.a = s.a AND c."League" = s."League" AND c."Date" = s."Date" AND c."Venue" = s."Venue"),
w AS ({_wide_sql(group, NAMES, 'f')})
SELECT {key}, "HomeTeam", "AwayTeam", {_published_sql(NAMES, COUNTS)} FROM w"""


@query(_played_sql())
def match_feature_table(spark, sf_dir):
    """All pre-match features of every match: 22 metrics over 5 and 19 matches, overall and by venue, both sides and differences."""
    return rounded(mf.match_features(history(spark, sf_dir)))


@query(_upcoming_sql())
def upcoming_feature_table(spark, sf_dir):
    """The same for all fixtures from a day on, as seen on that day; matches before it that the list still has are left out."""
    known = history(spark, sf_dir).filter(F.col("Date") < F.lit(DAY).cast("date"))
    listed = matches(spark, sf_dir).select("League", "Season", "Date", "HomeTeam", "AwayTeam")
    return rounded(mf.upcoming_features(known, listed))
