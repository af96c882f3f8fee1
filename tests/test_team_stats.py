"""A second source's statistics, what stays when it is down, ties and labels."""

import datetime

import pytest
from pyspark.sql import functions as F

from touchline.sources import team_stats as ts

DAY = datetime.date(2024, 8, 1)


def test_long_statistics(spark):
    raw = spark.createDataFrame(
        [("EPL", "2425", "2024-08-01 15:00:00", " Man Utd ", "B", "1.5", "0.5", "9.1", "8.0"), ("Other", "2425", "2024-08-01", "X", "Y", "1", "1", "1", "1"), ("EPL", "2324", None, "C", None, "n/a", None, None, "7")],
        "league string, season string, date string, home_team string, away_team string, home_xg string, away_xg string, home_ppda string, away_ppda string",
    )
    got = {(r.Team, r.Venue): r for r in ts.team_statistics(raw, {"E0": "EPL"}, {"Man Utd": "Man United"}).collect()}
    assert len(got) == 4 and "PPDAAgainst" not in got["B", "Away"].asDict()
    home = got["Man United", "Home"]
    assert (home.League, home.Season, home.Date, home.Opponent, home.xGFor, home.xGAgainst, home.PPDAFor, home.npxGFor) == ("E0", "2425", DAY, "B", 1.5, 0.5, 9.1, None)
    assert got["B", "Away"].xGAgainst == 1.5 and got["B", "Away"].PPDAFor == 8.0 and got["C", "Home"].xGFor is None
    assert ts.missing_seasons(ts.team_statistics(raw, {"E0": "EPL"}, {}), ["2425", "2223", "2324"]) == ["2223"] and ts.missing_seasons(raw, []) == []
    assert ts.team_statistics(raw.limit(0), {"E0": "EPL"}, {}).count() == 0
    names = ts.unknown_names(raw, ["home_team", "away_team"], spark.createDataFrame([("B",), ("X",)], "club string"), "club")
    assert {(r.name, r.rows) for r in names.collect()} == {(" Man Utd ", 1), ("Y", 1), ("C", 1)}


def test_published_statistics_stand_in(spark, tmp_path):
    path = str(tmp_path / "history")
    assert ts.published_statistics(spark, path).count() == 0 and ts.published_statistics(spark, path).columns == list(ts.XG_COLUMNS)
    kind = "League string, Season int, Date date, Team string, Opponent string, Venue string, xGFor double, xGAgainst double, npxGFor double, npxGAgainst double, PPDAFor double, DeepCompletionsFor int, Other string"
    rows = [("E0", 2425, DAY, t, "Z", "Home", x, 1.0, 1.0, 1.0, 1.0, 3, "o") for t, x in (("A", 0.5), ("B", None), ("C", 0.7))]
    spark.createDataFrame(rows, kind).write.parquet(path)
    published = ts.published_statistics(spark, path)
    assert sorted((r.Team, r.Season, r.xGFor) for r in published.collect()) == [("A", "2425", 0.5), ("C", "2425", 0.7)]
    fresh = published.filter("Team = 'A'").withColumn("xGFor", F.lit(9.0))
    assert sorted((r.Team, r.xGFor) for r in ts.with_fallback_statistics(fresh, published).collect()) == [("A", 9.0), ("C", 0.7)]
    assert ts.with_fallback_statistics(None, published).count() == 2
    spark.createDataFrame([("E0",)], "League string").write.mode("overwrite").parquet(path)
    assert ts.published_statistics(spark, path).count() == 0


def test_ties(spark):
    kind = "Date date, HomeTeam string, AwayTeam string, FTHG int, FTAG int, Round string"
    one = spark.createDataFrame([(DAY, "Hertha BSC", "A", 1, 0, "Final"), (DAY, "A", "B", None, None, "Group stage"), (DAY, "A", "Nowhere", 1, 1, "Round of 16"), (DAY, "B", "A", 0, 2, "New name"), (DAY, "A", "B", 1, 1, "Round of 16")], kind)
    clubs = spark.createDataFrame([("2425", "Hertha", "D1"), ("2425", "A", "E0"), ("2425", "A", "E0"), ("2425", "B", "SP1"), ("2324", "Nowhere", "F1")], "Season string, Team string, League string")
    ties, failed = ts.european_ties({("UCL", "2425"): one, ("UEL", "2425"): OSError("down")}, clubs, {"Hertha BSC": "Hertha"})
    got = sorted((r.HomeTeam, r.AwayTeam, r.home_league, r.away_league, r.FTR, r.kind) for r in ties.collect())
    assert got == [("A", "B", "E0", "SP1", "D", "two_legged"), ("B", "A", "SP1", "E0", "A", "unclassified"), ("Hertha", "A", "D1", "E0", "H", "neutral")]
    assert failed == [("UEL", "2425")] and ts.european_ties({("UEL", "2425"): OSError()}, clubs, {}) == (None, [("UEL", "2425")])


@pytest.mark.parametrize("label, reserve", [("FC Barcelona B", True), ("Willem II", False), ("Jong Ajax II ", True), ("Sevilla Atlético", True), ("Bayern U19", True), ("Real Madrid", False), ("1. FC Köln 2", True), ("Academy", False), ("Leeds reserves", True), (None, None)])
def test_reserves(spark, label, reserve):
    assert spark.createDataFrame([(label,)], "l string").select(ts.is_reserve(F.col("l"))).first()[0] is reserve
