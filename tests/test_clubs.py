"""Clubs by evidence, labels by votes, roles by position sets."""

import pytest

from touchline.operators import clubs


def test_refiling(spark):
    players = [
        (1, "E0", "2425", "Amad Diallo Traoré", "Loan FC"),  # seen at Home only
        (2, "E0", "2425", "André Onana", "Loan FC"),  # seen where he is filed
        (3, "E0", "2425", "Fabián", "Loan FC"),  # one name contains his
        (4, "E0", "2425", "Nobody Known", "Loan FC"),
        (5, "E0", "2425", "A. Twin", "Loan FC"),  # a key that two names share
        (6, "E0", "2425", "Two Clubs", "Third"),  # seen at two of the listed clubs
        (7, "E0", "2324", "Amad Diallo Traoré", "Loan FC"),  # another season
        (8, "E0", "2425", "Not Listed", "Loan FC"),
        (9, "E0", "2425", None, "Loan FC"),
        (10, "E0", "2425", "Extra Long Name", "Loan FC"),  # his contains theirs
    ]
    listed = [(p, c, i) for p in (1, 2, 3, 4, 5, 6, 7, 9, 10) for i, c in enumerate(["Loan FC", "Home", "Away"])] + [(6, "Third", 3)]
    stats = [
        ("E0", "2425", "Home United", "Amad Diallo", 10, 1.0),
        ("E0", "2425", "Loan FC", "Andre Onana", 10, 1.0),
        ("E0", "2425", "Home United", "Andre Onana", 90, 1.0),
        ("E0", "2425", "Home United", "Fabián Ruiz Peña", 5, 1.0),
        ("E0", "2425", "Home United", "Anna Twin", 5, 1.0),
        ("E0", "2425", "Home United", "Abel Twin", 5, 1.0),
        ("E0", "2425", "Home United", "Two Clubs", 5, 1.0),
        ("E0", "2425", "Away", "Two Clubs", 20, 1.0),
        ("E0", "2425", "Elsewhere", "Not Listed", 20, 1.0),
        ("E0", "2425", "Away", "Long Name", 0, 0.0),
        ("E0", "2425", None, "Gone", None, None),
    ]
    got = clubs.refile(
        spark.createDataFrame(players, "pid int, League string, Season string, Player string, Team string").repartition(3),
        spark.createDataFrame(stats, "League string, Season string, Team string, Player string, fouls int, fouls_per90 double").repartition(3),
        spark.createDataFrame(listed, "pid int, club string, place int"),
        {"Home": "Home Utd"},
        {"Home United": "Home Utd"},
    )
    teams = {r.pid: (r.Team, r.refiled) for r in got.collect()}
    assert len(teams) == 10
    moved = {k: t for k, (t, m) in teams.items() if m}
    assert moved == {1: "Home", 3: "Home", 6: "Away", 10: "Away"}
    assert all(t == dict((p[0], p[4]) for p in players)[k] for k, (t, m) in teams.items() if not m)
    nothing = clubs.refile(got.drop("refiled").limit(0), spark.createDataFrame([], "League string, Season string, Team string, Player string"), spark.createDataFrame([], "pid int, club string, place int"), {}, {})
    assert nothing.count() == 0


def test_votes(spark):
    rows = [("FC One", "2324", "One")] * 10 + [("FC One", "2324", "Left")] + [("FC One", "2425", "One")] * 4 + [("Few", "2425", "One")] * 3 + [("Split", "2425", "A")] * 5 + [("Split", "2425", "B")] * 5
    rows += [("Mixed", "2324", "A")] * 9 + [("Mixed", "2425", "B")] * 9 + [(None, "2425", "A"), ("FC One", "2425", None)]
    got = clubs.vote_labels(spark.createDataFrame(rows, "fifa_club string, Season string, Team string"), "fifa_club", "Team")
    assert [tuple(r) for r in got.collect()] == [("FC One", "One", 2)]


def test_settled_roles(spark):
    rows = [
        ("Kanté", "1617", "MID", "CM, CDM"),
        ("Kanté", "1718", "DM", "CDM, CM"),
        ("Kanté", "1819", "DM", "cdm,CM "),
        ("Kanté", "1920", "FB", "RB"),  # another set
        ("Tie", "9900", "CB", "CB, RB"),
        ("Tie", "0001", "FB", "RB, CB"),  # the later season, not the larger label
        ("Null", "2425", None, "ST"),
        ("Null", "2526", "FWD", None),
        (None, "2425", "CB", "CB, DM"),
    ]
    df = spark.createDataFrame(rows, "Player string, Season string, role string, fifa_positions string").repartition(3)
    got = {(r.Player, r.Season): r.role for r in clubs.settle_roles(df).collect()}
    assert got == {("Kanté", "1617"): "DM", ("Kanté", "1718"): "DM", ("Kanté", "1819"): "DM", ("Kanté", "1920"): "FB", ("Tie", "9900"): "FB", ("Tie", "0001"): "FB", ("Null", "2425"): None, ("Null", "2526"): "FWD", (None, "2425"): "CB"}
    assert clubs.settle_roles(df.limit(0)).columns == df.columns


def test_minutes(spark):
    df = spark.createDataFrame([(9, 1.0, 4, 0.5), (None, None, 0, 0.0), (3, 0.0, None, None)], "fouls int, fouls_per90 double, saves int, saves_per90 double")
    assert [r[0] for r in df.select(clubs.estimated_minutes(df)).collect()] == pytest.approx([810.0, 0.0, 0.0])
    bare = spark.createDataFrame([(1,)], "x int")
    assert bare.select(clubs.estimated_minutes(bare)).first()[0] == 0.0
