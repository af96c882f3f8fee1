"""Curves, rosters and squad strength on hand-made rows, against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import rating, sensitivity, squads
from touchline.sources import sinks


def test_interpolation_like_numpy(spark):
    rng = random.Random(4)
    points = [(k, float(x), rng.uniform(0, 99)) for k in ("a", "b") for x in sorted(rng.sample(range(40, 90), 9))] + [("one", 60.0, 50.0), (None, 1.0, 1.0)]
    asked = [(i, rng.choice(["a", "b", "one", "none", None]), rng.choice([None, rng.uniform(30, 99), float(rng.randrange(40, 90))])) for i in range(300)]
    curves = spark.createDataFrame(points, "k string, x double, y double")
    got = squads.interpolate(spark.createDataFrame(asked, "i int, k string, v double").repartition(4), curves, ["k"], "v", "out").collect()
    assert len(got) == len(asked)
    for r in got:
        xs, ys = ([p[j] for p in points if p[0] == r.k and r.k is not None] for j in (1, 2))
        if r.v is None or not xs:
            assert r.out is None
        else:
            assert r.out == pytest.approx(np.interp(r.v, xs, ys))


def test_thin_curves_give_way_to_the_season(spark):
    rows = [("CB", "2425", 60 + i, 50.0 + i) for i in range(5)] + [("GK", "2425", 70, 90.0), ("GK", "2425", 70, 80.0), ("CB", "2324", None, 1.0)]
    published = spark.createDataFrame(rows, "role string, Season string, o int, s double")
    asked = spark.createDataFrame([("CB", "2425", 62), ("GK", "2425", 70), ("GK", "2425", 99), (None, "2425", 61), ("CB", "2324", 60), ("CB", "2425", 10)], "role string, Season string, o int")
    got = {(r.role, r.Season, r.o): r.out for r in squads.on_our_scale(asked, published, "o", "s", "out").collect()}
    assert got == {("CB", "2425", 62): 52.0, ("GK", "2425", 70): 85.0, ("GK", "2425", 99): 85.0, (None, "2425", 61): 51.0, ("CB", "2324", 60): None, ("CB", "2425", 10): 50.0}


def past(spark):
    rows = [("p", "9899", "CB", 70, 900, 70, 71.0), ("p", "0001", "CB", 80, 1800, 72, 75.0), ("q", "0001", "CB", None, 90, 65, 66.0), ("r", "0102", "FB", 50, 100, 60, 61.0)]
    return spark.createDataFrame(rows, "player string, Season string, role string, rating int, minutes int, fifa_overall int, fifa_on_our_scale double")


def test_rosters_read_only_the_past(spark):
    edition = spark.createDataFrame([("L", "0001", "T", x, "CB", 70) for x in ("p", "q", "r")], "League string, Season string, Team string, player string, role string, fifa_overall int")
    got = {r.player: (r.rating, r.minutes, r.from_history, r.rated) for r in squads.rosters(edition, past(spark)).collect()}
    # the curve of the season: 65 -> 66, 72 -> 75
    assert got["p"] == (70.0, 900.0, True, True)
    assert got["q"][0] == pytest.approx(66 + 5 * 9 / 7) and got["q"][1:] == (None, False, True)
    assert got["r"][0] == got["q"][0] and not got["r"][2]
    now = {r.player: r.rating for r in squads.rosters(edition, past(spark), include_current=True).collect()}
    assert now["p"] == 80.0
    assert squads.rosters(edition.limit(0), past(spark)).count() == 0


def test_strength_of_the_best(spark):
    rows = [("L", "2425", "T", "a", 80.0, 900.0, True, True, "defence"), ("L", "2425", "T", "b", 60.0, None, False, True, "defence"), ("L", "2425", "T", "c", 70.0, None, False, True, "attack"), ("L", "2425", "T", "d", None, 500.0, False, False, "defence"), ("L", "2425", "T", "e", 99.0, 10.0, False, True, None), ("L", "2425", "U", "f", 50.0, 0.0, True, True, "attack")]
    roster = spark.createDataFrame(rows, "League string, Season string, Team string, player string, rating double, minutes double, from_history boolean, rated boolean, line string")
    got = {r.Team: r for r in squads.squad_strength(roster, {"defence": 4.0, "attack": 3.0}).collect()}
    # b weighs the mean of his line's known minutes, d's included
    defence = (80 * 900 + 60 * 700) / 1600
    assert got["T"].squad_defence == pytest.approx(defence) and got["T"].squad_overall == pytest.approx((4 * defence + 3 * 70) / 7)
    assert (got["T"].n_players, got["T"].n_from_history) == (3, 1)
    assert got["U"].squad_defence is None and got["U"].squad_overall == 50.0
    best = squads.squad_strength(roster, {"defence": 4.0, "attack": 3.0}, best=1).filter("Team = 'T'").first()
    assert (best.squad_defence, best.squad_attack, best.n_players) == (80.0, None, 1)
    assert squads.squad_strength(roster, {"defence": 4.0, "attack": 3.0}, least=2).count() == 1


def rated_clubs(spark):
    lines = ("defence", "midfield", "attack")
    return spark.createDataFrame([(s, t, t * 100 + p, lines[(p * p + t) % 3], (p * 37 + t * 11) % 60 + 30, (p * 53 + t) % 900) for s in ("2324", "2425") for t in range(9) for p in range(2 * t + 1)], "Season string, team int, player int, line string, rating int, minutes int")


def test_strength_without_the_best_is_that_of_the_rest(spark):
    rated, keys = rated_clubs(spark).repartition(4), ["Season", "team"]
    rest = sensitivity.without_best(rated, keys, [F.desc("rating"), F.desc("minutes"), F.asc("player")])
    want = sensitivity.strength_drops(rating.team_strength(rated, 4, 5), rating.team_strength(rest, 4, 5), keys, "strength_overall")
    got = {(r.Season, r.team): (r.strength_overall, r.drop) for r in rating.strength_without_best(rated, 4, 5).collect()}
    assert got == {(r.Season, r.team): pytest.approx((r.strength_overall, r.drop)) for r in want.collect()}
    assert {t for _, t in got} == set(range(3, 9))  # 5 players are too few once one is gone


def test_a_club_is_sorted_once(spark):
    rated = rated_clubs(spark)
    roster = rated.withColumns({"League": F.lit("A"), "rated": F.lit(True), "from_history": F.lit(True)}).withColumnRenamed("team", "Team")
    for strength, sorts in ((rating.team_strength(rated, 15, 5), 1), (rating.strength_without_best(rated, 15, 5), 1), (squads.squad_strength(roster, rating.LINE_WEIGHTS), 2)):
        plan = strength._jdf.queryExecution().executedPlan().toString()
        assert plan.count(" Sort [") == sorts
        assert plan.count("Exchange hashpartitioning") == 1


def test_an_edition_dealt_by_player_does_not_move(spark):
    """What an entry asks of the history and of the curves comes to it; the tables that the rating passes through are deleted."""
    entries = spark.createDataFrame([("L", "0001", "T", x, "CB", 70) for x in ("p", "q", "r")], "League string, Season string, Team string, player string, role string, fifa_overall int")
    made = []

    def kept(df, name, written=squads.written):
        made.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return written(df, name)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(squads, "written", kept)
        patch.setattr(squads, "BROADCAST_ANSWERS", 10)
        roster = squads.rosters(entries.repartition("player"), past(spark))
    assert roster.count() == 3
    plan = dict(made)["rosters"]
    assert "Window" in plan and "Union" not in plan  # the history has its ends, and entries meet it by player
    assert "Exchange hashpartitioning" not in roster._jdf.queryExecution().executedPlan().toString()

    first = []

    def passing():
        first.append(sinks.written(spark.range(5), "first"))
        return first[0][0].filter("id > 2")

    assert sinks.distilled(spark, passing, "last").count() == 2 and not sinks.exists(spark, first[0][1])
