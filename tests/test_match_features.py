"""The feature table: fixtures see what a played match in their place would have seen, however often a team appears."""

import datetime
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from touchline.operators import match_features as mf
from touchline.plans.match_queries import rounded

KIND = "match_id long, League string, Season string, Date date, Team string, Opponent string, Venue string, GoalsFor int, GoalsAgainst int, ShotsFor int, ShotsOnTargetFor int, xGFor double, xGAgainst double, Result string"


def games(n=90, seed=3):
    rng, day, out = random.Random(seed), datetime.date(2024, 8, 1), []
    for i in range(n):
        h, a = rng.sample("ABCDEF", 2)
        gh, ga, sh, st = rng.randrange(4), rng.randrange(4), rng.randrange(12), rng.randrange(3)
        result = "W" if gh > ga else "L" if gh < ga else "D"
        other = {"W": "L", "L": "W", "D": "D"}[result]
        d = day + datetime.timedelta(days=i // 2 * 3)
        out += [(i, "E0", "2425", d, h, a, "Home", gh, ga, sh, st, gh / 2, ga / 3, result), (i, "E0", "2425", d, a, h, "Away", ga, gh, sh + 1, st, ga / 3, gh / 2, other)]
    return out


def plain(row):
    return {k: (None if isinstance(v, float) and math.isnan(v) else v) for k, v in row.asDict().items()}


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == b[k] or a[k] == pytest.approx(b[k]), k


@pytest.fixture(scope="module")
def tmh(spark):
    return spark.createDataFrame(games(), KIND).repartition(4).cache()


def test_fixtures_like_matches_in_their_place(spark, tmh):
    """Features of the last round, built as fixtures from what came before, equal those it has as played matches."""
    whole = {r.match_id: plain(r) for r in mf.match_features(tmh).collect()}
    last = max(r[3] for r in games())
    before = tmh.filter(F.col("Date") < F.lit(last))
    fixtures = tmh.filter("Venue = 'Home'").select("League", "Season", "Date", F.col("Team").alias("HomeTeam"), F.col("Opponent").alias("AwayTeam"))
    got = [plain(r) for r in mf.upcoming_features(before, fixtures.unionByName(fixtures)).collect()]  # played ones and repeats go
    want = [v for v in whole.values() if v["Date"] == last]
    assert len(got) == len(want) == 2
    key = lambda v: (v["HomeTeam"], v["AwayTeam"])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        b.pop("match_id")
        teams = [b["HomeTeam"], b["AwayTeam"]]
        if len({t for v in want for t in (v["HomeTeam"], v["AwayTeam"])}) == 4:  # else the second match of the day sees the first
            same(a, {k: b[k] for k in a})
        assert teams


def test_form_stays_frozen_over_a_season(spark, tmh):
    day = max(r[3] for r in games()) + datetime.timedelta(days=7)
    rounds = [(day + datetime.timedelta(days=7 * k), h, a) for k in range(4) for h in "ABC" for a in "DEF"]
    fixtures = spark.createDataFrame([("E0", "2425", *r) for r in rounds] + [("E0", "2425", day, "A", "New")], "League string, Season string, Date date, HomeTeam string, AwayTeam string")
    got = [plain(r) for r in mf.upcoming_features(tmh, fixtures).collect()]
    assert len(got) == len(rounds) + 1
    form = {}
    for r in got:
        form.setdefault(r["HomeTeam"], set()).add((r["home_points_last_19"], r["home_xg_diff_last_5_venue"], r["home_matches_used_last_5"]))
        new = r["AwayTeam"] == "New"
        assert (r["away_points_last_5"] is None) == new and (r["away_matches_used_last_19"] == 0) == new and (r["points_last_5_diff"] is None) == new
        assert r["home_matches_last_14_days"] == (0 if (r["Date"] - day).days > 7 else r["home_matches_last_14_days"])
    assert all(len(v) == 1 for v in form.values())


def test_by_hand(spark, tmh):
    rows = sorted(games(), key=lambda r: (r[3], r[0]))
    got = {r.match_id: plain(r) for r in mf.match_features(tmh).collect()}
    assert len(got) == 90
    for i in (0, 7, 40, 89):
        home = next(r for r in rows if r[0] == i and r[6] == "Home")
        past = [r for r in rows if r[4] == home[4] and (r[3], r[0]) < (home[3], i)]
        at_home = [r for r in past if r[6] == "Home"][-5:]
        points = lambda v: sum({"W": 3, "D": 1, "L": 0}[r[13]] for r in v)
        assert got[i]["home_points_last_5"] == (points(past[-5:]) if past else None)
        assert got[i]["home_points_last_5_venue"] == (points(at_home) if at_home else None)
        assert got[i]["home_matches_used_last_19"] == min(19, len(past))
        assert got[i]["home_days_since_last_match"] == ((home[3] - past[-1][3]).days if past else None)
        assert got[i]["home_matches_last_14_days"] == sum(1 <= (home[3] - r[3]).days <= 14 for r in past)
        mean = [r[7] - r[8] for r in past[-19:]]
        assert got[i]["home_goal_diff_last_19"] == (pytest.approx(sum(mean) / len(mean)) if mean else None)


def test_inputs_and_absent_sources(spark, tmh):
    bare = mf.match_features(tmh.drop("xGFor", "xGAgainst", "ShotsFor", "ShotsOnTargetFor").withColumn("ShotsFor", F.lit(None).cast("int")))
    assert not any("xg" in c or "accuracy" in c for c in bare.columns) and "home_points_last_5" in bare.columns and bare.count() == 90
    inputs = mf.model_inputs(mf.match_features(tmh).withColumn("AvgH", F.lit(2.0)).withColumn("FTHG", F.lit(1)))
    assert "home_points_last_5" in inputs and not {"AvgH", "FTHG", "match_id", "Date", "HomeTeam"} & set(inputs)
    assert mf.match_features(tmh.limit(0)).count() == 0 and mf.upcoming_features(tmh, mf.match_features(tmh).limit(0)).count() == 0


def test_slices_of_time_give_the_windows_of_whole_teams(spark, monkeypatch):
    """Also for a team that plays too rarely for one slice to hold what its windows reach back to."""
    rows = [r for r in games(700) if "F" not in (r[4], r[5]) or r[0] % 45 == 0]
    table = spark.createDataFrame(rows, KIND).repartition(4)
    want = {r.match_id: plain(r) for r in mf.match_features(table).collect()}
    monkeypatch.setattr(mf, "SLICE_ROWS", 230)
    moved = []
    cut = mf._in_slices
    monkeypatch.setattr(mf, "_in_slices", lambda *a: moved.append(cut(*a)) or moved[-1])
    got = {r.match_id: plain(r) for r in mf.match_features(table).collect()}
    assert moved[0].select("_slice").distinct().count() > 3 and moved[0].filter("not _own").count() > 0
    assert got == want


def test_published_values_are_rounded_as_in_the_sql(spark):
    # exact halves in the seventh digit, of which the product with a million keeps, meets or misses the half
    values = [1.0003125, 0.9740624999999999, -0.13218749999999999, -0.22593749999999999, 0.0003125, -2.5, 0.0, 1e306, math.inf, -math.inf, None]
    df = spark.createDataFrame(list(enumerate(values)), "id int, x double")
    got = [row.x for row in rounded(df).orderBy("id").collect()]
    assert got == [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 6)", [v]).fetchone()[0] for v in values]
    assert got[:4] == [1.000312, 0.974063, -0.132188, -0.225938]
    assert math.isnan(rounded(spark.sql("SELECT double('nan') AS x")).first().x)


def test_a_slice_is_taken_at_once_and_repeated_sides_count_by_their_greatest(spark, monkeypatch):
    """No sliding frame of Spark is left in a sliced table; nulls, and a match that has a side twice or lacks one, are as before."""
    rows = [list(r) for r in games(300)]
    for i, r in enumerate(rows):
        if i % 7 == 0:
            r[7] = r[13] = None
        if i % 5 == 0:
            r[11] = None
    rows = [r for i, r in enumerate(rows) if i % 31] + [[*r[:4], "Z", *r[5:]] for r in rows[::37]]
    table = spark.createDataFrame(rows, KIND).repartition(3)
    want = {r.match_id: plain(r) for r in mf.match_features(table).collect()}
    monkeypatch.setattr(mf, "SLICE_ROWS", 280)
    sliced = mf.match_features(table)
    plan = sliced._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "specifiedwindowframe(RowFrame, -19, -1)" not in plan
    assert {r.match_id: plain(r) for r in sliced.collect()} == want
