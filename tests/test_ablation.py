"""Families of columns, coalitions of inputs, versions of models, and the walk with matches that only teach."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import ablation, boosting, heads, models, sequential
from touchline.operators import match_features as mf
from touchline.sources import registry
from touchline.sources.sinks import written


def test_families_cover_the_feature_table():
    names = [f"{name}_{suffix}" for _, _, suffix in mf.groupings() for name in [n for _, n in mf.FORM.values()] + ["matches_used"]]
    columns = [f"{side}_{n}" for n in [*names, "days_since_last_match", "matches_last_14_days", "elo", "strength_overall"] for side in ("home", "away")] + [f"{s}_diff" for s in mf.diff_stems([*names, "days_since_last_match"])] + ["league_code", "elo_diff"]
    found = ablation.classify(columns)
    assert set(found) == set(ablation.FAMILIES) and sum(map(len, found.values())) == len(columns)
    assert "home_npxg_diff_last_5_venue" in found["xg"] and "goal_diff_last_19_diff" in found["form"] and "elo_diff" in found["elo"]
    with pytest.raises(ablation.UnknownColumnError, match="no family"):
        ablation.classify(["home_points_last_5", "mystery"])
    assert ablation.columns_of(found, ["elo", "none"]) == ["home_elo", "away_elo", "elo_diff"]


def games(spark, n=900):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        elo, form = float(rng.normal()), float(rng.normal())
        w = np.exp([0.4 + 1.2 * elo + 0.4 * form, 0.0, -0.2 - 1.2 * elo - 0.4 * form])
        rows.append((i, f"{20 + i // 300}{21 + i // 300}", 2020 + i // 300, "HDA"[rng.choice(3, p=w / w.sum())], elo, form if i % 5 else None, float(rng.normal()), None))
    return spark.createDataFrame(rows, "match_id long, Season string, start int, FTR string, elo_diff double, home_points_last_5 double, home_xg_for_last_5 double, league_code double").repartition(4)


@pytest.fixture(scope="module")
def scores(spark):
    df = games(spark)
    by = ablation.classify(["elo_diff", "home_points_last_5", "home_xg_for_last_5", "league_code"])
    return ablation.coalition_scores(df, by, ["elo", "form", "xg"]).cache()


def test_ladder_and_shares(scores):
    members = ["elo", "form", "xg"]
    assert scores.count() == 600 and len(scores.columns) == 2 + 8
    steps = {r.families: (r.rps, r.gain) for r in ablation.ladder(scores, members).collect()}
    assert steps["base"][1] is None and steps["base+elo"][1] > 0.03 and steps["base+elo+form"][1] > 0 and abs(steps["base+elo+form+xg"][1]) < 0.005
    lost = {r.family: r.loss for r in ablation.leave_one_out(scores, members).collect()}
    assert lost["elo"] > lost["form"] > lost["xg"]
    got = {r.family: (r.contribution, r.share) for r in ablation.shares(scores, members).collect()}
    gain = steps["base"][0] - steps["base+elo+form+xg"][0]
    assert sum(c for c, _ in got.values()) == pytest.approx(gain) and sum(s for _, s in got.values()) == pytest.approx(1)
    # by hand, over all orders in which elo may join
    mean = {c: scores.agg(F.avg(c)).first()[0] for c in scores.columns if c.startswith("rps")}
    value = lambda *c: -mean["_".join(["rps", *c])]
    want = (value("elo") - value()) / 3 + (value("elo", "form") - value("form")) / 6 + (value("elo", "xg") - value("xg")) / 6 + (value("elo", "form", "xg") - value("form", "xg")) / 3
    assert got["elo"][0] == pytest.approx(want)


def test_arms_must_have_the_same_matches(spark, scores):
    assert ablation.aligned(scores, scores.repartition(3), ["match_id"]) == 600
    with pytest.raises(ablation.ArmsDifferError):
        ablation.aligned(scores, scores.filter("match_id <> 700"), ["match_id"])
    with pytest.raises(ablation.ArmsDifferError):
        ablation.aligned(scores, scores.union(scores.limit(1)), ["match_id"])


def test_other_fits_and_folds(spark):
    seen = []

    class Flat:
        def __init__(self, train, columns):
            seen.append((train.agg(F.max("start")).first()[0], tuple(columns)))

        def predict(self, df):
            return df.withColumns({"ph": F.lit(0.5), "pd": F.lit(0.3), "pa": F.lit(0.2)})

    got = ablation.coalition_scores(games(spark), {"elo": ["elo_diff"]}, ["elo"], folds=1, fit=Flat)
    assert got.count() == 300 and seen == [(2021, ()), (2021, ("elo_diff",))]
    with pytest.raises(ValueError):
        ablation.coalition_scores(games(spark).filter("start = 2020"), {}, ["elo"], fit=Flat)


def test_registry(spark, tmp_path):
    root = str(tmp_path / "models")
    assert registry.latest(spark, root) is None and registry.list_versions(spark, root).count() == 0
    with pytest.raises(FileNotFoundError):
        registry.load(spark, root)
    data = spark.createDataFrame([(float(i % 7), float(i % 3)) for i in range(200)], "x double, y double")
    model = boosting.fit_boosted(data, ["x"], ["y"], trees=2, least_rows=10)
    at = datetime.datetime(2024, 5, 1, tzinfo=datetime.UTC)
    first = registry.make_version(datetime.date(2024, 4, 30), at)
    assert first == "20240430-20240501T000000000000Z"
    registry.save(spark, root, first, model.to_dict(), {"n_train": 200, "leagues": ["E0"]}, at)
    registry.save(spark, root, "candidate", {"other": 1}, {}, at + datetime.timedelta(days=1), mark_latest=False)
    assert registry.latest(spark, root) == first
    body, meta = registry.load(spark, root)
    again = boosting.Boosted.from_dict(body)
    assert meta == {"n_train": 200, "leagues": ["E0"]} and again.trees == model.trees
    assert again.predict(data).toPandas().equals(model.predict(data).toPandas())
    assert [r.version for r in registry.list_versions(spark, root).collect()] == ["candidate", first]
    with pytest.raises(FileExistsError):
        registry.save(spark, root, first, {}, {})
    for name in ("latest", "../x", ""):
        with pytest.raises(ValueError):
            registry.save(spark, root, name, {}, {})
    with pytest.raises(FileNotFoundError):
        registry.load(spark, root, "none")


def test_extra_matches_teach_and_have_no_rows(spark):
    rng, day = random.Random(3), datetime.date(2024, 8, 1)
    kind = "match_id long, Date date, Season string, HomeTeam string, AwayTeam string, FTHG int, FTAG int, Round string"
    domestic = [(i, day + datetime.timedelta(days=2 * i), "2425", *rng.sample("ABCD", 2), rng.randrange(4), rng.randrange(4), None) for i in range(40)]
    ties = [(i, day + datetime.timedelta(days=8 * i + 1), "2425", *rng.sample("ABCDXY", 2), rng.randrange(4), rng.randrange(4), "Final" if i == 9 else "Group") for i in range(10)] + [(99, None, "2425", "A", "B", 1, 1, "Group")]
    home = spark.createDataFrame(domestic, kind).repartition(3)
    extra = sequential.european_rows(spark.createDataFrame(ties, kind))
    assert extra.count() == 10 and [r.match_id for r in extra.filter("Neutral").collect()] == [9]
    got = {r.match_id: (r.home_elo, r.away_elo) for r in sequential.elo_with_extra(home, extra).collect()}
    state, want = sequential.EloState(), {}
    for i, d, s, h, a, x, y, final, own in sorted([(*r, True) for r in domestic] + [(*r, False) for r in ties if r[1]], key=lambda r: (r[1], 2 * r[0] + (not r[8]))):
        before = state.match(h, a, s, x, y, final == "Final")
        if own:
            want[i] = before
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)
    alone = {r.match_id: r.home_elo for r in sequential.elo_walk(home).collect()}
    assert any(abs(alone[i] - got[i][0]) > 1 for i in got)
    none = {r.match_id: r.home_elo for r in sequential.elo_with_extra(home, extra.limit(0)).collect()}
    assert none == pytest.approx(alone)
    long = home.select("match_id", F.explode(F.array(*[F.struct(F.lit(v).alias("Venue"), F.col(t).alias("Team")) for v, t in (("Home", "HomeTeam"), ("Away", "AwayTeam"))])).alias("s")).select("match_id", "s.*")
    rows = {(r.match_id, r.Venue): (r.elo, r.opponent_elo) for r in sequential.long_elo(long, sequential.elo_with_extra(home, extra)).collect()}
    assert len(rows) == 80 and all(rows[i, "Home"] == pytest.approx(got[i]) and rows[i, "Away"] == pytest.approx(got[i][::-1]) for i in got)


def test_heads_are_those_of_a_fit_each_from_few_passes(spark):
    """Shares as from a logistic fit on filled columns and flags, all coalitions from a few jobs, and separable or absent columns do no harm."""
    df, _ = written(games(spark).withColumn("home_points_last_5", F.col("home_points_last_5") * 1e-3 + 1e6).withColumn("home_goals_for_last_5", F.col("home_points_last_5") * 2), "games")
    columns = {"one": ["elo_diff"], "two": ["home_points_last_5", "home_goals_for_last_5", "league_code"], "all": ["elo_diff", "home_points_last_5", "home_xg_for_last_5"], "none": []}
    spark.sparkContext.setJobGroup("heads", "")
    found = heads.fit_heads(df, columns)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("heads"))
    spark.sparkContext.setJobGroup("other", "")
    assert jobs < 30
    got = {r.match_id: r for r in found.predict(df, ["match_id"]).collect()}
    for i, own in enumerate([["e"], ["p", "m"], ["e", "p", "m", "x"]]):
        plain = df.withColumns({"e": F.col("elo_diff"), "p": F.coalesce((F.col("home_points_last_5") - 1e6) * 1e3, F.lit(0.0)), "m": F.col("home_points_last_5").isNull().cast("double"), "x": F.col("home_xg_for_last_5")})
        for r in models.head_probabilities(models.fit_outcome_head(plain, own), plain, own).select("match_id", "ph", "pd", "pa").collect():
            assert [got[r.match_id][f"{p}_{i}"] for p in ("ph", "pd", "pa")] == pytest.approx([r.ph, r.pd, r.pa], abs=2e-3)
    n = df.count()
    assert got[0].ph_3 == pytest.approx(df.filter("FTR = 'H'").count() / n) and got[0].pa_3 == pytest.approx(df.filter("FTR = 'A'").count() / n)
    parted, _ = written(df.withColumn("elo_diff", F.when(F.col("FTR") == "H", 1.0).otherwise(0.0)).filter("FTR <> 'A'"), "parted")
    for r in heads.fit_heads(parted, {"one": ["elo_diff"]}).predict(parted, ["FTR"]).collect():
        assert (r.ph_0 if r.FTR == "H" else r.pd_0) > 0.999


def test_scores_of_coalitions_come_from_few_jobs(spark):
    """Before, each of the 8 coalitions had a fit of its own, of up to 100 passes, and a join to the others."""
    by = ablation.classify(["elo_diff", "home_points_last_5", "home_xg_for_last_5", "league_code"])
    df = games(spark)
    spark.sparkContext.setJobGroup("coalitions", "")
    got = ablation.coalition_scores(df, by, ["elo", "form", "xg"], folds=1)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("coalitions"))
    spark.sparkContext.setJobGroup("other", "")
    assert jobs < 40 and got.count() == 300 and len(got.columns) == 10
