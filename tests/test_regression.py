"""Bootstrapped least squares, ratio intervals, verdicts and missingness weights, against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import regression


def ties(n=900, seed=3):
    rng = np.random.default_rng(seed)
    true, names = {"E0": 0.0, "SP1": -0.4, "D1": -0.6}, ["E0", "SP1", "D1"]
    rows = []
    for i in range(n):
        h, a = rng.choice(names, 2)
        gd = round(true[h] - true[a] + 0.35 + rng.normal(0, 1.2))
        away = int(rng.integers(0, 3)) + max(0, -gd)
        rows.append((i, str(h), str(a), away + gd, away))
    return rows


KIND = "match_id long, home_league string, away_league string, FTHG int, FTAG int"


def test_league_strength(spark):
    rows = ties()
    df = spark.createDataFrame([*rows, (-1, None, "E0", 1, 1), (-2, "E0", "D1", None, 1)], KIND).repartition(5)
    got = {r.league: r for r in regression.league_strength(df, "E0", 400).collect()}
    design = np.array([[(h == g) - (a == g) for g in ("D1", "SP1")] + [1] for _, h, a, _, _ in rows], float)
    want = np.linalg.lstsq(design, np.array([x - y for *_, x, y in rows], float), rcond=None)[0]
    assert [got[k].strength for k in ("D1", "SP1", "home_advantage")] == pytest.approx(list(want))
    assert got["E0"].strength == got["E0"].low == 0 and got["home_advantage"].n_matches == len(rows)
    assert got["D1"].n_matches == sum((h == "D1") != (a == "D1") for _, h, a, _, _ in rows)
    # the width agrees with the usual standard error
    left = np.array([x - y for *_, x, y in rows]) - design @ want
    error = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * left.var())
    for k, e in zip(("D1", "SP1"), error, strict=False):
        assert (got[k].high - got[k].low) / (2 * 1.645 * e) == pytest.approx(1, abs=0.2) and got[k].low < got[k].strength < got[k].high
    again = {r.league: r for r in regression.league_strength(df.repartition(2), "E0", 400).collect()}
    assert all(again[k].low == pytest.approx(got[k].low) for k in got)
    assert regression.league_strength(df.filter("home_league = 'E0' and away_league = 'E0'"), "E0").count() == 0
    assert {r.low for r in regression.league_strength(df, "E0", 0).collect() if r.league != "E0"} == {None}


def test_clusters_are_resampled_whole(spark):
    rng = np.random.default_rng(1)
    rows = [(k, 1.0, float(rng.normal())) for k in range(40) for _ in range(1)]
    once = regression.gram_draws(spark.createDataFrame(rows, "k int, one double, y double"), ["one"], "y", 50, ["k"])
    five = regression.gram_draws(spark.createDataFrame(rows * 5, "k int, one double, y double").repartition(7), ["one"], "y", 50, ["k"])
    assert np.allclose(five, 5 * once)
    counts = once[1:, 0, 0]
    assert abs(counts.mean() - 40) < 4 and counts.std() > 3
    with pytest.raises(ValueError, match="more sums"):
        regression.gram_draws(spark.createDataFrame(rows, "k int, one double, y double"), ["one"], "y", 10**8, ["k"])


def test_weights_are_like_repeats(spark):
    rows = [(i, 1.0, float(i % 3), float(i % 7), i % 4) for i in range(60)]
    kind = "k int, one double, x double, y double, w int"
    weighed = regression.gram_draws(spark.createDataFrame(rows, kind), ["one", "x"], "y", 0, ["k"], "w")
    repeated = regression.gram_draws(spark.createDataFrame([r for r in rows for _ in range(r[4])], kind), ["one", "x"], "y", 0, ["k"])
    assert np.allclose(weighed, repeated)
    beta = regression.solve(weighed)[0]
    x, y, w = (np.array(v, float) for v in zip(*[(r[2], r[3], r[4]) for r in rows], strict=True))
    left = y - beta[0] - beta[1] * x
    assert regression.r_squared(weighed[0], beta) == pytest.approx(1 - (w * left**2).sum() / (w * (y - np.average(y, weights=w)) ** 2).sum())


def test_fieller_against_its_equation():
    rng = np.random.default_rng(2)
    b = rng.normal(2.0, 0.2, 5000)
    a = 0.7 * b + rng.normal(0, 0.1, 5000)
    low, high = regression.fieller(a, b)
    c, t = np.cov(a, b), 1.959963984540054
    for r in (low, high):  # both ends solve (mean a - r mean b)^2 = t^2 Var(a - r b)
        assert (a.mean() - r * b.mean()) ** 2 == pytest.approx(t**2 * (c[0, 0] - 2 * r * c[0, 1] + r**2 * c[1, 1]))
    assert low < 0.7 < high
    assert regression.fieller(a, rng.normal(0.05, 0.2, 5000)) == (-math.inf, math.inf)
    assert regression.ratio_is_interpretable(b) and not regression.ratio_is_interpretable(rng.normal(0, 1, 99)) and not regression.ratio_is_interpretable([])


def test_verdicts():
    bounds = (0.8, 1.25)
    assert regression.verdict((-1, 1), 1.0, (0.9, 1.1), (-0.1, 0.5), bounds) == "uninformative"
    assert regression.verdict((-0.4, -0.1), 0.5, (0.3, 0.7), (0.2, 0.5), bounds) == "contamination"
    assert regression.verdict((-0.1, 0.1), 1.0, (0.9, 1.1), (0.2, 0.5), bounds) == "equivalent"
    assert regression.verdict((-0.1, 0.1), 1.0, (0.5, 1.6), (0.2, 0.5), bounds) == "inconclusive"
    assert regression.verdict((0.1, 0.4), 1.5, (1.3, 1.7), (0.2, 0.5), bounds) == "inconclusive"


def people(spark, slope, n=1500):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(n):
        x, moved = float(rng.normal()), bool(rng.random() < 0.4)
        y = (slope if moved else 0.5) * x + 0.2 * moved + (i % 3) * 0.1 + float(rng.normal(0, 0.4))
        rows.append((i // 3, x, moved, float(rng.normal()), f"s{i % 3}", y if rng.random() < 1 / (1 + math.exp(-x)) else None))
    return spark.createDataFrame(rows, "player int, x double, moved boolean, age double, Season string, y double").repartition(4)


@pytest.mark.parametrize("slope, said", [(0.1, "contamination"), (0.5, "equivalent")])
def test_travel(spark, slope, said):
    got = regression.travel(people(spark, slope), "y", "x", "moved", ["age"], ["Season"], ["player"], (0.7, 1.4), 300)
    assert got["verdict"] == said and got["stayer"] == pytest.approx(0.5, abs=0.06) and got["delta"] == pytest.approx(slope - 0.5, abs=0.09)
    assert got["ratio_low"] < got["ratio"] < got["ratio_high"] and 0.4 < got["r_squared"] < 0.9
    flat = regression.travel(people(spark, 0.0).withColumn("y", F.rand(1)), "y", "x", "moved", [], [], ["player"], (0.7, 1.4), 200)
    assert flat["verdict"] == "uninformative"


def test_missingness_weights(spark):
    df = people(spark, 0.5)
    got = regression.inverse_probability_weights(df, F.col("y").isNotNull(), ["x"]).toPandas()
    seen = got["y"].notna()
    assert (got.loc[~seen, "weight"] == 0).all() and got.loc[seen, "weight"].mean() == pytest.approx(1)
    # seen rows have too high an x; weighed, they look like all of them
    assert abs(got.loc[seen, "x"].mean()) > 0.25 and abs(np.average(got["x"], weights=got["weight"]) - got["x"].mean()) < 0.06
    assert got["weight"].max() <= 60
    all_seen = regression.inverse_probability_weights(df, F.lit(True), ["x"])
    assert {round(r.weight, 6) for r in all_seen.select("weight").distinct().collect()} == {1.0}
