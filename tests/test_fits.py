"""Fits, resamples and simulations against numpy on small tables, and the queries that have no SQL."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from touchline.functions import names, scale, seasons
from touchline.operators import models, resampling

SF = "/root/testdata/sf0.001"


def games(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    mh, ma = rng.uniform(0.6, 2.4, n).round(3), rng.uniform(0.5, 2.0, n).round(3)
    return mh, ma, rng.poisson(mh), rng.poisson(ma)


def test_rho(spark):
    mh, ma, h, a = games()
    df = spark.createDataFrame([(float(x), float(y), int(p), int(q)) for x, y, p, q in zip(mh, ma, h, a, strict=True)], "mu_home double, mu_away double, FTHG int, FTAG int").repartition(5)

    def loss(r):
        t = np.select([(h == 0) & (a == 0), (h == 0) & (a == 1), (h == 1) & (a == 0), (h == 1) & (a == 1)], [1 - mh * ma * r, 1 + mh * r, 1 + ma * r, np.full(len(h), 1 - r)], 1.0)
        return -np.log(t).sum()

    grid = np.linspace(-0.2, 0.2, 8001)
    assert models.fit_rho(df) == pytest.approx(grid[np.argmin([loss(r) for r in grid])], abs=2e-4)


def test_temperature(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([3, 2, 2], 2000)
    sharp = p**2 / (p**2).sum(axis=1, keepdims=True)  # the truth is sharper than what was said
    actual = [("H", "D", "A")[rng.choice(3, p=s)] for s in sharp]
    df = spark.createDataFrame([(*map(float, x), y) for x, y in zip(p, actual, strict=True)], "h double, d double, a double, y string").repartition(3)
    got = models.fit_temperature(df, "h", "d", "a", "y")

    def loss(t):
        q = p ** (1 / t)
        q /= q.sum(axis=1, keepdims=True)
        return -np.log(q[np.arange(len(q)), ["HDA".index(y) for y in actual]]).sum()

    grid = np.linspace(0.25, 4, 3001)
    assert got == pytest.approx(grid[np.argmin([loss(t) for t in grid])], abs=4e-3) and 0.4 < got < 0.65


def test_league_offsets_are_at_the_maximum(spark):
    rng = np.random.default_rng(5)
    true, rows = {"A": 0.0, "B": -0.4, "C": 0.3}, []
    for _ in range(800):
        x, y = rng.choice(list(true), 2, replace=False)
        mh, ma = rng.uniform(0.8, 2), rng.uniform(0.6, 1.6)
        gap = (true[x] - true[y]) / 2
        rows.append((str(x), str(y), float(mh), float(ma), int(rng.poisson(mh * math.exp(gap))), int(rng.poisson(ma * math.exp(-gap)))))
    found = models.league_offsets(spark.createDataFrame(rows, "League string, away_league string, mu_home double, mu_away double, FTHG int, FTAG int").repartition(4), "A", penalty=1e-9)
    assert found["A"] == 0 and found["B"] == pytest.approx(-0.4, abs=0.1) and found["C"] == pytest.approx(0.3, abs=0.1)

    def likelihood(x):
        total = 0.0
        for g, k, mh, ma, h, a in rows:
            half = (x[g] - x[k]) / 2
            total += h * half - mh * math.exp(half) - a * half - ma * math.exp(-half)
        return total

    best = likelihood(found)
    for league in "BC":
        for step in (-0.01, 0.01):
            assert likelihood(found | {league: found[league] + step}) < best


def test_paired_bootstrap(spark):
    x = np.random.default_rng(2).normal(0.1, 1.0, 5000).round(4)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, d double").repartition(6)
    got = resampling.paired_bootstrap(df, "d", 2000).first()
    error = x.std() / math.sqrt(len(x))
    assert got["mean"] == pytest.approx(x.mean()) and got["draws"] == 2000
    assert got["low"] == pytest.approx(x.mean() - 1.96 * error, abs=0.15 * error) and got["high"] == pytest.approx(x.mean() + 1.96 * error, abs=0.15 * error)
    assert resampling.paired_bootstrap(df.repartition(2), "d", 200).first()["low"] == pytest.approx(resampling.paired_bootstrap(df, "d", 200).first()["low"])


def test_season_simulation(spark):
    """Two matches are left: every chance is a sum over scores."""
    table = spark.createDataFrame([("L", "A", 10, 3), ("L", "B", 9, 0), ("L", "C", 5, -3)], "League string, Team string, points int, gd int")
    left = spark.createDataFrame([("L", "A", "C", 1.2, 0.9), ("L", "B", "C", 1.5, 0.7)], "League string, HomeTeam string, AwayTeam string, mu_home double, mu_away double")
    got = {r.Team: r for r in resampling.simulate_season(left, table, "League", 40_000, relegation=1).collect()}
    pmf = lambda m: [math.exp(-m) * m**k / math.factorial(k) for k in range(13)]
    want = {t: [0.0, 0.0] for t in "ABC"}
    for i, p in enumerate(pmf(1.2)):
        for j, q in enumerate(pmf(0.9)):
            for k, r in enumerate(pmf(1.5)):
                for m, s in enumerate(pmf(0.7)):
                    w = p * q * r * s
                    score = lambda x, y: 3 if x > y else 1 if x == y else 0
                    rows = {"A": (10 + score(i, j), 3 + i - j), "B": (9 + score(k, m), k - m), "C": (5 + score(j, i) + score(m, k), -3 + j - i + m - k)}
                    order = sorted(rows, key=lambda t: (-rows[t][0], -rows[t][1], t))
                    want[order[0]][0] += w
                    for t in "ABC":
                        want[t][1] += w * rows[t][0]
    for t in "ABC":
        assert got[t].title == pytest.approx(want[t][0], abs=0.012) and got[t].expected_points == pytest.approx(want[t][1], abs=0.05)
    assert sum(got[t].relegation for t in "ABC") == pytest.approx(1) and got["A"].top_four == 1


@pytest.mark.parametrize("name", ["rho_fit", "temperature_fit", "paired_bootstrap", "season_simulation", "goal_drivers", "boosted_goals", "edition_match", "configured_rating", "rho_by_league", "elo_head_backtest", "league_strength_fit", "rating_travel", "model_registry", "elo_with_ties", "similar_vectors"])
def test_queries_without_sql_run(spark, name):
    got = entry.queries()[name](spark, SF)
    assert got.count() > 0 and len(set(got.columns)) == len(got.columns)


def test_small_functions(spark):
    """Functions that no query calls."""
    df = spark.createDataFrame([("Łódź O'Neil-Straße", "ana maria lopez"), (None, None), ("大谷 Shohei", "pele")], "n string, k string")
    got = [r[0] for r in df.select(names.strip_foreign_script(F.col("n"))).collect()]
    assert got == ["Łódź O'Neil-Straße", None, "Shohei"]
    assert [r[0] for r in df.select(names.name_keys(F.col("k"))).collect()] == [["ana maria lopez", "ana lopez", "a lopez"], None, ["pele"]]
    two = spark.createDataFrame([(["a", "b"], ["a", "b", "c"]), (["a"], ["a", "b"]), (["a", "x"], ["a", "b"])], "a array<string>, b array<string>")
    assert [r[0] for r in two.select(names.token_subset(F.col("a"), F.col("b"))).collect()] == [True, False, False]
    assert names.humanise("home_points_last_5") == "home points last 5" and names.humanise("league_code") == "league code"
    pool = spark.createDataFrame([("p", 1.0, None), ("p", 2.0, None), ("p", 3.0, 1.0), ("q", None, 1.0)], "g string, x double, y double")
    gated = sorted((tuple(r) for r in scale.coverage_gate(pool, {"x": 1, "y": 1}, ["g"]).collect()), key=str)
    assert gated == [("p", 1.0, None), ("p", 2.0, None), ("p", 3.0, None), ("q", None, 1.0)]
    assert seasons.season_labels(1998, 2001) == ["9899", "9900", "0001", "0102"]


def test_paired_bootstrap_draws_equal_values_as_one(spark):
    """Three million rows of three values, and rows without one: the interval is that of the mean, and the nulls take no part."""
    n = 3_000_000
    x = F.when(F.col("id") % 4 != 3, (F.col("id") % 4).cast("double"))
    row = resampling.paired_bootstrap(spark.range(0, n, 1, 8).select("id", x.alias("d")), "d", 2000).first()
    error = math.sqrt(2 / 3 / (n * 0.75))
    assert row["mean"] == pytest.approx(1.0) and row["draws"] == 2000
    assert row["low"] == pytest.approx(1 - 1.96 * error, abs=0.3 * error) and row["high"] == pytest.approx(1 + 1.96 * error, abs=0.3 * error)
