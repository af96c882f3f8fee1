"""Corrections by league and by goals expected, against plain numpy fits of each fold."""

import math

import numpy as np
import pandas as pd
import pytest

from touchline.operators import conditional_rho as cr


def matches(n=6000, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        league = ["A", "B", "C"][min(2, i % 7 % 3)] if i % 50 else "tiny"
        mh, ma = rng.uniform(0.5, 2.2), rng.uniform(0.4, 1.8)
        rho = {"A": -0.15, "B": 0.05, "C": -0.05, "tiny": 0.0}[league]
        while True:  # draw by rejection
            h, a = rng.poisson(mh), rng.poisson(ma)
            t = {(0, 0): 1 - mh * ma * rho, (0, 1): 1 + mh * rho, (1, 0): 1 + ma * rho, (1, 1): 1 - rho}.get((h, a), 1.0)
            if rng.random() < t / 1.6:
                break
        rows.append((i, league, 2000 + i * 4 // n, int(h), int(a), mh, ma, "H" if h > a else "A" if h < a else "D"))
    return pd.DataFrame(rows, columns=["match_id", "League", "start", "FTHG", "FTAG", "mu_home", "mu_away", "FTR"])


def nll(f, rho):
    h, a, m, n = (f[c].to_numpy() for c in ("FTHG", "FTAG", "mu_home", "mu_away"))
    t = np.select([(h == 0) & (a == 0), (h == 0) & (a == 1), (h == 1) & (a == 0), (h == 1) & (a == 1)], [1 - m * n * rho, 1 + m * rho, 1 + n * rho, np.broadcast_to(1 - rho, m.shape)], 1.0)
    return -np.log(np.maximum(t, 1e-10)).sum()


def best(f):
    grid = np.linspace(-0.2, 0.2, 4001)
    return grid[int(np.argmin([nll(f, g) for g in grid]))]


@pytest.fixture(scope="module")
def data():
    return matches()


@pytest.fixture(scope="module")
def folds(spark, data):
    more = pd.DataFrame([(-1, "late", 2003, 1, 1, 1.0, 1.0, "D"), (-2, "A", 2002, 0, 0, np.nan, 1.0, "D")], columns=data.columns)
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in pd.concat([data, more]).itertuples(index=False, name=None)]
    df = spark.createDataFrame(rows, "match_id long, League string, start int, FTHG int, FTAG int, mu_home double, mu_away double, FTR string").repartition(4)
    return df, cr.fold_corrections(df, 300).toPandas()


def test_fits_of_every_fold(data, folds):
    table = folds[1].set_index(["League", "start"])
    assert set(table.index.get_level_values("start")) == {2001, 2002, 2003}
    for start in (2001, 2002, 2003):
        train = data[data["start"] < start]
        pooled = best(train)
        counts, per, var = {}, {}, {}
        for league, group in train.groupby("League"):
            counts[league] = len(group)
            per[league] = best(group) if len(group) >= 300 else pooled
            row = table.loc[league, start]
            assert row["pooled"] == pytest.approx(pooled, abs=4e-4) and row["per_league"] == pytest.approx(per[league], abs=4e-4) and row["n"] == len(group)
            step = 5e-3
            bend = (nll(group, per[league] + step) - 2 * nll(group, per[league]) + nll(group, per[league] - step)) / step**2
            var[league] = 1 / bend
            assert row["variance"] == pytest.approx(var[league], rel=0.05)
        total = sum(counts.values())
        tau2 = max(0.0, sum(counts[g] / total * ((per[g] - pooled) ** 2 - var[g]) for g in counts))
        for g in counts:
            assert table.loc[g, start]["shrunk"] == pytest.approx(pooled + tau2 / (tau2 + var[g]) * (per[g] - pooled) if tau2 else pooled, abs=2e-3)
    late = table.loc["late", 2003]
    assert late["n"] == 0 and late["shrunk"] == late["per_league"] == late["pooled"]
    assert table.loc["tiny", 2003]["per_league"] == table.loc["tiny", 2003]["pooled"]
    # linear in the goals expected: no worse than the pooled one on its own training rows
    train = data[data["start"] < 2003]
    line = table.loc["A", 2003]
    rho = np.clip(line["line_at"] + line["line_slope"] * (train["mu_home"] + train["mu_away"] - cr.CENTRE), -0.2, 0.2).to_numpy()
    assert nll(train, rho) <= nll(train, best(train)) + 0.05


def test_scores_of_the_arms(data, folds):
    got = cr.walk(folds[0].filter("match_id >= 0"), 300).toPandas()
    assert len(got) == 4 * (data["start"] > 2000).sum() and set(got["arm"]) == set(cr.ARMS)
    for r in got.sample(60, random_state=1).itertuples():
        h = np.array([math.exp(-r.mu_home) * r.mu_home**k / math.factorial(k) for k in range(11)])
        a = np.array([math.exp(-r.mu_away) * r.mu_away**k / math.factorial(k) for k in range(11)])
        grid = np.outer(h, a)
        for (i, j), t in {(0, 0): 1 - r.mu_home * r.mu_away * r.rho, (0, 1): 1 + r.mu_home * r.rho, (1, 0): 1 + r.mu_away * r.rho, (1, 1): 1 - r.rho}.items():
            grid[i, j] *= max(t, 1e-10)
        grid /= grid.sum()
        assert r.loglik == pytest.approx(math.log(grid[min(r.FTHG, 10), min(r.FTAG, 10)] + 1e-12), abs=1e-4)
        home, draw = np.tril(grid, -1).sum(), np.trace(grid)
        first, second = home - (r.FTR == "H"), home + draw - (r.FTR in ("H", "D"))
        assert r.rps == pytest.approx((first**2 + second**2) / 2, abs=1e-5)
        assert r.exact == (np.unravel_index(grid.argmax(), grid.shape) == (r.FTHG, r.FTAG))
    mean = got.groupby("arm")["loglik"].mean()
    assert mean["per_league"] > mean["production"] and mean["shrunk"] > mean["production"]


def test_matches_are_scored_in_batches_by_many_tasks(spark):
    cols = "match_id long, mu_home double, mu_away double, FTHG int, FTAG int, FTR string, " + ", ".join(f"rho_{a} double" for a in cr.ARMS)
    df = spark.createDataFrame([(1, 1.4, 1.1, 1, 1, "D", *[0.1] * 4), (2, 1.4, 1.1, None, 1, None, *[0.1] * 4), (3, None, 1.1, 0, 1, "A", *[0.1] * 4)], cols).coalesce(1)
    kind = "match_id long, arm string, rho double, loglik double, rps double, exact boolean"
    got = {(r.match_id, r.arm): r for r in df.mapInArrow(lambda b: cr.score_arms(b, ["match_id"]), kind).collect()}
    own = math.exp(-2.5) * 1.4 * 1.1 * 0.9
    assert len(got) == 12 and got[1, "shrunk"].loglik == pytest.approx(math.log(own + 1e-12)) and got[1, "shrunk"].exact is False
    assert (got[2, "shrunk"].loglik, got[2, "shrunk"].exact) == (None, None) and got[2, "shrunk"].rps is not None
    assert (got[3, "shrunk"].loglik, got[3, "shrunk"].rps, got[3, "shrunk"].exact) == (None, None, None)


def test_later_seasons_change_nothing_before(spark, data, folds):
    df = folds[0]
    twisted = df.selectExpr("match_id", "League", "start", "if(start = 2003, 0, FTHG) AS FTHG", "if(start = 2003, 0, FTAG) AS FTAG", "mu_home", "mu_away", "FTR")
    a, b = (cr.fold_corrections(x, 300).filter("start <= 2003").orderBy("League", "start").toPandas().round(9) for x in (df, twisted))
    assert a.equals(b)


def test_the_guard(spark):
    train, fold = spark.createDataFrame([(1,), (2,), (None,)], "match_id long"), spark.createDataFrame([(3,), (None,)], "match_id long")
    with pytest.raises(cr.FoldLeakError, match="1 rows"):
        cr.fit_within_fold(train, fold, lambda t: 0.0)
    assert cr.fit_within_fold(train, fold.filter("match_id = 3"), lambda t: t.count()) == 3


def test_shrinking(spark):
    df = spark.createDataFrame([("f", "a", 0.1, 0.0, 10, 0.001), ("f", "b", -0.1, 0.0, 30, 0.004), ("g", "a", 0.01, 0.0, 10, 0.5), ("h", "a", 0.1, 0.0, 5, float("inf"))], "fold string, g string, v double, p double, n long, var double")
    got = {(r.fold, r.g): r.out for r in cr.shrink(df, ["fold"], "v", "p", "n", "var", "out").collect()}
    tau2 = 0.01 - (10 * 0.001 + 30 * 0.004) / 40
    assert got["f", "a"] == pytest.approx(0.1 * tau2 / (tau2 + 0.001)) and got["f", "b"] == pytest.approx(-0.1 * tau2 / (tau2 + 0.004))
    assert got["g", "a"] == 0.0 and got["h", "a"] == 0.0
