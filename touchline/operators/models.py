"""Fits of goal models: each trial of a search is an aggregation in Spark, the driver sees sums only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.scoring import log_loss, temperature

RHO_BOUND = 0.2
TEMPERATURES = (0.25, 4.0)


def _grid_search(df: DataFrame, loss, low: float, high: float, points: int = 33, rounds: int = 3) -> float:
    """The minimum of a smooth loss: every round evaluates a whole grid in one aggregation."""
    best = low
    for _ in range(rounds):
        grid = np.linspace(low, high, points)
        row = df.agg(*[F.sum(loss(float(x))).alias(f"v{i}") for i, x in enumerate(grid)]).first()
        at = int(np.argmin([row[f"v{i}"] if row[f"v{i}"] is not None else 0.0 for i in range(points)]))
        best, step = float(grid[at]), (high - low) / (points - 1)
        low, high = max(low, best - step), min(high, best + step)
    return best


def fit_rho(df: DataFrame, mu_home: str = "mu_home", mu_away: str = "mu_away", home: str = "FTHG", away: str = "FTAG") -> float:
    """The low-score correction of greatest likelihood; only the four lowest scores depend on it."""
    h, a, x, y = F.col(home), F.col(away), F.col(mu_home), F.col(mu_away)

    def loss(rho: float) -> Column:
        tau = F.when((h == 0) & (a == 0), 1 - x * y * rho).when((h == 0) & (a == 1), 1 + x * rho).when((h == 1) & (a == 0), 1 + y * rho).when((h == 1) & (a == 1), 1 - F.lit(rho)).otherwise(F.lit(1.0))
        return -F.ln(F.greatest(tau, F.lit(1e-10)))

    return _grid_search(df.filter(h.isNotNull() & a.isNotNull()), loss, -RHO_BOUND, RHO_BOUND)


def fit_temperature(df: DataFrame, home: str, draw: str, away: str, actual: str) -> float:
    def loss(degree: float) -> Column:
        return log_loss(*temperature(F.col(home), F.col(draw), F.col(away), degree), F.col(actual))

    return _grid_search(df.filter(F.col(actual).isNotNull()), loss, *TEMPERATURES)


@dataclass
class GoalModel:
    """Two Poisson regressions, home and away goals."""

    features: Sequence[str]
    fills: dict[str, float]
    home: object
    away: object

    def predict(self, df: DataFrame) -> DataFrame:
        ready = _assembled(df, self.features, self.fills)
        ready = self.home.transform(ready).withColumnRenamed("prediction", "mu_home")
        return self.away.transform(ready).withColumnRenamed("prediction", "mu_away").drop("_x")


def _assembled(df: DataFrame, features: Sequence[str], fills: dict[str, float]) -> DataFrame:
    """A missing value becomes the median, and a flag beside it says so."""
    flags = {f"_{f}_missing": F.col(f).isNull().cast("double") for f in features}
    filled = {f"_{f}_filled": F.coalesce(F.col(f).cast("double"), F.lit(fills[f])) for f in features}
    return VectorAssembler(inputCols=[*filled, *flags], outputCol="_x").transform(df.withColumns({**filled, **flags})).drop(*filled, *flags)


def fit_goals(train: DataFrame, features: Sequence[str], home: str = "FTHG", away: str = "FTAG") -> GoalModel:
    """Features without any value are dropped; the rest are filled with their approximate median."""
    row = train.agg(*[F.percentile_approx(F.col(f).cast("double"), 0.5, 10_000).alias(f) for f in features]).first()
    used = [f for f in features if row[f] is not None]
    fills = {f: float(row[f]) for f in used}
    ready = _assembled(train, used, fills)
    fits = [GeneralizedLinearRegression(family="poisson", link="log", featuresCol="_x", labelCol=y, regParam=1e-3, maxIter=25).fit(ready.filter(F.col(y).isNotNull())) for y in (home, away)]
    return GoalModel(used, fills, *fits)


OUTCOMES = ("H", "D", "A")


def fit_outcome_head(train: DataFrame, features: Sequence[str], actual: str = "FTR"):
    """A three-way logistic fit on a few features; rows with a null among them or without a result take no part."""
    label = F.array_position(F.array(*[F.lit(o) for o in OUTCOMES]), F.col(actual)) - 1
    ready = train.select(*[F.col(f).cast("double").alias(f) for f in features], label.cast("double").alias("_y")).dropna().filter("_y >= 0")
    assembled = VectorAssembler(inputCols=list(features), outputCol="_x").transform(ready)
    return LogisticRegression(featuresCol="_x", labelCol="_y", family="multinomial", maxIter=100, regParam=0.0).fit(assembled)


def head_probabilities(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds ph, pd and pa; null where a feature is."""
    columns = {f"_h_{f}": F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features}
    whole = F.lit(True)
    for f in features:
        whole = whole & F.col(f).isNotNull()
    ready = VectorAssembler(inputCols=list(columns), outputCol="_x").transform(df.withColumns(columns))
    scored = model.setFeaturesCol("_x").setProbabilityCol("_p").setRawPredictionCol("_r").setPredictionCol("_g").transform(ready)
    return scored.withColumn("_a", vector_to_array("_p")).select(*df.columns, *[F.when(whole, F.col("_a")[i]).alias(n) for i, n in enumerate(("ph", "pd", "pa"))])


def walk_outcome_head(df: DataFrame, features: Sequence[str], least: int = 2000, season: str = "Season", date: str = "Date", scored: DataFrame | None = None, actual: str = "FTR") -> DataFrame:
    """Every season scored by a head fitted on the matches strictly before its first date.

    ``scored`` are the matches to forecast, ``df`` itself if None; they never enter a fit unless they are
    in ``df``, too.  Seasons with fewer than ``least`` earlier results, or not all three outcomes among
    them, are left out.  The loop is over seasons; every fit is distributed.
    """
    scored = df if scored is None else scored
    firsts = scored.groupBy(season).agg(F.min(date).alias("first")).orderBy("first").collect()
    out = scored.withColumns({n: F.lit(None).cast("double") for n in ("ph", "pd", "pa")}).limit(0)
    for row in firsts:
        train = df.filter((F.col(date) < row["first"]) & F.col(actual).isNotNull())
        n, kinds = train.agg(F.count(F.lit(1)), F.countDistinct(actual)).first()
        if n >= least and kinds == len(OUTCOMES):
            out = out.unionByName(head_probabilities(fit_outcome_head(train, features, actual), scored.filter(F.col(season) == row[season]), features))
    return out


def league_offsets(df: DataFrame, pinned: str, penalty: float = 1.0, steps: int = 30) -> dict[str, float]:
    """Strength of every league against a pinned one, from goals and rates of cross-league ties.

    Goals of the home league are Poisson with rate mu * exp(half the gap), the away league's with
    the opposite sign.  Sums per pair of leagues suffice; the driver solves by Newton's method.
    """
    pairs = df.groupBy("League", "away_league").agg(F.sum("FTHG").alias("gh"), F.sum("mu_home").alias("mh"), F.sum("FTAG").alias("ga"), F.sum("mu_away").alias("ma")).collect()
    names = sorted({r["League"] for r in pairs} | {r["away_league"] for r in pairs})
    index, x = {n: i for i, n in enumerate(names)}, np.zeros(len(names))
    for _ in range(steps):
        grad, hess = -penalty * x, -penalty * np.eye(len(names))
        for r in pairs:
            i, j = index[r["League"]], index[r["away_league"]]
            half = (x[i] - x[j]) / 2
            up, down = r["mh"] * np.exp(half), r["ma"] * np.exp(-half)
            g, h = (r["gh"] - up - r["ga"] + down) / 2, -(up + down) / 4
            grad[i] += g
            grad[j] -= g
            for a, b, s in ((i, i, 1), (j, j, 1), (i, j, -1), (j, i, -1)):
                hess[a, b] += s * h
        x = x - np.linalg.solve(hess, grad)
    base = x[index[pinned]] if pinned in index else 0.0
    return {n: float(x[index[n]] - base) for n in names}


def stratum_fits(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by, n, intercept, a slope an x, r_squared) of the fit of y on several x within each stratum.

    Rows with a null among them take no part; r_squared is null where y does not vary.
    """
    whole = df.select(*by, *[F.col(c).cast("double").alias(c) for c in [y, *xs]]).dropna(subset=[y, *xs])
    fitted = residualise(whole, y, xs, by, beta="_beta")
    total = F.sum(F.pow(F.col(y), 2)) - F.pow(F.sum(y), 2) / F.count(y)
    left = F.sum(F.pow(F.col("residual"), 2))
    slopes = [F.first(F.col("_beta")[i + 1]).alias(f"slope_{x}") for i, x in enumerate(xs)]
    return fitted.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.first(F.col("_beta")[0]).alias("intercept"), *slopes, F.when(total > 1e-9, 1 - left / total).alias("r_squared"))


def residualise(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str], beta: str | None = None) -> DataFrame:
    """Adds the residual of y on several x within each stratum, and its coefficients as ``beta`` if asked for.

    Strata are reduced to moments before anything is solved, so their size does not matter.
    """
    import pandas as pd

    columns = ["_one", *xs]
    base = df.withColumn("_one", F.lit(1.0))
    moments = [F.sum(F.col(a) * F.col(b)).alias(f"m{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns)]
    sums = base.groupBy(*by).agg(*moments, *[F.sum(F.col(a) * F.col(y)).alias(f"r{i}") for i, a in enumerate(columns)])
    n = len(columns)

    def solve(frames):
        for frame in frames:
            beta = [np.linalg.lstsq(np.array([[r[f"m{i}_{j}"] for j in range(n)] for i in range(n)], float), np.array([r[f"r{i}"] for i in range(n)], float), rcond=None)[0].tolist() for _, r in frame.iterrows()]
            yield pd.concat([frame[list(by)].reset_index(drop=True), pd.Series(beta, name="_beta", dtype=object)], axis=1)

    kind = ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in by) + ", _beta array<double>"
    fitted = base.join(sums.mapInPandas(solve, kind), list(by))
    line = sum((F.col("_beta")[i] * F.col(c) for i, c in enumerate(columns)), F.lit(0.0))
    out = fitted.withColumn("residual", F.col(y) - line).drop("_one")
    return out.withColumnRenamed("_beta", beta) if beta else out.drop("_beta")
