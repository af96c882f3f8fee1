"""Least squares with bootstrap from sums alone, and what its intervals allow to say.

All draws come from one pass: a row (or all rows of a cluster) has a Poisson count in each draw, from
a hash of its key and the draw, so that a draw does not depend on how rows are dealt.  Tasks
multiply their rows' products with the counts and Spark adds up; the driver solves one small system a
draw.  Its size is that of the parameters: draws times the square of the columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sums that the driver may hold, in numbers of eight bytes.
MOST_SUMS = 20_000_000
SEED = 7
_CUTS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


def poisson_counts(keys: np.ndarray, draws: np.ndarray, seed: int) -> np.ndarray:
    """(keys, draws) counts of mean 1, a function of key, draw and seed only."""
    x = keys.astype(np.int64).view(np.uint64)[:, None] ^ ((draws.astype(np.uint64)[None, :] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xD1B54A32D192ED03 % 2**64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return np.searchsorted(_CUTS, (x >> np.uint64(11)).astype(np.float64) * 2.0**-53, "right").astype(np.float64)


def gram_draws(df: DataFrame, columns: Sequence[str], y: str, draws: int, cluster: Sequence[str], weight: str | None = None, seed: int = SEED) -> np.ndarray:
    """(draws + 1, columns + 1, columns + 1) sums of products of the columns and y; the first is not resampled.

    Rows with a null among them are left out; a null weight counts as 0.
    """
    names = [*columns, y]
    p = len(names)
    upper = np.triu_indices(p)
    if (draws + 1) * len(upper[0]) > MOST_SUMS:
        raise ValueError(f"{draws} draws of {p} columns are more sums than the driver should hold")
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    rows = df.select(F.xxhash64(*[part for c in cluster for part in (F.col(c).isNull(), F.col(c))]).alias("_key"), w.alias("_w"), *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(names)]).dropna()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((draws + 1, len(upper[0])))
        for batch in batches:
            key, weights = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = np.stack([batch.column(2 + i).to_numpy() for i in range(p)], axis=1)
            products = x[:, upper[0]] * x[:, upper[1]] * weights[:, None]
            total[0] += products.sum(axis=0)
            for start in range(0, draws, 200):
                part = np.arange(start, min(draws, start + 200))
                total[1 + part] += poisson_counts(key, part, seed).T @ products
        cells = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "value"])

    found = rows.mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    flat = np.zeros((draws + 1) * len(upper[0]))
    flat[found.column(0).to_numpy()] = found.column(1).to_numpy()
    out = np.zeros((draws + 1, p, p))
    out[:, upper[0], upper[1]] = flat.reshape(draws + 1, -1)
    out[:, upper[1], upper[0]] = out[:, upper[0], upper[1]]
    return out


def solve(grams: np.ndarray) -> np.ndarray:
    """Coefficients of each draw: those of least norm where columns depend on each other."""
    return np.stack([np.linalg.lstsq(g[:-1, :-1], g[:-1, -1], rcond=None)[0] for g in grams])


def r_squared(gram: np.ndarray, beta: np.ndarray, intercept: int = 0) -> float:
    """Share of y's variance that a fit with its constant in column ``intercept`` explains."""
    yy, n, total = gram[-1, -1], gram[intercept, intercept], gram[intercept, -1]
    spread = yy - total**2 / n if n else 0.0
    left = yy - 2 * beta @ gram[:-1, -1] + beta @ gram[:-1, :-1] @ beta
    return float(1 - left / spread) if spread > 1e-12 * max(yy, 1e-300) else float("nan")


def league_strength(matches: DataFrame, reference: str, draws: int = 1000, interval: float = 0.9, seed: int = SEED, key: Sequence[str] = ("match_id",)) -> DataFrame:
    """league, strength, low, high, n_matches: goals a match against ``reference``, from matches of two leagues' clubs.

    ``matches`` has home_league, away_league, FTHG and FTAG.  A match counts 1 for the home side's
    league, -1 for the away side's and 1 for home advantage, which has a row of its own; matches
    within a league tell of that alone.  The bounds are quantiles of ``draws`` resamples (null with
    none).  Without two leagues the result is empty.  Leagues are columns of the fit, so their number
    is bounded by the sums that the driver may hold.
    """
    spark = matches.sparkSession
    usable = matches.filter("home_league is not null and away_league is not null and FTHG is not null and FTAG is not null")
    schema = "league string, strength double, low double, high double, n_matches long"
    sides = usable.select("home_league", "away_league", F.explode(F.array_distinct(F.array("home_league", "away_league"))).alias("league"))
    counts = {r["league"]: r["n"] for r in sides.groupBy("league").agg(F.sum((F.col("home_league") != F.col("away_league")).cast("long")).alias("n")).collect()}
    if len(counts) < 2:
        return spark.createDataFrame([], schema)
    others = sorted(set(counts) - {reference})
    design = usable.select(*key, F.lit(1.0).alias("_home"), (F.col("FTHG") - F.col("FTAG")).alias("_gd"), *[((F.col("home_league") == g).cast("int") - (F.col("away_league") == g).cast("int")).alias(f"_l{i}") for i, g in enumerate(others)])
    grams = gram_draws(design, [*[f"_l{i}" for i in range(len(others))], "_home"], "_gd", draws, key, seed=seed)
    beta = solve(grams)
    tail = 50 * (1 - interval)
    bounds = np.percentile(beta[1:], [tail, 100 - tail], axis=0) if draws else np.full((2, beta.shape[1]), np.nan)
    total = int(grams[0, len(others), len(others)])
    rows = [(reference, 0.0, 0.0, 0.0, counts.get(reference, 0))]
    for i, name in enumerate([*others, "home_advantage"]):
        n = counts[name] if i < len(others) else total
        rows.append((name, float(beta[0, i]), *[None if math.isnan(b) else float(b) for b in bounds[:, i]], n))
    return spark.createDataFrame(rows, schema)


def fieller(numerator: np.ndarray, denominator: np.ndarray, alpha: float = 0.05) -> tuple[float, float]:
    """Interval of a ratio of means from paired draws; unbounded where the denominator may be zero."""
    a, b = np.asarray(numerator, float), np.asarray(denominator, float)
    cov = np.cov(a, b)
    t = NormalDist().inv_cdf(1 - alpha / 2)
    ratio, g = a.mean() / b.mean(), t**2 * cov[1, 1] / b.mean() ** 2
    if g >= 1 or cov[1, 1] == 0:
        half = t * math.sqrt(cov[0, 0]) / abs(b.mean()) if g < 1 else math.inf
        return (ratio - half, ratio + half) if g < 1 else (-math.inf, math.inf)
    inner = cov[0, 0] - 2 * ratio * cov[0, 1] + ratio**2 * cov[1, 1] - g * (cov[0, 0] - cov[0, 1] ** 2 / cov[1, 1])
    if inner < 0:
        return -math.inf, math.inf
    middle, half = ratio - g * cov[0, 1] / cov[1, 1], t / abs(b.mean()) * math.sqrt(inner)
    return (middle - half) / (1 - g), (middle + half) / (1 - g)


def ratio_is_interpretable(denominator: np.ndarray, most: float = 0.025) -> bool:
    """Whether the draws of a denominator keep their sign, but for a share of ``most``."""
    d = np.asarray(denominator, float)
    d = d[np.isfinite(d)]
    return bool(len(d)) and min((d > 0).mean(), (d < 0).mean()) <= most


def verdict(delta: tuple[float, float], ratio: float, ratio_interval: tuple[float, float], base: tuple[float, float], bounds: tuple[float, float]) -> str:
    """uninformative, contamination, equivalent or inconclusive; the base slope's interval decides first.

    Equivalence needs the ratio's interval inside the bounds; one that merely holds 1 shows nothing.
    """
    if base[0] <= 0 <= base[1]:
        return "uninformative"
    if not delta[0] <= 0 <= delta[1] and ratio < bounds[0]:
        return "contamination"
    return "equivalent" if bounds[0] <= ratio_interval[0] and ratio_interval[1] <= bounds[1] else "inconclusive"


def inverse_probability_weights(df: DataFrame, seen: Column, features: Sequence[str], out: str = "weight", least: float = 0.02) -> DataFrame:
    """Adds 1 / P(seen | features) to the rows that are seen, 0 to the others.

    P comes from a logistic fit on all rows; a missing feature counts as its mean, with a flag.
    Probabilities below ``least`` are raised to it, so that no row weighs more than 1 / ``least``.  The
    weights average 1 over the seen rows.
    """
    means = df.agg(*[F.avg(F.col(f).cast("double")).alias(f"m{i}") for i, f in enumerate(features)]).first()
    parts = {}
    for i, f in enumerate(features):
        parts[f"_f{i}"] = F.coalesce(F.col(f).cast("double"), F.lit(float(means[i] or 0.0)))
        parts[f"_g{i}"] = F.col(f).isNull().cast("double")
    ready = VectorAssembler(inputCols=list(parts), outputCol="_x").transform(df.withColumns(parts | {"_seen": seen.cast("double")}))
    fit = LogisticRegression(featuresCol="_x", labelCol="_seen", maxIter=50, regParam=1e-6, probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_guess").fit(ready)
    p = vector_to_array("_p")
    scored = fit.transform(ready).withColumn("_share", F.greatest(p[1] if fit.numClasses > 1 else F.lit(1.0), F.lit(least)))
    scored = scored.withColumn(out, F.when(F.col("_seen") == 1, 1 / F.col("_share")).otherwise(0.0))
    mean = scored.agg(F.sum(out) / F.sum("_seen")).first()[0] or 1.0
    return scored.withColumn(out, F.col(out) / mean).select(*df.columns, out)


def travel(df: DataFrame, outcome: str, predictor: str, mover: str, controls: Sequence[str], fixed: Sequence[str], cluster: Sequence[str], bounds: tuple[float, float], draws: int = 1000, weight: str | None = None, seed: int = SEED) -> dict:
    """Whether a predictor's slope on the outcome is the same for those who moved: slopes, intervals, verdict.

    One model: constant, predictor, mover, their product, controls and a column for each value but the
    first of the ``fixed`` effects, whose number must be small.  Clusters are resampled whole, so that
    rows of one player do not count as independent.
    """
    base = df.filter(F.col(outcome).isNotNull() & F.col(predictor).isNotNull() & F.col(mover).isNotNull())
    columns = {"_one": F.lit(1.0), "_x": F.col(predictor), "_m": F.col(mover).cast("double"), "_xm": F.col(predictor) * F.col(mover).cast("double")}
    columns |= {f"_c{i}": F.col(c) for i, c in enumerate(controls)}
    for i, f in enumerate(fixed):
        values = sorted(r[0] for r in base.select(f).distinct().filter(F.col(f).isNotNull()).collect())
        columns |= {f"_f{i}_{j}": F.coalesce(F.col(f) == v, F.lit(False)).cast("double") for j, v in enumerate(values) if j}
    design = base.select(*cluster, *([weight] if weight else []), F.col(outcome).alias("_y"), *[c.cast("double").alias(n) for n, c in columns.items()])
    grams = gram_draws(design, list(columns), "_y", draws, cluster, weight, seed)
    beta = solve(grams)
    stayer, delta = beta[:, 1], beta[:, 3]
    mover_slope = stayer + delta
    interval = lambda v: tuple(float(x) for x in np.percentile(v[1:], [2.5, 97.5]))
    ratio = float(mover_slope[0] / stayer[0]) if stayer[0] else float("nan")
    clear = ratio_is_interpretable(stayer[1:])
    ratio_interval = fieller(mover_slope[1:], stayer[1:]) if clear else (-math.inf, math.inf)
    return {
        "stayer": float(stayer[0]), "stayer_low": interval(stayer)[0], "stayer_high": interval(stayer)[1], "delta": float(delta[0]), "delta_low": interval(delta)[0], "delta_high": interval(delta)[1],
        "ratio": ratio if clear else None, "ratio_low": ratio_interval[0], "ratio_high": ratio_interval[1], "r_squared": r_squared(grams[0], beta[0]), "verdict": verdict(interval(delta), ratio, ratio_interval, interval(stayer), bounds),
    }
