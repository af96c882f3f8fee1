"""A low-score correction that depends on the league or on the goals expected, walked forward over seasons.

The correction touches four scores only and takes no mass from the others, so its likelihood is a sum
over the matches that ended in one of them.  That sum is taken once, for every season, league and point
of a grid; what a fold may know is the sum over the seasons before it.  So all folds and leagues are fitted by
one aggregation, and no fold's own results can reach its fit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from touchline.functions.scoreline import MAX_GOALS, corrected

#: Grid of the correction; its step is that of the curvature, too.
BOUND, STEP = 0.2, 0.005
#: Grid of the linear form: the correction at ``CENTRE`` goals, and its slope by goals.
LINE, SLOPE, CENTRE = (-0.2, 0.2, 33), (-0.1, 0.1, 9), 2.7
#: A league of fewer matches before the fold takes the pooled correction.
MIN_FIT_ROWS = 500
ARMS = ("production", "per_league", "shrunk", "per_lambda")


class FoldLeakError(RuntimeError):
    """A fit was handed rows of the fold that it is to score."""


def fit_within_fold(train: DataFrame, scored: DataFrame, fitter, key: Sequence[str] = ("match_id",)):
    """``fitter(train)``, refused if any row of ``train`` is in the fold; null keys count as equal."""
    known = scored.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).distinct()
    match = F.lit(True)
    for i, k in enumerate(key):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    shared = train.join(known, match, "left_semi").count()
    if shared:
        raise FoldLeakError(f"{shared} rows are both in the training frame and in the fold")
    return fitter(train)


def _profile(df: DataFrame, points: Sequence[tuple[float, float]]) -> DataFrame:
    """(League, start, k, loss): the part of the loss that depends on the correction, at each point."""
    low = df.filter((F.col("FTHG") <= 1) & (F.col("FTAG") <= 1))
    grid = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for k, (a, b) in enumerate(points)])
    at = low.select("League", "start", "FTHG", "FTAG", "mu_home", "mu_away", F.explode(grid).alias("g"))
    total = F.col("mu_home") + F.col("mu_away")
    rho = F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.col("g.a") + F.col("g.b") * (total - CENTRE)))
    loss = -F.ln(corrected(F.col("FTHG"), F.col("FTAG"), F.col("mu_home"), F.col("mu_away"), rho))
    return at.groupBy("League", "start", F.col("g.k").alias("k")).agg(F.sum(loss).alias("loss"))


def _before(folds: DataFrame, sums: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Sums over the seasons strictly before each fold; the tables hold a row a season, not a match."""
    past = sums.withColumnRenamed("start", "past")
    on = [k for k in keys if k in folds.columns and k != "start"]
    met = folds.join(past, on) if on else folds.crossJoin(F.broadcast(past))
    return met.filter("past < start").groupBy("start", *keys).agg(*[F.sum(v).alias(v) for v in values])


def _refined(losses: Column, at: Column, low: float, step: float) -> Column:
    """The minimum near index ``at`` (from 0) of an array of losses, by the parabola through its neighbours."""
    left, mid, right = (F.get(losses, at + d) for d in (-1, 0, 1))
    bend = left - 2 * mid + right
    shift = F.when(bend > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (left - right) / (2 * bend)))).otherwise(0.0)
    return F.lit(low) + F.lit(step) * (at + F.coalesce(shift, F.lit(0.0)))


def _variance(losses: Column, rho: Column) -> Column:
    """Inverse curvature of the loss near ``rho``; infinite where it does not bend upwards."""
    at = F.greatest(F.lit(1), F.least(F.size(losses) - 2, F.round((rho + BOUND) / STEP).cast("int")))
    bend = (F.get(losses, at - 1) - 2 * F.get(losses, at) + F.get(losses, at + 1)) / STEP**2
    return F.when(bend > 0, 1 / bend).otherwise(F.lit(float("inf")))


def _listed(sums: DataFrame, keys: Sequence[str], points: int) -> DataFrame:
    """(keys, losses): an array by point; a point without a row is 0.  ``points`` values a group."""
    pairs = F.map_from_entries(F.collect_list(F.struct("k", "loss")))
    by = sums.groupBy(*keys).agg(pairs.alias("m"))
    return by.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.coalesce(F.col("m")[k], F.lit(0.0))).alias("losses"))


def _least(losses: Column) -> Column:
    return (F.array_position(losses, F.array_min(losses)) - 1).cast("int")


def shrink(df: DataFrame, by: Sequence[str], value: str, pooled: str, count: str, variance: str, out: str) -> DataFrame:
    """Adds ``value`` drawn towards ``pooled``: by tau2 / (tau2 + variance), tau2 the spread beyond the variances.

    The spread within ``by`` is weighted by ``count``.  Where the variances explain all of it, the
    pooled value stands.
    """
    weights = df.groupBy(*by).agg(F.sum(count).alias("_total"), F.sum(F.col(count) * F.pow(F.col(value) - F.col(pooled), 2)).alias("_spread"), F.sum(F.col(count) * F.col(variance)).alias("_within"))
    extra = F.greatest(F.lit(0.0), (F.col("_spread") - F.col("_within")) / F.col("_total"))
    joined = df.join(weights.select(*by, extra.alias("_tau2")), list(by))
    part = F.when(F.col("_tau2") > 0, F.col("_tau2") / (F.col("_tau2") + F.col(variance))).otherwise(0.0)
    return joined.withColumn(out, F.col(pooled) + part * (F.col(value) - F.col(pooled))).drop("_tau2")


def fold_corrections(df: DataFrame, least: int = MIN_FIT_ROWS) -> DataFrame:
    """(League, start, n, pooled, own, per_league, variance, shrunk, line_at, line_slope) of every fold but the first.

    ``df``: League, start (the year a season starts), FTHG, FTAG, mu_home, mu_away; rows with a null among them
    take no part.  ``n`` counts the league's matches before the fold; a league without any takes the
    pooled value.
    """
    usable = df.select("League", "start", "FTHG", "FTAG", "mu_home", "mu_away").dropna()
    points = int(round(2 * BOUND / STEP)) + 1
    flat = [(-BOUND + STEP * k, 0.0) for k in range(points)]
    folds = usable.select("League", "start").distinct()
    starts = folds.select("start").distinct()
    sums = _profile(usable, flat)
    counts = _before(folds, usable.groupBy("League", "start").agg(F.count(F.lit(1)).alias("n")), ["League"], ["n"])
    own = _listed(_before(folds, sums, ["League", "k"], ["loss"]), ["start", "League"], points)
    pooled = _listed(_before(starts, sums.groupBy("start", "k").agg(F.sum("loss").alias("loss")), ["k"], ["loss"]), ["start"], points)
    pooled = pooled.select("start", _refined(F.col("losses"), _least(F.col("losses")), -BOUND, STEP).alias("pooled"))

    line = [(a, b) for a in np.linspace(*LINE) for b in np.linspace(*SLOPE)]
    lines = _listed(_before(starts, _profile(usable, line).groupBy("start", "k").agg(F.sum("loss").alias("loss")), ["k"], ["loss"]), ["start"], len(line))
    best, width = _least(F.col("losses")), SLOPE[2]
    row, column = F.floor(best / width).cast("int"), (best % width).cast("int")
    across = F.transform(F.sequence(F.lit(0), F.lit(LINE[2] - 1)), lambda i: F.get(F.col("losses"), (i * width + column).cast("int")))
    down = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.get(F.col("losses"), (row * width + j).cast("int")))
    spacing = [(b - a) / (n - 1) for a, b, n in (LINE, SLOPE)]
    lines = lines.select("start", _refined(across, row, LINE[0], spacing[0]).alias("line_at"), _refined(down, column, SLOPE[0], spacing[1]).alias("line_slope"))

    table = folds.join(pooled, "start").join(lines, "start").join(counts, ["start", "League"], "left").join(own, ["start", "League"], "left")
    table = table.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("own", _refined(F.col("losses"), _least(F.col("losses")), -BOUND, STEP))
    table = table.withColumn("per_league", F.when((F.col("n") >= least) & F.col("own").isNotNull(), F.col("own")).otherwise(F.col("pooled")))
    table = table.withColumn("variance", F.coalesce(_variance(F.col("losses"), F.col("per_league")), F.lit(float("inf")))).drop("losses")
    known = shrink(table.filter("n > 0"), ["start"], "per_league", "pooled", "n", "variance", "shrunk")
    return known.unionByName(table.filter("n = 0").withColumn("shrunk", F.col("pooled"))).select("League", "start", "n", "pooled", "own", "per_league", "variance", "shrunk", "line_at", "line_slope")


def score_arms(batches: Iterator[pa.RecordBatch], kept: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """A row for each match and arm of ``ARMS``: ``kept``, arm, rho, loglik, rps, exact; a null input leaves nulls.

    All matches of a batch are scored at once, on the grid of 0 to ``MAX_GOALS`` goals a side; of equally
    likely scores the first stands, by home goals and then away goals.
    """
    k = np.arange(MAX_GOALS + 1)
    factorials = np.array([float(math.factorial(i)) for i in k])
    for whole in batches:
        for start in range(0, whole.num_rows, 2000):
            batch = whole.slice(start, 2000)
            number = lambda c, batch=batch: batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
            m, n = number("mu_home"), number("mu_away")
            h, a = np.minimum(number("FTHG"), MAX_GOALS), np.minimum(number("FTAG"), MAX_GOALS)
            result = np.array(batch.column("FTR").to_pylist(), dtype=object)
            x, y = (np.exp(-mu)[:, None] * mu[:, None] ** k / factorials for mu in (m, n))
            scored = ~(np.isnan(h) | np.isnan(a))
            at = np.arange(len(m)), np.where(scored, h, 0).astype(int), np.where(scored, a, 0).astype(int)
            for arm in ARMS:
                rho = number(f"rho_{arm}")
                cells = x[:, :, None] * y[:, None, :]
                cells[:, [0, 0, 1, 1], [0, 1, 0, 1]] *= np.maximum(np.stack([1 - m * n * rho, 1 + m * rho, 1 + n * rho, 1 - rho], axis=1), 1e-10)
                total = cells.sum(axis=(1, 2))
                home, draw = np.tril(cells, -1).sum(axis=(1, 2)) / total, np.trace(cells, axis1=1, axis2=2) / total
                first, second = home - (result == "H"), home + draw - (result == "H") - (result == "D")
                own = np.where(scored, cells[at], np.nan)
                best = cells.reshape(len(m), -1).argmax(axis=1)
                exact = (best // len(k) == at[1]) & (best % len(k) == at[2])
                made = [pa.array([arm] * len(m)), *[pa.array(v, from_pandas=True) for v in (rho, np.log(own + 1e-12), (first * first + second * second) / 2)], pa.array(exact, mask=np.isnan(own))]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + made, [*kept, "arm", "rho", "loglik", "rps", "exact"])


def walk(df: DataFrame, least: int = MIN_FIT_ROWS) -> DataFrame:
    """Every match from the second season on, scored by each arm: rho, loglik, rps and exact, with the arm's name.

    Arms: production (one correction for all), per_league, shrunk, per_lambda (linear in the goals
    expected).  ``df`` also has FTR; goals beyond ten count as ten.
    """
    rho = {
        "production": F.col("pooled"),
        "per_league": F.col("per_league"),
        "shrunk": F.col("shrunk"),
        "per_lambda": F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.col("line_at") + F.col("line_slope") * (F.col("mu_home") + F.col("mu_away") - CENTRE))),
    }
    joined = df.join(fold_corrections(df, least), ["League", "start"]).select(*df.columns, *[c.alias(f"rho_{a}") for a, c in rho.items()])
    # a short table is one file and would be one task
    dealt = joined.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
    kind = StructType([*df.schema.fields, *(StructField(n, t) for n, t in (("arm", StringType()), ("rho", DoubleType()), ("loglik", DoubleType()), ("rps", DoubleType()), ("exact", BooleanType())))])
    kept = list(df.columns)
    return dealt.mapInArrow(lambda batches: score_arms(batches, kept), kind)
