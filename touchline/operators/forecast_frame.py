"""Everything that is published of a forecast, from its two goal rates; market prices beside it, and boards.

The grid of scores is made for a whole Arrow batch at once in numpy; a row has twenty numbers, and
nothing is sorted but three places.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions import scoring
from touchline.functions.scoreline import MAX_GOALS
from touchline.operators.joins import checked_join

#: Places of the likeliest scores, the share from which a favourite is decisive, and the
#: goals a side must have been worth together for a match to be told again from them.
TOP_SCORES, DECISIVE, LEAST_GOALS = 3, 0.4, 0.1
FRAME = [
    "expected_goals_home", "expected_goals_away", "prob_home_win", "prob_draw", "prob_away_win", "modal_score_home", "modal_score_away", "prob_modal_score",
    *[f"score_{k}_{part}" for k in range(TOP_SCORES) for part in ("home", "away", "prob")], "prob_over_2_5", "prob_btts",
]
_WHOLE = {c for c in FRAME if c.startswith(("modal", "score")) and not c.endswith("prob")}
_FACTORIALS = np.array([factorial(k) for k in range(MAX_GOALS + 1)], dtype=np.float64)


def score_grid(mu_home: np.ndarray, mu_away: np.ndarray, rho: np.ndarray) -> np.ndarray:
    """(rows, 11, 11) probabilities of each score, corrected and summing to 1."""
    k = np.arange(MAX_GOALS + 1)
    home, away = (np.exp(-m)[:, None] * m[:, None] ** k / _FACTORIALS for m in (mu_home, mu_away))
    grid = home[:, :, None] * away[:, None, :]
    for (h, a), factor in {(0, 0): 1 - mu_home * mu_away * rho, (0, 1): 1 + mu_home * rho, (1, 0): 1 + mu_away * rho, (1, 1): 1 - rho}.items():
        grid[:, h, a] *= np.maximum(factor, 1e-10)
    return grid / grid.sum(axis=(1, 2), keepdims=True)


def _frame(mu_home: np.ndarray, mu_away: np.ndarray, rho: np.ndarray) -> dict[str, np.ndarray]:
    grid = score_grid(mu_home, mu_away, rho)
    h, a = np.indices(grid.shape[1:])
    share = lambda where: grid[:, where].sum(axis=1)
    flat = grid.reshape(len(grid), -1)
    best, left = [], np.round(flat, 12)  # equal to twelve digits is equal
    for _ in range(TOP_SCORES):  # argmax takes the first of equal ones
        best.append(left.argmax(axis=1))
        left[np.arange(len(left)), best[-1]] = -1.0
    best = np.stack(best, axis=1)
    p = np.take_along_axis(flat, best, axis=1)
    out = {"expected_goals_home": mu_home, "expected_goals_away": mu_away, "prob_home_win": share(h > a), "prob_draw": share(h == a), "prob_away_win": share(h < a), "prob_over_2_5": share(h + a > 2), "prob_btts": share((h > 0) & (a > 0))}
    out |= {"modal_score_home": best[:, 0] // (MAX_GOALS + 1), "modal_score_away": best[:, 0] % (MAX_GOALS + 1), "prob_modal_score": p[:, 0]}
    for place in range(TOP_SCORES):
        out |= {f"score_{place}_home": best[:, place] // (MAX_GOALS + 1), f"score_{place}_away": best[:, place] % (MAX_GOALS + 1), f"score_{place}_prob": p[:, place]}
    return out


@F.pandas_udf(T.StructType([T.StructField(c, T.IntegerType() if c in _WHOLE else T.DoubleType()) for c in FRAME]))
def _published(mu_home: pd.Series, mu_away: pd.Series, rho: pd.Series) -> pd.DataFrame:
    m, n, r = (c.to_numpy(dtype=np.float64, na_value=np.nan) for c in (mu_home, mu_away, rho))
    whole = ~(np.isnan(m) | np.isnan(n) | np.isnan(r))
    out = pd.DataFrame(index=range(len(m)), columns=FRAME, dtype=np.float64)
    if whole.any():
        for name, values in _frame(m[whole], n[whole], r[whole]).items():
            out.loc[whole, name] = values
    return out.astype({c: "Int32" for c in _WHOLE})


def prediction_frame(df: DataFrame, mu_home: str = "mu_home", mu_away: str = "mu_away", rho: Column | float = 0.0) -> DataFrame:
    """``df`` with expected goals, the three outcomes, the likeliest, the modal score, the three likeliest
    scores, over 2.5 goals and both sides to score; null where a rate is.

    Rates below 1e-6 count as that.  What is equal to twelve digits is equal: the score with fewer home, then
    away goals stands first, and home before draw before away.
    """
    r = rho if isinstance(rho, Column) else F.lit(float(rho))
    m, n = (F.greatest(F.col(c).cast("double"), F.lit(1e-6)) for c in (mu_home, mu_away))
    held = df.withColumn("_f", _published(F.when(F.col(mu_home).isNotNull(), m), F.when(F.col(mu_away).isNotNull(), n), r))
    out = held.select(*df.columns, *[F.col("_f")[c].alias(c) for c in FRAME])
    picked = F.when(F.col("prob_home_win").isNotNull(), scoring.pick(*[F.round(c, 12) for c in ("prob_home_win", "prob_draw", "prob_away_win")]))
    return out.withColumn("predicted_outcome", picked)


def retrodicted(df: DataFrame, xg_home: str, xg_away: str) -> DataFrame:
    """What the goals that the chances were worth say of a played match; null where both sides' together are below ``LEAST_GOALS``."""
    enough = F.col(xg_home) + F.col(xg_away) >= LEAST_GOALS
    rated = df.withColumns({"_h": F.when(enough, F.col(xg_home)), "_a": F.when(enough, F.col(xg_away))})
    return prediction_frame(rated, "_h", "_a").drop("_h", "_a")


def with_market(df: DataFrame, odds: DataFrame, on: Sequence[str], columns: Sequence[str] = ("AvgH", "AvgD", "AvgA")) -> DataFrame:
    """Adds market_home, market_draw and market_away: prices without the margin, null where one is missing or not above 1.

    For display and comparison only; running it fails if ``odds`` repeats a key.
    """
    priced = odds.select(*on, *[F.col(c).cast("double").alias(f"_o{i}") for i, c in enumerate(columns)])
    joined = checked_join(df, priced, on)
    usable = (F.col("_o0") > 1) & (F.col("_o1") > 1) & (F.col("_o2") > 1)
    total = 1 / F.col("_o0") + 1 / F.col("_o1") + 1 / F.col("_o2")
    names = ("market_home", "market_draw", "market_away")
    return joined.withColumns({n: F.when(usable, 1 / F.col(f"_o{i}") / total) for i, n in enumerate(names)}).drop("_o0", "_o1", "_o2")


def favourite(df: DataFrame) -> DataFrame:
    """Adds confidence, the largest share in whole per cent, and decisive, whether it reaches ``DECISIVE``."""
    top = F.greatest("prob_home_win", "prob_draw", "prob_away_win")
    return df.withColumns({"confidence": F.round(top * 100).cast("int"), "decisive": top >= DECISIVE})


def market_scores(df: DataFrame, by: Sequence[str], actual: str = "FTR") -> DataFrame:
    """(by, n_priced, model_rps, market_rps) over the rows that have both a price and a result."""
    rows = df.filter(F.col("market_home").isNotNull() & F.col(actual).isNotNull() & F.col("prob_home_win").isNotNull())
    model = scoring.rps(F.col("prob_home_win"), F.col("prob_draw"), F.col(actual))
    market = scoring.rps(F.col("market_home"), F.col("market_draw"), F.col(actual))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_priced"), F.avg(model).alias("model_rps"), F.avg(market).alias("market_rps"))


def _board(df: DataFrame, name: str, value: Column, key: str, n: int) -> DataFrame:
    ranked = df.withColumn("value", value).filter(F.col("value").isNotNull())
    top = ranked.orderBy(F.desc(F.abs("value")), F.asc(key)).limit(n)  # so few rows that numbering them takes one task
    return top.select(F.lit(name).alias("board"), key, "predicted_outcome", "value")


def discover(df: DataFrame, key: str = "match_id", n: int = 5) -> DataFrame:
    """Three boards of ``n`` forecasts: disagreement (ours minus the market's share of the outcome we pick),
    confident (confidence of the decisive ones) and upset (how much stronger the side is that we pick against).

    ``df`` has the frame, the market and strength_home and strength_away; rows that lack what a board needs
    are not on it.  Ties go by the key.
    """
    known = favourite(df)
    pick = F.col("predicted_outcome")
    ours = F.when(pick == "H", F.col("prob_home_win")).when(pick == "A", F.col("prob_away_win")).otherwise(F.col("prob_draw"))
    theirs = F.when(pick == "H", F.col("market_home")).when(pick == "A", F.col("market_away")).otherwise(F.col("market_draw"))
    deficit = F.when(pick == "H", F.col("strength_away") - F.col("strength_home")).when(pick == "A", F.col("strength_home") - F.col("strength_away"))
    boards = [
        _board(known, "disagreement", ours - theirs, key, n),
        _board(known, "confident", F.when(F.col("decisive"), F.col("confidence").cast("double")), key, n),
        _board(known, "upset", F.when(deficit > 0, deficit), key, n),
    ]
    return boards[0].unionByName(boards[1]).unionByName(boards[2])
