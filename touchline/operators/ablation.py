"""What each family of inputs is worth: one forecast a coalition and match, from which ladder, leave-one-out and shares follow."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import scoring
from touchline.operators import heads
from touchline.operators.resampling import coalitions, shapley_column
from touchline.sources.sinks import delete, written

#: What the stems of each family's columns look like; they do not overlap.
FAMILIES = {
    "base": (r"league_code", r"days_since_last_match", r"matches_last_\d+_days"),
    "elo": (r"elo",),
    "form": (r"(points|wins|draws|losses|goal_diff|goals_for|goals_against)_last_\d+(_venue)?", r"(shots|shots_on_target)_(for|against)_last_\d+(_venue)?", r"shot_accuracy_last_\d+(_venue)?", r"matches_used_last_\d+(_venue)?"),
    "xg": (r"(np)?xg_(for|against|diff|overperformance|per_shot)_last_\d+(_venue)?", r"(ppda|deep_completions)_last_\d+(_venue)?"),
    "squad": (r"strength_(overall|attack|defence|goalkeeper)",),
}


class UnknownColumnError(ValueError):
    """A column that belongs to no family, or to more than one."""


class ArmsDifferError(RuntimeError):
    """Two arms were not scored on the same matches."""


def stem(column: str) -> str:
    """A column's name without its side and without the mark of a difference."""
    return re.sub(r"_diff$", "", re.sub(r"^(home|away)_", "", column))


def family_of(column: str) -> str:
    found = [f for f, patterns in FAMILIES.items() if any(re.fullmatch(p, stem(column)) for p in patterns)]
    if len(found) != 1:
        raise UnknownColumnError(f"{column} belongs to {', '.join(found) or 'no family'}")
    return found[0]


def classify(columns: Iterable[str]) -> dict[str, list[str]]:
    """Every column in its one family; families without columns are absent, an unknown column is an error."""
    out: dict[str, list[str]] = {}
    for c in columns:
        out.setdefault(family_of(c), []).append(c)
    return out


def columns_of(by_family: dict[str, list[str]], families: Sequence[str]) -> list[str]:
    return [c for f in families for c in by_family.get(f, [])]


def aligned(left: DataFrame, right: DataFrame, key: Sequence[str]) -> int:
    """How many matches both arms have; an error if they are not the same ones, as often."""
    a, b = left.select(*key), right.select(*key)
    odd = a.exceptAll(b).count() + b.exceptAll(a).count()
    if odd:
        raise ArmsDifferError(f"{odd} matches are in one arm only")
    return a.count()


def coalition_scores(df: DataFrame, by_family: dict[str, list[str]], members: Sequence[str], folds: int | None = None, fit: Callable | None = None, actual: str = "FTR") -> DataFrame:
    """match_id, Season, and one ranked probability score a coalition of the members: ``rps``, ``rps_elo``, ``rps_elo_form``, ...

    Every coalition also has the columns of ``base``.  A season is forecast by a fit on all seasons before
    it; ``folds`` takes the last so many, None all but the first.  ``df`` has match_id, Season, start (the year the
    season starts) and the result.  Three-way heads of all coalitions are fitted and scored in the same passes over
    one written copy of the columns they need.  ``fit(train, columns)``, if given, takes their place one coalition
    at a time, and returns what has ``predict(df)`` with ph and pd.
    """
    spark = df.sparkSession
    every = {score_name(c): columns_of(by_family, ["base", *c]) for c in coalitions(list(members))}
    needed = list(dict.fromkeys(["match_id", "Season", "start", actual, *[c for own in every.values() for c in own]]))
    base, base_path = written((df if fit else df.select(*needed)).filter(F.col(actual).isNotNull()), "ablation")
    starts = [r[0] for r in base.select("start").distinct().orderBy("start").collect()][1:]
    starts = starts[-folds:] if folds else starts
    if not starts:
        raise ValueError("there is no season with one before it")
    result, _ = written((_one_by_one if fit else _together)(base, every, starts, fit, actual), "coalitions")
    delete(spark, base_path)
    return result


def _together(base: DataFrame, every: dict[str, list[str]], starts: Sequence, fit: None, actual: str) -> DataFrame:
    parts = []
    for start in starts:
        found = heads.fit_heads(base.filter(F.col("start") < start), every, actual).predict(base.filter(F.col("start") == start), ["match_id", "Season", actual])
        parts.append(found.select("match_id", "Season", *[scoring.rps(F.col(f"ph_{i}"), F.col(f"pd_{i}"), F.col(actual)).alias(name) for i, name in enumerate(every)]))
    return reduce(DataFrame.unionByName, parts)


def _one_by_one(base: DataFrame, every: dict[str, list[str]], starts: Sequence, fit: Callable, actual: str) -> DataFrame:
    """Each coalition's scores are written and joined to those before, if they have the same matches."""
    joined = None
    for name, columns in every.items():
        folds = [fit(base.filter(F.col("start") < start), columns).predict(base.filter(F.col("start") == start)) for start in starts]
        parts = [fold.select("match_id", "Season", scoring.rps(F.col("ph"), F.col("pd"), F.col(actual)).alias(name)) for fold in folds]
        scores, _ = written(reduce(DataFrame.unionByName, parts), "scores")
        if joined is None:
            joined = scores
        else:
            aligned(joined, scores, ["match_id", "Season"])
            joined = joined.join(scores, ["match_id", "Season"])
    return joined


def score_name(coalition: Sequence[str]) -> str:
    return "_".join(["rps", *coalition])


def ladder(scores: DataFrame, members: Sequence[str]) -> DataFrame:
    """(rung, families, rps, gain): the pooled score as the members join one by one, and what each step gains."""
    rungs = [tuple(members[:n]) for n in range(len(members) + 1)]
    row = scores.agg(*[F.avg(score_name(r)).alias(f"r{i}") for i, r in enumerate(rungs)]).first()
    rows = [(i, "+".join(["base", *r]), row[i], None if not i else row[i - 1] - row[i]) for i, r in enumerate(rungs)]
    return scores.sparkSession.createDataFrame(rows, "rung int, families string, rps double, gain double")


def leave_one_out(scores: DataFrame, members: Sequence[str]) -> DataFrame:
    """(family, rps, loss): the pooled score of all members but one, and what its absence costs."""
    full = tuple(members)
    without = {m: tuple(x for x in members if x != m) for m in members}
    row = scores.agg(F.avg(score_name(full)).alias("full"), *[F.avg(score_name(c)).alias(f"w{i}") for i, c in enumerate(without.values())]).first()
    return scores.sparkSession.createDataFrame([(m, row[i + 1], row[i + 1] - row[0]) for i, m in enumerate(without)], "family string, rps double, loss double")


def shares(scores: DataFrame, members: Sequence[str]) -> DataFrame:
    """(family, contribution, share): each member's exact mean contribution to the gain of all over none, and its part of it."""
    names = list(members)
    columns = [F.avg(shapley_column(m, names, lambda c: -F.col(score_name(c)))).alias(m) for m in names]
    row = scores.agg(*columns, (F.avg(score_name(())) - F.avg(score_name(tuple(names)))).alias("_gain")).first()
    rows = [(m, row[m], row[m] / row["_gain"] if row["_gain"] else None) for m in names]
    return scores.sparkSession.createDataFrame(rows, "family string, contribution double, share double")
