"""Joins that carry a promise: checked cardinality, as-of, nearest, band, unique keys, tiers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Only the rows whose key occurs once; all copies of another go."""
    return df.withColumn("_copies", F.count(F.lit(1)).over(Window.partitionBy(*key))).filter("_copies = 1").drop("_copies")


def asserted_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """``df``, but running it fails if a key occurs twice."""
    copies = F.count(F.lit(1)).over(Window.partitionBy(*key))
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in key])
    return df.withColumn("_copies", copies).filter(F.when(F.col("_copies") > 1, F.raise_error(F.concat(F.lit("repeated key "), name)).cast("boolean")).otherwise(F.lit(True))).drop("_copies")


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", validate: str = "m:1") -> DataFrame:
    """A join that fails where ``validate`` (1:1, m:1 or 1:m) does not hold."""
    one_left, one_right = validate[0] == "1", validate[-1] == "1"
    return (asserted_unique(left, on) if one_left else left).join(asserted_unique(right, on) if one_right else right, list(on), how)


def anti_append(base: DataFrame, extra: DataFrame, key: Sequence[str]) -> DataFrame:
    """``base`` and those rows of ``extra`` whose key it lacks; null keys count as equal."""
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_base_{k}")) for k in key])
    known = base.select([F.col(k).alias(f"_base_{k}") for k in key]).distinct()
    return base.unionByName(extra.join(known, match, "left_anti"), allowMissingColumns=True)


def with_fallback(base: DataFrame, measured: DataFrame, preseason: DataFrame, on: Sequence[str], values: Sequence[str], flag: str) -> DataFrame:
    """``base`` with the measured values of its key, or all of the pre-season ones where the key was not measured.

    A measured row is taken whole, its nulls too; ``flag`` says where the pre-season row stands in.
    """
    first = measured.select(*on, F.struct(*values).alias("_measured"))
    second = preseason.select(*on, F.struct(*values).alias("_preseason"))
    joined = checked_join(checked_join(base, first, on), second, on)
    chosen = F.coalesce("_measured", "_preseason")
    filled = F.col("_measured").isNull() & F.col("_preseason").isNotNull()
    return joined.withColumns({v: chosen[v] for v in values} | {flag: filled}).drop("_measured", "_preseason")


def asof_latest(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str], inclusive: bool = False, tie: Sequence[str] = ()) -> DataFrame:
    """To each left row, the values of the latest right row before it (at it, if ``inclusive``).

    One union, sorted once per key: no join of every pair.  Null values of the chosen row stay
    null.  ``tie`` orders right rows of one time; the last wins.
    """
    names = list(by)
    held = F.struct(F.col(right_time).alias("_at"), *[F.col(v) for v in values])
    rank = 0 if inclusive else 2
    a = left.select(*names, F.col(left_time).alias("_time"), F.lit(1).alias("_rank"), F.lit(None).cast(_struct_type(right, right_time, values)).alias("_held"), F.struct(*left.columns).alias("_row"), *[F.lit(None).cast(right.schema[t].dataType).alias(f"_tie_{t}") for t in tie])
    b = right.select(*names, F.col(right_time).alias("_time"), F.lit(rank).alias("_rank"), held.alias("_held"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType).alias("_row"), *[F.col(t).alias(f"_tie_{t}") for t in tie])
    window = Window.partitionBy(*names).orderBy("_time", "_rank", *[f"_tie_{t}" for t in tie]).rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("_last", F.last("_held", ignorenulls=True).over(window)).filter("_row is not null")
    return found.select("_row.*", F.col("_last._at").alias(f"asof_{right_time}"), *[F.col(f"_last.{v}").alias(v) for v in values])


def _struct_type(df: DataFrame, time: str, values: Sequence[str]):
    return df.select(F.struct(F.col(time).alias("_at"), *values).alias("s")).schema["s"].dataType


def asof_top_n(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, tie: Sequence[str], n: int) -> DataFrame:
    """The ``n`` latest right rows of the same ``by`` strictly before each left row, ``_n`` counting from the latest.

    Right rows are numbered by time, and one window over the union counts those before every left
    row; so each left row asks for ``n`` numbers by equal keys, and no row meets all of its past.
    """
    names = list(by)
    numbered = right.withColumn("_k", F.row_number().over(Window.partitionBy(*names).orderBy(right_time, *tie)))
    shape = left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType
    events = left.select(*names, F.col(left_time).alias("_time"), F.lit(0).alias("_past"), F.struct(*left.columns).alias("_row"))
    events = events.unionByName(right.select(*names, F.col(right_time).alias("_time"), F.lit(1).alias("_past"), F.lit(None).cast(shape).alias("_row")))
    before = Window.partitionBy(*names).orderBy("_time", "_past").rowsBetween(Window.unboundedPreceding, 0)
    asked = events.withColumn("_c", F.sum("_past").over(before)).filter("_row is not null and _c > 0")
    asked = asked.select("_row.*", "_c", F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("_c") - (n - 1)), "_c")).alias("_k"))
    return asked.join(numbered.drop(right_time) if right_time in left.columns else numbered, [*names, "_k"]).withColumn("_n", (F.col("_c") - F.col("_k") + 1).cast("int")).drop("_c", "_k")


def nearest(left: DataFrame, right: DataFrame, on: Sequence[str], left_at: str, right_at: str, value: str, tolerance: int) -> DataFrame:
    """To each left row, the value at the nearest distance up to ``tolerance``; the earlier wins ties.

    The range is turned into equal keys, one for each distance, so the join is an equi-join.
    """
    # from best to worst: distance 0, then earlier before later
    offsets = [0] + [s * d for d in range(1, tolerance + 1) for s in (-1, 1)]
    spread = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(o).alias("offset")) for i, o in enumerate(offsets)]))
    keyed = left.select(*on, left_at).distinct().withColumn("_o", spread).withColumn("_at", F.col(left_at) + F.col("_o.offset"))
    other = right.filter(F.col(value).isNotNull()).select(*[F.col(c).alias(f"_r_{c}") for c in on], F.col(right_at).alias("_r_at"), F.col(value).alias("_value"))
    match = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_r_{c}") for c in on]) & (F.col("_at") == F.col("_r_at"))
    best = keyed.join(other, match).groupBy(*on, left_at).agg(F.min_by("_value", F.struct("_o.place", "_value")).alias(f"nearest_{value}"))
    return left.join(best, [*on, left_at], "left")


def band_match(left: DataFrame, right: DataFrame, on: Column, within: Column, left_key: Sequence[str]) -> DataFrame:
    """Pairs within a band, kept only where the left row has exactly one."""
    pairs = left.join(right, on & within)
    return pairs.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*left_key))).filter("_n = 1").drop("_n")


def tiered_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, block: Sequence[str], tiers: Sequence[tuple[str, Callable[[str], Column]]], names: tuple[str, str]) -> DataFrame:
    """(left_id, right_id, tier): tiers of keys in turn, within blocks.

    A tier gives each row an array of keys.  A key held by two rows of one side is ambiguous and
    matches nothing, and matched rows of both sides leave before the next tier.
    """
    left_rows, right_rows, found = left, right, None
    for number, (tier, keys) in enumerate(tiers):

        def keyed(df: DataFrame, row: str, name: str, keys=keys) -> DataFrame:
            rows = df.select(*block, row, F.explode_outer(keys(name)).alias("_key")).filter("_key is not null and _key <> ''").distinct()
            return unique_keys(rows, [*block, "_key"])

        pairs = keyed(left_rows, left_id, names[0]).join(keyed(right_rows, right_id, names[1]), [*block, "_key"]).select(left_id, right_id).distinct()
        pairs = unique_keys(unique_keys(pairs, [left_id]), [right_id]).withColumn("tier", F.lit(tier)).withColumn("tier_number", F.lit(number))
        found = pairs if found is None else found.unionByName(pairs)
        left_rows = left_rows.join(pairs.select(left_id), left_id, "left_anti")
        right_rows = right_rows.join(pairs.select(right_id), right_id, "left_anti")
    return found


def round_robin_left(played: DataFrame, by: Sequence[str], home: str = "HomeTeam", away: str = "AwayTeam") -> DataFrame:
    """Ordered pairs of the teams of a group that have not met yet; a repeated pairing is an error.

    Pairs are made within a group only: an equi-join on it.
    """
    teams = played.select(*by, F.explode(F.array(home, away)).alias("t")).distinct()
    pairs = teams.withColumnRenamed("t", home).join(teams.withColumnRenamed("t", away), list(by)).filter(F.col(home) != F.col(away))
    return pairs.join(asserted_unique(played.select(*by, home, away), [*by, home, away]), [*by, home, away], "left_anti")
