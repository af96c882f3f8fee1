"""The player rating from a configuration: each role has sub-ratings of its own metrics and weights.

A player's row stays whole: distinct values are ranked apart and go back to it, and the configuration is
a small table of weights, one row a pool, that is sent to all rows; so a role costs no expression of its
own, and rows move once, to be ranked by their composite.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.scale import scale_map
from touchline.operators.percentiles import join_small, with_percentile, with_percentiles, with_totals
from touchline.sources.sinks import written

BY = ["role", "Season"]
#: Weight that may be missing, of a pool's definition and of a player's values; and the share of a pool that must have a metric.
MAX_MISSING, COVERAGE = 0.5, 0.5
REASONS = {"role": "No position recorded", "minutes": "Under {} minutes played", "pool": "Fewer than {} comparable players this season", "hollow": "No performance data this season"}


def long_percentiles(long: DataFrame, by: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Adds pct: the mean rank of a value among the non-null ones of its group and metric, over their number.

    Values are counted first; the ranks are sums over distinct values.
    """
    group = [*by, name]
    counts = long.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    window = Window.partitionBy(*group)
    upto = F.sum("_c").over(window.orderBy(value))
    ranks = counts.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col(value).alias("_v"), ((upto - (F.col("_c") - 1) / 2) / F.sum("_c").over(window)).alias("pct"))
    match = F.col(value) == F.col("_v")
    for i, c in enumerate(group):
        match = match & (F.col(c) == F.col(f"_g{i}"))
    return long.join(ranks, match).drop("_v", *[f"_g{i}" for i in range(len(group))])


def _weights(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """The configuration's weights, a handful a role; those of zero take no part."""
    return F.broadcast(df.sparkSession.createDataFrame([r for r in rows if r[-1]], schema))


def pool_weights(pools: DataFrame, present: dict[str, str], weights: DataFrame, targets: Sequence[str], max_missing: float) -> DataFrame:
    """One row a pool: ``_w_target_item`` of what it measures, ``_held_target`` and ``measured_target``.

    ``pools``: role, Season, size and how many have each item, in the columns of ``present``; ``weights``: role,
    target, item, weight.  An item that fewer than ``COVERAGE`` of a pool have is left out of it; a
    definition that lacks more than ``max_missing`` of its weight has no weights.
    """
    have = F.explode_outer(F.array(*[F.struct(F.lit(i).alias("item"), F.col(c).alias("_have")) for i, c in present.items()])) if present else F.lit(None).cast("struct<item: string, _have: bigint>")
    counted = pools.select(*BY, have.alias("_p")).select(*BY, "_p.*")
    covered = pools.select(*BY, "size").join(weights, "role").join(counted, [*BY, "item"], "left").withColumn("_usable", F.coalesce(F.col("_have") / F.col("size") >= COVERAGE, F.lit(False)))
    size = F.abs("weight")
    usable = covered.groupBy(*BY, "target").agg(F.sum(F.when(F.col("_usable"), size).otherwise(0.0)).alias("_held"), F.sum(size).alias("_all"))
    usable = usable.withColumn("measured", F.col("_held") / F.col("_all"))
    marked = covered.join(usable, [*BY, "target"])
    kept = (F.col("measured") >= 1 - max_missing) & (F.col("_held") > 0)
    cells = []
    for t in targets:
        own = F.col("target") == t
        cells += [F.max(F.when(own & kept & F.col("_usable") & (F.col("item") == i), F.col("weight"))).alias(f"_w_{t}_{i}") for i in present]
        cells += [F.max(F.when(own & kept, F.col("_held"))).alias(f"_held_{t}"), F.max(F.when(own, F.col("measured"))).alias(f"measured_{t}")]
    return marked.groupBy(*BY).agg(*cells)


def weighted(target: str, items: dict[str, Column], max_missing: float) -> Column:
    """The weighted mean of the items that a row has, by the columns of ``pool_weights``.

    A negative weight counts 1 - x; null for who lacks more than ``max_missing`` of what the pool has.
    """
    total, held = F.lit(0.0), F.lit(0.0)
    for item, x in items.items():
        w = F.col(f"_w_{target}_{item}")
        there = x.isNotNull() & w.isNotNull()
        total = total + F.when(there, F.when(w > 0, x).otherwise(1 - x) * F.abs(w)).otherwise(0.0)
        held = held + F.when(there, F.abs(w)).otherwise(0.0)
    return F.when((held > 0) & (held / F.col(f"_held_{target}") >= 1 - max_missing), total / held)


def eligibility(df: DataFrame, config: dict) -> DataFrame:
    """Adds unrated_reason: no role, an unrated role, too few minutes, or a pool of too few qualified players."""
    role = F.col("role")
    reason = F.when(role.isNull(), REASONS["role"])
    for name, why in config.get("unrated_roles", {}).items():
        reason = reason.when(role == name, why)
    reason = reason.when(F.coalesce(F.col("minutes"), F.lit(0)) < config["min_minutes"], REASONS["minutes"].format(config["min_minutes"]))
    least = config.get("min_group_size", 0)
    pooled = with_totals(df.withColumn("unrated_reason", reason), BY, _pool=F.count(F.when(F.col("unrated_reason").isNull(), 1)))
    return pooled.withColumn("unrated_reason", F.coalesce("unrated_reason", F.when(F.col("_pool") < least, REASONS["pool"].format(least)))).drop("_pool")


def _shrunk(value: str, mean: str, k: Column) -> Column:
    """A value drawn toward its pool's mean, by k nineties of evidence."""
    n = F.greatest(F.coalesce(F.col("nineties"), F.lit(0.0)), F.lit(0.0))
    return n / (n + k) * F.col(value) + (1 - n / (n + k)) * F.col(mean)


def rate_players(df: DataFrame, config: dict, key: Sequence[str]) -> DataFrame:
    """Every row of ``df`` with sub-ratings (0 to 99), composite, measured_share, performance_rating,
    fifa_on_our_scale, fifa_weight_used, rating, rated and unrated_reason.

    ``df``: the ``key`` (unique), role, Season, minutes, nineties, the metrics and fifa_overall, in any of
    which nulls may stand.  ``config``: min_minutes, min_group_size, unrated_roles, shrinkage_nineties,
    scale, positions (role: sub_ratings {name: {metric: weight}}, sub_rating_weights {name: weight}),
    discipline {metrics, weight}, peak_weight, fifa_weight, unmeasured_shift, unmatched_shrinkage_nineties.

    A sub-rating of weight zero is published but counts neither in the composite nor in the peak.  Who has
    no composite keeps the edition's rating alone, if there is one, and else is unrated.  The less of a
    role's definition a season measures, the more the edition counts, and the more a player without an
    entry is drawn to the mean.
    """
    base, _ = written(df, "players")
    marked = eligibility(base, config)
    work = marked.filter("unrated_reason is null")
    roles, discipline = config["positions"], config.get("discipline")
    subs = list(dict.fromkeys(s for spec in roles.values() for s in spec["sub_ratings"]))
    metrics = [(r, s, m, float(w)) for r, spec in roles.items() for s, of in spec["sub_ratings"].items() for m, w in of.items()]
    wanted = dict.fromkeys([m for _, _, m, _ in metrics] + list(discipline["metrics"] if discipline else []))
    present = {m: f"_m{i}" for i, m in enumerate(m for m in wanted if m in df.columns)}
    kind = "role string, target string, item string, weight double"

    # what a pool measures follows from which values are there, before any is ranked
    pools, _ = written(work.groupBy(*BY).agg(F.count(F.lit(1)).alias("size"), *[F.count(m).alias(c) for m, c in present.items()]).filter("Season is not null"), "pools")
    sub_weights = pool_weights(pools, present, _weights(df, metrics, kind), subs, MAX_MISSING)
    if discipline:
        penal = [(r, "_discipline", m, float(w)) for r in roles for m, w in discipline["metrics"].items()]
        sub_weights = join_small(sub_weights, pool_weights(pools, present, _weights(df, penal, kind), ["_discipline"], MAX_MISSING), BY)
    sub_weights, _ = written(sub_weights, "weights")
    with_subs = lambda rows, values: join_small(rows, sub_weights, BY).withColumns({f"sub_{s}": weighted(s, values, MAX_MISSING) for s in subs})
    counted = with_subs(work, {m: F.col(m).cast("double") for m in present})
    have = {s: f"_s{i}" for i, s in enumerate(subs)}
    of_sub = [(r, "_composite", s, float(w)) for r, spec in roles.items() for s, w in spec["sub_rating_weights"].items()]
    counts = join_small(pools, counted.groupBy(*BY).agg(*[F.count(f"sub_{s}").alias(c) for s, c in have.items()]), BY)
    weights, _ = written(pool_weights(counts, have, _weights(df, of_sub, kind), ["_composite"], 1.0), "weights")

    ranked = with_percentiles(work, BY, {c: (m, True) for m, c in present.items()} | {"_edition": ("fifa_overall", True)})
    values = {m: F.col(c) for m, c in present.items()}
    joined = join_small(with_subs(ranked, values), weights, BY).withColumnRenamed("measured__composite", "measured_share")
    raw = weighted("_composite", {s: F.col(f"sub_{s}") for s in subs}, 1.0)
    if discipline:
        score = weighted("_discipline", {m: 1 - x for m, x in values.items()}, MAX_MISSING)
        raw = F.when(score.isNotNull(), raw * (1 - discipline["weight"]) + score * discipline["weight"]).otherwise(raw)
    lift = float(config.get("peak_weight", 0.0))
    if lift:
        counting = {s: [r for r, _, t, w in of_sub if t == s and w] for s in subs}
        peak = F.array_max(F.array(*[F.when(F.col("role").isin(named), F.col(f"sub_{s}")) for s, named in counting.items()]))
        raw = F.when(peak.isNotNull(), (1 - lift) * raw + lift * peak).otherwise(raw)
    # a role that the configuration does not know is measured by nothing that could be missing
    rated, _ = written(joined.withColumn("composite_raw", raw).select(*df.columns, *[f"sub_{s}" for s in subs], "measured_share", "_edition", "composite_raw"), "composite")

    lost = F.col("composite_raw").isNull() & F.col("fifa_overall").isNull()
    means, _ = written(rated.groupBy(*BY).agg(F.avg("composite_raw").alias("_mean")), "means")
    known = join_small(rated.filter(~lost), means, BY).withColumn("composite", _shrunk("composite_raw", "_mean", F.lit(float(config["shrinkage_nineties"])))).drop("_mean")
    known = with_percentile(known, BY, "composite", "_pct").withColumn("performance_rating", scale_map(F.col("_pct"), config["scale"])).drop("_pct")
    known, _ = written(known.withColumn("fifa_on_our_scale", scale_map(F.col("_edition"), config["scale"])).drop("_edition"), "performance")
    known = with_totals(known, BY, _mean=F.avg("performance_rating"))
    known = known.withColumn("rating", _blended(config)).withColumn("fifa_weight_used", F.when(F.col("fifa_overall").isNotNull(), _edition_weight(config)))

    published = [*[F.round(F.col(f"sub_{s}") * 99, 0).alias(f"sub_{s}") for s in subs], "composite_raw", "composite", "performance_rating", "fifa_on_our_scale", "measured_share", "fifa_weight_used", F.bround("rating", 0).cast("int").alias("rating")]
    columns = [*key, *[c for c in df.columns if c not in key]]
    out = known.select(*columns, F.lit(None).cast("string").alias("unrated_reason"), *published, F.lit(True).alias("rated"))
    # who is not rated is added below; no row looks for its rating by key
    hollow = rated.filter(lost).select(*columns, F.lit(REASONS["hollow"]).alias("unrated_reason"), F.lit(False).alias("rated"))
    refused = marked.filter("unrated_reason is not null").select(*columns, "unrated_reason", F.lit(False).alias("rated"))
    return out.unionByName(hollow, allowMissingColumns=True).unionByName(refused, allowMissingColumns=True)


def _edition_weight(config: dict) -> Column:
    weight, shift = float(config.get("fifa_weight", 0.0)), float(config.get("unmeasured_shift", 1.0))
    measured = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("measured_share", F.lit(1.0))))
    return F.greatest(F.lit(weight), F.least(F.lit(1.0), weight + (1 - weight) * shift * (1 - measured)))


def _blended(config: dict) -> Column:
    """Performance and edition by weight; either alone where the other is missing."""
    performance, own = F.col("performance_rating"), F.col("fifa_overall").isNotNull()
    if not config.get("fifa_weight"):
        return performance
    scaled, weight = F.col("fifa_on_our_scale"), _edition_weight(config)
    k = float(config.get("unmatched_shrinkage_nineties", 0.0))
    share = F.greatest(F.coalesce("measured_share", F.lit(0.0)), F.lit(0.1))
    alone = _shrunk("performance_rating", "_mean", k / share) if k else performance
    return F.when(own & performance.isNull(), scaled).when(own, performance * (1 - weight) + scaled * weight).otherwise(alone)
