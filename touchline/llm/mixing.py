"""Mixing sources to target weights.

Tokens (here: words) are summed per source, targets are shared out by weight, and each document
is emitted floor(rate) times plus once more with the probability of the rate's fraction, decided
by a hash of its id, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.shared import BROADCAST_ROWS, WORD, stash, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SALTS = 64


def word_count(text_col: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")


def uniform(id_col: str, seed: str = "mix") -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of seed and id; a null id hashes as ``null``."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> also weight, target, rate.

    Sources in code-point order, null last, take ``weights`` in turn.  Targets share out
    ``share`` of all sizes by weight; a target stops at ``most`` times its source's size and the
    excess is shared again by weight until none is above.  That fixed point is a common level
    per unit of weight, found with prefix sums over the sources ordered by cap / weight.
    Sources of size 0 get target 0.
    """
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    ranked = sizes.withColumn("place", place).withColumn("weight", F.get(turn, (F.col("place") - 1) % len(weights)))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("level", F.col("cap") / F.col("weight"))
    before = Window.orderBy("level", "place").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    ranked = ranked.withColumn("trial", left / open_weight)
    fits = F.col("trial") <= F.col("level")
    shared = F.min_by(F.when(fits, F.col("trial")), F.when(fits, F.struct("level", "place"))).over(every)
    target = F.least(F.col("cap"), F.coalesce(shared * F.col("weight"), F.col("cap")))
    return ranked.withColumn("target", target).select(
        "source",
        "source_size",
        "weight",
        "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
    )


def mix_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: str = "mix",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: id, size, source_size, target, rate, copies (and the ``keep`` columns).

    Null text has size 0, null source is a source of its own, rows with one id get the same draw.
    The per-source table is broadcast when it is small; beyond ``BROADCAST_ROWS`` sources it is
    joined by (source, salt), so a source with a third of all rows is spread over ``SALTS`` tasks.
    """
    base = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(text_col).alias("_size"), *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)]
    )
    sizes = base.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"))
    rates = stash(source_targets(sizes, weights, share, most), "rates").withColumnRenamed("source", "_rate_source")
    if rates.count() <= BROADCAST_ROWS:
        joined = base.join(F.broadcast(rates), F.col("_source").eqNullSafe(F.col("_rate_source")))
    else:
        salted = rates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = base.withColumn("_doc_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)))
        joined = left.join(salted, F.col("_source").eqNullSafe(F.col("_rate_source")) & (F.col("_doc_salt") == F.col("_salt")))
    draw = uniform("_id", seed) < F.col("rate") - F.floor("rate")
    return joined.select(
        F.col("_id").alias("doc_id"),
        F.col("_size").alias("size"),
        "source_size",
        "target",
        "rate",
        (F.floor("rate") + draw.cast("long")).alias("copies"),
        *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep) if c != "doc_id"],
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as its plan says, columns unchanged."""
    columns = docs.columns
    renamed = docs.select([F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    names = {k: f"c{columns.index(options.pop(k, v))}" for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    plan = mix_plan(renamed, **names, **options, keep=tuple(renamed.columns))
    return (
        plan.filter("copies > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select([F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
    )
