"""Exact dedup by content sort.

Texts are normalised (every byte of ``[\\x20\\x09-\\x0D]`` removed) and range-partitioned by
content with Spark's sampled splitters; each partition is sorted externally by the whole
normalised text, so equal texts stand next to each other, and a full comparison with the neighbour
ends a run.  The splitters hold only the first ``PREFIX`` characters of a text, so that the sample
which the driver sees stays small.

Two kinds of hot keys are found in a count before, and dealt out:

* texts that begin alike and are too many for one partition are spread by a hash of the text,
  which keeps equal ones together;
* a text that very many rows hold is spread over ``salts`` runs by id, and those runs, a few rows a
  text, are united afterwards by a full comparison of the texts.

Hashes only deal rows out; equality of whole texts decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.shared import stash, text_or_empty

#: Code points of the text that a splitter holds.
PREFIX = 64
#: A key is hot with one row in so many; so there are no more hot keys than this.
HOT = 500
BLANKS = r"[\x20\x09-\x0D]"


def _hot(counts: DataFrame, key: str, least: int) -> DataFrame:
    """The values of ``key`` that ``least`` rows or more have: ``HOT`` rows at most, so it may be broadcast."""
    return counts.groupBy(F.col(key).alias(f"hot_{key}")).agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select(f"hot_{key}")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64, hot: int = HOT) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, and all empty texts are one group.  The row with the most code
    points in its original text stays, of those the smallest id (a null id comes last); of rows
    that repeat text and id, one stays.  Other input columns are ignored, so their names cannot
    clash.  An empty table gives an empty result.
    """
    text = text_or_empty(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), F.regexp_replace(text, BLANKS, "").alias("body"), F.length(text).alias("points"))
    base = base.select("*", F.substring("body", 1, PREFIX).alias("prefix"), F.xxhash64("body").alias("mark"))
    counts = stash(base.groupBy(F.xxhash64("prefix").alias("front"), "mark").agg(F.count(F.lit(1)).alias("n")), "counts")
    least = max(2, -(-counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // hot))
    fronts, marks = stash(_hot(counts, "front", least), "fronts"), stash(_hot(counts, "mark", least), "marks")
    dealt = (
        base.join(F.broadcast(fronts), F.xxhash64("prefix") == F.col("hot_front"), "left")
        .join(F.broadcast(marks), F.col("mark") == F.col("hot_mark"), "left")
        .select(
            "doc_id",
            "body",
            "points",
            "prefix",
            F.when(F.col("hot_front").isNotNull(), F.col("mark")).otherwise(F.lit(0).cast("long")).alias("spread"),
            F.when(F.col("hot_mark").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(salts))).otherwise(F.lit(-1).cast("long")).alias("salt"),
        )
    )
    run = Window.partitionBy("prefix", "spread", "salt", "body")
    ranked = run.orderBy(F.desc("points"), F.asc_nulls_last("doc_id"))
    members = dealt.repartitionByRange("prefix", "spread", "salt").select(
        "doc_id",
        "points",
        "salt",
        F.row_number().over(ranked).alias("place"),
        F.first("doc_id").over(ranked).alias("head"),
        F.count(F.lit(1)).over(run).alias("rows"),
        F.sha2(F.col("body"), 256).alias("text_sha256"),
        F.when((F.col("salt") >= 0) & (F.row_number().over(ranked) == 1), F.col("body")).alias("hot_body"),
    )
    members = stash(members, "members")
    # the runs of hot texts: one row each, so no more than hot keys times salts
    all_runs = Window.partitionBy("hot_body")
    best = all_runs.orderBy(F.desc("points"), F.asc_nulls_last("doc_id"))
    runs = members.filter("hot_body is not null").select(
        F.col("salt").alias("run_salt"),
        F.col("text_sha256").alias("run_sha"),
        F.first("doc_id").over(best).alias("run_keep"),
        F.row_number().over(best).alias("run_place"),
        F.sum("rows").over(all_runs).alias("run_rows"),
    )
    joined = members.join(F.broadcast(runs), (F.col("salt") == F.col("run_salt")) & (F.col("text_sha256") == F.col("run_sha")), "left")
    cold = F.col("salt") < 0
    return joined.select(
        "doc_id",
        F.when(cold, F.col("head")).otherwise(F.col("run_keep")).alias("keep_id"),
        F.when(cold, F.col("rows")).otherwise(F.col("run_rows")).alias("group_size"),
        ((F.col("place") == 1) & (cold | (F.col("run_place") == 1))).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, all columns; ids are taken to be unique here."""
    stay = exact_groups(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("_stays"))
    return docs.join(stay, docs[id_col].eqNullSafe(F.col("_stays")), "left_semi")
