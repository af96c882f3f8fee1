"""Filter interaction audit by direct relational replay.

Every document is reduced to a few flags.  They are crossed with all orders of the filters, a
broadcast table of fixed size (120 for five filters), each order is exploded into its steps, and
the first failing step decides what happens at the others.  The sums by part, order and step are
combined on the map side, so that one shuffled row a task, part, order and step is all that moves.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.shared import WORD, stash, text_or_empty

#: Flagged rows of a replay task; each becomes orders times steps rows there.
TASK_ROWS = 8_000
#: The orders are broadcast; so many filters have 5040 orders of 7 steps.
MOST_FILTERS = 7


def text_flags(text: Column) -> dict[str, Column]:
    """The failure conditions A to D of one text; E needs the table and is added by ``flagged``."""
    found = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    words, distinct = F.size(found), F.size(F.array_distinct(found))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": words < 200,
        "B": 100 * distinct.cast("long") < 50 * words.cast("long"),
        "C": 100 * capitals.cast("long") > 2 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per input row: part, the filters A to E that it fails, good and toxic.

    E: the same text under a smaller id anywhere in the table; texts are the same where their
    SHA-256 is.  Null text counts as empty, null part as the empty string.  A null id is smaller
    than none and greater than none; it has no labels.  Rows that repeat an id do not make each
    other copies.  Of several labels of one id, any 1 counts.  Other columns are ignored.
    """
    text = text_or_empty(text_col)
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), *[c.alias(k) for k, c in text_flags(text).items()], F.sha2(text, 256).alias("digest")
    )
    base = stash(base, "flags")  # the texts are read once
    heads = base.groupBy(F.col("digest").alias("of")).agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    heads = stash(heads, "heads")  # else the join would run where they are counted, and a hot text could not be split
    known = labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    joined = base.join(known, F.col("doc_id") == F.col("labelled"), "left").join(heads, F.col("digest") == F.col("of"), "left")
    none = F.lit(False)
    return joined.select("part", "A", "B", "C", "D", F.coalesce(F.col("doc_id") > F.col("head"), none).alias("E"), F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"))


def filter_orders(docs: DataFrame, filters: Sequence[str]) -> DataFrame:
    """(filter_order, letters): every order of the filters, as a string and as an array."""
    if len(filters) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters: their orders are broadcast")
    rows = [("".join(p), list(p)) for p in permutations(filters)]
    return docs.sparkSession.createDataFrame(rows, "filter_order string, letters array<string>")


def replay(flags: DataFrame, filters: Sequence[str] = "ABCDE") -> DataFrame:
    """One row per part, filter_order and step: what the order's step does to the part.

    ``flags`` has part, good, toxic and one boolean column per filter, true where the filter
    removes the row.  Every part has a row for each order and step, zeros included; an empty table
    gives an empty result.  A part of any size is summed on the map side, so none is one task.
    """
    flags = stash(flags, "flagged")
    tasks = max(1, -(-flags.count() // TASK_ROWS))
    bits = {f: 1 << i for i, f in enumerate(filters)}
    fails = reduce(lambda a, b: a + b, [F.when(F.col(f), bit).otherwise(0) for f, bit in bits.items()])
    bit_of = lambda letter: F.element_at(F.create_map(*[F.lit(x) for pair in bits.items() for x in pair]), letter)
    orders = filter_orders(flags, filters).select("filter_order", F.transform("letters", bit_of).alias("order_bits"))
    crossed = flags.repartition(tasks).select("part", fails.alias("fails"), "good", "toxic").crossJoin(F.broadcast(orders))
    first = F.lit(len(filters) + 1)
    for i in reversed(range(len(filters))):
        first = F.when(F.col("fails").bitwiseAND(F.col("order_bits")[i]) != 0, i + 1).otherwise(first)
    steps = crossed.select("part", "filter_order", "fails", "good", "toxic", first.alias("gone_at"), F.posexplode("order_bits").alias("at", "bit"))
    steps = steps.withColumn("step", F.col("at") + 1)
    removed, fails_here = F.col("gone_at") == F.col("step"), F.col("fails").bitwiseAND(F.col("bit")) != 0
    count = lambda condition: F.sum(condition.cast("long"))
    sums = steps.groupBy("part", "filter_order", "step").agg(
        count(F.col("gone_at") > F.col("step")).alias("kept"),
        count(removed).alias("removed"),
        count(fails_here & (F.col("gone_at") < F.col("step"))).alias("redundant"),
        count(F.col("fails") == F.col("bit")).alias("unique_fails"),
        count(removed & F.col("good")).alias("good_lost"),
        count(removed & F.col("toxic")).alias("toxic_lost"),
    )
    # the sums are one row per part, order and step: a filter of a part has as many as there are orders
    of_filter = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return sums.withColumn("shapley", F.sum("removed").over(of_filter))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five text filters; see ``flagged`` and ``replay``."""
    return replay(flagged(docs, labels))
