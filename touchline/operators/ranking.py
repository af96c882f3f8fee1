"""Selections under a total order."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A block of vectors whose numbers take about so many bytes may be broadcast.
BROADCAST_BYTES = 16_000_000
#: Subjects and vectors that meet in one product of matrices.
TILE = 1024


def top_n_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group; ``order`` must end in a unique key."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= n)
    return ranked.withColumnRenamed("_n", rank) if rank else ranked.drop("_n")


def top_n_of_enough(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, least: int) -> DataFrame:
    """The first ``n`` rows of each group that has ``least`` rows, with _n and _size; one sort numbers and counts them."""
    window = Window.partitionBy(*by).orderBy(*order)
    size = F.count(F.lit(1)).over(window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumns({"_n": F.row_number().over(window), "_size": size}).filter((F.col("_n") <= n) & (F.col("_size") >= least))


def eleven(df: DataFrame, by: Sequence[str], line: str, formation: dict[str, int], order: Sequence[Column]) -> DataFrame:
    """Each line's quota by ``order``, then the best of the rest until the eleven is full."""
    quota = F.lit(0)
    for name, n in formation.items():
        quota = F.when(F.col(line) == name, F.lit(n)).otherwise(quota)
    in_line = F.row_number().over(Window.partitionBy(*by, line).orderBy(*order))
    marked = df.withColumn("starter", in_line <= quota)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("starter"), *order))
    return marked.withColumn("place", place).filter(F.col("place") <= sum(formation.values()))


def latest(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_n_per_group(df, by, order, 1)


def bottom_share(value: str, by: Sequence[str], least: int = 20) -> Column:
    """The share of peers strictly below; null with fewer than ``least`` peers."""
    group = Window.partitionBy(*by)
    below = F.rank().over(group.orderBy(F.asc_nulls_last(value))) - 1
    peers = F.count(value).over(group)
    return F.when((peers >= least) & F.col(value).isNotNull(), below / peers)


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def sound(vector: Column, width: Column) -> Column:
    """Whether a vector has a distance to others: so many values, all finite numbers."""
    return (F.size(vector) == width) & ~F.exists(vector, lambda x: x.isNull() | ~F.abs(x).between(0.0, 1e300))


def nearest_vectors(subjects: DataFrame, vectors: DataFrame, id_col: str, vector_col: str, n: int, digits: int | None = None) -> DataFrame:
    """For each subject, the ``n`` nearest other vectors by Euclidean distance, of equal ones the smaller id.

    With ``digits`` distances are rounded first, and the rounded ones decide.  A distance to or from a
    vector that is null, has another length or a value that is no finite number is null and comes last.
    Ids are whole numbers.

    Subjects are sent in blocks whose numbers take about ``BROADCAST_BYTES``: each block is one pass
    over the vectors, a product of matrices at a time.  Each task keeps the ``n`` nearest it has seen of
    a subject, so only those move.
    """
    spark = vectors.sparkSession
    subject = subjects.select(F.col(id_col).alias("subject"), F.col(vector_col).alias("_s"))
    octets, width = subject.agg(F.coalesce(F.sum(F.size("_s")), F.lit(0)) * 8, F.coalesce(F.max(F.size("_s")), F.lit(0))).first()
    blocks = max(1, -(-int(octets) // BROADCAST_BYTES))
    whole = lambda c: sound(c, F.lit(width))
    known = vectors.filter(whole(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    spread = known.repartition(2 * spark.sparkContext.defaultParallelism)
    asked, parts = subject.filter(whole(F.col("_s"))), []
    for i in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("subject"), F.lit(blocks)) == i).select(F.col("subject").cast("long"), "_s").toArrow()
        sent = spark.sparkContext.broadcast((block["subject"].to_numpy(), _matrix(block["_s"].combine_chunks(), width)))
        parts.append(spread.mapInArrow(lambda batches, sent=sent: nearest_in_batches(batches, *sent.value, n, digits), "subject long, neighbour long, distance double"))
    # what has no distance: the smallest ids do, as no other of them can be among the first n
    least = lambda df: F.broadcast(df.select(F.col(id_col).cast("long").alias("neighbour")).orderBy("neighbour").limit(n + 1))
    lacking = subject.filter(~F.coalesce(whole(F.col("_s")), F.lit(False))).select("subject").crossJoin(least(vectors))
    lacking = lacking.unionByName(asked.select("subject").crossJoin(least(vectors.filter(~F.coalesce(whole(F.col(vector_col)), F.lit(False))))))
    parts.append(lacking.filter("subject <> neighbour").select(F.col("subject").cast("long"), "neighbour", F.lit(None).cast("double").alias("distance")))
    return top_n_per_group(reduce(DataFrame.union, parts), ["subject"], [F.asc_nulls_last("distance"), F.asc("neighbour")], n, "place")


def _matrix(vectors, width: int) -> np.ndarray:
    return np.asarray(vectors.flatten()).reshape(-1, width)


def nearest_in_batches(batches: Iterator, ids: np.ndarray, subjects: np.ndarray, n: int, digits: int | None) -> Iterator:
    """(subject, neighbour, distance): of the vectors of ``batches``, the ``n`` nearest to each subject.

    A product of matrices bounds all squared distances of a tile; those that may be among the nearest are
    measured again from the differences, as the published distance is.
    """
    count = len(ids)
    near, at, wide = np.full((count, n), np.inf), np.full((count, n), np.iinfo(np.int64).max), subjects.astype(np.float64)
    norms = (wide**2).sum(axis=1)

    def measured(rows: np.ndarray, columns: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows))
        for k in range(0, len(rows), 1 << 15):
            piece = slice(k, k + (1 << 15))
            squares = (x[columns[piece]] - subjects[rows[piece]]).astype(np.float64) ** 2
            out[piece] = np.sqrt(np.add.accumulate(squares, axis=1)[:, -1]) if squares.shape[1] else 0.0
        return out if digits is None else np.floor(out * 10.0**digits + 0.5) / 10.0**digits

    for batch in batches:
        keys, x = batch.column(0).to_numpy(), _matrix(batch.column(1), subjects.shape[1])
        for j in range(0, len(keys), TILE):
            own, part = keys[j : j + TILE], x[j : j + TILE]
            other = part.astype(np.float64)
            lengths = (other**2).sum(axis=1)
            for i in range(0, count, TILE):
                tile = slice(i, i + TILE)
                scale = norms[tile, None].max(initial=0.0) + lengths.max(initial=0.0)
                bound = norms[tile, None] + lengths - 2.0 * (wide[tile] @ other.T)
                bound[ids[tile, None] == own] = np.inf
                slack = 1e-9 * scale + 1e-30
                worst = near[tile, -1]
                fresh = np.isinf(worst)
                limit = (worst + (0.0 if digits is None else 10.0**-digits)) ** 2
                if fresh.any() and len(own) > n:
                    limit[fresh] = np.partition(bound[fresh], n - 1, axis=1)[:, n - 1]
                    if digits is not None:
                        limit[fresh] = (np.sqrt(np.maximum(limit[fresh], 0.0) + slack) + 10.0**-digits) ** 2
                rows, columns = np.nonzero((bound <= (limit * (1 + 1e-6) + slack)[:, None]) & np.isfinite(bound))
                if not len(rows):
                    continue
                distance = measured(rows + i, columns, part)
                better = (distance < worst[rows]) | ((distance == worst[rows]) & (own[columns] < at[tile][rows, -1]))
                rows, columns, distance = rows[better], columns[better], distance[better]
                touched = np.unique(rows)
                r = np.concatenate([np.repeat(touched, n), rows])
                d = np.concatenate([near[tile][touched].ravel(), distance])
                k = np.concatenate([at[tile][touched].ravel(), own[columns]])
                order = np.lexsort((k, d, r))
                r, d, k = r[order], d[order], k[order]
                first = np.searchsorted(r, touched)[:, None] + np.arange(n)
                near[tile][touched], at[tile][touched] = d[first], k[first]
    held = np.isfinite(near)
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, held.sum(axis=1))), pa.array(at[held]), pa.array(near[held])], ["subject", "neighbour", "distance"])
