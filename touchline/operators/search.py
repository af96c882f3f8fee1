"""Finding players: filters, a whitelisted order and pages; the players most like one, on a scale of their pool."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.pair_distances import median_distance
from touchline.operators.ranking import nearest_vectors


def search(df: DataFrame, equal: dict[str, object] | None = None, contains: dict[str, str] | None = None, least: dict[str, float] | None = None, sort: str | None = None, descending: bool = True, sortable: Sequence[str] = (), key: Sequence[str] = (), offset: int = 0, limit: int = 50) -> tuple[DataFrame, int]:
    """(page, total): the rows that pass all filters, in order, and how many there are in all.

    ``equal`` compares (a null asks for null), ``contains`` looks for text in any case, literally, ``least``
    is a lower bound.  ``sort`` must be one of ``sortable``; nulls come last, and ``key`` breaks ties.
    """
    if sort is not None and sort not in sortable:
        raise ValueError(f"{sort} is no column to sort by")
    found = df
    for c, v in (equal or {}).items():
        found = found.filter(F.col(c).eqNullSafe(F.lit(v)))
    for c, text in (contains or {}).items():
        if text and text.strip():
            found = found.filter(F.contains(F.lower(F.col(c)), F.lit(text.strip().lower())))
    for c, bound in (least or {}).items():
        found = found.filter(F.col(c) >= bound)
    order = ([F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort)] if sort else []) + [F.asc(k) for k in key]
    return (found.orderBy(*order) if order else found).offset(offset).limit(limit), found.count()


def reference_distance(vectors: DataFrame, id_col: str, vector_col: str, sample: int | None = None, width: int | None = None) -> float:
    """The median distance of two rows of a pool, over all its pairs (see ``median_distance``).

    A caller who asks for a ``sample`` gets that of so many rows picked by a hash of the id, whose vectors
    the driver holds.  The same pool gives the same distance however it is dealt.  0 with fewer than two rows.
    """
    if sample is None:
        return median_distance(vectors, id_col, vector_col, width)
    rows = vectors.filter(F.col(vector_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(sample).select(vector_col).collect()
    if len(rows) < 2:
        return 0.0
    x = np.array([r[0] for r in rows], dtype=np.float64)
    gaps = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=-1))
    return float(np.median(gaps[np.triu_indices(len(x), 1)]))


def similar(subjects: DataFrame, vectors: DataFrame, id_col: str, vector_col: str, n: int, sample: int | None = None) -> DataFrame:
    """(subject, neighbour, distance, place, similarity): the ``n`` nearest and how alike they are, 0 to 100.

    Likeness halves with every usual distance of the pool: 100 for the same values, 50 for a usual pair.
    In a pool without distance, the same values are 100 and others 0.
    """
    width = subjects.agg(F.max(F.size(vector_col))).first()[0]
    usual = reference_distance(vectors, id_col, vector_col, sample, width)
    found = nearest_vectors(subjects.filter(F.col(vector_col).isNotNull()), vectors.filter(F.col(vector_col).isNotNull()), id_col, vector_col, n)
    alike = F.round(F.lit(100.0) * F.pow(F.lit(0.5), F.col("distance") / usual), 1) if usual > 0 else F.when(F.col("distance") == 0, 100.0).otherwise(0.0)
    return found.withColumn("similarity", alike)
