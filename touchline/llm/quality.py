"""Quality classifier: random Fourier features of document statistics, ridge regression by
partition-summed normal equations, isotonic calibration.

The statistics of a text are computed in one pass; everything that is learned afterwards works on
those few numbers.  A fixed, seeded projection turns the standardised statistics into cosines
that approximate a Gaussian kernel.  Partitions sum the normal equations of two halves of the
training rows; each half is scored by the other half's fit for the calibration, and the final fit
uses both.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.kernels import WHITE, hash_words, slices, text_bytes, words
from touchline.llm.shared import stash

#: Random features, kernel width (in standard deviations), ridge penalty per feature, calibration bins.
FEATURES = 256
WIDTH = 2.5
PENALTY = 1e-3
BINS = 2048
#: Partitions that sum the normal equations last; the driver gets one matrix from each.
SUMMING = 8

STATISTICS = (
    "log_words",
    "log_word_length",
    "upper_share",
    "digit_share",
    "symbol_share",
    "shout_share",
    "bar_share",
    "stop_share",
    "distinct_share",
    "top_share",
    "line_share",
    "tail_symbol_share",
    "other_script_share",
    "log_longest",
    "repeat_share",
    "sentence_share",
)


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[ord(c) for c in chars]] = True
    return table


_SYMBOL, _DIGIT, _STOP = _class("#$%&*@^~<>{}[]\\/=+_"), _class("0123456789"), _class(".,;:?")
_ASCII_UPPER, _ASCII_LOWER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz")


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


def statistics(column: pa.Array) -> np.ndarray:
    """(rows, len(STATISTICS)) of one slice of texts; a text without words is all zero."""
    raw, offsets = text_bytes(column)
    starts, ends, at = words(raw, offsets)
    n = np.diff(at)
    docs = np.repeat(np.arange(len(n)), n)
    size = np.maximum(_sums(~WHITE[raw], offsets), 1)
    count = np.maximum(n, 1).astype(np.float64)
    # É and its like: the second byte of U+00C0..U+00DE
    second = np.zeros(len(raw), dtype=bool)
    second[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
    upper, lower = _ASCII_UPPER[raw] | second, _ASCII_LOWER[raw]
    letters = np.maximum(_sums(upper | lower | ((raw >= 0xC0) & ~second), offsets), 1)
    length = (ends - starts).astype(np.float64)
    longest = np.zeros(len(n))
    np.maximum.at(longest, docs, length)
    hashes = hash_words(raw, starts, ends, lower=True)
    distinct, top = np.zeros(len(n)), np.zeros(len(n))
    for d in range(len(n)):
        if n[d]:
            _, counts = np.unique(hashes[at[d] : at[d + 1]], return_counts=True)
            distinct[d], top[d] = len(counts), counts.max()
    repeat = np.zeros(len(hashes), dtype=bool)
    if len(hashes):
        repeat[1:] = (hashes[1:] == hashes[:-1]) & (docs[1:] == docs[:-1])
    tail = _SYMBOL[raw[ends - 1]] | (raw[ends - 1] == ord("!")) if len(ends) else np.zeros(0, bool)
    out = np.stack(
        [
            np.log1p(n),
            np.log1p(np.bincount(docs, length, len(n)) / count),
            _sums(upper, offsets) / letters,
            _sums(_DIGIT[raw], offsets) / size,
            _sums(_SYMBOL[raw], offsets) / size,
            _sums(raw == ord("!"), offsets) / count,
            _sums(raw == ord("|"), offsets) / count,
            _sums(_STOP[raw], offsets) / count,
            distinct / np.sqrt(count),
            top / count,
            _sums(raw == 10, offsets) / count,
            np.bincount(docs, tail, len(n)) / count,
            _sums(raw >= 0xC0, offsets) / letters,
            np.log1p(longest),
            np.bincount(docs, repeat, len(n)) / count,
            _sums((raw == ord(".")), offsets) / count,
        ],
        axis=1,
    )
    out[n == 0] = 0
    return out


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(1)
        parts = [statistics(text.slice(i, j - i)) for i, j in slices(text)]
        flat = np.concatenate(parts).ravel() if parts else np.zeros(0)
        offsets = pa.array(np.arange(len(text) + 1, dtype=np.int32) * len(STATISTICS))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["doc_id", "stats"])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, stats of every row; null text counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_statistics, "doc_id long, stats array<double>")


@dataclass
class QualityModel:
    """Everything a score needs; a few hundred numbers, shipped with the task."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, stats: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return fourier(stats, self.mean, self.scale) @ (self.weights if weights is None else weights)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.values)


def fourier(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, width: float = WIDTH) -> np.ndarray:
    """Standardised statistics -> cosines and a constant."""
    draw = np.random.default_rng(7)
    spread = draw.normal(size=(len(mean), features)) / width
    shift = draw.uniform(0, 2 * np.pi, features)
    z = np.clip((stats - mean) / scale, -6, 6)
    return np.concatenate([np.sqrt(2 / features) * np.cos(z @ spread + shift), np.ones((len(z), 1))], axis=1)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points in order of x: (centres, values) of the blocks."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x.tolist(), y.tolist(), weight.tolist(), strict=True):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(train: DataFrame) -> QualityModel:
    """Learn from rows of (doc_id, stats, label).  Every row counts; a null label is left out.

    Without any row the model scores 0.5 everywhere; with one class only, that class's rate.
    """
    size = len(STATISTICS)
    train = train.filter("label is not null").withColumn("half", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(2)))
    row = train.agg(F.count(F.lit(1)).alias("n"), *[f(F.col("stats")[i]).alias(f"{f.__name__}{i}") for i in range(size) for f in (F.avg, F.stddev_pop)]).first()
    if not row["n"]:
        return QualityModel(np.zeros(size), np.ones(size), np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))
    mean = np.array([row[f"avg{i}"] for i in range(size)])
    scale = np.maximum(np.array([row[f"stddev_pop{i}"] for i in range(size)]), 1e-6)
    dims = FEATURES + 1

    def normal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, right = np.zeros((2, dims, dims)), np.zeros((2, dims))
        for frame in frames:
            if len(frame):
                z, y, half = fourier(np.stack(frame["stats"].to_numpy()), mean, scale), frame["label"].to_numpy(float), frame["half"].to_numpy()
                for h in (0, 1):
                    mine = z[half == h]
                    gram[h] += mine.T @ mine
                    right[h] += mine.T @ y[half == h]
        yield pd.DataFrame({"part": [0], "sums": [np.concatenate([gram.ravel(), right.ravel()])]})

    def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(2 * dims * (dims + 1))
        for frame in frames:
            for sums in frame["sums"]:
                total += sums
        yield pd.DataFrame({"part": [0], "sums": [total]})

    kind = "part int, sums array<double>"
    partial = train.select("stats", "label", "half").mapInPandas(normal, kind)
    # in two levels, so that no task adds up the partitions of a large table
    between = partial.repartition(max(SUMMING, min(1000, math.isqrt(row["n"] // 1000)))).mapInPandas(added, kind)
    sums = np.sum([r["sums"] for r in between.repartition(SUMMING).mapInPandas(added, kind).collect()], axis=0)
    gram, right = sums[: 2 * dims * dims].reshape(2, dims, dims), sums[2 * dims * dims :].reshape(2, dims)

    def solve(g: np.ndarray, r: np.ndarray) -> np.ndarray:
        return np.linalg.solve(g + PENALTY * max(1.0, g[-1, -1] / dims) * np.eye(dims), r)

    model = QualityModel(mean, scale, solve(gram.sum(0), right.sum(0)), np.array([0.0]), np.array([0.5]))
    other = [solve(gram[1], right[1]), solve(gram[0], right[0])]

    def binned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                stats, half = np.stack(frame["stats"].to_numpy()), frame["half"].to_numpy()
                raw = np.where(half == 0, model.raw(stats, other[0]), model.raw(stats, other[1]))
                bins = np.clip(np.floor((raw + 0.5) / 2 * BINS), 0, BINS - 1).astype(int)
                yield pd.DataFrame({"bin": bins, "label": frame["label"].to_numpy(float)}).groupby("bin", as_index=False).agg(n=("label", "size"), ones=("label", "sum"))

    bins = (
        train.select("stats", "label", "half").mapInPandas(binned, "bin int, n long, ones double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).orderBy("bin").toPandas()
    )
    centre = (bins["bin"].to_numpy() + 0.5) / BINS * 2 - 0.5
    model.knots, model.values = isotonic(centre, bins["ones"].to_numpy() / bins["n"].to_numpy(), bins["n"].to_numpy(float))
    return model


def labelled(stats: DataFrame, labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """(doc_id, stats, label) of every pair of a row of statistics and a label of its id."""
    known = labels.select(F.col("doc_id").alias("label_id"), F.col(label_col).cast("double").alias("label")).filter("label is not null")
    return stats.join(known, F.col("doc_id") == F.col("label_id")).select("doc_id", "stats", "label")


def score(stats: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score of every row of (doc_id, stats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(model.score(values), 0.0, 1.0))], names=["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: QualityModel, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, all columns; narrow, so no text is shuffled."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(at)
            scores = [model.score(statistics(text.slice(i, j - i))) for i, j in slices(text)]
            yield batch.filter(pa.array(np.concatenate(scores) >= least)) if scores else batch

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, train_rows, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, score, predicted of every row of ``docs``.

    ``train_rows`` is a Column over ``doc_id`` that says which ids may be learned from; all
    labelled rows it admits are used.  Null text counts as empty, repeated rows are scored each,
    and other columns of either table are ignored.
    """
    stats = stash(document_statistics(docs, id_col, text_col), "stats")
    model = fit(labelled(stats.filter(train_rows), labels, label_col))
    return score(stats, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
