"""Three-way logistic heads over subsets of the same columns, all fitted together by Newton's method.

Each step is one pass over the rows for all heads: tasks add up gradients and Hessians a batch at a time,
Spark adds up tasks, the driver solves one small system a head.  Steps are few and their number hardly
depends on the columns, so a table is read a few times, however many heads there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.scoring import OUTCOMES

#: Newton steps and halvings of a step at most, and the mean log-likelihood that a last step may still promise.
STEPS, HALVINGS, PROMISE = 50, 10, 1e-9


def _values(batch: pa.RecordBatch, first: int) -> np.ndarray:
    """The batch's columns from ``first`` on as doubles, a missing value as NaN."""
    return np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[first:]], axis=1).astype(np.float64) if batch.num_columns > first else np.empty((batch.num_rows, 0))


def summed(df: DataFrame, size: int, add: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray:
    """``size`` sums over all rows: ``add(total, batch)`` adds a batch to its task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            add(total, batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["cell", "value"])

    found = df.mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


class Design:
    """What a head sees of a row: its columns as z-scores, a missing one as their mean, flags of those missing, and 1.

    Columns that are missing in the same rows of the training set share a flag, which is the mean of
    theirs elsewhere; those without spread and flags that are never or always up are left out.
    """

    def __init__(self, columns: Sequence[int], mean: np.ndarray, spread: np.ndarray, missing: np.ndarray, n: float):
        self.columns = np.array([c for c in columns if spread[c] > 0], int)
        self.mean, self.scale = mean[self.columns], spread[self.columns]
        groups: list[list[int]] = []
        for c in [c for c in columns if np.isfinite(mean[c]) and 0 < missing[c, c] < n]:
            same = next((g for g in groups if missing[c, c] == missing[g[0], g[0]] == missing[c, g[0]]), None)
            if same is None:
                groups.append([c])
            else:
                same.append(c)
        self.flags = np.zeros((len(mean), len(groups)))
        for j, g in enumerate(groups):
            share = missing[g[0], g[0]] / n
            self.flags[g, j] = 1 / len(g) / np.sqrt(share * (1 - share))
        self.width = len(self.columns) + len(groups) + 1

    def matrix(self, values: np.ndarray) -> np.ndarray:
        gone = np.isnan(values)
        z = np.where(gone[:, self.columns], 0.0, (values[:, self.columns] - self.mean) / self.scale)
        return np.concatenate([z, gone @ self.flags, np.ones((len(values), 1))], axis=1)


def shares(x: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, 3) shares of the outcomes, and the logarithm of their scale; the last outcome's score is 0."""
    scores = np.concatenate([x @ beta.T, np.zeros((len(x), 1))], axis=1)
    top = scores.max(axis=1, keepdims=True)
    parts = np.exp(scores - top)
    total = parts.sum(axis=1, keepdims=True)
    return parts / total, scores - top - np.log(total)


class Heads:
    """Fitted heads by name; ``predict`` adds their shares."""

    def __init__(self, columns: Sequence[str], designs: dict[str, Design], betas: dict[str, np.ndarray]):
        self.columns, self.designs, self.betas = list(columns), designs, betas

    def predict(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """The columns ``keep`` and, of the i-th head, ``ph_i``, ``pd_i`` and ``pa_i``."""
        designs, betas, first = list(self.designs.values()), list(self.betas.values()), len(keep)
        names = [*keep, *[f"{p}_{i}" for i in range(len(betas)) for p in ("ph", "pd", "pa")]]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values, out = _values(batch, first), batch.columns[:first]
                for design, beta in zip(designs, betas, strict=True):
                    out += [pa.array(c) for c in shares(design.matrix(values), beta)[0].T]
                yield pa.RecordBatch.from_arrays(out, names=names)

        kinds = dict(df.dtypes)
        schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], *[f"{n} double" for n in names[first:]]])
        return df.select(*keep, *[F.col(c).cast("double") for c in self.columns]).mapInArrow(run, schema)


def fit_heads(train: DataFrame, heads: Mapping[str, Sequence[str]], actual: str = "FTR") -> Heads:
    """A head a name, on its columns, by maximum likelihood; ``train`` is a written table, read a few times.

    Rows whose result is none of H, D, A take no part.  Where columns depend on each other, the step
    of least norm is taken; one that would lower the likelihood is halved.  The driver holds a head's square of columns.
    """
    columns = list(dict.fromkeys(c for own in heads.values() for c in own))
    at = {c: i for i, c in enumerate(columns)}
    label = F.array_position(F.array(*[F.lit(o) for o in OUTCOMES]), F.col(actual)) - 1
    rows = train.select(label.cast("int").alias("_y"), *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns]).filter("_y >= 0")
    size = len(columns)
    near = rows.limit(1000).toPandas()[columns].mean().fillna(0.0).to_numpy(float)  # squares are taken about it, so that they do not cancel

    def count(total: np.ndarray, batch: pa.RecordBatch) -> None:
        values = _values(batch, 1)
        gone = np.isnan(values)
        moved = np.where(gone, 0.0, values - near)
        parts = gone.T.astype(np.float64) @ gone, moved.sum(axis=0), (moved * moved).sum(axis=0), np.bincount(batch.column(0).to_numpy(), minlength=3)
        total += np.concatenate([p.ravel() for p in parts])

    sums = summed(rows, size * size + 2 * size + 3, count)
    counts, n = sums[-3:], float(sums[-3:].sum())
    missing, first, second = sums[: size * size].reshape(size, size), sums[size * size :][:size], sums[size * size + size :][:size]
    seen = n - missing.diagonal()
    shift = np.divide(first, seen, out=np.full(size, np.nan), where=seen > 0)
    mean, spread = near + shift, np.sqrt(np.maximum(second - first * np.nan_to_num(shift), 0.0) / np.maximum(seen, 1.0))
    spread = np.where(spread > 1e-12 * np.abs(mean), spread, 0.0)
    prior = np.log(np.maximum(counts, 1e-9 * max(n, 1.0)))
    designs = {h: Design([at[c] for c in own], mean, spread, missing, n) for h, own in heads.items()}
    betas = {h: np.concatenate([np.zeros((2, d.width - 1)), (prior[:2] - prior[2])[:, None]], axis=1) for h, d in designs.items()}
    best = {h: (np.inf, b, np.zeros_like(b)) for h, b in betas.items()}  # loss, place and step of the last place that was kept
    open_, halved = list(heads), dict.fromkeys(heads, 0)
    for _ in range(STEPS):
        if not open_ or not n:
            break
        sums = _derivatives(rows, {h: (designs[h], betas[h]) for h in open_}, n)
        for h, (loss, gradient, hessian) in sums.items():
            if loss > best[h][0] + 1e-12 * abs(best[h][0]):
                halved[h] += 1
                kept, place, step = best[h]
                betas[h], best[h] = (place, best[h]) if halved[h] > HALVINGS else (place - step / 2, (kept, place, step / 2))
                if halved[h] > HALVINGS:
                    open_.remove(h)
                continue
            step = np.linalg.lstsq(hessian, gradient, rcond=1e-11)[0]
            promise, place, halved[h] = gradient @ step / 2, betas[h], 0
            step = step.reshape(place.shape)
            best[h], betas[h] = (loss, place, step), place - step
            if promise < PROMISE:  # of this step; that of the next would be about its square
                open_.remove(h)
    return Heads(columns, designs, betas)


def _derivatives(rows: DataFrame, heads: Mapping[str, tuple[Design, np.ndarray]], n: float) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """Mean loss, gradient and Hessian of every head, from one pass."""
    parts = list(heads.values())
    sizes = [1 + 2 * d.width + 3 * d.width**2 for d, _ in parts]
    starts = np.cumsum([0, *sizes])

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        y, values = batch.column(0).to_numpy(), _values(batch, 1)
        hits = np.eye(3)[y]
        for (design, beta), start, q in zip(parts, starts, [d.width for d, _ in parts], strict=False):
            x = design.matrix(values)
            p, logs = shares(x, beta)
            total[start] -= logs[np.arange(len(y)), y].sum()
            total[start + 1 : start + 1 + 2 * q] += ((p - hits)[:, :2].T @ x).ravel()
            at = start + 1 + 2 * q
            for w in (p[:, 0] * (1 - p[:, 0]), -p[:, 0] * p[:, 1], p[:, 1] * (1 - p[:, 1])):
                total[at : at + q * q] += ((x * w[:, None]).T @ x).ravel()
                at += q * q

    found = summed(rows, int(starts[-1]), add) / n
    out = {}
    for h, start, (design, _) in zip(heads, starts, parts, strict=False):
        q = design.width
        blocks = found[start + 1 + 2 * q :][: 3 * q * q].reshape(3, q, q)
        out[h] = float(found[start]), found[start + 1 :][: 2 * q], np.block([[blocks[0], blocks[1]], [blocks[1].T, blocks[2]]])
    return out
