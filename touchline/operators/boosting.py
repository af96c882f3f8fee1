"""Gradient boosting of counts on histograms: Poisson trees that Spark grows level by level.

Values are cut into quantile bins once and written as one byte a feature.  A level of a tree is
one pass over that table: every task sums gradient, Hessian and rows by (node, feature, bin) in
numpy, Spark adds the tasks' sums up, and the driver, which sees those sums only, picks the splits.
Their number is bounded by the parameters, not by the rows.  Several targets (home and away goals)
grow side by side in the same passes.

Missing values have a bin of their own, and each split sends them to the side where they gain
more.  Sums are in fixed point, so a fit is the same however the rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.sources.sinks import delete, written

#: The byte of a missing value; so there are fewer bins than this.
MISSING = 255
#: Gradients and Hessians are counted in this unit.
UNIT = 2.0**-24
#: Trees that are applied anew in each pass, before the scores are written again.
PENDING = 8


@dataclass
class Tree:
    """Nodes in arrays; the children of a leaf are -1.  A row goes left if its bin is at most ``cut``."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    rows: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: float, rows: float) -> int:
        for column, x in ((self.feature, -1), (self.cut, -1), (self.missing_left, False), (self.left, -1), (self.right, -1), (self.value, value), (self.rows, rows), (self.gain, 0.0)):
            column.append(x)
        return len(self.feature) - 1

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row of a (rows, features) array of bins ends in."""
        at = np.zeros(len(bins), dtype=np.int64)
        feature, cut, missing_left, left, right = (np.array(c) for c in (self.feature, self.cut, self.missing_left, self.left, self.right))
        rows = np.flatnonzero(left[at] >= 0)
        while len(rows):
            node = at[rows]
            value = bins[rows, feature[node]]
            go_left = np.where(value == MISSING, missing_left[node], value <= cut[node])
            at[rows] = np.where(go_left, left[node], right[node])
            rows = rows[left[at[rows]] >= 0]
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(bins)]


def binned(columns: Sequence[np.ndarray], edges: Sequence[np.ndarray]) -> np.ndarray:
    """(rows, features) bytes: how many edges lie below a value; NaN is ``MISSING``."""
    out = np.empty((len(columns[0]) if len(columns) else 0, len(columns)), dtype=np.uint8)
    for i, (column, edge) in enumerate(zip(columns, edges, strict=True)):
        out[:, i] = np.where(np.isnan(column), MISSING, np.searchsorted(edge, column, "left"))
    return out


def bin_edges(df: DataFrame, features: Sequence[str], bins: int) -> dict[str, np.ndarray]:
    """Per feature the distinct quantiles that part its bins; features without any value are left out."""
    if not 2 <= bins < MISSING:
        raise ValueError(f"between 2 and {MISSING - 1} bins")
    shares = [k / bins for k in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.nanvl(F.col(f).cast("double"), F.lit(None)), shares, 100 * bins).alias(f"q{i}") for i, f in enumerate(features)]).first()
    return {f: np.unique(np.array(row[i], dtype=np.float64)) for i, f in enumerate(features) if row[i] is not None}


@dataclass
class Boosted:
    """Trees of each target, over shared bins; a prediction is exp(base + sum of leaves)."""

    features: list[str]
    edges: list[np.ndarray]
    targets: list[str]
    base: list[float]
    trees: list[list[Tree]]

    def to_dict(self) -> dict:
        """The model as plain values, for JSON."""
        trees = [[{k: [float(x) if k in ("value", "rows", "gain") else x for x in v] for k, v in vars(t).items()} for t in of] for of in self.trees]
        return {"features": list(self.features), "edges": [e.tolist() for e in self.edges], "targets": list(self.targets), "base": list(self.base), "trees": trees}

    @classmethod
    def from_dict(cls, values: dict) -> Boosted:
        return cls(values["features"], [np.array(e) for e in values["edges"]], values["targets"], values["base"], [[Tree(**t) for t in of] for of in values["trees"]])

    def _bins(self, columns: Sequence[pd.Series]) -> np.ndarray:
        return binned([c.to_numpy(dtype=np.float64, na_value=np.nan) for c in columns], self.edges)

    def predict(self, df: DataFrame, prefix: str = "mu_") -> DataFrame:
        """``df`` with the expected count of every target, never below 1e-6."""
        model = self
        names = [f"{prefix}{t}" for t in self.targets]

        @F.pandas_udf(", ".join(f"`{n}` double" for n in names))
        def rates(*columns: pd.Series) -> pd.DataFrame:
            bins = model._bins(columns)
            raw = [b + sum((t.predict(bins) for t in trees), np.zeros(len(bins))) for b, trees in zip(model.base, model.trees, strict=True)]
            return pd.DataFrame({n: np.maximum(np.exp(r), 1e-6) for n, r in zip(names, raw, strict=True)})

        found = df.withColumn("_rates", rates(*[F.col(f).cast("double") for f in self.features]))
        return found.select(*df.columns, *[F.col("_rates")[n].alias(n) for n in names])

    def drivers(self, df: DataFrame, keys: Sequence[str], top: int | None = None) -> DataFrame:
        """(keys, target, feature, contribution, place): what moved each row's log rate from the mean.

        Exact Shapley values of the trees under their own distribution of rows: a feature that is
        not known goes down both branches by their shares of rows.  A row's contributions and
        ``expected`` add up to the logarithm of its prediction.  ``top`` keeps the largest by
        size; ties go by the feature's name.
        """
        model = self

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                bins = model._bins([batch[f"_x{i}"] for i in range(len(model.features))])
                for target, base, trees in zip(model.targets, model.base, model.trees, strict=True):
                    share, expected = np.zeros((len(batch), len(model.features))), base
                    for tree in trees:
                        expected += shapley(tree, bins, share)
                    out = batch[list(keys)].copy()
                    out["target"], out["expected"], out["_share"] = target, expected, list(share)
                    yield out

        kinds = dict(df.dtypes)
        schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["target string", "expected double", "_share array<double>"])
        rows = df.select(*keys, *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(self.features)]).mapInPandas(run, schema)
        pairs = F.zip_with(F.array(*[F.lit(f) for f in self.features]), "_share", lambda f, v: F.struct((-F.abs(v)).alias("size"), f.alias("feature"), v.alias("contribution")))
        ordered = F.array_sort(pairs)
        rows = rows.select(*keys, "target", "expected", F.posexplode(F.slice(ordered, 1, top) if top else ordered).alias("_place", "_d"))
        return rows.select(*keys, "target", "expected", (F.col("_place") + 1).alias("place"), "_d.feature", "_d.contribution")


def shapley(tree: Tree, bins: np.ndarray, share: np.ndarray) -> float:
    """Adds the tree's Shapley values to ``share``; returns its mean over the rows it was fitted on.

    A leaf on a path with d features is a product of d factors, each 1 or 0 where the feature is
    known and the share of rows that go that way where it is not.  The value of a product is found
    per feature from the sums over subsets of each size of the others.
    """
    mean, stack = 0.0, [(0, {}, 1.0)]
    while stack:
        node, path, weight = stack.pop()
        if tree.left[node] >= 0:
            f = tree.feature[node]
            value = bins[:, f]
            goes_left = np.where(value == MISSING, tree.missing_left[node], value <= tree.cut[node])
            for child, goes in ((tree.left[node], goes_left), (tree.right[node], ~goes_left)):
                part = tree.rows[child] / tree.rows[node]
                known, unknown = path.get(f, (True, 1.0))
                stack.append((child, {**path, f: (known & goes, unknown * part)}, weight * part))
            continue
        mean += weight * tree.value[node]
        d = len(path)
        for f, (known, unknown) in path.items():
            sums = [np.ones(len(bins))]
            for g, (k, u) in path.items():
                if g != f:
                    sums = [(sums[i] * u if i < len(sums) else 0.0) + (sums[i - 1] * k if i else 0.0) for i in range(len(sums) + 1)]
            total = sum(factorial(i) * factorial(d - i - 1) / factorial(d) * s for i, s in enumerate(sums))
            share[:, f] += total * (known.astype(np.float64) - unknown) * tree.value[node]
    return mean


def _split(cells: np.ndarray, l2: float, least_rows: int) -> tuple[float, int, int, bool, np.ndarray] | None:
    """The best (gain, feature, cut, missing_left, sums on the left) of one node's (features, bins + 1, 3) sums."""
    known, missing = cells[:, :-1, :], cells[:, -1:, :]
    total = cells[0].sum(axis=0)
    best = None
    for missing_left in (False, True):
        left = np.cumsum(known, axis=1)[:, :-1, :] + (missing if missing_left else 0)
        right = total - left
        fit = (left[..., 2] >= least_rows) & (right[..., 2] >= least_rows) & (left[..., 1] > 0) & (right[..., 1] > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left[..., 0] ** 2 / (left[..., 1] + l2) + right[..., 0] ** 2 / (right[..., 1] + l2) - total[0] ** 2 / (total[1] + l2)
        gain = np.where(fit, gain, -np.inf)
        f, cut = np.unravel_index(int(np.argmax(gain)), gain.shape)
        if gain[f, cut] > 1e-9 and (best is None or gain[f, cut] > best[0]):
            # without missing values, later ones go where most rows went
            side = missing_left if missing[f, 0, 2] else bool(left[f, cut, 2] > right[f, cut, 2])
            best = float(gain[f, cut]), int(f), int(cut), side, left[f, cut]
    return best


def _pruned(tree: Tree, leaves: int) -> Tree:
    """The same tree grown best split first up to so many leaves."""
    out = Tree()
    out.add(tree.value[0], tree.rows[0])
    open_nodes, n = [(0, 0)], 1  # (node there, node here)
    while n < leaves:
        splits = [(tree.gain[a], -a, a, b) for a, b in open_nodes if tree.left[a] >= 0]
        if not splits:
            break
        _, _, a, b = max(splits)
        open_nodes.remove((a, b))
        out.feature[b], out.cut[b], out.missing_left[b], out.gain[b] = tree.feature[a], tree.cut[a], tree.missing_left[a], tree.gain[a]
        for side in ("left", "right"):
            child = getattr(tree, side)[a]
            getattr(out, side)[b] = out.add(tree.value[child], tree.rows[child])
            open_nodes.append((child, getattr(out, side)[b]))
        n += 1
    return out


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, width)


def _advance(table: DataFrame, width: int, pending: list[list[Tree]]) -> DataFrame:
    """The table with the pending trees added to its scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, columns = _matrix(batch, width), list(batch.columns)
            for k, trees in enumerate(pending):
                raw = columns[3 + 2 * k].to_numpy() + sum((t.predict(bins) for t in trees), np.zeros(len(bins)))
                columns[3 + 2 * k] = pa.array(raw)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return table.mapInArrow(run, table.schema)


def _sums(table: DataFrame, width: int, bins: int, pending: list[list[Tree]], growing: list[Tree], frontier: list[list[int]]) -> dict[tuple[int, int], np.ndarray]:
    """Per target and frontier node the (features, bins + 1, 3) sums of gradient, Hessian and rows."""
    size = width * (bins + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((len(nodes) * size, 3)) for nodes in frontier]
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, weight = _matrix(batch, width), batch.column(1).to_numpy()
            cells = np.where(codes == MISSING, bins, codes).astype(np.int64) + np.arange(width) * (bins + 1)
            for k, nodes in enumerate(frontier):
                y, raw = batch.column(2 + 2 * k).to_numpy(), batch.column(3 + 2 * k).to_numpy()
                place = np.full(len(growing[k].feature), -1)
                place[nodes] = np.arange(len(nodes))
                at = place[growing[k].leaf_of(codes)]
                use = np.flatnonzero((at >= 0) & ~np.isnan(y))
                rate = np.exp(raw[use] + sum((t.predict(codes[use]) for t in pending[k]), np.zeros(len(use))))
                index = (at[use][:, None] * size + cells[use]).ravel()
                for j, value in enumerate((weight[use] * (rate - y[use]) / UNIT, weight[use] * rate / UNIT, np.ones(len(use)))):
                    held[k][:, j] += np.bincount(index, np.repeat(np.rint(value), width), len(held[k]))
        for k, sums in enumerate(held):
            cell = np.flatnonzero(sums[:, 2])
            whole = sums[cell].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), k, np.int32)), pa.array(cell), *[pa.array(whole[:, j]) for j in range(3)]], names=["target", "cell", "g", "h", "n"])

    found = table.mapInArrow(run, "target int, cell long, g long, h long, n long").groupBy("target", "cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow()
    target, cell = (found.column(i).to_numpy() for i in (0, 1))
    values = np.stack([found.column(i).to_numpy().astype(np.float64) for i in (2, 3, 4)], axis=1) * [UNIT, UNIT, 1.0]
    out = {}
    for k, nodes in enumerate(frontier):
        sums = np.zeros((len(nodes) * size, 3))
        sums[cell[target == k]] = values[target == k]
        for place, node in enumerate(nodes):
            out[k, node] = sums[place * size : (place + 1) * size].reshape(width, bins + 1, 3)
    return out


def fit_boosted(
    df: DataFrame,
    features: Sequence[str],
    targets: Sequence[str],
    trees: int = 300,
    rate: float = 0.02,
    leaves: int = 15,
    depth: int = 6,
    least_rows: int = 40,
    l2: float = 1.0,
    bins: int = 64,
    weight: str | None = None,
) -> Boosted:
    """Poisson trees of each target (counts, null rows are passed over).

    Leaves are opened best gain first, down to ``depth``.  Features without any value in ``df`` are
    dropped.  ``weight`` names a column of row weights; a null weight counts as 0, and
    ``least_rows`` counts rows, not weights.  The bins and the scores are written to the shared
    folder; the scores anew every ``PENDING`` trees.
    """
    cuts = bin_edges(df, features, bins)
    if not cuts:
        raise ValueError("no feature has a value")
    names, edges = list(cuts), list(cuts.values())
    width = len(names)
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    means = df.agg(*[F.sum(F.when(F.col(t).isNotNull(), w * F.col(t))) / F.sum(F.when(F.col(t).isNotNull(), w)) for t in targets]).first()
    base = [float(np.log(max(m or 0.0, 1e-9))) for m in means]

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(width)]
            raw = binned(columns, edges)
            values = [pa.array([r.tobytes() for r in raw], pa.binary()), batch.column(width)]
            for k in range(len(targets)):
                values += [pa.array(batch.column(width + 1 + k).to_numpy(zero_copy_only=False).astype(np.float64)), pa.array(np.full(len(raw), base[k]))]
            yield pa.RecordBatch.from_arrays(values, names=[f.name for f in schema])

    schema = df.sparkSession.createDataFrame([], "bins binary, weight double, " + ", ".join(f"y{k} double, raw{k} double" for k in range(len(targets)))).schema
    chosen = df.select(*[F.col(n).cast("double").alias(f"_f{i}") for i, n in enumerate(names)], w.alias("_w"), *[F.col(t).cast("double").alias(f"_y{k}") for k, t in enumerate(targets)])
    table, path = written(chosen.mapInArrow(start, schema), "bins")
    done: list[list[Tree]] = [[] for _ in targets]
    pending: list[list[Tree]] = [[] for _ in targets]

    def leaf(sums: np.ndarray) -> float:
        return float(-rate * sums[0] / (sums[1] + l2)) if sums[1] + l2 > 0 else 0.0

    for _ in range(trees):
        growing = [Tree() for _ in targets]
        frontier = [[tree.add(0.0, 0.0)] for tree in growing]
        for _ in range(depth):
            if not any(frontier):
                break
            sums = _sums(table, width, bins, pending, growing, frontier)
            coming: list[list[int]] = [[] for _ in targets]
            for k, tree in enumerate(growing):
                for node in frontier[k]:
                    cells = sums[k, node]
                    total = cells[0].sum(axis=0)
                    if not node:
                        tree.value[0], tree.rows[0] = leaf(total), total[2]
                    found = _split(cells, l2, least_rows)
                    if found is None:
                        continue
                    tree.gain[node], tree.feature[node], tree.cut[node], tree.missing_left[node], left = found
                    tree.left[node], tree.right[node] = (tree.add(leaf(x), x[2]) for x in (left, total - left))
                    coming[k] += [c for c in (tree.left[node], tree.right[node]) if tree.rows[c] >= 2 * least_rows]
            frontier = coming
        for k, tree in enumerate(growing):
            pruned = _pruned(tree, leaves)
            done[k].append(pruned)
            pending[k].append(pruned)
        if len(pending[0]) >= PENDING:
            before = path
            table, path = written(_advance(table, width, pending), "bins")
            delete(df.sparkSession, before)
            pending = [[] for _ in targets]
    delete(df.sparkSession, path)
    return Boosted(names, edges, list(targets), base, done)
