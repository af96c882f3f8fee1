"""Boosted trees against a plain numpy tree, and their drivers against all coalitions."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from touchline.operators import boosting

FEATURES = ["a", "b", "c", "empty", "xy"]


def frame(n=400, seed=1):
    rng = np.random.default_rng(seed)
    a, b, c, d = rng.integers(0, 6, n).astype(float), rng.normal(size=n).round(2), rng.integers(0, 2, n).astype(float), rng.normal(size=n).round(1)
    b[rng.random(n) < 0.2] = np.nan
    y = rng.poisson(np.exp(0.2 * a - 0.5 * np.nan_to_num(b, nan=1.5)))
    z = rng.poisson(np.exp(0.1 * d))
    return pd.DataFrame({"id": np.arange(n), "a": a, "b": b, "c": c, "empty": np.nan, "xy": d, "home": y.astype(float), "away": z.astype(float), "w": rng.integers(0, 4, n).astype(float)})


def as_spark(spark, data):
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in data.itertuples(index=False, name=None)]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` {'long' if c == 'id' else 'double'}" for c in data.columns)).repartition(5)


def plain_boost(data, edges, features, target, trees, rate, leaves, least, l2, weight=None):
    """Best-first trees by trying every split of every leaf: predictions of all rows, and the leaves' sums."""
    keep = data[target].notna().to_numpy()
    w = data[weight].to_numpy() if weight else np.ones(len(data))
    y = data[target].fillna(0).to_numpy()
    raw = np.full(len(data), math.log((w * y)[keep].sum() / w[keep].sum()))
    values = data[features].to_numpy()
    counts = []
    for _ in range(trees):
        g, h = w * (np.exp(raw) - y), w * np.exp(raw)

        def best(rows, g=g, h=h):
            out = None
            score = lambda r: g[r].sum() ** 2 / (h[r].sum() + l2)
            for missing_left in (False, True):
                for f in range(len(features)):
                    x = values[rows, f]
                    for cut in edges[f]:
                        left = np.where(np.isnan(x), missing_left, x <= cut)
                        fit, rest = rows[left & keep[rows]], rows[~left & keep[rows]]
                        if len(fit) < least or len(rest) < least:
                            continue
                        gain = score(fit) + score(rest) - score(rows[keep[rows]])
                        if gain > 1e-6 and (out is None or gain > out[0] + 1e-9):
                            out = gain, rows[left], rows[~left]
            return out

        open_leaves = [(best(np.arange(len(data))), np.arange(len(data)))]
        while len(open_leaves) < leaves and any(s for s, _ in open_leaves):
            at = max(range(len(open_leaves)), key=lambda i: open_leaves[i][0][0] if open_leaves[i][0] else -1)
            (_, left, right), _ = open_leaves.pop(at)
            open_leaves += [(best(left), left), (best(right), right)]
        for _, rows in open_leaves:
            fit = rows[keep[rows]]
            raw[rows] += -rate * g[fit].sum() / (h[fit].sum() + l2)
        counts.append(sorted(len(rows[keep[rows]]) for _, rows in open_leaves))
    return np.exp(raw), counts


@pytest.mark.parametrize("weight", [None, "w"])
def test_like_a_plain_tree(spark, weight):
    data = frame()
    data.loc[:9, "home"] = np.nan
    model = boosting.fit_boosted(as_spark(spark, data), FEATURES, ["home", "away"], trees=10, rate=0.3, leaves=6, depth=6, least_rows=15, bins=8, weight=weight)
    assert model.features == ["a", "b", "c", "xy"]
    got = model.predict(as_spark(spark, data)).toPandas().sort_values("id")
    for k, target in enumerate(("home", "away")):
        want, counts = plain_boost(data, model.edges, model.features, target, 10, 0.3, 6, 15, 1.0, weight)
        assert np.allclose(got[f"mu_{target}"], want, rtol=1e-4)
        assert [sorted(t.rows[i] for i in range(len(t.left)) if t.left[i] < 0) for t in model.trees[k]] == counts
    assert list(got.columns[: len(data.columns)]) == list(data.columns)


def test_same_however_dealt(spark):
    data = as_spark(spark, frame())
    fits = [boosting.fit_boosted(data.repartition(n), FEATURES, ["home"], trees=3, leaves=4, least_rows=20, bins=10) for n in (1, 7)]
    assert fits[0].trees == fits[1].trees


def test_drivers_add_up_and_match_all_coalitions(spark):
    data = frame(200, 3)
    model = boosting.fit_boosted(as_spark(spark, data), FEATURES, ["home"], trees=9, rate=0.4, leaves=7, depth=4, least_rows=5, bins=6)
    few = data.head(12)
    got = model.drivers(as_spark(spark, few), ["id"]).toPandas()
    log_rate = np.log(model.predict(as_spark(spark, few)).toPandas().set_index("id")["mu_home"]).sort_index()
    sums = got.groupby("id")["contribution"].sum() + got.groupby("id")["expected"].first()
    assert np.allclose(sums, log_rate)

    bins = boosting.binned([few[f].to_numpy() for f in model.features], model.edges)

    def value(tree, node, row, known):
        if tree.left[node] < 0:
            return tree.value[node]
        f, sides = tree.feature[node], (tree.left[node], tree.right[node])
        if f in known:
            left = tree.missing_left[node] if row[f] == boosting.MISSING else row[f] <= tree.cut[node]
            return value(tree, sides[0] if left else sides[1], row, known)
        return sum(tree.rows[s] / tree.rows[node] * value(tree, s, row, known) for s in sides)

    n = len(model.features)
    for i, row in enumerate(bins):
        for f, name in enumerate(model.features):
            want = 0.0
            others = [g for g in range(n) if g != f]
            for size in range(n):
                for s in itertools.combinations(others, size):
                    weight = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
                    want += weight * sum(value(t, 0, row, {*s, f}) - value(t, 0, row, set(s)) for t in model.trees[0])
            assert np.isclose(got[(got["id"] == i) & (got["feature"] == name)]["contribution"].iloc[0], want)
    top = model.drivers(as_spark(spark, few), ["id"], top=2).toPandas()
    assert len(top) == 2 * len(few) and set(top["place"]) == {1, 2}
    merged = top.merge(got, on=["id", "target", "place"])
    assert (merged["feature_x"] == merged["feature_y"]).all()


def test_edges(spark):
    data = as_spark(spark, frame())
    with pytest.raises(ValueError, match="no feature"):
        boosting.fit_boosted(data, ["empty"], ["home"])
    with pytest.raises(ValueError, match="bins"):
        boosting.fit_boosted(data, ["a"], ["home"], bins=255)
    flat = boosting.fit_boosted(data, ["a"], ["home"], trees=1, least_rows=1000)
    assert flat.trees[0][0].left == [-1] and abs(flat.trees[0][0].value[0]) < 1e-6
    assert flat.predict(data.limit(0)).count() == 0
