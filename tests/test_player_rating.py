"""The configured rating against plain pandas, step by step, and its refusals."""

import numpy as np
import pandas as pd
import pytest

from touchline.operators import player_rating as pr

CONFIG = {
    "min_minutes": 450,
    "min_group_size": 8,
    "unrated_roles": {"XX": "Not rated"},
    "shrinkage_nineties": 8,
    "scale": [(0.0, 40.0), (0.1, 55.0), (0.5, 66.0), (0.9, 79.0), (1.0, 94.0)],
    "positions": {
        "CB": {"sub_ratings": {"defence": {"tackles": 2.0, "errors": -1.0}, "build": {"passes": 1.0, "carries": 1.0}, "extra": {"goals": 1.0}}, "sub_rating_weights": {"defence": 3.0, "build": 1.0, "extra": 0.0}},
        "FW": {"sub_ratings": {"attack": {"goals": 3.0, "shots": 1.0, "absent": 0.5}, "build": {"passes": 1.0}}, "sub_rating_weights": {"attack": 2.0, "build": 1.0}},
    },
    "discipline": {"metrics": {"cards": 1.0, "fouls": 1.0}, "weight": 0.03},
    "peak_weight": 0.15,
    "fifa_weight": 0.5,
    "unmeasured_shift": 1.0,
    "unmatched_shrinkage_nineties": 10,
}
METRICS = ["tackles", "errors", "passes", "carries", "goals", "shots", "cards", "fouls"]


def people(seed=7, n=260):
    rng = np.random.default_rng(seed)
    df = pd.DataFrame({"player": np.arange(n), "role": rng.choice(["CB", "FW", "XX", "ZZ", None], n, p=[0.45, 0.4, 0.05, 0.05, 0.05]), "Season": rng.choice(["2324", "2425", "2526"], n, p=[0.45, 0.45, 0.1])})
    df["minutes"] = rng.integers(200, 3000, n)
    df["nineties"] = df["minutes"] / 90
    for m in METRICS:
        df[m] = rng.integers(0, 9, n) / 2.0
        df.loc[rng.random(n) < 0.15, m] = np.nan
    df.loc[df["Season"] == "2425", "carries"] = np.nan  # a metric that one season lacks
    df.loc[(df["Season"] == "2324") & (df["role"] == "FW"), ["goals", "shots", "passes"]] = np.nan  # a pool without any
    df["fifa_overall"] = rng.integers(60, 90, n).astype(float)
    df.loc[rng.random(n) < 0.3, "fifa_overall"] = np.nan
    return df


def usable(frame, weights):
    keep = {c: w for c, w in weights.items() if c in frame and w and frame[c].notna().mean() >= 0.5}
    return keep, sum(map(abs, keep.values())) / sum(abs(w) for w in weights.values() if w)


def mean_of(frame, weights, most):
    keep, share = usable(frame, weights)
    if not keep or 1 - share > most:
        return pd.Series(np.nan, index=frame.index)
    present = sum(frame[c].notna() * abs(w) for c, w in keep.items())
    stacked = sum((frame[c] if w > 0 else 1 - frame[c]).fillna(0) * abs(w) for c, w in keep.items())
    return (stacked / present.replace(0, np.nan)).where(present / sum(map(abs, keep.values())) >= 1 - most)


def plain(df, config):
    df = df.copy()
    reason = pd.Series(None, index=df.index, dtype=object)
    reason[df["role"].isna()] = "No position recorded"
    for role, why in config["unrated_roles"].items():
        reason[df["role"] == role] = why
    reason[(df["minutes"] < config["min_minutes"]) & reason.isna()] = f"Under {config['min_minutes']} minutes played"
    sizes = df[reason.isna()].groupby(["role", "Season"]).size()
    small = [(r, s) in sizes.index and sizes[r, s] < config["min_group_size"] or ((r, s) not in sizes.index) for r, s in zip(df["role"], df["Season"], strict=True)]
    reason[pd.Series(small, index=df.index) & reason.isna()] = f"Fewer than {config['min_group_size']} comparable players this season"
    df["unrated_reason"] = reason
    work = df[reason.isna()].copy()
    scale = lambda v: pd.Series(np.where(v.isna(), np.nan, np.interp(v.fillna(0), *zip(*config["scale"], strict=True))), index=v.index)
    for (role, _), block in work.groupby(["role", "Season"]):
        spec = config["positions"].get(role)
        if not spec:
            continue
        pct = block[METRICS].rank(pct=True)
        subs = pd.DataFrame({s: mean_of(pct, m, 0.5) for s, m in spec["sub_ratings"].items()})
        composite = mean_of(subs, spec["sub_rating_weights"], 1.0)
        score = mean_of(1 - pct, config["discipline"]["metrics"], 0.5)
        w = config["discipline"]["weight"]
        composite = composite.where(score.isna(), composite * (1 - w) + score * w)
        peak = subs[[s for s, x in spec["sub_rating_weights"].items() if x]].max(axis=1)
        composite = composite.where(peak.isna(), 0.85 * composite + 0.15 * peak)
        for s in subs:
            work.loc[block.index, f"sub_{s}"] = subs[s]
        work.loc[block.index, "composite_raw"] = composite
        work.loc[block.index, "measured_share"] = usable(subs, spec["sub_rating_weights"])[1]
    lost = work["composite_raw"].isna() & work["fifa_overall"].isna()
    df.loc[work.index[lost], "unrated_reason"] = "No performance data this season"
    work = work[~lost]
    by = [work["role"], work["Season"]]

    def shrunk(v, k):
        n = work["nineties"]
        return n / (n + k) * v + (1 - n / (n + k)) * v.groupby(by).transform("mean")

    work["composite"] = shrunk(work["composite_raw"], config["shrinkage_nineties"])
    work["performance_rating"] = scale(work["composite"].groupby(by).rank(pct=True))
    ea = scale(work["fifa_overall"].groupby(by).rank(pct=True))
    weight = (0.5 + 0.5 * (1 - work["measured_share"].fillna(1).clip(0, 1))).clip(0.5, 1)
    alone = shrunk(work["performance_rating"], 10 / work["measured_share"].fillna(0).clip(lower=0.1))
    both = work["performance_rating"] * (1 - weight) + ea * weight
    work["rating"] = np.where(ea.notna(), np.where(work["performance_rating"].isna(), ea, both), alone)
    work["fifa_weight_used"] = weight.where(ea.notna())
    return df, work


def test_against_pandas(spark):
    df = people()
    frame = spark.createDataFrame([tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in df.itertuples(index=False, name=None)], "player long, role string, Season string, minutes long, nineties double, " + ", ".join(f"{m} double" for m in METRICS) + ", fifa_overall double")
    got = pr.rate_players(frame.repartition(5), CONFIG, ["player"]).toPandas().set_index("player").sort_index()
    whole, work = plain(df, CONFIG)
    assert len(got) == len(df)
    assert list(got["unrated_reason"].where(got["unrated_reason"].notna(), None)) == list(whole["unrated_reason"].where(whole["unrated_reason"].notna(), None))
    assert set(got.index[got["rated"]]) == set(work.index)
    for c in ("composite_raw", "composite", "performance_rating", "measured_share", "fifa_weight_used"):
        assert np.allclose(got.loc[work.index, c].astype(float), work[c].astype(float), equal_nan=True), c
    for s in ("defence", "build", "extra", "attack"):
        want = (work[f"sub_{s}"] * 99).astype(float)
        assert np.nanmax(np.abs(got.loc[work.index, f"sub_{s}"].astype(float) - want)) <= 0.5 + 1e-9
        assert (got.loc[work.index, f"sub_{s}"].isna() == want.isna()).all()
    assert np.allclose(got.loc[work.index, "rating"].astype(float), work["rating"].astype(float), atol=0.5 + 1e-6, equal_nan=True)
    # cases that the sample must hold
    assert work["composite_raw"].isna().any() and (whole["unrated_reason"] == "No performance data this season").any()
    assert (work["measured_share"] < 1).any() and work["fifa_overall"].isna().any()


def test_a_key_that_holds_the_season(spark):
    df = people(3)
    columns = "player long, role string, Season string, minutes long, nineties double, " + ", ".join(f"{m} double" for m in METRICS) + ", fifa_overall double"
    frame = spark.createDataFrame([tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in df.itertuples(index=False, name=None)], columns)
    a, b = (pr.rate_players(frame, CONFIG, k).select("player", "rating", "unrated_reason").orderBy("player").toPandas() for k in (["player"], ["player", "Season"]))
    assert a.equals(b)


def test_empty_and_plain(spark):
    empty = spark.createDataFrame([], "player long, role string, Season string, minutes long, nineties double, goals double, fifa_overall double")
    assert pr.rate_players(empty, CONFIG, ["player"]).count() == 0
    lone = spark.createDataFrame([(1, "FW", "2425", 900, 10.0, 1.0, None)], empty.schema)
    row = pr.rate_players(lone, CONFIG, ["player"]).first()
    assert (row.rated, row.unrated_reason) == (False, "Fewer than 8 comparable players this season")


@pytest.mark.parametrize("seed", [1, 2])
def test_percentiles(spark, seed):
    rng = np.random.default_rng(seed)
    df = pd.DataFrame({"g": rng.choice(["a", "b"], 200), "metric": "m", "value": rng.integers(0, 20, 200) / 4.0})
    got = pr.long_percentiles(spark.createDataFrame(df).repartition(3), ["g"]).toPandas()
    df["pct"] = df.groupby("g")["value"].rank(pct=True)
    key = ["g", "metric", "value"]
    a, b = (x.groupby(key)["pct"].agg(["min", "max", "count"]).round(12) for x in (got, df))
    assert a.equals(b)


def test_rows_are_not_looked_up_by_key(spark):
    df = people(5, 120).drop(columns=["role"]).assign(role="CB", Season="2324", player=lambda d: d["player"] // 2)
    frame = spark.createDataFrame([tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in df.itertuples(index=False, name=None)], "player long, Season string, minutes long, nineties double, " + ", ".join(f"{m} double" for m in METRICS) + ", fifa_overall double, role string")
    assert pr.rate_players(frame, CONFIG, ["player"]).count() == len(df)
