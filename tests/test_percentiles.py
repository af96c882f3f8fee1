"""Percentiles in slices are those of one window over the pool."""

import random
import statistics

from pyspark.sql import functions as F

from touchline.functions import scale
from touchline.operators import percentiles
from touchline.sources.sinks import written


def test_slices_give_the_percentiles_of_the_whole_pool(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, 0.0, 0.0, float(rng.randrange(5)), rng.random()]), rng.random()) for i in range(400)] + [(400, "only", None, None)]
    df, _ = written(spark.createDataFrame(rows, "i long, g string, x double, y double").repartition(4), "t")
    by_window = df.select("i", *[scale.percentile_within(c, ["g"], up).alias(n) for n, c, up in (("p", "x", True), ("q", "x", False), ("r", "y", True))])
    want = sorted(map(tuple, by_window.collect()))
    for size in (7, 100_000):
        monkeypatch.setattr(percentiles, "SLICE_ROWS", size)
        got = percentiles.with_percentiles(df, ["g"], {"p": ("x", True), "q": ("x", False)})
        got = got.join(percentiles.with_percentile(df, ["g"], "y", "r").select("i", "r"), "i")
        assert sorted(map(tuple, got.select("i", "p", "q", "r").collect())) == want


def test_totals_of_groups_go_back_to_their_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "i long, g string")
    assert sorted(map(tuple, percentiles.with_totals(df, ["g"], n=F.count(F.lit(1))).select("i", "n").collect())) == [(1, 2), (2, 2), (3, 1)]


def test_standardised_within_strata_without_bringing_them_together(spark):
    rng = random.Random(2)
    rows = [(i, "ab"[i % 2] if i % 7 else None, rng.choice([None, 40.0 + rng.random()]), i % 5) for i in range(300)] + [(300 + i, "few", float(i), i) for i in range(9)] + [(400 + i, "flat", 3.0, i) for i in range(12)]
    df, _ = written(spark.createDataFrame(rows, "i long, g string, x double, y int").repartition(4), "t")
    got = percentiles.with_standardised(df, ["g"], {"zx": "x", "zy": "y"})
    assert got.columns == ["i", "g", "x", "y", "zx", "zy"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
    want = {}
    for g in {r[1] for r in rows}:
        for c in (2, 3):
            pool = [r[c] for r in rows if r[1] == g and r[c] is not None]
            for r in rows:
                if r[1] == g:
                    sd = statistics.stdev(pool)
                    want[r[0], c] = (r[c] - statistics.mean(pool)) / sd if r[c] is not None and len(pool) >= 10 and sd else None
    for r in got.collect():
        for z, c in ((r.zx, 2), (r.zy, 3)):
            assert z is None if want[r.i, c] is None else abs(z - want[r.i, c]) < 1e-9
