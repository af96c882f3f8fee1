"""Properties of the operators on small hand-written tables."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from touchline.functions import names, scoreline
from touchline.operators import resampling, sequential, store


def test_elo_is_zero_sum_and_blind_to_its_own_match(spark):
    day = datetime.date(2024, 8, 1)
    rows = [(i, day + datetime.timedelta(days=i), "2425", h, a, x, y) for i, (h, a, x, y) in enumerate([("A", "B", 2, 0), ("B", "C", 1, 1), ("C", "A", None, None)])]
    df = spark.createDataFrame(rows, "match_id long, Date date, Season string, HomeTeam string, AwayTeam string, FTHG int, FTAG int")
    walked = {r.match_id: r for r in sequential.elo_walk(df).collect()}
    assert (walked[0].home_elo, walked[0].away_elo) == (1500.0, 1500.0)
    assert walked[1].home_elo < 1500 < walked[2].away_elo
    final = {r.Team: r.elo for r in sequential.final_ratings(df).collect()}
    assert sum(final.values()) == pytest.approx(4500)
    flipped = df.withColumn("FTHG", F.when(F.col("match_id") == 1, 9).otherwise(F.col("FTHG")))
    again = {r.match_id: r for r in sequential.elo_walk(flipped).collect()}
    assert again[1] == walked[1]


def test_scoreline_cells(spark):
    row = spark.range(1).select(scoreline.cells(F.lit(1.5), F.lit(1.2), -0.1).alias("g")).select(
        "g", scoreline.home_win(F.col("g")).alias("h"), scoreline.draw(F.col("g")).alias("d"), scoreline.away_win(F.col("g")).alias("a")
    ).first()
    want = [[math.exp(-2.7) * 1.5**h * 1.2**a / math.factorial(h) / math.factorial(a) for a in range(11)] for h in range(11)]
    want[0][0] *= 1 + 1.5 * 1.2 * 0.1
    want[0][1] *= 1 - 1.5 * 0.1
    want[1][0] *= 1 - 1.2 * 0.1
    want[1][1] *= 1.1
    total = sum(map(sum, want))
    assert row.g[0][0] == pytest.approx(want[0][0] / total) and row.g[3][2] == pytest.approx(want[3][2] / total)
    assert row.h + row.d + row.a == pytest.approx(1)


def test_settled_rows_never_change(spark):
    log = spark.createDataFrame([(1, None, None, None), (2, 9, 9, "D"), (3, None, None, None)], "id int, actual_home int, actual_away int, actual_result string")
    results = spark.createDataFrame([(1, 2, 1, "H"), (2, 0, 1, "A")], "id int, FTHG int, FTAG int, FTR string")
    got = {r.id: r.actual_result for r in store.settle(log, results, ["id"]).collect()}
    assert got == {1: "H", 2: "D", 3: None}


def test_names(spark):
    rows = spark.createDataFrame([("Ødegaard-Łukasz É",), (None,)], "n string").select(names.normalise_name(F.col("n")).alias("n")).collect()
    assert [r.n for r in rows] == ["odegaard lukasz e", None]


def test_shapley_adds_up():
    found = resampling.shapley(lambda c: len(c) ** 2 + ("a" in c), ["a", "b", "c"])
    assert sum(found.values()) == pytest.approx(10) and found["b"] == pytest.approx(found["c"])
