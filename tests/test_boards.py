"""Forecast frames against plain grids, market prices, search, likeness, quotas and yardsticks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import forecast_frame as ff
from touchline.operators import pair_distances, ranking, search, sensitivity


def test_frame_against_plain_grids(spark):
    rng = random.Random(4)
    rows = [(i, rng.uniform(0.1, 5), rng.uniform(0.1, 5), rng.uniform(-0.2, 0.2)) for i in range(60)] + [(100, None, 1.0, 0.0), (101, 0.0, 0.0, 0.0), (102, 2.0, 2.0, 0.0)]
    df = spark.createDataFrame(rows, "i int, mu_home double, mu_away double, rho double").repartition(3)
    for r in ff.prediction_frame(df, rho=F.col("rho")).collect():
        if r.mu_home is None:
            assert r.prob_draw is None and r.modal_score_home is None and r.predicted_outcome is None
            continue
        m, n = max(r.mu_home, 1e-6), max(r.mu_away, 1e-6)
        cells = {}
        for h in range(11):
            for a in range(11):
                t = {(0, 0): 1 - m * n * r.rho, (0, 1): 1 + m * r.rho, (1, 0): 1 + n * r.rho, (1, 1): 1 - r.rho}.get((h, a), 1.0)
                cells[h, a] = math.exp(-m - n) * m**h / math.factorial(h) * n**a / math.factorial(a) * max(t, 1e-10)
        total = sum(cells.values())
        share = lambda test: sum(p for c, p in cells.items() if test(*c)) / total  # noqa: E731, B023
        assert [r.prob_home_win, r.prob_draw, r.prob_away_win] == pytest.approx([share(lambda h, a: h > a), share(lambda h, a: h == a), share(lambda h, a: h < a)])
        assert [r.prob_over_2_5, r.prob_btts] == pytest.approx([share(lambda h, a: h + a > 2.5), share(lambda h, a: h and a)])
        top = sorted(cells.values(), reverse=True)[:3]
        assert [r.score_0_prob, r.score_1_prob, r.score_2_prob] == pytest.approx([p / total for p in top])
        for k in range(3):
            assert cells[r[f"score_{k}_home"], r[f"score_{k}_away"]] / total == pytest.approx(r[f"score_{k}_prob"])
        assert (r.modal_score_home, r.modal_score_away, r.prob_modal_score) == (r.score_0_home, r.score_0_away, r.score_0_prob)
        if r.i == 102:  # 1-1, 1-2, 2-1 and 2-2 are equally likely
            assert len({(r[f"score_{k}_home"], r[f"score_{k}_away"]) for k in range(3)} & {(1, 1), (1, 2), (2, 1), (2, 2)}) == 3
    assert ff.prediction_frame(df.limit(0)).count() == 0


def test_market_and_boards(spark):
    kind = "match_id int, prob_home_win double, prob_draw double, prob_away_win double, predicted_outcome string, FTR string, strength_home double, strength_away double"
    rows = [(1, 0.5, 0.3, 0.2, "H", "H", 1.0, 2.0), (2, 0.2, 0.3, 0.5, "A", "D", 1.0, 0.5), (3, 0.35, 0.33, 0.32, "H", None, 2.0, 1.0), (4, 0.6, 0.2, 0.2, "H", "A", None, 1.0)]
    df = spark.createDataFrame(rows, kind)
    odds = spark.createDataFrame([(1, 2.0, 4.0, 4.0), (2, 3.0, 3.0, 3.0), (3, 1.0, 3.0, 3.0), (9, 2.0, 2.0, 2.0)], "match_id int, AvgH double, AvgD double, AvgA double")
    known = ff.with_market(df, odds, ["match_id"])
    got = {r.match_id: (r.market_home, r.market_draw, r.market_away) for r in known.collect()}
    assert got[1] == pytest.approx((0.5, 0.25, 0.25)) and got[3] == got[4] == (None, None, None)
    scores = ff.market_scores(known, []).first()
    assert scores.n_priced == 2
    assert scores.market_rps == pytest.approx((((0.5 - 1) ** 2 + (0.75 - 1) ** 2) / 2 + ((1 / 3) ** 2 + (2 / 3 - 1) ** 2) / 2) / 2)
    boards = {(r.board, r.match_id): r.value for r in ff.discover(known).collect()}
    assert boards == pytest.approx({("disagreement", 2): 0.5 - 1 / 3, ("disagreement", 1): 0.0, ("confident", 4): 60.0, ("confident", 1): 50.0, ("confident", 2): 50.0, ("upset", 1): 1.0, ("upset", 2): 0.5})
    with pytest.raises(Exception, match="repeated key"):
        ff.with_market(df, odds.unionAll(odds), ["match_id"]).collect()


def test_retrodiction_gate(spark):
    df = spark.createDataFrame([(1, 0.04, 0.05), (2, 0.06, 0.05), (3, None, 1.0)], "i int, h double, a double")
    got = {r.i: r.prob_draw for r in ff.retrodicted(df, "h", "a").collect()}
    assert got[1] is None and got[3] is None and got[2] > 0.8


def test_search(spark):
    rows = [(1, "Ana 100%_", 5.0, "E0"), (2, "bANAna", None, "E0"), (3, "Bo", 7.0, "D1"), (4, "Ana", 7.0, None), (5, None, 9.0, "E0")]
    df = spark.createDataFrame(rows, "i int, name string, r double, league string")
    page, total = search.search(df, contains={"name": " ANA "}, sort="r", sortable=["r"], key=["i"])
    assert [r.i for r in page.collect()] == [4, 1, 2] and total == 3
    page, total = search.search(df, {"league": None}, least={"r": 6})
    assert [r.i for r in page.collect()] == [4] and total == 1
    assert [r.i for r in search.search(df, contains={"name": "%_"})[0].collect()] == [1]
    page, total = search.search(df, sort="r", descending=False, sortable=["r"], key=["i"], offset=1, limit=2)
    assert [r.i for r in page.collect()] == [3, 4] and total == 5
    with pytest.raises(ValueError):
        search.search(df, sort="name", sortable=["r"])


def test_likeness(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 3))
    vectors = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(99, None)], "i int, v array<double>").repartition(4)
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    usual = np.median(gaps[np.triu_indices(50, 1)])
    assert search.reference_distance(vectors, "i", "v") == pytest.approx(usual)
    assert search.reference_distance(vectors, "i", "v", 20) == search.reference_distance(vectors.repartition(2), "i", "v", 20) != pytest.approx(usual)
    for r in search.similar(vectors.filter("i < 3"), vectors, "i", "v", 4).collect():
        assert r.similarity == pytest.approx(100 * 0.5 ** (gaps[r.subject, r.neighbour] / usual), abs=0.051)
    flat = spark.createDataFrame([(1, [1.0]), (2, [1.0]), (3, [1.0])], "i int, v array<double>")
    assert {r.similarity for r in search.similar(flat, flat, "i", "v", 2).collect()} == {100.0}
    assert search.reference_distance(flat.limit(1), "i", "v") == 0.0


def test_usual_distance_is_that_of_all_pairs(spark, monkeypatch):
    """More rows than any sample once had, in blocks, with ties and odd rows; few enough pairs and too many to keep."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(ranking, "BROADCAST_BYTES", 500 * 3 * 8)
    for x in (rng.normal(size=(901, 3)) ** 3 * 1e200, np.repeat([[1.0, 2.0, 3.0], [4.0, 6.0, 3.0]], 350, axis=0)):
        rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(9990, None), (9991, [0.0]), (9992, [0.0, None, 1.0]), (9993, [math.nan, 0.0, 0.0])]
        vectors = spark.createDataFrame(rows, "i int, v array<double>").repartition(3)
        y = x / np.abs(x).max()
        usual = np.median(np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1))[np.triu_indices(len(x), 1)]) * np.abs(x).max()
        assert search.reference_distance(vectors, "i", "v") == pytest.approx(usual, rel=1e-12)
        with monkeypatch.context() as few:
            few.setattr(pair_distances, "KEPT", 10)
            assert search.reference_distance(vectors.repartition(5), "i", "v") == pytest.approx(usual, rel=1e-12)


def test_quota(spark):
    rows = [("c", i, line, r) for i, (line, r) in enumerate([("d", 90), ("d", 89), ("d", 88), ("a", 70), ("a", 60), ("m", 87), ("m", 50), ("g", 10)])] + [("thin", 20, "d", 5)]
    df = spark.createDataFrame(rows, "club string, i int, line string, r int")
    order = [F.desc("r"), F.asc("i")]
    pick = lambda quota, total: {r.i for r in sensitivity.quota_squad(df, ["club"], "line", quota, total, order).collect()}
    assert pick({"a": 2, "g": 3}, 5) == {3, 4, 7, 0, 1, 20}
    assert pick(None, 3) == {0, 1, 2, 20} == pick({"d": 1}, 3)
    assert pick({"a": 2, "m": 2, "g": 1}, 3) == {3, 4, 5, 6, 7, 20}  # a floor stands, even beyond the total


def test_yardsticks(spark):
    rows = [(s, c) for s, n in (("2223", 20), ("2324", 18), ("2425", 10), ("2526", 5)) for c in range(n)] + [(None, 1)]
    clubs = spark.createDataFrame(rows, "Season string, club int")
    assert {r.Season for r in sensitivity.publishable_seasons(clubs).collect()} == {"2223", "2324"}
    assert {r.Season for r in sensitivity.publishable_seasons(clubs.filter("Season = '2526'")).collect()} == {"2526"}
    assert sensitivity.publishable_seasons(clubs.limit(0)).count() == 0
    assert [r.Season for r in sensitivity.default_season(clubs.filter("Season is not null")).collect()] == ["2425"]
    assert sensitivity.default_season(clubs.limit(0)).count() == 0
