"""File sources, sinks and streams on small hand-written inputs."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import aggregates, joins, models, ranking, resampling, sequential, store
from touchline.plans import forecast_queries
from touchline.sources import files, sinks
from touchline.streaming import elo, predictions

DAY = datetime.date(2024, 8, 1)


def written(folder, name, data: bytes):
    (folder / name).write_bytes(data)


@pytest.fixture()
def feed(tmp_path):
    written(tmp_path, "E0_2425.csv", "﻿Div,Date,HomeTeam,AwayTeam,FTHG,FTAG,HS\r\nE0,01/08/2024,Málaga,Köln,2,1,9\r\n,,,,,,\r\nE0,02/08/24,A,B,,,\r\n".encode())
    written(tmp_path, "D1_2324.csv", "HomeTeam,Div,AwayTeam,Date,FTAG,FTHG,AvgH,AvgD,AvgA\nKöln,D1,Málaga,13/05/2024,3,x,2.1,3.3,3.0\nKöln,D1,A,14/05/2024,0,0,2.1,,3.0\n".encode("latin-1"))
    written(tmp_path, "page_2425.csv", b"<html>not found</html>")
    return str(tmp_path) + "/*.csv"


def test_csv_of_mixed_encodings(spark, feed):
    raw = files.csv_table(spark, feed)
    assert raw.count() == 4
    got = {(r.HomeTeam, r.AwayTeam): r for r in files.to_matches(raw, keep_unplayed=True).collect()}
    first = got["Málaga", "Köln"]
    assert (first.League, first.Season, first.Date, first.FTHG, first.HS, first.HC, first.FTR) == ("E0", "2425", DAY, 2.0, 9.0, None, "H")
    assert (got["Köln", "Málaga"].FTHG, got["Köln", "Málaga"].FTAG, got["Köln", "Málaga"].FTR) == (None, 3.0, None)
    assert got["A", "B"].Date == datetime.date(2024, 8, 2)
    assert {(r.HomeTeam, r.AwayTeam) for r in files.to_matches(raw).collect()} == {("Málaga", "Köln"), ("Köln", "A")}
    assert [(r.HomeTeam, r.AwayTeam) for r in files.fixtures(raw, ["E0"], "2024-08-01").collect()] == [("A", "B")]
    assert [(r.AwayTeam, r.AvgH) for r in files.raw_odds(raw).collect()] == [("Málaga", 2.1)]
    assert files.raw_odds(raw.drop("AvgD")).count() == 0


def test_no_usable_file(spark, tmp_path):
    written(tmp_path, "a.csv", b"x,y\n1,2\n")
    assert files.csv_table(spark, str(tmp_path)).count() == 0
    assert files.table_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0


def test_scores(spark):
    df = spark.createDataFrame([("2–1",), ("0 - 0",), ("(4) 1—1 (3)",), ("abd",), (None,)], "score string")
    got = [(r.FTHG, r.FTAG, r.played) for r in files.with_played(df).collect()]
    assert got == [(2, 1, True), (0, 0, True), (1, 1, True), (None, None, False), (None, None, False)]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "table")
    df = spark.createDataFrame([("2324", "a", 1), ("2425", "b", 2)], "Season string, Team string, n int")
    assert sinks.write_if_changed(df, path) and not sinks.write_if_changed(df.orderBy(F.desc("n")), path)
    assert sinks.write_if_changed(df.withColumn("n", F.col("n") + 1), path)
    assert {r.n for r in spark.read.parquet(path).collect()} == {2, 3}
    with pytest.raises(ValueError, match="lacks other"):
        sinks.checked_read(spark, path, ["n", "other"])
    seasons = str(tmp_path / "seasons")
    sinks.merge_seasons(df, seasons, ["Team", "n"])
    sinks.merge_seasons(df.filter("n = 2").withColumn("n", F.lit(9)), seasons, ["Team", "n"])
    sinks.merge_seasons(df.limit(0), seasons, ["Team", "n"])
    assert {(r.Team, r.n) for r in spark.read.parquet(seasons).collect()} == {("a", 1), ("b", 9)}
    sinks.save_stamped(spark, {"E0": 0.5}, "v1", str(tmp_path / "offsets"))
    assert sinks.load_stamped(spark, str(tmp_path / "offsets"), "v1") == {"E0": 0.5}
    with pytest.raises(ValueError, match="not made for v2"):
        sinks.load_stamped(spark, str(tmp_path / "offsets"), "v2")


def test_predictions_are_appended_once(spark, tmp_path):
    path = str(tmp_path / "log")
    kind = "model_version string, League string, competition string, Date date, HomeTeam string, AwayTeam string, p double"
    made = spark.createDataFrame([("v1", "E0", None, DAY, "A", "B", 0.5), ("v1", "E0", "domestic", DAY, "A", "B", 0.6), ("v1", "E0", "cup", DAY, "A", "B", 0.7)], kind)
    sinks.append_predictions(made, path)
    sinks.append_predictions(made.withColumn("p", F.lit(0.9)), path)
    log = spark.read.parquet(path).collect()
    assert len(log) == 2 and 0.9 not in {r.p for r in log}


def games(n=60, seed=1):
    rng, teams = random.Random(seed), "ABCDEF"
    out = []
    for i in range(n):
        home, away = rng.sample(teams, 2)
        goals = (rng.randrange(5), rng.randrange(4)) if i % 9 else (None, None)
        out.append((i, DAY + datetime.timedelta(days=i // 2 * 9), f"{24 + i // 40}{25 + i // 40}", home, away, *goals, i % 7 == 0))
    return out


KIND = "match_id long, Date date, Season string, HomeTeam string, AwayTeam string, FTHG int, FTAG int, Neutral boolean"


def test_elo_streamed_in_micro_batches_equals_the_batch_walk(spark, tmp_path):
    rows = games()
    whole = {r.match_id: (r.home_elo, r.away_elo) for r in sequential.elo_walk(spark.createDataFrame(rows, KIND)).collect()}
    for start in range(0, len(rows), 20):
        spark.createDataFrame(rows[start : start + 20], KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = elo.streamed_elo(spark.readStream.schema(KIND).parquet(str(tmp_path / "in")))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {r.match_id: (r.home_elo, r.away_elo) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got.keys() == whole.keys() and all(got[i] == pytest.approx(whole[i]) for i in whole)


def test_one_walk_gives_all_ratings(spark):
    """Final ratings honour neutral grounds, and groups that share no team can be walked apart."""
    rows = games()
    other = [(i + 1000, d, s, f"x{h}", f"x{a}", *rest) for i, d, s, h, a, *rest in games(seed=2)]
    both = spark.createDataFrame(rows + other, KIND).withColumn("part", F.when(F.col("match_id") < 1000, "one").otherwise("two"))
    state = sequential.EloState()
    for i, d, s, h, a, x, y, n in sorted(rows + other, key=lambda r: (r[1], r[5] is not None, r[0])):
        state.match(h, a, s, x, y, n)
    for group in (None, "part"):
        final = {r.Team: r.elo for r in sequential.final_ratings(both, group).collect()}
        assert final == pytest.approx(state.rating)


def test_asof_top_n(spark):
    rng = random.Random(3)
    left = [(i, rng.choice("ab"), rng.randrange(12)) for i in range(30)] + [(99, "c", 5)]
    right = [(i, rng.choice("abd"), rng.randrange(12)) for i in range(40)]
    want = {(i, j, k + 1) for i, b, t in left for k, (_, j) in enumerate(sorted(((u, j) for j, c, u in right if c == b and u < t), reverse=True)[:3])}
    found = joins.asof_top_n(spark.createDataFrame(left, "i int, b string, t int"), spark.createDataFrame(right, "j int, b string, u int"), ["b"], "t", "u", ["j"], 3)
    assert {(r.i, r.j, r._n) for r in found.collect()} == want


def test_backtest_does_not_see_the_future(spark):
    """What comes after a season changes none of its forecasts, also where labels wrap from 99 to 00."""
    rng = random.Random(7)
    rows = []
    for i in range(400):
        home, away = rng.sample("ABCDEFGH", 2)
        date = datetime.date(1997, 8, 1) + datetime.timedelta(days=i * 3)
        year = date.year - (date.month < 7)
        goals = rng.randrange(4), rng.randrange(3)
        rows.append((i, "L", f"{year % 100:02d}{(year + 1) % 100:02d}", date, home, away, *goals, "H" if goals[0] > goals[1] else "A" if goals[0] < goals[1] else "D", *[rng.randrange(9) for _ in range(4)], rng.random(), rng.random()))
    kind = "match_id long, League string, Season string, Date date, HomeTeam string, AwayTeam string, FTHG int, FTAG int, FTR string, HS int, AS int, HST int, AST int, HxG double, AxG double"
    whole = spark.createDataFrame(rows, kind)
    assert {r[0] for r in whole.select("Season").distinct().collect()} == {"9798", "9899", "9900", "0001"}
    columns = ["Points_5_diff", "home_GoalsFor_5"]
    full = forecast_queries.walk_forward(forecast_queries.features(whole), columns)
    assert {r[0] for r in full.select("Season").distinct().collect()} == {"9899", "9900", "0001"}
    cut = forecast_queries.walk_forward(forecast_queries.features(whole.filter("Season <> '0001'")), columns)
    a, b = ({r.match_id: (r.ph, r.pd) for r in x.filter("Season <> '0001'").collect()} for x in (full, cut))
    assert a.keys() == b.keys() and all(a[i] == pytest.approx(b[i]) for i in a)


def test_shapley_column_adds_up(spark):
    members = ["a", "b", "c"]
    worth = lambda c: F.lit(float(len(c) ** 2 + 3 * ("b" in c)))
    row = spark.range(1).select(*[resampling.shapley_column(m, members, worth).alias(m) for m in members]).first()
    assert sum(row) == pytest.approx(12) and row.b - row.a == pytest.approx(3)


def test_cluster_bootstrap(spark):
    df = spark.createDataFrame([(i // 5, float(i % 3), 1.0) for i in range(500)], "c int, x double, one double")
    draws = [r.value for r in resampling.cluster_bootstrap(df, "c", "x", "one", 400).collect()]
    assert len(draws) == 400 and sum(draws) / 400 == pytest.approx(1.0, abs=0.02)


def test_recompute_on_change(spark):
    stamps, runs = [], []
    source = spark.createDataFrame([(DAY,)], "Date date")
    for _ in range(2):
        predictions.recompute_on_change(source, lambda df: runs.append(df.count()), lambda: stamps[-1] if stamps else None, stamps.append)
    predictions.recompute_on_change(source.union(source), lambda df: runs.append(df.count()), lambda: stamps[-1], stamps.append)
    assert runs == [1, 2]


def test_nulls_that_change_column_are_seen(spark, tmp_path):
    path = str(tmp_path / "table")
    one = spark.createDataFrame([(1, None)], "a int, b int")
    other = spark.createDataFrame([(None, 1)], "a int, b int")
    assert sinks.write_if_changed(one, path) and sinks.write_if_changed(other, path) and not sinks.write_if_changed(other, path)
    nested = [spark.createDataFrame([(v, {"k": None})], "a array<int>, m map<string,int>") for v in ([1, None], [None, 1])]
    assert aggregates.fingerprint(nested[0], ["a", "m"]).first() != aggregates.fingerprint(nested[1], ["a", "m"]).first()
    empty = spark.createDataFrame([], "a int")
    assert aggregates.fingerprint(empty, ["a"]).first()["rows"] == 0


def test_a_stop_between_the_moves_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    key = ["k"]
    spark.createDataFrame([(1, "first")], "k int, v string").withColumn("competition", F.lit("domestic")).write.parquet(path + ".old")
    sinks.append_predictions(spark.createDataFrame([(2, "second"), (1, "late")], "k int, v string"), path, key)
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "first"), (2, "second")]
    # a replacement that was finished but for the old table's removal
    spark.createDataFrame([(9, "stale", "domestic")], "k int, v string, competition string").write.parquet(path + ".old")
    sinks.replace_table(spark.read.parquet(path).filter("k = 2"), path)
    assert [r.k for r in sinks.checked_read(spark, path, key).collect()] == [2]
    assert not sinks.exists(spark, path + ".old") and sinks.checked_read(spark, str(tmp_path / "none"), key) is None


def test_null_keys_and_repeats_in_the_log(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(None, "b"), (None, "a"), (1, None), (1, "c")], "k int, v string")
    for _ in range(2):
        sinks.append_predictions(rows, path, ["k"])
    assert sorted(((r.k or 0, r.v) for r in spark.read.parquet(path).collect())) == [(0, "a"), (1, "c")]
    log = spark.createDataFrame([(1, None, None, None)], "k int, actual_home int, actual_away int, actual_result string")
    results = spark.createDataFrame([(1, 2, 0, "H"), (1, 0, 2, "A")], "k int, FTHG int, FTAG int, FTR string")
    with pytest.raises(Exception, match="repeated key"):
        store.settle(log, results, ["k"]).collect()
    assert store.settle(log, results.limit(1), ["k"]).count() == 1


def test_long_and_quoted_headers(spark, tmp_path):
    many = ",".join(f"column{i}" for i in range(4000))
    written(tmp_path, "a.csv", f"{many},Div,\"Odds, best\",Div,\n{','.join(['x'] * 4000)},E0,\"1,5\",again,z\n\n".encode())
    written(tmp_path, "b.csv", "﻿Div,HomeTeam\nE0,Málaga\n".encode())
    written(tmp_path, "c.csv", "Div,HomeTeam\nE1,Málaga\nE1\n,none\n".encode("latin-1"))
    got = files.csv_table(spark, str(tmp_path))
    rows = {(r._file, r.Div, r.HomeTeam, r["Odds, best"], r.column3999) for r in got.collect()}
    assert rows == {("a.csv", "E0", None, "1,5", "x"), ("b.csv", "E0", "Málaga", None, None), ("c.csv", "E1", "Málaga", None, None), ("c.csv", "E1", None, None, None)}
    assert "" not in got.columns and len(got.columns) == 4000 + 5


def test_walk_of_a_stream_in_tables(spark, tmp_path):
    rows = games()
    whole = {r.match_id: (r.home_elo, r.away_elo) for r in sequential.elo_walk(spark.createDataFrame(rows, KIND)).collect()}
    for start in range(0, len(rows), 20):
        spark.createDataFrame(rows[start : start + 20], KIND).repartition(3).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        elo.walk_stream(spark.readStream.schema(KIND).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r.match_id: (r.home_elo, r.away_elo) for r in spark.read.parquet(str(tmp_path / "out" / "matches")).collect()}
    assert got.keys() == whole.keys() and all(got[i] == pytest.approx(whole[i]) for i in whole)
    last = {r.Team: r.rating for r in spark.read.parquet(str(tmp_path / "out" / "ratings")).filter("batch = 2").collect()}
    want = {r.Team: r.elo for r in sequential.final_ratings(spark.createDataFrame(rows, KIND)).collect()}
    assert last == pytest.approx(want)


def test_walk_in_stages_is_the_whole_walk(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    rows = [(i, datetime.date(2001, 1, 1) + datetime.timedelta(days=rng.randrange(12) * 40), f"0{1 + i // 60}", f"t{rng.randrange(4)}", f"u{rng.randrange(4)}", rng.choice([None, 0, 1, 2]), rng.randrange(3)) for i in range(120)]
    df = spark.createDataFrame(rows, "match_id long, Date date, Season string, HomeTeam string, AwayTeam string, FTHG int, FTAG int").repartition(5)
    split = df.withColumn("g", F.lit("a")).unionByName(df.withColumns({c: F.concat(F.lit("b"), c) for c in ("HomeTeam", "AwayTeam")} | {"g": F.lit("b"), "match_id": F.col("match_id") + 1000}))
    state, want = sequential.EloState(), {}
    for r in sorted(rows, key=lambda r: (r[1], r[5] is not None, r[0])):
        want[r[0]] = state.match(r[3], r[4], r[2], r[5], r[6])
    monkeypatch.setattr(sequential, "STAGE_ROWS", 25)
    got = {r.match_id: (r.home_elo, r.away_elo) for r in sequential.elo_walk(df).collect()}
    assert got == want
    assert {r.Team: r.elo for r in sequential.final_ratings(df).collect()} == state.rating
    apart = {r.match_id: (r.home_elo, r.away_elo) for r in sequential.elo_walk(split, "g").collect()}
    assert apart == want | {i + 1000: x for i, x in want.items()}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    elo.walk_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert {r.match_id: (r.home_elo, r.away_elo) for r in spark.read.parquet(str(tmp_path / "out" / "matches")).collect()} == want


def test_vectors_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    vectors = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(60)], "i int, v array<double>").repartition(3)
    subjects = vectors.filter("i % 3 = 0")
    whole = sorted(map(tuple, ranking.nearest_vectors(subjects, vectors, "i", "v", 5).collect()))
    monkeypatch.setattr(ranking, "BROADCAST_BYTES", 100)
    assert sorted(map(tuple, ranking.nearest_vectors(subjects, vectors, "i", "v", 5).collect())) == whole and len(whole) == 100


def test_nearest_vectors_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(0, 3, size=(90, 4)), np.repeat(rng.integers(0, 3, size=(1, 4)), 40, axis=0), 1000 + rng.random((20, 4)) / 1e7]).astype(np.float32)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(150, None), (151, [1.0, None, 2.0, 0.0]), (152, [1.0]), (153, [float("nan")] * 4)]
    vectors = spark.createDataFrame(rows, "i long, v array<float>").repartition(3)
    subjects = vectors.filter("i % 5 = 0")
    for digits in (None, 6):
        want = []
        for i in range(0, 154, 5):
            gaps = [(d if digits is None else round(d, digits), j) for j, d in enumerate(np.sqrt(((x[i] - x).astype(float) ** 2).sum(axis=1))) if j != i] if i < 150 else []
            want += [(i, j, pytest.approx(d), k + 1) for k, (d, j) in enumerate(sorted(gaps)[:6])]
        want += [(150, j, None, j + 1) for j in range(6)]
        monkeypatch.setattr(ranking, "TILE", 16 if digits else 1024)
        got = sorted(map(tuple, ranking.nearest_vectors(subjects, vectors, "i", "v", 6, digits).select("subject", "neighbour", "distance", "place").collect()), key=lambda r: (r[0], r[3]))
        assert got == sorted(want, key=lambda r: (r[0], r[3]))
    # too few vectors with a distance: those without one follow
    few = ranking.nearest_vectors(subjects.filter("i = 0"), vectors.filter("i in (0, 7, 150, 152)"), "i", "v", 3).orderBy("place").collect()
    assert [(r.neighbour, r.distance is None) for r in few] == [(7, False), (150, True), (152, True)]


def test_stratum_fits(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(x), float(z), float(2 + 3 * x - z + rng.normal())) for x, z in rng.normal(size=(80, 2))] + [("b", 1.0, 2.0, 5.0), ("b", 2.0, 1.0, 5.0), ("b", None, 1.0, 9.0)]
    got = {r.k: r for r in models.stratum_fits(spark.createDataFrame(rows, "k string, x double, z double, y double").repartition(3), "y", ["x", "z"], ["k"]).collect()}
    data = np.array([r[1:] for r in rows[:80]])
    design = np.column_stack([np.ones(80), data[:, :2]])
    beta = np.linalg.lstsq(design, data[:, 2], rcond=None)[0]
    assert [got["a"].intercept, got["a"].slope_x, got["a"].slope_z] == pytest.approx(list(beta))
    assert got["a"].r_squared == pytest.approx(1 - (data[:, 2] - design @ beta).var() / data[:, 2].var()) and got["b"].n == 2 and got["b"].r_squared is None
