"""The gate and its dead-letter table, resumable tables, late rows of a real stream, the outcome head."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import models
from touchline.sources import gate, resumable, sinks
from touchline.streaming import events, late

DAY = datetime.date(2024, 9, 1)
KEY = "League string, Season string, Date date, HomeTeam string, AwayTeam string"


def games(spark, *homes, league="E0"):
    return spark.createDataFrame([(league, "2425", DAY, h, "Away") for h in homes], KEY)


def history(spark, *teams):
    return spark.createDataFrame([("E0", "2425", DAY, t) for t in teams], "League string, Season string, Date date, Team string")


def shots(**lines):
    """A source that has (HS, AS) for the named teams, and the whole league whatever is asked."""

    def fetch(wanted):
        fetch.calls += 1
        spark = wanted.sparkSession
        return spark.createDataFrame([("E0", "2425", DAY, h, "Away", *v) for h, v in lines.items()], f"{KEY}, HS int, AS int")

    fetch.calls = 0
    return fetch


def run(spark, path, schedule, known, fetch, days):
    whole = gate.run_gate(schedule, known, fetch, ["HS", "AS"], path, DAY + datetime.timedelta(days=days))
    parked = {r.HomeTeam: (r.attempts, (r.last_attempt - DAY).days) for r in spark.read.parquet(path).collect()}
    return None if whole is None else sorted(r.HomeTeam for r in whole.collect()), parked


def test_parking_and_retry(spark, tmp_path):
    path, schedule = str(tmp_path / "parked"), games(spark, "A", "B", "C", "D")
    source = shots(A=(1, 2), B=(None, 3), C=(4, None), D=(5, 6))
    # D is known already and not passed on; rows that lack a column never pass
    assert run(spark, path, schedule, history(spark, "D"), source, 1) == (["A"], {"B": (1, 1), "C": (1, 1)})
    # within the week there is nothing worth fetching
    assert run(spark, path, schedule, history(spark, "A", "D"), source, 7) == (None, {"B": (1, 1), "C": (1, 1)})
    assert source.calls == 1
    # after it both are tried again; C has arrived from elsewhere by then
    assert run(spark, path, schedule, history(spark, "A", "C", "D"), source, 8) == ([], {"B": (2, 8)})
    assert run(spark, path, schedule, history(spark, "A", "B", "C", "D"), source, 20) == (None, {})


def test_a_source_that_did_not_work_parks_nothing(spark, tmp_path):
    path = str(tmp_path / "parked")
    assert run(spark, path, games(spark, "A", "B"), history(spark), shots(A=(None, None), B=(None, 1)), 1) == ([], {})
    assert run(spark, path, games(spark, "A", "B").limit(0), history(spark), shots(), 1) == (None, {})


def test_a_malformed_table_counts_as_absent(spark, tmp_path):
    path = str(tmp_path / "parked")
    games(spark, "A").write.parquet(path)
    assert gate.load_parked(spark, path).count() == 0 and gate.load_parked(spark, str(tmp_path / "none")).count() == 0
    rows = [("E0", "2425", DAY, "A", "Away", None, DAY), ("E0", "2425", None, "B", "Away", 1, DAY), ("E0", "2425", DAY, "C", None, 1, DAY)]
    spark.createDataFrame(rows, f"{KEY}, attempts int, last_attempt date").write.mode("overwrite").parquet(path)
    assert [r.HomeTeam for r in gate.load_parked(spark, path).collect()] == ["C"]
    # a null away team is a key like any other
    assert gate.eligible(spark.createDataFrame([("E0", "2425", DAY, "C", None)], KEY), gate.load_parked(spark, path), DAY).count() == 0


def test_resuming(spark, tmp_path):
    path, calls = str(tmp_path / "cache"), []
    rows = [(f"d{k}", k, i) for k in range(7) for i in range(3)] + [(None, 0, 0)]
    inputs = spark.createDataFrame(rows, "day string, k int, i int")

    def build(of):
        def made(parts):
            calls.append(parts)
            if "d3" in parts and "fail" in calls[0]:
                raise OSError("stopped")
            return of.filter(F.col("day").isin(parts)).groupBy(F.col("day").alias("part")).agg(F.sum("i").alias("total"), F.max("k").alias("k"))

        return made

    load = lambda of=None: {r.part: (r.total, r.k) for r in resumable.load(spark, path, "total long, k int", of, "day").collect()}
    assert load() == {}
    assert resumable.resume(inputs, path, "day", build(inputs), every=2, most=3) == 3 and calls == [["d0", "d1"], ["d2"]]
    calls[:] = ["fail"]
    with pytest.raises(OSError):
        resumable.resume(inputs, path, "day", build(inputs), every=1)
    assert set(load()) == {"d0", "d1", "d2"}
    # rows written before a stop, without their entry in the manifest, do not count and are replaced
    spark.createDataFrame([(99, 99, "d5")], "total long, k int, part string").write.mode("append").partitionBy("part").parquet(f"{path}/rows")
    calls[:] = [[]]
    assert resumable.resume(inputs, path, "day", build(inputs)) == 4 and load() == {f"d{k}": (3, k) for k in range(7)}
    assert resumable.resume(inputs.repartition(5), path, "day", build(inputs)) == 0
    changed = inputs.withColumn("i", F.col("i") + F.when(F.col("day") == "d4", 1).otherwise(0)).filter("day is null or day <> 'd6'")
    assert set(load(changed)) == {"d0", "d1", "d2", "d3", "d5"}
    assert resumable.resume(changed, path, "day", build(changed)) == 1 and load(changed)["d4"] == (6, 4) and "d6" not in load(changed)
    resumable.clear(spark, path)
    assert load() == {}


def test_late_rows_are_parked(spark, tmp_path):
    """Over three micro-batches the same rows that a windowed aggregation drops are kept in a table of their own."""
    at = lambda m: datetime.datetime(2024, 1, 1, 12) + datetime.timedelta(minutes=m)
    batches = [[(1, at(0)), (2, at(300))], [(3, at(10)), (4, at(250)), (5, at(400)), (6, None)], [(7, at(320)), (8, at(339)), (9, at(340)), (10, at(341))]]
    kind = "id long, ts timestamp"
    for batch in batches:
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        late.split_late(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        counted = events.tumbling(spark.readStream.schema(kind).parquet(str(tmp_path / "in")).withColumn("k", F.lit("k")), "1 minute", by="k", value="id")
        counted.writeStream.format("parquet").option("path", str(tmp_path / "windows")).option("checkpointLocation", str(tmp_path / "windows_state")).trigger(availableNow=True).start().awaitTermination()
    parts = {p: {(r.id, r.batch) for r in late.read_part(spark, str(tmp_path / "out"), p, kind).collect()} for p in ("late", "on_time")}
    assert parts["late"] == {(3, 1), (6, 1), (7, 2), (8, 2)}
    assert parts["on_time"] == {(1, 0), (2, 0), (4, 1), (5, 1), (9, 2), (10, 2)}
    # what the windows hold are rows on time only
    seen = sum(r.total for r in spark.read.schema("start timestamp, k string, n long, total long").parquet(str(tmp_path / "windows")).collect())
    assert seen <= sum(i for i, _ in parts["on_time"])


def test_a_batch_run_again_replaces_itself(spark, tmp_path):
    kind = "id long, ts timestamp"
    spark.createDataFrame([(1, datetime.datetime(2024, 1, 1))], kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    for state in ("a", "b"):  # a second checkpoint runs batch 0 again
        late.split_late(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / state)).awaitTermination()
    assert late.read_part(spark, str(tmp_path / "out"), "on_time", kind).count() == 1


def test_outcome_head(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(1500):
        x = float(rng.normal())
        w = np.exp([0.5 + 0.9 * x, 0.0, 0.1 - 0.8 * x])
        rows.append((i, f"s{i // 500}", DAY + datetime.timedelta(days=i), x, "HDA"[rng.choice(3, p=w / w.sum())]))
    df = spark.createDataFrame([*rows, (9999, "s2", DAY + datetime.timedelta(days=1200), None, "H")], "match_id long, Season string, Date date, x double, FTR string").repartition(3)
    got = models.walk_outcome_head(df, ["x"], least=400)
    assert {r.Season: r["count"] for r in got.groupBy("Season").count().collect()} == {"s1": 500, "s2": 501}
    x = np.array([r[3] for r in rows[:500]])
    y = np.array(["HDA".index(r[4]) for r in rows[:500]])
    beta = np.zeros((3, 2))
    design = np.stack([np.ones(500), x], axis=1)
    for _ in range(4000):  # plain gradient ascent on the same likelihood
        p = np.exp(design @ beta.T)
        p /= p.sum(axis=1, keepdims=True)
        beta += 0.5 * (np.eye(3)[y] - p).T @ design / 500
    for r in got.filter("Season = 's1'").limit(30).collect():
        p = np.exp(beta @ [1, r.x])
        assert [r.ph, r.pd, r.pa] == pytest.approx(list(p / p.sum()), abs=2e-3)
    assert got.filter("match_id = 9999").first().ph is None
    assert models.walk_outcome_head(df, ["x"], least=10_000).count() == 0
    # what comes later changes nothing before
    twisted = df.withColumn("FTR", F.when(F.col("Season") == "s2", "A").otherwise(F.col("FTR")))
    a, b = ({r.match_id: r.ph for r in models.walk_outcome_head(d, ["x"], least=400).filter("Season = 's1'").collect()} for d in (df, twisted))
    assert a == pytest.approx(b)


def test_scratch_tables_go(spark):
    table, path = sinks.written(spark.range(3), "test")
    assert table.count() == 3
    sinks.delete(spark, path)
    assert not sinks.exists(spark, path)
