"""Exports of many schemas become one; statistics of two tables become one row a player."""

import pytest
from pyspark.sql import functions as F

from touchline.sources import exports as ex


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_columns_and_names(spark):
    assert ex.find_column(["OVERALL", "ovr"], "overall") == "ovr" and ex.find_column(["OVERALL"], "overall") == "OVERALL" and ex.find_column(["x"], "club") is None
    df = spark.createDataFrame([(" ", "Kylian", " Mbappé "), ("Vini Jr.", "Vinicius", None), (None, None, "")], "common_name string, first_name string, last_name string")
    assert [r[0] for r in df.select(ex.display_name(df)).collect()] == ["Kylian Mbappé", "Vini Jr.", None]
    only = df.select("first_name", "last_name")
    assert [r[0] for r in only.select(ex.display_name(only)).collect()] == ["Kylian Mbappé", "Vinicius", None]
    assert ex.display_name(df.select("first_name")) is None


def test_normalising(spark):
    kind = "Name string, OVR string, Club string, Position string, gender string, `GK Diving` string"
    data = [
        ("Ødegård  Ünal 大谷", "80", "FC", "CAM, CM", "Men", None),
        ("Odegard Unal", "85", "Other", "??|ST", "men's", "12"),
        ("Ada", "90", "FC", "GK", "Women's", None),
        ("Bo", "x", "FC", "GK", "men", None),
        ("Cy", "70", " ", None, None, "7"),
        ("Cy", "70", "A", "lwb", None, "7"),
    ]
    got = ex.normalise_export(spark.createDataFrame(data, kind))
    assert rows(got, "fifa_name", "fifa_overall", "fifa_club", "role", "norm", "fifa_gk_diving") == [("Cy", 70.0, None, None, "cy", 7.0), ("Odegard Unal", 85.0, "Other", "FWD", "odegard unal", 12.0)]
    assert ex.latin_only(F.lit("x")) is not None
    women = spark.createDataFrame([("Ada", "90", "Women")], "name string, overall string, gender string")
    assert ex.normalise_export(women).count() == 1  # none would be left
    assert ex.normalise_export(women.drop("overall")) is None and ex.normalise_export(women.drop("name")) is None
    assert ex.normalise_export(women.limit(0)).count() == 0
    alt = spark.createDataFrame([("Vitor Machado", "Vitinha", 1), ("Same", "Same", 2), ("None", None, 3)], "long_name string, short_name string, overall int")
    assert rows(ex.normalise_export(alt), "fifa_name", "fifa_alt_name") == [("None", None), ("Same", None), ("Vitor Machado", "Vitinha")]


def test_roles_and_groups(spark):
    df = spark.createDataFrame([("ST, LW", "F M S"), (" xx |  rcb", "D M"), ("", "S"), (None, None), ("SUB", "GK  D")], "p string, g string")
    got = [(r[0], r[1]) for r in df.select(ex.primary_role(F.col("p")), ex.position_group(F.col("g"))).collect()]
    assert got == [("FWD", "F"), ("CB", "D"), (None, None), (None, None), (None, "GK")]


def test_adapters(spark):
    long = spark.createDataFrame([("Legal Name", "Known", "81", "FC", "ST", "20", 23), (None, "x", "80", None, None, None, 23), ("No Rating", "x", "-", None, None, None, 9)], "long_name string, short_name string, overall string, club_name string, player_positions string, age string, version int")
    got = ex.adapted(long, "long", F.col("version")).collect()
    assert [(r.name, r.alt_name, r.overall, r.age, r.pace, r.Season) for r in got] == [("Legal Name", "Known", 81.0, 20.0, None, "2223")]
    site = spark.createDataFrame([("A", 70, "CB", "RB, LB", 9, 66), ("B", 71, "GK", None, None, 1)], "Name string, OVR int, Position string, `Alternative positions` string, `GK Diving` int, PAC int")
    assert [(r.name, r.positions, r.gk_diving, r.pace, r.Season) for r in ex.adapted(site, "site25", F.lit(25)).orderBy("name").collect()] == [("A", "CB, RB, LB", 9.0, 66.0, "2425"), ("B", "GK", None, 1.0, "2425")]
    new = spark.createDataFrame([(" ", "Ky", "Mb", 91, "men's"), ("Vini", "V", "J", 90, None), ("W", "W", "W", 99, "women's")], "common_name string, first_name string, last_name string, overall_rating int, gender string")
    assert [(r.name, r.alt_name, r.Season) for r in ex.adapted(new, "site27", F.lit(27)).orderBy("name").collect()] == [("Ky Mb", None, "2627"), ("Vini", "Vini", "2627")]
    for schema in ex.SCHEMAS:
        empty = spark.createDataFrame([], "nothing string")
        assert ex.adapted(empty, schema, F.lit(24)).columns == [*ex.CANON, "Season"] and ex.adapted(empty, schema, F.lit(24)).count() == 0


def test_editions_of_a_folder(spark, tmp_path):
    (tmp_path / "fifa_2324.csv").write_text("Name,Overall,Position\nAnders Ø,80,ST\nAnders O,79,CB\n")
    (tmp_path / "fifa_2425.csv").write_text('long_name,overall,player_positions,short_name\n"Anders Øst",82,"ST, LW",Andy\n')
    (tmp_path / "fifa_2526.csv").write_text("something,else\n1,2\n")
    (tmp_path / "other.csv").write_text("Name,Overall\nX,1\n")
    got = ex.load_editions(spark, str(tmp_path))
    assert rows(got, "Season", "fifa_name", "fifa_overall", "role", "fifa_alt_name") == [("2324", "Anders Ø", 80.0, "FWD", None), ("2425", "Anders Øst", 82.0, "FWD", "Andy")]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "fifa_2526.csv").write_text("something,else\n1,2\n")
    assert ex.load_editions(spark, str(tmp_path / "sub")) is None


def test_flat_names():
    assert ex.flat_names([("Performance", "Save%"), ("Penalty Kicks", "Save%"), ("Penalty Kicks", "Save%"), ("player", ""), "player", ("", "90s")]) == ["Save%", "Penalty Kicks_Save%", "Penalty Kicks_Save%_2", "player", "player_2", "90s"]
    assert ex.flat_names([]) == []


def test_player_stats(spark):
    misc = spark.createDataFrame([("a", "9", "3", "50"), ("b", "0", "3", "x"), ("c", None, "1", None)], "Player string, `90s` string, Fls string, `Won%` string")
    keeper = spark.createDataFrame([("a", 9.0, 18, 0.5), ("k", 2.0, 1, 0.7)], "Player string, `90s` double, Fls int, `Save%` double")
    got = ex.player_stats(misc, keeper, ["Player"], {"Fls": "fouls", "Won%": "aerial_pct", "None": "none"}, {"Fls": "fouls", "Save%": "save_pct"})
    want = [("a", pytest.approx(1 / 3), 3.0, 50.0, 2.0, 18.0, 0.5), ("b", None, 3.0, None, None, None, None), ("c", None, 1.0, None, None, None, None), ("k", None, None, None, 0.5, 1.0, 0.7)]
    assert rows(got, "Player", "fouls_per90", "fouls", "aerial_pct", "fouls_per90_gk", "fouls_gk", "save_pct") == want


def test_challenge_rates(spark):
    df = spark.createDataFrame([(3.0, 1.0, 1.0), (0.0, 2.0, 0.0), (None, 1.0, 1.0)], "tackles_won_per90 double, interceptions_per90 double, fouls_per90 double")
    got = [(r.clean_challenge_rate, r.ball_won_per_foul) for r in ex.challenge_rates(df).collect()]
    assert got == [(0.75, 4.0), (None, None), (None, None)]
    assert ex.challenge_rates(df.select("fouls_per90")).columns == ["fouls_per90"]
