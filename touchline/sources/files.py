"""CSV sources: files of mixed encodings and headers become one table of matches or odds."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns of a match file, and the names they get.
MATCH_COLUMNS = {"Div": "League", "HomeTeam": "HomeTeam", "AwayTeam": "AwayTeam"}
STATISTICS = ("FTHG", "FTAG", "HS", "AS", "HST", "AST", "HF", "AF", "HC", "AC", "HY", "AY", "HR", "AR")
ODDS = ("AvgH", "AvgD", "AvgA")
#: The dashes that may stand between the goals of a score.
DASHES = "-‐‑‒–—―"


def _lines(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """_file, _path, start and line: the lines of text files, each as UTF-8 if it is valid and else as Latin-1.

    Files are read in splits; the byte order mark goes, and lines without anything are left out.
    """
    value = F.col("value")
    text = F.when(F.is_valid_utf8(value), value).otherwise(F.decode(value.cast("binary"), "ISO-8859-1"))
    rows = spark.read.text(paths if isinstance(paths, str) else list(paths)).select(text.alias("line"), "_metadata.file_name", "_metadata.file_path", "_metadata.file_block_start")
    rows = rows.select(F.col("file_name").alias("_file"), F.col("file_path").alias("_path"), F.col("file_block_start").alias("start"), F.regexp_replace("line", "^\uFEFF", "").alias("line"))
    return rows.filter(F.trim("line") != "")


def header_names(line: str) -> list[str]:
    """The column names of a header line, quoted commas included; of equal names only the first is kept, as null the rest."""
    names, seen = [c.strip() for c in next(csv.reader([line]), [])], set()
    return [None if not c or c in seen or seen.add(c) else c for c in names]


def csv_frames(spark: SparkSession, paths: Sequence[str] | str, required: Sequence[str]) -> list[DataFrame]:
    """One frame a header line, of all files with that header and one of the ``required`` columns at least.

    All columns are strings, with ``_file`` and ``_path``; columns without a name are left out.  Lines are
    read as UTF-8 where they are valid, else as Latin-1; a byte order mark is skipped.  Only the first
    line of a file reaches the driver.  A quoted field ends with its line.
    """
    lines = _lines(spark, paths)
    heads = lines.filter("start = 0").withColumn("at", F.monotonically_increasing_id()).groupBy("_path").agg(F.min_by("line", "at").alias("head")).collect()
    groups: dict[str, list[str]] = {}
    for r in heads:
        if set(required) & set(header_names(r["head"])):
            groups.setdefault(r["head"], []).append(r["_path"])
    parts = []
    for head, files in sorted(groups.items()):
        names = header_names(head)
        schema = ", ".join(f"c{i} string" for i in range(len(names)))
        parsed = F.from_csv("line", schema, {"mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
        rows = lines.filter(F.col("_path").isin(sorted(files)) & (F.col("line") != head)).select("_file", "_path", parsed.alias("r"))
        parts.append(rows.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names) if n], "_file", "_path"))
    return parts


def csv_table(spark: SparkSession, paths: Sequence[str] | str, required: str = "Div") -> DataFrame:
    """The frames of all headers as one table: columns go by name and may be in any order or absent, where they are null.

    Rows without ``required`` are dropped, and files without that column left out.
    """
    parts = [df.filter(F.col(f"`{required}`").isNotNull() & (F.trim(f"`{required}`") != "")) for df in csv_frames(spark, paths, [required])]
    if not parts:
        return spark.createDataFrame([], f"{required} string, _file string, _path string")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def day_first(text: Column) -> Column:
    """A date written day first, with a year of two or four digits, or in ISO order; null if it is none."""
    text = F.trim(text)
    return F.coalesce(F.try_to_date(text, "dd/MM/yyyy"), F.try_to_date(text, "dd/MM/yy"), F.try_to_date(text, "yyyy-MM-dd"))


def season_of_file(name: Column) -> Column:
    """The four digits of a season in a file's name."""
    return F.nullif(F.regexp_extract(name, r"(\d{4})", 1), F.lit(""))


def to_matches(raw: DataFrame, keep_unplayed: bool = False) -> DataFrame:
    """League, Season, Date, teams and every statistic as a number; absent or unreadable ones are null.

    Matches without a full score are left out, unless they are asked for.
    """
    have = set(raw.columns)
    numbers = [(F.expr(f"try_cast(trim(`{c}`) as double)") if c in have else F.lit(None).cast("double")).alias(c) for c in STATISTICS]
    names = [F.trim(old).alias(new) for old, new in MATCH_COLUMNS.items()]
    out = raw.select(names[0], season_of_file(F.col("_file")).alias("Season"), day_first(F.col("Date")).alias("Date"), *names[1:], *numbers)
    result = F.when(F.col("FTHG") > F.col("FTAG"), "H").when(F.col("FTHG") < F.col("FTAG"), "A").when(F.col("FTHG") == F.col("FTAG"), "D")
    out = out.withColumn("FTR", result)
    return out if keep_unplayed else out.filter("FTHG is not null and FTAG is not null")


def raw_odds(raw: DataFrame, odds: Sequence[str] = ODDS) -> DataFrame:
    """League, Date, teams and the three odds, where all three are numbers above 1; without their columns, no rows."""
    if not set(odds) <= set(raw.columns):
        return raw.sparkSession.createDataFrame([], "League string, Date date, HomeTeam string, AwayTeam string, " + ", ".join(f"{o} double" for o in odds))
    numbers = [F.expr(f"try_cast(trim(`{o}`) as double)").alias(o) for o in odds]
    out = raw.select(F.trim("Div").alias("League"), day_first(F.col("Date")).alias("Date"), F.trim("HomeTeam").alias("HomeTeam"), F.trim("AwayTeam").alias("AwayTeam"), *numbers)
    return out.filter(reduce(lambda a, b: a & b, [F.col(o) > 1 for o in odds]))


def fixtures(raw: DataFrame, leagues: Sequence[str], today) -> DataFrame:
    """Unplayed matches of the leagues from a day on."""
    upcoming = to_matches(raw, keep_unplayed=True).filter(F.col("League").isin(*leagues) & (F.col("Date") >= F.lit(today).cast("date")) & F.col("FTHG").isNull())
    return upcoming.select("League", "Date", "HomeTeam", "AwayTeam")


def score(text: Column) -> tuple[Column, Column]:
    """(home, away) goals of a score such as ``2–1``, with any dash; null where there is none."""
    shape = rf"(\d+)\s*[{DASHES}]\s*(\d+)"
    return tuple(F.nullif(F.regexp_extract(text, shape, k), F.lit("")).cast("int") for k in (1, 2))


def with_played(schedule: DataFrame, column: str = "score") -> DataFrame:
    """A schedule with FTHG, FTAG and whether it was played."""
    home, away = score(F.col(column))
    return schedule.withColumns({"FTHG": home, "FTAG": away, "played": home.isNotNull()})


def table_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A Parquet table, or an empty one of the schema where the path does not exist."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path)
