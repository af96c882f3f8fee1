"""Exports of a game's editions in many schemas, and player statistics in two-level tables, as one schema.

Columns are resolved on the plan's side from a frame's column names; rows are worked on by column
functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions.names import normalise_name
from touchline.sources.files import csv_frames

#: The names that an export may give a field, best first.
FIELDS = {
    "name": ("long_name", "common_name", "name", "player_name", "Name", "Player", "PLAYER", "short_name"),
    "alt_name": ("alt_name", "short_name", "common_name", "display_name"),
    "first_name": ("first_name", "firstname", "given_name"),
    "last_name": ("last_name", "lastname", "surname", "family_name"),
    "overall": ("overall", "overall_rating", "Overall", "OVR", "ovr", "rating"),
    "club": ("club_name", "club", "Club", "team", "Team", "TEAM", "club_team"),
    "positions": ("player_positions", "positions", "position", "Position", "POS", "best_position"),
    "gender": ("gender", "Gender", "sex"),
    "age": ("age", "Age", "AGE"),
    "pace": ("pace", "Pace", "PAC"),
    "shooting": ("shooting", "Shooting", "SHO"),
    "passing": ("passing", "Passing", "PAS"),
    "dribbling": ("dribbling", "Dribbling", "DRI"),
    "defending": ("defending", "Defending", "DEF"),
    "physical": ("physic", "physical", "Physicality", "PHY"),
    "gk_diving": ("gk_diving", "goalkeeping_diving", "GK Diving"),
    "gk_handling": ("gk_handling", "goalkeeping_handling", "GK Handling"),
    "gk_kicking": ("gk_kicking", "goalkeeping_kicking", "GK Kicking"),
    "gk_positioning": ("gk_positioning", "goalkeeping_positioning", "GK Positioning"),
    "gk_reflexes": ("gk_reflexes", "goalkeeping_reflexes", "GK Reflexes"),
}
KEEPER = ("gk_diving", "gk_handling", "gk_kicking", "gk_positioning", "gk_reflexes")
NUMBERS = ("age", "pace", "shooting", "passing", "dribbling", "defending", "physical", *KEEPER)
CANON = ("name", "alt_name", "overall", "club", "positions", *NUMBERS)
#: The role of each position, and the groups of a season's position from the strongest.
ROLES = {
    "GK": "GK", "CB": "CB", "LCB": "CB", "RCB": "CB", "LB": "FB", "RB": "FB", "LWB": "FB", "RWB": "FB", "CDM": "DM", "LDM": "DM", "RDM": "DM", "CM": "MID", "LCM": "MID", "RCM": "MID",
    "CAM": "AMW", "LM": "AMW", "RM": "AMW", "LW": "AMW", "RW": "AMW", "ST": "FWD", "CF": "FWD", "LS": "FWD", "RS": "FWD", "LF": "FWD", "RF": "FWD",
}
GROUPS = ("GK", "D", "F", "M")
#: What each kind of export calls the canonical columns; a tuple is joined with commas.
SCHEMAS = {
    "long": {"name": "long_name", "alt_name": "short_name", "overall": "overall", "club": "club_name", "positions": "player_positions", "age": "age", "pace": "pace", "shooting": "shooting", "passing": "passing", "dribbling": "dribbling", "defending": "defending", "physical": "physic", **{k: f"goalkeeping_{k[3:]}" for k in KEEPER}},
    "site24": {"name": "Name", "alt_name": "Name", "overall": "Overall", "club": "Club", "positions": "Position", "age": "Age", "pace": "Pace", "shooting": "Shooting", "passing": "Passing", "dribbling": "Dribbling", "defending": "Defending", "physical": "Physicality"},
    "site25": {"name": "Name", "alt_name": "Name", "overall": "OVR", "club": "Team", "positions": ("Position", "Alternative positions"), "age": "Age", "pace": "PAC", "shooting": "SHO", "passing": "PAS", "dribbling": "DRI", "defending": "DEF", "physical": "PHY", **{k: f"GK {k[3:].capitalize()}" for k in KEEPER}},
    "site27": {"name": ("common_name", "first_name", "last_name"), "alt_name": "common_name", "overall": "overall_rating", "club": "club", "positions": ("position", "alternate_positions"), **{k: f"goalkeeping_{k[3:]}" for k in KEEPER}},
}


def find_column(columns: Sequence[str], field: str) -> str | None:
    """The column that holds a field: by an exact name first, then in any case."""
    exact = [c for c in FIELDS[field] if c in columns]
    folded = {c.lower(): c for c in columns}
    return exact[0] if exact else next((folded[c.lower()] for c in FIELDS[field] if c.lower() in folded), None)


def _text(df: DataFrame, name: str | None) -> Column:
    """A column as trimmed text, null where it is blank or absent."""
    return F.nullif(F.trim(F.col(f"`{name}`").cast("string")), F.lit("")) if name in df.columns else F.lit(None).cast("string")


def _number(df: DataFrame, name: str | None) -> Column:
    return F.expr(f"try_cast(trim(cast(`{name}` as string)) as double)") if name in df.columns else F.lit(None).cast("double")


def full_name(first: Column, last: Column) -> Column:
    return F.nullif(F.trim(F.concat_ws(" ", first, last)), F.lit(""))


def display_name(df: DataFrame) -> Column | None:
    """The name column, else first and last name, row by row; None if the frame has neither."""
    name, first, last = (find_column(df.columns, f) for f in ("name", "first_name", "last_name"))
    both = full_name(_text(df, first), _text(df, last)) if first and last else None
    if name:
        return F.coalesce(_text(df, name), both) if both is not None else F.coalesce(_text(df, name), F.lit(""))
    return both


def latin_only(name: Column) -> Column:
    """Without letters of other scripts, and without the gaps they leave."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"[^\x00-\x7F\u00C0-\u024F\u1E00-\u1EFF]", ""), r"\s+", " "))


def men_only(df: DataFrame, column: str) -> DataFrame:
    """Rows whose gender says men or nothing; all rows if that would leave none."""
    text = F.lower(F.col(f"`{column}`").cast("string"))
    keep = F.coalesce(text.contains("men"), F.lit(True)) & ~F.coalesce(text.contains("women"), F.lit(False))
    any_kept = df.agg(F.coalesce(F.max(keep.cast("int")), F.lit(0)).alias("_any"))
    return df.withColumn("_keep", keep).crossJoin(F.broadcast(any_kept)).filter(F.col("_keep") | (F.col("_any") == 0)).drop("_keep", "_any")


def primary_role(positions: Column) -> Column:
    """The role of the first position that is known, of a list by commas or bars."""
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    tokens = F.transform(F.split(F.replace(positions, F.lit("|"), F.lit(",")), ","), lambda t: known[F.upper(F.trim(t))])
    return F.get(F.filter(tokens, lambda r: r.isNotNull()), F.lit(0))


def position_group(position: Column) -> Column:
    """The strongest group among the words of a season's position; null if there is none."""
    words = F.split(F.trim(position), r"\s+")
    out = F.lit(None).cast("string")
    for group in reversed(GROUPS):
        out = F.when(F.array_contains(words, group), group).otherwise(out)
    return out


def normalise_export(df: DataFrame, season: Column | None = None) -> DataFrame | None:
    """An export as fifa_name, fifa_overall, the other fields that it has, role, norm and (with it) Season.

    None if it has no column for a name or an overall.  Of rows of one normalised name (and season) the
    best rated stays, of equal ones the first by its other values; rows without an overall go.
    """
    overall = find_column(df.columns, "overall")
    if overall is None or display_name(df) is None:
        return None
    gender = find_column(df.columns, "gender")
    df = men_only(df, gender) if gender else df
    name = latin_only(F.coalesce(display_name(df), F.lit("")))
    columns = {"fifa_name": name, "fifa_overall": _number(df, overall)}
    for field in ("club", "positions", *NUMBERS):
        found = find_column(df.columns, field)
        if found:
            columns[f"fifa_{field}"] = _text(df, found) if field in ("club", "positions") else _number(df, found)
    alt = find_column(df.columns, "alt_name")
    if alt:
        other = latin_only(_text(df, alt))
        columns["fifa_alt_name"] = F.when(other != name, other)
    columns["role"] = primary_role(columns["fifa_positions"]) if "fifa_positions" in columns else F.lit(None).cast("string")
    if season is not None:
        columns["Season"] = season
    out = df.select(*[c.alias(n) for n, c in columns.items()]).filter("fifa_overall is not null").withColumn("norm", normalise_name(F.col("fifa_name")))
    keys = ["norm"] + (["Season"] if season is not None else [])
    rest = [c for c in out.columns if c not in (*keys, "fifa_overall")]
    best = Window.partitionBy(*keys).orderBy(F.desc("fifa_overall"), *rest)
    return out.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def load_editions(spark: SparkSession, folder: str, pattern: str = "fifa_[0-9][0-9][0-9][0-9].csv") -> DataFrame | None:
    """All editions of a folder, one file (or folder of files) a season; files of one header are read together.

    None if no file has a name and an overall.
    """
    season = F.regexp_extract("_path", r"fifa_(\d{4})\.csv", 1)
    frames = csv_frames(spark, f"{folder.rstrip('/')}/{pattern}", FIELDS["overall"])
    parts = [p for p in (normalise_export(df, season) for df in frames) if p is not None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def adapted(df: DataFrame, schema: str, edition: Column) -> DataFrame:
    """Any of the known schemas as the canonical columns and Season; rows without name or overall go.

    Edition 24 is the season 2324.  Columns that the export lacks are null.
    """
    spec = SCHEMAS[schema]
    if schema == "site27" and "gender" in df.columns:
        df = men_only(df, "gender")

    def joined(sources: tuple[str, ...]) -> Column:
        return F.nullif(F.concat_ws(", ", *[_text(df, s) for s in sources]), F.lit(""))

    columns = []
    for name in CANON:
        source = spec.get(name)
        if name == "name" and isinstance(source, tuple):
            value = F.coalesce(_text(df, source[0]), full_name(_text(df, source[1]), _text(df, source[2])))
        elif name in ("name", "alt_name", "club", "positions"):
            value = joined(source) if isinstance(source, tuple) else _text(df, source)
        else:
            value = _number(df, source)
        columns.append(value.alias(name))
    year = edition.cast("int")
    season = F.concat(F.lpad(F.pmod(year - 1, F.lit(100)).cast("string"), 2, "0"), F.lpad(F.pmod(year, F.lit(100)).cast("string"), 2, "0"))
    return df.select(*columns, season.alias("Season")).filter("name is not null and overall is not null")


def flat_names(columns: Sequence[tuple[str, str] | str]) -> list[str]:
    """Unique names of two-level headers: the lower level, with the upper one before it where it stands already, then numbered."""
    out: list[str] = []
    for column in columns:
        group, leaf = column if isinstance(column, tuple) else ("", column)
        options = [leaf or group] + ([f"{group}_{leaf}"] if group and leaf else [])
        name, number = next((o for o in options if o not in out), options[-1]), 2
        while name in out:
            name, number = f"{options[-1]}_{number}", number + 1
        out.append(name)
    return out


def per_ninety(df: DataFrame, keys: Sequence[str], wanted: dict[str, str], nineties: str = "90s") -> DataFrame:
    """Keys and the wanted columns by their new names; counts also per 90 minutes, shares and rates as they are.

    A column that ends with % or 90 is a share or a rate.  Without a positive number of nineties a rate is null.
    """
    n = _number(df, nineties)
    columns = []
    for source, name in wanted.items():
        if source in df.columns:
            value = _number(df, source)
            columns += [value.alias(name)] if source.endswith(("%", "90")) else [F.when(n > 0, value / n).alias(f"{name}_per90"), value.alias(name)]
    return df.select(*keys, *columns)


def player_stats(misc: DataFrame, keeper: DataFrame, keys: Sequence[str], misc_columns: dict[str, str], keeper_columns: dict[str, str]) -> DataFrame:
    """Both kinds of statistics on one row a player, whichever has him; a name that both have gets ``_gk`` on the second."""
    a, b = per_ninety(misc, keys, misc_columns), per_ninety(keeper, keys, keeper_columns)
    renamed = b.select(*keys, *[F.col(f"`{c}`").alias(f"{c}_gk" if c in a.columns else c) for c in b.columns if c not in keys])
    return a.join(renamed, list(keys), "full")


def challenge_rates(df: DataFrame) -> DataFrame:
    """Adds clean_challenge_rate and ball_won_per_foul as far as their columns are there; null where the divisor is 0."""
    have, out = set(df.columns), df
    if {"tackles_won_per90", "fouls_per90"} <= have:
        out = out.withColumn("clean_challenge_rate", F.expr("try_divide(tackles_won_per90, tackles_won_per90 + fouls_per90)"))
    if {"tackles_won_per90", "interceptions_per90", "fouls_per90"} <= have:
        out = out.withColumn("ball_won_per_foul", F.expr("try_divide(tackles_won_per90 + interceptions_per90, fouls_per90)"))
    return out
