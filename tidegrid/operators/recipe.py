"""Recipes: one row per column says how it is cleaned. Choices are CASE expressions over a profile.

profile: col, dtype_raw, dtype_inferred, n, null_pct, distinct_pct, zero_pct, iqr, skew, any_outlier,
temporal_pct, iqr_pct, issue, constant. A catalogue's profile has its tables' rows, told apart by further
columns (keys, as a rule "table"); a table's timestamp and season are then columns too, see planned().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.spec import DEFAULT, SEASON

#: Choices a recipe may hold, and names that mark bookkeeping columns.
MISSING = ("none", "interpolate", "forward_fill", "backward_fill", "mean_fill", "median_fill", "flag_and_fill", "drop_row")
OUTLIER = ("keep", "winsorize", "clip_iqr", "log_transform", "rolling_iqr", "stl_residuals", "remove")
TYPE_FIX = ("none", "parse_datetime", "cast_numeric", "encode_boolean")
ACTION = ("keep", "drop")
AUDIT = "created|updated|loaded|inserted|modified|source_file|audit|batch"
_IQR_FAMILY = ("clip_iqr", "rolling_iqr", "stl_residuals", "remove")


#: A value for the whole profile, or a column of it.
Value = str | int | None | Column


def _value(x: Value, kind: str) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast(kind)


def period_of(frequency: Column) -> Column:
    return F.coalesce(*(F.when(frequency == k, v) for k, v in SEASON.items()), F.lit(7))


def outlier_choice(any_outlier: Column, has_ts: Column, rows: Column, period: Column) -> Column:
    return F.when(~any_outlier, "keep").when(~has_ts, "clip_iqr").when(rows >= 2 * period, "stl_residuals").when(rows >= 30, "rolling_iqr").otherwise("clip_iqr")


def is_audit(col: Column) -> Column:
    return F.lower(col).rlike(AUDIT)


def _fix(issue: Column) -> Column:
    return F.when(issue == "numeric_as_string", "cast_numeric").when(issue == "datetime_as_string", "parse_datetime").otherwise("none")


def default_recipe(profile: DataFrame, timestamp_col: Value, period: Value, keys: tuple[str, ...] = ()) -> DataFrame:
    """profile (of diagnose.facts()) -> a recipe; a constant column is dropped and nothing else is done to it."""
    has_ts, live = _value(timestamp_col, "string").isNotNull(), ~F.col("constant")
    missing = F.when(live & (F.col("null_pct") > 0), F.when(has_ts, "interpolate").otherwise("forward_fill")).otherwise("none")
    outlier = outlier_choice(F.coalesce("any_outlier", F.lit(False)), has_ts, F.col("n"), _value(period, "long"))
    return profile.select(
        *keys,
        "col",
        missing.alias("missing_strategy"),
        F.when(live, outlier).otherwise("keep").alias("outlier_strategy"),
        F.when(live, _fix(F.col("issue"))).otherwise("none").alias("type_fix"),
        F.when(live, "keep").otherwise("drop").alias("action"),
    )


def evidence_recipe(profile: DataFrame, timestamp_col: Value, period: Value, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rules by evidence: few local outliers call for local fences, zero-inflated values stay, skew prefers medians."""
    ts, season = _value(timestamp_col, "string"), _value(period, "long")
    profile = profile.withColumns({"_ts": ts, "_season": season})
    base = default_recipe(profile, F.col("_ts"), F.col("_season"), keys).join(profile, [*keys, "col"])
    local = F.col("temporal_pct") * 2 <= F.col("iqr_pct")
    outlier = F.when(F.col("outlier_strategy") == "keep", "keep").when(F.col("zero_pct") > DEFAULT.zero_pct, "keep").when(F.col("temporal_pct").isNull(), "clip_iqr").when(local, F.when(F.col("n") >= 2 * F.col("_season"), "stl_residuals").otherwise("rolling_iqr")).otherwise("clip_iqr")
    numeric = F.col("dtype_inferred") == "numeric"
    missing = F.when(F.col("null_pct") <= 0, "none").when(F.col("null_pct") < 1, "drop_row").when(F.col("_ts").isNotNull(), F.col("missing_strategy")).when(numeric & (F.abs("skew") > 1), "median_fill").when(numeric, "mean_fill").otherwise("forward_fill")
    gone = (F.col("null_pct") >= DEFAULT.drop_null_pct) | (F.col("distinct_pct") >= DEFAULT.identifier_pct) & (F.col("col") != F.coalesce("_ts", F.lit("")))
    return base.select(*keys, "col", missing.alias("missing_strategy"), outlier.alias("outlier_strategy"), "type_fix", F.when(gone, "drop").otherwise(F.col("action")).alias("action"))


def normalized(recipe: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """A recipe from outside: none and keep are swapped where the field wants the other; unknown values raise."""

    def field(name: str, allowed: tuple[str, ...], wrong: str, right: str) -> Column:
        v = F.when(F.col(name) == wrong, right).otherwise(F.coalesce(F.col(name), F.lit(right)))
        return F.when(v.isin(*allowed), v).otherwise(F.raise_error(F.concat(F.lit(f"{name}: unknown value "), v))).alias(name)

    return recipe.select(*keys, "col", field("missing_strategy", MISSING, "keep", "none"), field("outlier_strategy", OUTLIER, "none", "keep"), field("type_fix", TYPE_FIX, "keep", "none"), field("action", ACTION, "none", "keep"))


def filled(recipe: DataFrame, columns: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every one of columns (col); those that the recipe omits do nothing."""
    noop = {"missing_strategy": "none", "outlier_strategy": "keep", "type_fix": "none", "action": "keep"}
    return columns.select(*keys, "col").join(recipe, [*keys, "col"], "left").select(*keys, "col", *(F.coalesce(k, F.lit(v)).alias(k) for k, v in noop.items()))


def forced_type_fix(recipe: DataFrame, issues: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    fix = F.when(F.col("type_fix") == "none", _fix(F.col("issue"))).otherwise(F.col("type_fix"))
    return recipe.join(issues.select(*keys, "col", "issue"), [*keys, "col"], "left").withColumn("type_fix", fix).drop("issue")


def catalogue_options(grids: DataFrame, tables: DataFrame) -> DataFrame:
    """Options of every table: table, timestamp_col, frequency, period, sort_by_timestamp, drop_duplicates.

    grids: table, col, frequency, pos, a row for each timestamp column; tables: table, duplicates, user_timestamp (null where the
    user chose none). Without a timestamp nothing is sorted and the season is the default one.
    """
    from tidegrid.operators.diagnose import finest

    picked = grids.groupBy("table").agg(finest().alias("picked"))
    chosen = tables.join(picked, "table", "left").withColumn("col", F.coalesce(F.nullif("user_timestamp", F.lit("")), "picked"))
    known = chosen.join(grids.select("table", "col", "frequency"), ["table", "col"], "left")
    frequency = F.coalesce("frequency", F.lit("unknown"))
    return known.select("table", F.col("col").alias("timestamp_col"), frequency.alias("frequency"), period_of(F.col("frequency")).cast("long").alias("period"), F.col("col").isNotNull().alias("sort_by_timestamp"), (F.coalesce("duplicates", F.lit(0)) > 0).alias("drop_duplicates"))


def planned(profiles: DataFrame, options: DataFrame, rules: str = "default", given: DataFrame | None = None) -> DataFrame:
    """Recipes of all tables of a catalogue at once: table, col and the choices, sanitized.

    profiles: rows of diagnose.facts() with their table; options: see catalogue_options(). given is a recipe from outside (table,
    col, choices): it is checked, completed, and takes the rules' place. A table without options has no timestamp.
    """
    keys = ("table",)
    known = profiles.join(options.select("table", "timestamp_col", "period"), "table", "left")
    ts, period = F.col("timestamp_col"), F.coalesce("period", period_of(F.lit(None).cast("string")))
    if given is not None:
        made = filled(normalized(given, keys), known, keys)
    else:
        made = {"default": default_recipe, "evidence": evidence_recipe}[rules](known, ts, period, keys)
    return sanitized(forced_type_fix(made, known, keys), known, ts, keys)


def options(grids: DataFrame, user_timestamp: str | None = None, duplicates: int = 0) -> DataFrame:
    """grids (col, frequency, pos) -> timestamp_col, frequency, period, sort_by_timestamp, drop_duplicates; a user's choice wins."""
    from tidegrid.operators.diagnose import pick_timestamp

    name = pick_timestamp(grids).select(F.coalesce(F.nullif(F.lit(user_timestamp or ""), F.lit("")), "timestamp_col").alias("timestamp_col"))
    out = name.join(grids.select(F.col("col").alias("timestamp_col"), "frequency"), "timestamp_col", "left")
    return out.select("timestamp_col", F.coalesce("frequency", F.lit("unknown")).alias("frequency"), period_of(F.col("frequency")).cast("long").alias("period"), F.col("timestamp_col").isNotNull().alias("sort_by_timestamp"), F.lit(duplicates > 0).alias("drop_duplicates"))


def sanitized(recipe: DataFrame, profile: DataFrame, timestamp_col: Value, keys: tuple[str, ...] = ()) -> DataFrame:
    """Choices that the profile doesn't justify are corrected; mostly empty columns and the timestamp stop early."""
    known = profile.select(*keys, "col", "dtype_raw", "dtype_inferred", "null_pct", "distinct_pct", "zero_pct", "iqr", "constant", _value(timestamp_col, "string").alias("_ts"))
    r = recipe.join(known, [*keys, "col"])
    empty = F.coalesce(F.col("null_pct") >= DEFAULT.drop_null_pct, F.lit(False))
    is_ts = F.col("col") == F.coalesce("_ts", F.lit(""))
    text = F.col("dtype_raw") == "string"
    fix = F.when(empty | (F.col("type_fix") != "none"), F.col("type_fix")).when(text & (F.col("dtype_inferred") == "numeric"), "cast_numeric").when(text & (F.col("dtype_inferred") == "datetime"), "parse_datetime").otherwise(F.col("type_fix"))
    justified = F.col("constant") | (F.col("distinct_pct") >= DEFAULT.identifier_pct) | is_audit(F.col("col"))
    action = F.when(empty, "drop").when(is_ts, "keep").when((F.col("action") == "drop") & ~justified, "keep").otherwise(F.col("action"))
    numeric = (F.col("dtype_inferred") == "numeric") | (fix == "cast_numeric")
    missing = F.when(empty, F.col("missing_strategy")).when(is_ts, "drop_row").when(~numeric & F.col("missing_strategy").isin("interpolate", "mean_fill", "median_fill"), "forward_fill").otherwise(F.col("missing_strategy"))
    flat = (F.col("iqr") == 0) | (F.col("zero_pct") >= DEFAULT.zero_pct)
    outlier = F.when(empty, F.col("outlier_strategy")).when(is_ts, "keep").when(F.col("outlier_strategy").isin(*_IQR_FAMILY) & F.coalesce(flat, F.lit(False)), "keep").otherwise(F.col("outlier_strategy"))
    return r.select(*keys, "col", missing.alias("missing_strategy"), outlier.alias("outlier_strategy"), fix.alias("type_fix"), action.alias("action"))
