"""Cleaning transforms, and a recipe applied step by step to all columns at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions import expressions as ex
from tidegrid.functions import formats
from tidegrid.operators import ordering
from tidegrid.operators.measures import Measures, measured
from tidegrid.operators.profile import _wide, numeric_columns, sane
from tidegrid.operators.quantiles import beside, grouped, quantiles
from tidegrid.sources.scratch import stored
from tidegrid.spec import DEFAULT, SeriesSpec

_FENCES = (0.25, 0.75)


def _double(c: str) -> Column:
    return F.col(c).cast("double")


def _with_quantiles(df: DataFrame, values: dict[str, Column], shares: tuple[float, ...], series: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, tuple[Column, ...]], dict[str, Column]]:
    """df, quantiles of values by name, and how many values there are; of each series for itself if there are any.

    The returned frame may hold further columns that the expressions need. Without values quantiles are null.
    """
    if not series:
        found, count = quantiles(df, values, shares), df.agg(*(F.count(v).alias(n) for n, v in values.items())).first() if values else {}
        lits = {n: tuple(F.lit(x).cast("double") for x in (q or [None] * len(shares))) for n, q in found.items()}
        return df, lits, {n: F.lit(count[n]) for n in values}
    stats = grouped(df, series, values, shares)
    return beside(df, stats, series), {n: tuple(F.col(f"q_{n}")[i] for i in range(len(shares))) for n in values}, {n: F.col(f"n_{n}") for n in values}


def _numbers(columns: list[str]) -> dict[str, Column]:
    return {c: ex.no_nan(_double(c)) for c in columns}


def _clipped(c: str, low: Column, high: Column) -> Column:
    """Outside values become the bound; without bounds (no values at all) nothing changes."""
    return F.when(low.isNull(), F.col(c)).otherwise(ex.clip(F.col(c), low, high))


def _wide_fences(q1: Column, q3: Column) -> tuple[Column, Column]:
    return q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)


def winsorize(df: DataFrame, *columns: str, series: tuple[str, ...] = ()) -> DataFrame:
    """Values beyond the outer percentiles become these; with series, those of each series."""
    rows, q, _ = _with_quantiles(df, _numbers(list(columns)), DEFAULT.winsor, series)
    return rows.withColumns({c: _clipped(c, *q[c]) for c in columns}).select(*df.columns)


def clip_iqr(df: DataFrame, *columns: str, series: tuple[str, ...] = ()) -> DataFrame:
    """Values outside the fences become these; with series, those of each series."""
    rows, q, _ = _with_quantiles(df, _numbers(list(columns)), _FENCES, series)
    return rows.withColumns({c: _clipped(c, *_wide_fences(*q[c])) for c in columns}).select(*df.columns)


def log_transform(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.log1p(F.greatest(F.col(c), F.lit(0.0)))) for c in columns})


def marked(df: DataFrame, columns: list[str], series: tuple[str, ...] = ()) -> DataFrame:
    """df with _out_{column}: whether the value is outside the fences (of its series); nulls are not."""
    if not columns:
        return df
    rows, q, _ = _with_quantiles(df, _numbers(columns), _FENCES, series)
    fences = {c: _wide_fences(*q[c]) for c in columns}
    masks = {f"_out_{c}": F.coalesce((F.col(c) < low) | (F.col(c) > high), F.lit(False)) for c, (low, high) in fences.items()}
    return rows.withColumns(masks).select(*df.columns, *masks)


def without_outliers(df: DataFrame, *columns: str, series: tuple[str, ...] = ()) -> DataFrame:
    out = marked(df, list(columns), series)
    return drop_rows(out, [F.col(f"_out_{c}") for c in columns]).select(*df.columns)


def rolling_iqr(df: DataFrame, columns: str | list[str], spec: SeriesSpec, period: int) -> DataFrame:
    """Clip to centred rolling fences; where a series has fewer values of a column than the window, to that series' own ones."""
    columns, w = [columns] if isinstance(columns, str) else columns, max(period, 7)
    rolled = ordering.rolling(df, spec, w, **{f"_q_{c}": ordering.quartiles(ex.no_nan(_double(c))) for c in columns})
    rows, q, n = _with_quantiles(rolled, _numbers(columns), _FENCES, spec.series)
    fences = {}
    for c in columns:
        low, high = _wide_fences(F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[1])
        local = ex.clip(F.col(c), F.coalesce(low, F.col(c)), F.coalesce(high, F.col(c)))
        fences[c] = F.when(n[c] >= w, local).otherwise(_clipped(c, *_wide_fences(*q[c])))
    return rows.withColumns(fences).select(*df.columns)


def seasonal_repair(df: DataFrame, columns: str | list[str], spec: SeriesSpec, period: int) -> DataFrame:
    """Values whose residual from trend and season is far off become trend plus season; all columns in one pass.

    A series is filled both ways first; the trend is a centred mean over an odd window, the season
    the mean detrended value by ordinal modulo period. What is far off is measured by the median distance of a series'
    own residuals; without any spread nothing changes.
    """
    columns = [columns] if isinstance(columns, str) else columns
    w = period + 1 if period % 2 == 0 else period
    rows = ordering.ordered(df, spec)
    rows = _filled(rows, {c: ("both", f"_f_{c}") for c in columns}, spec)
    rows = ordering.ordinal(ordering.rolling(stored(rows), spec, w, **{f"_t_{c}": F.avg(f"_f_{c}") for c in columns}), spec, "_i")
    rows = stored(rows.withColumn("_phase", F.col("_i") % period).drop("_i"))
    season = rows.groupBy(*spec.series, "_phase").agg(*(F.avg(F.col(f"_f_{c}") - F.col(f"_t_{c}")).alias(f"_s_{c}") for c in columns))
    # stored, so that few phases are broadcast: dealt by phase, rows would meet in as many tasks as a season has steps
    rows = beside(rows, stored(season), [*spec.series, "_phase"])
    rows = rows.withColumns({f"_r_{c}": F.col(f"_f_{c}") - F.col(f"_t_{c}") - F.col(f"_s_{c}") for c in columns})
    rows, median, _ = _with_quantiles(rows, {f"m_{c}": F.col(f"_r_{c}") for c in columns}, (0.5,), spec.series)
    rows = stored(rows.withColumns({f"_d_{c}": F.abs(F.col(f"_r_{c}") - median[f"m_{c}"][0]) for c in columns}))
    rows, mad, _ = _with_quantiles(rows, {f"a_{c}": F.col(f"_d_{c}") for c in columns}, (0.5,), spec.series)
    off = {c: (mad[f"a_{c}"][0] > 0) & (F.col(f"_d_{c}") > DEFAULT.residual * mad[f"a_{c}"][0]) for c in columns}
    return rows.withColumns({c: F.when(x, F.col(f"_t_{c}") + F.col(f"_s_{c}")).otherwise(F.col(c)) for c, x in off.items()}).select(*df.columns)


def stl_residuals(df: DataFrame, columns: str | list[str], spec: SeriesSpec, period: int) -> DataFrame:
    """seasonal_repair(), or rolling_iqr() where a series has fewer than two seasons of a column's values."""
    columns = [columns] if isinstance(columns, str) else columns
    least = df.groupBy(*spec.series).agg(*(F.count(c).alias(c) for c in columns)) if spec.series else df.agg(*(F.count(c).alias(c) for c in columns))
    least = least.agg(*(F.struct(F.min(c).alias("low"), F.max(c).alias("high")).alias(c) for c in columns)).first()
    long = [c for c in columns if (least[c]["low"] or 0) >= 2 * period]
    short = [c for c in columns if (least[c]["high"] or 0) < 2 * period]
    mixed = [c for c in columns if c not in long and c not in short]  # series of both kinds
    out = seasonal_repair(df, long, spec, period) if long else df
    out = rolling_iqr(out, short, spec, period) if short else out
    if mixed:
        out = ordering.ordered(out, spec)
        both = stored(rolling_iqr(out.withColumns({f"_w_{c}": F.col(c) for c in mixed}), [f"_w_{c}" for c in mixed], spec, period))
        both = seasonal_repair(both.withColumns({f"_x_{c}": F.col(c) for c in mixed}), [f"_x_{c}" for c in mixed], spec, period)
        rows, _, n = _with_quantiles(both, {c: F.col(c) for c in mixed}, (0.5,), spec.series)
        out = rows.withColumns({c: F.when(n[c] >= 2 * period, F.col(f"_x_{c}")).otherwise(F.col(f"_w_{c}")) for c in mixed}).select(*out.columns)
    return out.select(*df.columns)


def _filled(df: DataFrame, ways: dict[str, tuple[str, str]], spec: SeriesSpec) -> DataFrame:
    """Each column filled in its way (forward, backward, both: forward first) under its name, in one pass."""
    forward = {f"_fwd_{c}": F.col(c) for c, (way, _) in ways.items() if way in ("forward", "both")}
    backward = {f"_bwd_{c}": F.col(c) for c, (way, _) in ways.items() if way in ("backward", "both")}
    out = ordering.carried(df, spec, forward, backward)
    parts = {"forward": ["_fwd_"], "backward": ["_bwd_"], "both": ["_fwd_", "_bwd_"]}
    return out.withColumns({name: F.coalesce(*(F.col(x + c) for x in parts[way])) for c, (way, name) in ways.items()}).drop(*forward, *backward)


def fill(df: DataFrame, column: str, spec: SeriesSpec, way: str, name: str | None = None) -> DataFrame:
    """Fill nulls forward, backward, or both ways (forward first)."""
    return _filled(df, {column: (way, name or column)}, spec)


def flag_and_fill(df: DataFrame, column: str, spec: SeriesSpec) -> DataFrame:
    return fill(df.withColumn(f"{column}_missing", F.col(column).isNull().cast("int")), column, spec, "forward")


def filled_in(df: DataFrame, spec: SeriesSpec, ways: dict[str, str] | None = None, linear: list[str] | None = None, by_time: bool = True) -> DataFrame:
    """Columns filled in their ways and interpolated, all in one pass over the order.

    Interpolation is linear between neighbours by time, or by position if by_time is false or any row lacks a stamp;
    leading nulls stay, trailing ones take the last value.
    """
    ways, linear = ways or {}, linear or []
    rows = ordering.ordered(df, spec)
    if linear and by_time and rows.where(F.col(spec.ts).isNull()).take(1):
        by_time = False
    if linear:
        rows = rows.withColumn("_x", ex.micros(spec.ts)) if by_time else ordering.ordinal(rows, spec, "_x")

    def here(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.col("_x").alias("x"), _double(c).alias("v")))

    forward = {f"_fwd_{c}": F.col(c) for c, way in ways.items() if way in ("forward", "both")} | {f"_a_{c}": here(c) for c in linear}
    backward = {f"_bwd_{c}": F.col(c) for c, way in ways.items() if way in ("backward", "both")} | {f"_b_{c}": here(c) for c in linear}
    out = ordering.carried(rows, spec, forward, backward)
    new = {c: F.coalesce(*(F.col(x + c) for x in ("_fwd_", "_bwd_") if x + c in forward | backward)) for c in ways}
    for c in linear:
        a, b = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        between = F.when(b.isNull() | (b["x"] == a["x"]), a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * (F.col("_x") - a["x"]) / (b["x"] - a["x"]))
        new[c] = F.coalesce(F.col(c), F.when(a.isNotNull(), between))
    return out.withColumns(new).select(*df.columns)


def interpolate(df: DataFrame, column: str, spec: SeriesSpec, by_time: bool = True) -> DataFrame:
    """See filled_in()."""
    return filled_in(df, spec, linear=[column], by_time=by_time)


def fill_with(df: DataFrame, how: str, *columns: str, series: tuple[str, ...] = ()) -> DataFrame:
    """Nulls become the column's mean or median; with series, that of their series. Without values they stay."""
    if how == "median":
        rows, q, _ = _with_quantiles(df, _numbers(list(columns)), (0.5,), series)
        value = {c: q[c][0] for c in columns}
    elif series:
        means = stored(df.groupBy(*series).agg(*(F.avg(v).alias(f"_m_{c}") for c, v in _numbers(list(columns)).items())))
        rows, value = beside(df, means, series), {c: F.col(f"_m_{c}") for c in columns}
    else:
        row = df.agg(*(F.avg(v).alias(c) for c, v in _numbers(list(columns)).items())).first()
        rows, value = df, {c: F.lit(row[c]) for c in columns}
    return rows.withColumns({c: F.coalesce(F.col(c), v) for c, v in value.items()}).select(*df.columns)


def drop_rows(df: DataFrame, masks: list[Column]) -> DataFrame:
    """One filter of all masks; null is no reason to drop."""
    gone = F.lit(False)
    for m in masks:
        gone = gone | F.coalesce(m, F.lit(False))
    return df.where(~gone)


def sorted_by_time(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """df in time order. A timestamp stored as text is read by its column's format first, and rows that it doesn't read go; others stay, without a stamp too."""
    if dict(df.dtypes)[spec.ts] == "string":
        df = df.withColumn(spec.ts, formats.timestamps(df, [spec.ts])[spec.ts]).where(F.col(spec.ts).isNotNull())
    return df.orderBy(F.col(spec.ts).asc_nulls_last(), *(c for c in spec.ties if c in df.columns))


def snapshot(df: DataFrame) -> DataFrame:
    """col, null_pct, std (0 without values; null for other than numbers)."""
    numeric = numeric_columns(df)
    std = lambda c: F.coalesce(F.round(F.stddev_samp(c), 6), F.lit(0.0)) if c in numeric else F.lit(None).cast("double")
    return _wide(sane(df), df.columns, lambda c: {"null_pct": F.round(ex.pct(F.count("*") - F.count(F.col(c)), F.count("*")), 6), "std": std(c)})


def report(before: DataFrame | Measures, after: DataFrame | Measures) -> DataFrame:
    """One row; tables that were measured while they were written aren't read again."""
    spark = SparkSession.active()
    a, b = (x if isinstance(x, Measures) else measured(x) for x in (before, after))
    gone = ",".join(c for c in a.nulls if c not in b.nulls)
    loss = round((a.rows - b.rows) * 100.0 / a.rows, 6) if a.rows else 0.0
    return spark.createDataFrame([(a.rows, b.rows, a.rows - b.rows, loss, gone)], "rows_before long, rows_after long, rows_removed long, loss_pct double, dropped_columns string")


_ORDERED = {"outlier_strategy": ("rolling_iqr", "stl_residuals"), "missing_strategy": ("interpolate", "forward_fill", "backward_fill", "flag_and_fill")}


def apply_recipe(df: DataFrame, recipe: DataFrame, spec: SeriesSpec, period: int, dedupe: bool = True, sort: bool = True) -> DataFrame:
    """Drop columns, fix types, treat outliers, fill, drop rows, remove repeats, sort: in this order.

    The recipe has one row per column and is read by the driver to build the plans; data stays where it is. Each
    step handles all its columns at once and starts from a stored table where the one before needed the order.
    Columns that the recipe drops are gone for every later step: where they order the series, rows get their place before
    and keep it; names of series that are dropped are held aside under other names until the last step that needs them.
    Without the timestamp nothing is sorted, and interpolation goes by position. Rows that repeat others in all kept columns
    leave one, the first of them.
    """
    steps = {r["col"]: r for r in recipe.collect()}
    gone = {c for c in df.columns if c in steps and steps[c]["action"] == "drop"}
    mine = [c for c in df.columns if c in steps and c not in gone]
    fixes = {"cast_numeric": ex.number, "encode_boolean": ex.boolean}
    fixed = {c: fixes[steps[c]["type_fix"]](c) for c in mine if steps[c]["type_fix"] in fixes} | formats.timestamps(df, [c for c in mine if steps[c]["type_fix"] == "parse_datetime"])
    out = sane(df.withColumns(fixed)) if fixed else sane(df)
    needed = any(steps[c][field] in names for c in mine for field, names in _ORDERED.items())
    if needed or set(spec.order) & gone:
        out = ordering.ordered(out, spec)
    aside = {c: f"_held_{c}" for c in spec.series if c in gone}
    own = SeriesSpec(spec.ts, spec.ties, tuple(aside.get(c, c) for c in spec.series))
    series = own.series
    out = out.withColumnsRenamed(aside).drop(*(c for c in gone if c not in aside))
    numeric = set(numeric_columns(out))
    timed = dict(out.dtypes).get(spec.ts, "").startswith(("timestamp", "date"))

    def having(field: str, *wanted: str, only: set[str] | None = None) -> list[str]:
        return [c for c in mine if steps[c][field] in wanted and (only is None or c in only)]

    removed = having("outlier_strategy", "remove", only=numeric)
    out = marked(out, removed, series)
    for how, treat in (("winsorize", winsorize), ("clip_iqr", clip_iqr)):
        columns = having("outlier_strategy", how, only=numeric)
        out = treat(out, *columns, series=series) if columns else out
    columns = having("outlier_strategy", "log_transform", only=numeric)
    out = log_transform(out, *columns) if columns else out
    for how, repair in (("rolling_iqr", rolling_iqr), ("stl_residuals", stl_residuals)):
        columns = having("outlier_strategy", how, only=numeric)
        out = stored(repair(out, columns, own, period)) if columns else out
    flagged = having("missing_strategy", "flag_and_fill")
    out = out.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in flagged})
    for how in ("mean", "median"):
        columns = having("missing_strategy", f"{how}_fill", only=numeric)
        out = fill_with(out, how, *columns, series=series) if columns else out
    between = having("missing_strategy", "interpolate")
    ways = {c: "forward" for c in [*having("missing_strategy", "forward_fill"), *flagged]} | {c: "backward" for c in having("missing_strategy", "backward_fill")} | {c: "both" for c in between if c not in numeric}
    linear = [c for c in between if c in numeric]
    if ways or linear:
        out = filled_in(out, own, ways, linear, by_time=timed)
    out = drop_rows(out, [*(F.col(c).isNull() for c in having("missing_strategy", "drop_row")), *(F.col(f"_out_{c}") for c in removed)])
    placed = ordering.ROW in out.columns
    out = out.drop(*aside.values(), *(f"_out_{c}" for c in removed))
    visible = [c for c in out.columns if c != ordering.ROW]
    if dedupe:
        # an aggregate keeps the first of equal rows, and its parts are joined before they are dealt
        out = out.groupBy(*visible).agg(F.min(ordering.ROW).alias(ordering.ROW)) if placed else out.dropDuplicates()
    if sort and spec.ts in visible:
        # rows without ties of their own, which the recipe may have dropped, keep the place they had
        ties = tuple(c for c in spec.ties if c in visible)
        out = sorted_by_time(out, SeriesSpec(spec.ts, (*ties, ordering.ROW) if placed else ties))
    return out.select(*visible)
