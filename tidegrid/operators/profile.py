"""Profiles: shape, nulls, types, statistics, frequent values, time grid."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidegrid.functions import formats
from tidegrid.functions.expressions import kurtosis, micros, no_nan, number, pct, skew
from tidegrid.operators.quantiles import quantiles
from tidegrid.sources.scratch import stored
from tidegrid.spec import DEFAULT

STATISTICS = ("min", "max", "mean", "median", "std", "skew", "kurtosis", "q1", "q3", "iqr")
_NESTED = (T.ArrayType, T.MapType, T.StructType)


def sane(df: DataFrame) -> DataFrame:
    """NaN becomes null: both mean missing."""
    return df.select(*(no_nan(f.name).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def flat_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if not isinstance(f.dataType, _NESTED)]


def _by_column(one: DataFrame, columns: list[str], fields: list[str]) -> DataFrame:
    """One wide row of structs -> a row per column; only results are turned, never data."""
    rows = F.array(*(F.struct(F.lit(c).alias("col"), *(F.col(f"`{c}`.{f}").alias(f) for f in fields)) for c in columns))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def _wide(df: DataFrame, columns: list[str], made) -> DataFrame:
    fields = list(made(columns[0]))
    return _by_column(df.agg(*(F.struct(*(v.alias(k) for k, v in made(c).items())).alias(c) for c in columns)), columns, fields)


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).cast("long").alias("cols"))


def source_bytes(df: DataFrame) -> DataFrame:
    """Bytes of the files that a file-based df reads."""
    files = df.select("_metadata.file_path", "_metadata.file_size").distinct()
    return files.agg(F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("bytes"))


def nulls(df: DataFrame) -> DataFrame:
    """col, null_count, null_pct; one scan for all columns."""
    return _wide(sane(df), df.columns, lambda c: {"null_count": F.count("*") - F.count(F.col(c)), "null_pct": F.round(pct(F.count("*") - F.count(F.col(c)), F.count("*")), 6)})


def _texts(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def text_rates(df: DataFrame) -> DataFrame:
    """col, n, num, parsed, format of the text columns: cells, those that are numbers, those that the column's best format reads; one pass.

    A format is one for the whole column (see formats): what reads in several of them isn't added up.
    """
    texts = _texts(df)
    rates = {c: {"n": F.count(F.col(c)), "num": F.count(number(c)), "parsed": formats.counts(c)["parsed"], "format": formats.counts(c)["format"]} for c in texts}
    return _wide(df, texts, rates.__getitem__) if texts else df.sparkSession.createDataFrame([], "col string, n long, num long, parsed long, format string")


def _kind() -> Column:
    """What the cells of a text column are: numbers above DEFAULT.parse, timestamps if one format reads all of them."""
    n = F.col("n")
    return F.when((n > 0) & (F.col("num") > n * DEFAULT.parse), "numeric").when((n > 0) & (F.col("parsed") == n), "datetime").otherwise("categorical")


def dtypes(df: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """col, dtype_raw, dtype_inferred; text by its cells, see text_rates(): rates, if these are there already."""

    def fixed(t: T.DataType) -> str:
        if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return "datetime"
        if isinstance(t, T.BooleanType):
            return "boolean"
        return "numeric" if isinstance(t, T.NumericType) else "nested" if isinstance(t, _NESTED) else "categorical"

    texts = _texts(df)
    others = [(f.name, f.dataType.simpleString(), fixed(f.dataType)) for f in df.schema if f.name not in texts]
    return df.sparkSession.createDataFrame(others, "col string, dtype_raw string, dtype_inferred string").unionByName((text_rates(df) if rates is None else rates).select("col", F.lit("string").alias("dtype_raw"), _kind().alias("dtype_inferred")))


def datetime_columns(kinds: DataFrame) -> DataFrame:
    """kinds (of dtypes()) -> col: those that hold timestamps."""
    return kinds.where("dtype_inferred = 'datetime'").select("col")


def text_issues(df: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """col, issue: text columns typed categorical that mostly hold numbers or dates; rates as in dtypes()."""
    issue = F.when(F.col("num") > F.col("n") * DEFAULT.parse, "numeric_as_string").when(F.col("parsed") > F.col("n") * DEFAULT.parse, "datetime_as_string")
    return (text_rates(df) if rates is None else rates).where(_kind() == "categorical").select("col", issue.alias("issue")).where("issue is not null")


def value_of(df: DataFrame, c: str) -> Column:
    """A column's numbers: text that isn't one, and NaN, count as missing."""
    return number(c) if dict(df.dtypes)[c] == "string" else no_nan(F.col(c).cast("double"))


def statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """col, n and min, max, mean, median, std, skew, kurtosis, q1, q3, iqr; columns without values are left out.

    One aggregate for the moments, and exact quantiles (see quantiles()); text counts as the numbers in it.
    """
    columns = columns or numeric_columns(df)
    values = {c: value_of(df, c) for c in columns}

    def made(c: str) -> dict[str, Column]:
        v = values[c]
        return {"n": F.count(v), "min": F.min(v), "max": F.max(v), "mean": F.avg(v), "std": F.stddev_samp(v), "skew": skew(v), "kurtosis": kurtosis(v)}

    rows = {r.col: r for r in _wide(df, columns, made).collect()}  # a row for each column
    q = quantiles(df, values, (0.25, 0.5, 0.75))
    out = [(c, r.n, r.min, r.max, r.mean, q[c][1], r.std, r.skew, r.kurtosis, q[c][0], q[c][2], q[c][2] - q[c][0]) for c, r in rows.items() if r.n]
    return df.sparkSession.createDataFrame(out, "col string, n long, " + ", ".join(f"{x} double" for x in STATISTICS))


def catalogue(tables: dict[str, DataFrame]) -> DataFrame:
    """table, col, dtype_raw, null_count, null_pct and, of numbers, statistics(): a row for each column of every table.

    Columns that hold arrays, maps or structs have nulls counted only; a table without rows has rows without statistics.
    """
    out = []
    for name, df in tables.items():
        kinds = df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema], "col string, dtype_raw string")
        numbers = numeric_columns(df)
        found = kinds.join(nulls(df), "col")
        if numbers:
            found = found.join(statistics(sane(df), numbers), "col", "left")
        else:
            found = found.withColumns({"n": F.lit(None).cast("long"), **{x: F.lit(None).cast("double") for x in STATISTICS}})
        out.append(found.select(F.lit(name).alias("table"), "col", "dtype_raw", "null_count", "null_pct", "n", *STATISTICS))
    return union_all(out)


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """col, distinct_count: how many different values each column has, nulls left out.

    A value travels as its column's number and 128 bits of hash, once for each task that has it: rows are neither copied whole
    for each column, nor do equal values meet in one task before they are one.
    """
    cells = [F.when(F.col(f"`{c}`").isNotNull(), F.struct(F.lit(i).alias("i"), F.xxhash64(F.lit(1), F.col(f"`{c}`")).alias("a"), F.xxhash64(F.lit(2), F.col(f"`{c}`")).alias("b"))) for i, c in enumerate(columns)]
    seen = df.select(F.explode(F.array(*cells)).alias("x")).where("x IS NOT NULL").select("x.*").distinct().groupBy("i").agg(F.count("*").alias("n"))
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "i int, col string")
    return names.join(seen, "i", "left").select("col", F.coalesce("n", F.lit(0)).alias("distinct_count"))


def cardinality(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    if not approximate:
        return distinct_counts(df, columns)
    return _wide(df, columns, lambda c: {"distinct_count": F.approx_count_distinct(F.col(c))})


def top_values(df: DataFrame, columns: list[str], top: int = DEFAULT.top) -> DataFrame:
    """col, rank, value, freq: null counts as a value; ties by value, null last."""
    parts = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in columns))).alias("r")).select("r.*")
    counted = parts.groupBy("col", "value").agg(F.count("*").alias("freq"))
    order = Window.partitionBy("col").orderBy(F.desc("freq"), F.asc_nulls_last("value"))
    return counted.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier one on all columns, null = null."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def frequency(df: DataFrame, ts: str) -> DataFrame:
    """One row: the grid's name, from the median gap of distinct stamps.

    Gaps are taken within blocks of stamps and stitched between them, so no task sorts all stamps.
    """
    from tidegrid.operators.ordering import lagged
    from tidegrid.spec import SeriesSpec

    stamps = df.select(F.col(ts).cast("timestamp").alias("_t")).where("_t is not null").distinct()
    step = lagged(stamps, micros("_t"), SeriesSpec("_t"), "_b").select((micros("_t") - F.col("_b")).alias("gap"))
    gap = quantiles(stored(step), {"gap": F.col("gap")}, [0.5])["gap"]
    return df.sparkSession.createDataFrame([(grid_name(gap[0] if gap else None),)], "frequency string")


def grid_name(gap: float | None) -> str:
    """The name of a median gap in microseconds; without a gap, unknown. Above 36 hours, whole days count."""
    if gap is None:
        return "unknown"
    hours = gap / 3.6e9
    days = math.floor(hours / 24)
    if hours <= 36:
        return "hourly" if hours <= 1.5 else "daily"
    named = {"weekly": (5, 8), "monthly": (25, 32), "quarterly": (85, 95), "yearly": (360, 370)}
    return next((k for k, (low, high) in named.items() if low <= days <= high), f"every_{days}_days")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
