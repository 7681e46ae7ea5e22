"""The validation gate: checks of a table before and after cleaning.

Each table is measured once, by one aggregate or while it is written; only the order of stamps needs a pass of its own.
Whatever a check takes as a table may also be measures that are there already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.expressions import micros
from tidegrid.operators import ordering
from tidegrid.operators.measures import Measures, measured
from tidegrid.spec import DEFAULT, SeriesSpec

Measured = DataFrame | Measures
_SCHEMA = "check string, passed boolean, severity string, detail string"
#: A check's name, whether it passed, how grave a failure is, what it found.
Outcome = tuple[str, bool, str, str]


def _measures(x: Measured, as_of: str | None = None) -> Measures:
    return x if isinstance(x, Measures) else measured(x, as_of)


def row_loss(before: Measures, after: Measures) -> Outcome:
    lost = before.rows - after.rows
    return "row_loss", lost * 100 <= before.rows * DEFAULT.max_row_loss_pct, "blocking", str(lost)


def series_length(after: Measures) -> Outcome:
    return "series_length", after.rows >= DEFAULT.min_rows, "blocking", str(after.rows)


def null_regression(before: Measures, after: Measures, fixed: list[str]) -> Outcome:
    """A column may not have more nulls than it had, but for those whose type was fixed; one that is gone has none."""
    worse = sorted(c for c in before.nulls if c not in fixed and round(after.null_pct(c), 6) - round(before.null_pct(c), 6) > 0.1)
    return "no_null_regression", not worse, "blocking", ",".join(worse)


def variance(before: Measures, after: Measures) -> Outcome:
    flat = sorted(c for c, std in before.std.items() if c in after.std and (std or 0) > 0 and not round(after.std[c] or 0.0, 6))
    return "numeric_variance", not flat, "blocking", ",".join(flat)


def ts_nulls(after: Measures, ts: str) -> Outcome:
    return "timestamp_nulls", not after.nulls[ts], "blocking", str(after.nulls[ts])


def forecastable(after: Measures) -> Outcome:
    n = sum(round(x or 0.0, 6) > 0 for x in after.std.values())
    return "forecastable_columns", n >= 1, "blocking", str(n)


def future(after: Measures, ts: str) -> Outcome:
    """Stamps more than a day beyond the as_of that after was measured with; text holds none."""
    n = after.late.get(ts, 0)
    return "future_timestamps", not n, "warning", str(n)


def seasonal_history(after: Measures, period: int) -> Outcome:
    return "seasonal_history", after.rows >= 2 * period, "warning", str(after.rows)


def checks(spark: SparkSession, *outcomes: Outcome) -> DataFrame:
    """check, passed, severity, detail."""
    return spark.createDataFrame(list(outcomes), _SCHEMA)


def _check(df: DataFrame, name: str, passed: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(name).alias("check"), passed.alias("passed"), F.lit("blocking").alias("severity"), detail.cast("string").alias("detail"))


def monotonic(after: DataFrame, ts: str, stored: SeriesSpec | None = None) -> DataFrame:
    """Stamps never fall in the order of `stored`, by default that of the files that after was read from; a null stamp fails."""
    if stored is None:
        after, stored = ordering.in_storage_order(after)
    step = ordering.lagged(after, F.coalesce(micros(ts), F.lit(2**62)), stored, "_before")
    falls = F.count_if(F.col(ts).isNull() | F.coalesce(micros(ts) < F.col("_before"), F.lit(False)))
    return _check(step.agg(falls.alias("n")), "timestamp_monotonic", F.col("n") == 0, F.col("n"))


def verdict(checks: DataFrame) -> DataFrame:
    warnings = F.array_join(F.sort_array(F.collect_list(F.when(~F.col("passed") & (F.col("severity") == "warning"), F.col("check")))), ",")
    return checks.agg(F.bool_and(F.col("passed") | (F.col("severity") == "warning")).alias("passed"), warnings.alias("warnings"))


def validate(before: Measured, after: DataFrame, fixed: list[str], spec: SeriesSpec, period: int, as_of: str, stored: SeriesSpec | None = None, seen: Measures | None = None) -> DataFrame:
    """All checks as rows check, passed, severity, detail; stored is the order for monotonic(), seen what was observed of after when it was written."""
    a, b = _measures(before), seen or measured(after, as_of)
    outcomes = [row_loss(a, b), series_length(b), null_regression(a, b, fixed), variance(a, b), ts_nulls(b, spec.ts), forecastable(b), future(b, spec.ts), seasonal_history(b, period)]
    return checks(after.sparkSession, *outcomes).unionByName(monotonic(after, spec.ts, stored))
