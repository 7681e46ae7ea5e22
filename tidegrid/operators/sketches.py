"""Profiles that can be added up: sketches of a table's columns, kept as an artifact and merged over runs, days and tables.

Each column has three of bounded size: of its distinct values (HyperLogLog), of its frequent ones, and, of numbers, of
its distribution (KLL). Merging reads sketches only. Counts of rows and nulls are exact; statistics() and its kin stay
the exact way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.operators.profile import flat_columns, numeric_columns, sane
from tidegrid.spec import DEFAULT

#: Registers of distinct values (2 to this power: about 0.8 % standard error), size of a distribution (about 0.4 % of ranks),
#: values tracked as frequent (exact for columns of up to three quarters as many distinct ones).
DISTINCT_BITS, RANKS, TRACKED = 14, 800, 4096
#: Up to so many distinct values, as estimated, all are surely tracked: quantiles come from their counts.
COUNTED = TRACKED // 2


def sketched(df: DataFrame, *keys: str) -> DataFrame:
    """col (behind keys, if rows are to be sketched by group), n, null_count, distinct, frequent, ranks: one pass, one row for each column.

    Values are sketched as text, numbers' distribution as doubles. Nested columns are left out; a table without rows has empty sketches.
    """
    rows = sane(df)
    columns, numeric = [c for c in flat_columns(rows) if c not in keys], set(numeric_columns(rows))

    def made(c: str) -> Column:
        text, number = f"CAST(`{c}` AS STRING)", F.col(f"`{c}`").cast("double")
        return F.struct(
            F.lit(c).alias("col"),
            F.count(F.lit(1)).alias("n"),
            (F.count(F.lit(1)) - F.count(F.col(f"`{c}`"))).alias("null_count"),
            F.hll_sketch_agg(F.expr(text), DISTINCT_BITS).alias("distinct"),
            F.expr(f"approx_top_k_accumulate({text}, {TRACKED}) FILTER (WHERE `{c}` IS NOT NULL)").alias("frequent"),
            (F.kll_sketch_agg_double(number, RANKS) if c in numeric else F.lit(None).cast("binary")).alias("ranks"),
        )

    grouped = rows.groupBy(*keys) if keys else rows
    wide = grouped.agg(*(made(c).alias(f"_s{i}") for i, c in enumerate(columns)))
    return wide.select(*keys, F.explode(F.array(*(F.col(f"_s{i}") for i in range(len(columns))))).alias("_s")).select(*keys, "_s.*")


def merged(sketches: DataFrame, *keys: str) -> DataFrame:
    """Sketches of parts -> of the whole, by column (and keys): as many rows as columns meet, whatever the data."""
    return sketches.groupBy(*keys, "col").agg(
        F.sum("n").alias("n"),
        F.sum("null_count").alias("null_count"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.expr("approx_top_k_combine(frequent)").alias("frequent"),
        F.when(F.count("ranks") > 0, F.kll_merge_agg_double("ranks")).alias("ranks"),
    )


def _counted(share: float) -> Column:
    """The quantile at share (linear between neighbours) of _values: all values of a column in their order, with their counts."""
    at = "aggregate(_values, named_struct('n', 0L, 'v', CAST(NULL AS DOUBLE)), (a, x) -> named_struct('n', a.n + x.c, 'v', IF(a.n <= {k} AND a.n + x.c > {k}, x.v, a.v)), a -> a.v)"
    rank = f"({share!r}D * (n - null_count - 1))"
    low, high = at.format(k=f"floor({rank})"), at.format(k=f"ceil({rank})")
    return F.expr(f"{low} + ({high} - {low}) * ({rank} - floor({rank}))")


def estimated(sketches: DataFrame, shares: Sequence[float] = (0.25, 0.5, 0.75), top: int = DEFAULT.top) -> DataFrame:
    """What sketches tell: keys, col, n, null_count, distinct_count, quantiles (at shares; null but for numbers with values), top_values (value, freq).

    Quantiles of columns with few distinct values (see COUNTED) are exact: a rank that is off by little may be another value there, far from the right one.
    """
    keys = [f.name for f in sketches.schema if f.name not in ("col", "n", "null_count", "distinct", "frequent", "ranks")]
    held = F.col("n") > F.col("null_count")
    sketched = [F.kll_sketch_get_quantile_double("ranks", F.lit(float(p))) for p in shares]
    best = F.expr(f"transform(approx_top_k_estimate(frequent, {int(top)}), x -> named_struct('value', x.item, 'freq', x.count))")
    schema = T.ArrayType(T.StructType([T.StructField("value", T.StringType()), T.StructField("freq", T.LongType())]))
    numbers = held & (F.kll_sketch_get_n_double("ranks") > 0)
    every = F.expr(f"array_sort(transform(approx_top_k_estimate(frequent, {TRACKED}), x -> named_struct('v', CAST(x.item AS DOUBLE), 'c', x.count)))")
    known = sketches.withColumn("_distinct", F.hll_sketch_estimate("distinct")).withColumn("_values", F.when(numbers & (F.col("_distinct") <= COUNTED), every))
    # counts that sum up to the values: nothing was left out
    whole = F.expr("aggregate(_values, 0L, (a, x) -> a + x.c)") == F.col("n") - F.col("null_count")
    at = F.when(F.coalesce(whole, F.lit(False)), F.array(*(_counted(float(p)) for p in shares))).otherwise(F.array(*sketched))
    return known.select(*keys, "col", "n", "null_count", F.col("_distinct").alias("distinct_count"), F.when(F.kll_sketch_get_n_double("ranks") > 0, at).alias("quantiles"), F.when(held, best).otherwise(F.array().cast(schema)).alias("top_values"))
