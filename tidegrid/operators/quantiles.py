"""Exact interpolated quantiles, in memory that doesn't grow with the data."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.sources.scratch import stored

#: Up to so many values a column's quantiles are one exact aggregate; beyond, each is narrowed down first.
EXACT_VALUES = 1 << 20
_ACCURACY = 10_000
#: Up to so many values a group's quantiles are one exact aggregate.
EXACT_IN_GROUP = 1 << 16
#: A table of so many groups is broadcast, a longer one joined by shuffle.
BROADCAST_GROUPS = 1 << 14


def quantiles(df: DataFrame, values: Mapping[str, Column], shares: Sequence[float], exact_values: int = EXACT_VALUES) -> dict[str, list[float] | None]:
    """For each name its value's quantiles at shares (linear between neighbours), None without values.

    A share's rank lies between two bounds that an approximate quantile gives, with how many values are below;
    bounds close in, a pass for all at once, until at most exact_values lie between them. Only bounds and counts
    reach the driver.
    """
    if not values:
        return {}
    names = list(values)
    df = df.select(*(values[n].cast("double").alias(f"v{i}") for i, n in enumerate(names)))
    count = df.agg(*(F.count(c).alias(c) for c in df.columns)).first()
    few = [c for c in df.columns if 0 < count[c] <= exact_values]
    found: dict[str, list[float] | None] = {c: None for c in df.columns}
    if few:
        row = df.agg(*(F.percentile(c, F.array(*map(F.lit, shares))).alias(c) for c in few)).first()
        found |= {c: list(row[c]) for c in few}
    # (column, share) -> bounds, values below them, values within
    open_ = {(c, p): (-math.inf, math.inf, 0, count[c]) for c in df.columns if count[c] > exact_values for p in shares}
    done: dict[tuple[str, float], float] = {}

    def within(c: str, low: float, high: float) -> Column:
        return F.when((F.col(c) >= low) & (F.col(c) <= high), F.col(c))

    while open_:
        keys = list(open_)
        ranges: dict[tuple, list[float]] = {}  # shares between the same bounds are one aggregate's
        for c, p in keys:
            low, high, below, n = open_[c, p]
            at = (p * (count[c] - 1) - below) / max(n - 1, 1)
            margin = 3 / _ACCURACY + 2 / n
            ranges.setdefault((c, low, high), []).extend((max(0.0, at - margin), min(1.0, at + margin)))
        asks = [F.percentile_approx(F.col(c) if low == -math.inf else within(c, low, high), F.array(*map(F.lit, shares_)), F.lit(_ACCURACY)) for (c, low, high), shares_ in ranges.items()]
        given = dict(zip(ranges, df.agg(*(x.alias(f"b{i}") for i, x in enumerate(asks))).first(), strict=True))
        bounds = []
        for c, p in keys:
            pair = given[c, open_[c, p][0], open_[c, p][1]]
            bounds.append((pair.pop(0), pair.pop(0)))
        tally = df.agg(*(F.struct(F.count_if(F.col(c) < bounds[i][0]).alias("below"), F.count(within(c, *bounds[i])).alias("n")).alias(f"t{i}") for i, (c, _) in enumerate(keys))).first()
        last, later = [], {}
        for i, key in enumerate(keys):
            (low, high), (below, n) = bounds[i], tally[i]
            if low == high:
                done[key] = low
            elif n <= exact_values or n >= open_[key][3]:  # ties alone can keep n: their distinct values are few
                last.append((key, low, high, (key[1] * (count[key[0]] - 1) - below) / (n - 1)))
            else:
                later[key] = (low, high, below, n)
        if last:
            row = df.agg(*(F.percentile(within(k[0], low, high), F.lit(min(1.0, max(0.0, at)))).alias(f"q{i}") for i, (k, low, high, at) in enumerate(last))).first()
            done |= {k: row[i] for i, (k, *_) in enumerate(last)}
        open_ = later
    for c in df.columns:
        if count[c] > exact_values:
            found[c] = [done[c, p] for p in shares]
    return {n: found[f"v{i}"] for i, n in enumerate(names)}


def _same(keys: Sequence[str], left: str, right: str) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return on


def beside(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with the columns of its group's row in stats (stored; one row for each group of keys, null being one)."""
    names = [c for c in stats.columns if c not in keys]
    few = F.broadcast(stats) if stats.count() <= BROADCAST_GROUPS else stats
    return df.alias("l").join(few.alias("r"), _same(keys, "l", "r"), "left").select("l.*", *(F.col(f"r.{c}") for c in names))


def grouped(df: DataFrame, keys: Sequence[str], values: Mapping[str, Column], shares: Sequence[float], exact_values: int = EXACT_IN_GROUP) -> DataFrame:
    """A stored row for each group of keys: for each name n_{name}, its values, and q_{name}, their quantiles at shares (null without any).

    Groups of up to exact_values values are aggregated as they are. Larger ones are sorted: equal values become one row with
    their number, ranges of these are numbered through, and the rows at the ranks in question are taken. So no
    group, however large, meets in one task, and all groups and names are handled at once.
    """
    keys, names = list(keys), list(values)
    rows = df.select(*keys, *(values[n].cast("double").alias(f"v{i}") for i, n in enumerate(names)))
    counts = stored(rows.groupBy(*keys).agg(*(F.count(f"v{i}").alias(f"n{i}") for i in range(len(names)))))
    large = F.greatest(*(F.col(f"n{i}") for i in range(len(names))), F.lit(0)) > exact_values
    out = [*keys, *(F.col(f"n{i}").alias(f"n_{n}") for i, n in enumerate(names)), *(F.col(f"q{i}").alias(f"q_{n}") for i, n in enumerate(names))]
    at = F.array(*map(F.lit, shares))
    hot = counts.where(large)
    if not hot.take(1):
        found = rows.groupBy(*keys).agg(*(F.count(f"v{i}").alias(f"n{i}") for i in range(len(names))), *(F.percentile(f"v{i}", at).alias(f"q{i}") for i in range(len(names))))
        return stored(found.select(*out))
    hot = stored(hot)
    few = rows.alias("l").join(hot.select(*keys).alias("r"), _same(keys, "l", "r"), "left_anti").groupBy(*keys)
    few = few.agg(*(F.count(f"v{i}").alias(f"n{i}") for i in range(len(names))), *(F.percentile(f"v{i}", at).alias(f"q{i}") for i in range(len(names))))
    cells = F.array_compact(F.array(*(F.when(F.col(f"v{i}").isNotNull(), F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("v"))) for i in range(len(names)))))
    many = rows.alias("l").join(hot.select(*keys).alias("r"), _same(keys, "l", "r"), "left_semi").select(*keys, F.explode(cells).alias("_x"))
    many = many.groupBy(*keys, F.col("_x.i").alias("_i"), F.col("_x.v").alias("_v")).agg(F.count("*").alias("_c"))
    order = [*keys, "_i", "_v"]
    many = stored(many.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33)))
    group = [*keys, "_i"]
    sums = many.groupBy(*group, "_part").agg(F.sum("_c").alias("_s"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("_s").over(Window.partitionBy(*group))
    sums = stored(sums.select(*group, "_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"), total.alias("_n")))
    here = Window.partitionBy(*group, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    ranked = beside(many, sums, [*group, "_part"]).withColumn("_first", F.col("_base") + F.coalesce(F.sum("_c").over(here), F.lit(0)))

    def value(rank: Column) -> Column:
        return F.max(F.when((F.col("_first") <= rank) & (rank < F.col("_first") + F.col("_c")), F.col("_v")))

    picks = []
    for p in shares:
        rank = F.lit(float(p)) * (F.col("_n") - 1)
        low = F.floor(rank)
        picks.append(F.struct(value(low).alias("a"), value(F.ceil(rank)).alias("b"), F.max(rank - low).alias("part")))
    picked = ranked.groupBy(*group).agg(F.max("_n").alias("_m"), F.array(*picks).alias("_q"))
    picked = picked.select(*group, "_m", F.transform("_q", lambda x: x["a"] + (x["b"] - x["a"]) * x["part"]).alias("_q"))
    own = lambda i, c: F.first(F.when(F.col("_i") == i, F.col(c)), True)
    wide = picked.groupBy(*keys).agg(*(F.coalesce(own(i, "_m"), F.lit(0)).alias(f"n{i}") for i in range(len(names))), *(own(i, "_q").alias(f"q{i}") for i in range(len(names))))
    return stored(few.select(*out).unionByName(wide.select(*out)))
