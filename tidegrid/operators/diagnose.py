"""Diagnosis: missing patterns, outliers, integrity of the time grid, constants, breaks, payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.functions import formats
from tidegrid.functions.expressions import micros, pct
from tidegrid.operators import ordering
from tidegrid.operators.profile import _wide, cardinality, distinct_counts, dtypes, duplicate_rows, frequency, nulls, numeric_columns, sane, statistics, text_issues, text_rates, union_all, value_of
from tidegrid.operators.quantiles import beside, grouped, quantiles
from tidegrid.sources.scratch import stored
from tidegrid.spec import DEFAULT, GAP_SECONDS, SeriesSpec


def missing_pattern(df: DataFrame, columns: str | list[str], spec: SeriesSpec) -> DataFrame:
    """col, n, null_count, max_run, pattern (none, block, trailing or random): all columns in one pass over the order."""
    columns = [columns] if isinstance(columns, str) else columns
    held = dict.fromkeys([*spec.series, *spec.order, *columns, *([ordering.ROW] if ordering.ROW in df.columns else [])])
    rows = ordering.ordered(df.select(*held), spec)
    n = rows.count()
    tail = F.col("rn") >= n - max(1, n // 10)
    counts = _wide(ordering.ordinal(rows, spec), columns, lambda c: {"n": F.count("*"), "null_count": F.count_if(F.col(c).isNull()), "tail_nulls": F.count_if(F.col(c).isNull() & tail), "tail": F.count_if(tail)})
    counts = stored(counts)
    gappy = {r["col"] for r in counts.where("null_count > 0").select("col").collect()}  # a row for each column: the others have no runs
    looked = [c for c in columns if c in gappy or spec.series] or columns[:1]
    both = counts.join(ordering.null_runs(rows, looked, spec), "col", "left").withColumn("max_run", F.coalesce("max_run", F.lit(0).cast("long")))
    pattern = F.when(F.col("null_count") == 0, "none").when(F.col("max_run") > 0.4 * F.col("null_count"), "block").when(F.col("tail_nulls") > 0.5 * F.col("tail"), "trailing").otherwise("random")
    return both.select("col", "n", "null_count", "max_run", pattern.alias("pattern"))


def outliers_global(df: DataFrame, columns: list[str], known: DataFrame | None = None) -> DataFrame:
    """col, iqr_pct, zscore_pct, mad_pct: statistics (known, if they are there already), then the median distance, then one aggregate of counts; 0 without values."""
    stats = {r.col: r for r in (statistics(df, columns) if known is None else known).collect()}  # a row for each column
    values = {c: value_of(df, c) for c in columns}
    mads = quantiles(df, {c: F.abs(values[c] - stats[c].median) for c in stats}, [0.5])

    def made(c: str):
        if c not in stats:
            return {name: F.lit(0.0) for name in ("iqr_pct", "zscore_pct", "mad_pct")}
        v, s, n = values[c], stats[c], F.count(values[c])
        fences = (v < s.q1 - DEFAULT.iqr * s.iqr) | (v > s.q3 + DEFAULT.iqr * s.iqr)
        far = F.abs(v - s.mean) > DEFAULT.z * s.std if s.std else F.lit(False)
        off = F.abs(v - s.median) > DEFAULT.mad * mads[c][0] if mads[c][0] > 0 else F.lit(False)
        return {name: F.round(pct(F.count_if(x), n), 6) for name, x in (("iqr_pct", fences), ("zscore_pct", far), ("mad_pct", off))}

    return _wide(df, columns, made)


def outliers_by_series(df: DataFrame, columns: list[str], series: tuple[str, ...]) -> DataFrame:
    """series..., col, iqr_pct, zscore_pct, mad_pct: outliers_global() for each series by its own statistics, all series at once."""
    values = {c: value_of(df, c) for c in columns}
    rows = df.select(*series, *(v.alias(f"v_{c}") for c, v in values.items()))
    names = {c: F.col(f"v_{c}") for c in columns}
    moments = stored(rows.groupBy(*series).agg(*(F.struct(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std")).alias(f"m_{c}") for c, v in names.items())))
    rows = beside(beside(rows, grouped(rows, series, names, (0.25, 0.5, 0.75)), series), moments, series)
    rows = stored(rows.withColumns({f"d_{c}": F.abs(names[c] - F.col(f"q_{c}")[1]) for c in columns}))
    spread = grouped(rows, series, {f"d_{c}": F.col(f"d_{c}") for c in columns}, (0.5,))
    rows = beside(rows, spread.drop(*(f"n_d_{c}" for c in columns)), series)

    def made(c: str) -> Column:
        v, q, m, mad = names[c], F.col(f"q_{c}"), F.col(f"m_{c}"), F.col(f"q_d_{c}")[0]
        wide = DEFAULT.iqr * (q[2] - q[0])
        share = lambda x: F.round(pct(F.count_if(x), F.count(v)), 6)
        far = (m["std"] > 0) & (F.abs(v - m["mean"]) > DEFAULT.z * m["std"])
        return F.struct(F.lit(c).alias("col"), share((v < q[0] - wide) | (v > q[2] + wide)).alias("iqr_pct"), share(far).alias("zscore_pct"), share((mad > 0) & (F.col(f"d_{c}") > DEFAULT.mad * mad)).alias("mad_pct"))

    return rows.groupBy(*series).agg(F.array(*map(made, columns)).alias("x")).select(*series, F.explode("x").alias("x")).select(*series, "x.*")


def outliers_temporal(df: DataFrame, columns: str | list[str], spec: SeriesSpec, period: int, by_series: bool = False, numbers: dict[str, Column] | None = None) -> DataFrame:
    """col, temporal_pct against centred rolling quartiles of a column's values in time order; null below thirty of them.

    All columns in one pass over one stored order; rows without a stamp come last. With by_series a row for each series too.
    numbers are the columns' values, if these are there already; a frame that has _row is taken in that order.
    """
    columns = [columns] if isinstance(columns, str) else columns
    if not columns:
        return df.sparkSession.createDataFrame([], "col string, temporal_pct double")
    names = {f"v{i}": c for i, c in enumerate(columns)}
    rows = df.select(*spec.series, F.col(spec.ts).isNull().alias("_late"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(spec.order)), *((numbers[c] if numbers else value_of(df, c)).alias(v) for v, c in names.items()), *([ordering.ROW] if ordering.ROW in df.columns else []))
    order = SeriesSpec("_late", tuple(f"_o{i}" for i in range(len(spec.order))), spec.series)
    rolled = ordering.rolling_values(rows, list(names), order, max(period, 7), ordering.quartiles(F.col("v")))
    q1, q3 = F.col("made")[0], F.col("made")[1]
    wide = 1.5 * (q3 - q1)
    share = F.round(F.count_if((F.col("v") < q1 - wide) | (F.col("v") > q3 + wide)) * 100.0 / F.count("*"), 6)
    keys = [*spec.series, "col"] if by_series else ["col"]
    found = rolled.groupBy(*keys).agg(F.when(F.count("*") >= 30, share).alias("temporal_pct"))
    name = F.coalesce(*(F.when(F.col("col") == v, F.lit(c)) for v, c in names.items()))
    found = found.withColumn("col", name)
    if by_series:
        return found
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "col string")
    return every.join(found, "col", "left").select("col", "temporal_pct")


def monotonic(df: DataFrame, ts: str, stored: SeriesSpec) -> DataFrame:
    """One row: is_monotonic, whether stamps never fall in the order of `stored`; missing ones are left out."""
    stamps = df.where(F.col(ts).isNotNull())
    step = ordering.lagged(stamps, micros(ts), stored, "_before")
    return step.agg(F.coalesce(F.bool_and(F.coalesce(micros(ts) >= F.col("_before"), F.lit(True))), F.lit(True)).alias("is_monotonic"))


def integrity(df: DataFrame, spec: SeriesSpec, stored: SeriesSpec) -> DataFrame:
    """One row: frequency, is_monotonic (in the order of `stored`), duplicate_timestamps, gap_count.

    A timestamp stored as text is read by the column's format; if that doesn't read all of it: unknown, null, 0, 0.
    """
    if dict(df.dtypes)[spec.ts] == "string":
        name, read, n = formats.elected(df, [spec.ts])[spec.ts]
        parsed = formats.BY_NAME[name].read(F.col(spec.ts)) if name else F.lit(None).cast("timestamp")
        if read < n:
            return df.sparkSession.createDataFrame([("unknown", None, 0, 0)], "frequency string, is_monotonic boolean, duplicate_timestamps long, gap_count long")
        df = df.withColumn(spec.ts, parsed)
    stamps = df.where(F.col(spec.ts).isNotNull())
    name = frequency(df, spec.ts).first()[0]
    gaps = ordering.gaps(stamps, SeriesSpec(spec.ts, spec.ties), GAP_SECONDS[name] * DEFAULT.gap) if name in GAP_SECONDS else df.sparkSession.createDataFrame([(0,)], "gap_count long")
    repeats = stamps.agg((F.count("*") - F.count_distinct(F.col(spec.ts))).alias("duplicate_timestamps"))
    one = F.struct(F.lit(1))  # three tables of one row each
    parts = [x.withColumn("_one", one) for x in (monotonic(df, spec.ts, stored), repeats, gaps)]
    return parts[0].join(parts[1], "_one").join(parts[2], "_one").select(F.lit(name).alias("frequency"), "is_monotonic", "duplicate_timestamps", "gap_count")


def constants(df: DataFrame, numeric: list[str], texts: list[str]) -> DataFrame:
    """col: texts of one value at most; numbers that hardly vary around their mean."""
    s = statistics(df, numeric)
    still = (F.abs("mean") > 0) & (F.col("std") / F.abs("mean") < DEFAULT.near_constant) | (F.col("mean") == 0) & (F.col("std") < 1e-9)
    return s.where(still).select("col").union(cardinality(df, texts).where("distinct_count <= 1").select("col"))


def column_profile(df: DataFrame) -> DataFrame:
    """col, null_pct, distinct_pct, zero_pct, skew (null for text)."""
    numeric = numeric_columns(df)
    share = _wide(df, df.columns, lambda c: {"n": F.count("*"), "zero_pct": F.round(pct(F.count_if(F.col(c) == 0), F.count("*")), 6) if c in numeric else F.lit(None).cast("double")})
    different = share.join(distinct_counts(sane(df), df.columns), "col").select("col", F.round(pct(F.col("distinct_count"), F.col("n")), 6).alias("distinct_pct"), "zero_pct")
    return nulls(df).join(different, "col").join(statistics(df, numeric).select("col", F.round("skew", 6).alias("skew")), "col", "left").select("col", "null_pct", "distinct_pct", "zero_pct", "skew")


def catalogue_facts(tables: dict[str, DataFrame], specs: dict[str, SeriesSpec], periods: dict[str, int]) -> DataFrame:
    """facts() of every table, with its name in front: what recipes of a whole catalogue are planned from."""
    return union_all([facts(df, specs.get(t), periods.get(t, 7)).select(F.lit(t).alias("table"), "*") for t, df in tables.items()])


def facts(df: DataFrame, spec: SeriesSpec | None, period: int, measures: list[str] | None = None, rates: DataFrame | None = None) -> DataFrame:
    """All that recipes need to know, one row for each column: what profile and diagnosis find, joined by column.

    col, dtype_raw, dtype_inferred, n, null_count, null_pct, max_run, pattern, distinct_pct, zero_pct, skew, iqr, iqr_pct,
    zscore_pct, mad_pct, temporal_pct, any_outlier, issue, constant. Outliers are looked for in measures (all numeric
    columns but the timestamp unless given), temporal ones and runs only with a spec.
    rates are those of profile.text_rates(), if they are there already.
    """
    df = sane(df)
    rates = stored(text_rates(df)) if rates is None else rates
    kinds = dtypes(df, rates)
    inferred = {r.col: r.dtype_inferred for r in kinds.collect()}  # a row for each column, to choose the plan
    numeric = [c for c in (measures or df.columns) if inferred[c] == "numeric"]
    texts = [c for c in df.columns if inferred[c] == "categorical"]
    n = F.count("*")
    # numbers are read from text once, and one order serves all that follows
    read = {c: f"_number{i}" for i, c in enumerate(numeric) if dict(df.dtypes)[c] == "string"}
    rows = df.withColumns({name: value_of(df, c) for c, name in read.items()})
    rows = ordering.ordered(rows, spec) if spec else stored(rows) if read else rows
    number = {c: F.col(read.get(c, c)).cast("double") for c in numeric}
    numbers = rows.select(*(number[c].alias(c) for c in numeric))

    def share(c: str) -> dict[str, Column]:
        zero = F.count_if(number[c] == 0) if c in numeric else F.lit(None).cast("long")
        return {"n": n, "null_count": n - F.count(F.col(c)), "zeros": zero}

    different = stored(distinct_counts(rows, [c for c in df.columns if inferred[c] != "nested"]))
    held = stored(_wide(rows, df.columns, share)).join(different.withColumnRenamed("distinct_count", "distinct"), "col", "left")
    held = held.select("col", "n", "null_count", F.round(pct(F.col("null_count"), F.col("n")), 6).alias("null_pct"), F.round(pct(F.col("distinct"), F.col("n")), 6).alias("distinct_pct"), F.when(F.col("zeros").isNotNull(), F.round(pct(F.col("zeros"), F.col("n")), 6)).alias("zero_pct"))
    stats = statistics(numbers, numeric)
    out = kinds.join(held, "col").join(stats.select("col", F.round("skew", 6).alias("skew"), F.round("iqr", 6).alias("iqr")), "col", "left").join(outliers_global(numbers, numeric, stats), "col", "left")
    still = (F.abs("mean") > 0) & (F.col("std") / F.abs("mean") < DEFAULT.near_constant) | (F.col("mean") == 0) & (F.col("std") < 1e-9)
    same = stats.where(still).select("col").union(different.where(F.col("col").isin(texts) & (F.col("distinct_count") <= 1)).select("col"))
    out = out.join(same.withColumn("constant", F.lit(True)), "col", "left").join(text_issues(df, rates), "col", "left")
    if spec:
        # rows without a stamp are first in this order, temporal outliers take them last: only where there are some a second one is needed
        late = held.where((F.col("col") == spec.ts) & (F.col("null_count") > 0)).take(1)
        local = outliers_temporal(rows.drop(ordering.ROW) if late else rows, [c for c in numeric if c != spec.ts], spec, period, numbers=number)
        out = out.join(missing_pattern(rows, df.columns, spec).select("col", "max_run", "pattern"), "col").join(local, "col", "left")
    else:
        out = out.withColumns({"max_run": F.lit(None).cast("long"), "pattern": F.lit(None).cast("string"), "temporal_pct": F.lit(None).cast("double")})
    found = [F.coalesce(F.col(x) > 0, F.lit(False)) for x in ("iqr_pct", "zscore_pct", "mad_pct", "temporal_pct")]
    return out.select("col", "dtype_raw", "dtype_inferred", "n", "null_count", "null_pct", "max_run", "pattern", "distinct_pct", "zero_pct", "skew", "iqr", "iqr_pct", "zscore_pct", "mad_pct", "temporal_pct", (found[0] | found[1] | found[2] | found[3]).alias("any_outlier"), "issue", F.coalesce("constant", F.lit(False)).alias("constant"))


def grids(df: DataFrame, stamps: list[str]) -> DataFrame:
    """col, frequency, pos: the grid of each of a table's timestamp columns, in their order."""
    if not stamps:
        return df.sparkSession.createDataFrame([], "col string, frequency string, pos int")
    return union_all([frequency(df, c).select(F.lit(c).alias("col"), "frequency", F.lit(i).alias("pos")) for i, c in enumerate(stamps)])


def table_facts(df: DataFrame, stamps: list[str], value: str | None = None, frequencies: DataFrame | None = None) -> DataFrame:
    """One row about a whole table: n_rows, duplicate_rows, frequency (by timestamp column), timestamp_col, duplicate_timestamps, breakpoints.

    Breakpoints are dates at which the daily mean of value shifts; none without a value or a timestamp. frequencies are
    those of grids(), if they are there already.
    """
    spark, known = df.sparkSession, (grids(df, stamps) if frequencies is None else frequencies).collect()  # a row for each timestamp column
    found = {r["col"]: r["frequency"] for r in known}
    ts = pick_timestamp(spark.createDataFrame(known, "col string, frequency string, pos int")).first()[0] if known else None
    n, repeats, moved = df.count(), duplicate_rows(df).first()[0], None
    if ts:
        moved = df.where(F.col(ts).isNotNull()).agg((F.count("*") - F.count_distinct(F.col(ts))).alias("n")).first()[0]
    dates: list[str] = []
    if ts and value:
        daily = df.where(F.col(ts).isNotNull()).groupBy(F.col(ts).cast("date").alias("d")).agg(F.avg(value_of(df, value)).alias("y"))
        dates = sorted(str(r["break_at"]) for r in breaks(daily, "d", "y").select("break_at").collect())
    row = (n, repeats, found, ts, moved, dates)
    return spark.createDataFrame([row], "n_rows long, duplicate_rows long, frequency map<string, string>, timestamp_col string, duplicate_timestamps long, breakpoints array<string>")


def payload(profile: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """profile (of facts()) -> col, kind, json: what a decision needs, aggregates only; columns with nothing to report are left out.

    With table (of table_facts()) one row more, of kind table and without a column.
    """
    parts = [
        ("missing", "null_count > 0", ["null_pct", "max_run", "pattern"]),
        ("outliers", "any_outlier", ["iqr_pct", "zscore_pct", "mad_pct", "temporal_pct"]),
        ("profile", "true", ["dtype_inferred", "n", "null_pct", "distinct_pct", "zero_pct", "skew"]),
        ("issue", "issue is not null", ["issue"]),
        ("constant", "constant", ["constant"]),
    ]
    rows = [profile.where(keep).select("col", F.lit(kind).alias("kind"), F.to_json(F.struct(*names)).alias("json")) for kind, keep, names in parts]
    if table is not None:
        rows.append(table.select(F.lit(None).cast("string").alias("col"), F.lit("table").alias("kind"), F.to_json(F.struct(*table.columns)).alias("json")))
    return union_all(rows)


def finest() -> Column:
    """An aggregate of grids (col, frequency, pos): the column of the finest grid, ties by position."""
    rank = F.coalesce(*(F.when(F.col("frequency") == name, i) for i, name in enumerate(GAP_SECONDS)), F.lit(len(GAP_SECONDS)))
    return F.min_by("col", F.struct(rank.alias("rank"), "pos"))


def pick_timestamp(grids: DataFrame) -> DataFrame:
    """grids (col, frequency, pos) -> the column of the finest grid, ties by position."""
    return grids.agg(finest().alias("timestamp_col"))


def breaks(daily: DataFrame, date: str, value: str, rounds: int | None = None, penalty: str = "bic", series: tuple[str, ...] = ()) -> DataFrame:
    """daily (one row per date and series) -> series, break_at, gain, round: level shifts by least-squares binary segmentation.

    Missing values take the last one before, else 0. Each round splits every segment of every series whose best gain exceeds the
    penalty, until none does (or rounds is reached). Series under DEFAULT.break_rows rows have none. Rows are ordered and stored
    once; sums run within blocks of that order, one row a block carries what is before it, and the best split of a segment is the
    best of its blocks': so a long series is many tasks' work.
    """
    keys, spec = list(series), SeriesSpec("d", (), series)
    y = daily.where(F.col(date).isNotNull()).select(*keys, F.col(date).alias("d"), F.col(value).cast("double").alias("y"))
    y = ordering.carried(ordering.ordered(y, spec), spec, {"_f": F.col("y")}).withColumn("y", F.coalesce("_f", F.lit(0.0)))
    whole = y.groupBy(*keys).agg(F.count("*").alias("_n"), F.var_pop("y").alias("_var"), F.avg("y").alias("_mean"))
    var = F.when(F.col("_var") == 0, 1.0).otherwise(F.col("_var"))
    bar = {"bic": F.log(F.col("_n").cast("double")) * var, "aic": 2 * var}.get(penalty, var)
    whole = stored(whole.where(F.col("_n") >= DEFAULT.break_rows).withColumn("_bar", bar))
    part = F.shiftright(ordering.ROW, 33).alias("_part")
    y = beside(y, whole, keys).where(F.col("_n").isNotNull())
    seg = stored(y.select(*keys, "d", ordering.ROW, part, (F.col("y") - F.col("_mean")).alias("y"), "_bar", F.lit("").alias("seg")))
    found, k = None, 0
    group = [*keys, "seg"]
    earlier, all_ = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*group)
    upto = Window.partitionBy(*group, "_part").orderBy(ordering.ROW).rowsBetween(Window.unboundedPreceding, 0)
    while rounds is None or k < rounds:
        k += 1
        sums = seg.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.sum("y").alias("_s"))
        before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_b{c}")
        sums = stored(sums.select(*group, "_part", before("_n"), before("_s"), F.sum("_n").over(all_).alias("_m"), F.sum("_s").over(all_).alias("_t")))
        at = beside(seg, sums, [*group, "_part"])
        at = at.select(*group, "d", "_bar", "_m", "_t", (F.col("_b_n") + F.count("*").over(upto)).alias("_i"), (F.col("_b_s") + F.sum("y").over(upto)).alias("_u"))
        i, u, m, total = (F.col(c) for c in ("_i", "_u", "_m", "_t"))
        gain = u * u / i + (total - u) * (total - u) / (m - i) - total * total / m
        best = at.where("_i < _m").withColumn("gain", gain).where("gain > _bar").groupBy(*group).agg(F.max_by(F.struct("d", "gain"), F.struct("gain", F.col("d"))).alias("b"))
        best = stored(best.select(*group, F.col("b.d").alias("break_at"), F.col("b.gain").alias("gain")))
        rows = best.select(*keys, "break_at", "gain", F.lit(k).cast("long").alias("round"))
        found = rows if found is None else found.union(rows)
        if not best.take(1):
            break
        # segments that weren't split can't be later
        split = beside(seg, best.drop("gain"), group).where(F.col("break_at").isNotNull())
        seg = stored(split.withColumn("seg", F.concat("seg", F.when(F.col("d") > F.col("break_at"), "r").otherwise("l"))).drop("break_at"))
    return found
