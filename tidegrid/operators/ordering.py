"""Operators that need row order, without putting a long series into one task.

A frame is sorted by ranges of its order keys and stored once, with _row: a number that ascends through the
ranges, whose high bits name the range and a run of at most 2^BLOCK_BITS rows in it (a block). Everything later starts from that table: work
happens in the blocks, and one row per block (and series) carries what crosses them. Blocks don't grow with the table. They are
cut by rows and not by dates: a dense day, rows without a stamp and one long series are cut like anything else. All
columns of one order are handled in one pass, so plans don't grow with their number.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tidegrid.functions.expressions import micros
from tidegrid.sources.scratch import stored
from tidegrid.spec import SeriesSpec

ROW = "_row"
BLOCK_BITS = 20


def ordered(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """df in the order of spec (nulls first), stored, with _row; a frame that has _row is returned as it is."""
    if ROW in df.columns:
        return df
    keys = [*spec.series, *spec.order]
    return stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(ROW, F.monotonically_increasing_id()))


def in_storage_order(df: DataFrame) -> tuple[DataFrame, SeriesSpec]:
    """A frame read from Parquet files with the place of each row, and the order in which it was written."""
    path = F.col("_metadata.file_path")
    part = F.lpad(F.regexp_extract(path, r"part-(\d+)[^/]*$", 1), 20, "0")  # parts are numbered; as text 100000 comes before 99999
    placed = df.select("*", F.concat(part, F.lit(" "), path).alias("_file"), F.col("_metadata.row_index").alias("_place"))
    return placed, SeriesSpec("_file", ("_place",))


def _blocked(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    return df.withColumn("_block", F.struct(*(F.col(c) for c in spec.series), F.shiftright(ROW, BLOCK_BITS).alias("_part")))


def _in_block(backward: bool = False):
    # frames that end at the current row are running ones; those that begin there cost the square of the rows
    return Window.partitionBy("_block").orderBy(F.desc(ROW) if backward else ROW)


def _over_blocks(spec: SeriesSpec, backward: bool = False):
    """The few rows of one series' blocks."""
    part = F.col("_block._part")
    return Window.partitionBy(*(F.col(f"_block.{c}") for c in spec.series)).orderBy(part.desc() if backward else part)


def _done(out: DataFrame, df: DataFrame, *names: str) -> DataFrame:
    """out with df's columns and names; _row only if df had it."""
    return out.select(*(c for c in df.columns if c not in names), *names)


def ordinal(df: DataFrame, spec: SeriesSpec, name: str = "rn") -> DataFrame:
    """df with the row number (from 0) in its series. A frame with _row must hold all rows that were ordered."""
    rows = _blocked(ordered(df, spec), spec)
    sizes = rows.groupBy("_block").agg(F.count("*").alias("_n"), F.min(ROW).alias("_first"))
    offset = sizes.select("_block", (F.sum("_n").over(_over_blocks(spec)) - F.col("_n") - F.col("_first")).alias("_offset"))
    # without series there is a row for each range: rows stay where they are
    return _done(rows.join(offset if spec.series else F.broadcast(offset), "_block").withColumn(name, F.col(ROW) + F.col("_offset")), df, name)


def carried(df: DataFrame, spec: SeriesSpec, forward: Mapping[str, Column] | None = None, backward: Mapping[str, Column] | None = None) -> DataFrame:
    """df with, for each name, the last value that isn't null up to each row (forward), or the first from it on (backward).

    All of them in one pass: one aggregate by block, one window over blocks, one join, one window in blocks.
    """
    forward, backward = dict(forward or {}), dict(backward or {})
    values = forward | backward
    rows = _blocked(ordered(df, spec), spec).withColumns({f"_v_{k}": v for k, v in values.items()})

    def at(k: str) -> Column:
        return F.when(F.col(f"_v_{k}").isNotNull(), F.struct(F.col(ROW), F.col(f"_v_{k}").alias("v")))

    ends = rows.groupBy("_block").agg(*(F.max(at(k)).alias(k) for k in forward), *(F.min(at(k)).alias(k) for k in backward))
    earlier = (Window.unboundedPreceding, -1)
    carry = [F.last(k, True).over(_over_blocks(spec, k in backward).rowsBetween(*earlier))["v"].alias(f"_c_{k}") for k in values]
    ends = ends.select("_block", *carry)
    own = {f"_o_{k}": F.last(f"_v_{k}", True).over(_in_block(k in backward).rowsBetween(Window.unboundedPreceding, 0)) for k in values}
    out = rows.withColumns(own).join(ends, "_block").withColumns({k: F.coalesce(f"_o_{k}", f"_c_{k}") for k in values})
    return _done(out, df, *values)


def lagged(df: DataFrame, value: Column, spec: SeriesSpec, name: str) -> DataFrame:
    """df with the value of the row before, which may stand in an earlier block."""
    rows = _blocked(ordered(df, spec), spec).withColumn("_v", value)
    last = rows.groupBy("_block").agg(F.max(F.struct(F.col(ROW), F.struct("_v").alias("v"))).alias("_end"))
    last = last.select("_block", F.lag("_end").over(_over_blocks(spec))["v"].alias("_carry"))
    own = F.when(F.row_number().over(_in_block()) > 1, F.struct(F.lag("_v").over(_in_block()).alias("_v")))
    return _done(rows.withColumn("_own", own).join(last, "_block").withColumn(name, F.coalesce("_own", "_carry")["_v"]), df, name)


@dataclass(frozen=True)
class Sorted:
    """What is made of a frame's values in ascending order, nulls left out; for frames of few rows, which are sorted as they are."""

    value: Column
    made: Callable[[Column], Column]


def _quartiles(values: Column) -> Column:
    n = F.size(values)

    def at(share: float) -> Column:
        place = F.lit(share) * (n - 1)
        low, high = F.floor(place), F.ceil(place)
        a, b = F.get(values, low.cast("int")), F.get(values, high.cast("int"))
        return F.when(a == b, a).otherwise((high - place) * a + (place - low) * b)

    return F.when(n > 0, F.array(at(0.25), at(0.75)))


def quartiles(value: Column) -> Sorted:
    """For frames: an array of the first and third quartile (linear between neighbours), null without values.

    A percentile would fill and sort a hash map for each row.
    """
    return Sorted(value, _quartiles)


def _framed(rows: DataFrame, made: Mapping[str, Column | Sorted], frame: WindowSpec, keep: Column) -> DataFrame:
    """Rows to be kept, with aggregates over their frames."""
    lists = {k: v for k, v in made.items() if isinstance(v, Sorted)}
    out = rows.withColumns({k: (F.collect_list(v.value) if k in lists else v).over(frame) for k, v in made.items()}).where(keep)
    if lists:  # each a projection of its own: a list is sorted once, however often it is read
        out = out.withColumns({k: F.sort_array(k) for k in lists}).withColumns({k: v.made(F.col(k)) for k, v in lists.items()})
    return out


def rolling(df: DataFrame, spec: SeriesSpec, window: int, size: int = 4096, **made: Column | Sorted) -> DataFrame:
    """df with aggregates over the centred frame of `window` rows: row i covers i - w div 2 to i - w div 2 + w - 1.

    Blocks of `size` ordinals; rows near a border are copied into the neighbour. Frames shrink at the ends.
    """
    half = window // 2
    size = max(size, window)
    rows = ordinal(df, spec, "_rn").withColumn("_home", F.floor(F.col("_rn") / size))
    low, high = F.floor((F.col("_rn") - (window - 1 - half)) / size), F.floor((F.col("_rn") + half) / size)
    spread = rows.withColumn("_b", F.explode(F.sequence(low, high)))
    frame = Window.partitionBy(*spec.series, "_b").orderBy("_rn").rowsBetween(-half, window - 1 - half)
    return _done(_framed(spread, made, frame, F.expr("_b = _home")), df, *made)


def value_counts(df: DataFrame, columns: list[str], spec: SeriesSpec) -> DataFrame:
    """df with _k_{column}: how many values (not nulls) of each column its series has up to the row; one pass for all columns."""
    rows = _blocked(ordered(df, spec), spec)
    held = rows.groupBy("_block").agg(*(F.count(F.col(c)).alias(f"_n_{c}") for c in columns))
    before = held.select("_block", *((F.sum(f"_n_{c}").over(_over_blocks(spec)) - F.col(f"_n_{c}")).alias(f"_p_{c}") for c in columns))
    up = _in_block().rowsBetween(Window.unboundedPreceding, 0)
    own = rows.select("*", *(F.count(F.col(c)).over(up).alias(f"_own_{c}") for c in columns)).join(before, "_block")
    return _done(own.withColumns({f"_k_{c}": F.col(f"_own_{c}") + F.col(f"_p_{c}") for c in columns}), df, *(f"_k_{c}" for c in columns))


def rolling_values(df: DataFrame, columns: list[str], spec: SeriesSpec, window: int, made: Column | Sorted, size: int = 4096) -> DataFrame:
    """series..., col, v, made: for each value of each column an aggregate of v over the centred frame of its column's values, nulls left out.

    Values of all columns travel as cells, so there is one stored order and one pass, however many columns there are.
    """
    half, size = window // 2, max(size, window)
    rows = value_counts(df, columns, spec)
    cells = F.array(*(F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("col"), (F.col(f"_k_{c}") - 1).alias("rn"), F.col(c).cast("double").alias("v"))) for c in columns))
    cells = rows.select(*spec.series, F.explode(cells).alias("x")).where("x IS NOT NULL").select(*spec.series, "x.*")
    low, high = F.floor((F.col("rn") - (window - 1 - half)) / size), F.floor((F.col("rn") + half) / size)
    spread = cells.withColumn("_b", F.explode(F.sequence(low, high)))
    frame = Window.partitionBy(*spec.series, "col", "_b").orderBy("rn").rowsBetween(-half, window - 1 - half)
    return _framed(spread, {"made": made}, frame, F.col("_b") == F.floor(F.col("rn") / size)).select(*spec.series, "col", "v", "made")


def null_runs(df: DataFrame, columns: list[str], spec: SeriesSpec) -> DataFrame:
    """col (and series), max_run: the longest run of nulls of each column, 0 without any; one pass for all columns.

    Nulls with equally many values before them form a run.
    """
    keys = [*spec.series, *spec.order]
    rows = ordered(df.select(*dict.fromkeys([*keys, *columns, *([ROW] if ROW in df.columns else [])])), spec)
    seen = value_counts(rows, columns, spec)
    cells = F.array(*(F.when(F.col(c).isNull(), F.struct(F.lit(c).alias("col"), F.col(f"_k_{c}").alias("run"))) for c in columns))
    runs = seen.select(*spec.series, F.explode(cells).alias("x")).where("x IS NOT NULL").groupBy(*spec.series, "x").agg(F.count("*").alias("len"))
    longest = runs.groupBy(*spec.series, "x.col").agg(F.max("len").alias("max_run"))
    every = (rows.select(*spec.series).distinct() if spec.series else df.sparkSession.range(1)).select(*spec.series, F.explode(F.array(*map(F.lit, columns))).alias("col"))
    same = F.col("e.col") == F.col("l.col")
    for k in spec.series:
        same = same & F.col(f"e.{k}").eqNullSafe(F.col(f"l.{k}"))
    return every.alias("e").join(longest.alias("l"), same, "left").select("e.*", F.coalesce("max_run", F.lit(0)).cast("long").alias("max_run"))


def gaps(df: DataFrame, spec: SeriesSpec, seconds: float) -> DataFrame:
    """gap_count (by series), steps between sorted stamps (equal ones included) longer than seconds."""
    step = lagged(df.where(F.col(spec.ts).isNotNull()), micros(spec.ts), spec, "_before").withColumn("_step", micros(spec.ts) - F.col("_before"))
    return step.groupBy(*spec.series).agg(F.count_if(F.col("_step") > seconds * 1_000_000).alias("gap_count"))
