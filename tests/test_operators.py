"""Ordered operators against pandas written afresh, profile edges, recipe and reader guards."""

import datetime as dt
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidegrid.functions import expressions as ex
from tidegrid.functions import formats
from tidegrid.operators import clean, diagnose, gate, measures, ordering, profile, recipe, sketches
from tidegrid.operators.quantiles import grouped, quantiles
from tidegrid.sources import readers, runs
from tidegrid.spec import SeriesSpec

SPEC = SeriesSpec("ts", ("id",))
PANEL = SeriesSpec("ts", ("id",), ("s",))


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(2)
    rows, at = [], dt.datetime(2024, 1, 1)
    for i in range(300):
        at += dt.timedelta(minutes=rng.choice([0, 30, 60, 900]))
        rows.append((i, at, i % 3, None if i < 2 or 40 <= i < 90 or rng.random() < 0.2 else float(rng.randint(0, 50))))
    return spark.createDataFrame(rows, "id long, ts timestamp, s int, v double").repartition(5), pd.DataFrame(rows, columns=["id", "ts", "s", "v"])


def result(df, column="v"):
    return df.select("id", column).toPandas().sort_values("id")[column].to_numpy(dtype=float)


@pytest.mark.parametrize("way", ["forward", "backward", "both"])
def test_fill(series, way):
    df, p = series
    expected = {"forward": p.v.ffill(), "backward": p.v.bfill(), "both": p.v.ffill().bfill()}[way]
    np.testing.assert_array_equal(result(clean.fill(df, "v", SPEC, way)), expected)
    panel = {"forward": p.groupby("s").v.ffill(), "backward": p.groupby("s").v.bfill(), "both": p.groupby("s").v.transform(lambda v: v.ffill().bfill())}[way]
    np.testing.assert_array_equal(result(clean.fill(df, "v", PANEL, way)), panel)


def test_interpolation(series):
    df, p = series
    np.testing.assert_allclose(result(clean.interpolate(df, "v", SPEC, by_time=False)), p.v.interpolate())


@pytest.mark.parametrize("window", [7, 12, 24])
@pytest.mark.parametrize("size", [25, 4096])
def test_rolling_does_not_depend_on_blocks(series, window, size):
    df, p = series
    half = window // 2
    expected = [p.v[max(0, i - half) : i - half + window].quantile(0.25) for i in range(len(p))]
    np.testing.assert_allclose(result(ordering.rolling(df, SPEC, window, size, q=F.percentile("v", 0.25)), "q"), expected)


def test_runs_lags_and_gaps(series):
    df, p = series
    runs = p.v.isna().astype(int).groupby(p.v.notna().cumsum()).sum()
    found = {r.col: r.max_run for r in ordering.null_runs(df, ["v", "s"], SPEC).collect()}
    assert found == {"v": runs.max(), "s": 0}
    panel = {r.s: r.max_run for r in ordering.null_runs(df, ["v"], PANEL).collect()}
    assert panel == {s: g.v.isna().astype(int).groupby(g.v.notna().cumsum()).sum().max() for s, g in p.groupby("s")}
    np.testing.assert_array_equal(result(ordering.lagged(df, F.col("v"), SPEC, "l"), "l"), p.v.shift())
    assert ordering.gaps(df, SPEC, 3600).first()[0] == (p.ts.diff() > pd.Timedelta(hours=1)).sum()


@pytest.mark.parametrize("n", range(5))
def test_statistics_of_few_values(spark, n):
    df = spark.createDataFrame([(float(i * i),) for i in range(n)], "x double")
    found, p = profile.statistics(df).collect(), pd.Series([float(i * i) for i in range(n)])
    assert len(found) == (n > 0)
    for r in found:
        for name, value in (("std", p.std()), ("skew", p.skew()), ("kurtosis", p.kurt())):
            assert r[name] is None if pd.isna(value) else r[name] == pytest.approx(value)


def test_numbers_in_text(spark):
    texts = [" 1 ", "1e3", "inf", "nan", "0x10", "1_000", "True", "", "1d", "1f", "1L", "1.", "+5"]
    found = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(ex.number("t")).collect()]
    assert found == [1, 1000, float("inf"), None, None, None, None, None, None, None, None, 1, 5]


def test_clip_keeps_nulls(spark):
    df = spark.createDataFrame([(None,), (1.0,), (float("inf"),)], "x double")
    assert [r[0] for r in df.select(ex.clip(F.col("x"), F.lit(2.0), F.lit(3.0))).collect()] == [None, 2.0, 3.0]


def test_quantiles_by_bounds(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=20_000), np.where(rng.random(20_000) < 0.6, 0.0, rng.integers(0, 50, 20_000))
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b}))
    values = {"a": F.col("a"), "b": F.col("b"), "none": F.lit(None).cast("double")}
    shares = [0.0, 0.015, 0.25, 0.5, 0.75, 0.999, 1.0]
    for most in (1 << 20, 200):
        found = quantiles(df, values, shares, most)
        assert found["none"] is None
        np.testing.assert_allclose(found["a"], np.quantile(a, shares))
        np.testing.assert_allclose(found["b"], np.quantile(b, shares))


def test_plan_does_not_grow_with_columns(spark):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), *(None if (i + k) % 3 else float(i) for k in range(8))) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, " + ", ".join(f"v{k} double" for k in range(8)))

    def scans(n):
        steps = spark.createDataFrame([(f"v{k}", "interpolate", "keep", "none", "keep") for k in range(n)], recipe_schema)
        out = clean.apply_recipe(df, steps, SPEC, 24)
        return out._jdf.queryExecution().sparkPlan().toString().count("FileScan")

    recipe_schema = "col string, missing_strategy string, outlier_strategy string, type_fix string, action string"
    began = time.time()
    assert scans(1) == scans(8) and time.time() - began < 60


def test_rows_without_stamp_stay(spark):
    rows = [(i, None if i % 4 == 0 else dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), None if i in (5, 6) else float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, v double")
    steps = spark.createDataFrame([("v", "interpolate", "keep", "none", "keep")], "col string, missing_strategy string, outlier_strategy string, type_fix string, action string")
    out = clean.apply_recipe(df, steps, SPEC, 24).collect()
    assert [r.id for r in out] == [1, 2, 3, 5, 6, 7, 9, 10, 11, 0, 4, 8]
    assert {r.id: r.v for r in out}[5] == 3 + 4 / 3  # by place: 3, 5, 6, 7


def test_order_of_files(spark, tmp_path):
    stamps = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=h) for h in (0, 1, 1, 5)]
    for name, order in (("up", stamps), ("down", stamps[::-1])):
        spark.createDataFrame([(t,) for t in order], "ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/{name}")
        assert gate.monotonic(spark.read.parquet(f"{tmp_path}/{name}"), "ts").first().passed == (name == "up")


def test_few_or_odd_values_in_text(spark):
    df = spark.createDataFrame([(i, dt.datetime(2024, 1, 1, i), "n/a" if i == 3 else str(i)) for i in range(20)], "id long, ts timestamp, x string")
    assert profile.statistics(df, ["x"]).first().n == 19
    assert diagnose.outliers_global(df, ["x"]).first().iqr_pct == 0
    assert diagnose.outliers_temporal(df, ["x"], SPEC, 24).first().temporal_pct is None


def test_grid_names():
    day = 86_400_000_000
    assert [profile.grid_name(x) for x in (None, day / 24, day, 8.5 * day, 9 * day, 31 * day, 91 * day, 365 * day)] == ["unknown", "hourly", "daily", "weekly", "every_9_days", "monthly", "quarterly", "yearly"]


def test_breaks_of_series(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(120)]
    rows = [("a", d, float(i >= 60) * 50 + i % 3) for i, d in enumerate(days)] + [("b", d, None if i < 3 else 7.0) for i, d in enumerate(days)] + [("c", d, float(i) * 9) for i, d in enumerate(days[:40])]
    found = diagnose.breaks(spark.createDataFrame(rows, "s string, d date, y double"), "d", "y", series=("s",)).collect()
    assert [(r.s, r.break_at) for r in found if r.s == "a"] == [("a", days[59])] and not [r for r in found if r.s == "c"]


RECIPE = "col string, missing_strategy string, outlier_strategy string, type_fix string, action string"


def test_breaks_do_not_depend_on_blocks(spark):
    """One series over many blocks, against plain binary segmentation."""
    rng = np.random.default_rng(4)
    y = np.concatenate([rng.normal(m, 1, n) for m, n in ((0, 150), (6, 90), (5.9, 60), (-4, 200), (2, 40))])
    y[5] = np.nan
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(len(y))]
    df = spark.createDataFrame([(d, None if np.isnan(v) else float(v)) for d, v in zip(days, y, strict=True)], "d date, y double").repartition(3)
    x = pd.Series(y).ffill().to_numpy()
    x, bar, expected, todo = x - x.mean(), np.log(len(x)) * x.var(), set(), [(0, len(x))]
    while todo:
        a, b = todo.pop()
        s, n = np.cumsum(x[a:b]), b - a
        i = np.arange(1, n)
        gain = s[:-1] ** 2 / i + (s[-1] - s[:-1]) ** 2 / (n - i) - s[-1] ** 2 / n
        if n > 1 and gain.max() > bar:
            at = a + int(gain.argmax())
            expected.add(days[at])
            todo += [(a, at + 1), (at + 1, b)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert {r.break_at for r in diagnose.breaks(df, "d", "y").collect()} == expected and len(expected) >= 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_runs_replace_themselves(spark, tmp_path):
    root = str(tmp_path)
    for run in ("run_1", "run_2", "run_1"):  # the first one is written again
        assert runs.write_raw(spark.range(5), root, run, f"of {run}").rows == 5
    assert spark.read.parquet(f"{root}/raw").count() == 10
    runs.write_artifact(spark.range(3), root, "recipe", "run_2")
    (tmp_path / "metadata" / "run_id=run_3").mkdir()  # broke off
    (tmp_path / "metadata" / "run_id=run_4").mkdir()
    (tmp_path / "metadata" / "run_id=run_4" / "part-0.parquet").write_bytes(b"not a file of this kind")
    (tmp_path / "metadata" / "run_id=run_4" / "_SUCCESS").touch()
    found = runs.run_listing(spark, root).collect()
    assert [tuple(r) for r in found] == [("run_2", 5, 1, "of run_2", False, True), ("run_1", 5, 1, "of run_1", False, False)]
    summary = {r.run_id: r for r in runs.run_summary(spark, root).collect()}
    assert len(summary["run_2"].recipe) == 3 and summary["run_1"].recipe is None and summary["run_1"].gate is None
    with pytest.raises(ValueError):
        runs.write_artifact(spark.range(1), root, "raw", "../x")


def test_cleaned_run_is_measured_as_written(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=(7 * i) % 50), None if i % 5 == 0 else float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, v double").repartition(6)
    seen = runs.write_cleaned(df, str(tmp_path), "run_1", "ts", ["id"], partitions=5, as_of="2024-01-01 00:00:00")
    files = spark.read.parquet(f"{tmp_path}/cleaned")
    read = measures.measured(files.drop("run_id"), "2024-01-01 00:00:00")
    assert (seen.rows, seen.nulls, seen.late) == (read.rows, read.nulls, read.late) == (50, {"id": 0, "ts": 0, "v": 10}, {"ts": 25})
    assert seen.std == pytest.approx(read.std)
    assert runs.out_of_order(files, "ts").first().falls == 0
    runs.write_artifact(df.coalesce(1), str(tmp_path), "shuffled", "run_1")
    assert runs.out_of_order(spark.read.parquet(f"{tmp_path}/shuffled"), "ts").first().falls > 0


def test_parts_are_ordered_by_number(spark, tmp_path):
    for name, hour in (("part-99999-a.parquet", 1), ("part-100000-a.parquet", 2)):
        pd.DataFrame({"ts": [dt.datetime(2024, 1, 1, hour)]}).astype("datetime64[us]").to_parquet(tmp_path / name)
    assert gate.monotonic(spark.read.parquet(str(tmp_path)), "ts").first().passed


STAMPS = {
    "2024-03-01T10:20:30": (10, 20, 30, 0),
    "2024-03-01 10:20:30.25": (10, 20, 30, 250_000),
    "2024-03-01T10:20:30.123456789Z": (10, 20, 30, 123_456),
    "2024-03-01T10:20:30+02:00": (8, 20, 30, 0),
    "2024-03-01T10:20:30-0130": (11, 50, 30, 0),
    "2024-03-01 10:20:30+02": (8, 20, 30, 0),
    "2024-03-01 10:20": (10, 20, 0, 0),
    " 2024-03-01 ": (0, 0, 0, 0),
}


def test_iso_stamps(spark):
    df = spark.createDataFrame([(t,) for t in STAMPS], "t string")
    assert formats.elected(df, ["t"]) == {"t": ("iso", len(STAMPS), len(STAMPS))}
    found = [r[0] for r in df.select(formats.timestamps(df, ["t"])["t"]).collect()]
    assert found == [dt.datetime(2024, 3, 1, *x) for x in STAMPS.values()]
    for bad in ("2024-13-01", "10:20", "2024", "20240301", "x2024-03-01", ""):
        assert spark.createDataFrame([(bad,)], "t string").select(formats.BY_NAME["iso"].read(F.col("t"))).first()[0] is None


def test_one_format_for_a_column(spark):
    rows = [("01/02/2024", "01/02/2024", "1.2.2024 5:07", None), ("03/04/2024", "25/02/2024", "31.12.2024 23:59:58", None), ("12/31/2024", "02/03/2024", "30.2.2024", None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "us string, eu string, dots string, none string")
    assert formats.elected(df, df.columns) == {"us": ("MM/dd/yyyy", 3, 3), "eu": ("dd/MM/yyyy", 3, 3), "dots": ("dd.MM.yyyy", 2, 3), "none": (None, 0, 0)}
    t = formats.timestamps(df, df.columns)
    found = df.select(*(t[c].alias(c) for c in df.columns)).collect()
    assert [r.us for r in found] == [dt.datetime(2024, 1, 2), dt.datetime(2024, 3, 4), dt.datetime(2024, 12, 31), None]
    assert [r.eu for r in found] == [dt.datetime(2024, 2, 1), dt.datetime(2024, 2, 25), dt.datetime(2024, 3, 2), None]
    assert [r.dots for r in found] == [dt.datetime(2024, 2, 1, 5, 7), dt.datetime(2024, 12, 31, 23, 59, 58), None, None] and {r.none for r in found} == {None}
    assert {r.col: r.dtype_inferred for r in profile.dtypes(df).collect()} == {"us": "datetime", "eu": "datetime", "dots": "categorical", "none": "categorical"}


def test_iso_text_loses_no_row(spark):
    df = spark.createDataFrame([(i, t, float(i)) for i, t in enumerate(STAMPS)], "id long, ts string, v double")
    steps = spark.createDataFrame([("v", "interpolate", "keep", "none", "keep")], RECIPE)
    out = clean.apply_recipe(df, steps, SeriesSpec("ts", ("id",)), 24).collect()
    assert len(out) == len(STAMPS) and [r.ts for r in out] == sorted(r.ts for r in out)


def test_dropped_columns_are_gone_for_later_steps(spark):
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, at, "a", 1.0) for i in range(3)] + [(None, at, "a", 1.0), (9, at, "b", None), (10, None, "b", 2.0)], "id long, ts timestamp, s string, v double")
    drop_id = [("id", "drop_row", "keep", "none", "drop")]
    out = clean.apply_recipe(df, spark.createDataFrame(drop_id, RECIPE), SPEC, 24)
    assert out.columns == ["ts", "s", "v"] and [tuple(r) for r in out.collect()] == [(at, "a", 1.0), (at, "b", None), (None, "b", 2.0)]
    no_time = [*drop_id, ("ts", "drop_row", "keep", "none", "drop"), ("v", "forward_fill", "keep", "none", "keep")]
    out = clean.apply_recipe(df, spark.createDataFrame(no_time, RECIPE), SPEC, 24, dedupe=False)
    assert out.columns == ["s", "v"] and out.where("v is null").count() == 0 and out.count() == 6
    no_series = [("s", "none", "keep", "none", "drop"), ("v", "mean_fill", "keep", "none", "keep")]
    out = clean.apply_recipe(df, spark.createDataFrame(no_series, RECIPE), SeriesSpec("ts", ("id",), ("s",)), 24, dedupe=False)
    assert out.columns == ["id", "ts", "v"] and {r.id: r.v for r in out.collect()}[9] == 2.0  # the mean of its own series


def test_recipe_without_order_isn_t_sorted_and_stored(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "1", None), (2, dt.datetime(2024, 1, 2), "x", 3.0)], "id long, ts timestamp, t string, v double")
    steps = spark.createDataFrame([("t", "none", "keep", "cast_numeric", "keep"), ("v", "mean_fill", "keep", "none", "keep")], RECIPE)
    out = clean.apply_recipe(df, steps, SPEC, 24)
    assert "FileScan" not in out._jdf.queryExecution().sparkPlan().toString()
    assert [tuple(r)[2:] for r in out.collect()] == [(1.0, 3.0), (None, 3.0)]


@pytest.fixture(scope="module")
def panel(spark):
    rng, rows = random.Random(8), []
    for s, n in (("a", 300), ("b", 120), (None, 40), ("d", 9), ("e", 3)):
        for i in range(n):
            value = None if s == "e" or rng.random() < 0.15 else (rng.gauss(0, 1) + 3 * (i % 6)) * {"a": 1, "b": 50}.get(s, 7) + (400 if rng.random() < 0.03 else 0)
            rows.append((len(rows), s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), value))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id long, s string, ts timestamp, v double").repartition(5)


PANEL_STEPS = {
    "winsorize": lambda d, spec: clean.winsorize(d, "v", series=spec.series),
    "clip": lambda d, spec: clean.clip_iqr(d, "v", series=spec.series),
    "remove": lambda d, spec: clean.without_outliers(d, "v", series=spec.series),
    "mean": lambda d, spec: clean.fill_with(d, "mean", "v", series=spec.series),
    "median": lambda d, spec: clean.fill_with(d, "median", "v", series=spec.series),
    "rolling": lambda d, spec: clean.rolling_iqr(d, "v", spec, 24),
    "seasonal": lambda d, spec: clean.seasonal_repair(d, "v", spec, 6),
    "by length": lambda d, spec: clean.stl_residuals(d, "v", spec, 24),
}


@pytest.mark.parametrize("step", PANEL_STEPS)
def test_panel_is_its_series_one_by_one(spark, panel, step):
    found = {r.id: r.v for r in PANEL_STEPS[step](panel, PANEL).select("id", "v").collect()}
    for s in ("a", "b", None, "d", "e"):
        one = panel.where(F.col("s").eqNullSafe(F.lit(s)))
        for r in PANEL_STEPS[step](one, SPEC).select("id", "v").collect():
            assert found.pop(r.id) == (r.v if r.v is None else pytest.approx(r.v))
    assert not found


def test_panel_outliers_are_those_of_each_series(spark, panel):
    found = {r.s: r for r in diagnose.outliers_by_series(panel, ["v"], ("s",)).collect()}
    late = {r.s: r.temporal_pct for r in diagnose.outliers_temporal(panel, ["v"], PANEL, 24, by_series=True).collect()}
    assert set(found) == {"a", "b", None, "d", "e"} and late["a"] > 0 and late["d"] is None
    for s, r in found.items():
        one = panel.where(F.col("s").eqNullSafe(F.lit(s)))
        own = diagnose.outliers_global(one, ["v"]).first()
        assert (r.iqr_pct, r.zscore_pct, r.mad_pct) == (own.iqr_pct, own.zscore_pct, own.mad_pct)
        assert late.get(s) == diagnose.outliers_temporal(one, ["v"], SPEC, 24).first().temporal_pct


def test_grouped_quantiles_in_bounded_memory(spark, panel):
    values = {"v": F.col("v"), "even": F.when(F.col("id") % 2 == 0, F.lit(5.0)), "none": F.lit(None).cast("double")}
    shares = [0.0, 0.1, 0.5, 0.999, 1.0]
    key = lambda r: str(r.s)
    plain, cut = (sorted(grouped(panel, ["s"], values, shares, most).collect(), key=key) for most in (1 << 16, 20))
    p = panel.toPandas()
    for a, b in zip(plain, cut, strict=True):
        x = p[p.s.isna() if a.s is None else p.s == a.s].v.dropna()
        assert (a.n_v, a.n_even, a.n_none, a.q_none) == (b.n_v, b.n_even, b.n_none, b.q_none) and a.n_v == len(x) and a.q_none is None
        for q in (a.q_v, b.q_v):
            assert (q is None) == (not len(x)) and (q is None or q == pytest.approx(list(np.quantile(x, shares))))
        assert a.q_even == b.q_even


def test_runs_of_a_series_without_a_name(spark, panel):
    found = {r.s: r.max_run for r in ordering.null_runs(panel, ["v"], PANEL).collect()}
    p = panel.toPandas().sort_values(["ts", "id"])
    for s, longest in found.items():
        v = p[p.s.isna() if s is None else p.s == s].v
        assert longest == v.isna().astype(int).groupby(v.notna().cumsum()).sum().max() and (s is not None or longest > 0)


def test_recipes_of_a_catalogue_are_those_of_its_tables(spark):
    fields = "col string, dtype_raw string, dtype_inferred string, n long, null_pct double, distinct_pct double, zero_pct double, skew double, iqr double, iqr_pct double, temporal_pct double, any_outlier boolean, issue string, constant boolean"
    rows = [("ts", "timestamp", "datetime", 900, 0.0, 99.5, None, None, None, None, None, False, None, False), ("v", "double", "numeric", 900, 3.0, 50.0, 1.0, 0.2, 4.0, 8.0, 1.0, True, None, False), ("t", "string", "categorical", 900, 0.5, 10.0, None, None, None, None, None, False, "numeric_as_string", False), ("k", "string", "categorical", 900, 0.0, 0.1, None, None, None, None, None, False, None, True)]
    one = spark.createDataFrame(rows, fields)
    options = spark.createDataFrame([("a", "ts", 24), ("b", None, 7), ("c", "ts", 1000)], "table string, timestamp_col string, period long")
    every = one.crossJoin(options.select("table"))
    choices = ["col", "missing_strategy", "outlier_strategy", "type_fix", "action"]
    for rules, made in (("default", recipe.default_recipe), ("evidence", recipe.evidence_recipe)):
        found = recipe.planned(every, options, rules)
        for t, ts, period in (("a", "ts", 24), ("b", None, 7), ("c", "ts", 1000)):
            alone = recipe.sanitized(recipe.forced_type_fix(made(one, ts, period), one), one, ts)
            assert sorted(map(tuple, found.where(F.col("table") == t).select(choices).collect())) == sorted(map(tuple, alone.select(choices).collect()))
    given = spark.createDataFrame([("a", "v", "keep", "none", "none", "drop")], "table string, " + RECIPE)
    found = {(r.table, r.col): tuple(r)[2:] for r in recipe.planned(every, options, given=given).collect()}
    assert len(found) == 12 and found["a", "v"] == ("none", "keep", "none", "keep") and found["b", "t"][2] == "cast_numeric"


def test_options_of_every_table(spark):
    grids = spark.createDataFrame([("a", "day", "daily", 0), ("a", "hour", "hourly", 1), ("b", "x", "weekly", 0), ("b", "y", "weekly", 1)], "table string, col string, frequency string, pos int")
    tables = spark.createDataFrame([("a", 0, None), ("b", 2, "y"), ("c", None, ""), ("d", 0, "mine")], "table string, duplicates long, user_timestamp string")
    found = {r.table: tuple(r)[1:] for r in recipe.catalogue_options(grids, tables).collect()}
    assert found == {"a": ("hour", "hourly", 24, True, False), "b": ("y", "weekly", 52, True, True), "c": (None, "unknown", 7, False, False), "d": ("mine", "unknown", 7, True, False)}


def test_distinct_counts(spark):
    df = spark.createDataFrame([(1, "a", 0.0, None), (1, "b", -0.0, None), (2, None, 1.5, None)], "i int, s string, d double, n string")
    assert {r.col: r.distinct_count for r in profile.distinct_counts(df, df.columns).collect()} == {"i": 2, "s": 2, "d": 2, "n": 0}


def test_temporal_outliers_need_one_stored_order(spark, monkeypatch):
    rows = [(i, None if i % 40 == 0 else dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), None if i % 3 else float(i % 7), 1000.0 if i == 77 else float(i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, a double, b double").repartition(3)
    made, real = [], ordering.stored
    monkeypatch.setattr(ordering, "stored", lambda d: made.append(1) or real(d))
    found = {r.col: r.temporal_pct for r in diagnose.outliers_temporal(df, ["a", "b"], SPEC, 24).collect()}
    assert len(made) == 1
    p = pd.DataFrame(rows, columns=["id", "ts", "a", "b"]).sort_values(["ts", "id"], na_position="last")
    for c in "ab":
        x = p[c].dropna().reset_index(drop=True)
        q1, q3 = ([x[max(0, i - 12) : i + 12].quantile(q) for i in range(len(x))] for q in (0.25, 0.75))
        wide = 1.5 * (np.array(q3) - np.array(q1))
        assert found[c] == pytest.approx(((x < q1 - wide) | (x > q3 + wide)).mean() * 100, abs=1e-5)


@pytest.mark.parametrize("late", [False, True])
def test_facts_read_and_order_a_table_once(spark, monkeypatch, late):
    """As the operators find them one by one, with text read and rows sorted once (twice where rows lack a stamp)."""
    rng = random.Random(8)
    rows = [(i, None if late and i % 9 == 0 else dt.datetime(2024, 1, 1) + dt.timedelta(hours=i // 2), None if 20 <= i < 50 else rng.gauss(0, 1) * (50 if i % 31 == 0 else 1), str(i * i) if i % 9 else "n/a", rng.choice("ab")) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, v double, t string, k string").repartition(5)
    known = {
        "text": {r.col: r.dtype_inferred for r in profile.dtypes(df).collect()},
        "runs": {r.col: (r.max_run, r.pattern) for r in diagnose.missing_pattern(df, df.columns, SPEC).collect()},
        "far": {r.col: r.temporal_pct for r in diagnose.outliers_temporal(df, ["id", "v", "t"], SPEC, 24).collect()},
        "off": {r.col: (r.iqr_pct, r.zscore_pct, r.mad_pct) for r in diagnose.outliers_global(df, ["id", "v", "t"]).collect()},
    }
    calls = []
    for module, name in ((profile, "text_rates"), (diagnose, "text_rates"), (diagnose, "statistics")):
        if hasattr(module, name):
            monkeypatch.setattr(module, name, lambda *a, was=getattr(module, name), n=name: calls.append(n) or was(*a))
    monkeypatch.setattr(ordering, "stored", lambda x, was=ordering.stored: calls.append("order") or was(x))
    found = {r.col: r for r in diagnose.facts(df, SPEC, 24).collect()}
    assert sorted(calls) == ["order"] * (1 + late) + ["statistics", "text_rates"]
    assert {c: r.dtype_inferred for c, r in found.items()} == known["text"] and {c: (r.max_run, r.pattern) for c, r in found.items()} == known["runs"]
    assert {c: found[c].temporal_pct for c in known["far"]} == known["far"] and {c: (found[c].iqr_pct, found[c].zscore_pct, found[c].mad_pct) for c in known["off"]} == known["off"]


def test_seasons_are_brought_to_the_rows(spark, monkeypatch):
    """Dealt by phase, all rows would meet in as many tasks as a season has steps; blocks don't depend on the result."""
    df = spark.range(500).select("id", F.expr("timestamp '2024-01-01' + id * interval 1 hour").alias("ts"), (F.col("id") % 7 + F.when(F.col("id") % 50 == 3, 90.0).otherwise(0.1 * (F.col("id") % 5))).alias("v")).repartition(3)
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    seen = []
    monkeypatch.setattr(clean, "stored", lambda x, was=clean.stored: seen.append(plan(x)) or was(x))
    once = result(clean.seasonal_repair(df, "v", SPEC, 7))
    joined = [x for x in seen if "_s_v" in x and "Join" in x]
    assert joined and all("strategy=broadcast" in x for x in joined)
    monkeypatch.setattr(ordering, "BLOCK_BITS", 4)
    np.testing.assert_allclose(result(clean.seasonal_repair(df, "v", SPEC, 7)), once)
    assert (once < 40).all()  # spikes of 90 are gone


def test_flagship_finds_grids_and_text_once(spark, monkeypatch):
    calls = []
    for module, name in ((diagnose, "frequency"), (diagnose, "text_rates"), (profile, "text_rates")):
        if hasattr(module, name):
            monkeypatch.setattr(module, name, lambda *a, was=getattr(module, name), n=name: calls.append(n) or was(*a))
    assert __spark_entry__.queries()["pipeline_checks"](spark, "/root/testdata/sf0.001").count() == 9
    assert sorted(calls) == ["frequency", "text_rates"]


def test_sketches_add_up(spark):
    """Of parts that were sketched apart: errors of the sum against exact figures; empty and null columns, NaN, ties."""
    rng = np.random.default_rng(6)
    p = pd.DataFrame({"part": np.arange(60_000) % 7, "x": rng.lognormal(size=60_000), "u": rng.integers(0, 50_000, 60_000), "t": rng.choice(["a", "b", "c"], 60_000, p=[0.7, 0.2, 0.1])})
    p.loc[::10, "x"] = np.nan
    df = spark.createDataFrame(p).withColumn("none", F.lit(None).cast("string")).withColumn("list", F.array(F.lit(1)))
    parts = sketches.sketched(df, "part")
    assert parts.count() == 7 * 4
    found = {r.col: r for r in sketches.estimated(sketches.merged(parts), [0.1, 0.5, 0.99], 2).collect()}
    assert set(found) == {"x", "u", "t", "none"} and all(r.n == 60_000 for r in found.values())
    assert found["x"].null_count == 6000 and found["none"].null_count == 60_000 and found["none"].top_values == [] and found["none"].quantiles is None
    for c in ("x", "u"):
        values = p[c].dropna()
        assert abs(found[c].distinct_count / values.nunique() - 1) < 0.03
        for q, share in zip(found[c].quantiles, (0.1, 0.5, 0.99), strict=True):
            assert abs((values <= q).mean() - share) < 0.01
    assert [(r.value, r.freq) for r in found["t"].top_values] == [(k, int(n)) for k, n in p.t.value_counts().head(2).items()] and found["t"].distinct_count == 3
    empty = sketches.estimated(sketches.merged(sketches.sketched(df.limit(0).drop("part")))).collect()
    assert {(r.n, r.distinct_count) for r in empty} == {(0, 0)}


def test_sketched_quantiles_of_few_values(spark):
    """At shares where one value ends and the next begins, a rank that is off by little is another value: counts must tell."""
    p = pd.DataFrame({"part": np.arange(4000) % 4, "half": (np.arange(4000) >= 2000).astype(float), "step": np.where(np.arange(4000) < 1001, 0.02, 0.03), "key": np.arange(4000) % 50, "wide": np.arange(4000) * 1.0})
    p.loc[::9, "step"] = np.nan
    found = {r.col: r.quantiles for r in sketches.estimated(sketches.merged(sketches.sketched(spark.createDataFrame(p), "part"))).collect()}
    for c in ("half", "step", "key"):
        assert found[c] == pytest.approx([p[c].quantile(q) for q in (0.25, 0.5, 0.75)], abs=1e-12)
    assert found["wide"] == pytest.approx([1000, 2000, 3000], abs=80)


def test_jdbc_relation():
    assert readers.jdbc_relation("s.t") == '"s"."t"' and readers.jdbc_relation("t", 5) == '(SELECT * FROM "t" FETCH FIRST 5 ROWS ONLY) AS picked'
    assert readers.jdbc_relation("t", 5, ["a", "b"], ["b"]) == '(SELECT "a", "b" FROM "t" ORDER BY "b" FETCH FIRST 5 ROWS ONLY) AS picked'
    for bad in (("t; DROP TABLE x",), ("t", None, ["a FROM x --"]), ("t", 1, None, ["a; DELETE"])):
        with pytest.raises(ValueError):
            readers.jdbc_relation(*bad)


def test_jdbc_scan_is_split_by_the_databases_own_bounds(spark):
    """Against the database that comes with Spark, held in memory."""
    url, driver = "jdbc:derby:memory:scan;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    rows = [(i, float(i) / 2, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), f"t{i}") for i in range(100)] + [(None, 0.0, None, "none")]
    spark.createDataFrame(rows, "id long, v double, ts timestamp, name string").write.format("jdbc").options(url=url, dbtable='"readings"', driver=driver).mode("overwrite").save()
    assert readers.jdbc_split(spark, url, "readings", "id", rows=1000, driver=driver) is None
    assert readers.jdbc_split(spark, url, "readings", "id", rows=30, driver=driver) == readers.Split("id", 0, 99, 4)
    assert readers.jdbc_split(spark, url, "readings", "id", rows=1, most=7, driver=driver).partitions == 7
    df = readers.jdbc_table(spark, url, "readings", "id", rows=30, driver=driver)
    assert df.rdd.getNumPartitions() == 4 and df.count() == 101 and df.where("id is null").count() == 1
    assert max(df.rdd.glom().map(len).collect()) < 40
    by_time = readers.jdbc_table(spark, url, "readings", "ts", rows=50, driver=driver)
    assert by_time.rdd.getNumPartitions() == 3 and by_time.where("ts >= timestamp '2024-01-02'").count() == 76
    few = readers.jdbc_table(spark, url, "readings", "id", 5, ["id", "name"], ["id"], driver=driver)
    assert few.columns == ["id", "name"] and [r[0] for r in few.collect()] == [0, 1, 2, 3, 4]
    plan = df.where("v > 3").select("name")._jdf.queryExecution().executedPlan().toString()
    assert "*GreaterThan(v,3.0)" in plan and "struct<name:string>" in plan


def test_reader_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.read_source(spark, "x.xls")
    (tmp_path / "a.csv").write_text("a,b\n1,x\n2,y\n")
    df = readers.read_source(spark, f"{tmp_path}/a.csv", 1, ["a"])
    assert df.dtypes[0] == ("a", "int") and df.count() == 1


def test_guard():
    assert readers.guarded("select ';--' -- c\n;") .startswith("select ';--'")
    for bad in ("DROP TABLE x", "SELECT 1; DROP TABLE x", "-- SELECT\nDELETE FROM x"):
        with pytest.raises(ValueError):
            readers.guarded(bad)


def test_unknown_choice_raises(spark):
    bad = spark.createDataFrame([("v", "guess", "keep", "none", "keep")], "col string, missing_strategy string, outlier_strategy string, type_fix string, action string")
    with pytest.raises(Exception, match="unknown value"):
        recipe.normalized(bad).collect()


def test_entry(spark):
    rows = {r["check"]: r.passed for r in __spark_entry__.entry(spark).collect()}
    assert len(rows) == 9 and rows["timestamp_monotonic"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
