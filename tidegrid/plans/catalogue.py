"""Registered queries of the library and their DuckDB counterparts.

Fixtures are SQL that both engines read; operators do the rest in Spark, plain SQL in DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions import expressions as ex
from tidegrid.functions import formats
from tidegrid.operators import clean, diagnose, gate, ordering, profile, recipe, sketches
from tidegrid.operators.measures import measured
from tidegrid.sources import readers, runs
from tidegrid.sources.scratch import fresh_folder, stored
from tidegrid.spec import SeriesSpec

Query = Callable[[SparkSession, str], DataFrame]
#: Time order, and the order in which events were stored.
SPEC, BY_KEY = SeriesSpec("ts", ("event_id",)), SeriesSpec("event_id")
PANEL = SeriesSpec("ts", ("event_id",), ("user_id",))
DIRTY = """SELECT event_id, ts, user_id, event_type,
 CASE WHEN event_id % 17 = 0 OR event_id BETWEEN 100 AND 139 THEN NULL WHEN event_id % 501 = 0 THEN value * 50 ELSE value END AS v,
 CASE WHEN event_id >= 9000 AND event_id % 3 <> 0 THEN NULL ELSE value END AS v_trail,
 CASE WHEN event_id >= 9000 THEN NULL ELSE value END AS v_block,
 CASE WHEN event_id % 2 = 0 THEN 0.0e0 ELSE value END AS v_zero,
 CASE WHEN event_id % 11 = 0 THEN 'n/a' ELSE CAST(event_id AS STRING) END AS num_txt,
 CASE WHEN event_id % 13 = 0 THEN 'bad' ELSE CAST(CAST(ts AS DATE) AS STRING) END AS date_txt,
 CASE event_id % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'TRUE' WHEN 3 THEN '0' ELSE 'maybe' END AS flag_txt,
 CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS t_gap,
 'x' AS const_txt, 5.0e0 + 0.0001e0 * (event_id % 2) AS const_num FROM events"""
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
MEASURES = ["v", "v_trail", "v_zero", "const_num"]
DUP = "SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 100 = 0"
JOINED = "SELECT n.n_name AS nation, count(*) AS orders, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name"

#: One moment written in several ways; each column has one format, but for what isn't a date at all.
STAMPS = """SELECT event_id, event_id AS place, value, CASE event_id % 6 WHEN 0 THEN replace(x, ' ', 'T') WHEN 1 THEN replace(x, ' ', 'T') || 'Z' WHEN 2 THEN replace(x, ' ', 'T') || '+02:00' WHEN 3 THEN substr(x, 1, 16) WHEN 4 THEN substr(x, 1, 10) ELSE x END AS iso_txt,
 substr(x, 6, 2) || '/' || substr(x, 9, 2) || '/' || substr(x, 1, 4) AS us_txt, substr(x, 9, 2) || '/' || substr(x, 6, 2) || '/' || substr(x, 1, 4) AS eu_txt,
 CASE WHEN event_id % 10 = 3 THEN 'n/a' ELSE substr(x, 9, 2) || '.' || substr(x, 6, 2) || '.' || substr(x, 1, 4) || ' ' || substr(x, 12, 5) END AS dot_txt
 FROM (SELECT event_id, value, CAST(ts AS STRING) AS x FROM events)"""
#: Its text columns, and the formats that read any of them.
_WRITTEN = {"iso_txt": ("iso", "dd.MM.yyyy"), "us_txt": ("MM/dd/yyyy", "dd/MM/yyyy"), "eu_txt": ("MM/dd/yyyy", "dd/MM/yyyy"), "dot_txt": ("iso", "dd.MM.yyyy")}

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _tables(spark: SparkSession, sf_dir: str) -> None:
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def _sql(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    _tables(spark, sf_dir)
    return spark.sql(query)


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, DIRTY)


def _add(name: str, query: Query, sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql:
        _SQL[name] = sql


def _on(name: str, made: Callable[[DataFrame], DataFrame], sql: str | None = None, base: str = DIRTY) -> None:
    """A query over a fixture; {d} in sql stands for the fixture."""
    _add(name, lambda spark, sf_dir: made(_sql(spark, sf_dir, base)), sql and "WITH d AS MATERIALIZED (" + base.replace("AS STRING", "AS VARCHAR") + ") " + sql)


def _each(columns: list[str], select: str) -> str:
    return " UNION ALL ".join(select.replace("@", c) for c in columns)


# Sources -----------------------------------------------------------------------------------------


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    _tables(spark, sf_dir)
    return readers.table_scan(spark, "nation")


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    _tables(spark, sf_dir)
    return readers.sql_query(spark, f"/* joins come in as SQL */ {JOINED}; -- one statement")


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null profile of every listed table."""
    _tables(spark, sf_dir)
    names = [t for t in readers.listed_tables(spark) if t in TABLES]  # a session may hold views of others
    return profile.union_all([profile.nulls(readers.table_scan(spark, t)).select(F.lit(t).alias("table"), "col", "null_count") for t in names])


_add("src_table_scan", _scan, "SELECT * FROM nation")
_add("src_sql_query", _query, JOINED)
_add("src_row_limit", lambda s, d: readers.read_source(s, f"{d}/orders.parquet", 100, ["o_orderkey"]), "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100")
_add("src_parquet", lambda s, d: readers.read_source(s, f"{d}/customer.parquet"), "SELECT * FROM customer")
_add("profile_source_bytes", lambda s, d: profile.source_bytes(s.read.parquet(f"{d}/lineitem.parquet")))

# Profile -----------------------------------------------------------------------------------------
_ALL = ["event_id", "ts", "user_id", "event_type", "v", "v_trail", "v_block", "v_zero", "num_txt", "date_txt", "flag_txt", "t_gap", "const_txt", "const_num"]
_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_NUMBER = "regexp_matches(@, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$')"
_STATS = """SELECT '@' AS col, CAST(count(@) AS BIGINT) AS n, min(@) AS min, max(@) AS max, round(avg(@), 6) AS mean, round(quantile_cont(@, 0.5), 6) AS median,
 round(stddev_samp(@), 6) AS std, round(skewness(@), 6) AS skew, round(kurtosis(@), 6) AS kurtosis, round(quantile_cont(@, 0.25), 6) AS q1, round(quantile_cont(@, 0.75), 6) AS q3,
 round(quantile_cont(@, 0.75) - quantile_cont(@, 0.25), 6) AS iqr FROM lineitem"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


_on("profile_shape", profile.shape, "SELECT count(*) AS rows, CAST(14 AS BIGINT) AS cols FROM d")
_on("profile_nulls", profile.nulls, _each(_ALL, "SELECT '@' AS col, count(*) - count(@) AS null_count, round((count(*) - count(@)) * 100.0e0 / count(*), 6) AS null_pct FROM d"))
_on("profile_dtypes", lambda d: profile.dtypes(d).select("col", "dtype_inferred"), "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{t}')" for c, t in zip(_ALL, ["numeric", "datetime", "numeric", "categorical", "numeric", "numeric", "numeric", "numeric"], strict=False)) + ", ('flag_txt', 'categorical'), ('t_gap', 'categorical'), ('const_txt', 'categorical'), ('const_num', 'numeric')) t(col, dtype_inferred) UNION ALL " + _each(["num_txt", "date_txt"], f"SELECT '@', CASE WHEN count(*) FILTER (WHERE {_NUMBER}) > 0.8 * count(@) THEN 'numeric' WHEN count(try_cast(@ AS TIMESTAMP)) = count(@) THEN 'datetime' ELSE 'categorical' END FROM d"))
_add("profile_numeric", lambda s, d: _rounded(profile.statistics(s.read.parquet(f"{d}/lineitem.parquet"), _LINE)), _each(_LINE, _STATS))
_on("profile_cardinality", lambda d: profile.cardinality(d, ["event_type", "flag_txt", "num_txt", "const_txt"]), _each(["event_type", "flag_txt", "num_txt", "const_txt"], "SELECT '@' AS col, count(DISTINCT @) AS distinct_count FROM d"))
_on("profile_top_values", lambda d: profile.top_values(d, ["event_type", "flag_txt", "t_gap"]), "SELECT * FROM (SELECT col, value, count(*) AS freq, row_number() OVER (PARTITION BY col ORDER BY count(*) DESC, value NULLS LAST) AS rank FROM (" + _each(["event_type", "flag_txt", "t_gap"], "SELECT '@' AS col, @ AS value FROM d") + ") GROUP BY col, value) WHERE rank <= 5")
_on("profile_duplicate_rows", profile.duplicate_rows, "SELECT (SELECT count(*) FROM d) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS duplicates", DUP)
_FREQ = "WITH s AS (SELECT DISTINCT {c} AS t FROM {f}), g AS (SELECT epoch_us(t) - lag(epoch_us(t)) OVER (ORDER BY t) AS gap FROM s), h AS (SELECT quantile_cont(gap, 0.5) / 3.6e9 AS h FROM g) SELECT CASE WHEN h IS NULL THEN 'unknown' WHEN h <= 1.5 THEN 'hourly' WHEN h <= 36 THEN 'daily' WHEN floor(h / 24) BETWEEN 5 AND 8 THEN 'weekly' WHEN floor(h / 24) BETWEEN 25 AND 32 THEN 'monthly' WHEN floor(h / 24) BETWEEN 85 AND 95 THEN 'quarterly' WHEN floor(h / 24) BETWEEN 360 AND 370 THEN 'yearly' ELSE 'every_' || CAST(CAST(floor(h / 24) AS BIGINT) AS VARCHAR) || '_days' END AS frequency FROM h"
_GRIDS = {"ts_frequency": ("l_shipdate", "lineitem"), "ts_frequency_events": ("ts", "events")}
for _n, (_c, _f) in _GRIDS.items():
    _add(_n, lambda s, d, c=_c, f=_f: profile.frequency(s.read.parquet(f"{d}/{f}.parquet"), c), _FREQ.format(c=_c, f=_f))
for _unit in ("week", "month", "quarter", "year"):
    _add(f"ts_frequency_{_unit}", lambda s, d, u=_unit: profile.frequency(_sql(s, d, f"SELECT date_trunc('{u}', o_orderdate) AS t FROM orders"), "t"), _FREQ.format(c="t", f=f"(SELECT date_trunc('{_unit}', o_orderdate) AS t FROM orders)"))
_EIGHT = "SELECT TIMESTAMP '2024-01-01' + event_id * INTERVAL '{h}' HOUR AS t FROM events"
for _n, _h in (("week_and_half_day", 204), ("third_day", 72)):  # 8.5 days count as 8
    _add(f"ts_frequency_{_n}", lambda s, d, h=_h: profile.frequency(_sql(s, d, _EIGHT.format(h=h)), "t"), _FREQ.format(c="t", f=f"({_EIGHT.format(h=_h)})"))
_add("catalog_null_profile", _catalog, " UNION ALL ".join(f"""SELECT '{t}' AS "table", col, null_count FROM (UNPIVOT (SELECT count(*) - count(COLUMNS('(.*)')) AS '\\1' FROM {t}) ON COLUMNS(*) INTO NAME col VALUE null_count)""" for t in TABLES))

def _catalog_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    _tables(spark, sf_dir)
    return _rounded(profile.catalogue({t: readers.table_scan(spark, t) for t in readers.listed_tables(spark) if t in TABLES}))


#: Numeric columns of the given tables; all other columns have nulls counted.
_NUMBERS_OF = {
    "region": "r_regionkey",
    "nation": "n_nationkey n_regionkey",
    "customer": "c_custkey c_nationkey c_acctbal",
    "supplier": "s_suppkey s_nationkey s_acctbal",
    "part": "p_partkey p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_totalprice",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax",
    "events": "event_id user_id value",
    "documents": "doc_id n_chars",
    "embeddings": "vec_id label",
    "pages": "page_id",
    "benchmark": "item_id",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn",
}
_MANY = _STATS.replace("FROM lineitem", "FROM {t}").replace("min(@) AS min, max(@) AS max", "CAST(min(@) AS DOUBLE) AS min, CAST(max(@) AS DOUBLE) AS max")
_OF_TABLE = """SELECT '{t}' AS "table", n.col, n.null_count, s.* EXCLUDE (col) FROM (UNPIVOT (SELECT count(*) - count(COLUMNS('(.*)')) AS '\\1' FROM {t}) ON COLUMNS(*) INTO NAME col VALUE null_count) n LEFT JOIN ({s}) s ON s.col = n.col"""
_add("catalog_statistics", lambda s, d: _catalog_statistics(s, d).drop("dtype_raw", "null_pct"), " UNION ALL ".join(_OF_TABLE.format(t=t, s=_each(c.split(), _MANY.format(t=t))) for t, c in _NUMBERS_OF.items()))

# Diagnosis ---------------------------------------------------------------------------------------
_RUN = "(SELECT coalesce(max(n), 0) FROM (SELECT count(*) AS n FROM (SELECT @, row_number() OVER (ORDER BY ts, event_id) - row_number() OVER (PARTITION BY @ IS NULL ORDER BY ts, event_id) AS k FROM d) WHERE @ IS NULL GROUP BY k))"
_GAPPED = ["v", "v_trail", "v_block", "v_zero"]


def _patterns(d: DataFrame) -> DataFrame:
    return diagnose.missing_pattern(d, _GAPPED, SPEC)


_PATTERN = _each(_GAPPED, f"""SELECT '@' AS col, n, null_count, max_run, CASE WHEN null_count = 0 THEN 'none' WHEN max_run > 0.4 * null_count THEN 'block' WHEN tail_nulls > 0.5 * tail THEN 'trailing' ELSE 'random' END AS pattern
 FROM (SELECT count(*) AS n, count(*) - count(@) AS null_count, CAST({_RUN} AS BIGINT) AS max_run, count(*) FILTER (WHERE i > c - greatest(1, c // 10) AND @ IS NULL) AS tail_nulls, count(*) FILTER (WHERE i > c - greatest(1, c // 10)) AS tail
 FROM (SELECT @, row_number() OVER (ORDER BY ts, event_id) AS i, count(*) OVER () AS c FROM d))""")
_OUT = _each(MEASURES, """SELECT '@' AS col, coalesce(round(count(*) FILTER (WHERE @ < q1 - 1.5 * (q3 - q1) OR @ > q3 + 1.5 * (q3 - q1)) * 100.0e0 / count(@), 6), 0) AS iqr_pct,
 coalesce(round(count(*) FILTER (WHERE s > 0 AND abs(@ - m) > 3 * s) * 100.0e0 / count(@), 6), 0) AS zscore_pct,
 coalesce(round(count(*) FILTER (WHERE mad > 0 AND abs(@ - md) > 3 * mad) * 100.0e0 / count(@), 6), 0) AS mad_pct
 FROM d, (SELECT avg(@) AS m, stddev_samp(@) AS s, quantile_cont(@, 0.5) AS md, quantile_cont(@, 0.25) AS q1, quantile_cont(@, 0.75) AS q3 FROM d),
 (SELECT quantile_cont(abs(@ - (SELECT quantile_cont(@, 0.5) FROM d)), 0.5) AS mad FROM d)""")
_on("missing_max_run", lambda d: ordering.null_runs(d, ["v"], SPEC).select("max_run"), f"SELECT CAST({_RUN.replace('@', 'v')} AS BIGINT) AS max_run")
_on("missing_pattern", _patterns, _PATTERN)
for _i, _m in enumerate(("iqr_pct", "zscore_pct", "mad_pct")):
    _on("outlier_" + _m.removesuffix("_pct"), lambda d, m=_m: diagnose.outliers_global(d, MEASURES).select("col", m), f"SELECT col, {_m} FROM ({_OUT})")
_W = "(ORDER BY ts, event_id ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)"
_on("outlier_temporal", lambda d: diagnose.outliers_temporal(d, "v", SPEC, 24).select("temporal_pct"), f"SELECT round(count(*) FILTER (WHERE v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)) * 100.0e0 / count(*), 6) AS temporal_pct FROM (SELECT v, quantile_cont(v, 0.25) OVER {_W} AS a, quantile_cont(v, 0.75) OVER {_W} AS b FROM d WHERE v IS NOT NULL)")
_on("rolling_quartiles", lambda d: _rounded(ordering.rolling(d.select("event_id", "ts", "value"), SPEC, 24, q1=F.percentile("value", 0.25), q3=F.percentile("value", 0.75)).select("event_id", "q1", "q3")), f"SELECT event_id, round(quantile_cont(value, 0.25) OVER {_W}, 6) AS q1, round(quantile_cont(value, 0.75) OVER {_W}, 6) AS q3 FROM d", "SELECT * FROM events")
_INT = "SELECT 'hourly' AS frequency, (SELECT coalesce(bool_and(ts >= p), true) FROM (SELECT ts, lag(ts) OVER (ORDER BY place, event_id) AS p FROM d WHERE ts IS NOT NULL) WHERE p IS NOT NULL) AS is_monotonic, count(*) - count(DISTINCT ts) AS duplicate_timestamps, (SELECT count(*) FROM (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts, event_id) AS g FROM d) WHERE g > 5400000000) AS gap_count FROM d"
_GAP = "SELECT *, event_id AS place FROM events WHERE event_id NOT BETWEEN 5000 AND 5099"
_DUP_PLACED = f"SELECT *, event_id AS place FROM ({DUP})"
_SHUFFLED = "SELECT *, event_id * 7919 % 10000 AS place FROM events"
STORED = SeriesSpec("place", ("event_id",))
for _name, _cols, _base in (("ts_integrity", "*", _GAP), ("ts_monotonic", "is_monotonic", _GAP), ("ts_monotonic_shuffled", "is_monotonic", _SHUFFLED), ("ts_integrity_shuffled", "*", _SHUFFLED), ("ts_duplicates", "duplicate_timestamps", _DUP_PLACED), ("ts_gaps", "gap_count", _GAP)):
    _on(_name, lambda d, c=_cols: diagnose.integrity(d, SPEC, STORED).select(c), f"SELECT {_cols} FROM ({_INT.replace(chr(39) + 'hourly' + chr(39), '(' + _FREQ.format(c='ts', f='d') + ')')})", _base)
#: DuckDB's cast leaves an offset out.
_ISO = "(try_cast({c} AS TIMESTAMP) - CASE WHEN {c} LIKE '%+02:00' THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END)"
_TEXT_TS = "SELECT event_id, event_id AS place, CASE WHEN event_id % 13 = 0 THEN 'bad' ELSE CAST(ts AS STRING) END AS ts FROM events"
_ISO_TS = "SELECT event_id, place, iso_txt AS ts FROM (" + STAMPS + ")"
_INT_OF = _INT.replace("'hourly'", "(" + _FREQ.format(c="ts", f="e") + ")").replace("FROM d", "FROM e")
for _name, _base in (("ts_integrity_unparsed", _TEXT_TS), ("ts_integrity_iso", _ISO_TS)):
    _on(_name, lambda d: diagnose.integrity(d, SPEC, STORED), f"SELECT CASE WHEN ok THEN frequency ELSE 'unknown' END AS frequency, CASE WHEN ok THEN is_monotonic END AS is_monotonic, CASE WHEN ok THEN duplicate_timestamps ELSE 0 END AS duplicate_timestamps, CASE WHEN ok THEN gap_count ELSE 0 END AS gap_count FROM (WITH e AS (SELECT event_id, place, {_ISO.format(c='ts')} AS ts FROM d) {_INT_OF}), (SELECT count(try_cast(ts AS TIMESTAMP)) = count(ts) AS ok FROM d)", _base)
_READ = {"iso": _ISO, "MM/dd/yyyy": "try_strptime({c}, '%m/%d/%Y')", "dd/MM/yyyy": "try_strptime({c}, '%d/%m/%Y')", "dd.MM.yyyy": "try_strptime({c}, '%d.%m.%Y %H:%M')"}
_on("format_election", lambda d: formats.election(d, list(_WRITTEN)), " UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS col, unnest(['{a}', '{b}']) AS format, unnest([count({_READ[a].format(c=c)}), count({_READ[b].format(c=c)})]) AS parsed, count({c}) AS n FROM d) QUALIFY row_number() OVER (ORDER BY parsed DESC) = 1" for c, (a, b) in _WRITTEN.items()), STAMPS)
_on("dtype_issues_dates", profile.text_issues, f"SELECT 'dot_txt' AS col, 'datetime_as_string' AS issue FROM d HAVING count({_READ['dd.MM.yyyy'].format(c='dot_txt')}) BETWEEN 0.8 * count(dot_txt) AND count(dot_txt) - 1", STAMPS)
_on("profile_dtypes_dates", lambda d: profile.dtypes(d).select("col", "dtype_inferred"), "SELECT 'event_id' AS col, 'numeric' AS dtype_inferred UNION ALL SELECT 'place', 'numeric' UNION ALL SELECT 'value', 'numeric' UNION ALL " + " UNION ALL ".join(f"SELECT '{c}', CASE WHEN greatest(count({_READ[a].format(c=c)}), count({_READ[b].format(c=c)})) = count({c}) THEN 'datetime' ELSE 'categorical' END FROM d" for c, (a, b) in _WRITTEN.items()), STAMPS)
_on("dtype_issues", profile.text_issues, f"SELECT 'date_txt' AS col, 'datetime_as_string' AS issue FROM d HAVING count(try_cast(date_txt AS TIMESTAMP)) > 0.8 * count(date_txt) AND count(*) FILTER (WHERE {_NUMBER.replace('@', 'date_txt')}) <= 0.8 * count(date_txt)")
_on("constant_columns", lambda d: diagnose.constants(d, MEASURES, ["const_txt", "flag_txt"]), _each(MEASURES, "SELECT '@' AS col FROM d HAVING (abs(avg(@)) > 0 AND stddev_samp(@) / abs(avg(@)) < 0.001) OR (avg(@) = 0 AND stddev_samp(@) < 1e-9)") + " UNION ALL " + _each(["const_txt", "flag_txt"], "SELECT '@' FROM d HAVING count(DISTINCT @) <= 1"))
_PROFILED = ["v", "v_zero", "flag_txt"]
_on("column_profile", lambda d: diagnose.column_profile(d.select(*_PROFILED)), " UNION ALL ".join(f"SELECT '{c}' AS col, round((count(*) - count({c})) * 100.0e0 / count(*), 6) AS null_pct, round(count(DISTINCT {c}) * 100.0e0 / count(*), 6) AS distinct_pct, " + (f"round(count(*) FILTER (WHERE {c} = 0) * 100.0e0 / count(*), 6)" if c != "flag_txt" else "CAST(NULL AS DOUBLE)") + " AS zero_pct, " + (f"round(skewness({c}), 6)" if c != "flag_txt" else "CAST(NULL AS DOUBLE)") + " AS skew FROM d" for c in _PROFILED))
_NUMERIC = ["event_id", "user_id", "v", "v_trail", "v_block", "v_zero", "num_txt", "const_num"]
_VALUE = {c: f"CASE WHEN {_NUMBER.replace('@', c)} THEN try_cast({c} AS DOUBLE) END" if c == "num_txt" else f"CAST({c} AS DOUBLE)" for c in _NUMERIC}


def _fact(c: str) -> str:
    """One row of facts about a column of the fixture d."""
    raw = f"CASE any_value(typeof({c})) WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' END"
    text = f"CASE WHEN count(*) FILTER (WHERE {_NUMBER.replace('@', f'CAST({c} AS VARCHAR)')}) > 0.8 * count({c}) THEN 'numeric' WHEN count(try_cast(CAST({c} AS VARCHAR) AS TIMESTAMP)) = count({c}) THEN 'datetime' ELSE 'categorical' END"
    kind = f"CASE any_value(typeof({c})) WHEN 'VARCHAR' THEN {text} WHEN 'TIMESTAMP' THEN 'datetime' ELSE 'numeric' END"
    issue = f"CASE WHEN any_value(typeof({c})) = 'VARCHAR' AND {text} = 'categorical' AND count(try_cast(CAST({c} AS VARCHAR) AS TIMESTAMP)) > 0.8 * count({c}) THEN 'datetime_as_string' END"
    base = f"SELECT '{c}' AS col, {raw} AS dtype_raw, {kind} AS dtype_inferred, count(*) AS n, count(*) - count({c}) AS null_count, round((count(*) - count({c})) * 100.0e0 / count(*), 6) AS null_pct, round(count(DISTINCT {c}) * 100.0e0 / count(*), 6) AS distinct_pct, {issue} AS issue, count(DISTINCT {c}) <= 1 AS single FROM d"
    pattern = f"SELECT max_run, pattern FROM ({_PATTERN_OF.replace('@', c)})"
    if c not in _NUMERIC:
        none = ", ".join(f"CAST(NULL AS DOUBLE) AS {x}" for x in ("zero_pct", "skew", "iqr", "iqr_pct", "zscore_pct", "mad_pct", "temporal_pct"))
        return f"SELECT b.* EXCLUDE (single), max_run, pattern, {none}, false AS any_outlier, dtype_inferred = 'categorical' AND single AS constant FROM ({base}) b, ({pattern})"
    v = f"(SELECT ts, event_id, {_VALUE[c]} AS x FROM d)"
    rates = f"""SELECT round(zeros * 100.0e0 / rows, 6) AS zero_pct, skew, round(q3 - q1, 6) AS iqr, round(count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) * 100.0e0 / count(x), 6) AS iqr_pct,
 round(count(*) FILTER (WHERE s > 0 AND abs(x - m) > 3 * s) * 100.0e0 / count(x), 6) AS zscore_pct, round(count(*) FILTER (WHERE mad > 0 AND abs(x - md) > 3 * mad) * 100.0e0 / count(x), 6) AS mad_pct,
 coalesce((abs(m) > 0 AND s / abs(m) < 0.001) OR (m = 0 AND s < 1e-9), false) AS constant
 FROM {v}, (SELECT count(*) AS rows, count(*) FILTER (WHERE x = 0) AS zeros, round(skewness(x), 6) AS skew, avg(x) AS m, stddev_samp(x) AS s, quantile_cont(x, 0.5) AS md, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM {v}),
 (SELECT quantile_cont(abs(x - (SELECT quantile_cont(x, 0.5) FROM {v})), 0.5) AS mad FROM {v}) GROUP BY ALL"""
    local = f"SELECT round(count(*) FILTER (WHERE x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a)) * 100.0e0 / count(*), 6) AS temporal_pct FROM (SELECT x, quantile_cont(x, 0.25) OVER {_W} AS a, quantile_cont(x, 0.75) OVER {_W} AS b FROM {v} WHERE x IS NOT NULL)"
    return f"SELECT b.* EXCLUDE (single), max_run, pattern, r.* EXCLUDE (constant), temporal_pct, iqr_pct > 0 OR zscore_pct > 0 OR mad_pct > 0 OR temporal_pct > 0 AS any_outlier, constant FROM ({base}) b, ({pattern}), ({rates}) r, ({local})"


_PATTERN_OF = f"""SELECT '@' AS col, n, null_count, max_run, CASE WHEN null_count = 0 THEN 'none' WHEN max_run > 0.4 * null_count THEN 'block' WHEN tail_nulls > 0.5 * tail THEN 'trailing' ELSE 'random' END AS pattern
 FROM (SELECT count(*) AS n, count(*) - count(@) AS null_count, CAST({_RUN} AS BIGINT) AS max_run, count(*) FILTER (WHERE i > c - greatest(1, c // 10) AND @ IS NULL) AS tail_nulls, count(*) FILTER (WHERE i > c - greatest(1, c // 10)) AS tail
 FROM (SELECT @, row_number() OVER (ORDER BY ts, event_id) AS i, count(*) OVER () AS c FROM d))"""
_DUCK_DIRTY = f"WITH d AS MATERIALIZED ({DIRTY.replace('AS STRING', 'AS VARCHAR')}), "
_DUCK_FACTS = _DUCK_DIRTY + f"f AS MATERIALIZED ({' UNION ALL BY NAME '.join(map(_fact, _ALL))}), "
_known: dict[tuple[str, str], DataFrame] = {}


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts about the fixture's columns, found once in a session as a run's profile artifact is."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _known:
        _known[key] = stored(diagnose.facts(_dirty(spark, sf_dir), SPEC, 24))
    return _known[key]


def _reported(p: DataFrame, table: DataFrame) -> DataFrame:
    field = lambda name: F.get_json_object("json", f"$.{name}")
    return diagnose.payload(p, table).select("col", "kind", *(F.round(field(x).cast("double"), 6).alias(x) for x in ("null_pct", "iqr_pct", "zscore_pct", "mad_pct", "temporal_pct", "distinct_pct", "zero_pct", "skew")), field("max_run").cast("long").alias("max_run"), *(field(x).alias(x) for x in ("pattern", "issue", "dtype_inferred")), *(field(x).cast("long").alias(x) for x in ("n_rows", "duplicate_rows", "duplicate_timestamps")), field("frequency.ts").alias("frequency"), F.get_json_object("json", "$.breakpoints").alias("breakpoints"))


def _part(kind: str, keep: str, *names: str) -> str:
    every = ("null_pct", "iqr_pct", "zscore_pct", "mad_pct", "temporal_pct", "distinct_pct", "zero_pct", "skew", "max_run", "pattern", "issue", "dtype_inferred")
    return f"SELECT col, '{kind}' AS kind, " + ", ".join(x if x in names else f"NULL AS {x}" for x in every) + f", {_NO_TABLE} FROM f WHERE {keep}"


_NO_TABLE = "NULL AS n_rows, NULL AS duplicate_rows, NULL AS duplicate_timestamps, NULL AS frequency, NULL AS breakpoints"
_DAILY = "SELECT CAST(ts AS DATE) AS d, avg(v) AS y FROM d GROUP BY ALL"


_add("column_facts", _facts, _DUCK_FACTS.rstrip(", ") + " SELECT * FROM f")
def _grids(d: DataFrame) -> DataFrame:
    """The grid of each timestamp column of lineitem-like data."""
    parts = [("ts", "ts"), ("day", "CAST(date_trunc('day', ts) AS TIMESTAMP)"), ("week", "date_trunc('week', ts)")]
    return profile.union_all([profile.frequency(d.selectExpr(f"{e} AS t"), "t").select(F.lit(n).alias("col"), "frequency", F.lit(i).alias("pos")) for i, (n, e) in enumerate(parts)])


_SHIFT = "SELECT CAST(l_shipdate AS DATE) AS d, avg(l_extendedprice) * (CASE WHEN l_shipdate >= TIMESTAMP '1997-01-01' THEN 1.6e0 ELSE 1e0 END) * (CASE WHEN l_shipdate >= TIMESTAMP '1999-06-01' THEN 0.5e0 ELSE 1e0 END) AS y FROM lineitem GROUP BY l_shipdate"
_on("pick_timestamp", lambda d: diagnose.pick_timestamp(_grids(d)), f"SELECT CASE WHEN ({_FREQ.format(c='ts', f='d')}) IN ('hourly', 'daily') THEN 'ts' ELSE 'day' END AS timestamp_col", "SELECT * FROM events")
_CENTRED = "WITH c AS (SELECT d, y - avg(y) OVER () AS y, count(*) OVER () AS n, CASE WHEN var_pop(y) OVER () = 0 THEN 1 ELSE var_pop(y) OVER () END AS var FROM ({q})), p AS (SELECT d, n, var, row_number() OVER (ORDER BY d) AS i, sum(y) OVER (ORDER BY d) AS s, sum(y) OVER () AS t FROM c), g AS (SELECT *, s * s / i + (t - s) * (t - s) / (n - i) - t * t / n AS gain FROM p WHERE i < n) SELECT CAST(d AS VARCHAR) AS break_at, CAST(1 AS BIGINT) AS round FROM g WHERE n >= 50 AND gain > ln(n) * var ORDER BY gain DESC, d DESC LIMIT 1"
_add("structural_break", lambda s, d: diagnose.breaks(_sql(s, d, _SHIFT), "d", "y", 1).select(F.col("break_at").cast("string").alias("break_at"), "round"), _CENTRED.format(q=_SHIFT))


def _rounds(q: str, rounds: int) -> str:
    """Binary segmentation written out for so many rounds; more than the data need."""
    out = f"WITH c0 AS (SELECT d, y - avg(y) OVER () AS y, ln(count(*) OVER ()) * var_pop(y) OVER () AS bar, count(*) OVER () AS n, '' AS seg FROM ({q}))"
    for k in range(1, rounds + 1):
        out += f""", g{k} AS (SELECT *, CASE WHEN i < m THEN s * s / i + (t - s) * (t - s) / (m - i) - t * t / m END AS gain FROM (SELECT *, row_number() OVER u AS i, sum(y) OVER u AS s, count(*) OVER w AS m, sum(y) OVER w AS t FROM c{k - 1} WHERE n >= 50 WINDOW u AS (PARTITION BY seg ORDER BY d), w AS (PARTITION BY seg))),
 b{k} AS (SELECT seg, max_by(d, gain) AS break_at FROM g{k} WHERE gain > bar GROUP BY seg), c{k} AS (SELECT c.d, c.y, c.bar, c.n, c.seg || CASE WHEN c.d > b.break_at THEN 'r' ELSE 'l' END AS seg FROM c{k - 1} c JOIN b{k} b ON b.seg = c.seg)"""
    return out + " " + " UNION ALL ".join(f"SELECT CAST(break_at AS VARCHAR) AS break_at, CAST({k} AS BIGINT) AS round FROM b{k}" for k in range(1, rounds + 1))


_add("structural_breaks_all", lambda s, d: diagnose.breaks(_sql(s, d, _SHIFT), "d", "y").select(F.col("break_at").cast("string").alias("break_at"), "round"), _rounds(_SHIFT, 6))

_ABOUT = "SELECT NULL AS col, 'table' AS kind, " + _part("x", "x", "").split("kind, ")[1].split(", " + _NO_TABLE)[0] + f""", (SELECT count(*) FROM d) AS n_rows, (SELECT count(*) FROM d) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS duplicate_rows, (SELECT count(*) - count(DISTINCT ts) FROM d) AS duplicate_timestamps, ({_FREQ.format(c="ts", f="d")}) AS frequency,
 (SELECT '[' || coalesce(string_agg('"' || break_at || '"', ',' ORDER BY break_at), '') || ']' FROM ({_rounds(_DAILY, 6)})) AS breakpoints"""
_add("decision_payload", lambda s, d: _reported(_facts(s, d), diagnose.table_facts(_dirty(s, d), ["ts"], "v")), _DUCK_FACTS.rstrip(", ") + " " + " UNION ALL ".join((_part("missing", "null_count > 0", "null_pct", "max_run", "pattern"), _part("outliers", "any_outlier", "iqr_pct", "zscore_pct", "mad_pct", "temporal_pct"), _part("profile", "true", "dtype_inferred", "null_pct", "distinct_pct", "zero_pct", "skew"), _part("issue", "issue IS NOT NULL", "issue"), _part("constant", "constant"), _ABOUT)))

# Recipe ------------------------------------------------------------------------------------------


def _default_sql(ts: bool, period: int) -> str:
    outlier = f"CASE WHEN NOT any_outlier OR constant THEN 'keep' WHEN n >= {2 * period} THEN 'stl_residuals' WHEN n >= 30 THEN 'rolling_iqr' ELSE 'clip_iqr' END" if ts else "CASE WHEN NOT any_outlier OR constant THEN 'keep' ELSE 'clip_iqr' END"
    return f"SELECT col, CASE WHEN constant OR null_pct <= 0 THEN 'none' ELSE '{'interpolate' if ts else 'forward_fill'}' END AS missing_strategy, {outlier} AS outlier_strategy, CASE WHEN constant THEN 'none' WHEN issue = 'numeric_as_string' THEN 'cast_numeric' WHEN issue = 'datetime_as_string' THEN 'parse_datetime' ELSE 'none' END AS type_fix, CASE WHEN constant THEN 'drop' ELSE 'keep' END AS action FROM f"


_DEFAULT = f"r AS ({_default_sql(True, 24)}) "
#: Timestamp or none, and season lengths at which each branch of the outlier choice is reached; the last has few rows.
_CASES = {"ts": ("ts", 24), "none": (None, 24), "season": ("ts", 1_000_000), "short": ("ts", 24)}


def _cases(made: Callable[[DataFrame, str | None, int], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    def query(p: DataFrame) -> DataFrame:
        few = p.withColumn("n", F.lit(20).cast("long"))
        return profile.union_all([made(few if k == "short" else p, *case).withColumn("case", F.lit(k)) for k, case in _CASES.items()])

    return query


def _cases_sql(made: Callable[[str, str | None, int], str]) -> str:
    return " UNION ALL ".join(f"SELECT *, '{k}' AS \"case\" FROM ({made('(SELECT * REPLACE (20 AS n) FROM f)' if k == 'short' else 'f', *case)})" for k, case in _CASES.items())


def _recipe(name: str, made: Callable[[DataFrame], DataFrame], sql: str) -> None:
    _add(name, lambda s, d: made(_facts(s, d)), _DUCK_FACTS + _DEFAULT + sql)


def _default(p: DataFrame) -> DataFrame:
    return recipe.default_recipe(p, "ts", 24)


def _evidence_sql(f: str, ts: str | None, period: int) -> str:
    local = f"CASE WHEN n >= {2 * period} THEN 'stl_residuals' ELSE 'rolling_iqr' END"
    fill = "CASE WHEN constant THEN 'none' ELSE 'interpolate' END" if ts else "CASE WHEN dtype_inferred = 'numeric' AND abs(skew) > 1 THEN 'median_fill' WHEN dtype_inferred = 'numeric' THEN 'mean_fill' ELSE 'forward_fill' END"
    return f"""SELECT col, CASE WHEN null_pct <= 0 THEN 'none' WHEN null_pct < 1 THEN 'drop_row' ELSE {fill} END AS missing_strategy,
 CASE WHEN NOT any_outlier OR constant OR zero_pct > 50 THEN 'keep' WHEN temporal_pct IS NULL THEN 'clip_iqr' WHEN temporal_pct * 2 <= iqr_pct THEN {local} ELSE 'clip_iqr' END AS outlier_strategy,
 CASE WHEN null_pct >= 95 OR (distinct_pct >= 99 AND col <> '{ts or ''}') OR constant THEN 'drop' ELSE 'keep' END AS action FROM {f}"""


def _swapped(r: DataFrame) -> DataFrame:
    return r.withColumn("missing_strategy", F.when(F.col("missing_strategy") == "none", "keep").otherwise(F.col("missing_strategy")))


_recipe("recipe_default", _default, "SELECT * FROM r")
_recipe("recipe_outlier_choice", _cases(lambda p, ts, period: recipe.default_recipe(p, ts, period).select("col", "missing_strategy", "outlier_strategy")), _cases_sql(lambda f, ts, period: f"SELECT col, missing_strategy, outlier_strategy FROM ({_default_sql(ts is not None, period).replace(' FROM f', ' FROM ' + f)})"))
#: Few nulls, nearly none but nulls, and a zero-inflated column, for the branches that the fixture itself doesn't reach.
_TURNED = {"null_pct": {"v_trail": 0.5, "t_gap": 96.0}, "zero_pct": {"v_zero": 60.0}, "temporal_pct": {"v": 0.001}}


def _turned(p: DataFrame) -> DataFrame:
    for field, values in _TURNED.items():
        p = p.withColumn(field, F.coalesce(*(F.when(F.col("col") == c, F.lit(x)) for c, x in values.items()), F.col(field)))
    return p


_TURN = "(SELECT * REPLACE (" + ", ".join("CASE col " + " ".join(f"WHEN '{c}' THEN {x}e0" for c, x in values.items()) + f" ELSE {field} END AS {field}" for field, values in _TURNED.items()) + ") FROM {f})"
_recipe("recipe_evidence", lambda p: _cases(lambda q, ts, period: recipe.evidence_recipe(q, ts, period).select("col", "missing_strategy", "outlier_strategy", "action"))(_turned(p)), _cases_sql(lambda f, ts, period: _evidence_sql(_TURN.format(f=f), ts, period)))
_recipe("recipe_normalize", lambda p: recipe.normalized(_swapped(_default(p))), "SELECT * FROM r")
_recipe("recipe_fill_missing_cols", lambda p: recipe.filled(_default(p).where("col <> 'v'"), p), "SELECT f.col, coalesce(missing_strategy, 'none') AS missing_strategy, coalesce(outlier_strategy, 'keep') AS outlier_strategy, coalesce(type_fix, 'none') AS type_fix, coalesce(action, 'keep') AS action FROM f LEFT JOIN (SELECT * FROM r WHERE col <> 'v') r ON r.col = f.col")
_recipe("recipe_force_typefix", lambda p: recipe.forced_type_fix(_default(p).withColumn("type_fix", F.lit("none")), p).select("col", "type_fix"), "SELECT col, type_fix FROM r")


def _harsh(p: DataFrame) -> DataFrame:
    """A recipe that drops everything, clips everything and averages what is missing."""
    return _default(p).withColumns({"outlier_strategy": F.lit("clip_iqr"), "action": F.when(F.col("col") == "v_trail", "keep").otherwise("drop"), "missing_strategy": F.when(F.col("missing_strategy") == "none", "none").otherwise("mean_fill"), "type_fix": F.when(F.col("col") == "flag_txt", "encode_boolean").otherwise(F.col("type_fix"))})


_recipe("recipe_sanitize", lambda p: recipe.sanitized(_harsh(_turned(p)), _turned(p), "ts"), f"""SELECT col, CASE WHEN null_pct >= 95 THEN m WHEN col = 'ts' THEN 'drop_row' WHEN m = 'mean_fill' AND dtype_inferred <> 'numeric' AND t <> 'cast_numeric' THEN 'forward_fill' ELSE m END AS missing_strategy,
 CASE WHEN null_pct >= 95 THEN 'clip_iqr' WHEN col = 'ts' OR coalesce(iqr = 0 OR zero_pct >= 50, false) THEN 'keep' ELSE 'clip_iqr' END AS outlier_strategy, t AS type_fix,
 CASE WHEN null_pct >= 95 THEN 'drop' WHEN col IN ('ts', 'v_trail') THEN 'keep' WHEN constant OR distinct_pct >= 99 THEN 'drop' ELSE 'keep' END AS action
 FROM (SELECT f.*, CASE WHEN constant OR null_pct <= 0 THEN 'none' ELSE 'mean_fill' END AS m, CASE WHEN col = 'flag_txt' THEN 'encode_boolean' WHEN issue = 'datetime_as_string' AND NOT constant THEN 'parse_datetime' WHEN null_pct < 95 AND dtype_raw = 'string' AND dtype_inferred = 'numeric' THEN 'cast_numeric' ELSE 'none' END AS t FROM {_TURN.format(f='f')} f)""")
_GRID_ROWS = [("ts", "day", "daily", 0), ("ts", "ts", "hourly", 1), ("season", "ts", "hourly", 0), ("season", "b", "hourly", 1), ("short", "ts", "weekly", 0), ("own", "ts", "hourly", 0), ("own", "mine", "weekly", 1)]


def _catalogue_plan(p: DataFrame) -> DataFrame:
    """Five tables at once: with a timestamp, with none, with few rows, with another profile, and with a user's timestamp."""
    spark = p.sparkSession
    grids = spark.createDataFrame(_GRID_ROWS, "table string, col string, frequency string, pos int")
    tables = spark.createDataFrame([("ts", 0, None), ("none", 3, ""), ("season", 0, None), ("short", 0, None), ("own", 1, "mine")], "table string, duplicates long, user_timestamp string")
    options = recipe.catalogue_options(grids, tables)
    few = p.withColumn("n", F.lit(20).cast("long"))
    profiles = profile.union_all([x.withColumn("table", F.lit(t)) for t, x in (("ts", p), ("none", p), ("season", _turned(p)), ("short", few), ("own", p))])
    return recipe.planned(profiles, options).join(options.select("table", "timestamp_col", "period", "drop_duplicates"), "table")


def _sanitized_sql(made: str, f: str, ts: str | None) -> str:
    """A default recipe with forced type fixes, sanitized."""
    is_ts = f"col = '{ts}'" if ts else "false"
    t = "CASE WHEN null_pct >= 95 OR fix <> 'none' THEN fix WHEN dtype_raw = 'string' AND dtype_inferred = 'numeric' THEN 'cast_numeric' WHEN dtype_raw = 'string' AND dtype_inferred = 'datetime' THEN 'parse_datetime' ELSE fix END"
    fixed = f"SELECT f.*, d.missing_strategy AS m, d.outlier_strategy AS o, d.action AS a, CASE WHEN d.type_fix <> 'none' THEN d.type_fix WHEN issue = 'numeric_as_string' THEN 'cast_numeric' WHEN issue = 'datetime_as_string' THEN 'parse_datetime' ELSE 'none' END AS fix FROM {f} f JOIN ({made}) d ON d.col = f.col"
    audit = "regexp_matches(lower(col), 'created|updated|loaded|inserted|modified|source_file|audit|batch')"
    return f"""SELECT col, CASE WHEN null_pct >= 95 THEN m WHEN {is_ts} THEN 'drop_row' WHEN m IN ('interpolate', 'mean_fill', 'median_fill') AND NOT (dtype_inferred = 'numeric' OR t = 'cast_numeric') THEN 'forward_fill' ELSE m END AS missing_strategy,
 CASE WHEN null_pct >= 95 THEN o WHEN {is_ts} THEN 'keep' WHEN o IN ('clip_iqr', 'rolling_iqr', 'stl_residuals', 'remove') AND coalesce(iqr = 0 OR zero_pct >= 50, false) THEN 'keep' ELSE o END AS outlier_strategy, t AS type_fix,
 CASE WHEN null_pct >= 95 THEN 'drop' WHEN {is_ts} THEN 'keep' WHEN a = 'drop' AND NOT (constant OR distinct_pct >= 99 OR {audit}) THEN 'keep' ELSE a END AS action FROM (SELECT *, {t} AS t FROM ({fixed}))"""


_FEW = "(SELECT * REPLACE (20 AS n) FROM f)"
_TABLES_SQL = [("ts", "f", "ts", 24, False), ("none", "f", None, 7, True), ("season", _TURN.format(f="f"), "ts", 24, False), ("short", _FEW, "ts", 52, False), ("own", "f", "mine", 52, True)]
_recipe("recipe_catalogue", _catalogue_plan, " UNION ALL ".join(f"SELECT *, '{t}' AS \"table\", {f'{chr(39)}{ts}{chr(39)}' if ts else 'NULL'} AS timestamp_col, CAST({n} AS BIGINT) AS period, {str(d).lower()} AS drop_duplicates FROM ({_sanitized_sql(_default_sql(ts is not None, n).replace(' FROM f', ' FROM ' + f), f, ts)})" for t, f, ts, n, d in _TABLES_SQL))
_recipe("recipe_audit_cols", lambda p: p.select("col", recipe.is_audit(F.concat("col", F.when(F.col("col") == "v", "_Updated_at").otherwise(""))).alias("audit")), "SELECT col, col = 'v' AS audit FROM f")
_on("recipe_period", lambda d: recipe.options(_grids(d), "week"), "SELECT 'week' AS timestamp_col, f AS frequency, CAST(CASE f WHEN 'weekly' THEN 52 WHEN 'daily' THEN 7 ELSE 7 END AS BIGINT) AS period, true AS sort_by_timestamp, false AS drop_duplicates FROM (SELECT (" + _FREQ.format(c="t", f="(SELECT date_trunc('week', ts) AS t FROM d)") + ") AS f)", "SELECT * FROM events")

# Cleaning ----------------------------------------------------------------------------------------
_VQ = "(SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, quantile_cont(v, 0.015) AS lo, quantile_cont(v, 0.985) AS hi, avg(v) AS m, quantile_cont(v, 0.5) AS md FROM d)"


def _clean(name: str, made: Callable[[DataFrame], DataFrame], value: str, source: str = f"d, {_VQ}") -> None:
    _on(name, lambda d: _rounded(made(d.select("event_id", "ts", "user_id", "v", "t_gap")).select("event_id", "v")), f"SELECT event_id, round({value}, 6) AS v FROM {source}")


_clean("clean_winsorize", lambda d: clean.winsorize(d, "v"), "CASE WHEN v IS NOT NULL THEN greatest(lo, least(hi, v)) END")
_clean("clean_clip_iqr", lambda d: clean.clip_iqr(d, "v"), "CASE WHEN v IS NOT NULL THEN greatest(q1 - 1.5 * (q3 - q1), least(q3 + 1.5 * (q3 - q1), v)) END")
_clean("clean_log1p", lambda d: clean.log_transform(d, "v"), "CASE WHEN v IS NOT NULL THEN ln(1 + greatest(v, 0)) END", "d")
_clean("clean_mean_fill", lambda d: clean.fill_with(d, "mean", "v"), "coalesce(v, m)")
_clean("clean_median_fill", lambda d: clean.fill_with(d, "median", "v"), "coalesce(v, md)")
_clean("clean_remove_outliers", lambda d: clean.without_outliers(d, "v"), "v", f"d, {_VQ} WHERE NOT coalesce(v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1), false)")
_clean("clean_ffill", lambda d: clean.fill(d, "v", SPEC, "forward"), "last_value(v IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)", "d")
_clean("clean_ffill_panel", lambda d: clean.fill(d, "v", PANEL, "forward"), "last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)", "d")
_clean("clean_bfill", lambda d: clean.fill(d, "v", SPEC, "backward"), "first_value(v IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)", "d")
_clean("clean_rolling_iqr", lambda d: clean.rolling_iqr(d, "v", SPEC, 24), "CASE WHEN v IS NOT NULL THEN greatest(a - 1.5 * (b - a), least(b + 1.5 * (b - a), v)) END", f"(SELECT event_id, v, quantile_cont(v, 0.25) OVER {_W} AS a, quantile_cont(v, 0.75) OVER {_W} AS b FROM d)")
_LINEAR = "(SELECT event_id, v, x, last_value(CASE WHEN v IS NOT NULL THEN x END IGNORE NULLS) OVER u AS ax, last_value(v IGNORE NULLS) OVER u AS av, first_value(CASE WHEN v IS NOT NULL THEN x END IGNORE NULLS) OVER o AS bx, first_value(v IGNORE NULLS) OVER o AS bv FROM (SELECT event_id, ts, v, {x} AS x FROM d) WINDOW u AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), o AS (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
_BETWEEN = "CASE WHEN v IS NOT NULL THEN v WHEN av IS NULL THEN NULL WHEN bv IS NULL OR ax = bx THEN av ELSE av + (bv - av) * (x - ax) / (bx - ax) END"
_clean("clean_interpolate_time", lambda d: clean.interpolate(d, "v", SPEC), _BETWEEN, _LINEAR.format(x="epoch_us(ts)"))
_clean("clean_interpolate_linear", lambda d: clean.interpolate(d, "v", SPEC, by_time=False), _BETWEEN, _LINEAR.format(x="row_number() OVER (ORDER BY ts, event_id)"))
_on("clean_fill_both", lambda d: clean.fill(d, "t_gap", SPEC, "both").select("event_id", "t_gap"), "SELECT event_id, coalesce(last_value(t_gap IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), first_value(t_gap IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS t_gap FROM d")
_on("clean_flag_fill", lambda d: _rounded(clean.flag_and_fill(d, "v", SPEC).select("event_id", "v", "v_missing")), "SELECT event_id, round(last_value(v IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS v, CAST(v IS NULL AS INTEGER) AS v_missing FROM d")
_SEASON = """, f AS (SELECT event_id, ts, v, coalesce(last_value(v IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), first_value(v IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS y FROM d),
 t AS (SELECT *, avg(y) OVER (ORDER BY ts, event_id ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS trend, (row_number() OVER (ORDER BY ts, event_id) - 1) % 24 AS phase FROM f),
 s AS (SELECT *, avg(y - trend) OVER (PARTITION BY phase) AS season FROM t), r AS (SELECT *, y - trend - season AS res FROM s),
 m AS (SELECT quantile_cont(res, 0.5) AS md FROM r), a AS (SELECT quantile_cont(abs(res - md), 0.5) AS mad FROM r, m)
 SELECT event_id, round(CASE WHEN mad > 0 AND abs(res - md) > 3.5 * 1.4826 * mad THEN trend + season ELSE v END, 6) AS v FROM r, m, a"""
for _name, _f in (("seasonal_decompose", clean.seasonal_repair), ("clean_seasonal", clean.stl_residuals)):
    _add(_name, lambda s, d, f=_f: _rounded(f(_dirty(s, d).select("event_id", "ts", "v"), "v", SPEC, 24).select("event_id", "v")), "WITH d AS MATERIALIZED (" + DIRTY.replace("AS STRING", "AS VARCHAR") + ")" + _SEASON)
_on("clean_drop_columns", lambda d: d.drop("const_txt", "const_num").select("event_id", "ts", "v_zero"), "SELECT event_id, ts, v_zero FROM d")
_on("clean_parse_datetime", lambda d: d.select("event_id", formats.timestamps(d, ["date_txt"])["date_txt"].cast("timestamp_ntz").alias("t")), "SELECT event_id, try_cast(date_txt AS TIMESTAMP) AS t FROM d")
_STAMPED = "SELECT event_id, " + ", ".join(f"coalesce({_READ[b].format(c=c)}, NULL) AS {c}" if c in ("eu_txt", "dot_txt") else f"{_READ[a].format(c=c)} AS {c}" for c, (a, b) in _WRITTEN.items()) + " FROM d"
_on("clean_parse_formats", lambda d: (lambda t: d.select("event_id", *(t[c].cast("timestamp_ntz").alias(c) for c in _WRITTEN)))(formats.timestamps(d, _WRITTEN)), _STAMPED, STAMPS)
_on("clean_cast_numeric", lambda d: d.select("event_id", ex.number("num_txt").alias("x")), f"SELECT event_id, CASE WHEN {_NUMBER.replace('@', 'num_txt')} THEN try_cast(num_txt AS DOUBLE) END AS x FROM d")
_on("clean_encode_boolean", lambda d: d.select("event_id", ex.boolean("flag_txt").alias("b")), "SELECT event_id, CASE WHEN lower(flag_txt) IN ('yes', 'true', '1') THEN true WHEN lower(flag_txt) IN ('no', 'false', '0') THEN false END AS b FROM d")
_on("clean_drop_rows", lambda d: clean.drop_rows(d, [F.col("v").isNull(), F.col("v_zero") == 0]).select("event_id"), "SELECT event_id FROM d WHERE v IS NOT NULL AND NOT coalesce(v_zero = 0, false)")
_on("clean_dedupe", lambda d: d.dropDuplicates(), "SELECT DISTINCT * FROM d", DUP)
_on("clean_sort", lambda d: clean.sorted_by_time(d, SPEC).select("event_id", "ts"), "SELECT event_id, ts FROM d ORDER BY ts, event_id")
_on("clean_sort_text", lambda d: clean.sorted_by_time(d.select("event_id", "date_txt"), SeriesSpec("date_txt", ("event_id",))).select("event_id", F.col("date_txt").cast("timestamp_ntz").alias("t")), "SELECT event_id, try_cast(date_txt AS TIMESTAMP) AS t FROM d WHERE try_cast(date_txt AS TIMESTAMP) IS NOT NULL")
_on("clean_sort_iso", lambda d: clean.sorted_by_time(d.select("event_id", "iso_txt"), SeriesSpec("iso_txt", ("event_id",))).select("event_id", F.col("iso_txt").cast("timestamp_ntz").alias("t")), f"SELECT event_id, {_ISO.format(c='iso_txt')} AS t FROM d", STAMPS)
_NULL_TS = DIRTY.replace("SELECT event_id, ts,", "SELECT event_id, CASE WHEN event_id % 50 = 7 THEN NULL ELSE ts END AS ts,")
_on("clean_interpolate_null_ts", lambda d: _rounded(clean.interpolate(d, "v", SPEC).select("event_id", "v")), f"SELECT event_id, round({_BETWEEN}, 6) AS v FROM {_LINEAR.format(x='row_number() OVER (ORDER BY ts NULLS FIRST, event_id)').replace('ORDER BY ts, event_id ROWS', 'ORDER BY ts NULLS FIRST, event_id ROWS')}", _NULL_TS)
_on("clean_snapshot", lambda d: clean.snapshot(d.select("v", "v_zero", "flag_txt")), "SELECT 'flag_txt' AS col, 0.0e0 AS null_pct, CAST(NULL AS DOUBLE) AS std UNION ALL " + _each(["v", "v_zero"], "SELECT '@', round((count(*) - count(@)) * 100.0e0 / count(*), 6), round(stddev_samp(@), 6) FROM d"))
_LOSSY = "event_id % 5 <> 0"
_on("clean_report", lambda d: clean.report(d, d.where(_LOSSY).drop("const_txt")), f"SELECT count(*) AS rows_before, count(*) FILTER (WHERE {_LOSSY}) AS rows_after, count(*) FILTER (WHERE NOT {_LOSSY}) AS rows_removed, round(count(*) FILTER (WHERE NOT {_LOSSY}) * 100.0e0 / count(*), 6) AS loss_pct, 'const_txt' AS dropped_columns FROM d")


_STEPS = "col string, missing_strategy string, outlier_strategy string, type_fix string, action string"


def _plan(d: DataFrame) -> DataFrame:
    steps = [
        ("v", "forward_fill", "clip_iqr", "none", "keep"),
        ("v_trail", "median_fill", "winsorize", "none", "keep"),
        ("v_block", "none", "remove", "none", "keep"),
        ("v_zero", "none", "log_transform", "none", "keep"),
        ("t_gap", "drop_row", "keep", "none", "keep"),
        ("num_txt", "none", "keep", "cast_numeric", "keep"),
        ("date_txt", "none", "keep", "parse_datetime", "keep"),
        ("flag_txt", "none", "keep", "encode_boolean", "keep"),
        ("const_txt", "none", "keep", "none", "drop"),
    ]
    return d.sparkSession.createDataFrame(steps, _STEPS)


def _ntz(d: DataFrame) -> DataFrame:
    return d.select(*(F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in d.dtypes))


_FENCE = "greatest({q}1 - 1.5 * ({q}3 - {q}1), least({q}3 + 1.5 * ({q}3 - {q}1), {c}))"
_APPLIED = f"""SELECT event_id, ts, user_id, event_type, round(v, 6) AS v, round(coalesce(v_trail, (SELECT quantile_cont(v_trail, 0.5) FROM o)), 6) AS v_trail, round(v_block, 6) AS v_block, round(v_zero, 6) AS v_zero, num_txt, date_txt, flag_txt, t_gap, const_num FROM
 (SELECT * REPLACE (last_value(v IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v) FROM o) WHERE t_gap IS NOT NULL AND NOT coalesce(gone, false)"""
_on("clean_apply_recipe", lambda d: _ntz(_rounded(clean.apply_recipe(d, _plan(d), SPEC, 24))), f""", q AS (SELECT quantile_cont(v, 0.25) AS v1, quantile_cont(v, 0.75) AS v3, quantile_cont(v_trail, 0.015) AS lo, quantile_cont(v_trail, 0.985) AS hi, quantile_cont(v_block, 0.25) AS b1, quantile_cont(v_block, 0.75) AS b3 FROM d),
 o AS MATERIALIZED (SELECT event_id, ts, user_id, event_type, CASE WHEN v IS NOT NULL THEN {_FENCE.format(q="v", c="v")} END AS v, CASE WHEN v_trail IS NOT NULL THEN greatest(lo, least(hi, v_trail)) END AS v_trail, v_block, ln(1 + greatest(v_zero, 0)) AS v_zero,
 CASE WHEN {_NUMBER.replace('@', 'num_txt')} THEN try_cast(num_txt AS DOUBLE) END AS num_txt, try_cast(date_txt AS TIMESTAMP) AS date_txt, CASE WHEN lower(flag_txt) IN ('yes', 'true', '1') THEN true WHEN lower(flag_txt) IN ('no', 'false', '0') THEN false END AS flag_txt, t_gap, const_num,
 v_block < b1 - 1.5 * (b3 - b1) OR v_block > b3 + 1.5 * (b3 - b1) AS gone FROM d, q) {_APPLIED}""")
#: Rows that repeat others but for the key that orders them, which the recipe drops, with nulls in it.
_KEYED = "SELECT CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id END AS event_id, CAST(ts AS DATE) AS ts, user_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS event_type FROM (" + DUP + ")"
_on("clean_apply_dropped_key", lambda d: clean.apply_recipe(d, d.sparkSession.createDataFrame([("event_id", "drop_row", "keep", "none", "drop")], _STEPS), SPEC, 24), "SELECT DISTINCT ts, user_id, event_type FROM d", _KEYED)
_on("clean_apply_dropped_ts", lambda d: clean.apply_recipe(d, d.sparkSession.createDataFrame([("ts", "drop_row", "keep", "none", "drop"), ("event_id", "none", "keep", "none", "drop"), ("v", "forward_fill", "keep", "none", "keep")], _STEPS), SPEC, 24, dedupe=False).groupBy("user_id").agg(F.count("*").alias("n"), F.count("v").alias("v"), F.round(F.sum("v"), 6).alias("total")), "SELECT user_id, count(*) AS n, count(v) AS v, round(sum(v), 6) AS total FROM (SELECT user_id, last_value(v IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v FROM d) GROUP BY user_id")
_on("clean_apply_iso", lambda d: _ntz(clean.apply_recipe(d.select("event_id", "iso_txt", "value"), d.sparkSession.createDataFrame([("value", "interpolate", "keep", "none", "keep")], _STEPS), SeriesSpec("iso_txt", ("event_id",)), 24)), f"SELECT event_id, {_ISO.format(c='iso_txt')} AS iso_txt, value FROM d", STAMPS)

# The frame of the baseline: lineitem in order of its dates and all other columns --------------------
_LINE_ORDER = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
_BY_DATE = SeriesSpec("l_shipdate", _LINE_ORDER)
_LW = "(ORDER BY l_shipdate, " + ", ".join(_LINE_ORDER) + " ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING)"
_add("outlier_temporal_lineitem", lambda s, d: diagnose.outliers_temporal(s.read.parquet(f"{d}/lineitem.parquet"), "l_extendedprice", _BY_DATE, 24), f"SELECT 'l_extendedprice' AS col, round(count(*) FILTER (WHERE v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)) * 100.0e0 / count(*), 6) AS temporal_pct FROM (SELECT l_extendedprice AS v, quantile_cont(l_extendedprice, 0.25) OVER {_LW.format(a=12, b=11)} AS a, quantile_cont(l_extendedprice, 0.75) OVER {_LW.format(a=12, b=11)} AS b FROM lineitem)")


def _seasonal_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("v", F.col("l_extendedprice"))
    out = clean.seasonal_repair(line, "v", _BY_DATE, 7)
    return out.agg(F.count("*").alias("n"), F.count_if(F.col("v") != F.col("l_extendedprice")).alias("repaired"), F.round(F.avg("v"), 4).alias("mean"))


_add("seasonal_lineitem", _seasonal_lineitem, f"""WITH t AS (SELECT l_extendedprice AS y, avg(l_extendedprice) OVER {_LW.format(a=3, b=3)} AS trend, (row_number() OVER (ORDER BY l_shipdate, {", ".join(_LINE_ORDER)}) - 1) % 7 AS phase FROM lineitem),
 r AS (SELECT y, trend, avg(y - trend) OVER (PARTITION BY phase) AS season FROM t), m AS (SELECT quantile_cont(y - trend - season, 0.5) AS md FROM r), a AS (SELECT quantile_cont(abs(y - trend - season - md), 0.5) AS mad FROM r, m),
 v AS (SELECT y, CASE WHEN mad > 0 AND abs(y - trend - season - md) > 3.5 * 1.4826 * mad THEN trend + season ELSE y END AS v FROM r, m, a) SELECT count(*) AS n, count(*) FILTER (WHERE v <> y) AS repaired, round(avg(v), 4) AS mean FROM v""")

# Panels: statistics of each series for itself -----------------------------------------------------
_BY, _MEASURED = ("user_id",), ["v", "v_trail", "v_block", "v_zero"]
_PW = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING)"
_PQ = "(SELECT *, {q} FROM d)".replace("{q}", ", ".join(f"quantile_cont(v, {p}) OVER (PARTITION BY user_id) AS {n}" for n, p in (("q1", 0.25), ("q3", 0.75), ("lo", 0.015), ("hi", 0.985), ("md", 0.5))) + ", avg(v) OVER (PARTITION BY user_id) AS m, count(v) OVER (PARTITION BY user_id) AS n")
_clean("clean_winsorize_panel", lambda d: clean.winsorize(d, "v", series=_BY), "CASE WHEN v IS NOT NULL THEN greatest(lo, least(hi, v)) END", _PQ)
_clean("clean_clip_panel", lambda d: clean.clip_iqr(d, "v", series=_BY), f"CASE WHEN v IS NOT NULL THEN {_FENCE.format(q='q', c='v')} END", _PQ)
_clean("clean_remove_panel", lambda d: clean.without_outliers(d, "v", series=_BY), "v", f"{_PQ} WHERE NOT coalesce(v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1), false)")
_clean("clean_mean_fill_panel", lambda d: clean.fill_with(d, "mean", "v", series=_BY), "coalesce(v, m)", _PQ)
_clean("clean_median_fill_panel", lambda d: clean.fill_with(d, "median", "v", series=_BY), "coalesce(v, md)", _PQ)
_PANEL_W = 80  # some series have fewer values than that at every size, others more
_clean("clean_rolling_panel", lambda d: clean.rolling_iqr(d, "v", PANEL, _PANEL_W), f"CASE WHEN v IS NULL THEN NULL WHEN n >= {_PANEL_W} THEN greatest(a - 1.5 * (b - a), least(b + 1.5 * (b - a), v)) ELSE {_FENCE.format(q='q', c='v')} END", f"(SELECT *, quantile_cont(v, 0.25) OVER {_PW.format(a=_PANEL_W // 2, b=_PANEL_W // 2 - 1)} AS a, quantile_cont(v, 0.75) OVER {_PW.format(a=_PANEL_W // 2, b=_PANEL_W // 2 - 1)} AS b FROM {_PQ})")
_UP, _DOWN = "(PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)", "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_on("seasonal_decompose_panel", lambda d: _rounded(clean.seasonal_repair(d.select("event_id", "ts", "user_id", "v"), "v", PANEL, 6).select("event_id", "v")), f""", f AS (SELECT event_id, ts, user_id, v, coalesce(last_value(v IGNORE NULLS) OVER {_UP}, first_value(v IGNORE NULLS) OVER {_DOWN}) AS y FROM d),
 t AS (SELECT *, avg(y) OVER {_PW.format(a=3, b=3)} AS trend, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 6 AS phase FROM f),
 s AS (SELECT *, avg(y - trend) OVER (PARTITION BY user_id, phase) AS season FROM t), r AS (SELECT *, y - trend - season AS res FROM s),
 m AS (SELECT *, quantile_cont(res, 0.5) OVER (PARTITION BY user_id) AS md FROM r), a AS (SELECT *, quantile_cont(abs(res - md), 0.5) OVER (PARTITION BY user_id) AS mad FROM m)
 SELECT event_id, round(CASE WHEN mad > 0 AND abs(res - md) > 3.5 * 1.4826 * mad THEN trend + season ELSE v END, 6) AS v FROM a""")
_on("outlier_panel", lambda d: diagnose.outliers_by_series(d, ["v", "v_zero"], _BY), " UNION ALL ".join(f"""SELECT user_id, '{c}' AS col, coalesce(round(count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) * 100.0e0 / nullif(count({c}), 0), 6), 0) AS iqr_pct,
 coalesce(round(count(*) FILTER (WHERE s > 0 AND abs({c} - m) > 3 * s) * 100.0e0 / nullif(count({c}), 0), 6), 0) AS zscore_pct, coalesce(round(count(*) FILTER (WHERE mad > 0 AND abs({c} - md) > 3 * mad) * 100.0e0 / nullif(count({c}), 0), 6), 0) AS mad_pct
 FROM (SELECT *, quantile_cont(abs({c} - md), 0.5) OVER (PARTITION BY user_id) AS mad FROM (SELECT user_id, {c}, avg({c}) OVER w AS m, stddev_samp({c}) OVER w AS s, quantile_cont({c}, 0.5) OVER w AS md, quantile_cont({c}, 0.25) OVER w AS q1, quantile_cont({c}, 0.75) OVER w AS q3 FROM d WINDOW w AS (PARTITION BY user_id))) GROUP BY user_id""" for c in ("v", "v_zero")))
_on("outlier_temporal_panel", lambda d: diagnose.outliers_temporal(d, ["v", "v_block"], PANEL, 24, by_series=True), " UNION ALL ".join(f"SELECT user_id, '{c}' AS col, CASE WHEN count(*) >= 30 THEN round(count(*) FILTER (WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) * 100.0e0 / count(*), 6) END AS temporal_pct FROM (SELECT user_id, {c}, quantile_cont({c}, 0.25) OVER w AS a, quantile_cont({c}, 0.75) OVER w AS b FROM d WHERE {c} IS NOT NULL WINDOW w AS {_PW.format(a=12, b=11)}) GROUP BY user_id" for c in ("v", "v_block")))
_on("outlier_temporal_all", lambda d: diagnose.outliers_temporal(d, _MEASURED, SPEC, 24), _each(_MEASURED, f"SELECT '@' AS col, CASE WHEN count(*) >= 30 THEN round(count(*) FILTER (WHERE @ < a - 1.5 * (b - a) OR @ > b + 1.5 * (b - a)) * 100.0e0 / count(*), 6) END AS temporal_pct FROM (SELECT @, quantile_cont(@, 0.25) OVER w AS a, quantile_cont(@, 0.75) OVER w AS b FROM d WHERE @ IS NOT NULL WINDOW w AS (ORDER BY ts NULLS LAST, event_id ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING))"), _NULL_TS)

# Gate --------------------------------------------------------------------------------------------
_AS_OF = "2024-02-01 00:00:00"


def _after(d: DataFrame) -> DataFrame:
    return d.where(_LOSSY).withColumn("v", F.when(F.col("event_id") % 100 == 1, None).otherwise(F.col("v"))).withColumn("v_zero", F.lit(1.0)).withColumn("ts", F.when(F.col("event_id") % 1000 == 3, F.expr("ts + INTERVAL 3650 DAYS")).otherwise(F.col("ts")))


_COLS = ["event_id", "ts", "v", "v_zero"]
_AFT = f"WITH d AS MATERIALIZED ({DIRTY.replace('AS STRING', 'AS VARCHAR')}), a AS (SELECT event_id, CASE WHEN event_id % 1000 = 3 THEN ts + INTERVAL 3650 DAY ELSE ts END AS ts, CASE WHEN event_id % 100 = 1 THEN NULL ELSE v END AS v, 1.0e0 AS v_zero FROM d WHERE {_LOSSY}), "
_CHECKS = {
    "row_loss": "SELECT 'row_loss' AS \"check\", (SELECT count(*) FROM d) - count(*) <= 0.15 * (SELECT count(*) FROM d) AS passed, 'blocking' AS severity, CAST((SELECT count(*) FROM d) - count(*) AS VARCHAR) AS detail FROM a",
    "series_length": "SELECT 'series_length', count(*) >= 30, 'blocking', CAST(count(*) AS VARCHAR) FROM a",
    "null_regression": "SELECT 'no_null_regression', NOT w, 'blocking', CASE WHEN w THEN 'v' ELSE '' END FROM (SELECT (SELECT (count(*) - count(v)) * 100.0e0 / count(*) FROM a) - (SELECT (count(*) - count(v)) * 100.0e0 / count(*) FROM d) > 0.1 AS w)",
    "variance": "SELECT 'numeric_variance', w = '', 'blocking', w FROM (SELECT CASE WHEN (SELECT stddev_samp(v_zero) FROM d) > 0 AND (SELECT stddev_samp(v_zero) FROM a) = 0 THEN 'v_zero' ELSE '' END AS w)",
    "ts_nulls": "SELECT 'timestamp_nulls', count(*) = count(ts), 'blocking', CAST(count(*) - count(ts) AS VARCHAR) FROM a",
    "forecastable": "SELECT 'forecastable_columns', k >= 1, 'blocking', CAST(k AS VARCHAR) FROM (SELECT CAST(stddev_samp(event_id) > 0 AS INTEGER) + CAST(stddev_samp(v) > 0 AS INTEGER) + CAST(stddev_samp(v_zero) > 0 AS INTEGER) AS k FROM a)",
    "monotonic": "SELECT 'timestamp_monotonic', count(*) = 0, 'blocking', CAST(count(*) AS VARCHAR) FROM (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS p FROM a) WHERE ts < p",
    "future_ts": f"SELECT 'future_timestamps', count(*) = 0, 'warning', CAST(count(*) AS VARCHAR) FROM a WHERE ts > TIMESTAMP '{_AS_OF}' + INTERVAL 1 DAY",
    "seasonal_history": "SELECT 'seasonal_history', count(*) >= 48, 'warning', CAST(count(*) AS VARCHAR) FROM a",
}
_GATE: dict[str, Callable[[DataFrame, DataFrame], gate.Outcome]] = {
    "row_loss": lambda d, a: gate.row_loss(measured(d), measured(a)),
    "series_length": lambda d, a: gate.series_length(measured(a)),
    "null_regression": lambda d, a: gate.null_regression(measured(d), measured(a), []),
    "variance": lambda d, a: gate.variance(measured(d), measured(a)),
    "ts_nulls": lambda d, a: gate.ts_nulls(measured(a), "ts"),
    "forecastable": lambda d, a: gate.forecastable(measured(a)),
    "future_ts": lambda d, a: gate.future(measured(a, _AS_OF), "ts"),
    "seasonal_history": lambda d, a: gate.seasonal_history(measured(a), 24),
}


def _gated(made: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = _dirty(spark, sf_dir).select(*_COLS)
        return made(d, _after(d))

    return query


_CHECKED = {n: lambda d, a, f=f: gate.checks(d.sparkSession, f(d, a)) for n, f in _GATE.items()} | {"monotonic": lambda d, a: gate.monotonic(a, "ts", BY_KEY)}
for _n, _made in _CHECKED.items():
    _add(f"gate_{_n}", _gated(_made), f'{_AFT} c("check", passed, severity, detail) AS ({_CHECKS[_n]}) SELECT * FROM c')
_add("gate_verdict", _gated(lambda d, a: gate.verdict(gate.validate(d, a, [], SPEC, 24, _AS_OF, BY_KEY))), f'{_AFT} c("check", passed, severity, detail) AS (' + " UNION ALL ".join(_CHECKS.values()) + """) SELECT bool_and(passed OR severity = 'warning') AS passed, coalesce(string_agg("check", ',' ORDER BY "check") FILTER (WHERE NOT passed AND severity = 'warning'), '') AS warnings FROM c""")


# Sinks -------------------------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    return fresh_folder(spark, "artifacts")


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark) + "/orders.csv"
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    df.write.option("header", True).csv(path)
    return readers.read_source(spark, path, schema=", ".join(f"{c} {t}" for c, t in df.dtypes))


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _folder(spark)
    runs.write_cleaned(spark.read.parquet(f"{sf_dir}/events.parquet"), root, "run_1", "ts", ["event_id"])
    return runs.artifact(spark, root, "cleaned")


def _cleaned_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the files of a cleaned run, written from shuffled rows, hold them in time order."""
    root = _folder(spark)
    seen = runs.write_cleaned(spark.read.parquet(f"{sf_dir}/events.parquet").repartition(5, "user_id"), root, "run_1", "ts", ["event_id"], partitions=7)
    files = spark.read.parquet(f"{root}/cleaned")
    return runs.out_of_order(files, "ts").withColumn("rows", F.lit(seen.rows).cast("long")).withColumn("missing", F.lit(seen.nulls["ts"]).cast("long"))


def _artifact(kind: str, made: Callable[[DataFrame], DataFrame]) -> Query:
    """Written twice, as by a driver that was started again: one copy stays."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = _folder(spark)
        for _ in range(2):
            runs.write_artifact(made(_dirty(spark, sf_dir)), root, kind, "run_1")
        return runs.artifact(spark, root, kind)

    return query


_KINDS = ("run_0", "run_1", "run_2")


def _written_runs(spark: SparkSession, sf_dir: str) -> str:
    """Three runs, each over a third of the events, that got to the first, second and last stage; and one that broke off."""
    root, d = _folder(spark), _dirty(spark, sf_dir)
    for k, run in enumerate(_KINDS):
        mine = d.where(F.col("event_id") % 3 == k).select("event_id", "ts", "v", "const_txt")
        before = runs.write_raw(mine, root, run, f"events {k}")
        if k > 0:
            runs.write_artifact(profile.nulls(mine), root, "payload", run)
        if k > 1:
            steps = spark.createDataFrame([("v", "drop_row", "keep", "none", "keep"), ("const_txt", "none", "keep", "none", "drop")], _STEPS)
            runs.write_artifact(steps, root, "recipe", run)
            after = runs.write_cleaned(clean.apply_recipe(mine, steps, SPEC, 24), root, run, "ts", ["event_id"])
            runs.write_artifact(clean.report(before, after), root, "report", run)
    broken = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/metadata/run_id=run_9/_temporary")
    broken.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(broken)
    return root


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.run_summary(spark, _written_runs(spark, sf_dir))
    lost = F.get_json_object(F.col("report")[0], "$.rows_removed").cast("long")
    return out.select("run_id", "rows", "cols", "source", F.size("payload").cast("long").alias("payload_columns"), F.size("recipe").cast("long").alias("recipe_columns"), lost.alias("rows_removed"), F.col("gate").isNull().alias("not_gated"))


def _sketch_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four runs, each over a quarter of lineitem, leave sketches; counts that their sum tells, and whether its estimates are near what is exactly so."""
    root, whole = _folder(spark), spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    for k in range(4):
        runs.write_artifact(sketches.sketched(whole.where(F.col("l_orderkey") % 4 == k)), root, "sketch", f"run_{k}")
    found = sketches.estimated(sketches.merged(runs.artifact(spark, root, "sketch")))
    exact = profile.cardinality(whole, whole.columns).withColumnRenamed("distinct_count", "distinct")
    exact = exact.join(profile.statistics(whole).select("col", "q1", "median", "q3", (F.col("max") - F.col("min")).alias("range")), "col", "left")
    near = [F.abs(F.col("quantiles")[i] - F.col(q)) <= 0.02 * F.col("range") for i, q in enumerate(("q1", "median", "q3"))]
    few = F.col("distinct") <= 10
    return found.join(exact, "col").select("col", "n", "null_count", (F.abs(F.col("distinct_count") / F.col("distinct") - 1) < 0.04).alias("distinct_near"), (near[0] & near[1] & near[2]).alias("quantiles_near"), F.when(few, F.get("top_values", F.lit(0))["freq"]).alias("top_freq"))


_add("src_csv", _csv, "SELECT * FROM orders")
_add("sink_raw", _artifact("raw", lambda d: d), f"SELECT *, 'run_1' AS run_id FROM ({DIRTY.replace('AS STRING', 'AS VARCHAR')})")
_add("sink_artifacts", _artifact("profile", profile.nulls), f"WITH d AS MATERIALIZED ({DIRTY.replace('AS STRING', 'AS VARCHAR')}) " + _each(_ALL, "SELECT '@' AS col, count(*) - count(@) AS null_count, round((count(*) - count(@)) * 100.0e0 / count(*), 6) AS null_pct, 'run_1' AS run_id FROM d"))
_add("sink_cleaned", _cleaned, "SELECT *, 'run_1' AS run_id FROM events")
_add("sink_cleaned_order", _cleaned_order, "SELECT CAST(0 AS BIGINT) AS falls, count(*) AS rows, count(*) - count(ts) AS missing FROM events")
_LINE_COLUMNS = [*_NUMBERS_OF["lineitem"].split(), "l_returnflag", "l_linestatus", "l_shipdate"]
_add("profile_sketches", _sketch_runs, " UNION ALL ".join(f"SELECT '{c}' AS col, (SELECT count(*) FROM lineitem) AS n, (SELECT count(*) - count({c}) FROM lineitem) AS null_count, true AS distinct_near, {'true' if c in _NUMBERS_OF['lineitem'].split() else 'NULL'} AS quantiles_near, CASE WHEN (SELECT count(DISTINCT {c}) FROM lineitem) <= 10 THEN (SELECT max(k) FROM (SELECT count(*) AS k FROM lineitem GROUP BY {c})) END AS top_freq" for c in _LINE_COLUMNS))
_LIST = "SELECT 'run_' || CAST(event_id % 3 AS VARCHAR) AS run_id, count(*) AS rows, CAST(4 AS BIGINT) AS cols, 'events ' || CAST(event_id % 3 AS VARCHAR) AS source, event_id % 3 > 0 AS has_stage2, event_id % 3 > 1 AS has_stage3 FROM d GROUP BY event_id % 3"
_add("run_listing", lambda s, d: runs.run_listing(s, _written_runs(s, d)), f"{_DUCK_DIRTY.rstrip(', ')} {_LIST}")
_add("run_summary", _summary, f"{_DUCK_DIRTY.rstrip(', ')} SELECT run_id, rows, cols, source, CASE WHEN has_stage2 THEN 4 END AS payload_columns, CASE WHEN has_stage3 THEN 2 END AS recipe_columns, CASE WHEN has_stage3 THEN (SELECT count(*) FROM d WHERE event_id % 3 = 2 AND v IS NULL) END AS rows_removed, true AS not_gated FROM ({_LIST})")


def _planned(p: DataFrame, ts: str | None, period: int) -> DataFrame:
    """The recipe that follows from facts: defaults, forced casts, sanitized."""
    return recipe.sanitized(recipe.forced_type_fix(recipe.default_recipe(p, ts, period), p), p, ts)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile, diagnose, plan, clean and gate the dirty events, all their columns; the checks as rows.

    Timestamp, season and whether to remove repeats follow from the table; the cleaned run is measured while it is written.
    """
    d, root = _dirty(spark, sf_dir), _folder(spark)
    before = runs.write_raw(d, root, "run_1", "events")
    rates = stored(profile.text_rates(d))
    stamps = [r.col for r in profile.datetime_columns(profile.dtypes(d, rates)).collect()]
    frequencies = stored(diagnose.grids(d, stamps))
    about = diagnose.table_facts(d, stamps, frequencies=frequencies).first()
    choice = recipe.options(frequencies, duplicates=about.duplicate_rows).first()
    spec = SeriesSpec(choice.timestamp_col, ("event_id",))
    known = stored(diagnose.facts(d, spec, choice.period, rates=rates))
    plan = stored(_planned(known, choice.timestamp_col, choice.period))
    out = clean.apply_recipe(d, plan, spec, choice.period, choice.drop_duplicates, choice.sort_by_timestamp)
    ties = [c for c in spec.ties if c in out.columns]
    after = runs.write_cleaned(out, root, "run_1", spec.ts, ties, as_of=_AS_OF)
    fixed = [r.col for r in plan.where("type_fix <> 'none'").collect()]  # a row for each column
    written = spark.read.parquet(runs.artifact_path(root, "cleaned", "run_1"))
    return gate.validate(before, written, fixed, spec, choice.period, _AS_OF, seen=after)


_add("pipeline_checks", flagship)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
