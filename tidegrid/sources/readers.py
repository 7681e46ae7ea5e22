"""Sources: files, tables, SQL queries, databases."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_.]*$")
_TOKEN = re.compile(r"'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/|;", re.S)


def read_source(spark: SparkSession, path: str, row_limit: int | None = None, order: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """A reader by suffix; a limit with an order is repeatable."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind == "csv":
        reader = spark.read.option("header", True)
        df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    elif kind in ("parquet", "orc", "json"):
        df = getattr(spark.read, kind)(path)
    else:
        raise ValueError(f"no reader for .{kind}")
    return df if row_limit is None else (df.orderBy(*order) if order else df).limit(row_limit)


def table_scan(spark: SparkSession, name: str, row_limit: int | None = None) -> DataFrame:
    if not _NAME.match(name):
        raise ValueError(f"not a table name: {name}")
    df = spark.table(name)
    return df if row_limit is None else df.limit(row_limit)


def guarded(query: str) -> str:
    """The query if it is one SELECT (or WITH) statement; comments go, literals stay."""
    plain = _TOKEN.sub(lambda m: m[0] if m[0][0] in "';" else " ", query).strip()
    body = plain.rstrip("; \n\t")
    if not re.match(r"(?i)(select|with)\b", body) or ";" in re.sub(r"'(?:[^']|'')*'", "", body):
        raise ValueError("only a single SELECT statement is allowed")
    return body


def sql_query(spark: SparkSession, query: str) -> DataFrame:
    return spark.sql(guarded(query))


def listed_tables(spark: SparkSession) -> list[str]:
    """Names of the session's tables and views that hold user data, ordered."""
    return sorted(t.name for t in spark.catalog.listTables() if not t.name.startswith("_"))


#: How a session is made read-only, by the database's name in its URL; others have no statement for it.
_READ_ONLY = {"postgresql": "SET default_transaction_read_only = on"}


def _named(*names: str) -> str:
    """Checked names as SQL writes them, in quotes: as they are, whatever case the database folds to."""
    for n in names:
        if not _NAME.match(n):
            raise ValueError(f"not a name: {n}")
    return ", ".join(".".join(f'"{part}"' for part in n.split(".")) for n in names)


def jdbc_relation(table: str, row_limit: int | None = None, columns: list[str] | None = None, order: list[str] | None = None) -> str:
    """What a JDBC scan reads: a checked table name, or a query for some of its columns, or its first rows (in an order: repeatable)."""
    if row_limit is None and not columns:
        return _named(table)
    query = f"SELECT {_named(*columns) if columns else '*'} FROM {_named(table)}"
    query += f" ORDER BY {_named(*order)}" if order else ""
    query += f" FETCH FIRST {int(row_limit)} ROWS ONLY" if row_limit is not None else ""
    return f"({query}) AS picked"


@dataclass(frozen=True)
class Split:
    """How a scan is dealt: by ranges of a column between its least and greatest value."""

    column: str
    low: object
    high: object
    partitions: int


def jdbc_split(spark: SparkSession, url: str, table: str, column: str, rows: int = 1_000_000, most: int = 512, **options: str) -> Split | None:
    """Bounds from the database itself: one query for a column's least and greatest value, and how many rows there are.

    Numbers, dates and timestamps can be split; a range for each so many rows, at most `most`. None for a table that one range
    holds, and where the column has one value or none.
    """
    query = f"SELECT MIN({_named(column)}) AS low, MAX({_named(column)}) AS high, COUNT(*) AS n FROM {_named(table)}"
    found = spark.read.format("jdbc").options(url=url, query=query, **options).load().first()
    low, high, n = found
    if low is None or low == high or n <= rows:
        return None
    return Split(column, low, high, min(most, -(-n // rows)))


def jdbc_table(spark: SparkSession, url: str, table: str, column: str | None = None, row_limit: int | None = None, columns: list[str] | None = None, order: list[str] | None = None, rows: int = 1_000_000, **options: str) -> DataFrame:
    """A read-only JDBC scan of a table or of some of its columns, in ranges of a column (rows without a value in it come with the first).

    A row limit is the database's work, and such a scan isn't split; filters on the result go into its query by themselves.
    """
    kind = url.split(":")[1] if url.count(":") > 1 else ""
    reader = spark.read.format("jdbc").options(url=url, dbtable=jdbc_relation(table, row_limit, columns, order), **options)
    if kind in _READ_ONLY:
        reader = reader.option("sessionInitStatement", _READ_ONLY[kind])
    split = jdbc_split(spark, url, table, column, rows, **options) if column and row_limit is None else None
    if split:
        reader = reader.options(partitionColumn=split.column, lowerBound=str(split.low), upperBound=str(split.high), numPartitions=split.partitions)
    return reader.load()
