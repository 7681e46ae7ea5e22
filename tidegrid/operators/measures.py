"""What reports and gates need of a table, as one aggregate that can also be observed while the table is written."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.expressions import no_nan


@dataclass(frozen=True)
class Measures:
    """Rows; by column the missing values and (numbers only; null below two values) the standard deviation; late: stamps beyond a day after as_of, by column."""

    rows: int
    nulls: dict[str, int]
    std: dict[str, float | None]
    late: dict[str, int]

    def null_pct(self, column: str) -> float:
        """0 for a column that isn't there, and without rows."""
        return self.nulls.get(column, 0) * 100.0 / self.rows if self.rows else 0.0


def _aggregates(df: DataFrame, as_of: str | None) -> list[Column]:
    out = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(df.schema):
        c = F.col(f"`{f.name}`")
        c = no_nan(c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c
        out.append(F.count(c).alias(f"n{i}"))
        if isinstance(f.dataType, T.NumericType):
            out.append(F.stddev_samp(c).alias(f"s{i}"))
        if as_of and isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out.append(F.count_if(c.cast("timestamp") > F.lit(as_of).cast("timestamp") + F.expr("INTERVAL 1 DAY")).alias(f"l{i}"))
    return out


def _of(df: DataFrame, row: dict) -> Measures:
    names = {i: f.name for i, f in enumerate(df.schema)}
    part = lambda kind: {names[int(k[1:])]: v for k, v in row.items() if k != "rows" and k[0] == kind}
    return Measures(row["rows"], {c: row["rows"] - n for c, n in part("n").items()}, part("s"), part("l"))


def measured(df: DataFrame, as_of: str | None = None) -> Measures:
    """One pass over df; as many numbers as columns reach the driver."""
    return _of(df, df.agg(*_aggregates(df, as_of)).first().asDict())


class Watch:
    """df, which measures itself while an action (a write) runs over it."""

    def __init__(self, df: DataFrame, as_of: str | None = None):
        self._seen = Observation(uuid.uuid4().hex)
        self._schema = df
        self.df = df.observe(self._seen, *_aggregates(df, as_of))

    def measures(self) -> Measures:
        """What the first action over df has seen; waits for it."""
        return _of(self._schema, self._seen.get)
