"""How a text column writes its timestamps: one format for a column, chosen by how much of it each of them reads.

A format has a shape, which a text must match before it is parsed: cells of another kind cost a comparison and no exception.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CLOCK = r"( \d{1,2}:\d{2}(:\d{2})?)?"
_OFFSET = r"(Z|[+-]\d{2}(:?\d{2})?)?"


@dataclass(frozen=True)
class Format:
    """pattern is Spark's, with optional parts in brackets; None for ISO, which a cast reads."""

    name: str
    shape: str
    pattern: str | None = None

    def read(self, text: Column) -> Column:
        """A timestamp, or null for a text of another format or without such a day."""
        if self.pattern is None:
            # a cast knows hours with minutes behind an offset's sign only
            parsed = F.regexp_replace(F.regexp_replace(F.trim(text), r"(\d:\d{2}(?::\d{2}(?:\.\d+)?)?) ?([+-]\d{2})$", "$1$2:00"), r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp")
        else:
            parsed = F.try_to_timestamp(F.trim(text), F.lit(self.pattern))
        return F.when(F.trim(text).rlike(self.shape), parsed)


#: Fixed order: of formats that read equally much of a column the first one wins.
FORMATS = (
    Format("iso", rf"^\d{{4}}-\d{{2}}-\d{{2}}([T ]\d{{2}}:\d{{2}}(:\d{{2}}(\.\d{{1,9}})?)? ?{_OFFSET})?$"),
    Format("yyyy/MM/dd", rf"^\d{{4}}/\d{{1,2}}/\d{{1,2}}{_CLOCK}$", "yyyy/M/d[ H:mm[:ss]]"),
    Format("MM/dd/yyyy", rf"^\d{{1,2}}/\d{{1,2}}/\d{{4}}{_CLOCK}$", "M/d/yyyy[ H:mm[:ss]]"),
    Format("dd/MM/yyyy", rf"^\d{{1,2}}/\d{{1,2}}/\d{{4}}{_CLOCK}$", "d/M/yyyy[ H:mm[:ss]]"),
    Format("dd-MM-yyyy", rf"^\d{{1,2}}-\d{{1,2}}-\d{{4}}{_CLOCK}$", "d-M-yyyy[ H:mm[:ss]]"),
    Format("dd.MM.yyyy", rf"^\d{{1,2}}\.\d{{1,2}}\.\d{{4}}{_CLOCK}$", "d.M.yyyy[ H:mm[:ss]]"),
)
BY_NAME = {f.name: f for f in FORMATS}


def _reads(column: str) -> list[Column]:
    return [F.count(f.read(F.col(column).cast("string"))).alias(f.name) for f in FORMATS]


def counts(column: str) -> Column:
    """A struct aggregate: texts that are there (n), that the best format reads (parsed), and its name (null if none reads any)."""
    best = F.array_max(F.array(*(F.struct(x.alias("parsed"), F.lit(-i).alias("place"), F.lit(f.name).alias("format")) for i, (x, f) in enumerate(zip(_reads(column), FORMATS, strict=True)))))
    return F.struct(F.count(F.col(column)).alias("n"), best["parsed"].alias("parsed"), F.when(best["parsed"] > 0, best["format"]).alias("format"))


def elected(df: DataFrame, columns: Iterable[str]) -> dict[str, tuple[str | None, int, int]]:
    """For each text column its format, how many of its texts that reads, and how many there are: one pass for all of them.

    The format is null where none reads any text; columns of other types don't belong here. A row a column reaches the driver.
    """
    columns = list(columns)
    if not columns:
        return {}
    row = df.agg(*(counts(c).alias(c) for c in columns)).first()
    return {c: (row[c]["format"], row[c]["parsed"], row[c]["n"]) for c in columns}


def election(df: DataFrame, columns: list[str]) -> DataFrame:
    """col, format, parsed, n: elected() as a table."""
    rows = F.array(*(F.struct(F.lit(c).alias("col"), F.col(f"`{c}`.format").alias("format"), F.col(f"`{c}`.parsed").alias("parsed"), F.col(f"`{c}`.n").alias("n")) for c in columns))
    return df.agg(*(counts(c).alias(c) for c in columns)).select(F.explode(rows).alias("r")).select("r.*")


def timestamps(df: DataFrame, columns: Iterable[str]) -> dict[str, Column]:
    """Expressions that read each text column by its elected format, null where that doesn't fit; columns of other types are cast."""
    types = dict(df.dtypes)
    texts = [c for c in columns if types[c] == "string"]
    chosen = elected(df, texts)
    out = {c: F.col(c).cast("timestamp") for c in columns if types[c] not in ("string",)}
    for c in texts:
        name = chosen[c][0]
        out[c] = BY_NAME[name].read(F.col(c)) if name else F.lit(None).cast("timestamp")
    return out
