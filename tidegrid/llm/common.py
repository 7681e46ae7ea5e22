"""Reading tables, the shared folder, and small helpers that every operator here uses."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Space and the five control characters 0x09-0x0D part words.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only a local master gets a temporary folder where the setting is missing.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="tidegrid-")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named


def forgotten(spark: SparkSession, path: str) -> None:
    """Have the driver delete path when it ends: tables under it serve this session only."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends here. The driver deletes it when it ends."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    forgotten(df.sparkSession, path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(df: DataFrame, value: str, keys: list[str], order: str, size: int = 4096) -> DataFrame:
    """df with _before: the sum of value over the key's rows of smaller order (a whole number, unique within the key).

    Stretches of `size` orders are summed first, so that no task holds all rows of a key.
    """
    stretch = df.withColumn("_stretch", F.floor(F.col(order) / size))
    sums = stretch.groupBy(*keys, "_stretch").agg(F.sum(value).alias("_sum"))
    up = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_stretch", F.coalesce(F.sum("_sum").over(up), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*keys, "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = stretch.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0))).join(sums, [*keys, "_stretch"])
    return out.withColumn("_before", F.col("_base") + F.col("_in")).drop("_stretch", "_base", "_in")


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df (stored, with _row: a unique number of which the high bits name a file's part) with its place from 0 among rows of equal keys.

    Rows are numbered within a key and part, and the parts' counts added up, so that no task holds all rows of a frequent key.
    """
    part = df.withColumn("_part", F.shiftright("_row", 16))
    counts = part.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = running(counts, "_n", keys, "_part").drop("_n")
    at = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_row")) - 1
    return part.withColumn("_at", at).join(before, [*keys, "_part"]).withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; plain ASCII takes the faster way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def bitmap(keys: DataFrame, bits: int) -> list[int]:
    """2**bits flags as longs, set where pmod(key, 2**bits) of a row's only column falls.

    A sketch of fixed size, however many rows there are.
    """
    name = keys.columns[0]
    spot = keys.select(F.pmod(F.col(name), F.lit(1 << bits)).alias("b"))
    rows = spot.groupBy(F.expr("shiftright(b, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("m")).collect()
    out = [0] * ((1 << bits) >> 6 or 1)
    for w, m in rows:
        out[w] = m
    return out
