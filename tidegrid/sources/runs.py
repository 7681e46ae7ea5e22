"""Artifacts of runs: one folder for each kind and run, replaced as a whole, and what a listing tells about them.

A run's artifact lies under root/kind/run_id=.... It counts once its write has been committed, which Spark marks by a file;
a write that broke off, or one that is under way, isn't seen. Writing it again replaces it, so a retried driver leaves one copy.
Kinds: raw, metadata (what the run took in), payload, recipe, cleaned, report, gate.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import measures, ordering

_MARK = "_SUCCESS"
_RUN = re.compile(r"^[A-Za-z0-9_.-]+$")
METADATA = "rows long, cols long, source string"


def artifact_path(root: str, kind: str, run_id: str) -> str:
    if not _RUN.match(run_id):
        raise ValueError(f"not a run's name: {run_id}")
    return f"{root}/{kind}/run_id={run_id}"


def write_artifact(df: DataFrame, root: str, kind: str, run_id: str) -> None:
    """Rows of a run, in place of what it wrote before; other runs stay. Files appear when all of them are there."""
    df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(artifact_path(root, kind, run_id))


def write_raw(df: DataFrame, root: str, run_id: str, source: str) -> measures.Measures:
    """The raw snapshot and its metadata, measured while it is written."""
    watch = measures.Watch(df)
    write_artifact(watch.df, root, "raw", run_id)
    seen = watch.measures()
    write_artifact(df.sparkSession.createDataFrame([(seen.rows, len(df.columns), source)], METADATA), root, "metadata", run_id)
    return seen


def write_cleaned(df: DataFrame, root: str, run_id: str, ts: str, ties: list[str], partitions: int | None = None, as_of: str | None = None) -> measures.Measures:
    """Range-partitioned and sorted by time, measured while it is written."""
    ranged = df.repartitionByRange(partitions, ts, *ties) if partitions else df.repartitionByRange(ts, *ties)
    watch = measures.Watch(ranged.sortWithinPartitions(ts, *ties), as_of)  # above the exchange, whose sampling would be seen too
    write_artifact(watch.df, root, "cleaned", run_id)
    return watch.measures()


def committed(spark: SparkSession, root: str) -> DataFrame:
    """run_id, kind: a row for each artifact that was written to its end. One look at the folders, none into files."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/run_id=*/{_MARK}")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    rows = []
    for x in found or []:
        run = x.getPath().getParent()
        rows.append((run.getName().partition("=")[2], run.getParent().getName()))
    return spark.createDataFrame(rows, "run_id string, kind string")


def artifact(spark: SparkSession, root: str, kind: str, schema: str | None = None) -> DataFrame | None:
    """All committed runs' rows of a kind with their run_id, in one read; files that can't be read are skipped. None without any run."""
    runs = [r.run_id for r in committed(spark, root).where(F.col("kind") == kind).select("run_id").collect()]
    if not runs:
        return None
    reader = spark.read.option("basePath", f"{root}/{kind}").option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    reader = reader.schema(f"{schema}, run_id string") if schema else reader.option("mergeSchema", False)
    return reader.parquet(*(artifact_path(root, kind, r) for r in runs)).withColumn("run_id", F.col("run_id").cast("string"))


def run_listing(spark: SparkSession, root: str) -> DataFrame:
    """run_id, rows, cols, source, has_stage2 (a payload), has_stage3 (a recipe); newest first. Runs without readable metadata are left out."""
    metadata = artifact(spark, root, "metadata", METADATA)
    if metadata is None:
        return spark.createDataFrame([], f"run_id string, {METADATA}, has_stage2 boolean, has_stage3 boolean")
    stages = committed(spark, root).groupBy("run_id").agg(F.bool_or(F.col("kind") == "payload").alias("has_stage2"), F.bool_or(F.col("kind") == "recipe").alias("has_stage3"))
    return metadata.join(stages, "run_id").select("run_id", "rows", "cols", "source", "has_stage2", "has_stage3").orderBy(F.desc("run_id"))


def run_summary(spark: SparkSession, root: str) -> DataFrame:
    """A row for each listed run: its metadata, payload and recipe (as sorted JSON rows), report and gate; null where it didn't get so far."""
    out = run_listing(spark, root).select("run_id", "rows", "cols", "source")
    for kind in ("payload", "recipe", "report", "gate"):
        found = artifact(spark, root, kind)
        if found is None:
            out = out.withColumn(kind, F.lit(None).cast("array<string>"))
            continue
        # rows here are one for each column, check or run: small, whatever the data
        rows = F.sort_array(F.collect_list(F.to_json(F.struct(*(c for c in found.columns if c != "run_id")))))
        out = out.join(found.groupBy("run_id").agg(rows.alias(kind)), "run_id", "left")
    return out


def out_of_order(cleaned: DataFrame, ts: str) -> DataFrame:
    """One row: falls, how many rows of written files have an earlier stamp than the row before them, in the order of files and rows."""
    placed, stored = ordering.in_storage_order(cleaned)
    stamp = F.col(ts).cast("timestamp")
    return ordering.lagged(placed, stamp, stored, "_before").agg(F.count_if(stamp < F.col("_before")).alias("falls"))
