"""Run tables, input snapshots and the run registry as partitioned Parquet."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


MANIFEST = "run string, attempt string, tables array<string>, written_at timestamp"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def committed_runs(spark: SparkSession, path: str) -> DataFrame:
    """``run_id, attempt, tables`` of every whole run; of two attempts that both ended, the first one counts."""
    if not _exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], "run_id string, attempt string, tables array<string>")
    rows = spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{path}/manifest")
    first = rows.groupBy(F.col("run").alias("run_id")).agg(F.min(F.struct("written_at", "attempt", "tables")).alias("m"))
    return first.select("run_id", "m.attempt", "m.tables")


def write_run(run_id: str, tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """One directory per table, partitioned by run and attempt; a run is written once, whole or not at all.

    The manifest is written after all tables and makes the run visible: readers go through it, so what an
    attempt that was cut off has left behind is never read, and the run can be written again. Only
    directories of this attempt are written, so other runs are neither read nor moved.
    """
    if not tables:
        raise ValueError("a run needs a table")
    spark = next(iter(tables.values())).sparkSession
    if committed_runs(spark, path).filter(F.col("run_id") == run_id).take(1):
        raise ValueError(f"run {run_id!r} is there already")
    attempt = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.format(fmt).mode("errorifexists").option("header", "true").save(f"{path}/{name}/run_id={run_id}/attempt={attempt}")
    row = spark.createDataFrame([(run_id, attempt, sorted(tables))], "run string, attempt string, tables array<string>")
    row = row.withColumn("written_at", F.current_timestamp())
    row.coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest/{attempt}")


def read_run_table(spark: SparkSession, path: str, name: str, run_id: str | None = None) -> DataFrame:
    """A table of all whole runs, or of one, with its ``run_id``. Partitions of other attempts are pruned."""
    runs = committed_runs(spark, path).filter(F.array_contains("tables", name))
    if run_id is not None:
        runs = runs.filter(F.col("run_id") == run_id)
    chosen = runs.select(F.col("run_id").alias("__run"), F.col("attempt").alias("__attempt"))
    rows = spark.read.parquet(f"{path}/{name}")
    same = (rows["run_id"].cast("string") == F.col("__run")) & (rows["attempt"] == F.col("__attempt"))
    return rows.join(chosen, same, "left_semi").withColumn("run_id", F.col("run_id").cast("string")).drop("attempt")


def snapshot(
    df: DataFrame, settings: dict, path: str, *, warnings: DataFrame | None = None, accept_warnings: bool = False, name: str = ""
) -> str:
    """Save an input under a new id that is never overwritten; returns the id."""
    spark = df.sparkSession
    if not name.strip():
        raise ValueError("a dataset needs a name")
    if warnings is not None and not accept_warnings and warnings.take(1):
        raise ValueError("review and accept the data adjustments before saving")
    dataset_id = uuid.uuid4().hex
    df.write.mode("errorifexists").parquet(f"{path}/data/dataset_id={dataset_id}")
    row = spark.createDataFrame([(name.strip(), json.dumps(settings, sort_keys=True))], "name string, settings string")
    row = row.withColumn("created_at", F.current_timestamp())
    row.write.mode("errorifexists").parquet(f"{path}/settings/dataset_id={dataset_id}")
    return dataset_id


def read_snapshot(spark: SparkSession, path: str, dataset_id: str) -> tuple[DataFrame, dict]:
    data = spark.read.parquet(f"{path}/data/dataset_id={dataset_id}")
    row = spark.read.parquet(f"{path}/settings/dataset_id={dataset_id}").first()
    return data, json.loads(row["settings"])


def register_run(runs: DataFrame, path: str) -> None:
    """Append finished runs to the registry."""
    runs.write.mode("append").parquet(f"{path}/runs")


def run_list(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), F.desc("run_id"))


def latest_run(runs: DataFrame) -> DataFrame:
    return run_list(runs).limit(1)


def scenarios_of(runs: DataFrame, base_run_id: str) -> DataFrame:
    return runs.filter((F.col("base_run_id") == base_run_id) & F.col("scenario_name").isNotNull())
