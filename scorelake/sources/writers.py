"""Sinks: cases per user, reports by run, typed tables laid out for lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS_PER_FILE = 1_000_000


def write_cases(cases: DataFrame, path: str, by: str = "user_id", combined: bool = True) -> None:
    """JSON lines in one folder per user, and one folder with everything."""
    cases.write.mode("overwrite").option("maxRecordsPerFile", RECORDS_PER_FILE).partitionBy(by).json(f"{path}/by_{by}")
    if combined:
        cases.write.mode("overwrite").option("maxRecordsPerFile", RECORDS_PER_FILE).json(f"{path}/all")


def write_report(results: DataFrame, path: str) -> None:
    """Results by benchmark, dataset, target label and run; a run written again replaces itself only."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "benchmark", "dataset", "target_label", "run_ts").parquet(path)


def bucketed(df: DataFrame, n_buckets: int, user: str = "user_id") -> DataFrame:
    return df.withColumn("user_bucket", F.pmod(F.xxhash64(user), F.lit(n_buckets)).cast("int"))


def build_tables(df: DataFrame, path: str, n_buckets: int = 256, sort: Sequence[str] = ("user_id", "indicator", "time"),
                 time: str = "time", changed_users: DataFrame | None = None) -> None:
    """Parquet by user bucket, sorted for row-group pruning.

    Writers are spread over bucket and month, so that a user with very many rows fills several files.
    With `changed_users`, only the buckets they fall into are written again.
    """
    rows = bucketed(df, n_buckets)
    if changed_users is not None:
        stale = bucketed(changed_users.select("user_id").distinct(), n_buckets).select("user_bucket").distinct()
        rows = rows.join(stale, "user_bucket", "left_semi")
    spread = rows.repartition("user_bucket", F.trunc(F.col(time).cast("date"), "month"))
    spread.sortWithinPartitions("user_bucket", *sort).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("user_bucket").parquet(path)


def read_user(spark: SparkSession, path: str, user_id, n_buckets: int = 256) -> DataFrame:
    """One user's rows: the bucket is a constant that prunes folders, the sort order prunes row groups."""
    table = spark.read.parquet(path)
    user = F.lit(user_id).cast(table.schema["user_id"].dataType)
    return table.where((F.col("user_bucket") == F.pmod(F.xxhash64(user), F.lit(n_buckets)).cast("int")) & (F.col("user_id") == user))
