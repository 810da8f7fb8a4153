"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..shared import root

#: Bucketed tables need a name; they are kept out of the user's databases.
DATABASE = "condspark_scratch"


def path(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_go(spark: SparkSession):
    """What is written within needs its shuffle files no more once it is written."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def table(df: DataFrame, name: str, bucket: str | None = None, buckets: int | None = None) -> DataFrame:
    """Write df to a shared table and read it back, which cuts the lineage.

    With ``bucket`` the rows of one key meet in one bucket, so later grouping by it needs no shuffle.
    """
    spark = df.sparkSession
    to = path(spark, name)
    with _shuffles_go(spark):
        if bucket is None:
            df.write.option("compression", "zstd").parquet(to)
            return spark.read.schema(df.schema).parquet(to)
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {DATABASE} LOCATION '{root(spark)}/tables'")
        known = f"{DATABASE}.{name}_{uuid.uuid4().hex[:12]}"
        n = buckets or partitions(spark)
        df.write.format("parquet").option("compression", "zstd").option("path", to).bucketBy(n, bucket).saveAsTable(known)
    return spark.table(known)


def parts(df: DataFrame, by: str, values: list) -> list[DataFrame]:
    """Write df to a folder for each value of ``by`` and read each back, without that column."""
    spark, to = df.sparkSession, path(df.sparkSession, by)
    with _shuffles_go(spark):
        df.write.option("compression", "zstd").partitionBy(by).parquet(to)
    schema = df.drop(by).schema
    found = []
    for v in values:
        folder = f"{to}/{by}={str(v).lower() if isinstance(v, bool) else v}"
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
        found.append(spark.read.schema(schema).parquet(folder) if there else spark.createDataFrame([], schema))
    return found


def drop(*read: DataFrame) -> None:
    """Delete the files of all tables that these read, which must have been written here; nothing may read them afterwards."""
    for df in read:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if f"/condspark-{spark.sparkContext.applicationId}/" not in f"{folder}/":
                raise ValueError(f"not a scratch folder: {folder}")
            where = spark._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def clear(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; results that read them must be written first."""
    spark.sql(f"DROP DATABASE IF EXISTS {DATABASE} CASCADE")
    where = spark._jvm.org.apache.hadoop.fs.Path(root(spark))
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
