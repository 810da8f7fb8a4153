"""Tables between steps, in a folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir.

    Where that is unset it is set here: on one machine to a temporary folder, on a cluster to one in the warehouse.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        folder = f"file://{tempfile.mkdtemp(prefix='condspark-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_condspark"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/condspark-{spark.sparkContext.applicationId}"


def table(df: DataFrame, name: str) -> DataFrame:
    """df, written to a shared table and read back, which cuts the lineage and survives lost executors."""
    to = f"{root(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)
