"""Tables in the shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from netloom.functions.ship import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only
    where that is unset: a temporary one in local mode, otherwise the warehouse's."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        local = spark.sparkContext.master.startswith("local")
        at = os.path.join(tempfile.gettempdir(), "checkpoints", "netloom") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_netloom"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Spark then deletes an execution's shuffle files at its end, and not when the driver next collects garbage.
_CLEANS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder, and read again.  The table goes when the application ends,
    what was shuffled for it as soon as it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    cleans = spark.conf.get(_CLEANS, None)
    spark.conf.set(_CLEANS, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANS) if cleans is None else spark.conf.set(_CLEANS, cleans)
    fs, at = _hadoop(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more."""
    fs, at = _hadoop(df.sparkSession, df.stored_at)
    fs.delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
