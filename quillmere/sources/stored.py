"""Tables that cut a plan: written once to the folder in spark.checkpoint.dir, read by what follows."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder; where it is unset on a local master (tests), a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quillmere-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def file_system(spark: SparkSession, path: str) -> tuple:
    """(file system, path) as Hadoop objects, for any store that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own, made now, once, however often the result is read; gone when the program ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            fs, where = file_system(spark, path)
            fs.delete(where, True)
        except Exception:  # noqa: BLE001  the JVM may have ended already
            pass

    atexit.register(drop)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as the session runs at once, where its source has fewer splits than half of them
    (one small file of one row group); larger sources, and plans with an exchange of their own, are returned as they are."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    if any(step in plan for step in ("Join", "Aggregate", "Window", "Sort", "Repartition")):
        return df  # asking for its splits would run it
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df
