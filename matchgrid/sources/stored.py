"""Tables written to the cluster's shared folder: lineage is cut there, and a lost executor costs only its tasks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, tag: str) -> str:
    """A path of its own under the folder that ``spark.checkpoint.dir`` names."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{folder.rstrip('/')}/matchgrid-steps/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder, and read again."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop_stored(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "stored_at", None)
        if path:
            spark = t.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
