"""Tables that cut a lineage: written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a local folder where it is unset and all runs on one machine (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root is None:
        root = getattr(spark.sparkContext, "_quillon_scratch", None)
        if root is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = tempfile.mkdtemp(prefix="quillon-")
            spark.sparkContext._quillon_scratch = root
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its plan is short and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/quillon/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all scratch tables under the shared folder: for the end of a job, when nothing reads them any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/quillon")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
