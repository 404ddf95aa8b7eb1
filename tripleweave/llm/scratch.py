"""Tables written to the folder that the whole cluster shares.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and all runs on one
machine (tests, notebooks) a local folder is made and set; on a cluster that is an error. A table written here cuts the lineage: whatever executor is lost later,
its rows are read again from shared storage instead of being computed again.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI, without a slash at its end."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that all its machines share")
        at = "file://" + tempfile.mkdtemp(prefix="tripleweave-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`written` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def tidied(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files that no live plan needs; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()
