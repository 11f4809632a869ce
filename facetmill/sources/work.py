"""Work tables in the folder that a cluster shares: written once, read as often as needed, and gone when the application ends."""

from __future__ import annotations

import logging
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)
_TIDIED: set[str] = set()


def work_dir(spark: SparkSession) -> str:
    """A fresh folder under the shared one that the cluster names in spark.checkpoint.dir; an application's folders go when it ends.

    Only where that is unset (tests, a laptop) a local folder is made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            log.warning("spark.checkpoint.dir is unset: work tables go to a folder of the driver, which executors on other machines do not see")
        root = tempfile.mkdtemp(prefix="spark-work-")
        spark.sparkContext.setCheckpointDir(root)
    folder = f"{root.rstrip('/')}/tables/{spark.sparkContext.applicationId}"
    if folder not in _TIDIED:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _TIDIED.add(folder)
    return f"{folder}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    spark, path = df.sparkSession, work_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
