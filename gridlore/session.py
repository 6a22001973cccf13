"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_own: dict[str, tempfile.TemporaryDirectory] = {}  # of sessions on one machine; removed when the process ends


def get_session(app: str = "gridlore", cores: int | None = None, checkpoint_dir: str | None = None) -> SparkSession:
    """A local session for tests and the bench; on a cluster pass your own session instead.

    ``checkpoint_dir`` is the folder for intermediate tables; without it the session gets one that ends with it.
    """
    cores = cores or os.cpu_count() or 4
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.files.minPartitionNum", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .config(SETTING, checkpoint_dir or _own_folder(app))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _own_folder(key: str) -> str:
    if key not in _own:
        _own[key] = tempfile.TemporaryDirectory(prefix="gridlore-", ignore_cleanup_errors=True)
    return _own[key].name


def scratch_folder(spark: SparkSession) -> str:
    """The application's folder below ``spark.checkpoint.dir``, which all executors share.

    Only a session on one machine that leaves the setting out gets a folder of its own.
    """
    base = spark.conf.get(SETTING, None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        base = _own_folder(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/gridlore/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for an intermediate table."""
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several later passes read; the files also cut the lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Remove what the application has written below the shared folder, once its results have been stored."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
