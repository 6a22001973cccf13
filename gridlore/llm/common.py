"""Helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def whole_text(docs: DataFrame) -> DataFrame:
    """doc_id and text, null as empty; other columns are not read."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def packed(docs: DataFrame) -> DataFrame:
    """All columns in one, so that names of added columns cannot clash with them."""
    return docs.select(F.struct("*").alias("_row"))


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("_row.*")


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write an intermediate table small, and let go of the shuffle files behind it, which nothing reads any more.

    Spark has that as a setting of the session, which is put back after the write. A job that another thread starts meanwhile
    lets go of its own shuffle files as well, once it has ended; its result is the same.
    """
    path = scratch_path(df.sparkSession, name)
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove the files of written tables that nothing reads any more, to keep the peak of disk low."""
    for t in tables:
        jvm, conf = t.sparkSession.sparkContext._jvm, t.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
