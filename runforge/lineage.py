"""Cutting lineage by a table in the folder that all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """Writes df as a Parquet table to the shared folder and goes on from there.

    Shuffle files that only the write needed go with it. What is written stays until
    discard() or until the folder is cleared.
    """
    spark = df.sparkSession
    path = shared_path(spark)
    clean_up = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean_up)
    spark.conf.set(clean_up, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(clean_up, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of cut() that nothing reads any more: what was made from them has been cut itself."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.cut_path)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir; where it is unset a temporary one, but only on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _temporary()
    return f"{folder}/{uuid.uuid4()}"


@functools.cache
def _temporary() -> str:
    return tempfile.mkdtemp(prefix="spark-runforge-")
