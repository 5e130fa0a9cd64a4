"""Several outputs under one commit.

Outputs are written to a folder of their own below the target, and a marker that names the
folder is replaced last, by one rename. Whoever reads through the marker sees all outputs of
one write or all of another; a write that fails leaves the marker, and what it wrote is never
read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

MARKER = "_current"


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the last whole write, None if there is none."""
    marker, fs = _path(spark, f"{path}/{MARKER}")
    if not fs.exists(marker):
        return None
    stream = fs.open(marker)
    try:
        return f"{path}/{stream.readUTF()}"
    finally:
        stream.close()


def write_versioned(spark: SparkSession, path: str, write: Callable[[str], None], overwrite: bool = False) -> str:
    """Has write(folder) write a new version and commits it; a target that has one is an error unless overwritten."""
    if not overwrite and current(spark, path) is not None:
        raise FileExistsError(f"{path} exists")
    version = f"v-{uuid.uuid4()}"
    write(f"{path}/{version}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, fs = _path(spark, f"{path}/.{MARKER}.{version}")
    stream = fs.create(new, True)
    stream.writeUTF(version)
    stream.close()
    replace = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    replace[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else fs.getUri(), conf).rename(fs.makeQualified(new), fs.makeQualified(_path(spark, f"{path}/{MARKER}")[0]), replace)
    return f"{path}/{version}"
