"""Many small run files as one Parquet table that grows.

A table is a folder with data/ (rows by batch and dataset, in files of bounded size), manifest/
(what each batch took: path, length, time, and the reason if the file was left out) and
nothing else. A batch counts once its manifest is there, which is written last: what a failed
run has left behind is never read, and the next run takes the same files again. Files that a
manifest has with their length and time are not opened again; a changed file replaces its rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from runforge.lineage import cut, discard
from runforge.sources import readers

#: Bytes of source files that make one file of the table.
BUNDLE_BYTES = 128 << 20
MANIFEST = "path string, length bigint, modified timestamp, reason string, batch string"


def _slim_results(files: DataFrame, _: DataFrame) -> DataFrame:
    """Without the coverage detail, which is most of a result and which no score needs."""
    parsed = readers.parse_run_results(files)
    slim = F.col("result").withField("cov_info", F.col("result.cov_info").dropFields("detail"))
    return parsed.withColumn("result", slim).withColumn("result_json", F.to_json("result"))


#: For each kind of file its name, what reads it from (parts, name, raw) and a listing of all files, and the columns that are kept.
KINDS: dict[str, tuple[str, Callable[[DataFrame, DataFrame], DataFrame], tuple[str, ...]]] = {
    "results": ("*_result.json", _slim_results, readers.RESULT_COLUMNS),
    "histories": ("agentic_round_history.json", readers.parse_round_histories, readers.HISTORY_COLUMNS),
    "round_inputs": ("agentic_eval_round_inputs_*.json", lambda files, _: readers.parse_round_inputs(files), readers.INPUT_COLUMNS),
}


def manifest_of(spark: SparkSession, table: str) -> DataFrame:
    """(path, length, modified, reason, batch) of all that was taken; empty if there is no table."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{table}/manifest")
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)


def compact(spark: SparkSession, root: str, table: str, kind: str, bundle_bytes: int = BUNDLE_BYTES) -> int:
    """Takes the files of a kind below root that the table doesn't have yet, and says how many there were.

    Files are listed, not opened, to see which are new. These are read in one pass, rows are
    dealt over as many bundles of each dataset as its bytes ask for, and the manifest is
    written last.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind: {kind}")
    glob, parse, columns = KINDS[kind]
    # Histories are told by what lies beside them, other kinds by their own path.
    every = readers.listed_files(spark, root, "*" if kind == "histories" else glob)
    listed = (every.where(F.element_at("parts", -1) == glob) if kind == "histories" else every).withColumn("path", F.array_join("parts", "/"))
    known = manifest_of(spark, table).select("path", "length", "modified").distinct()
    new = cut(listed.join(known, ["path", "length", "modified"], "left_anti").select("path", "parts", "length", "modified"))
    n, since = new.agg(F.count("*"), F.date_format(F.min("modified") - F.expr("interval 1 second"), "yyyy-MM-dd'T'HH:mm:ss")).first()
    if n:
        batch = str(uuid.uuid4())
        files = readers.whole_files(spark, root, glob, since, new).withColumn("path", F.array_join("parts", "/")).join(new.select("path", "length", "modified"), "path")
        # One pass over the files: good rows and reasons are told apart from what it has written.
        taken = cut(parse(files, every).select(*columns, "path", "length", "modified", "reason"))
        good = taken.where("reason is null")
        bundles = good.groupBy("dataset").agg(F.ceil(F.sum("length") / bundle_bytes).alias("bundles"))
        dealt = good.join(bundles, "dataset").withColumn("bundle", F.pmod(F.xxhash64("path"), F.col("bundles")))
        rows = dealt.repartition("dataset", "bundle").withColumn("batch", F.lit(batch)).drop("bundle", "bundles", "length", "modified", "reason")
        rows.write.mode("append").partitionBy("batch", "dataset").parquet(f"{table}/data")
        taken.select("path", "length", "modified", "reason", F.lit(batch).alias("batch")).coalesce(1 + n // 1_000_000).write.mode("append").parquet(f"{table}/manifest")
        discard(taken)
    discard(new, every)
    return n


def compacted(spark: SparkSession, table: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a table as the reader of its kind gives them, from the latest reading of each file."""
    columns = KINDS[kind][2]
    latest = manifest_of(spark, table).groupBy("path").agg(F.max_by(F.struct("batch", "reason"), F.struct("modified", "batch")).alias("x")).select("path", "x.batch", "x.reason")
    rejects = latest.where("reason is not null").select("path", "reason")
    try:
        data = spark.read.option("basePath", f"{table}/data").parquet(f"{table}/data")
    except AnalysisException:  # nothing good was ever taken
        return None, rejects
    data = data.withColumns({"dataset": F.col("dataset").cast("string"), "batch": F.col("batch").cast("string")})
    return data.join(latest.where("reason is null").select("path", "batch"), ["path", "batch"], "left_semi").select(*columns), rejects
