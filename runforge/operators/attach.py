"""Joining runs to their designs, best entries, files and earlier states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runforge.operators.scoring import KEY


def attach_contexts(runs: DataFrame, contexts: DataFrame, order_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(runs with their design's columns, runs without a design). Of designs with one id the first by order_col counts.

    Only designs that runs ask for are carried; columns of runs win over the design's.
    """
    wanted = contexts.join(runs.select(*KEY).distinct(), list(KEY), "left_semi")
    if order_col is None:
        one = wanted.dropDuplicates(list(KEY))
    else:
        one = wanted.withColumn("_k", F.row_number().over(Window.partitionBy(*KEY).orderBy(order_col))).where("_k = 1").drop("_k")
    cols = [c for c in one.columns if c in KEY or c not in runs.columns]
    return runs.join(one.select(*cols), list(KEY)), runs.join(one.select(*KEY), list(KEY), "left_anti")


def keep_best_run(history: DataFrame, best: DataFrame) -> DataFrame:
    """History rows whose run is the best one of its context."""
    return history.join(best.select(*KEY, "run_id"), [*KEY, "run_id"], "left_semi")


def pick_testbench(files: DataFrame, design_files: DataFrame, policy: str = "label") -> DataFrame:
    """(keys, run_id, name, content, pick_error): the testbench among each run's files (keys, run_id, name, content).

    design_files (keys, name, kind: rtl or spec) names what belongs to the design. label takes
    .sv and .v files that aren't the design's, names that begin with tb_ first, then by name;
    strict demands exactly one .sv, .v or .vh file; resume takes whatever is no rtl file,
    .sv first. Runs without a pick are left out, but strict keeps them with pick_error.
    """
    run = [*KEY, "run_id"]
    if policy == "strict":
        code = files.where(F.col("name").rlike(r"\.(sv|v|vh)$"))
        n = code.groupBy(*run).agg(F.count("*").alias("n"), F.min_by("name", "name").alias("name"), F.min_by("content", "name").alias("content"))
        every = files.select(*run).distinct().join(n, run, "left")
        ok = F.coalesce(F.col("n"), F.lit(0)) == 1
        return every.select(*run, F.when(ok, F.col("name")).alias("name"), F.when(ok, F.col("content")).alias("content"), F.when(~ok, F.format_string("%d testbench files", F.coalesce("n", F.lit(0)))).alias("pick_error"))
    if policy == "label":
        own, mine = design_files, files.where(F.col("name").rlike(r"\.(sv|v)$"))
        order = [~F.col("name").startswith("tb_"), F.col("name")]
    elif policy == "resume":
        own, mine = design_files.where("kind = 'rtl'"), files.where("not name like '%_result.json'")
        order = [~F.col("name").endswith(".sv"), F.col("name")]
    else:
        raise ValueError(f"unknown policy: {policy}")
    left = mine.join(own.select(*KEY, "name").distinct(), [*KEY, "name"], "left_anti")
    first = left.withColumn("_k", F.row_number().over(Window.partitionBy(*run).orderBy(*order))).where("_k = 1")
    return first.select(*run, "name", "content", F.lit(None).cast("string").alias("pick_error"))


def best_run_rows(best: DataFrame, testbenches: DataFrame) -> DataFrame:
    """Best entries with their run's testbench; without one they are left out."""
    return best.join(testbenches.where("name is not null").select(*KEY, "run_id", F.struct("name", "content").alias("tb")), [*KEY, "run_id"])


def previous_state(best: DataFrame, testbenches: DataFrame, results: DataFrame) -> DataFrame:
    """Best entries with what the next round starts from: prev_run_id, prev_tb and, if there is one, prev_result_json_raw."""
    with_tb = best_run_rows(best, testbenches).withColumnRenamed("tb", "prev_tb")
    raw = results.select(*KEY, "run_id", F.col("result_json").alias("prev_result_json_raw"))
    return with_tb.join(raw, [*KEY, "run_id"], "left").withColumnRenamed("run_id", "prev_run_id")


