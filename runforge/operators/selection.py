"""Representative runs and budgets of runs for each context."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runforge.operators.blend import sample_exact, seeded
from runforge.operators.scoring import KEY, result_order


def _first(runs: DataFrame, *order: Column) -> DataFrame:
    return runs.withColumn("_k", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order))).where("_k = 1").drop("_k")


def candidates(runs: DataFrame) -> DataFrame:
    """Runs with coverage below full."""
    return runs.where("is_pass_xrun and has_coverage and overall_coverage < 1.0")


def select_median(runs: DataFrame) -> DataFrame:
    """For each context the candidate with the lower median of its distinct coverages; ties: smallest run_id."""
    w = Window.partitionBy(*KEY)
    ranked = candidates(runs).withColumn("_r", F.dense_rank().over(w.orderBy("overall_coverage")))
    middle = ranked.withColumn("_m", F.floor((F.max("_r").over(w) - 1) / 2) + 1).where("_r = _m").drop("_r", "_m")
    return _first(middle, F.col("run_id"))


def select_worst(runs: DataFrame) -> DataFrame:
    """For each context the candidate with the smallest coverage; ties: smallest run_id."""
    return _first(candidates(runs), F.col("overall_coverage"), F.col("run_id"))


def select_xrun_fail(runs: DataFrame) -> DataFrame:
    """For each context the run that failed simulation with the smallest run_id."""
    return _first(runs.where("not is_pass_xrun"), F.col("run_id"))


def gap_rule(median: DataFrame, worst: DataFrame, threshold: float = 0.1, keep_worst_first: bool = False) -> DataFrame:
    """Both selections with a column pick; the second only where median - worst exceeds threshold.

    The median run is always kept, or the worst one with keep_worst_first.
    """
    gap = median.select(*KEY, F.col("overall_coverage").alias("_m")).join(worst.select(*KEY, F.col("overall_coverage").alias("_w")), list(KEY)).where(F.col("_m") - F.col("_w") > threshold).select(*KEY)
    always, maybe = (("worst", worst), ("median", median)) if keep_worst_first else (("median", median), ("worst", worst))
    return always[1].withColumn("pick", F.lit(always[0])).unionByName(maybe[1].join(gap, list(KEY), "left_semi").withColumn("pick", F.lit(maybe[0])))


def _budget(ranked: DataFrame, n: int, seed: int) -> DataFrame:
    """The first n of ranked, round by round; of the last round a seeded choice of contexts."""
    sums = ranked.groupBy("round_id").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(Window.orderBy("round_id")))
    last = sums.where(F.col("upto") >= n).orderBy("round_id").first()
    if last is None:
        raise ValueError(f"fewer than {n} candidates")
    whole, part = ranked.where(F.col("round_id") < last["round_id"]), ranked.where(F.col("round_id") == last["round_id"])
    if last["upto"] > n:
        part = sample_exact(part, n - (last["upto"] - last["c"]), seed, *KEY)
    return whole.unionByName(part)


def select_rounds(runs: DataFrame, n: int | None, mode: str = "best", seed: int = 42) -> DataFrame:
    """n runs, one of each context in each round, with their round_id; runs with full coverage are left out.

    best takes the best result first (ties: largest run_id), random a seeded order. In the
    last round a seeded choice of contexts fills what is left. More than there are is an
    error; None takes all.
    """
    if mode not in ("best", "random"):
        raise ValueError(f"unknown mode: {mode}")
    open_runs = runs.where("overall_coverage < 1.0")
    order = [result_order().desc(), F.col("run_id").desc()] if mode == "best" else [seeded(seed, *KEY, "run_id"), F.col("run_id")]
    ranked = open_runs.withColumn("round_id", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order)) - 1)
    return ranked if n is None else ranked.limit(0) if n == 0 else _budget(ranked, n, seed)


def preselect_ratio(runs: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """ceil(ratio of all) runs, round by round, the largest run_id of each context first."""
    if not 0 < ratio <= 1:
        raise ValueError(f"ratio must be in (0, 1]: {ratio}")
    ranked = runs.withColumn("round_id", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("run_id").desc())) - 1)
    total = runs.count()
    return ranked if total == 0 else _budget(ranked, math.ceil(total * ratio), seed)
