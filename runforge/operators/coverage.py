"""Scoring of one run's coverage result, and what is said about it next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runforge.schemas import METRICS, RESULT_JSON

OVERALL = "Overall Average"


def parse_result(raw: str = "result_json") -> Column:
    """The simulator's result as a struct; fields that are missing or of another type are null."""
    return F.from_json(raw, RESULT_JSON)


def _once(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), where value is computed once however often of() names it: what is given may be a whole parse."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def top_entry(result: Column, top: Column) -> Column:
    """The first summary row of the top module at level 0, or null."""
    return F.try_element_at(F.filter(result["cov_info"]["summary"], lambda m: (m["name"] == top) & (m["level"] == 0)), F.lit(1))


def metrics_of(entry: Column) -> Column:
    """A summary row's metrics as a map, without name and level; null metrics are left out."""
    pairs = F.array(*(F.struct(F.lit(m).alias("key"), entry[m].alias("value")) for m in METRICS))
    return F.when(entry.isNotNull(), F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())))


def coverage_categories(result: Column, top: Column) -> Column:
    """The metrics of the top module; null if anything on the way to them is missing."""
    return _once(top_entry(result, top), metrics_of)


def score_coverage(runs: DataFrame) -> DataFrame:
    """Adds is_pass_xrun, has_coverage, is_pass_targets, overall_coverage, misc and eval_error.

    runs has result_json, dut_top_module_name, dut_top_instance_name and targets. A missing
    status is a failed simulation, any but xrun_failed has passed it, only success has
    coverage. Targets are checked in order and the first failure ends the check, so that an
    error behind it doesn't count: the top instance means the top row, others the first
    row of that name; a metric other than the overall one passes if it is null or absent;
    coverage times 100 has to reach the target. No targets pass. eval_error names what a
    result with coverage lacks (summary, top row, its overall average, an instance); such
    rows have null scores. Unreadable JSON counts as an empty result.
    """
    r = parse_result()
    status = F.coalesce(r["status"], F.lit("xrun_failed"))
    parsed = runs.withColumn("_r", r).withColumns({"_status": status, "_top": top_entry(F.col("_r"), F.col("dut_top_module_name"))})
    summary, top = F.col("_r.cov_info.summary"), F.col("_top")

    def verdict(t: Column) -> Column:
        row = F.when(t["inst_name"] == F.col("dut_top_instance_name"), top).otherwise(F.try_element_at(F.filter(summary, lambda m: m["name"] == t["inst_name"]), F.lit(1)))
        known = F.coalesce(*(F.when(t["metric"] == m, row[m]) for m in METRICS))
        reached = known * 100 >= t["target_percentage"]
        return (
            F.when(row.isNull(), F.lit("missing instance"))
            .when(t["metric"] == OVERALL, F.when(F.coalesce(reached, F.lit(False)), "ok").otherwise("fail"))
            .otherwise(F.when(F.coalesce(reached, F.lit(True)), "ok").otherwise("fail"))
        )

    decisive = F.try_element_at(F.filter(F.transform(F.coalesce("targets", F.array().cast("array<struct<inst_name: string, metric: string, target_percentage: double>>")), verdict), lambda v: v != "ok"), F.lit(1))
    error = F.when(F.col("_status") == "success", F.when(summary.isNull(), "missing summary").when(top.isNull(), "missing top").when(top[OVERALL].isNull(), "missing overall").when(decisive.startswith("missing"), decisive))
    scored = parsed.withColumn("eval_error", error)
    fine, covered = F.col("eval_error").isNull(), F.col("_status") == "success"
    return scored.withColumns({
        "is_pass_xrun": F.when(fine, F.col("_status") != "xrun_failed"),
        "has_coverage": F.when(fine, covered),
        "is_pass_targets": F.when(fine, covered & decisive.isNull()),
        "overall_coverage": F.when(fine, F.when(covered, top[OVERALL]).otherwise(0.0)),
        "misc": F.when(fine & covered, metrics_of(top)),
    }).drop("_r", "_status", "_top")


def quarantine(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that were scored, rows that weren't with their eval_error)."""
    return scored.where("eval_error is null").drop("eval_error"), scored.where("eval_error is not null")


def summarize_status(result: Column, prev_overall: Column | None = None) -> Column:
    """struct<status, stage, log, coverage> of a result for the next prompt.

    A missing status is "unknown" here and belongs to the imc stage. Without a result the
    previous coverage, if given, stands in for it.
    """
    status = F.coalesce(result["status"], F.lit("unknown"))
    log = F.coalesce(result["err_msg"], F.lit(""))
    none = F.lit(None).cast("string")

    def say(status, stage, log, coverage):
        return F.struct(status.alias("status"), stage.alias("stage"), log.alias("log"), coverage.alias("coverage"))

    said = (
        F.when(status == "xrun_failed", say(status, F.lit("xrun"), log, none))
        .when(status != "success", say(status, F.lit("imc"), log, none))
        .otherwise(say(status, F.lit("success"), none, F.coalesce(result["cov_info"]["detail"], F.lit(""))))
    )
    if prev_overall is None:
        return said
    before = F.when(prev_overall.isNotNull(), say(F.lit("success"), F.lit("success"), none, F.format_string("overall=%.4f", prev_overall)))
    return F.when(result.isNull() | (result["status"].isNull() & result["cov_info"].isNull()), before).otherwise(said)


def next_instruction(stage: Column, fix_xrun: str, fix_imc: str, improve: str) -> Column:
    """Which instruction the next round gets."""
    return F.when(stage == "xrun", fix_xrun).when(stage == "imc", fix_imc).otherwise(improve)


def coverage_label(cov: Column) -> Column:
    """The four result fields and misc of a result, coverage rounded to four decimals; null stays null."""
    fields = [cov[c].alias(c) for c in ("is_pass_xrun", "has_coverage", "is_pass_targets")]
    return F.when(cov.isNotNull(), F.struct(*fields, F.round(cov["overall_coverage"], 4).alias("overall_coverage"), cov["misc"].alias("misc")))
