"""Row types that sources, operators and jobs agree on."""

from __future__ import annotations

from pyspark.sql import types as T

FILE = "struct<name: string, content: string>"
MESSAGE = "struct<role: string, content: string>"
TARGET = "struct<inst_name: string, metric: string, target_percentage: double>"
#: What orders results; structs compare from left to right, false before true.
RESULT_ORDER = ("is_pass_xrun", "has_coverage", "is_pass_targets", "overall_coverage")
COV_RESULT = "struct<is_pass_xrun: boolean, has_coverage: boolean, is_pass_targets: boolean, overall_coverage: double, misc: map<string, double>>"
LLM_STATS = "struct<prompt_tokens: bigint, completion_tokens: bigint, reasoning_tokens: bigint, total_tokens: bigint, latency_seconds: double>"

#: The metrics of a simulator's coverage summary (fixed values).
METRICS = (
    "Overall Average", "Overall Covered", "Code Average", "Code Covered", "Fsm Average", "Fsm Covered",
    "Functional Average", "Functional Covered", "Toggle", "Block", "Assertion",
)
SUMMARY_ROW = T.StructType([T.StructField("name", T.StringType()), T.StructField("level", T.IntegerType()), *(T.StructField(m, T.DoubleType()) for m in METRICS)])
RESULT_JSON = T.StructType([
    T.StructField("returncode", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("err_msg", T.StringType()),
    T.StructField("cov_info", T.StructType([T.StructField("summary", T.ArrayType(SUMMARY_ROW)), T.StructField("detail", T.StringType()), T.StructField("runtime_sec", T.DoubleType())])),
])

CONTEXT = (
    f"dataset string, context_id string, rtl_files array<{FILE}>, spec_files array<{FILE}>, rtl_tokens int, potential_top array<string>, "
    f"dut_top_module_name string, dut_top_instance_name string, instructions string, targets array<{TARGET}>, difficulty string, is_agentic boolean"
)
ROUND_INPUTS = f"array<struct<round_index: int, messages: array<{MESSAGE}>, best_cov_result: {COV_RESULT}, final_best_cov_result: {COV_RESULT}, error: string>>"
ROUND_HISTORY = (
    f"array<struct<round_index: string, separation_id: string, messages: array<{MESSAGE}>, llm_response: string, llm_stats: {LLM_STATS}, "
    f"parse_status: map<string, string>, eda_result: string, cov_result: {COV_RESULT}, cov_result_categories: map<string, double>, improved: boolean, "
    f"prev_cov_result: {COV_RESULT}, prev_cov_result_categories: map<string, double>, prev_tb: {FILE}, prev_run_id: string, prev_run_dir: string, "
    "prev_result_json_raw: string, task_hash_id: string, run_id: string, error: string>>"
)
SFT_RAW = (
    f"input array<{MESSAGE}>, output {MESSAGE}, dataset string, context_id string, run_type string, "
    f"cov_result {COV_RESULT}, prev_cov_result {COV_RESULT}, run_id string"
)
SFT = "dataset string, context_id string, run_type string, context_length_label string, system string, history array<array<string>>, instruction string, output string"
