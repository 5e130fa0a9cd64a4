"""Composed jobs: requests for generation, training rows, reports, selections, decontamination, blends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runforge.functions import text
from runforge.lineage import cut
from runforge.operators import attach, blend, coverage, designs, rounds, scoring, selection, sft, similarity
from runforge.operators.scoring import KEY


def build_generation_requests(contexts: DataFrame, instructions: str, system: str, user_template: str, max_tokens: int, n_repeats: int, sample: int | None = None, seed: int = 42, keep_long: bool = False, rules: str | None = None) -> DataFrame:
    """(keys, repeat_index, messages): which designs are asked for, how often, with which prompt."""
    chosen = designs.filter_by_length(designs.filter_single_top(contexts), max_tokens, keep_long)
    if sample is not None:
        chosen = blend.sample_exact(chosen, sample, seed, *KEY)
    ready = designs.to_generation_context(chosen, instructions)
    if rules is not None:
        ready = ready.withColumn("instructions", text.inject_rules(F.col("instructions"), rules))
    prompt = text.render_initial_prompt(F.col("rtl_files"), F.col("spec_files"), F.col("instructions"), system, user_template)
    return blend.repeat_items(ready.select(*KEY, prompt.alias("messages")), n_repeats)


def build_followup_requests(best: DataFrame, contexts: DataFrame, testbenches: DataFrame, results: DataFrame, instructions: dict[str, str], n_repeats: int) -> DataFrame:
    """(keys, prev_run_id, repeat_index, messages) of the next round; instructions has fix_xrun, fix_imc and improve."""
    state = attach.previous_state(best, testbenches, results)
    with_context, _ = attach.attach_contexts(state, contexts)
    result = coverage.parse_result("prev_result_json_raw")
    said = coverage.summarize_status(result, F.col("overall_coverage"))
    status = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), F.col(f"said.{k}").alias("value")) for k in ("status", "stage", "log", "coverage"))), lambda p: p["value"].isNotNull())
    ask = coverage.next_instruction(F.col("said.stage"), instructions["fix_xrun"], instructions["fix_imc"], instructions["improve"])
    parsed = F.create_map(F.lit("type"), F.lit("full"), F.lit("status"), F.lit("ok"))
    none = F.lit(None).cast("map<string, string>")
    messages = text.render_followup(parsed, none, F.col("prev_tb.content"), F.map_from_entries(status), ask)
    return blend.repeat_items(with_context.withColumn("said", said).select(*KEY, "prev_run_id", messages.alias("messages")), n_repeats)


def collect_direct_rows(runs: DataFrame, contexts: DataFrame, testbenches: DataFrame, system: str, user_template: str, best: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(chat rows, rejected rows) of direct runs, of their best only if best is given. contexts have instructions."""
    known, _ = attach.attach_contexts(runs, contexts)
    if best is not None:
        known = attach.keep_best_run(known, best)
    good, bad = coverage.quarantine(coverage.score_coverage(known))
    joined = good.join(testbenches.where("name is not null").select(*KEY, "run_id", "name", "content"), [*KEY, "run_id"])
    prompt = text.render_initial_prompt(F.col("rtl_files"), F.col("spec_files"), F.col("instructions"), system, user_template)
    cov = F.struct("is_pass_xrun", "has_coverage", "is_pass_targets", "overall_coverage", "misc")
    rows = joined.select(
        prompt.alias("input"), text.format_answer(F.col("name"), F.col("content")).alias("output"), *KEY, F.lit("direct_infer").alias("run_type"),
        coverage.coverage_label(cov).alias("cov_result"), F.lit(None).cast("struct<is_pass_xrun: boolean, has_coverage: boolean, is_pass_targets: boolean, overall_coverage: double, misc: map<string, double>>").alias("prev_cov_result"), "run_id",
    )
    return rows, bad


def collect_agentic_rows(histories: DataFrame, injected: str | None = None, best: DataFrame | None = None) -> DataFrame:
    """Chat rows of agentic runs (keys, run_id, entry), of the best runs only if best is given; without injected text.

    Entries with an error go, as do those without messages or without a response.
    """
    e = F.col("entry")
    run_id = text.first_run_id(e["run_id"], e["task_hash_id"], e["prev_run_id"], F.col("run_id"))
    messages: Column = e["messages"] if injected is None else text.strip_injected(e["messages"], injected)
    rows = histories.where(e["error"].isNull() & e["messages"].isNotNull() & e["llm_response"].isNotNull()).select(
        messages.alias("input"), F.struct(F.lit("assistant").alias("role"), e["llm_response"].alias("content")).alias("output"), *KEY, F.lit("agentic").alias("run_type"),
        coverage.coverage_label(e["cov_result"]).alias("cov_result"), coverage.coverage_label(e["prev_cov_result"]).alias("prev_cov_result"), run_id.alias("run_id"),
    )
    return rows if best is None else attach.keep_best_run(rows, best)


def refine_training_rows(rows: DataFrame, ids: DataFrame | None, order_col: str, threshold: float = 0.01, length_label: str = "long", tokens_of: Column | None = None) -> dict[str, DataFrame]:
    """rows: the refined chat rows; rejected: chats without the form of one; longest: the token counts of the longest rows."""
    good, bad = sft.refine_sft(rows, ids, order_col, threshold, length_label)
    return {"rows": good, "rejected": bad, "longest": sft.longest_tail_check(good, tokens_of)}


def evaluate_samples(samples: DataFrame, contexts: DataFrame, n: int, cohorts: dict[str, str]) -> dict[str, DataFrame]:
    """Reports over scored samples (repeat_index below n): metrics, per task, mean coverage unpadded and padded, cohorts, tokens.

    Samples are read once, without their texts; what is missing of n is accounted for and not made.
    """
    stats = [c for c in scoring.STATS if c in samples.columns]
    slim = cut(samples.select(*KEY, "repeat_index", *scoring.BOOL_METRICS, "overall_coverage", *stats))
    every = slim if contexts is samples else cut(contexts.select(*KEY).distinct())
    tasks, by = cut(scoring.per_task(slim, KEY, every, n)), scoring.by_repeat(slim)
    return {
        "metrics": scoring.macro(tasks),
        "per_task": tasks,
        "mean_cov": scoring.mean_sim_pass_cov(slim, by=by),
        "mean_cov_padded": scoring.mean_sim_pass_cov(slim, tasks.where("metric = 'overall_coverage'"), n, by=by),
        "cohorts": scoring.cohort_pass_rates(tasks, cohorts),
    } | ({"tokens": scoring.token_usage(slim)} if len(stats) == len(scoring.STATS) else {})


def select_splits(runs: DataFrame, gap: float = 0.1, keep_worst_first: bool = False) -> DataFrame:
    """Median, worst and failed runs of each context by the gap rule, with a column pick."""
    picked = selection.gap_rule(selection.select_median(runs), selection.select_worst(runs), gap, keep_worst_first)
    return picked.unionByName(selection.select_xrun_fail(runs).withColumn("pick", F.lit("xrun_fail")))


def select_ablation(runs: DataFrame, n: int | None = None, ratio: float | None = None, mode: str = "best", seed: int = 42) -> DataFrame:
    """n runs round by round, or all of a preselected ratio of them."""
    if (n is None) == (ratio is None):
        raise ValueError("give n or ratio")
    if ratio is not None:
        runs = selection.preselect_ratio(runs, ratio, seed).drop("round_id")
    return selection.select_rounds(runs, n, mode, seed)


def report_rounds(round_inputs: DataFrame, k: int = 5, max_round: int | None = None) -> dict[str, DataFrame]:
    """Metrics, improvements and errors by round."""
    top = rounds.max_round_of(round_inputs) if max_round is None else max_round
    return {"metrics": rounds.metrics_by_round(round_inputs, top, k), "improvements": rounds.round_improvements(round_inputs, top), "errors": rounds.errors_by_round(round_inputs, top)}


def decontaminate(train: DataFrame, evals: DataFrame, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(clean training contexts, contaminated id pairs); evals have eval_ord."""
    pairs = similarity.find_contamination(similarity.files_of(train), similarity.files_of(evals, "eval_ord"), threshold)
    return sft.drop_contaminated(train, pairs.select(F.col("train_id").alias("context_id"))), pairs


def blend_sources(sources: list[DataFrame], n: int, seed: int, *keys: str) -> DataFrame:
    """Sources blended to n rows and shuffled; ready for publish_split()."""
    mixed = blend.blend(blend.concat_sources(*sources), n, seed, *keys)
    return blend.shuffle_rows(mixed, seed, "source_ord", *keys, "copy")
