"""From paired results to cleaned chat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runforge.functions.chat import history_of, instruction_of, output_of, render_chat, system_of
from runforge.lineage import cut
from runforge.operators import quantiles
from runforge.operators.scoring import KEY


def drop_contaminated(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the rows whose context_id, and dataset if ids has one, is in ids; ids are compared as strings."""
    on = [c for c in KEY if c in ids.columns]
    left = rows.withColumns({f"_{c}": F.col(c).cast("string") for c in on})
    right = ids.select(*(F.col(c).cast("string").alias(f"_{c}") for c in on)).distinct()
    return left.join(right, [f"_{c}" for c in on], "left_anti").drop(*(f"_{c}" for c in on))


def valid_pairs(rows: DataFrame) -> DataFrame:
    """Rows with both results, the current one with coverage."""
    return rows.where("cov_result is not null and prev_cov_result is not null and cov_result.has_coverage")


def has_absolute_improvement(cur: Column, prev: Column, threshold: float = 0.01) -> Column:
    """Whether cur has coverage and prev had none, or coverage rose by more than threshold and no metric of prev fell or went missing."""
    kept = F.forall(
        F.map_entries(F.coalesce(prev["misc"], F.create_map().cast("map<string, double>"))),
        lambda e: e["value"].isNull() | F.coalesce(F.try_element_at(cur["misc"], e["key"]) >= e["value"], F.lit(False)),
    )
    better = (cur["overall_coverage"] > prev["overall_coverage"] + threshold) & kept
    return F.coalesce(cur["has_coverage"], F.lit(False)) & F.when(F.coalesce(prev["has_coverage"], F.lit(False)), better).otherwise(True)


def best_improvement(rows: DataFrame, order_col: str) -> DataFrame:
    """For each context the row with the largest gain in coverage; of equal ones the first by order_col."""
    gain = F.col("cov_result.overall_coverage") - F.col("prev_cov_result.overall_coverage")
    k = F.row_number().over(Window.partitionBy(*KEY).orderBy(gain.desc_nulls_last(), order_col))
    return rows.withColumn("_k", k).where("_k = 1").drop("_k")


def relabel_run_type(prev: Column) -> Column:
    return F.when(F.coalesce(prev["has_coverage"], F.lit(False)), "agentic_coverage").otherwise("agentic_xrun")


def split_name(dataset: Column, eval_dataset: str) -> Column:
    """eval for the evaluation dataset, train for all others."""
    return F.when(dataset == eval_dataset, "eval").otherwise("train")


def split_chats(rows: DataFrame, length_label: str = "long") -> DataFrame:
    """The final columns of chat rows, with chat_error naming what a row's chat lacks, or null."""
    m = F.col("input")
    out = rows.select(
        *KEY, F.col("run_type"), F.lit(length_label).alias("context_length_label"),
        system_of(m).alias("system"), history_of(m).alias("history"), instruction_of(m).alias("instruction"), output_of(F.col("output")).alias("output"),
    )
    lacks = [F.when(F.col(c).isNull(), F.lit(c)) for c in ("system", "history", "instruction", "output")]
    return out.withColumn("chat_error", F.coalesce(*lacks))


def longest_tail_check(rows: DataFrame, tokens_of: Column | None = None, q: float = 0.99, sketch: int | None = None) -> DataFrame:
    """One row: the largest token count among the rows at or above the q quantile by characters, and by words.

    rows are those of split_chats(); tokens_of gives the tokens of column chat, by default
    its words. Tokens are counted on the tail only. With sketch the quantiles are by sketches
    of this size, taken lower by quantiles.rank_error(sketch), so that the tail misses none
    of the exact one and holds at most twice that share of the rows more.
    """
    chat = render_chat(*(F.col(c) for c in ("system", "history", "instruction", "output")))
    sized = rows.select(chat.alias("chat")).withColumns({"chars": F.length("chat"), "words": F.size(F.filter(F.split("chat", r"\s+"), lambda x: x != ""))})
    if sketch is None:
        cuts = sized.agg(F.percentile("chars", F.lit(q)).alias("c"), F.percentile("words", F.lit(q)).alias("w"))
    else:
        at = max(0.0, q - quantiles.rank_error(sketch))
        both = sized.agg(*(F.kll_sketch_agg_bigint(F.col(c).cast("bigint"), sketch).alias(c) for c in ("chars", "words")), F.count("*").alias("n")).where("n > 0")
        cuts = both.select(quantiles.quantile("chars", at).alias("c"), quantiles.quantile("words", at).alias("w"))
    tail = sized.join(F.broadcast(cuts)).where("chars >= c or words >= w").withColumn("n", F.col("words") if tokens_of is None else tokens_of)
    return tail.agg(F.max(F.when(F.col("chars") >= F.col("c"), F.col("n"))).alias("max_by_chars"), F.max(F.when(F.col("words") >= F.col("w"), F.col("n"))).alias("max_by_words"))


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """(stage, n_rows, n_contexts, n_datasets) for named stages."""
    out = None
    for name, rows in stages.items():
        one = rows.agg(F.lit(name).alias("stage"), F.count("*").alias("n_rows"), F.count_distinct("context_id").alias("n_contexts"), F.count_distinct("dataset").alias("n_datasets"))
        out = one if out is None else out.unionByName(one)
    return out


def refine_sft(rows: DataFrame, ids: DataFrame | None, order_col: str, threshold: float = 0.01, length_label: str = "long") -> tuple[DataFrame, DataFrame]:
    """(chat rows, rejected chats): clean, improving rows, the best of each context. Rejected are those without the form of a chat, with chat_error.

    What is left after the filters must be of one dataset.
    """
    clean = valid_pairs(rows if ids is None else drop_contaminated(rows, ids))
    better = clean.where(has_absolute_improvement(F.col("cov_result"), F.col("prev_cov_result"), threshold))
    best = cut(best_improvement(better, order_col).withColumn("run_type", relabel_run_type(F.col("prev_cov_result"))))
    if best.agg(F.count_distinct("dataset").alias("n")).first()["n"] > 1:
        raise ValueError("rows of more than one dataset")
    chats = split_chats(best, length_label)
    return chats.where("chat_error is null").drop("chat_error"), chats.where("chat_error is not null")
