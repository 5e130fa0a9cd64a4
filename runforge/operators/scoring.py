"""Best of N, pass@k and other summaries of scored runs.

Frames are keyed by dataset and context_id. Rates over nothing are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runforge.schemas import RESULT_ORDER

KEY = ("dataset", "context_id")
BOOL_METRICS = ("is_pass_xrun", "has_coverage", "is_pass_targets")


def result_order(prefix: str = "") -> Column:
    return F.struct(*(F.col(prefix + c).alias(c) for c in RESULT_ORDER))


def share(n: Column, of: Column) -> Column:
    return F.coalesce(F.try_divide(n.cast("double"), of.cast("double")), F.lit(0.0))


def best_of_n(runs: DataFrame, order_col: str, keys: tuple[str, ...] = KEY) -> DataFrame:
    """The best run of each key; of equal ones the first in order_col (a number)."""
    best = F.max_by(F.struct("*"), F.struct(result_order().alias("r"), (-F.col(order_col)).alias("o")))
    return runs.groupBy(*keys).agg(best.alias("best")).select("best.*")


def eval_summary(best: DataFrame, cohorts: dict[str, str]) -> DataFrame:
    """One row: counts and rates of the three flags, mean coverage over all and over rows with coverage, and each cohort's rate of passed targets.

    cohorts maps a name to an id prefix; an empty cohort has rate 0. Without rows only
    total_items is set, to 0.
    """
    n = F.count("*")
    out = [n.alias("total_items")]
    for c in BOOL_METRICS:
        out += [F.count_if(c).alias(f"n_{c}"), share(F.count_if(c), n).alias(f"rate_{c}")]
    out += [
        F.avg("overall_coverage").alias("mean_overall_cov"),
        F.coalesce(F.avg(F.when(F.col("has_coverage"), F.col("overall_coverage"))), F.lit(0.0)).alias("mean_overall_cov_has_cov"),
    ]
    for name, prefix in cohorts.items():
        mine = F.col("context_id").startswith(prefix)
        out.append(share(F.count_if(mine & F.col("is_pass_targets")), F.count_if(mine)).alias(f"pass_targets_{name}"))
    row = best.agg(*out)
    return row.select("total_items", *(F.when(F.col("total_items") > 0, F.col(c)).alias(c) for c in row.columns[1:]))


def per_task(samples: DataFrame, keys: tuple[str, ...] = KEY, contexts: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """(keys, metric, at_1, at_k) for each task: mean, and any (flags) or best (coverage) of its samples; null counts as failed or 0.

    With contexts and n every context counts n samples, repeat_index 0 to n - 1, of which
    those that are missing failed with coverage 0. No row is made for them: sums are divided
    by n, and a context without any sample has zeros. Rates over n = 0 are 0. If contexts is
    samples itself, nothing is joined.
    """
    values = {m: F.coalesce(F.col(m), F.lit(False)).cast("double") for m in BOOL_METRICS} | {"overall_coverage": F.coalesce("overall_coverage", F.lit(0.0))}
    counts = F.lit(True) if contexts is None else F.col("repeat_index").between(0, n - 1)
    aggs = [f(F.when(counts, v)).alias(f"{m}_{x}") for m, v in values.items() for f, x in ((F.sum, "sum"), (F.max, "k"))]
    got = samples.groupBy(*keys).agg(F.count("*").alias("_n"), *aggs)
    if contexts is not None and contexts is not samples:
        got = contexts.select(*keys).distinct().join(got, list(keys), "left")
    if contexts is not None:
        got = got.withColumn("_n", F.lit(n))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    each = [F.struct(F.lit(m).alias("metric"), share(zero(F.col(f"{m}_sum")), F.col("_n")).alias("at_1"), zero(F.col(f"{m}_k")).alias("at_k")) for m in values]
    return got.select(*keys, F.explode(F.array(*each)).alias("m")).select(*keys, "m.*")


def macro(tasks: DataFrame) -> DataFrame:
    """(metric, at_1, at_k): means over the tasks of per_task()."""
    return tasks.groupBy("metric").agg(F.avg("at_1").alias("at_1"), F.avg("at_k").alias("at_k"))


def pass_at_k(samples: DataFrame, keys: tuple[str, ...] = KEY, contexts: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """(metric, at_1, at_k): means over tasks of per_task()."""
    return macro(per_task(samples, keys, contexts, n))


def by_repeat(samples: DataFrame) -> DataFrame:
    """(repeat_index, n_pass, total): how many samples passed simulation, and the sum of their coverage. As many rows as a context has samples."""
    passed = F.col("is_pass_xrun")
    return samples.groupBy("repeat_index").agg(F.count_if(passed).alias("n_pass"), F.sum(F.when(passed, F.col("overall_coverage"))).alias("total"), F.count(F.when(passed, F.col("overall_coverage"))).alias("n_cov"))


def mean_sim_pass_cov(samples: DataFrame, contexts: DataFrame | None = None, n: int | None = None, by: DataFrame | None = None) -> DataFrame:
    """One row (at_1, at_k): mean and maximum over repeat indices of each index's mean coverage.

    Only samples that passed simulation count, and an index without any is left out. With
    contexts and n all contexts count at each index below n: what didn't pass or is missing
    counts as 0, by division and not by rows. by is by_repeat(samples) if that is at hand.
    """
    by = by_repeat(samples) if by is None else by
    if contexts is None:
        m = F.try_divide("total", "n_cov")
        return by.where("n_pass > 0").agg(F.coalesce(F.avg(m), F.lit(0.0)).alias("at_1"), F.coalesce(F.max(m), F.lit(0.0)).alias("at_k"))
    of = contexts.select(*KEY).distinct().agg(F.count("*")).scalar()
    row = by.where(F.col("repeat_index").between(0, n - 1)).agg(F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"), F.coalesce(F.max("total"), F.lit(0.0)).alias("top"))
    return row.select(share(F.col("total"), of * n).alias("at_1"), share(F.col("top"), of).alias("at_k"))


def cohort_pass_rates(tasks: DataFrame, cohorts: dict[str, str]) -> DataFrame:
    """(cohort, n_tasks, at_1, at_k) of passed targets over the tasks of per_task() whose id has the cohort's prefix; empty cohorts have zeros."""
    passed = tasks.where("metric = 'is_pass_targets'")
    of = F.explode(F.filter(F.array(*(F.when(F.col("context_id").startswith(p), F.lit(c)) for c, p in cohorts.items())), lambda c: c.isNotNull()))
    got = passed.select("at_1", "at_k", of.alias("cohort")).groupBy("cohort").agg(F.count("*").alias("n"), F.avg("at_1").alias("a"), F.avg("at_k").alias("b"))
    every = tasks.sparkSession.sql("select explode(array(" + ", ".join(f"'{c}'" for c in cohorts) + ")) as cohort")
    return every.join(got, "cohort", "left").select("cohort", F.coalesce("n", F.lit(0)).alias("n_tasks"), F.coalesce("a", F.lit(0.0)).alias("at_1"), F.coalesce("b", F.lit(0.0)).alias("at_k"))


STATS = ("prompt_tokens", "completion_tokens", "reasoning_tokens", "total_tokens", "latency_seconds")


def token_usage(rounds: DataFrame, keys: tuple[str, ...] = (*KEY, "repeat_index")) -> DataFrame:
    """The sums of the token counts and the latency over each sample's rounds; null stats are 0."""
    return rounds.groupBy(*keys).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in STATS))


def pad_missing(samples: DataFrame, contexts: DataFrame, n: int) -> DataFrame:
    """The samples of contexts at repeat indices below n, with a failed zero sample for each index that a context lacks; none if n is 0.

    Rows are made for what is missing only; reports don't need them (see per_task()).
    """
    every = contexts.select(*KEY).distinct()
    mine = samples.where(F.col("repeat_index").between(0, n - 1)).join(every, list(KEY), "left_semi")
    has = mine.groupBy(*KEY).agg(F.collect_set("repeat_index").alias("_has"))
    none = F.array().cast("array<int>")
    wanted = F.sequence(F.lit(0), F.lit(n - 1)) if n > 0 else none
    lacks = every.join(has, list(KEY), "left").select(*KEY, F.explode(F.array_except(wanted, F.coalesce("_has", none))).alias("repeat_index"))
    zeros = {m: F.lit(False) for m in BOOL_METRICS} | {"overall_coverage": F.lit(0.0), "ok": F.lit(False), "error": F.lit("missing_direct_infer_run")}
    for c, v in (("ok", F.lit(True)), ("error", F.lit(None).cast("string"))):
        mine = mine if c in mine.columns else mine.withColumn(c, v)
    return mine.unionByName(lacks.withColumns(zeros), allowMissingColumns=True)


def run_inventory(runs: DataFrame, contexts: DataFrame, n: int) -> DataFrame:
    """(keys, n_runs, n_missing, too_many) for each context; a run without a context is not counted."""
    counts = runs.groupBy(*KEY).agg(F.count("*").alias("n_runs"))
    out = contexts.select(*KEY).distinct().join(counts, list(KEY), "left").withColumn("n_runs", F.coalesce("n_runs", F.lit(0)))
    return out.withColumns({"n_missing": F.greatest(F.lit(n) - F.col("n_runs"), F.lit(0)), "too_many": F.col("n_runs") > n})


def assign_repeat_index(runs: DataFrame, n: int | None = None) -> DataFrame:
    """Adds repeat_index, from 0 by run_id within each context; with n, rows from index n on are dropped."""
    out = runs.withColumn("repeat_index", F.row_number().over(Window.partitionBy(*KEY).orderBy("run_id")) - 1)
    return out if n is None else out.where(F.col("repeat_index") < n)
