"""What happened over the rounds of agentic runs.

round_inputs has one row for each sample (dataset, context_id, repeat_index) with entries, a
list of rounds (round_index, messages, best_cov_result: the state before the round) and
one final entry (final_best_cov_result), any of which may carry an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runforge.operators.scoring import KEY, result_order
from runforge.schemas import MESSAGE

SAMPLE = (*KEY, "repeat_index")


def post_round_best(entries: Column, r: Column) -> Column:
    """The best result after round r: what round r + 1 began with, else the final best, else what the last round began with, else null."""
    rounds = F.filter(entries, lambda e: e["round_index"].isNotNull())
    following = F.try_element_at(F.filter(rounds, lambda e: e["round_index"] == r + 1), F.lit(-1))["best_cov_result"]
    final = F.try_element_at(F.filter(entries, lambda e: e["round_index"].isNull() & e["final_best_cov_result"].isNotNull()), F.lit(-1))["final_best_cov_result"]
    latest = F.array_max(F.transform(rounds, lambda e: F.struct(e["round_index"].alias("i"), _slim(e["best_cov_result"]).alias("best"))))["best"]
    slim = "struct<is_pass_xrun: boolean, has_coverage: boolean, is_pass_targets: boolean, overall_coverage: double>"
    return F.coalesce(_slim(following).cast(slim), _slim(final).cast(slim), latest)


def _slim(c: Column) -> Column:
    return F.when(c.isNotNull(), F.struct(*(c[x].alias(x) for x in ("is_pass_xrun", "has_coverage", "is_pass_targets", "overall_coverage"))))


def slim_entries(round_inputs: DataFrame) -> DataFrame:
    """Without messages and metric maps, which no metric needs."""
    return round_inputs.select(
        *SAMPLE,
        F.transform("entries", lambda e: F.struct(e["round_index"].alias("round_index"), _slim(e["best_cov_result"]).alias("best_cov_result"), _slim(e["final_best_cov_result"]).alias("final_best_cov_result"), e["error"].alias("error"))).alias("entries"),
    )


def max_round_of(round_inputs: DataFrame) -> int:
    """The largest round index of all samples, 0 if there is none."""
    return round_inputs.agg(F.coalesce(F.max(F.array_max(F.transform("entries", lambda e: e["round_index"]))), F.lit(0))).first()[0]


def _by_cap(round_inputs: DataFrame, max_round: int) -> DataFrame:
    each = slim_entries(round_inputs).withColumn("max_round", F.explode(F.sequence(F.lit(0), F.lit(max_round))))
    return each.withColumn("cov", post_round_best(F.col("entries"), F.col("max_round"))).drop("entries")


def metrics_by_round(round_inputs: DataFrame, max_round: int | None = None, k: int = 5) -> DataFrame:
    """For each cap on rounds: pass_xrun and pass_targets @1 and @k over tasks, mean coverage over samples, and counts.

    Samples without any result are counted as missing and left out; pass_k is the smaller of
    k and the most samples of a task, and labels the @k columns only.
    """
    caps = _by_cap(round_inputs, max_round_of(round_inputs) if max_round is None else max_round)
    hit = lambda c: F.coalesce(F.col(f"cov.{c}"), F.lit(False)).cast("double")
    here = F.col("cov").isNotNull()
    tasks = caps.groupBy("max_round", *KEY).agg(
        F.count("*").alias("n"), F.count_if(here).alias("n_here"), F.sum(F.when(here, F.coalesce("cov.overall_coverage", F.lit(0.0)))).alias("cov"),
        *(f(F.when(here, hit(c))).alias(f"{c}_{x}") for c in ("is_pass_xrun", "is_pass_targets") for f, x in ((F.avg, "1"), (F.max, "k"))),
    )
    out = [F.coalesce(F.avg(f"{c}_{x}"), F.lit(0.0)).alias(f"{name}_at_{x}") for c, name in (("is_pass_xrun", "pass_xrun"), ("is_pass_targets", "pass_targets")) for x in "1k"]
    return tasks.groupBy("max_round").agg(
        *out, F.coalesce(F.try_divide(F.sum("cov"), F.sum("n_here")), F.lit(0.0)).alias("avg_overall_cov"), F.sum("n").alias("samples"),
        F.sum(F.col("n") - F.col("n_here")).alias("missing"), F.least(F.lit(k), F.greatest(F.max("n_here"), F.lit(1))).cast("int").alias("pass_k"),
    )


def round_improvements(round_inputs: DataFrame, max_round: int | None = None) -> DataFrame:
    """(round_index, improved, total) for rounds from 1: samples whose coverage after the round exceeds that before."""
    top = max_round_of(round_inputs) if max_round is None else max_round
    each = slim_entries(round_inputs).withColumn("round_index", F.explode(F.sequence(F.lit(1), F.lit(top)))) if top else slim_entries(round_inputs).withColumn("round_index", F.lit(1)).limit(0)
    now, before = (F.coalesce(post_round_best(F.col("entries"), r)["overall_coverage"], F.when(post_round_best(F.col("entries"), r).isNotNull(), 0.0)) for r in (F.col("round_index"), F.col("round_index") - 1))
    return each.select("round_index", now.alias("a"), before.alias("b")).where("a is not null and b is not null").groupBy("round_index").agg(F.count_if(F.col("a") > F.col("b")).alias("improved"), F.count("*").alias("total"))


def errors_by_round(round_inputs: DataFrame, max_round: int | None = None) -> DataFrame:
    """(round_index, errors) for every round up to max_round: samples with an error, at their last listed round."""
    top = max_round_of(round_inputs) if max_round is None else max_round
    failed = round_inputs.where(F.exists("entries", lambda e: e["error"].isNotNull()))
    last = F.try_element_at(F.filter(F.transform("entries", lambda e: e["round_index"]), lambda i: i.isNotNull()), F.lit(-1))
    counts = failed.select(last.alias("round_index")).groupBy("round_index").agg(F.count("*").alias("n"))
    every = round_inputs.sparkSession.range(top + 1).select(F.col("id").cast("int").alias("round_index"))
    return every.join(counts, "round_index", "left").select("round_index", F.coalesce("n", F.lit(0)).alias("errors"))


def running_best(rounds: DataFrame) -> DataFrame:
    """Adds best_round: the round with the best result so far in each sample; of equal ones the later."""
    w = Window.partitionBy(*SAMPLE).orderBy("round_index").rowsBetween(Window.unboundedPreceding, 0)
    return rounds.withColumn("best_round", F.max(F.struct(result_order().alias("r"), "round_index")).over(w)["round_index"])


def markov_snapshot(rounds: DataFrame) -> DataFrame:
    """Adds prompt: the messages that the round saw.

    rounds has messages (what the first round was given), answer and feedback arrays.
    Rounds 0 and 1 see all that was said before; later ones the first two messages and the
    answer and feedback of the best round before.
    """
    w = Window.partitionBy(*SAMPLE).orderBy("round_index")
    best = running_best(rounds).withColumns({"_before": F.lag("best_round").over(w), "_first": F.first("messages").over(w)})
    said = rounds.select(*SAMPLE, F.col("round_index").alias("_before"), F.concat("answer", "feedback").alias("_said"))
    joined = best.join(said, [*SAMPLE, "_before"], "left")
    prompt = F.when(F.col("round_index") == 0, F.col("_first")).when(F.col("round_index") == 1, F.concat("_first", "_said")).otherwise(F.concat(F.slice("_first", 1, 2), "_said"))
    return joined.withColumn("prompt", prompt).drop("_before", "_first", "_said")


def message_log(rounds: DataFrame) -> DataFrame:
    """(sample keys, log, upto): all that was said in a sample, each message once, and for each round how many of these messages it saw.

    A log begins with the first round's messages; answer and feedback of each round follow,
    nothing where either is null. upto maps a round index to a length of the log.
    """
    none = F.array().cast(f"array<{MESSAGE}>")
    said = F.coalesce(F.concat("answer", "feedback"), none).cast(f"array<{MESSAGE}>")
    each = F.array_sort(F.collect_list(F.struct("round_index", F.coalesce("messages", none).cast(f"array<{MESSAGE}>").alias("messages"), said.alias("said"))))
    whole = rounds.groupBy(*SAMPLE).agg(each.alias("r")).withColumn("first", F.get("r", F.lit(0))["messages"])
    start = F.struct(F.size("first").alias("n"), F.array().cast("array<struct<i: int, n: int>>").alias("upto")).cast("struct<n: int, upto: array<struct<i: int, n: int>>>")
    seen = F.aggregate("r", start, lambda s, x: F.struct((s["n"] + F.size(x["said"])).alias("n"), F.concat(s["upto"], F.array(F.struct(x["round_index"].cast("int").alias("i"), s["n"].alias("n")))).alias("upto")))
    return whole.select(*SAMPLE, F.concat("first", F.flatten(F.transform("r", lambda x: x["said"]))).alias("log"), F.map_from_entries(seen["upto"]).alias("upto"))


def full_history(rounds: DataFrame) -> DataFrame:
    """Adds prompt: the first messages and all answers and feedback before, in order.

    Prompts grow with the square of the rounds, so they are cut from the sample's
    message_log() where rows come out; what is shuffled is each message once or twice. To
    keep the output small too, write message_log() and expand later.
    """
    log = message_log(rounds)
    return rounds.join(log, list(SAMPLE)).withColumn("prompt", F.slice("log", F.lit(1), F.try_element_at("upto", F.col("round_index").cast("int")))).drop("log", "upto")


def stop_when_full(rounds: DataFrame) -> DataFrame:
    """Without the rounds after a sample's first with full coverage."""
    w = Window.partitionBy(*SAMPLE).orderBy("round_index").rowsBetween(Window.unboundedPreceding, -1)
    full = F.max((F.coalesce("overall_coverage", F.lit(0.0)) >= 1.0).cast("int")).over(w)
    return rounds.withColumn("_full", F.coalesce(full, F.lit(0))).where("_full = 0").drop("_full")


def previous_state(rounds: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    """Adds prev_<col>: what the sample's round before had."""
    w = Window.partitionBy(*SAMPLE).orderBy("round_index")
    return rounds.withColumns({f"prev_{c}": F.lag(c).over(w) for c in cols})


def resume_check(history: DataFrame, keys: tuple[str, ...] = (*KEY, "separation_id")) -> DataFrame:
    """The rows of groups whose rounds go from 0 without gap, each with a run directory of its own."""
    fine = history.groupBy(*keys).agg(F.max("round_index").alias("top"), F.count("*").alias("n"), F.count_distinct("round_index").alias("r"), F.count_distinct("run_dir").alias("d"), F.min("round_index").alias("low"))
    return history.join(fine.where("low = 0 and top + 1 = r and n = r and d = r").select(*keys), list(keys), "left_semi")


def resume_histogram(history: DataFrame, keys: tuple[str, ...] = (*KEY, "separation_id")) -> DataFrame:
    """(max_round, n): how far how many groups have come."""
    return history.groupBy(*keys).agg(F.max("round_index").alias("max_round")).groupBy("max_round").agg(F.count("*").alias("n"))


def advanced_first() -> list:
    """The order of work to be resumed."""
    return [F.col("max_round").desc_nulls_last(), *map(F.col, (*KEY, "separation_id"))]


def resume_order(items: DataFrame) -> DataFrame:
    """Most advanced work first."""
    return items.orderBy(*advanced_first())


def attach_resume(items: DataFrame, history: DataFrame) -> DataFrame:
    """items with max_round and run_dirs of what was done for them already.

    Entries with an error or without a whole round index are passed over; a separation id
    that is no whole number is 0. Items without history are left out.
    """
    ok = (
        history.where("error is null")
        .withColumns({"round_index": F.expr("try_cast(round_index as int)"), "separation_id": F.coalesce(F.expr("try_cast(separation_id as int)"), F.lit(0))})
        .where("round_index >= 0")
    )
    whole = resume_check(ok).groupBy(*KEY, "separation_id").agg(F.max("round_index").alias("max_round"), F.sort_array(F.collect_list(F.struct("round_index", "run_dir"))).alias("done"))
    return items.join(whole, [*KEY, "separation_id"])


def improvement_summary(history: DataFrame) -> DataFrame:
    """One row: how many runs beat their true previous result, by whether that had passed simulation."""
    prev = F.struct(*(F.col(f"prev_cov_result.{c}").alias(c) for c in ("is_pass_xrun", "has_coverage", "is_pass_targets", "overall_coverage")))
    now = F.struct(*(F.col(f"cov_result.{c}").alias(c) for c in ("is_pass_xrun", "has_coverage", "is_pass_targets", "overall_coverage")))
    rows = history.where("cov_result is not null and prev_cov_result is not null").select((prev < now).alias("up"), F.col("prev_cov_result.is_pass_xrun").alias("passed"))
    n, rate = F.count("*"), F.avg(F.col("passed").cast("double"))
    return rows.agg(
        n.alias("total"), F.count_if("up").alias("improved"), F.count_if(F.col("up") & ~F.col("passed")).alias("improved_xrun"), F.count_if(F.col("up") & F.col("passed")).alias("improved_coverage"),
        F.coalesce(n - F.round(rate * n), F.lit(0.0)).cast("bigint").alias("xrun_candidates"), F.coalesce(F.round(rate * n), F.lit(0.0)).cast("bigint").alias("coverage_candidates"),
    )
