"""Queries over runs, samples and rounds staged from events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runforge.operators import attach, blend, coverage, rounds, scoring, selection
from runforge.plans import jobs, staging
from runforge.plans.staging import COHORTS, KEY, PAIRS, ROUND_INPUTS, ROUNDS, RUNS, SAMPLES

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
RUN = ("dataset", "context_id", "run_id")


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r6(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, as engines add in different orders."""
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


BEST = RUNS + ", best as (select * from (select *, row_number() over (partition by dataset, context_id order by ord desc, event_id) as rk from runs) where rk = 1)"


@query(f"with {BEST} select dataset, context_id, run_id, is_pass_xrun, has_coverage, is_pass_targets, overall_coverage from best")
def a2_best_of_n(spark, sf):
    return scoring.best_of_n(staging.runs(spark, sf), "event_id").select(*RUN, *staging.RESULT_ORDER)


@query(f"""with {BEST} select count(*) as total_items, count(*) filter (is_pass_xrun) as n_is_pass_xrun, round(avg(is_pass_xrun::int), 6) as rate_is_pass_xrun,
 count(*) filter (has_coverage) as n_has_coverage, round(avg(has_coverage::int), 6) as rate_has_coverage, count(*) filter (is_pass_targets) as n_is_pass_targets,
 round(avg(is_pass_targets::int), 6) as rate_is_pass_targets, round(avg(overall_coverage), 6) as mean_overall_cov,
 round(coalesce(avg(overall_coverage) filter (has_coverage), 0), 6) as mean_overall_cov_has_cov,
 round(coalesce(avg(is_pass_targets::int) filter (starts_with(context_id, 'solo_')), 0), 6) as pass_targets_solo,
 round(coalesce(avg(is_pass_targets::int) filter (starts_with(context_id, 'team_')), 0), 6) as pass_targets_team from best""")
def a3_eval_summary(spark, sf):
    return _r6(scoring.eval_summary(scoring.best_of_n(staging.runs(spark, sf), "event_id"), COHORTS))


RESULTS = RUNS + """, res as (select *, k % 3 = 0 as t1, case when k % 4 = 0 then 'sub' when k % 7 = 0 then 'ghost' end as t2 from runs)"""


def _results(spark, sf) -> DataFrame:
    """runs as result JSON: the top module's row, a row of one instance below it, and targets on both, at times on a missing instance."""
    r = staging.runs(spark, sf)
    summary = F.format_string(
        '[{"name":"top","level":0,"Overall Average":%s,"Toggle":%s,"Block":null},{"name":"top","level":1,"Overall Average":0.0},{"name":"sub","level":1,"Overall Average":%s}]',
        F.col("overall_coverage").cast("string"), (F.col("k") / 100.0).cast("string"), (F.col("k") / 200.0).cast("string"),
    )
    raw = F.concat(F.lit('{"returncode":0,"status":"'), F.col("status"), F.lit('","err_msg":"e","cov_info":{"summary":'), summary, F.lit(',"detail":"d","runtime_sec":1.5}}'))
    target = lambda inst, metric, t: F.struct(inst.alias("inst_name"), F.lit(metric).alias("metric"), t.alias("target_percentage"))
    second = F.when(F.col("k") % 4 == 0, F.lit("sub")).when(F.col("k") % 7 == 0, F.lit("ghost"))
    targets = F.array(
        F.when(F.col("k") % 3 == 0, target(F.lit("u0"), "Overall Average", F.lit(3.0))),
        target(F.lit("u0"), "Block", F.lit(99.0)),
        F.when(second.isNotNull(), target(second, "Overall Average", F.lit(10.0))),
    )
    return r.select(*RUN, "event_id", "status", raw.alias("result_json"), F.lit("top").alias("dut_top_module_name"), F.lit("u0").alias("dut_top_instance_name"), F.filter(targets, lambda t: t.isNotNull()).alias("targets"))


VERDICT = """case when not has_coverage then 'none' when t1 and not (overall_coverage * 100 >= 3) then 'fail' when t2 = 'ghost' then 'error' when t2 = 'sub' and not ((k / 200e0) * 100 >= 10) then 'fail' else 'ok' end"""


@query(f"""with {RESULTS}, v as (select *, {VERDICT} as v from res)
select dataset, context_id, run_id, case when v <> 'error' then is_pass_xrun end as is_pass_xrun, case when v <> 'error' then has_coverage end as has_coverage,
 case when v <> 'error' then v = 'ok' end as is_pass_targets, case when v <> 'error' then overall_coverage end as overall_coverage,
 case when has_coverage and v <> 'error' then k / 100e0 end as toggle, case when v = 'error' then 'missing instance' end as eval_error from v""")
def a1_score_coverage(spark, sf):
    s = coverage.score_coverage(_results(spark, sf))
    return s.select(*RUN, *staging.RESULT_ORDER, F.try_element_at("misc", F.lit("Toggle")).alias("toggle"), "eval_error")


@query(f"with {RESULTS} select dataset, context_id, run_id, overall_coverage as overall, k / 100e0 as toggle, 2 as n from res")
def p10_coverage_categories(spark, sf):
    c = coverage.coverage_categories(coverage.parse_result(), F.col("dut_top_module_name"))
    return _results(spark, sf).withColumn("c", c).select(*RUN, F.col("c")["Overall Average"].alias("overall"), F.col("c")["Toggle"].alias("toggle"), F.size("c").alias("n"))


@query(f"""with {RUNS} select dataset, context_id, run_id, status, case status when 'xrun_failed' then 'xrun' when 'success' then 'success' else 'imc' end as stage,
 case when status <> 'success' then 'e' end as log, case when status = 'success' then 'd' end as coverage,
 case status when 'xrun_failed' then 'fix the build' when 'success' then 'cover more' else 'fix the report' end as instruction from runs""")
def p11_p12_status_and_instruction(spark, sf):
    s = _results(spark, sf).select(*RUN, coverage.summarize_status(coverage.parse_result()).alias("s")).select(*RUN, "s.*")
    return s.withColumn("instruction", coverage.next_instruction(F.col("stage"), "fix the build", "fix the report", "cover more"))


@query(f"with {RUNS} select dataset, context_id, run_id, is_pass_xrun, has_coverage, is_pass_targets, round(overall_coverage::varchar::decimal(38, 20), 4)::double as overall_coverage from runs")
def p13_coverage_label(spark, sf):
    r = staging.runs(spark, sf).withColumn("misc", F.lit(None).cast("map<string, double>"))
    return r.select(*RUN, coverage.coverage_label(F.struct(*staging.RESULT_ORDER, "misc")).alias("c")).select(*RUN, "c.is_pass_xrun", "c.has_coverage", "c.is_pass_targets", "c.overall_coverage")


@query(f"""with {RESULTS}, v as (select *, {VERDICT} as v from res) select dataset, count(*) filter (v <> 'error') as n_good, count(*) filter (v = 'error') as n_bad from v group by dataset""")
def p15_quarantine(spark, sf):
    good, bad = coverage.quarantine(coverage.score_coverage(_results(spark, sf)))
    return good.select("dataset", F.lit(1).alias("g")).unionByName(bad.select("dataset", F.lit(0).alias("g"))).groupBy("dataset").agg(F.sum("g").alias("n_good"), F.sum(1 - F.col("g")).alias("n_bad"))


TASKS = """t as (select dataset, context_id, unnest([{'m': 'is_pass_xrun', 'a': avg(is_pass_xrun::int), 'k': max(is_pass_xrun::int)}, {'m': 'has_coverage', 'a': avg(has_coverage::int), 'k': max(has_coverage::int)},
 {'m': 'is_pass_targets', 'a': avg(is_pass_targets::int), 'k': max(is_pass_targets::int)}, {'m': 'overall_coverage', 'a': avg(overall_coverage), 'k': max(overall_coverage)}]) as x from padded group by dataset, context_id)"""
PADDED = SAMPLES + """, five as (select * from samples), ctx as (select distinct dataset, context_id from runs),
padded as (select c.dataset, c.context_id, g.i as repeat_index, coalesce(f.is_pass_xrun, false) as is_pass_xrun, coalesce(f.has_coverage, false) as has_coverage, coalesce(f.is_pass_targets, false) as is_pass_targets,
 coalesce(f.overall_coverage, 0) as overall_coverage, f.run_id is not null as ok from ctx c cross join (select unnest(range(max(repeat_index) + 1))::int as i from samples) g left join five f on f.dataset = c.dataset and f.context_id = c.context_id and f.repeat_index = g.i)"""


def _every(spark, sf) -> tuple[DataFrame, tuple, DataFrame, int]:
    """Samples padded to as many as the largest context has: samples, keys, contexts, n."""
    s = staging.samples(spark, sf)
    return s, KEY, s, staging.most_samples(staging.runs(spark, sf))


@query(f"with {PADDED} select dataset, context_id, repeat_index, is_pass_xrun, has_coverage, is_pass_targets, overall_coverage, ok, case when not ok then 'missing_direct_infer_run' end as error from padded")
def j5_pad_missing(spark, sf):
    s, _, contexts, n = _every(spark, sf)
    return scoring.pad_missing(s, contexts, n).select(*KEY, "repeat_index", *staging.RESULT_ORDER, "ok", "error")


@query(f"with {PADDED}, {TASKS} select x.m as metric, round(avg(x.a), 6) as at_1, round(avg(x.k), 6) as at_k from t group by 1")
def a4_pass_at_k(spark, sf):
    return _r6(scoring.pass_at_k(*_every(spark, sf)))


@query(f"with {PADDED}, {TASKS} select dataset, context_id, x.m as metric, round(x.a, 6) as at_1, round(x.k::double, 6) as at_k from t")
def a4_per_task(spark, sf):
    return _r6(scoring.per_task(*_every(spark, sf)))


@query(f"""with {PADDED}, u as (select repeat_index, avg(overall_coverage) as m from five where is_pass_xrun group by 1), p as (select repeat_index, avg(case when is_pass_xrun then overall_coverage else 0 end) as m from padded group by 1)
select 'unpadded' as kind, round(avg(m), 6) as at_1, round(max(m), 6) as at_k from u union all select 'padded', round(avg(m), 6), round(max(m), 6) from p""")
def a5_mean_sim_pass_cov(spark, sf):
    s, _, contexts, n = _every(spark, sf)
    a, b = scoring.mean_sim_pass_cov(s), scoring.mean_sim_pass_cov(s, contexts, n)
    return _r6(a.select(F.lit("unpadded").alias("kind"), "*").unionByName(b.select(F.lit("padded").alias("kind"), "*")))


@query(f"""with {PADDED}, {TASKS}, c as (select * from (values ('solo', 'solo_'), ('team', 'team_'), ('none', 'none_')) v(cohort, prefix))
select cohort, count(t.x) as n_tasks, round(coalesce(avg(x.a), 0), 6) as at_1, round(coalesce(avg(x.k), 0), 6) as at_k from c left join t on starts_with(context_id, prefix) and x.m = 'is_pass_targets' group by 1""")
def a6_cohort_pass_rates(spark, sf):
    return _r6(scoring.cohort_pass_rates(scoring.per_task(*_every(spark, sf)), COHORTS | {"none": "none_"}))


@query("""select l_orderkey, sum(l_quantity::bigint) as prompt_tokens, sum(l_linenumber::bigint) as completion_tokens, sum(l_suppkey) as reasoning_tokens, coalesce(sum(case when l_linenumber > 2 then l_partkey end), 0) as total_tokens,
 round(sum(l_discount), 6) as latency_seconds from lineitem group by 1""")
def a7_token_usage(spark, sf):
    u = staging.load(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_quantity").cast("bigint").alias("prompt_tokens"), F.col("l_linenumber").cast("bigint").alias("completion_tokens"), F.col("l_suppkey").alias("reasoning_tokens"),
        F.when(F.col("l_linenumber") > 2, F.col("l_partkey")).alias("total_tokens"), F.col("l_discount").alias("latency_seconds"),
    )
    return _r6(scoring.token_usage(u, ("l_orderkey",)))


@query(f"with {RUNS} select dataset, context_id, count(*) as n_runs, greatest(70 - count(*), 0) as n_missing, count(*) > 70 as too_many from runs group by 1, 2")
def j6_run_inventory(spark, sf):
    r = staging.runs(spark, sf)
    return scoring.run_inventory(r, r, 70)


@query(f"with {SAMPLES} select dataset, context_id, run_id, repeat_index from samples")
def w13_assign_repeat_index(spark, sf):
    return staging.samples(spark, sf).select(*RUN, "repeat_index")


MEDIAN = RUNS + """, cand as (select *, dense_rank() over (partition by dataset, context_id order by overall_coverage) as dr from runs where is_pass_xrun and has_coverage and overall_coverage < 1),
mid as (select *, (max(dr) over (partition by dataset, context_id) - 1) // 2 + 1 as mr from cand),
med as (select * from (select *, row_number() over (partition by dataset, context_id order by run_id) as z from mid where dr = mr) where z = 1),
wor as (select * from (select *, row_number() over (partition by dataset, context_id order by overall_coverage, run_id) as z from cand) where z = 1),
fai as (select dataset, context_id, min(run_id) as run_id from runs where not is_pass_xrun group by 1, 2)"""


@query(f"with {MEDIAN} select dataset, context_id, run_id, overall_coverage from med")
def w1_select_median(spark, sf):
    return selection.select_median(staging.runs(spark, sf)).select(*RUN, "overall_coverage")


@query(f"with {MEDIAN} select dataset, context_id, run_id, overall_coverage from wor")
def w2_select_worst(spark, sf):
    return selection.select_worst(staging.runs(spark, sf)).select(*RUN, "overall_coverage")


@query(f"with {MEDIAN} select * from fai")
def w3_select_xrun_fail(spark, sf):
    return selection.select_xrun_fail(staging.runs(spark, sf)).select(*RUN)


@query(f"""with {MEDIAN}, gap as (select m.dataset, m.context_id from med m join wor w on m.dataset = w.dataset and m.context_id = w.context_id where m.overall_coverage - w.overall_coverage > 0.1)
select dataset, context_id, run_id, 'median' as pick from med union all select w.dataset, w.context_id, w.run_id, 'worst' from wor w join gap g on w.dataset = g.dataset and w.context_id = g.context_id
union all select *, 'xrun_fail' from fai""")
def w4_e7_select_splits(spark, sf):
    return jobs.select_splits(staging.runs(spark, sf)).select(*RUN, "pick")


@query(f"""with {RUNS}, o as (select *, row_number() over (partition by dataset, context_id order by ord desc, run_id desc) - 1 as round_id from runs where overall_coverage < 1)
select dataset, context_id, run_id, round_id::int as round_id from o where round_id < 2""")
def w5_select_rounds_best(spark, sf):
    runs = staging.runs(spark, sf)
    two = runs.where("overall_coverage < 1.0").groupBy(*KEY).agg(F.least(F.count("*"), F.lit(2)).alias("n")).agg(F.sum("n")).first()[0]
    return selection.select_rounds(runs, two, "best").select(*RUN, "round_id")


def _budget_sql(order: str, n: str, seed: int) -> str:
    """Rounds of o (round_id) up to n rows, of the last round the contexts that come first by md5."""
    return f"""{order}, c as (select round_id, count(*) as c from o group by 1), u as (select round_id, sum(c) over (order by round_id) as upto, c from c),
last as (select * from u where upto >= {n} order by round_id limit 1),
z as (select o.*, row_number() over (partition by o.round_id order by md5(concat_ws('|', {seed}, dataset, context_id))) as pos from o)
select dataset, context_id, run_id, round_id from z where round_id < (select round_id from last) or round_id = (select round_id from last) and pos <= (select {n} - (upto - c) from last)"""


@query(_budget_sql(f"with {RUNS}, o as (select *, row_number() over (partition by dataset, context_id order by md5(concat_ws('|', 7, dataset, context_id, run_id)), run_id) - 1 as round_id from runs where overall_coverage < 1)", "77", 7))
def w5_select_rounds_random(spark, sf):
    return selection.select_rounds(staging.runs(spark, sf), 77, "random", 7).select(*RUN, F.col("round_id").cast("bigint").alias("round_id"))


@query(_budget_sql(f"with {RUNS}, o as (select *, row_number() over (partition by dataset, context_id order by run_id desc) - 1 as round_id from runs)", "(select ceil(count(*) * 0.3) from runs)", 42))
def w6_preselect_ratio(spark, sf):
    return selection.preselect_ratio(staging.runs(spark, sf), 0.3).select(*RUN, F.col("round_id").cast("bigint").alias("round_id"))


@query(f"with {ROUND_INPUTS} select dataset, context_id, repeat_index, c as round_index, best.a as is_pass_xrun, best.b as has_coverage, best.c as is_pass_targets, best.d as overall_coverage from after")
def w7_post_round_best(spark, sf):
    e = rounds.slim_entries(staging.round_inputs(spark, sf)).withColumn("round_index", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return e.withColumn("b", rounds.post_round_best(F.col("entries"), F.col("round_index"))).select(*KEY, "repeat_index", "round_index", *(F.col(f"b.{c}").alias(c) for c in staging.RESULT_ORDER))


@query(f"""with {ROUND_INPUTS}, t as (select c, dataset, context_id, count(*) as n, count(best) as here, sum(best.d) as cov, avg(best.a::int) as x1, max(best.a::int) as xk, avg(best.c::int) as t1, max(best.c::int) as tk from after group by 1, 2, 3)
select c as max_round, round(avg(x1), 6) as pass_xrun_at_1, round(avg(xk), 6) as pass_xrun_at_k, round(avg(t1), 6) as pass_targets_at_1, round(avg(tk), 6) as pass_targets_at_k, round(sum(cov) / sum(here), 6) as avg_overall_cov,
 sum(n)::bigint as samples, sum(n - here)::bigint as missing, least(5, greatest(max(here), 1))::int as pass_k from t group by 1""")
def a8_metrics_by_round(spark, sf):
    return _r6(rounds.metrics_by_round(staging.round_inputs(spark, sf)))


@query(f"""with {ROUND_INPUTS} select a.c as round_index, count(*) filter (a.best.d > b.best.d) as improved, count(*) filter (a.best is not null and b.best is not null) as total from after a join after b
 on a.dataset = b.dataset and a.context_id = b.context_id and a.repeat_index = b.repeat_index and a.c = b.c + 1 group by 1""")
def a9_round_improvements(spark, sf):
    return rounds.round_improvements(staging.round_inputs(spark, sf))


@query(f"""with {ROUNDS}, e as (select max(round_index) as r from rounds group by dataset, context_id, repeat_index having bool_or(k % 17 = 0) and arg_min(k, round_index) % 19 <> 7)
select g.i as round_index, count(e.r) as errors from (select unnest(range(4))::int as i) g left join e on e.r = g.i group by 1""")
def a10_errors_by_round(spark, sf):
    return rounds.errors_by_round(staging.round_inputs(spark, sf))


@query(f"""with {PAIRS}, u as (select p_x, p_ord < ord as up from pairs where has_prev)
select count(*) as total, count(*) filter (up) as improved, count(*) filter (up and not p_x) as improved_xrun, count(*) filter (up and p_x) as improved_coverage,
 count(*) filter (not p_x) as xrun_candidates, count(*) filter (p_x) as coverage_candidates from u""")
def a12_improvement_summary(spark, sf):
    return rounds.improvement_summary(staging.pairs(spark, sf))


@query(f"""with {ROUNDS}, o as (select *, row_number() over (partition by dataset, context_id, repeat_index order by ord, round_index) as rk from rounds)
select a.dataset, a.context_id, a.run_id, (select arg_max(b.round_index, b.rk) from o b where b.dataset = a.dataset and b.context_id = a.context_id and b.repeat_index = a.repeat_index and b.round_index <= a.round_index)::int as best_round from o a""")
def w9_running_best(spark, sf):
    return rounds.running_best(staging.rounds(spark, sf)).select(*RUN, "best_round")


MSGS = """x as (select *, 'answer ' || run_id as ans, 'feedback ' || status as fb from o),
first as (select dataset, context_id, repeat_index, 'rules|task ' || run_id as msgs from x where round_index = 0)"""


def _talk(spark, sf) -> DataFrame:
    say = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return staging.rounds(spark, sf).withColumns({
        "messages": F.array(say("system", F.lit("rules")), say("user", F.concat(F.lit("task "), F.col("run_id")))),
        "answer": F.array(say("assistant", F.concat(F.lit("answer "), F.col("run_id")))),
        "feedback": F.array(say("user", F.concat(F.lit("feedback "), F.col("status")))),
    })


def _joined(df: DataFrame) -> DataFrame:
    return df.select(*RUN, F.array_join(F.transform("prompt", lambda m: m["content"]), "|").alias("prompt"))


@query(f"""with {ROUNDS}, o as (select *, row_number() over (partition by dataset, context_id, repeat_index order by ord, round_index) as rk from rounds), {MSGS}
select a.dataset, a.context_id, a.run_id, case when a.round_index = 0 then f.msgs else f.msgs || '|' ||
 (select arg_max(b.ans || '|' || b.fb, b.rk) from x b where b.dataset = a.dataset and b.context_id = a.context_id and b.repeat_index = a.repeat_index and b.round_index < a.round_index) end as prompt
from x a join first f on a.dataset = f.dataset and a.context_id = f.context_id and a.repeat_index = f.repeat_index""")
def w10_markov_snapshot(spark, sf):
    return _joined(rounds.markov_snapshot(_talk(spark, sf)))


@query(f"""with {ROUNDS}, o as (select * from rounds), {MSGS}
select a.dataset, a.context_id, a.run_id, f.msgs || coalesce('|' || string_agg(a.ans || '|' || a.fb, '|') over (partition by a.dataset, a.context_id, a.repeat_index order by a.round_index rows between unbounded preceding and 1 preceding), '') as prompt
from x a join first f on a.dataset = f.dataset and a.context_id = f.context_id and a.repeat_index = f.repeat_index""")
def w10_full_history(spark, sf):
    return _joined(rounds.full_history(_talk(spark, sf)))


@query(f"""with {ROUNDS}, f as (select *, coalesce(max((value >= 30)::int) over (partition by dataset, context_id, repeat_index order by round_index rows between unbounded preceding and 1 preceding), 0) as done from rounds)
select dataset, context_id, run_id from f where done = 0""")
def w11_stop_when_full(spark, sf):
    r = staging.rounds(spark, sf).withColumn("overall_coverage", F.least(F.col("value") / 30.0, F.lit(1.0)))
    return rounds.stop_when_full(r).select(*RUN)


@query(f"with {ROUNDS} select dataset, context_id, run_id, lag(run_id) over w as prev_run_id, lag(status) over w as prev_status from rounds window w as (partition by dataset, context_id, repeat_index order by round_index)")
def w12_previous_state(spark, sf):
    return rounds.previous_state(staging.rounds(spark, sf), ("run_id", "status")).select(*RUN, "prev_run_id", "prev_status")


def _history(spark, sf) -> DataFrame:
    """Rounds whose k is a multiple of 11 are lost."""
    return staging.rounds(spark, sf).where("k % 11 <> 0").select(*KEY, F.col("repeat_index").alias("separation_id"), "round_index", F.col("run_id").alias("run_dir"))


WHOLE = ROUNDS + """, h as (select dataset, context_id, repeat_index as separation_id, round_index, run_id as run_dir from rounds where k % 11 <> 0),
whole as (select dataset, context_id, separation_id, max(round_index) as top from h group by 1, 2, 3 having min(round_index) = 0 and max(round_index) + 1 = count(*))"""


@query(f"with {WHOLE} select h.* from h join whole using (dataset, context_id, separation_id)")
def w15_resume_check(spark, sf):
    return rounds.resume_check(_history(spark, sf))


@query(f"with {WHOLE} select top as max_round, count(*) as n from whole group by 1")
def w15_resume_histogram(spark, sf):
    return rounds.resume_histogram(rounds.resume_check(_history(spark, sf)))


@query(f"with {WHOLE} select dataset, context_id, separation_id, top as max_round from whole")
def j9_attach_resume(spark, sf):
    h = _history(spark, sf).withColumns({"error": F.lit(None).cast("string"), "round_index": F.col("round_index").cast("string"), "separation_id": F.col("separation_id").cast("string")})
    items = staging.rounds(spark, sf).select(*KEY, F.col("repeat_index").alias("separation_id")).distinct()
    return rounds.resume_order(rounds.attach_resume(items, h)).select(*KEY, "separation_id", "max_round")


@query(f"""with {RUNS}, c as (select 'ds' || (c_custkey % 3) as dataset, case when c_custkey % 2 = 0 then 'solo_' else 'team_' end || lpad(c_custkey::varchar, 6, '0') as context_id, c_name from customer)
select r.dataset, r.context_id, r.run_id, c.c_name, c.c_name is not null as found from runs r left join c using (dataset, context_id)""")
def j1_attach_contexts(spark, sf):
    c = staging.load(spark, sf, "customer")
    contexts = c.select(F.concat(F.lit("ds"), F.col("c_custkey") % 3).alias("dataset"), F.concat(F.when(F.col("c_custkey") % 2 == 0, "solo_").otherwise("team_"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("context_id"), "c_name", "c_custkey")
    hit, miss = attach.attach_contexts(staging.runs(spark, sf), contexts, "c_custkey")
    return hit.select(*RUN, "c_name", F.lit(True).alias("found")).unionByName(miss.select(*RUN, F.lit(None).cast("string").alias("c_name"), F.lit(False).alias("found")))


@query(f"with {BEST} select dataset, context_id, run_id, status from best")
def j2_keep_best_run(spark, sf):
    runs = staging.runs(spark, sf)
    return attach.keep_best_run(runs, scoring.best_of_n(runs, "event_id")).select(*RUN, "status")


@query(f"with {BEST} select dataset, context_id, run_id as prev_run_id, 'tb_' || run_id as tb_content, '{{}}' || event_id as prev_result_json_raw from best where k % 7 <> 0")
def j3_j11_previous_state(spark, sf):
    runs = staging.runs(spark, sf)
    tbs = runs.where("k % 7 <> 0").select(*RUN, F.lit("tb.sv").alias("name"), F.concat(F.lit("tb_"), "run_id").alias("content"))
    results = runs.select(*RUN, F.concat(F.lit("{}"), "event_id").alias("result_json"))
    return attach.previous_state(scoring.best_of_n(runs, "event_id"), tbs, results).select(*KEY, "prev_run_id", F.col("prev_tb.content").alias("tb_content"), "prev_result_json_raw")


FILES = RUNS + """, f as (select dataset, context_id, run_id, case k % 5 when 0 then 'rtl.sv' when 1 then 'tb_' || k || '.sv' when 2 then 'a.v' when 3 then 'notes.txt' else 'zz.sv' end as name from runs),
g as (select dataset, context_id, context_id as run_id, name from f)"""


def _files(spark, sf) -> DataFrame:
    """All files of a context as those of one run."""
    k = F.col("k")
    name = F.when(k % 5 == 0, "rtl.sv").when(k % 5 == 1, F.concat(F.lit("tb_"), k.cast("string"), F.lit(".sv"))).when(k % 5 == 2, "a.v").when(k % 5 == 3, "notes.txt").otherwise("zz.sv")
    return staging.runs(spark, sf).select(*KEY, F.col("context_id").alias("run_id"), name.alias("name"), F.lit("x").alias("content")).distinct()


@query(f"with {FILES} select dataset, context_id, arg_min(name, (case when starts_with(name, 'tb_') then '0' else '1' end) || name) as name from g where name <> 'rtl.sv' and regexp_matches(name, '[.](sv|v)$') group by 1, 2")
def w14_pick_testbench(spark, sf):
    files = _files(spark, sf)
    design = files.select(*KEY).distinct().select(*KEY, F.lit("rtl.sv").alias("name"), F.lit("rtl").alias("kind"))
    return attach.pick_testbench(files, design, "label").select(*KEY, "name")


@query(f"""with {FILES}, d as (select distinct dataset, context_id, name from g), s as (select dataset, context_id, count(*) filter (regexp_matches(name, '[.](sv|v|vh)$')) as n, min(name) filter (regexp_matches(name, '[.](sv|v|vh)$')) as name from d group by 1, 2)
select 'strict' as policy, dataset, context_id, case when n = 1 then name end as name, case when n <> 1 then n || ' testbench files' end as pick_error from s
union all select 'resume', dataset, context_id, arg_min(name, (case when ends_with(name, '.sv') then '0' else '1' end) || name), null from d where name <> 'rtl.sv' group by 2, 3""")
def w14_strict_and_resume(spark, sf):
    files = _files(spark, sf)
    design = files.select(*KEY).distinct().select(*KEY, F.lit("rtl.sv").alias("name"), F.lit("rtl").alias("kind"))
    strict, resume = (attach.pick_testbench(files, design, policy).select(F.lit(policy).alias("policy"), *KEY, "name", "pick_error") for policy in ("strict", "resume"))
    return strict.unionByName(resume)


@query(f"with {RUNS} select dataset, context_id, run_id from runs order by dataset, context_id, run_id offset 100 limit 250")
def p3_slice_rows(spark, sf):
    return blend.slice_rows(staging.runs(spark, sf), 100, 350, *RUN).select(*RUN)


@query(f"with {RUNS} select dataset, context_id, run_id, unnest(range(3))::int as repeat_index from runs")
def u3_repeat_items(spark, sf):
    return blend.repeat_items(staging.runs(spark, sf).select(*RUN), 3)


@query(f"with {RUNS} select dataset, context_id, run_id from runs order by md5(concat_ws('|', 42, dataset, context_id, run_id)) limit 200")
def t2_sample_exact(spark, sf):
    return blend.sample_exact(staging.runs(spark, sf), 200, 42, *RUN).select(*RUN)


@query(f"with {RUNS} select dataset, context_id, run_id, row_number() over (order by md5(concat_ws('|', 42, dataset, context_id, run_id))) - 1 as position from runs")
def t3_shuffle_rows(spark, sf):
    shuffled = blend.shuffle_rows(staging.runs(spark, sf).select(*RUN), 42, *RUN)
    return blend.positions(shuffled, blend.seeded(42, *RUN), *RUN)


@query(f"with {WHOLE} select dataset, context_id, separation_id, top as max_round, row_number() over (order by top desc, dataset, context_id, separation_id) - 1 as position from whole")
def t1_resume_order(spark, sf):
    h = rounds.resume_check(_history(spark, sf)).groupBy(*KEY, "separation_id").agg(F.max("round_index").alias("max_round"))
    return blend.positions(rounds.resume_order(h), *rounds.advanced_first())


@query(f"with {RUNS} select context_id, run_id, coalesce(nullif(case when k % 3 = 0 then '' else run_id end, ''), nullif(case when k % 2 = 0 then 'task' end, ''), 'path') as found from runs")
def f21_run_id_fallback(spark, sf):
    from runforge.functions.text import first_run_id

    k = F.col("k")
    return staging.runs(spark, sf).select("context_id", "run_id", first_run_id(F.when(k % 3 == 0, "").otherwise(F.col("run_id")), F.when(k % 2 == 0, "task"), F.lit("path")).alias("found"))


REPORTS = PADDED + ", " + TASKS + """, means as (select 'mean_cov' as report, avg(overall_coverage) as m from five where is_pass_xrun group by repeat_index
 union all select 'mean_cov_padded', avg(case when is_pass_xrun then overall_coverage else 0 end) from padded group by repeat_index)"""


@query(f"""with {REPORTS} select 'metrics' as report, x.m as name, round(avg(x.a), 6) as at_1, round(avg(x.k), 6) as at_k from t group by 2
union all select 'per_task', dataset || '/' || context_id || '/' || x.m, round(x.a, 6), round(x.k::double, 6) from t
union all select report, 'all', round(avg(m), 6), round(max(m), 6) from means group by 1
union all select 'cohorts', split_part(context_id, '_', 1), round(avg(x.a), 6), round(avg(x.k), 6) from t where x.m = 'is_pass_targets' group by 2
union all select 'tokens', dataset || '/' || context_id || '/' || repeat_index, k::double, (k * 2)::double from samples""")
def e6_evaluate_samples(spark, sf):
    k = F.coalesce("k", F.lit(0)).cast("bigint")
    s = staging.samples(spark, sf).withColumns({"prompt_tokens": k, "completion_tokens": k, "reasoning_tokens": F.lit(0).cast("bigint"), "total_tokens": k * 2, "latency_seconds": F.lit(1.0)})
    out = jobs.evaluate_samples(s, s, staging.most_samples(staging.runs(spark, sf)), COHORTS)
    name = {
        "metrics": F.col("metric"), "per_task": F.concat_ws("/", *KEY, "metric"), "mean_cov": F.lit("all"), "mean_cov_padded": F.lit("all"),
        "cohorts": F.col("cohort"), "tokens": F.concat_ws("/", *KEY, F.col("repeat_index").cast("string")),
    }
    every = None
    for report, rows in out.items():
        if report == "tokens":
            rows = rows.withColumns({"at_1": F.col("prompt_tokens").cast("double"), "at_k": F.col("total_tokens").cast("double")})
        one = rows.select(F.lit(report).alias("report"), name[report].alias("name"), "at_1", "at_k")
        every = one if every is None else every.unionByName(one)
    return _r6(every)


@query(f"""with {ROUND_INPUTS}, t as (select c, dataset, context_id, count(*) as n, count(best) as here, sum(best.d) as cov, avg(best.a::int) as x1, max(best.a::int) as xk, avg(best.c::int) as t1, max(best.c::int) as tk from after group by 1, 2, 3),
e as (select max(round_index) as r from rounds group by dataset, context_id, repeat_index having bool_or(k % 17 = 0) and arg_min(k, round_index) % 19 <> 7)
select 'metrics' as report, c as round_index, round(avg(x1), 6) as a, round(avg(xk), 6) as b, round(avg(t1), 6) as c, round(avg(tk), 6) as d, round(sum(cov) / sum(here), 6) as e from t group by 2
union all select 'improvements', a.c, count(*) filter (a.best.d > b.best.d), count(*) filter (a.best is not null and b.best is not null), null, null, null from after a join after b on a.dataset = b.dataset and a.context_id = b.context_id and a.repeat_index = b.repeat_index and a.c = b.c + 1 group by 2
union all select 'errors', g.i, count(e.r), null, null, null, null from (select unnest(range(4))::int as i) g left join e on e.r = g.i group by 2""")
def e8_report_rounds(spark, sf):
    out = jobs.report_rounds(staging.round_inputs(spark, sf))
    cols = {
        "metrics": ("max_round", "pass_xrun_at_1", "pass_xrun_at_k", "pass_targets_at_1", "pass_targets_at_k", "avg_overall_cov"),
        "improvements": ("round_index", "improved", "total"), "errors": ("round_index", "errors"),
    }
    every = None
    for report, (at, *values) in cols.items():
        shown = [F.col(v).cast("double").alias(x) for v, x in zip(values, "abcde", strict=False)] + [F.lit(None).cast("double").alias(x) for x in "abcde"[len(values) :]]
        one = out[report].select(F.lit(report).alias("report"), F.col(at).alias("round_index"), *shown)
        every = one if every is None else every.unionByName(one)
    return _r6(every)
