"""The given tables in the shapes that operators take. SQL has the same expressions for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runforge.operators.scoring import KEY, assign_repeat_index
from runforge.schemas import COV_RESULT, FILE, MESSAGE, RESULT_ORDER

SLIM = "struct<is_pass_xrun: boolean, has_coverage: boolean, is_pass_targets: boolean, overall_coverage: double>"
COHORTS = {"solo": "solo_", "team": "team_"}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as scored runs: a user is a context, an event a run."""
    e = load(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(F.col("event_type") == "error", "xrun_failed").when(F.col("event_type") == "signup", "imc_report_summary_failed").otherwise("success")
    out = e.select(
        F.concat(F.lit("ds"), F.col("user_id") % 3).alias("dataset"),
        F.concat(F.when(F.col("user_id") % 2 == 0, "solo_").otherwise("team_"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("context_id"),
        F.lpad(F.col("event_id").cast("string"), 10, "0").alias("run_id"),
        "event_id", "value", k.alias("k"), status.alias("status"),
    )
    ok = F.col("status") == "success"
    return out.withColumns({
        "is_pass_xrun": F.col("status") != "xrun_failed",
        "has_coverage": ok,
        "overall_coverage": F.when(ok, F.least(F.col("value") / F.lit(200.0), F.lit(1.0))).otherwise(0.0),
        "target": F.lit(50) + F.col("k") / F.lit(2.0),
    }).withColumn("is_pass_targets", ok & (F.col("overall_coverage") * 100 >= F.col("target") - 40))


RUNS = """
r0 as (select 'ds' || (user_id % 3) as dataset, case when user_id % 2 = 0 then 'solo_' else 'team_' end || lpad(user_id::varchar, 6, '0') as context_id,
  lpad(event_id::varchar, 10, '0') as run_id, event_id, value, json_extract_string(props, '$.k')::int as k,
  case event_type when 'error' then 'xrun_failed' when 'signup' then 'imc_report_summary_failed' else 'success' end as status from events),
r1 as (select *, status <> 'xrun_failed' as is_pass_xrun, status = 'success' as has_coverage,
  case when status = 'success' then least(value / 200e0, 1e0) else 0e0 end as overall_coverage, 50 + k / 2e0 as target from r0),
runs as (select *, has_coverage and overall_coverage * 100 >= target - 40 as is_pass_targets,
  {'a': is_pass_xrun, 'b': has_coverage, 'c': has_coverage and overall_coverage * 100 >= target - 40, 'd': overall_coverage} as ord from r1)
"""


def samples(spark: SparkSession, sf_dir: str, n: int | None = None) -> DataFrame:
    return assign_repeat_index(runs(spark, sf_dir), n)


def most_samples(runs: DataFrame) -> int:
    """How many runs the largest context has, 0 if there are none; counted, not numbered."""
    return runs.groupBy(*KEY).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).cast("int")).first()[0]


SAMPLES = RUNS + ", samples as (select *, (row_number() over (partition by dataset, context_id order by run_id) - 1)::int as repeat_index from runs)"

ROUNDS_IN_SAMPLE = 4


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four runs of a context in a row are the rounds of one sample."""
    s = samples(spark, sf_dir)
    return s.withColumns({"round_index": F.col("repeat_index") % ROUNDS_IN_SAMPLE, "repeat_index": F.floor(F.col("repeat_index") / ROUNDS_IN_SAMPLE).cast("int")})


ROUNDS = SAMPLES + ", rounds as (select * replace ((repeat_index // 4)::int as repeat_index), repeat_index % 4 as round_index from samples)"


def round_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of each sample: every round with the best result before it, and the final best if there are all four rounds.

    A round whose k is a multiple of 17 has an error. A sample whose first k leaves 7 of 19
    has nothing but an error and so no result.
    """
    w = Window.partitionBy(*KEY, "repeat_index").orderBy("round_index").rowsBetween(Window.unboundedPreceding, -1)
    nothing = F.struct(F.lit(False), F.lit(False), F.lit(False), F.lit(0.0)).cast(SLIM)
    best = F.coalesce(F.max(F.struct(*RESULT_ORDER)).over(w).cast(SLIM), nothing)
    rows = rounds(spark, sf_dir).withColumn("best", best).groupBy(*KEY, "repeat_index").agg(
        F.array_sort(F.collect_list(F.struct("round_index", "k", "best"))).alias("rows"), (F.min_by("k", "round_index") % 19 == 7).alias("gone"), F.max(F.struct(*RESULT_ORDER)).cast(SLIM).alias("final"), F.count("*").alias("n")
    )
    none, messages = F.lit(None).cast(COV_RESULT), F.array().cast(f"array<{MESSAGE}>")

    def result(c: Column) -> Column:
        return F.struct(*(c[x].alias(x) for x in RESULT_ORDER), F.lit(None).cast("map<string, double>").alias("misc"))

    def entry(i: Column, best: Column, final: Column, error: Column) -> Column:
        return F.struct(i.alias("round_index"), messages.alias("messages"), best.alias("best_cov_result"), final.alias("final_best_cov_result"), error.alias("error"))

    each = F.transform("rows", lambda x: entry(x["round_index"], result(x["best"]), none, F.when(x["k"] % 17 == 0, F.lit("failed"))))
    last = entry(F.lit(None).cast("int"), none, result(F.col("final")), F.lit(None).cast("string"))
    lost = F.array(entry(F.lit(None).cast("int"), none, none, F.lit("failed")))
    return rows.select(*KEY, "repeat_index", F.when(F.col("gone"), lost).when(F.col("n") == ROUNDS_IN_SAMPLE, F.concat(each, F.array(last))).otherwise(each).alias("entries"))


# b: the order of the best result before each round; after: that after round c.
ROUND_INPUTS = (
    ROUNDS
    + """,
b as (select *, max(ord) over (partition by dataset, context_id, repeat_index order by round_index rows between unbounded preceding and current row) as upto,
  max(round_index) over (partition by dataset, context_id, repeat_index) as last_round,
  max(ord) over (partition by dataset, context_id, repeat_index) as final, first_value(k) over (partition by dataset, context_id, repeat_index order by round_index) % 19 = 7 as gone from rounds),
inputs as (select distinct dataset, context_id, repeat_index, last_round, final, gone from b),
caps as (select unnest(range(4))::int as c),
after as (select i.dataset, i.context_id, i.repeat_index, c,
  case when i.gone then null when c < i.last_round then (select upto from b where b.dataset = i.dataset and b.context_id = i.context_id and b.repeat_index = i.repeat_index and b.round_index = c)
       when i.last_round = 3 then i.final
       when i.last_round = 0 then {'a': false, 'b': false, 'c': false, 'd': 0e0}
       else (select upto from b where b.dataset = i.dataset and b.context_id = i.context_id and b.repeat_index = i.repeat_index and b.round_index = i.last_round - 1) end as best
  from inputs i, caps)
"""
)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each round after the first with its result and the one before, and a map of two metrics of which one is null at times."""
    w = Window.partitionBy(*KEY, "repeat_index").orderBy("round_index")
    misc = F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("Toggle").alias("key"), F.when(F.col("has_coverage"), F.col("value") / F.lit(250.0)).alias("value")),
        F.struct(F.lit("Block").alias("key"), F.when(F.col("has_coverage") & (F.col("k") % 5 != 0), F.col("k") / F.lit(100.0)).alias("value")),
    ), lambda p: p["value"].isNotNull()))
    cov = F.struct(*RESULT_ORDER, misc.alias("misc"))
    return rounds(spark, sf_dir).withColumn("cov_result", cov).withColumn("prev_cov_result", F.lag("cov_result").over(w)).select(*KEY, "repeat_index", "round_index", "run_id", "event_id", "cov_result", "prev_cov_result")


PAIRS = (
    ROUNDS
    + """,
m as (select *, case when has_coverage then value / 250e0 end as toggle, case when has_coverage and k % 5 <> 0 then k / 100e0 end as block from rounds),
pairs as (select *, lag(run_id) over w is not null as has_prev, lag(is_pass_xrun) over w as p_x, lag(has_coverage) over w as p_h, lag(is_pass_targets) over w as p_t, lag(overall_coverage) over w as p_cov,
  lag(toggle) over w as p_toggle, lag(block) over w as p_block, lag(ord) over w as p_ord
  from m window w as (partition by dataset, context_id, repeat_index order by round_index)),
valid as (select * from pairs where has_prev and has_coverage),
better as (select * from valid where not p_h or (overall_coverage > p_cov + 0.01
  and (p_toggle is null or coalesce(toggle >= p_toggle, false)) and (p_block is null or coalesce(block >= p_block, false))))
"""
)


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chat rows: the last assistant turn is the output, what comes before it the input."""
    c = load(spark, sf_dir, "conversations")
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("t"))
    last = F.array_max(F.transform("t", lambda x, i: F.when(x["role"] == "assistant", i)))
    said = F.transform(F.slice("t", F.lit(1), F.coalesce(last, F.lit(0))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    out = F.get("t", last)
    return turns.where(F.exists("t", lambda x: x["role"] == "assistant")).select(
        F.lit("talk").alias("dataset"), F.col("conv_id").cast("string").alias("context_id"), F.lit("direct").alias("run_type"), said.alias("input"), F.struct(out["role"].alias("role"), out["content"].alias("content")).alias("output")
    )


CHATS = """
last as (select conv_id, max(turn) as lt from conversations where role = 'assistant' group by 1),
said as (select c.*, l.lt, row_number() over (partition by c.conv_id order by turn) as pos, count(*) over (partition by c.conv_id) as n from conversations c join last l using (conv_id) where c.turn < l.lt),
outp as (select c.conv_id, c.text as output from conversations c join last l on c.conv_id = l.conv_id and c.turn = l.lt)
"""


def designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as designs: four modules in a design, one instance of the next module if the part's size is odd, comments and macros around."""
    p = load(spark, sf_dir, "part")
    name = F.format_string("m%d", "p_partkey")
    inside = F.when(F.col("p_size") % 2 == 1, F.format_string("  m%d #(.W(8)) u%d (.clk(clk));\n", F.col("p_partkey") + 1, F.col("p_partkey"))).otherwise("")
    text = F.concat(F.format_string("`define SIZE %d\n// part %s\n", "p_size", "p_name"), F.lit("module "), name, F.lit(" (input clk);\n"), inside, F.lit("  /* m1 x (y); */ wire [`SIZE:0] w;\nendmodule\n"))
    each = p.select(F.floor(F.col("p_partkey") / 4).cast("bigint").alias("d"), "p_partkey", "p_size", text.alias("t"))
    return each.groupBy("d").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "t"))), lambda x: F.struct(F.format_string("m%d.sv", x["p_partkey"]).alias("name"), x["t"].alias("content"))).alias("rtl_files"), F.sum("p_size").cast("int").alias("size")
    ).select(
        F.lit("parts").alias("dataset"), F.col("d").cast("string").alias("context_id"), "rtl_files",
        F.when(F.col("size") % 3 == 0, F.array(F.struct(F.lit("spec.md").alias("name"), F.col("size").cast("string").alias("content")))).otherwise(F.array().cast(f"array<{FILE}>")).alias("spec_files"),
        F.lit(None).cast("int").alias("rtl_tokens"), F.lit(None).cast("array<string>").alias("potential_top"), "size",
    )


DESIGNS = """
mods as (select p_partkey // 4 as d, p_partkey, p_size, 'm' || p_partkey as m, case when p_size % 2 = 1 then 'm' || (p_partkey + 1) end as i from part),
tops as (select d, sum(p_size)::int as size, case when count(*) = 1 then list(m) else list_sort(list(m) filter (m not in (select i from mods x where x.d = mods.d and i is not null))) end as tops from mods group by d)
"""
