"""Queries over jobs, readers and writers with their SQL. Files are staged from the given tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runforge.lineage import shared_path
from runforge.operators import blend, scoring
from runforge.plans import jobs, staging
from runforge.plans.run_queries import BEST, RESULTS, RUN, VERDICT, _budget_sql, _results, query
from runforge.plans.staging import CHATS, COHORTS, KEY, ROUND_INPUTS, RUNS
from runforge.plans.text_queries import SIM
from runforge.schemas import MESSAGE
from runforge.sources import compaction, readers, writers


def write_files(rows: DataFrame, root: str) -> None:
    """A file for each row (path, content) below root, from the tasks that hold the rows; a file appears whole, whichever attempt of a task writes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                folder, _, name = f"{base}/{path}".rpartition("/")
                store.create_dir(folder, recursive=True)
                part = f"{folder}/.{name}.{uuid.uuid4()}"  # hidden from readers
                with store.open_output_stream(part) as f:
                    f.write(content.encode())
                store.move(part, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    rows.select("path", "content").mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def _below(spark) -> str:
    path = shared_path(spark)
    return path if "://" in path else f"file://{path}"


def _say(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), text.alias("content"))


def _best(spark, sf) -> DataFrame:
    return scoring.best_of_n(staging.runs(spark, sf), "event_id")


# S5: every best run leaves a result; some are no JSON object, some lie too high up.
RESULT_FILES = f"""with {BEST}, odd as (select *, case when k % 7 = 3 then 'path too short' when k % 7 = 4 then 'no JSON object' end as reason from best)
select case when reason is null then dataset end as dataset, case when reason is null then context_id end as context_id, case when reason is null then run_id end as run_id, case when reason is null then status end as status, reason from odd"""


def _result_files(spark, sf) -> DataFrame:
    odd = F.col("k") % 7
    path = F.when(odd == 3, F.concat_ws("/", F.col("context_id"), F.concat("run_id", F.lit("_result.json")))).otherwise(F.concat_ws("/", *RUN, F.lit("x_result.json")))
    info = F.struct(F.lit("d").alias("detail"), F.col("value").alias("runtime_sec"))
    content = F.when(odd == 4, F.lit("[1, 2]")).otherwise(F.to_json(F.struct(F.lit(0).alias("returncode"), "status", info.alias("cov_info"))))
    return _best(spark, sf).select(path.alias("path"), content.alias("content"), "k")


def _with_rejects(good: DataFrame, bad: DataFrame) -> DataFrame:
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad.select("reason"), allowMissingColumns=True)


@query(RESULT_FILES)
def s5_read_run_results(spark, sf):
    root = _below(spark)
    write_files(_result_files(spark, sf), root)
    good, bad = readers.read_run_results(spark, root)
    return _with_rejects(good.select(*RUN, "result.status"), bad)


@query(RESULT_FILES.replace(" as status, reason from odd", " as status, case when reason is null then value end as runtime_sec, reason from odd"))
def s5_compacted_results(spark, sf):
    """The same files as a table, taken in two runs of which the second opens the second half only."""
    root, table, files = _below(spark), _below(spark), _result_files(spark, sf)
    for rest in (0, 1):
        write_files(files.where(F.col("k") % 2 == rest), root)
        compaction.compact(spark, root, table, "results")
    good, bad = compaction.compacted(spark, table, "results")
    return _with_rejects(good.select(*RUN, "result.status", "result.cov_info.runtime_sec"), bad)


# S6: histories in round directories, in run directories, and beside the only or one of two run directories; some are no list.
@query(f"""with {BEST}, h as (select *, case when k % 13 = 5 then 'no JSON list' end as reason from best)
select case when reason is null then case when k % 4 = 1 then 'top/' || dataset else dataset end end as dataset, case when reason is null then context_id end as context_id,
 case when reason is null and k % 4 <> 3 then run_id end as run_id, case when reason is null then 'last ' || run_id end as response, reason from h""")
def s6_read_round_histories(spark, sf):
    kind, name = F.col("k") % 4, F.lit("agentic_round_history.json")
    entry = lambda text: F.struct(text.alias("llm_response"), F.col("run_id").alias("run_id"))
    whole = F.to_json(F.array(entry(F.lit("first")), entry(F.concat(F.lit("last "), "run_id"))))
    b = _best(spark, sf).withColumn("content", F.when(F.col("k") % 13 == 5, F.lit("{}")).otherwise(whole))
    # Of four parts: root/dataset/context/file, so the dataset here is two directories.
    where = F.when(kind == 0, F.concat_ws("/", *RUN, F.lit("round_1"), name)).when(kind == 1, F.concat_ws("/", F.lit("top"), *RUN, name)).otherwise(F.concat_ws("/", F.col("dataset"), F.lit("x"), F.col("context_id"), name))
    beside = lambda run: b.where("k % 4 >= 2").select(F.concat_ws("/", F.col("dataset"), F.lit("x"), F.col("context_id"), run, F.lit("tb.sv")).alias("path"), F.lit("t").alias("content"), "k")
    root = _below(spark)
    write_files(b.select(where.alias("path"), "content").unionByName(beside(F.col("run_id")).drop("k")).unionByName(beside(F.concat("run_id", F.lit("b"))).where("k % 4 = 3").drop("k")), root)
    good, bad = readers.read_round_histories(spark, root)
    return _with_rejects(good.select(F.regexp_replace("dataset", "/x$", "").alias("dataset"), "context_id", "run_id", F.col("entry.llm_response").alias("response")), bad)


# S7: some lists are broken; of the others counts and what the last round began with and the sample ended with.
@query(f"""with {ROUND_INPUTS}, p as (select *, lag(upto) over (partition by dataset, context_id, repeat_index order by round_index) as prior from b),
f as (select dataset, context_id, repeat_index, case when any_value(gone) then 1 else (count(*) + case when count(*) = 4 then 1 else 0 end)::int end as n_entries, case when any_value(gone) then 1 else count(*) filter (k % 17 = 0)::int end as n_errors,
  max(case when round_index = last_round and not gone then coalesce(prior.d, 0) end) as last_best, case when count(*) = 4 and not any_value(gone) then max(final.d) end as final_best from p group by 1, 2, 3)
select dataset, context_id, repeat_index, n_entries, n_errors, last_best, final_best, null as reason from f where repeat_index % 5 <> 3 union all select null, null, null, null, null, null, null, 'no JSON list' from f where repeat_index % 5 = 3""")
def s7_read_round_inputs(spark, sf):
    path = F.concat(F.concat_ws("/", *KEY), F.lit("/agentic_eval_round_inputs_"), F.col("repeat_index"), F.lit(".json"))
    root = _below(spark)
    content = F.when(F.col("repeat_index") % 5 == 3, F.lit('[{"round_index": 0')).otherwise(F.to_json("entries"))
    write_files(staging.round_inputs(spark, sf).select(path.alias("path"), content.alias("content")), root)
    good, bad = readers.read_round_inputs(spark, root)
    latest = F.try_element_at(F.filter("entries", lambda e: e["round_index"].isNotNull()), F.lit(-1))
    final = F.filter("entries", lambda e: e["final_best_cov_result"].isNotNull())
    rows = good.select(
        *KEY, "repeat_index", F.size("entries").alias("n_entries"), F.size(F.filter("entries", lambda e: e["error"].isNotNull())).alias("n_errors"),
        latest["best_cov_result"]["overall_coverage"].alias("last_best"), F.try_element_at(final, F.lit(1))["final_best_cov_result"]["overall_coverage"].alias("final_best"),
    )
    return _with_rejects(rows, bad)


# S8: a summary for each dataset and block of contexts, some with results and some with run ids only; some keys are absolute.
@query(f"with {BEST} select dataset, context_id, run_id, case when dataset <> 'ds1' then overall_coverage end as overall_coverage from best where dataset <> 'ds1' or k % 3 <> 2")
def s8_read_best_entries(spark, sf):
    key = F.concat_ws("/", *KEY)
    k, ids = F.col("k"), F.col("dataset") == "ds1"
    shown = F.when(~ids, F.when(k % 2 == 0, F.concat(F.lit("/runs/r1/"), key)).otherwise(key)).when(k % 3 == 0, F.concat(F.lit("/elsewhere/r1/"), key)).when(k % 3 == 2, F.concat(F.lit("/other/"), key)).otherwise(key)
    block = F.pmod(F.crc32("context_id"), F.lit(64))
    rows = _best(spark, sf).withColumns({"key": shown, "block": block}).groupBy("dataset", "block")
    entries = rows.agg(F.map_from_entries(F.collect_list(F.struct("key", F.struct("run_id", *staging.RESULT_ORDER)))).alias("full"), F.map_from_entries(F.collect_list(F.struct("key", "run_id"))).alias("ids"))
    content = F.when(ids, F.to_json(F.struct(F.col("ids").alias("best_rids")))).otherwise(F.to_json(F.struct(F.col("full").alias("best_results_output"))))
    root = _below(spark)
    write_files(entries.select(F.concat(F.concat_ws("/", "dataset", F.col("block").cast("string")), F.lit("/eval_stats.json")).alias("path"), content.alias("content")), root)
    return readers.read_best_entries(spark, root, "/runs/r1").select(*RUN, "overall_coverage")


@query("select 0 as source_ord, doc_id, text, lang from documents where lang is not distinct from 'en' union all select 1, doc_id, text, null from documents where lang is distinct from 'en'")
def s9_s10_jsonl(spark, sf):
    d = staging.load(spark, sf, "documents")
    en = F.col("lang").eqNullSafe("en")
    parts = [d.where(en).select("doc_id", "text", "lang"), d.where(~en).select("doc_id", "text", F.lit(None).cast("string").alias("lang"))]
    paths = [_below(spark) for _ in parts]
    for rows, path in zip(parts, paths, strict=True):
        writers.write_jsonl(rows, path)
    return readers.read_jsonl_sources(spark, paths, "doc_id bigint, text string, lang string").select("source_ord", "doc_id", "text", "lang")


@query("select doc_id::varchar as train_id, (doc_id // 2)::varchar as eval_id from documents")
def s11_write_id_pairs(spark, sf):
    root = _below(spark)
    writers.write_id_pairs(staging.load(spark, sf, "documents").select(F.col("doc_id").alias("train_id"), F.floor(F.col("doc_id") / 2).alias("eval_id")), root)
    return spark.read.option("sep", "\t").schema("train_id string, eval_id string").csv(root)


@query(f"with {BEST} select dataset, context_id, run_id, 'median' as pick, null::bigint as total_items from best union all select null, null, null, null, count(*) from best")
def s12_write_selection(spark, sf):
    root = _below(spark)
    writers.write_selection(_best(spark, sf).withColumn("pick", F.lit("median")), root, COHORTS)
    none = [F.lit(None).cast("string").alias(c) for c in (*RUN, "pick")]
    manifest, stats = readers.read_selection(spark, root)
    stats = stats.select(*none, "total_items")
    return manifest.select(*RUN, "pick", F.lit(None).cast("bigint").alias("total_items")).unionByName(stats)


@query("select case when lang is not distinct from 'en' then 'eval' else 'train' end as split, doc_id, lang from documents")
def s13_publish_split(spark, sf):
    root, d = _below(spark), staging.load(spark, sf, "documents").select("doc_id", "lang")
    en = F.col("lang").eqNullSafe("en")
    writers.publish_splits({"eval": d, "train": d.where(~en)}, root)
    writers.publish_split(d.where(en), root, "eval")  # replaces what was published first
    return spark.read.parquet(root).select("split", "doc_id", "lang")


@query("select p_partkey::varchar as context_id, 'qa' as dataset, p_name as rtl, p_type as spec from part union all select (row_number() over (order by p_partkey) - 1)::varchar, 'v', p_name, case when p_size % 2 = 0 then p_type end from part")
def s4_load_dataset(spark, sf):
    p = staging.load(spark, sf, "part")
    c = lambda x: F.struct(F.col(x).alias("content"))
    root = _below(spark)
    p.select(F.array(c("p_brand"), c("p_type")).alias("question"), F.array(c("p_name")).alias("ground_truth"), F.col("p_partkey").alias("problem_id")).write.parquet(f"{root}/qa")
    writers.write_jsonl(p.select(F.col("p_type").alias("question"), F.col("p_name").alias("ground_truth"), (F.col("p_size") % 2 == 0).alias("verified"), "p_partkey"), f"{root}/v.jsonl")
    registry = {"qa": ("qa", f"{root}/qa"), "v": ("verified", f"{root}/v.jsonl", "p_partkey")}
    every = None
    for name in registry:
        got = readers.load_dataset(spark, name, registry)
        one = got.select("context_id", "dataset", F.col("rtl_files")[0]["content"].alias("rtl"), F.get("spec_files", F.lit(0))["content"].alias("spec"))
        every = one if every is None else every.unionByName(one)
    return every


CONTEXTS = "c as (select 'ds' || (c_custkey % 3) as dataset, case when c_custkey % 2 = 0 then 'solo_' else 'team_' end || lpad(c_custkey::varchar, 6, '0') as context_id, c_name, c_mktsegment from customer)"


def _contexts(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    files = lambda name, c: F.array(F.struct(F.lit(name).alias("name"), F.col(c).alias("content")))
    return staging.load(spark, sf, "customer").select(
        F.concat(F.lit("ds"), k % 3).alias("dataset"), F.concat(F.when(k % 2 == 0, "solo_").otherwise("team_"), F.lpad(k.cast("string"), 6, "0")).alias("context_id"),
        files("m.sv", "c_name").alias("rtl_files"), files("s.md", "c_mktsegment").alias("spec_files"), F.concat(F.lit("test "), "c_name").alias("instructions"),
    )


@query(f"""with {BEST}, {CONTEXTS}, f as (select * from best join c using (dataset, context_id) where k % 7 <> 0)
select dataset, context_id, run_id as prev_run_id, unnest(range(2))::int as repeat_index, 'Parsed:' || chr(10) || '- type: full' || chr(10) || '- status: ok' || '|' || 'Run:' || chr(10) || '- status: ' || status || chr(10) || '- stage: '
 || case status when 'xrun_failed' then 'xrun' || chr(10) || '- log: log ' || run_id when 'success' then 'success' || chr(10) || '- coverage: seen ' || run_id else 'imc' || chr(10) || '- log: log ' || run_id end
 || '|' || 'Next:' || chr(10) || case status when 'xrun_failed' then 'fix the build' when 'success' then 'cover more' else 'fix the report' end as said from f""")
def e2_build_followup_requests(spark, sf):
    r = staging.runs(spark, sf)
    tbs = r.where("k % 7 <> 0").select(*RUN, F.lit("tb.sv").alias("name"), F.concat(F.lit("tb "), "run_id").alias("content"))
    info = F.struct(F.concat(F.lit("seen "), "run_id").alias("detail"))
    results = r.select(*RUN, F.to_json(F.struct("status", F.concat(F.lit("log "), "run_id").alias("err_msg"), info.alias("cov_info"))).alias("result_json"))
    ask = {"fix_xrun": "fix the build", "fix_imc": "fix the report", "improve": "cover more"}
    out = jobs.build_followup_requests(_best(spark, sf), _contexts(spark, sf), tbs, results, ask, 2)
    return out.select(*KEY, "prev_run_id", "repeat_index", F.array_join(F.transform("messages", lambda m: m["content"]), "|").alias("said"))


@query(f"""with {RESULTS}, {CONTEXTS}, v as (select *, {VERDICT} as v from res join c using (dataset, context_id))
select dataset, context_id, run_id, '// File: m.sv' || chr(10) || c_name || '// File: s.md' || chr(10) || c_mktsegment || '/test ' || c_name as asked, 'filename: tb.sv' || chr(10) || '```systemverilog' || chr(10) || 'tb ' || run_id || chr(10) || '```' as answer,
 'direct_infer' as run_type, v = 'ok' as is_pass_targets, round(overall_coverage::varchar::decimal(38, 20), 4)::double as overall_coverage, null as eval_error from v where v <> 'error' and k % 7 <> 0
union all select dataset, context_id, run_id, null, null, null, null, null, 'missing instance' from v where v = 'error'""")
def e3_collect_direct_rows(spark, sf):
    r = staging.runs(spark, sf)
    tbs = r.where("k % 7 <> 0").select(*RUN, F.lit("tb.sv").alias("name"), F.concat(F.lit("tb "), "run_id").alias("content"))
    rows, bad = jobs.collect_direct_rows(_results(spark, sf), _contexts(spark, sf), tbs, "rules", "{context}/{instructions}")
    good = rows.select(*RUN, F.col("input")[1]["content"].alias("asked"), F.col("output.content").alias("answer"), "run_type", "cov_result.is_pass_targets", "cov_result.overall_coverage", F.lit(None).cast("string").alias("eval_error"))
    none = [F.lit(None).cast(t).alias(c) for c, t in good.dtypes if c not in (*RUN, "eval_error")]
    return good.unionByName(bad.select(*RUN, *none, "eval_error"))


@query(f"""with {BEST} select dataset, context_id, run_id, cov from (select dataset, context_id, round(overall_coverage::varchar::decimal(38, 20), 4)::double as cov, run_id, k from best) where k % 17 <> 0 and k % 5 <> 1 and k % 7 <> 2""".replace("run_id, cov from", "run_id, 'task ' || run_id || chr(10) as asked, 'answer ' || run_id as answer, cov from"))
def e4_collect_agentic_rows(spark, sf):
    k = F.col("k")
    r = staging.runs(spark, sf).withColumn("misc", F.lit(None).cast("map<string, double>"))
    cov = F.struct(*staging.RESULT_ORDER, "misc")
    # The run's id is in one of three fields, or in the path.
    some = lambda i: F.when(k % 4 == i, F.col("run_id"))
    entry = F.struct(
        F.when(k % 17 == 0, "failed").alias("error"), F.when(k % 5 != 1, F.array(_say("user", F.concat(F.lit("task "), "run_id", F.lit("\n\ninjected"))))).cast(f"array<{MESSAGE}>").alias("messages"),
        F.when(k % 7 != 2, F.concat(F.lit("answer "), "run_id")).alias("llm_response"), some(0).alias("run_id"), some(1).alias("task_hash_id"), F.coalesce(some(2), F.lit("")).alias("prev_run_id"), cov.alias("cov_result"), cov.alias("prev_cov_result"),
    )
    out = jobs.collect_agentic_rows(r.select(*RUN, entry.alias("entry")), "injected", _best(spark, sf))
    return out.select(*RUN, F.col("input")[0]["content"].alias("asked"), F.col("output.content").alias("answer"), F.col("cov_result.overall_coverage").alias("cov"))


@query(f"""with {RUNS}, picked as ({_budget_sql("with o as (select *, row_number() over (partition by dataset, context_id order by run_id desc) - 1 as round_id from runs)", "(select ceil(count(*) * 0.4) from runs)", 42)})
select r.dataset, r.context_id, r.run_id, row_number() over (partition by r.dataset, r.context_id order by r.ord desc, r.run_id desc) - 1 as round_id from picked p join runs r on r.dataset = p.dataset and r.context_id = p.context_id and r.run_id = p.run_id where r.overall_coverage < 1""")
def e7_select_ablation(spark, sf):
    return jobs.select_ablation(staging.runs(spark, sf), ratio=0.4).select(*RUN, F.col("round_id").cast("bigint").alias("round_id"))


@query(f"with {SIM}, hit as (select doc_id, min(item_id) as item_id from l where lcs > 0 and 2.0 * lcs / (m + n) >= 0.3 group by 1) select d.doc_id::varchar as context_id, h.item_id::varchar as eval_id from documents d left join hit h using (doc_id)")
def e9_decontaminate(spark, sf):
    def designs_of(table: str, key: str) -> DataFrame:
        file = F.array(F.struct(F.lit("a.sv").alias("name"), F.coalesce("text", F.lit("")).alias("content")))
        none = F.lit(None).cast("array<struct<name: string, content: string>>")
        return staging.load(spark, sf, table).select(F.col(key).cast("string").alias("context_id"), F.lit("docs").alias("dataset"), file.alias("rtl_files"), none.alias("spec_files"), F.col(key).alias("eval_ord"))

    clean, pairs = jobs.decontaminate(designs_of("documents", "doc_id"), designs_of("benchmark", "item_id"), 0.3)
    return clean.select("context_id", F.lit(None).cast("string").alias("eval_id")).unionByName(pairs.select(F.col("train_id").alias("context_id"), "eval_id"))


@query(f"with {CHATS} select l.conv_id::varchar as context_id, o.output from last l join outp o using (conv_id)")
def s9_chat_rows_from_jsonl(spark, sf):
    """Chat rows written and read again under their own schema."""
    root = _below(spark)
    writers.write_jsonl(staging.chats(spark, sf), root)
    return readers.read_jsonl_sources(spark, [root]).select("context_id", F.col("output.content").alias("output"))


@query(f"with {RUNS} select dataset, context_id, run_id from runs order by dataset, context_id, run_id limit 300")
def p3_limit(spark, sf):
    return blend.slice_rows(staging.runs(spark, sf), None, None, *RUN, limit=300, needs="run_id").select(*RUN)
