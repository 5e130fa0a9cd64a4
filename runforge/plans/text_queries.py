"""Queries over chat rows, designs, sources and similar texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from runforge import lineage
from runforge.functions import chat, patches, text, tokens
from runforge.operators import blend, designs, quantiles, sft, similarity, token_cache
from runforge.plans import jobs, staging
from runforge.plans.run_queries import _r6, query
from runforge.plans.staging import CHATS, DESIGNS, KEY, PAIRS


@query(f"with {PAIRS} select dataset, context_id, run_id from valid")
def p5_valid_pairs(spark, sf):
    return sft.valid_pairs(staging.pairs(spark, sf)).select(*KEY, "run_id")


@query(f"with {PAIRS} select dataset, context_id, run_id from better")
def p6_has_absolute_improvement(spark, sf):
    p = sft.valid_pairs(staging.pairs(spark, sf))
    return p.where(sft.has_absolute_improvement(F.col("cov_result"), F.col("prev_cov_result"))).select(*KEY, "run_id")


@query(f"with {PAIRS} select dataset, context_id, run_id, case when p_h then 'agentic_coverage' else 'agentic_xrun' end as run_type from valid")
def p7_relabel_run_type(spark, sf):
    return sft.valid_pairs(staging.pairs(spark, sf)).select(*KEY, "run_id", sft.relabel_run_type(F.col("prev_cov_result")).alias("run_type"))


@query(f"with {PAIRS} select dataset, context_id, run_id from better where (event_id % 7) <> 0 or true qualify row_number() over (partition by dataset, context_id order by overall_coverage - p_cov desc, event_id) = 1")
def w8_best_improvement(spark, sf):
    p = sft.valid_pairs(staging.pairs(spark, sf))
    better = p.where(sft.has_absolute_improvement(F.col("cov_result"), F.col("prev_cov_result")))
    return sft.best_improvement(better, "event_id").select(*KEY, "run_id")


@query(f"with {PAIRS} select dataset, context_id, run_id from valid where (dataset, context_id) not in (select distinct dataset, context_id from runs where user_id_of(context_id) % 5 = 0)".replace("user_id_of(context_id)", "right(context_id, 6)::int"))
def p4_drop_contaminated(spark, sf):
    ids = staging.runs(spark, sf).select(*KEY).distinct().where(F.substring("context_id", -6, 6).cast("int") % 5 == 0)
    return sft.drop_contaminated(sft.valid_pairs(staging.pairs(spark, sf)), ids).select(*KEY, "run_id")


@query(f"""with {PAIRS} select 'all' as stage, count(*) as n_rows, count(distinct context_id) as n_contexts, count(distinct dataset) as n_datasets from pairs union all select 'valid', count(*), count(distinct context_id), count(distinct dataset) from valid
union all select 'better', count(*), count(distinct context_id), count(distinct dataset) from better""")
def a14_stage_counts(spark, sf):
    p = staging.pairs(spark, sf)
    v = sft.valid_pairs(p)
    return sft.stage_counts({"all": p, "valid": v, "better": v.where(sft.has_absolute_improvement(F.col("cov_result"), F.col("prev_cov_result")))})


SPLIT = CHATS + """,
s1 as (select *, max(case when role in ('system', 'assistant') then pos end) over (partition by conv_id) as last_other,
  case when role = 'user' then null else pos end as npos from said),
sys as (select conv_id, max(case when pos = 1 and role = 'system' then text end) as system from said group by 1),
ins as (select conv_id, string_agg(text, chr(10) order by pos) as instruction from s1 where last_other is not null and pos > last_other group by 1),
allc as (select l.conv_id, o.output, s.system, i.instruction from last l join outp o using (conv_id) left join sys s using (conv_id) left join ins i using (conv_id))"""


@query(f"with {SPLIT} select conv_id::varchar as context_id, system, instruction, output from allc")
def f16_f18_f19_split_chats(spark, sf):
    c = staging.chats(spark, sf)
    return c.select("context_id", chat.system_of(F.col("input")).alias("system"), chat.instruction_of(F.col("input")).alias("instruction"), chat.output_of(F.col("output")).alias("output"))


@query(f"""with {CHATS}, b as (select *, sum((role = 'assistant')::int) over (partition by conv_id order by pos) - (role = 'assistant')::int as grp from said where pos > 1),
g as (select conv_id, grp, string_agg(case when role = 'user' then text end, chr(10) order by pos) as u, max(case when role = 'assistant' then text end) as a, bool_or(role = 'assistant') as closed, bool_or(role not in ('user', 'assistant')) as odd from b group by 1, 2),
h as (select conv_id, bool_or(odd) or bool_or(closed and u is null) as bad, coalesce(string_agg(u || '>' || a, '|' order by grp) filter (closed), '') as hist, count(*) filter (closed) as n from g group by 1)
select l.conv_id::varchar as context_id, case when coalesce(h.bad, false) then null else coalesce(h.hist, '') end as history from last l left join h using (conv_id)""")
def f17_history_of(spark, sf):
    c = staging.chats(spark, sf).withColumn("h", chat.history_of(F.col("input")))
    return c.select("context_id", F.when(F.col("h").isNotNull(), F.array_join(F.transform("h", lambda p: F.concat(p[0], F.lit(">"), p[1])), "|")).alias("history"))


@query(f"with {SPLIT} select 'n' as k, count(*) as n, count(*) filter (system is null) as no_system from allc")
def p8_chat_errors(spark, sf):
    c = sft.split_chats(staging.chats(spark, sf))
    return c.agg(F.lit("n").alias("k"), F.count("*").alias("n"), F.count_if(F.col("chat_error") == "system").alias("no_system"))


@query("""with c as (select doc_id, text, length(text) as chars, len(list_filter(string_split_regex(text, '[\\t-\\r ]+'), lambda x: x <> '')) as words from documents),
r as (select *, 20 + 33 + length(text) as x from c), q as (select quantile_cont(chars, 0.99) as qc, quantile_cont(words, 0.99) as qw from c)
select max(words) filter (chars >= qc) as max_by_chars, max(words) filter (words >= qw) as max_by_words from c, q""")
def a13_longest_tail_check(spark, sf):
    d = staging.load(spark, sf, "documents").select(F.lit("").alias("system"), F.array().cast("array<array<string>>").alias("history"), F.lit("").alias("instruction"), F.col("text").alias("output"))
    return _tail(d)


def _tail(d):
    # The template adds as many characters and words to every row; they are taken off again.
    out = sft.longest_tail_check(d)
    return out.select((F.col("max_by_chars") - 3).cast("bigint").alias("max_by_chars"), (F.col("max_by_words") - 3).cast("bigint").alias("max_by_words"))


@query("select lang, case lang when 'en' then 'eval' else 'train' end as split, count(*) as n from documents group by 1, 2")
def p14_split_name(spark, sf):
    return staging.load(spark, sf, "documents").select("lang", sft.split_name(F.col("lang"), "en").alias("split")).groupBy("lang", "split").agg(F.count("*").alias("n"))


SIM = """d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\t-\\r\\x1c-\\x20]+'), lambda x: x <> '') as t from documents),
b as (select item_id, list_filter(string_split_regex(coalesce(text, ''), '[\\t-\\r\\x1c-\\x20]+'), lambda x: x <> '') as t from benchmark),
p as (select doc_id, item_id, d.t as x, b.t as y, len(d.t) as m, len(b.t) as n from d, b where 2.0 * least(len(d.t), len(b.t)) >= 0.3 * (len(d.t) + len(b.t)) and len(list_intersect(d.t, b.t)) > 0),
q as (select *, list_transform(x, lambda c: list_sum(list_transform(range(n), lambda i: case when y[i + 1] = c then (1::hugeint << i::int) else 0::hugeint end))::hugeint) as masks from p where n <= 62),
s as (select *, list_reduce(masks, lambda v, mk: ((v + (v & mk)) | (v & ~mk)) & ((1::hugeint << n::int) - 1), (1::hugeint << n::int) - 1) as v from q),
l as (select doc_id, item_id, m, n, n - bit_count(v) as lcs from s)"""


def _texts(spark, sf):
    d = staging.load(spark, sf, "documents").select(F.col("doc_id").alias("context_id"), F.col("doc_id").alias("f"), text.whitespace_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    b = staging.load(spark, sf, "benchmark").select(F.col("item_id").alias("context_id"), F.col("item_id").alias("eval_ord"), F.col("item_id").alias("f"), text.whitespace_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    return d, b


@query(f"with {SIM} select doc_id, item_id, lcs::int as lcs, round(2.0 * lcs / (m + n), 6) as f1 from l where lcs > 0 and 2.0 * lcs / (m + n) >= 0.3")
def j4_similar_files(spark, sf):
    d, b = _texts(spark, sf)
    found = similarity.similar_files(d.select("f", "tokens"), b.select("f", "tokens"), 0.3)
    return found.select(F.col("f_left").alias("doc_id"), F.col("f_right").alias("item_id"), "lcs", F.round("f1", 6).alias("f1"))


@query(f"with {SIM} select doc_id as train_id, min(item_id) as eval_id from l where lcs > 0 and 2.0 * lcs / (m + n) >= 0.3 group by 1")
def e9_find_contamination(spark, sf):
    return similarity.find_contamination(*_texts(spark, sf), 0.3)


@query("""with s as (select dense_rank() over (order by lang) - 1 as source_ord, doc_id from documents), z as (select source_ord::int as source_ord, count(*) as size from s group by 1),
e as (select *, size * 777 / sum(size) over () as exact from z), f as (select *, floor(exact) as whole from e)
select source_ord, size, (whole + case when row_number() over (order by exact - whole desc, source_ord desc) <= 777 - sum(whole) over () then 1 else 0 end)::bigint as share from f""")
def u2_blend_shares(spark, sf):
    return blend.blend_shares(_sources(spark, sf), 777)


def _sources(spark, sf):
    d = staging.load(spark, sf, "documents").select("doc_id", "lang")
    # A row for each language; a null one comes last.
    ords = d.select(F.col("lang").alias("_l")).distinct().withColumn("source_ord", F.row_number().over(Window.orderBy(F.col("_l").asc_nulls_last())) - 1)
    return d.join(ords, d["lang"].eqNullSafe(ords["_l"])).drop("_l")


@query("""with s as (select (dense_rank() over (order by lang) - 1)::int as source_ord, doc_id from documents), z as (select source_ord, count(*) as size, (select count(*) from documents) as total from s group by 1),
e as (select *, size * (2 * total + 5) / total as exact from z), f as (select *, floor(exact) as whole from e),
h as (select source_ord, size, (whole + case when row_number() over (order by exact - whole desc, source_ord desc) <= (2 * total + 5) - sum(whole) over () then 1 else 0 end)::bigint as share from f),
r as (select s.*, row_number() over (partition by source_ord order by md5(concat_ws('|', 42, source_ord, doc_id)), doc_id) as rk from s)
select source_ord, doc_id, (share // size + case when rk <= share % size then 1 else 0 end)::bigint as copies from r join h using (source_ord)""")
def u2_blend(spark, sf):
    """Growing: how often every row is taken."""
    rows = _sources(spark, sf)
    out = blend.blend(rows, 2 * rows.count() + 5, 42, "doc_id")
    return out.groupBy("source_ord", "doc_id").agg(F.count("*").alias("copies"))


@query("select (case when lang is not distinct from 'en' then 0 else 1 end)::int as source_ord, count(*) as n from documents group by 1")
def u1_concat_sources(spark, sf):
    d = staging.load(spark, sf, "documents").select("doc_id", "lang")
    return blend.concat_sources(d.where(F.col("lang").eqNullSafe("en")), d.where(~F.col("lang").eqNullSafe("en"))).groupBy("source_ord").agg(F.count("*").alias("n"))


@query(f"with {DESIGNS} select d::varchar as context_id, array_to_string(tops, ',') as tops from tops")
def f2_j7_top_modules(spark, sf):
    return designs.with_tops(staging.designs(spark, sf)).select("context_id", F.array_join("potential_top", ",").alias("tops"))


@query(f"with {DESIGNS} select d::varchar as context_id, case when len(tops) = 0 then 'no top module' when len(tops) > 1 then 'several top modules: ' || array_to_string(tops, ', ') end as top_error from tops")
def j8_require_single_top(spark, sf):
    return designs.require_single_top(designs.with_tops(staging.designs(spark, sf))).select("context_id", "top_error")


@query(f"with {DESIGNS} select d::varchar as context_id from tops where len(tops) = 1")
def p1_filter_single_top(spark, sf):
    return designs.filter_single_top(designs.with_tops(staging.designs(spark, sf))).select("context_id")


@query(f"with {DESIGNS} select d::varchar as context_id, size > 100 as long from tops")
def p2_filter_by_length(spark, sf):
    d = staging.designs(spark, sf).withColumn("rtl_tokens", F.col("size"))
    return designs.filter_by_length(d, 100).select("context_id", F.lit(False).alias("long")).unionByName(designs.filter_by_length(d, 100, True).select("context_id", F.lit(True).alias("long")))


@query(f"""with {DESIGNS}, s as (select size, size % 3 = 0 as spec, unnest(['all', case when len(tops) = 1 then 'single_top' end, case when len(tops) = 1 and size <= 100 then 'short' end, case when len(tops) = 1 and size > 100 then 'long' end]) as stage from tops)
select stage, count(*) as n, count(*) filter (spec) as n_with_spec, min(size) as min, max(size) as max, round(avg(size), 6) as mean, quantile_cont(size, 0.25) as q1, quantile_cont(size, 0.5) as q2, quantile_cont(size, 0.75) as q3 from s where stage is not null group by 1""")
def a11_length_profile(spark, sf):
    d = designs.with_tops(staging.designs(spark, sf)).withColumn("rtl_tokens", F.col("size"))
    return _r6(designs.length_profile(d, 100))


@query(f"""with {DESIGNS}, s as (select size, unnest(['all', case when len(tops) = 1 then 'single_top' end, case when len(tops) = 1 and size <= 100 then 'short' end, case when len(tops) = 1 and size > 100 then 'long' end]) as stage from tops)
select stage, count(*) as n, quantile_cont(size, 0.25) as q1, quantile_cont(size, 0.5) as q2, quantile_cont(size, 0.75) as q3, 3 as n_within from s where stage is not null group by 1""")
def a11_sketched_profile(spark, sf):
    """Exact quartiles, and how many of the sketched ones have a rank within the stated error; sketches of parts are merged."""
    d = designs.with_tops(staging.designs(spark, sf)).withColumn("rtl_tokens", F.col("size"))
    exact = designs.length_profile(d, 100).select("stage", "n", "q1", "q2", "q3")
    single = F.size("potential_top") == 1
    stages = F.array_compact(F.array(F.lit("all"), F.when(single, "single_top"), F.when(single & (F.col("size") <= 100), "short"), F.when(single & (F.col("size") > 100), "long")))
    rows = d.select(F.explode(stages).alias("stage"), F.col("size").alias("v"), F.pmod(F.xxhash64("context_id"), F.lit(7)).alias("part"))
    whole = quantiles.merged(quantiles.sketches(rows, "v", "stage", "part"), "stage")
    shown = whole.select("stage", F.posexplode(F.array(*(quantiles.quantile("sketch", r) for r in (0.25, 0.5, 0.75)))).alias("i", "x"))
    ranks = rows.join(shown, "stage").groupBy("stage", "i").agg(F.avg((F.col("v") < F.col("x")).cast("int")).alias("below"), F.avg((F.col("v") <= F.col("x")).cast("int")).alias("upto"))
    at, e = (F.col("i") + 1) / 4.0, quantiles.rank_error()
    within = ranks.groupBy("stage").agg(F.count_if((F.col("below") <= at + e) & (F.col("upto") >= at - e)).cast("int").alias("n_within"))
    return exact.join(within, "stage")


@query("""select p_partkey, '`define SIZE ' || p_size || chr(10) || 'x' || chr(10) as raw, chr(10) || 'x  wire [:0] w;' || chr(10) as stripped from part""")
def f1_strip_verilog(spark, sf):
    p = staging.load(spark, sf, "part")
    t = F.concat(F.format_string("`define SIZE %d\n", "p_size"), F.lit("x /* a\nb */ wire [`SIZE(1, 2):0] w;// c\n"))
    return p.select("p_partkey", F.concat(F.lit("`define SIZE "), F.col("p_size"), F.lit("\nx\n")).alias("raw"), text.strip_verilog(t).alias("stripped"))


@query("select p_partkey, case p_size % 4 when 0 then 'a' when 1 then 'module m; endmodule' when 2 then null else '' end as code, case p_size % 4 when 0 then 'x.sv' when 1 then 'y.v' end as name from part")
def f3_f4_extract_code_and_name(spark, sf):
    p = staging.load(spark, sf, "part")
    k = F.col("p_size") % 4
    t = F.when(k == 0, "filename: dir/x.sv\n```verilog\n a \n```\n```\nb```").when(k == 1, "see y.v: module m; endmodule, so").when(k == 2, "nothing here").otherwise("```sv\n```")
    return p.select("p_partkey", text.extract_code(t).alias("code"), text.extract_filename(t).alias("name"))


@query("select p_partkey, case when p_size % 2 = 0 then p_name else '' end as reasoning from part")
def f5_extract_reasoning(spark, sf):
    p = staging.load(spark, sf, "part")
    t = F.concat(F.lit("a <think> "), F.col("p_name"), F.when(F.col("p_size") % 2 == 0, "</think> b").otherwise(" b"))
    return p.select("p_partkey", text.extract_reasoning(t).alias("reasoning"))


@query("select p_partkey, case when p_size % 2 = 0 then 't.sv' end as name, case when p_size % 2 = 0 then p_name end as content, case when p_size % 2 = 0 then 'ok' else 'no name' end as status from part")
def f6_parse_response(spark, sf):
    p = staging.load(spark, sf, "part")
    t = F.concat(F.when(F.col("p_size") % 2 == 0, "file name = t.sv\n").otherwise("\n"), F.lit("```systemverilog\n"), F.col("p_name"), F.lit("\n```"))
    return p.select("p_partkey", text.parse_response(t).alias("r")).select("p_partkey", "r.*")


@query("select p_partkey, 'a' || chr(10) || p_name || chr(10) || 'c' || chr(10) as patched, case when p_size % 2 = 0 then 0 else 1 end as n_failed from part where p_size % 3 <> 0 union all select p_partkey, 'a' || chr(10) || 'b' || chr(10) || 'c' || chr(10), 0 from part where p_size % 3 = 0")
def f7_f8_apply_patches(spark, sf):
    p = staging.load(spark, sf, "part")
    patch = F.concat(F.lit("@@\n a\n-b\n+"), F.col("p_name"), F.lit("\n c\n"), F.when(F.col("p_size") % 2 == 0, "").otherwise("@@\n-zz\n+y\n"))
    rows = p.select("p_partkey", F.lit("a\nb\nc\n").alias("content"), F.when(F.col("p_size") % 3 == 0, "NO_CHANGES").otherwise(patch).alias("patch"))
    return patches.apply_patches(rows).select("p_partkey", "patched", F.size("failed").alias("n_failed"))


@query("select p_partkey, '// File: m.sv' || chr(10) || p_name || case when p_size % 2 = 0 then '// File: s.md' || chr(10) || p_type else '(no spec)' end || chr(10) || 'do' as content, 'rules' as system from part")
def f10_render_initial_prompt(spark, sf):
    p = staging.load(spark, sf, "part")
    f = lambda n, c: F.array(F.struct(F.lit(n).alias("name"), F.col(c).alias("content")))
    spec = F.when(F.col("p_size") % 2 == 0, f("s.md", "p_type")).otherwise(F.array().cast("array<struct<name: string, content: string>>"))
    m = text.render_initial_prompt(f("m.sv", "p_name"), spec, F.lit("do"), "rules", "{context}\n{instructions}")
    return p.select("p_partkey", m.alias("m")).select("p_partkey", F.col("m")[1]["content"].alias("content"), F.col("m")[0]["content"].alias("system"))


@query("""select p_partkey, 'Parsed:' || chr(10) || '- type: ' || case when p_size % 2 = 0 then 'patch' else 'full' end || case when p_size % 2 = 0 then chr(10) || chr(10) || 'File now:' || chr(10) || p_name else '' end
 || chr(10) || chr(10) || 'Run:' || chr(10) || '- status: ' || p_type || chr(10) || chr(10) || 'Next:' || chr(10) || 'go on' as content from part""")
def f11_render_followup(spark, sf):
    p = staging.load(spark, sf, "part")
    kind = F.when(F.col("p_size") % 2 == 0, "patch").otherwise("full")
    m = text.render_followup(F.create_map(F.lit("type"), kind), F.lit(None).cast("map<string, string>"), F.concat("p_name", F.lit(" \n")), F.create_map(F.lit("status"), F.col("p_type")), F.lit(" go on\n"), single=True)
    return p.select("p_partkey", m[0]["content"].alias("content"))


@query("select p_partkey, p_name || chr(10) || 'rules' as injected, p_name || chr(10) as stripped, 'filename: t.sv' || chr(10) || '```systemverilog' || chr(10) || p_name || chr(10) || '```' as answer from part")
def f9_f12_f20_messages(spark, sf):
    p = staging.load(spark, sf, "part")
    i = text.inject_rules(F.col("p_name"), "rules")
    m = F.array(F.struct(F.lit("user").alias("role"), F.concat(i, F.lit("")).alias("content")))
    return p.select("p_partkey", i.alias("injected"), text.strip_injected(m, "rules")[0]["content"].alias("stripped"), text.format_answer(F.lit("t.sv"), F.col("p_name"))["content"].alias("answer"))


@query("select doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '[\\t-\\r\\x1c-\\x20]+'), lambda x: x <> ''))::int as n from documents")
def f13_whitespace_tokens(spark, sf):
    return staging.load(spark, sf, "documents").select("doc_id", F.size(text.whitespace_tokens(F.coalesce("text", F.lit("")))).alias("n"))


@query("select doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z_][A-Za-z_0-9]*|[0-9]+|[^\\sA-Za-z_0-9]'))::int as n from documents")
def f15_count_tokens(spark, sf):
    return staging.load(spark, sf, "documents").select("doc_id", tokens.count_tokens(F.col("text")).alias("n"))


def _words_of(texts: list[str]) -> list[int]:
    return [len(t.split()) for t in texts]


@query("select doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '[\\t-\\r\\x1c-\\x20]+'), lambda x: x <> ''))::int as n from documents")
def f15_encoder_tokens(spark, sf):
    """By an encoder, on texts that are dealt out by length."""
    d = staging.load(spark, sf, "documents").select("doc_id", "text")
    dealt = tokens.deal_by_length(d, F.coalesce(F.length("text"), F.lit(0)), "doc_id")
    return dealt.select("doc_id", tokens.count_tokens(F.col("text"), _words_of).alias("n"))


@query("select c_custkey::varchar as context_id, ('0x' || substr(md5(c_custkey::varchar), 1, 13))::bigint / 4503599627370496e0 as r from customer")
def p9_id_fraction(spark, sf):
    return staging.load(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("context_id")).select("context_id", tokens.md5_fraction(F.col("context_id")).alias("r"))


@query()
def p9_to_generation_context(spark, sf):
    d = designs.filter_single_top(designs.with_tops(staging.designs(spark, sf)))
    blank = d.withColumns({c: F.lit(None).cast("string") for c in ("dut_top_module_name", "dut_top_instance_name", "instructions")})
    return designs.to_generation_context(blank, "Test {top} as {instance}.", exact_hash=True).select("context_id", "dut_top_module_name", "dut_top_instance_name", "instructions")


GENERATION = DESIGNS + """, txt as (select p_partkey // 4 as d, string_agg('// File: m' || p_partkey || '.sv' || chr(10) || '`define SIZE ' || p_size || chr(10) || '// part ' || p_name || chr(10) || 'module m' || p_partkey || ' (input clk);' || chr(10)
 || case when p_size % 2 = 1 then '  m' || (p_partkey + 1) || ' #(.W(8)) u' || p_partkey || ' (.clk(clk));' || chr(10) else '' end || '  /* m1 x (y); */ wire [`SIZE:0] w;' || chr(10) || 'endmodule' || chr(10), chr(10) || chr(10) order by p_partkey) as rtl from part group by 1),
one as (select d, size, tops[1] as top, ('0x' || substr(md5(d::varchar), 1, 13))::bigint / 4503599627370496e0 as r from tops where len(tops) = 1),
gen as (select d, top, case when r < 0.33 then 'dut' when r < 0.66 then 'uut' else 'inst_' || top end as inst, rtl, case when size % 3 = 0 then '// File: spec.md' || chr(10) || size else '(no spec)' end as spec from one join txt using (d))"""


@query(f"with {GENERATION} select d::varchar as context_id, unnest(range(2))::int as repeat_index, 'You write tests.' as system, rtl || spec || chr(10) || 'Test ' || top || ' as ' || inst || '.' as content from gen")
def e1_build_generation_requests(spark, sf):
    d = designs.count_rtl_tokens(designs.with_tops(staging.designs(spark, sf)))
    blank = d.withColumns({c: F.lit(None).cast("string") for c in ("dut_top_module_name", "dut_top_instance_name", "instructions")})
    r = jobs.build_generation_requests(blank, "Test {top} as {instance}.", "You write tests.", "{context}\n{instructions}", 100_000, 2)
    return r.select("context_id", "repeat_index", F.col("messages")[0]["content"].alias("system"), F.col("messages")[1]["content"].alias("content"))


@query("select p_partkey::varchar as context_id, p_name as rtl, p_type as spec from part")
def s1_normalize_qa(spark, sf):
    p = staging.load(spark, sf, "part")
    c = lambda x: F.struct(F.col(x).alias("content"))
    raw = p.select(F.array(c("p_brand"), c("p_type")).alias("question"), F.array(c("p_name")).alias("ground_truth"), F.col("p_partkey").alias("problem_id"))
    return designs.normalize_qa(raw, "qa").select("context_id", F.col("rtl_files")[0]["content"].alias("rtl"), F.col("spec_files")[0]["content"].alias("spec"))


@query("select (row_number() over (order by p_partkey) - 1)::varchar as context_id, p_name as rtl, case when p_size % 2 = 0 then p_type end as spec from part")
def s2_normalize_verified(spark, sf):
    p = staging.load(spark, sf, "part").select(F.col("p_type").alias("question"), F.col("p_name").alias("ground_truth"), (F.col("p_size") % 2 == 0).alias("verified"), "p_partkey")
    return designs.normalize_verified(p, "v", "p_partkey").select("context_id", F.col("rtl_files")[0]["content"].alias("rtl"), F.get("spec_files", F.lit(0))["content"].alias("spec"))


@query("select p_partkey::varchar as context_id, p_brand as top, p_brand as tops from part")
def s3_normalize_nested(spark, sf):
    p = staging.load(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("context_id"), F.col("p_brand").alias("dut_top_module_name"))
    return designs.normalize_nested(p, "n").select("context_id", F.col("dut_top_module_name").alias("top"), F.array_join("potential_top", ",").alias("tops"))


@query(f"""with {PAIRS}, best as (select * from better qualify row_number() over (partition by dataset, context_id order by overall_coverage - p_cov desc, event_id) = 1),
one as (select dataset, context_id, case when p_h then 'agentic_coverage' else 'agentic_xrun' end as run_type, 'rules' as system, case when k % 6 <> 5 then 'task ' || run_id end as instruction, 'answer ' || run_id || repeat(' word', k::int % 23) as output,
  case when k % 6 = 5 then 'system' end as chat_error, 5 + k::int % 23 as said from best),
good as (select dataset, length(instruction) + length(output) as chars, said + 3 as tokens from one where chat_error is null), edge as (select dataset, quantile_cont(chars, 0.99) as c from good group by 1),
tail as (select dataset, max(tokens)::int as longest from good join edge using (dataset) where chars >= c group by 1)
select dataset, context_id, run_type, case when chat_error is null then system end as system, instruction, output, chat_error, null::int as longest from one
union all select dataset, null, null, null, null, null, null, longest from tail""")
def e5_refine_sft(spark, sf):
    say = lambda role, t: F.struct(F.lit(role).alias("role"), t.alias("content"))
    task = say("user", F.concat(F.lit("task "), "run_id"))
    k = staging.rounds(spark, sf).select(*KEY, "run_id", "k")
    rows = staging.pairs(spark, sf).join(k, [*KEY, "run_id"]).withColumns({
        "input": F.when(F.col("k") % 6 == 5, F.array(task)).otherwise(F.array(say("system", F.lit("rules")), task)), "output": say("assistant", F.concat(F.lit("answer "), "run_id", F.repeat(F.lit(" word"), F.col("k") % 23))), "run_type": F.lit("agentic"),
    })
    every = None
    for name in sorted(r["dataset"] for r in rows.select("dataset").distinct().collect()):
        out = jobs.refine_training_rows(rows.where(F.col("dataset") == name), None, "event_id")
        cols = [*KEY, "run_type", "system", "instruction", "output"]
        longest = out["longest"].select(F.lit(name).alias("dataset"), *(F.lit(None).cast("string").alias(c) for c in (*cols[1:], "chat_error")), F.col("max_by_chars").alias("longest"))
        one = out["rows"].withColumn("chat_error", F.lit(None).cast("string")).unionByName(out["rejected"]).select(*cols, "chat_error", F.lit(None).cast("int").alias("longest")).unionByName(longest)
        every = one if every is None else every.unionByName(one)
    return every


BLENDED = """s as (select (dense_rank() over (order by lang) - 1)::int as source_ord, doc_id, lang from documents), total as (select count(*) * 2 // 3 as n from documents),
z as (select source_ord, count(*) as size from s group by 1), e as (select *, size * (select n from total) / sum(size) over () as exact from z), f as (select *, floor(exact) as whole from e),
h as (select source_ord, size, whole + case when row_number() over (order by exact - whole desc, source_ord desc) <= (select n from total) - sum(whole) over () then 1 else 0 end as share from f),
r as (select s.*, row_number() over (partition by source_ord order by md5(concat_ws('|', 42, source_ord, doc_id)), doc_id) as rk from s)"""


@query(f"with {BLENDED} select r.doc_id, r.lang, r.source_ord, 0 as copy, row_number() over (order by md5(concat_ws('|', 42, r.source_ord, r.doc_id, 0)), r.source_ord, r.doc_id) - 1 as position from r join h using (source_ord) where rk <= share")
def e10_blend_sources(spark, sf):
    d = staging.load(spark, sf, "documents").select("doc_id", "lang")
    langs = sorted((r["lang"] for r in d.select("lang").distinct().collect()), key=lambda x: (x is None, x))  # a handful
    mixed = jobs.blend_sources([d.where(F.col("lang").eqNullSafe(x)) for x in langs], d.count() * 2 // 3, 42, "doc_id")
    order = ("source_ord", "doc_id", "copy")
    return blend.positions(mixed, blend.seeded(42, *order), *order)


TOKENS = f"""with {DESIGNS}, t as (select p_partkey // 4 as d, len(regexp_extract_all('`define SIZE ' || p_size || chr(10) || '// part ' || p_name || chr(10) || 'module m' || p_partkey || ' (input clk);' || chr(10)
 || case when p_size % 2 = 1 then '  m' || (p_partkey + 1) || ' #(.W(8)) u' || p_partkey || ' (.clk(clk));' || chr(10) else '' end || '  /* m1 x (y); */ wire [`SIZE:0] w;' || chr(10) || 'endmodule' || chr(10), '[A-Za-z_][A-Za-z_0-9]*|[0-9]+|[^\\sA-Za-z_0-9]')) as n from part),
s as (select d, sum(n)::int as n from t group by 1)"""


@query(TOKENS + " select d::varchar as context_id, case when size % 2 = 0 then size else n end as rtl_tokens from tops join s using (d)")
def j10_cached_token_counts(spark, sf):
    d = staging.designs(spark, sf)
    cache = d.where("size % 2 = 0").select(*KEY, F.col("size").alias("rtl_tokens"))
    return designs.count_rtl_tokens(d, cache).select("context_id", "rtl_tokens")


@query(TOKENS + " select d::varchar as context_id, n as rtl_tokens from tops join s using (d)")
def j10_written_cache(spark, sf):
    """Half of the designs write the cache, then all are read through it."""
    path, d = lineage.shared_path(spark), staging.designs(spark, sf)
    token_cache.count_with_cache(d.where("size % 2 = 0"), path)
    return token_cache.count_with_cache(d, path).select("context_id", "rtl_tokens")
