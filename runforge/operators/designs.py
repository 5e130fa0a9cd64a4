"""Designs: normalizing layouts, finding top modules, filters and profiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runforge.functions.text import strip_verilog
from runforge.functions.tokens import count_tokens, hash_fraction, md5_fraction, sum_tokens
from runforge.lineage import cut
from runforge.operators import quantiles
from runforge.schemas import FILE

#: Words that may stand where a module's name stands in an instance (fixed values).
KEYWORDS = frozenset(
    "always always_comb always_ff always_latch and assert assign assume automatic begin bit buf byte case casex casez cover default defparam disable "
    "else end endcase endfunction endgenerate endmodule endtask enum for force forever fork function generate genvar if initial inout input int "
    "integer join localparam logic longint macromodule module nand negedge nor not or output parameter posedge real reg repeat return shortint "
    "signed static string struct task time tri typedef union unsigned var void wait wand while wire wor xnor xor".split()
)
_BLOCK = r"(?s)\b(?:macro)?module\s+\w+.*?\bendmodule\b"
_INSTANCE = r"(?s)\b([A-Za-z_]\w*)\s*(?:#\s*\((?:[^()]|\([^()]*\))*\)\s*)?\s+[A-Za-z_]\w*\s*(?:\[[^\]]*\]\s*)?\((?=[^;]*;)"


def module_defs(text: Column) -> Column:
    """Names of the modules that a text defines, comments and macros stripped; found by regular expressions."""
    return F.array_distinct(F.regexp_extract_all(strip_verilog(text), F.lit(r"\b(?:macro)?module\s+(?:automatic\s+|static\s+)?(\w+)"), 1))


def module_insts(text: Column) -> Column:
    """Names of the modules of which a text has instances inside of some module."""
    blocks = F.regexp_extract_all(strip_verilog(text), F.lit(_BLOCK), 0)
    bodies = F.transform(blocks, lambda b: F.regexp_replace(b, r"(?s)^\s*(?:macro)?module\s+\w+\s*(?:#\s*\((?:[^()]|\([^()]*\))*\)\s*)?(?:\((?:[^()]|\([^()]*\))*\))?\s*;", " ; "))
    names = F.flatten(F.transform(bodies, lambda b: F.regexp_extract_all(b, F.lit(_INSTANCE), 1)))
    return F.array_distinct(F.filter(names, lambda n: ~n.isin(*KEYWORDS)))


def top_modules(defs: Column, insts: Column) -> Column:
    """Defined and never instantiated; a sole definition is always the top. Sorted."""
    return F.sort_array(F.when(F.size(defs) == 1, defs).otherwise(F.array_except(defs, insts)))


def with_tops(contexts: DataFrame) -> DataFrame:
    """Fills potential_top from the rtl files where it is null."""
    text = F.array_join(F.transform("rtl_files", lambda f: f["content"]), "\n")
    found = top_modules(F.col("_d"), F.col("_i"))
    return contexts.withColumns({"_d": module_defs(text), "_i": module_insts(text)}).withColumn("potential_top", F.coalesce("potential_top", found)).drop("_d", "_i")


def require_single_top(contexts: DataFrame) -> DataFrame:
    """Adds top_error: null for exactly one top."""
    n = F.size(F.coalesce("potential_top", F.array().cast("array<string>")))
    return contexts.withColumn("top_error", F.when(n == 0, "no top module").when(n > 1, F.concat(F.lit("several top modules: "), F.array_join("potential_top", ", "))))


def filter_single_top(contexts: DataFrame) -> DataFrame:
    return contexts.where(F.size("potential_top") == 1)


def filter_by_length(contexts: DataFrame, max_tokens: int, keep_long: bool = False) -> DataFrame:
    """Designs above max_tokens, or up to it."""
    return contexts.where(F.col("rtl_tokens") > max_tokens if keep_long else F.col("rtl_tokens") <= max_tokens)


def count_rtl_tokens(contexts: DataFrame, cache: DataFrame | None = None, encoder: Callable | None = None) -> DataFrame:
    """Fills rtl_tokens, the tokens of all rtl files; a cache (dataset, context_id, rtl_tokens) spares what it has.

    Tokens are added up within the row: repeated ids are counted each, rows with null ids or files stay.
    """
    texts = F.transform(F.coalesce("rtl_files", F.array().cast(f"array<{FILE}>")), lambda f: f["content"])

    def fill(rows: DataFrame) -> DataFrame:
        n = F.aggregate(F.transform(texts, lambda t: count_tokens(t)), F.lit(0), lambda a, x: a + x) if encoder is None else sum_tokens(texts, encoder)
        return rows.withColumn("rtl_tokens", n)

    if cache is None:
        return fill(contexts)
    known = cache.groupBy("dataset", "context_id").agg(F.max("rtl_tokens").alias("rtl_tokens"))
    both = contexts.drop("rtl_tokens").join(known, ["dataset", "context_id"], "left")
    return both.where("rtl_tokens is not null").unionByName(fill(both.where("rtl_tokens is null")))


def to_generation_context(contexts: DataFrame, instructions: str, exact_hash: bool = False) -> DataFrame:
    """Fills top module, instance name and instructions where they are null.

    The top is the first candidate; a hash of the id deals out instance names: dut below
    .33, uut below .66, else inst_ and the top. instructions has {top} and {instance}.
    exact_hash takes blake2b, a vectorized helper, instead of the native hash.
    """
    top = F.coalesce("dut_top_module_name", F.get("potential_top", F.lit(0)))
    r = hash_fraction(F.col("context_id")) if exact_hash else md5_fraction(F.col("context_id"))
    named = contexts.withColumns({"_r": r, "_top": top})
    inst = F.coalesce("dut_top_instance_name", F.when(F.col("_r") < 0.33, "dut").when(F.col("_r") < 0.66, "uut").otherwise(F.concat(F.lit("inst_"), "_top")))
    text = F.replace(F.replace(F.lit(instructions), F.lit("{top}"), F.col("_top")), F.lit("{instance}"), F.col("_inst"))
    return named.withColumn("_inst", inst).withColumns({"dut_top_module_name": F.col("_top"), "dut_top_instance_name": F.col("_inst"), "instructions": F.coalesce("instructions", text)}).drop("_r", "_top", "_inst")


def length_profile(contexts: DataFrame, max_tokens: int, sketch: int | None = None) -> DataFrame:
    """(stage, n, n_with_spec, min, max, mean, q1, q2, q3) of rtl_tokens over all designs, those with one top, and the short and long of these. One pass.

    Quartiles are exact and interpolated. With sketch they are values of rtl_tokens by a
    sketch of this size, whose ranks are off by quantiles.rank_error(sketch) of the rows.
    """
    single = F.size("potential_top") == 1
    stages = F.filter(F.array(F.lit("all"), F.when(single, "single_top"), F.when(single & (F.col("rtl_tokens") <= max_tokens), "short"), F.when(single & (F.col("rtl_tokens") > max_tokens), "long")), lambda s: s.isNotNull())
    ranks = (0.25, 0.5, 0.75)
    q = F.percentile("rtl_tokens", F.array(*map(F.lit, ranks))) if sketch is None else F.kll_sketch_agg_bigint(F.col("rtl_tokens").cast("bigint"), sketch)
    out = contexts.select("rtl_tokens", (F.size("spec_files") > 0).alias("spec"), F.explode(stages).alias("stage")).groupBy("stage").agg(
        F.count("*").alias("n"), F.count_if("spec").alias("n_with_spec"), F.min("rtl_tokens").alias("min"), F.max("rtl_tokens").alias("max"), F.avg("rtl_tokens").alias("mean"), q.alias("q")
    )
    return out.select("stage", "n", "n_with_spec", "min", "max", "mean", *((F.col("q")[i] if sketch is None else quantiles.quantile("q", r).cast("double")).alias(f"q{i + 1}") for i, r in enumerate(ranks)))


def _file(name: Column | str, content: Column) -> Column:
    return F.struct((F.lit(name) if isinstance(name, str) else name).alias("name"), content.alias("content"))


def normalize_qa(raw: DataFrame, dataset: str) -> DataFrame:
    """Layout qa: question array<struct<content>>, ground_truth array<struct<content>>, problem_id."""
    return _complete(raw.select(
        F.col("problem_id").cast("string").alias("context_id"),
        F.array(_file("rtl.sv", F.get("ground_truth", F.lit(0))["content"])).alias("rtl_files"),
        F.array(_file("spec.md", F.get("question", F.lit(1))["content"])).alias("spec_files"),
    ), dataset)


def normalize_verified(raw: DataFrame, dataset: str, *order: str) -> DataFrame:
    """Layout verified: question, ground_truth, verified; the id is the row's place in the order, from 0.

    Rows are numbered within ranges of the order, to which the counts of earlier ranges are
    added, so that no task numbers all rows.
    """
    if not order:
        raise ValueError("an order is needed: ids are row positions")
    ranged = raw.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = cut(ranged.withColumn("_id", F.monotonically_increasing_id()).withColumns({"_range": F.shiftright("_id", 33), "_in": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = numbered.groupBy("_range").agg(F.count("*").alias("_c")).withColumn("_before", F.sum("_c").over(Window.orderBy("_range")) - F.col("_c"))
    placed = numbered.join(F.broadcast(counts.drop("_c")), "_range")
    spec = F.when(F.col("verified"), F.array(_file("spec.md", F.col("question")))).otherwise(F.array().cast(f"array<{FILE}>"))
    return _complete(placed.select((F.col("_before") + F.col("_in")).cast("string").alias("context_id"), F.array(_file("rtl.sv", F.col("ground_truth"))).alias("rtl_files"), spec.alias("spec_files")), dataset)


def normalize_nested(raw: DataFrame, dataset: str) -> DataFrame:
    """Layout nested: files, targets, names and instructions as they are; the top is the named module."""
    return _complete(raw.withColumn("potential_top", F.array("dut_top_module_name")), dataset)


def _complete(rows: DataFrame, dataset: str) -> DataFrame:
    from pyspark.sql.types import _parse_datatype_string

    from runforge.schemas import CONTEXT

    rows = rows.withColumn("dataset", F.lit(dataset))
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in _parse_datatype_string(CONTEXT).fields))
