"""Line dedup: range-partitioned line hashes, secondary sort by document and position.

Lines become (hash, document, position); these are range-partitioned by hash and document,
so that the occurrences of a frequent line spread over as many ranges as they need, and
sorted by position within. The first occurrence in each document is streamed off and
counted; texts never leave their rows. Occurrences of hot lines are found by broadcasting
those lines, of which there can only be so many, all others by a join. The result is a compressed keep bitmap for each
document: the runs of lines that stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runforge.llm.common import ascii_lower, cut, load, row_key, shuffle_partitions

MIN_CODE_POINTS = 1
MIN_DOCS = 10
#: Lines with at least this share of all occurrences count as hot; there are at most HOT_KEYS of them.
HOT_KEYS = 10_000


def text_lines(text: str = "text") -> Column:
    """The lines of a text, split at \\n; null or empty: one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(" \t\n\x0b\x0c\r")))


def line_keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_code_points: int = MIN_CODE_POINTS, keep_first: bool = False) -> DataFrame:
    """(doc_id, row_key, keep_runs) for each document that loses lines.

    A line's key is line_key(); keys of at least min_code_points code points found in at
    least min_docs documents lose all their lines, or all but the very first occurrence (by
    doc_id and position) with keep_first. keep_runs is array<struct<first, n>>: the runs of
    lines that stay, counted from 0; null runs never occur, all lines gone is an empty array.
    row_key is row_key("doc_id", "text"): rows of one doc_id with different texts get bitmaps
    of their own but count as one document, as do rows alike in both; texts without an id
    count each. Empty lines have no key if min_code_points >= 1. Other columns of docs are
    ignored, an empty table gives no rows. Keys are compared by two 64-bit hashes.
    """
    spark = docs.sparkSession
    src = docs.select("doc_id", row_key("doc_id", "text").alias("row_key"), text_lines().alias("lines"))
    marks = F.transform("lines", lambda x, i: F.struct(i.alias("pos"), line_key(x).alias("k")))
    occ = (
        src.select("doc_id", "row_key", F.size("lines").alias("n_lines"), F.explode(marks).alias("m"))
        .where(F.length("m.k") >= min_code_points)
        .select("doc_id", "row_key", F.when(F.col("doc_id").isNull(), F.col("row_key")).alias("no_id"), "n_lines", "m.pos", F.xxhash64("m.k").alias("h1"), F.xxhash64(F.lit(1), "m.k").alias("h2"))
    )
    # Cut, as range bounds are found by a pass of their own.
    occ = cut(occ)
    frequent = cut(
        first_occurrences(occ, shuffle_partitions(spark)).groupBy("h1", "h2")
        .agg(F.count("*").alias("n_docs"), F.min(F.struct("doc_id", "row_key", "pos")).alias("first"))
        .where(F.col("n_docs") >= min_docs)
    )
    hot = F.col("n_docs") * HOT_KEYS >= occ.count()
    keys = ["h1", "h2"]
    gone = occ.join(F.broadcast(frequent.where(hot).drop("n_docs")), keys).unionByName(occ.join(frequent.where(~hot).drop("n_docs"), keys))
    if keep_first:
        gone = gone.where(~F.struct("doc_id", "row_key", "pos").eqNullSafe(F.col("first")))
    dropped = gone.groupBy("doc_id", "row_key").agg(F.any_value("n_lines").alias("n_lines"), F.sort_array(F.collect_set("pos")).alias("dropped"))
    return dropped.select("doc_id", "row_key", keep_runs(F.col("dropped"), F.col("n_lines")).alias("keep_runs"))


def first_occurrences(occ: DataFrame, parts: int) -> DataFrame:
    """The first of each line's occurrences in each document.

    Ranges are cut by what the window groups by, so that rows are shuffled once, lie sorted
    within their range, and a line of many documents spreads over ranges.
    """
    ranged = occ.repartitionByRange(parts, "h1", "h2", "doc_id", "no_id")
    in_doc = Window.partitionBy("h1", "h2", "doc_id", "no_id").orderBy("row_key", "pos")
    return ranged.withColumn("k", F.row_number().over(in_doc)).where("k = 1").drop("k")


def keep_runs(dropped: Column, n_lines: Column) -> Column:
    """The runs that stay, from the sorted positions that go."""
    def run(j: Column) -> Column:
        first = F.when(j == 0, F.lit(0)).otherwise(F.get(dropped, j - 1) + 1)
        return F.struct(first.alias("first"), (F.when(j == F.size(dropped), n_lines).otherwise(F.get(dropped, j)) - first).alias("n"))

    return F.filter(F.transform(F.sequence(F.lit(0), F.size(dropped)), run), lambda r: r["n"] > 0)


def apply_keep_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Adds n_lines, n_dropped and kept_text to every row of docs, from line_keep_bitmaps().

    Documents without a bitmap keep their text as it is (null: empty). Columns of docs with
    these names are replaced.
    """
    b = bitmaps.select(F.col("doc_id").alias("b_id"), F.col("row_key").alias("b_key"), "keep_runs")
    left = docs.drop("n_lines", "n_dropped", "kept_text", "keep_runs").withColumn("b_row", row_key("doc_id", "text"))
    joined = left.join(b, left["doc_id"].eqNullSafe(b["b_id"]) & (left["b_row"] == b["b_key"]), "left")
    lines = text_lines()
    kept = F.array_join(F.flatten(F.transform("keep_runs", lambda r: F.slice(F.col("lines"), r["first"] + 1, r["n"]))), "\n")
    n_kept = F.aggregate("keep_runs", F.lit(0), lambda a, r: a + r["n"])
    whole = F.col("keep_runs").isNull()
    return (
        joined.withColumn("lines", lines)
        .withColumns({
            "n_lines": F.size("lines").cast("long"),
            "n_dropped": F.when(whole, F.lit(0)).otherwise(F.size("lines") - n_kept).cast("long"),
            "kept_text": F.when(whole, F.coalesce("text", F.lit(""))).otherwise(kept),
        })
        .drop("b_id", "b_key", "b_row", "keep_runs", "lines")
    )


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    done = apply_keep_bitmaps(docs, line_keep_bitmaps(docs))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = """
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
k as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10)
select k.doc_id, count(*)::bigint as n_lines, count(f.key)::bigint as n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) order by k.pos) filter (f.key is null), '')) as kept_sha256
from k left join f on k.key = f.key group by k.doc_id
"""
