"""Contamination by ROUGE-L: an exact similarity join of files.

A pair of token lists of sizes a and b with F1 >= t has 2 min(a, b) / (a + b) >= t, shares a
multiset of at least t (a + b) / 2 tokens, and one of the rarest |x| - ceil(|x| t / (2 - t)) + 1
(token, occurrence) elements of each, their prefixes. Files whose size no file of the other
side can match are left out before their tokens are looked at. Candidates meet in their
prefixes, so that frequent tokens join nothing. Where they meet bounds what they can share: the
elements met so far and no more than either has after the last of them. Bags and tokens are
taken of what passes, and the longest common subsequence is computed on what is left.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runforge.functions.text import whitespace_tokens
from runforge.functions.tokens import lcs_length, rouge_l_f1
from runforge.lineage import cut, discard

#: An element that more right files have is joined in blocks of about so many.
LIST_FILES = 256


def _elements(files: DataFrame) -> DataFrame:
    """(f, n, token, occ): the elements of each file."""
    each = files.select("f", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).groupBy("f", "n", "token").agg(F.count("*").cast("int").alias("c"))
    return each.select("f", "n", "token", F.explode(F.sequence(F.lit(1), F.col("c"))).alias("occ"))


def _of_size(files: DataFrame, others: DataFrame, t: float) -> DataFrame:
    """The files (f, tokens) whose size some size between the smallest and the largest of others can match; tokens are taken apart once."""
    lo, hi = others.agg(F.min(F.size("tokens")), F.max(F.size("tokens"))).first()
    if not lo:
        return files.select("f", "tokens").where("false")
    least, most = math.ceil(lo * t / (2 - t) - 1e-9), math.floor(hi * (2 - t) / t + 1e-9)
    return files.select("f", F.explode(F.filter(F.array("tokens"), lambda x: F.size(x).between(least, most))).alias("tokens"))


def _bags(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(f, tokens, bag): the wanted files with their elements as strings."""
    files = files.join(wanted, "f", "left_semi")
    bag = _elements(files).groupBy("f").agg(F.collect_list(F.concat_ws("\x00", "token", F.col("occ").cast("string"))).alias("bag"))
    return files.select("f", "tokens").join(bag, "f")


def _rare(files: DataFrame, known: DataFrame, t: float) -> DataFrame:
    """(f, n, token, occ, freq, pos): the prefix of each file by rising frequency, as far as known has its elements, and where they stand.

    known is (token, freqs): how many files have the first, second, ... occurrence. Elements
    that it lacks are rarest; they take places and join nothing, so they aren't listed.
    """
    each = files.select("f", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).join(known, "token")
    shared = each.groupBy("f", "n", "token").agg(F.count("*").cast("int").alias("c"), F.first("freqs").alias("freqs"))
    elements = shared.select("f", "n", "token", F.posexplode(F.slice("freqs", F.lit(1), F.col("c"))).alias("occ", "freq"))
    mine = Window.partitionBy("f")
    pos = F.col("n") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("freq", "token", "occ"))
    return elements.withColumn("pos", pos).where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * F.lit(t / (2 - t)) - 1e-9) + 1)


def candidate_files(left: DataFrame, right: DataFrame, t: float) -> DataFrame:
    """(f_left, a, f_right, b, met, bound): files (f, tokens) that meet in their prefixes, in how many elements, and how many they can share at most."""
    counts = _elements(right).groupBy("token", "occ").agg(F.count("*").alias("freq"))
    known = cut(counts.groupBy("token").agg(F.transform(F.array_sort(F.collect_list(F.struct("occ", "freq"))), lambda x: x["freq"]).alias("freqs")))
    blocks = F.ceil(F.col("freq") / LIST_FILES).cast("int")
    pa = _rare(left, known, t).select(F.col("f").alias("f_left"), F.col("n").alias("a"), "token", "occ", F.col("pos").alias("i"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    pb = _rare(right, known, t).select(F.col("f").alias("f_right"), F.col("n").alias("b"), "token", "occ", F.col("pos").alias("j"), F.pmod(F.xxhash64("f"), blocks).cast("int").alias("block"))
    near = F.lit(2.0) * F.least("a", "b") >= F.lit(t) * (F.col("a") + F.col("b")) - 1e-9
    met = pa.join(pb, ["token", "occ", "block"]).where(near).groupBy("f_left", "a", "f_right", "b").agg(F.count("*").alias("met"), F.max("i").alias("i"), F.max("j").alias("j"))
    return met.select("f_left", "a", "f_right", "b", "met", (F.col("met") + F.least(F.col("a") - F.col("i"), F.col("b") - F.col("j"))).alias("bound"))


def similar_files(left: DataFrame, right: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(f_left, f_right, lcs, f1) for all pairs of files (f bigint, tokens array<string>) with F1 of threshold or more.

    Token frequencies of right rank the elements, whichever side is larger. Files without
    tokens match nothing and are left out, as are null token lists; rows of one f are one file.
    """
    if not 0 < threshold <= 1:
        raise ValueError(f"threshold must be in (0, 1]: {threshold}")
    t = threshold
    right = cut(right.where(F.size("tokens") > 0).select("f", "tokens").dropDuplicates(["f"]))
    left = cut(_of_size(left, right, t).dropDuplicates(["f"]))
    least = F.lit(t) * (F.col("a") + F.col("b")) - 1e-9
    pairs = cut(candidate_files(left, right, t).where(F.lit(2.0) * F.col("bound") >= least).select("f_left", "a", "f_right", "b"))
    lt, rt = (_bags(x, pairs.select(F.col(f"f_{side}").alias("f")).distinct()).toDF(f"f_{side}", f"{side}_tokens", f"{side}_bag") for x, side in ((left, "left"), (right, "right")))
    texts = pairs.join(lt, "f_left").join(rt, "f_right")
    overlap = F.size(F.array_intersect("left_bag", "right_bag"))
    # Cut, or the optimizer would have the subsequences of all candidates computed.
    left_over = cut(texts.where(F.lit(2.0) * overlap >= least).drop("left_bag", "right_bag"))
    discard(left, right, pairs)
    shorter, longer = (F.when((F.col("a") <= F.col("b")) == first, F.col("left_tokens")).otherwise(F.col("right_tokens")) for first in (True, False))
    return left_over.withColumn("lcs", lcs_length(shorter, longer)).withColumn("f1", rouge_l_f1(F.col("lcs"), F.col("a"), F.col("b"))).where(F.col("f1") >= t).select("f_left", "f_right", "lcs", "f1")


def files_of(contexts: DataFrame, *extra: str) -> DataFrame:
    """A row (context_id, extra, f, tokens) for each spec and rtl file."""
    none = F.array().cast("array<struct<name: string, content: string>>")
    files = contexts.select("context_id", *extra, F.explode(F.concat(F.coalesce("spec_files", none), F.coalesce("rtl_files", none))).alias("file"))
    return files.select("context_id", *extra, F.xxhash64("context_id", "file.name", "file.content").alias("f"), whitespace_tokens(F.col("file.content")).alias("tokens"))


def find_contamination(train: DataFrame, evals: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(train_id, eval_id): each contaminated training id with the first evaluation id, by eval_ord, that it matches.

    train has context_id, f, tokens; evals also eval_ord. A context matches if any pair of
    files does; files are compared once, however many contexts share them.
    """
    pairs = similar_files(train, evals, threshold)
    t = train.select(F.col("context_id").alias("train_id"), F.col("f").alias("f_left")).distinct()
    e = evals.select(F.col("context_id").alias("eval_id"), "eval_ord", F.col("f").alias("f_right")).distinct()
    return pairs.join(t, "f_left").join(e, "f_right").groupBy("train_id").agg(F.min_by("eval_id", "eval_ord").alias("eval_id"))

