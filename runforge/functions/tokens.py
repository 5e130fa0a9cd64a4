"""Longest common subsequences, token counts and id hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, IntegerType

#: Bits of a word of a row; the sum of two words and a carry still fits a bigint.
MAX_BITS = 62
_FULL = (1 << MAX_BITS) - 1


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), i)


def _mask(items: Column, y: Column) -> Column:
    """A bit for each of at most MAX_BITS items that equals y."""
    return F.aggregate(F.transform(items, lambda x, i: F.when(x == y, _bit(i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda s, x: s + x)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _advanced(v: Column, m: Column, carry: Column | None = None) -> Column:
    """(V + (V & M) + carry) | (V & ~M): a word of the row after one more item, with what it carries in its highest bit."""
    total = v + v.bitwiseAND(m)
    return (total if carry is None else total + carry).bitwiseOR(v.bitwiseAND(F.bitwise_not(m)))


def _lcs_short(a: Column, b: Column) -> Column:
    full = _bit(F.size(a)) - 1
    step = lambda v, y: F.aggregate(F.array(_mask(a, y)), v, lambda v, m: _advanced(v, m).bitwiseAND(full))
    return F.size(a) - F.bit_count(F.aggregate(b, full, step))


def _lcs_long(a: Column, b: Column) -> Column:
    state = "struct<carry: bigint, row: array<bigint>>"
    words = F.ceil(F.size(a) / MAX_BITS).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), words - 1), lambda w: F.slice(a, w * MAX_BITS + 1, F.lit(MAX_BITS)))

    def over(cut_up: Column) -> Column:
        def word(s: Column, x: Column) -> Column:
            total = x["v"] + x["v"].bitwiseAND(x["m"]) + s["carry"]
            return F.struct(F.shiftright(total, MAX_BITS).alias("carry"), F.concat(s["row"], F.array(_advanced(x["v"], x["m"], s["carry"]).bitwiseAND(F.lit(_FULL)))).alias("row")).cast(state)

        def step(row: Column, y: Column) -> Column:
            both = F.zip_with(row, cut_up, lambda v, items: F.struct(v.alias("v"), _mask(items, y).alias("m")))
            start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("row")).cast(state)
            return F.aggregate(both, start, word)["row"]

        last = F.aggregate(b, F.transform(cut_up, lambda _: F.lit(_FULL).cast("bigint")), step)
        return F.aggregate(last, F.lit(0), lambda n, v: n + MAX_BITS - F.bit_count(v))

    return _let(chunks, over)


def lcs_length(a: Column, b: Column) -> Column:
    """LCS of two arrays, bit-parallel (Hyyro 2004), without leaving the JVM; fastest if a is the shorter.

    Bit i of a mask stands for item i of a; each item of b advances the row V by
    V = (V + (V & M)) | (V & ~M), and zeros among the low bits are matches. Rows of more than
    MAX_BITS items are arrays of words through which the sum carries; bits above the last
    item stay set.
    """
    return F.when(F.size(a) <= MAX_BITS, _lcs_short(a, b)).otherwise(_lcs_long(a, b))


def rouge_l_f1(lcs: Column, a: Column, b: Column) -> Column:
    """2 lcs / (a + b) of token counts a and b; 1 if both are empty."""
    return F.when((a == 0) & (b == 0), F.lit(1.0)).when(lcs == 0, F.lit(0.0)).otherwise(F.lit(2.0) * lcs / (a + b))


def count_tokens(text: Column, encoder: Callable[[list[str]], list[int]] | None = None) -> Column:
    """How many tokens each text has; null has 0.

    Without an encoder words, numbers and single other characters count, natively. An encoder
    takes a list of texts and returns their counts; it runs in Arrow batches.
    """
    if encoder is None:
        return F.coalesce(F.regexp_count(text, F.lit(r"[A-Za-z_]\w*|\d+|[^\sA-Za-z_\d]")), F.lit(0))

    @pandas_udf(IntegerType())
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(encoder(s.fillna("").tolist()), dtype="int32")

    return run(text)


def sum_tokens(texts: Column, encoder: Callable[[list[str]], list[int]]) -> Column:
    """How many tokens all texts of an array have together, by an encoder as in count_tokens()."""

    @pandas_udf(IntegerType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: int(sum(encoder([t or "" for t in x])))).astype("int32")

    return run(texts)


def deal_by_length(rows: DataFrame, size: Column, *keys: str, parts: int | None = None) -> DataFrame:
    """rows repartitioned so that tasks have about as much text each, before work that takes time by length.

    Rows of sizes between two powers of two are a bucket, which is dealt by the hash of keys
    over as many partitions as its share of all text asks for. So large texts lie apart, small
    ones together. Sizes are added up by bucket first, in one slim pass; there are as many
    buckets as powers of two. At most one more partition a bucket is made than parts, by
    default the session's shuffle partitions.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))).cast("int")
    sums = {r["b"]: r["s"] for r in rows.groupBy(bucket.alias("b")).agg(F.sum(F.greatest(size, F.lit(1)).cast("bigint")).alias("s")).collect()}
    total, first, share = sum(sums.values()), {}, {}
    for b in sorted(sums):
        first[b], share[b] = sum(share.values()), max(1, round(parts * sums[b] / total))
    if not sums:
        return rows
    look_up = lambda of: F.create_map(*(F.lit(x) for b in of for x in (b, of[b])))[bucket]
    return rows.repartitionById(sum(share.values()), (look_up(first) + F.pmod(F.xxhash64(*keys), look_up(share))).cast("int"))


@pandas_udf(DoubleType())
def hash_fraction(ids: pd.Series) -> pd.Series:
    """blake2b of the id, 8 bytes big-endian, over 2 ** 64; null for null."""
    return ids.map(lambda x: None if x is None else int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") / 2**64).astype("float64")


def md5_fraction(ids: Column) -> Column:
    """The like from md5's first 13 hex digits, without leaving the JVM."""
    return F.conv(F.substring(F.md5(ids), 1, 13), 16, 10).cast("double") / float(2**52)
