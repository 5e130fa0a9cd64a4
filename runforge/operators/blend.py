"""Exact samples, shuffles and blends by a seeded hash order, which no partitioning changes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runforge.lineage import cut

#: Rows that one task may rank.
BUCKET_ROWS = 100_000
#: Hex digits of the buckets that a blend counts first; enough for BUCKET_ROWS * 16 ** 2 rows.
FIRST_DIGITS = 2


def seeded(seed: int, *keys: str) -> Column:
    """md5 of the seed and the keys, null keys left out: the order of samples and shuffles, which any engine can compute."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def _digits(n: int) -> int:
    """How many hex digits of a hash part n rows into buckets of BUCKET_ROWS or less, eight at most."""
    return min(8, max(0, math.ceil(math.log(max(1, n / BUCKET_ROWS), 16))))


def sample_exact(rows: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """n rows without replacement, all if there are no more; keys identify a row.

    The first n by seeded() are taken: whole buckets of hash prefixes, counted first, and of
    the bucket in which n falls its first rows, so that no task ranks more than a bucket.
    """
    if n < 0:
        raise ValueError(f"n must not be negative: {n}")
    total = rows.count()
    if n >= total:
        return rows
    hashed = rows.withColumn("_h", seeded(seed, *keys)).withColumn("_b", F.substring("_h", 1, _digits(total)))
    before = 0
    for b, c in sorted((r["_b"], r["c"]) for r in hashed.groupBy("_b").agg(F.count("*").alias("c")).collect()):  # a few times total / BUCKET_ROWS
        if before + c > n:
            break
        before += c
    part = hashed.where(F.col("_b") == b).orderBy("_h", *keys).limit(n - before)
    return hashed.where(F.col("_b") < b).unionByName(part).drop("_h", "_b")


def shuffle_rows(rows: DataFrame, seed: int, *keys: str) -> DataFrame:
    return rows.orderBy(seeded(seed, *keys), *keys)


def positions(rows: DataFrame, *order: str | Column) -> DataFrame:
    """Adds position, from 0, in the order: rows are sorted by ranges, counted in each, and numbered where they lie."""
    placed = cut(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_p")).agg(F.count("*").alias("_c"))  # a row for each partition
    before = counts.withColumn("_before", F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).drop("_c")
    return placed.withColumn("_p", part).join(F.broadcast(before), "_p").withColumn("position", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_at", "_before")


def slice_rows(rows: DataFrame, start: int | None, end: int | None, *order: str, limit: int | None = None, needs: str | None = None) -> DataFrame:
    """Rows start to end (exclusive) of the order, or the first limit; not both. A null in column needs is an error."""
    if limit is not None and (start is not None or end is not None):
        raise ValueError("give a slice or a limit")
    if needs is not None and rows.where(F.col(needs).isNull()).head(1):
        raise ValueError(f"rows without {needs}")
    last = limit if limit is not None else end
    at = F.col("position")
    return positions(rows, *order).where((at >= (start or 0)) & (F.lit(True) if last is None else at < last)).drop("position")


def repeat_items(rows: DataFrame, n: int) -> DataFrame:
    """Each row n times, with repeat_index."""
    return rows.withColumn("repeat_index", F.explode(F.sequence(F.lit(0), F.lit(n - 1)) if n > 0 else F.array().cast("array<int>")))


def concat_sources(*sources: DataFrame) -> DataFrame:
    """All rows with source_ord, the place of their source."""
    out = None
    for i, s in enumerate(sources):
        one = s.withColumn("source_ord", F.lit(i))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def blend_shares(rows: DataFrame, n: int) -> DataFrame:
    """(source_ord, size, share): how many of n rows each source gives, by largest remainder; of equal remainders the later source. One row for each source."""
    return _shares(rows.groupBy("source_ord").agg(F.count("*").alias("size")), n)


def _shares(sizes: DataFrame, n: int) -> DataFrame:
    every = Window.partitionBy(F.lit(0))
    exact = F.col("size") * F.lit(n) / F.sum("size").over(every)
    floors = sizes.withColumn("exact", exact).withColumn("whole", F.floor("exact"))
    rest = F.row_number().over(every.orderBy((F.col("exact") - F.col("whole")).desc(), F.col("source_ord").desc()))
    return floors.withColumn("share", F.col("whole") + F.when(rest <= F.lit(n) - F.sum("whole").over(every), 1).otherwise(0)).select("source_ord", "size", "share")


def blend(rows: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """n rows in all, from each source_ord its share: whole copies, and a sample of the rest.

    keys identify a row within its source. copy counts a row's copies. n = -1 changes
    nothing. Rows are ranked by hash within hash buckets, of which there are more as the
    sources grow, so that no task ranks a whole source. Rows are read twice: to count
    buckets, from which sizes and shares follow, and to take them.
    """
    if n == -1:
        return rows.withColumn("copy", F.lit(0))
    if n <= 0:
        raise ValueError(f"n must be -1 or positive: {n}")
    hashed = rows.withColumn("_h", seeded(seed, "source_ord", *keys))
    counted = lambda digits: cut(hashed.groupBy("source_ord", F.substring("_h", 1, digits).alias("_b")).agg(F.count("*").alias("_c")))
    digits = FIRST_DIGITS
    counts = counted(digits)
    total = counts.agg(F.coalesce(F.sum("_c"), F.lit(0))).first()[0]
    if _digits(total) > digits:
        digits = _digits(total)
        counts = counted(digits)
    sizes = counts.groupBy("source_ord").agg(F.sum("_c").alias("size"))
    shares = _shares(sizes, n).withColumns({"copies": F.floor(F.col("share") / F.col("size")).cast("int"), "rest": F.col("share") % F.col("size")})
    # How many rows come before each bucket.
    before = counts.withColumn("_before", F.sum("_c").over(Window.partitionBy("source_ord").orderBy("_b")) - F.col("_c")).drop("_c")
    placed = hashed.withColumn("_b", F.substring("_h", 1, digits)).join(shares.drop("size", "share"), "source_ord").join(before, ["source_ord", "_b"])
    rank = F.row_number().over(Window.partitionBy("source_ord", "_b").orderBy("_h", *keys)) + F.col("_before")
    times = F.col("copies") + F.when(F.col("_rank") <= F.col("rest"), 1).otherwise(0)
    return placed.withColumn("_rank", rank).withColumn("_t", times).where("_t > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_t") - 1))).drop("_h", "_b", "_before", "_rank", "_t", "copies", "rest")
