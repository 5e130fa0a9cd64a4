"""Quantiles by sketches that merge, for where exact ones cost too much.

An exact percentile keeps every distinct value with its count; a sketch keeps a few hundred
numbers however many rows it has seen, and sketches of parts, of days or of datasets, can be
stored and merged later without their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch; larger is closer.
K = 400


def rank_error(k: int = K) -> float:
    """How far a quantile's rank may be off, as a share of all rows, with 99 % confidence: the published bound of KLL sketches."""
    return 2.296 / k**0.9021


def sketches(rows: DataFrame, value: str | Column, *keys: str, k: int = K) -> DataFrame:
    """(keys, n, sketch) of the whole numbers in value; nulls don't count."""
    v = (F.col(value) if isinstance(value, str) else value).cast("bigint")
    return rows.select(*keys, v.alias("_v")).where("_v is not null").groupBy(*keys).agg(F.count("*").alias("n"), F.kll_sketch_agg_bigint("_v", k).alias("sketch"))


def merged(parts: DataFrame, *keys: str, k: int = K) -> DataFrame:
    """(keys, n, sketch) over several sketches() of parts."""
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch", k).alias("sketch"))


def quantile(sketch: str | Column, q: float) -> Column:
    """The value of rank q among those that the sketch has seen."""
    return F.kll_sketch_get_quantile_bigint(sketch, F.lit(float(q)))
