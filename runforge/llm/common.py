"""What the operators of this subpackage share: loading, row keys, cutting lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runforge.lineage import cut, discard  # noqa: F401  the operators take them from here

#: The white space of the contracts: space, \t, \n, \v, \f, \r.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else, as lower() would also change other letters."""
    return F.translate(c, UPPER, LOWER)


def row_key(*cols: str) -> Column:
    """Tells rows of one id with different contents apart; always joined along with the id."""
    return F.xxhash64(*cols)


def same_row(a: DataFrame, b: DataFrame, id_col: str, key: str = "row_key") -> Column:
    """Join condition on (id, key) under which null ids meet."""
    return a[id_col].eqNullSafe(b[id_col]) & (a[key] == b[key])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
