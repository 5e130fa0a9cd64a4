"""Writers of rows, id pairs, selections and named splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runforge.operators.scoring import eval_summary
from runforge.sources.versions import write_versioned


def write_jsonl(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object a line, UTF-8 as it is, nulls kept."""
    rows.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_id_pairs(pairs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """(train_id, eval_id) as tab-separated text without a header."""
    pairs.select("train_id", "eval_id").write.mode(mode).option("sep", "\t").csv(path)


def write_selection(selected: DataFrame, path: str, cohorts: dict[str, str], overwrite: bool = False) -> None:
    """A manifest of selected runs and the summary of their scores under one commit; an existing target is an error unless overwritten. read_selection() gives both."""
    keys = [c for c in ("dataset", "context_id", "run_id", "run_dir", "round_id", "pick") if c in selected.columns]

    def write(folder: str) -> None:
        selected.select(*keys).write.parquet(f"{folder}/manifest")
        write_jsonl(eval_summary(selected, cohorts), f"{folder}/eval_stats")

    write_versioned(selected.sparkSession, path, write, overwrite)


def publish_splits(splits: dict[str, DataFrame], path: str) -> None:
    """Named splits of a Parquet dataset, in one write. A split that is there already is replaced, others stay; an empty one is an error.

    Rows go to a staging folder first; splits take their places when all are written, so a
    repeated or a failed publication neither doubles rows nor loses any.
    """
    every = None
    for name, rows in splits.items():
        if not rows.head(1):
            raise ValueError(f"split {name} has no rows")
        one = rows.withColumn("split", F.lit(name))
        every = one if every is None else every.unionByName(one)
    if every is None:
        raise ValueError("no splits")
    every.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split").parquet(path)


def publish_split(rows: DataFrame, path: str, split: str) -> None:
    """One split of publish_splits()."""
    publish_splits({split: rows}, path)
