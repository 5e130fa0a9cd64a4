"""Readers of what runs leave behind. Paths are data: <dataset...>/<context_id>/<run_id>/<file>."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runforge.lineage import cut, discard
from runforge.operators import designs
from runforge.schemas import RESULT_JSON, ROUND_HISTORY, ROUND_INPUTS, SFT_RAW
from runforge.sources.versions import current

#: Layouts of design tables and what normalizes them.
LAYOUTS: dict[str, Callable[..., DataFrame]] = {"qa": designs.normalize_qa, "verified": designs.normalize_verified, "nested": designs.normalize_nested}


def normalize_contexts(raw: DataFrame, layout: str, dataset: str, *order: str) -> DataFrame:
    """A design table in one of LAYOUTS as contexts; order is needed by verified only."""
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout: {layout}")
    return LAYOUTS[layout](raw, dataset, *order)


def load_dataset(spark: SparkSession, name: str, registry: dict[str, tuple]) -> DataFrame:
    """The contexts of a named dataset; registry maps a name to (layout, path, order columns...). Paths end in .json, .jsonl or are Parquet."""
    if name not in registry:
        raise ValueError(f"unknown dataset: {name}")
    layout, path, *order = registry[name]
    raw = spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)
    return normalize_contexts(raw, layout, name, *order)


#: Directories that a task lists, and files and bytes that it reads, where there are more than tasks to share them.
DIRS_IN_TASK, FILES_IN_TASK, BYTES_IN_TASK = 1_000, 20_000, 256 << 20
#: Files and bytes that a task holds at once.
HELD_FILES, HELD_BYTES = 1_000, 16 << 20


def _qualified(spark: SparkSession, root: str) -> str:
    """root as tasks open it: with its scheme, local ones as a plain path. A missing one is an error."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(path):
        raise FileNotFoundError(f"no such path: {root}")
    whole = store.makeQualified(path).toString().rstrip("/")
    return "/" + whole.removeprefix("file:").lstrip("/") if whole.startswith("file:") else whole


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata")))


def _tasks(spark: SparkSession, least: int, most: int) -> int:
    return max(1, min(most, max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))))


def listed_files(spark: SparkSession, root: str, name_glob: str = "*") -> DataFrame:
    """(parts, length, modified) of the files at any depth below root whose name fits (*, ? and [..]); none is opened. A root that is a file is listed itself.

    Tasks list directories, a level of them at a time, into the shared folder, so that the
    driver holds no path however many files there are. Hidden names are passed over; empty
    files count.
    """
    whole = _qualified(spark, root)

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(whole)
        for b in batches:
            for folder in b.column(0).to_pylist():
                top = store.get_file_info(base) if not folder else None
                alone = top is not None and top.type == fs.FileType.File
                found = [top] if alone else store.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base))
                for at in range(0, len(found), 10_000):
                    rows = []
                    for x in found[at : at + 10_000]:
                        is_dir = x.type == fs.FileType.Directory
                        if alone or not _hidden(x.base_name) and (is_dir or fnmatch.fnmatchcase(x.base_name, name_glob)):
                            rows.append({"path": f"{folder}/{x.base_name}" if folder else x.base_name, "is_dir": is_dir, "length": x.size, "ms": (x.mtime_ns or 0) // 1_000_000})
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    kinds = pa.schema([("path", pa.string()), ("is_dir", pa.bool_()), ("length", pa.int64()), ("ms", pa.int64())])
    levels, dirs, n = [], spark.range(1).select(F.lit("").alias("path")), 1
    while n:
        dealt = dirs.repartition(_tasks(spark, -(-n // DIRS_IN_TASK), n), "path")
        levels.append(cut(dealt.mapInArrow(below, "path string, is_dir boolean, length bigint, ms bigint")))
        dirs = levels[-1].where("is_dir").select("path")
        n = dirs.count()
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    out = cut(every.where("not is_dir").select(F.split("path", "/").alias("parts"), "length", F.timestamp_millis("ms").alias("modified")).coalesce(_tasks(spark, 0, 1_000_000)))
    discard(*levels)
    return out


def whole_files(spark: SparkSession, root: str, name_glob: str, modified_after: str | None = None, listed: DataFrame | None = None) -> DataFrame:
    """(parts, name, raw): the path below root in parts, and the whole text, of each file of that name at any depth.

    Of those that are listed, if given, else of listed_files(). Tasks open files by the paths
    that they are dealt; bytes are kept as they are.
    """
    listed = listed_files(spark, root, name_glob) if listed is None else listed
    if modified_after is not None:
        listed = listed.where(F.col("modified") > F.lit(modified_after).cast("timestamp"))
    whole = _qualified(spark, root)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(whole)
        alone = store.get_file_info(base).type == fs.FileType.File
        paths, raw, size = [], [], 0

        def held() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(raw, pa.binary())], names=["path", "raw"])

        for b in batches:
            for path in b.column(0).to_pylist():
                with store.open_input_stream(base if alone else f"{base}/{path}") as f:
                    raw.append(f.read())
                paths.append(path)
                size += len(raw[-1])
                if len(raw) >= HELD_FILES or size >= HELD_BYTES:
                    yield held()
                    paths, raw, size = [], [], 0
        yield held()

    n, length = listed.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    dealt = listed.select(F.array_join("parts", "/").alias("path")).repartition(_tasks(spark, max(n // FILES_IN_TASK, length // BYTES_IN_TASK), n), "path")
    parts = F.split("path", "/")
    return dealt.mapInArrow(read, "path string, raw binary").select(parts.alias("parts"), F.col("raw").cast("string").alias("raw"), F.element_at(parts, -1).alias("name"))


def _dataset(depth: int) -> Column:
    return F.array_join(F.slice("parts", F.lit(1), F.greatest(F.size("parts") - depth, F.lit(0))), "/")


def _at(i: int) -> Column:
    return F.try_element_at("parts", F.lit(-i))


def _holds(opening: str) -> Column:
    """Whether the text is JSON that begins so; malformed text gives a struct of nulls or nothing, so it is told here."""
    return F.coalesce(F.expr("try_parse_json(raw) is not null"), F.lit(False)) & F.trim("raw", F.lit(" \t\r\n")).startswith(opening)


def _split(marked: DataFrame, *cols: str) -> tuple[DataFrame, DataFrame]:
    """(rows with these columns, rejects: path and reason)."""
    return marked.where("reason is null").select(*cols), marked.where("reason is not null").select(F.array_join("parts", "/").alias("path"), "reason")


RESULT_COLUMNS = ("dataset", "context_id", "run_id", "result_json", "result")
HISTORY_COLUMNS = ("dataset", "context_id", "run_id", "entry")
INPUT_COLUMNS = ("dataset", "context_id", "repeat_index", "entries")
HISTORY_FILE = "agentic_round_history.json"


def parse_run_results(files: DataFrame) -> DataFrame:
    """Adds RESULT_COLUMNS and reason to (parts, name, raw)."""
    short = F.size("parts") < 4
    reason = F.when(short, "path too short").when(~_holds("{"), "no JSON object")
    keys = {c: F.when(~short, v) for c, v in (("dataset", _dataset(3)), ("context_id", _at(3)), ("run_id", _at(2)))}
    return files.withColumns(keys | {"result_json": F.col("raw"), "result": F.from_json("raw", RESULT_JSON), "reason": reason})


def read_run_results(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(runs, rejects) from all *_result.json: dataset, context_id, run_id, result_json, result; path and reason of what was left out.

    Left out are paths of less than four parts and files that hold no JSON object.
    """
    return _split(parse_run_results(whole_files(spark, root, "*_result.json")), *RESULT_COLUMNS)


def read_run_files(spark: SparkSession, root: str) -> DataFrame:
    """(dataset, context_id, run_id, name, content) of all files of runs, results aside."""
    files = whole_files(spark, root, "*").where(F.size("parts") >= 4)
    return files.where(~F.col("name").endswith("_result.json")).select(_dataset(3).alias("dataset"), _at(3).alias("context_id"), _at(2).alias("run_id"), "name", F.col("raw").alias("content"))


def parse_round_histories(files: DataFrame, every: DataFrame) -> DataFrame:
    """Adds HISTORY_COLUMNS and reason to (parts, name, raw); every lists all files (parts), as a run may be named by a directory beside the history."""
    n = F.size("parts")
    deep, in_round = n >= 5, _at(2).startswith("round_")
    pick = lambda a, b, c: F.when(deep & in_round, a).when(deep, b).when(n == 4, c)
    entries = F.from_json("raw", ROUND_HISTORY)
    keyed = files.withColumns({
        "entry": F.try_element_at(entries, F.lit(-1)), "dataset": pick(_dataset(4), _dataset(3), _dataset(2)), "context_id": pick(_at(4), _at(3), _at(2)), "run_id": pick(_at(3), _at(2), F.lit(None)),
        "reason": F.when(n < 4, "path too short").when(~_holds("["), "no JSON list").when(F.coalesce(F.size(entries), F.lit(0)) < 1, "empty list").when(F.try_element_at(entries, F.lit(-1)).isNull(), "no entry"),
    })
    # Of each directory those below that hold files.
    dirs = every.where(F.size("parts") >= 5).select(F.array_join(F.slice("parts", 1, 3), "/").alias("dir"), F.element_at("parts", 4).alias("d")).distinct()
    only = dirs.groupBy("dir").agg(F.when(F.count("*") == 1, F.min("d")).alias("only"))
    out = keyed.withColumn("dir", F.when(n == 4, F.array_join(F.slice("parts", 1, 3), "/"))).join(only, "dir", "left")
    return out.withColumn("run_id", F.coalesce("run_id", "only")).drop("dir", "only")


def read_round_histories(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(histories, rejects) from each agentic_round_history.json: dataset, context_id, run_id, entry, the last of the file's list; path and reason of what was left out.

    Of a path of five parts or more the run is two above the file if the file lies in a
    round_ directory, else the directory itself; of four parts it is the only directory
    beside the file, or null. Left out are shorter paths and files that hold no list, or an
    empty one, or one that doesn't end in an object.
    """
    every = listed_files(spark, root)
    histories = every.where(F.element_at("parts", -1) == HISTORY_FILE)
    return _split(parse_round_histories(whole_files(spark, root, HISTORY_FILE, None, histories), every), *HISTORY_COLUMNS)


def parse_round_inputs(files: DataFrame) -> DataFrame:
    """Adds INPUT_COLUMNS and reason to (parts, name, raw)."""
    n = F.expr(r"try_cast(regexp_extract(name, '^agentic_eval_round_inputs_(\\d+)\\.json$', 1) as int)")
    out = files.withColumns({"dataset": _dataset(2), "context_id": _at(2), "repeat_index": n, "entries": F.from_json("raw", ROUND_INPUTS)})
    return out.withColumn("reason", F.when(F.size("parts") < 2, "path too short").when(F.col("repeat_index").isNull(), "no repeat index in the name").when(~_holds("[") | F.col("entries").isNull(), "no JSON list"))


def read_round_inputs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(inputs, rejects) from agentic_eval_round_inputs_<n>.json: dataset, context_id, repeat_index, entries, where the context is the directory; path and reason of what was left out."""
    return _split(parse_round_inputs(whole_files(spark, root, "agentic_eval_round_inputs_*.json")), *INPUT_COLUMNS)


def read_best_entries(spark: SparkSession, path: str, run_dir: str) -> DataFrame:
    """(dataset, context_id, run_id, and result fields if there are any) from an eval_stats.json, or from all JSON files below a directory.

    Of each file best_results_output is taken, else best_rids, which has run ids only; a file
    with neither is an error. Keys below run_dir, or below a directory of its name, are cut
    down to what follows; other absolute keys and keys of less than two parts are left out.
    """
    entry = "struct<run_id: string, is_pass_xrun: boolean, has_coverage: boolean, overall_coverage: double, is_pass_targets: boolean, misc: map<string, double>>"
    stats = whole_files(spark, path, "*.json").select(F.from_json("raw", f"best_results_output map<string, {entry}>, best_rids map<string, string>").alias("s"))
    if stats.where("s.best_results_output is null and s.best_rids is null").head(1) or not stats.head(1):
        raise ValueError(f"{path} has neither best_results_output nor best_rids")
    full = stats.where("s.best_results_output is not null").select(F.explode("s.best_results_output").alias("key", "e"))
    ids = stats.where("s.best_results_output is null").select(F.explode("s.best_rids").alias("key", "r"))
    none = F.lit(None)
    as_entry = F.struct(F.col("r"), none.cast("boolean"), none.cast("boolean"), none.cast("double"), none.cast("boolean"), none.cast("map<string, double>")).cast(entry)
    rows = full.unionByName(ids.select("key", as_entry.alias("e")))
    base, name = run_dir.rstrip("/") + "/", run_dir.rstrip("/").rpartition("/")[2]
    k = F.col("key")
    parts = F.split(k, "/")
    at = F.array_position(parts, name)
    rel = (
        F.when(~k.startswith("/"), k)
        .when(k.startswith(base), F.substring(k, len(base) + 1, 1 << 20))
        .when(at > 0, F.array_join(F.slice(parts, (at + 1).cast("int"), F.greatest(F.size(parts) - at, F.lit(0)).cast("int")), "/"))
    )
    cut = rows.withColumn("parts", F.filter(F.split(rel, "/"), lambda p: p != "")).where(F.size("parts") >= 2)
    return cut.select(_dataset(1).alias("dataset"), _at(1).alias("context_id"), "e.*")


def read_selection(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(manifest, statistics) of the last write_selection() to path that was finished; both are of the same one."""
    folder = current(spark, path)
    if folder is None:
        raise ValueError(f"{path} holds no selection")
    return spark.read.parquet(f"{folder}/manifest"), spark.read.json(f"{folder}/eval_stats")


def read_jsonl_sources(spark: SparkSession, paths: list[str], schema: str = SFT_RAW, non_empty: bool = True) -> DataFrame:
    """The rows of several JSON-lines files with source_ord, the place of the file in the list; an empty one is an error unless allowed."""
    out = None
    for i, p in enumerate(paths):
        one = spark.read.schema(schema).json(p)
        if non_empty and not one.head(1):
            raise ValueError(f"{p} has no rows")
        one = one.withColumn("source_ord", F.lit(i))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no paths")
    return out
