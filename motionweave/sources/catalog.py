"""Recordings, event logs, demographics and matrices as files.

File names carry the relational key (``sub-…_task-…[_run-…]_tracksys-…_kinct<a>-<b>_…``); for
our own matrices the same key is the partitioning of a Parquet table, so Spark prunes
files instead of filtering names.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable
from functools import reduce
from multiprocessing.pool import ThreadPool

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = "onset double, event_type string"
MATRIX_KEYS = ["task", "kin", "method", "full", "interpol"]


def file_keys(files: DataFrame) -> DataFrame:
    """Adds sub_id, task, run, tracksys, start and stop parsed from ``name`` (NULL if absent)."""

    def part(pattern: str, group: int = 1):
        return F.nullif(F.regexp_extract("name", pattern, group), F.lit(""))

    return files.withColumns(
        {k: part(f"{k.removesuffix('_id')}-([^_.]+)") for k in ("sub_id", "task", "run", "tracksys")}
        | {k: part(r"kinct(\d+)-(\d+)", g).cast("long") for g, k in enumerate(("start", "stop"), 1)}
    )


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Files as a table of path, name and the keys of their names; no file is opened."""
    files = spark.read.format("binaryFile").load(path).select("path")
    return file_keys(files.withColumn("name", F.element_at(F.split("path", "/"), -1)))


def choose_recordings(recordings: DataFrame, logs: DataFrame, subjects: DataFrame) -> DataFrame:
    """One recording and one event file for each subject, task and tracking system.

    ``subjects`` has sub_id, ``asked`` (the run to look for) and ``run`` (the one that the
    recording counts as; NULL for people without medication).  Recordings without an event
    file are left out.  Returns the keys, name, path, log and log_path.
    """
    ours = [files.withColumnRenamed("run", "_own").join(subjects, "sub_id") for files in (recordings, logs)]
    ours = [files.withColumnsRenamed({"run": "_as", "_own": "run"}) for files in ours]
    first = first_of_run(ours[0], ["sub_id", "task", "tracksys"], F.col("asked"))
    log = first_of_run(ours[1], ["sub_id", "task"], F.col("asked")).select("sub_id", "task", F.col("name").alias("log"), F.col("path").alias("log_path"))
    return first.join(log, ["sub_id", "task"]).select("sub_id", "task", "tracksys", F.col("_as").alias("run"), "name", "path", "log", "log_path")


def first_of_run(files: DataFrame, keys: list[str], run: str | Column | None) -> DataFrame:
    """First file by name per key: of the asked run if any file names a run, else of those without."""
    w = Window.partitionBy(*keys)
    marked = files.withColumn("_any", F.max(F.col("run").isNotNull()).over(w))
    fits = F.when(F.col("_any"), F.col("run") == (run if isinstance(run, Column) else F.lit(run))).otherwise(F.col("run").isNull())
    return marked.filter(fits).withColumn("_r", F.row_number().over(w.orderBy("name"))).filter("_r = 1").drop("_any", "_r")


def pick_matrices(files: DataFrame, task: str, tracksys: str, kin: str, method: str, *, run: str | None = None, full: bool = False, interpol: bool = False) -> DataFrame:
    """Matrix files of one condition, with their cycle's start."""
    keyed = file_keys(files)
    ok = (F.col("task") == task) & (F.col("tracksys") == tracksys) & F.contains("name", F.lit(f"_{kin}_")) & F.contains("name", F.lit(method))
    for word, wanted in (("full", full), ("interpol", interpol)):
        ok &= F.contains("name", F.lit(word)) if wanted else ~F.contains("name", F.lit(word))
    return keyed.filter(ok & (F.col("run") == run if run else F.col("run").isNull()))


def read_tsv(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """Tab-separated files with a header, which must be that of the schema."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema, enforceSchema=False, nanValue="NaN", nullValue="")


def header(spark: SparkSession, path: str) -> str:
    """First line of a file, from its first bytes."""
    io, target = spark._jvm.java.io, spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = io.BufferedReader(io.InputStreamReader(target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target), "UTF-8"))
    try:
        return (reader.readLine() or "").rstrip("\r")
    finally:
        reader.close()


def layouts(spark: SparkSession, paths: Iterable[str], at_once: int = 16) -> dict[str, list[str]]:
    """Files by their header line; only the first bytes of each are read."""
    paths, out = sorted(paths), {}
    with ThreadPool(at_once) as pool:
        for path, line in zip(paths, pool.map(lambda p: header(spark, p), paths)):
            out.setdefault(line, []).append(path)
    return out


def read_motion(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Wide recordings (a pattern or a list of files) as (name, frame, marker, axis, value); NaN becomes NULL.

    Files may differ in their columns and in the order of them.  Frames are numbered by the
    place in the file, whatever splits it is read in.
    """
    if isinstance(paths, str):
        paths = [r.path for r in listing(spark, paths).select("path").collect()]
    parts = []
    for head, files in layouts(spark, paths).items():
        columns = head.split("\t")
        if not any("_POS_" in c for c in columns):
            continue
        wide = read_tsv(spark, files, T.StructType([T.StructField(c, T.DoubleType()) for c in columns]))
        wide = wide.withColumns({"name": F.col("_metadata.file_name"), "_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()})
        wide = wide.withColumn("frame", F.row_number().over(Window.partitionBy("_file").orderBy("_block", "_at")) - 1)
        kept = [c for c in columns if not c.endswith("_err") and not c.startswith(("start_", "end_"))]
        long = wide.unpivot(["name", "frame"], kept, "column", "value")
        key = F.regexp_extract("column", r"^(.*)_POS_([xyz])$", 1), F.regexp_extract("column", r"^(.*)_POS_([xyz])$", 2)
        parts.append(long.select("name", "frame", key[0].alias("marker"), key[1].alias("axis"), F.when(~F.isnan("value"), F.col("value")).alias("value")))
    if not parts:
        return spark.createDataFrame([], "name string, frame int, marker string, axis string, value double")
    return reduce(DataFrame.unionByName, parts)


def read_events(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Event logs with the keys of their file names; onsets are frames."""
    rows = read_tsv(spark, path, EVENT_SCHEMA).withColumn("name", F.col("_metadata.file_name"))
    return file_keys(rows).withColumn("onset", F.col("onset").cast("long"))


def read_demographics(spark: SparkSession, path: str) -> DataFrame:
    """Demographics as CSV, Parquet or a workbook (a small table, which pandas reads on the driver)."""
    if path.endswith((".xlsx", ".xls")):
        return spark.createDataFrame(pd.read_excel(path))
    return spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True, inferSchema=True)


def write_matrices(edges: DataFrame, path: str) -> None:
    """Edge tables of all cycles, partitioned by condition.

    Only the conditions that are written are replaced.  Rows are rebalanced by condition, so a
    small one is one file and a large one is dealt over tasks of the advisory size.
    """
    edges.hint("rebalance", *MATRIX_KEYS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*MATRIX_KEYS).parquet(path)


def read_matrices(spark: SparkSession, path: str, **condition) -> DataFrame:
    """Edges of one condition: the filters prune partitions."""
    out = spark.read.parquet(path)
    for k, v in condition.items():
        out = out.filter(F.col(k) == v)
    return out


def content_key(df: DataFrame) -> str:
    """A key of a table's rows, whatever their order: their number and two sums of row hashes."""
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(20,0)")).alias("sum"), F.bit_xor(row).alias("xor")).first()
    return f"{r.n}:{r.sum}:{r.xor}"


def cached_table(spark: SparkSession, path: str, build: Callable[[], DataFrame], key: dict | None = None) -> DataFrame:
    """The table of ``key`` (inputs and parameters), built below ``path`` if it is absent.

    A table is written aside and published by one rename, so readers see all of it or none; of
    two writers of one key the first wins.  Other keys have tables of their own.
    """
    name = hashlib.sha256(json.dumps(key or {}, sort_keys=True, default=str).encode()).hexdigest()[:24]
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    target, aside = to_path(f"{path}/{name}"), to_path(f"{path}/_{name}-{uuid.uuid4().hex}")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(target):
        build().write.parquet(aside.toString())
        if not files.exists(target):
            files.rename(aside, target)
        if files.exists(aside):
            files.delete(aside, True)
        lost = to_path(target, aside.getName())  # a rename onto a folder moves into it
        if files.exists(lost):
            files.delete(lost, True)
    return spark.read.parquet(target.toString())


def pivot_edges(edges: DataFrame, keys: list[str], columns: str, value: str, names: list[str]) -> DataFrame:
    """One row per key with a column for each edge, at two decimals, 'nan' where it is missing."""
    wide = edges.groupBy(*keys).pivot(columns, names).agg(F.first(F.when(F.col(value).isNotNull(), F.format_string("%.2f", F.round(value, 2)))))
    return wide.fillna("nan", names)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
