"""Shared plumbing: the shared working folder, hold-out splits and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = b" \t\n\x0b\x0c\r"
_OWN_DIR = "spark.motionweave.sharedDir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that is unset and all runs on one machine (tests), a temporary folder is
    made, once a session; its name is kept in a setting of our own, since Spark lets no
    running session change ``spark.checkpoint.dir``.  A cluster must name its folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN_DIR, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="motionweave-")
        spark.conf.set(_OWN_DIR, path)
    return path.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to ``path`` and read it back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it below the shared folder and read it back."""
    return written(df, fresh_dir(df.sparkSession, name))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared one that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: str | Column, m: int) -> Column:
    """crc32 of the id written as text, modulo ``m``; null ids give null."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % F.lit(m)


def is_held_out(doc_id: str | Column, m: int, r: int) -> Column:
    """True where the remainder is ``r``; a null id is never held out."""
    return F.coalesce(crc_mod(doc_id, m) == F.lit(r), F.lit(False))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """First column of that name (extra columns may repeat it)."""
    return batch.column(batch.schema.names.index(name))


def text_bytes(col: pa.Array) -> list[bytes]:
    """UTF-8 of every value; null counts as empty."""
    return [b"" if v is None else v for v in col.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, name: str, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``limit`` text bytes (one row at least)."""
    if batch.num_rows == 0:
        return
    col = column(batch, name).cast(pa.large_binary())
    ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    start = 0
    while start < len(col):
        stop = int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), len(col))
        yield batch.slice(start, stop - start)
        start = stop


def record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [v if isinstance(v, pa.Array) else pa.array(v, f.type) for f, v in ((f, columns[f.name]) for f in schema)],
        schema=schema,
    )
