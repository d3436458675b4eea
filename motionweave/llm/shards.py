"""A sharded table with size-tiered compaction and versioned manifests.

``append`` writes arrivals as small immutable Parquet shards; ``compact`` merges runs of
similarly sized shards into files of about the target size, one task per output file
and without a shuffle.

A version is a small file: the schema and the names of *segments*, each an immutable list
of shards.  An append adds one segment; a compaction rewrites only the segments that it
touches, so a commit's size does not grow with the table.  A version is published by
creating its file if it is absent, atomically: a hard link on local and mounted folders, a
rename that does not overwrite on HDFS, and a conditional create on object stores (which
publish a file when it is closed).  Of two writers one wins; the other puts its shards on
top of the new version and tries again.  Before that, it checks that its files exist.

Every writer first leaves an intent, which bears the prefix of its data files, and removes
it when it is done.  ``vacuum`` deletes only data that no kept version names and no intent
covers, so it never takes the files of a writer that has not committed yet.

Columns may be added: a version's schema is that of the former one and the new columns,
older rows are null in them, and arrivals without a column are null in it.  A column that
changes its type is refused before anything is written.  Names that differ in case only are
one column, as in Spark; an arrival with two columns of one name is refused.

Rows are kept as they are: nulls, empty and long texts, repeated rows and columns of any
other name.  An empty arrival adds a version without shards.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motionweave.llm.common import column, fresh_dir, table

SHARD_BYTES = 8 << 20  # plain Arrow bytes of a small shard
TARGET_BYTES = 128 << 20  # Parquet bytes of a compacted file
TIER_BASE, TIER_RATIO, FAN_IN = 1 << 20, 4, 2
ROW_GROUP_BYTES = 64 << 20

RETRIES = 20
#: Intents of writers that have died are ignored after this many seconds.
STALE_INTENT = 7 * 86_400

_SHARD = "path string, rows long, bytes long"


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


class SchemaConflict(ValueError):
    """A column has another type than in the table, or a name occurs twice."""


@dataclass(frozen=True)
class Shard:
    path: str
    rows: int
    bytes: int

    @property
    def tier(self) -> int:
        return tier(self.bytes)


def tier(size: int) -> int:
    """Tier 0 holds shards of up to ``TIER_BASE``; each next one is ``TIER_RATIO`` times as large."""
    return max(0, math.ceil(math.log(max(size, 1) / TIER_BASE, TIER_RATIO)))


def plan(shards: list[Shard], target: int = TARGET_BYTES, fan_in: int = FAN_IN) -> list[list[Shard]]:
    """Groups to merge: neighbours within a tier, up to the target size; full files stay."""
    out: list[list[Shard]] = []
    tiers: dict[int, list[Shard]] = {}
    for s in shards:
        if 4 * s.bytes < 3 * target:
            tiers.setdefault(s.tier, []).append(s)
    for _, run in sorted(tiers.items()):
        group: list[Shard] = []
        for s in sorted(run, key=lambda s: (s.bytes, s.path)):
            if group and sum(x.bytes for x in group) + s.bytes > target:
                out.append(group)
                group = []
            group.append(s)
        out.append(group)
    return [g for g in out if len(g) >= fan_in]


def merged(old: T.StructType | None, new: T.StructType) -> T.StructType:
    """``old`` and the columns that only ``new`` has; all are nullable."""
    names = [f.name.lower() for f in new]
    if len(set(names)) < len(names):
        raise SchemaConflict("two columns of one name")
    out = {f.name.lower(): T.StructField(f.name, f.dataType, True) for f in (old or [])}
    for f in new:
        here = out.setdefault(f.name.lower(), T.StructField(f.name, f.dataType, True))
        if here.dataType.simpleString() != f.dataType.simpleString():
            raise SchemaConflict(f"column {f.name} is {here.dataType.simpleString()}, not {f.dataType.simpleString()}")
    return T.StructType(list(out.values()))


def _fit(piece: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """The columns of ``schema``; those that an older shard lacks are null."""
    at = {n.lower(): k for k, n in enumerate(piece.schema.names)}
    columns = [piece.column(at[f.name.lower()]).cast(f.type) if f.name.lower() in at else pa.nulls(piece.num_rows, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


class _Writer:
    """Writes one Parquet file in row groups of bounded size."""

    def __init__(self, root: str, writer: str, schema: pa.Schema) -> None:
        self.uri = f"{root}/data/{writer}-{uuid.uuid4().hex}.parquet"
        where, path = fs.FileSystem.from_uri(self.uri)
        self.where, self.path = where, path
        self.sink = where.open_output_stream(path, compression=None)
        self.out = pq.ParquetWriter(self.sink, schema, compression="zstd")
        self.pending: list[pa.RecordBatch] = []
        self.size = self.rows = 0

    def add(self, batch: pa.RecordBatch) -> None:
        self.pending.append(batch)
        self.rows += batch.num_rows
        self.size += batch.nbytes
        if self.size >= ROW_GROUP_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.pending:
            self.out.write_table(pa.Table.from_batches(self.pending))
        self.pending, self.size = [], 0

    def close(self) -> tuple[str, int, int]:
        self.flush()
        self.out.close()
        self.sink.close()
        return self.uri, self.rows, self.where.get_file_info(self.path).size


def _shard_batch(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
    path, n, size = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(path), pa.array(n, pa.int64()), pa.array(size, pa.int64())], names=["path", "rows", "bytes"])


def _pieces(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """Halve a batch until every piece is below the limit or has one row."""
    if batch.num_rows <= 1 or batch.nbytes <= limit:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from _pieces(batch.slice(0, half), limit)
        yield from _pieces(batch.slice(half), limit)


class ShardTable:
    """A table below ``root`` (a URI that all executors reach)."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.where, self.base = fs.FileSystem.from_uri(self.root)
        for d in ("data", "manifests", "segments", "intents"):
            self.where.create_dir(f"{self.base}/{d}")

    # --- versions -----------------------------------------------------------------

    def versions(self) -> list[int]:
        found = self.where.get_file_info(fs.FileSelector(f"{self.base}/manifests"))
        return sorted(int(f.base_name[1:]) for f in found if f.base_name.startswith("v"))

    def latest(self) -> int:
        return max(self.versions(), default=0)

    def _lines(self, name: str) -> list[str]:
        with self.where.open_input_stream(f"{self.base}/{name}", compression=None) as f:
            return f.read().decode().splitlines()

    def _write(self, name: str, lines: list[str]) -> None:
        with self.where.open_output_stream(f"{self.base}/{name}", compression=None) as f:
            f.write("\n".join(lines).encode())

    def segments(self, version: int) -> tuple[T.StructType | None, list[str]]:
        """Schema and segment names of a version (0: before the first one)."""
        if not version:
            return None, []
        schema, *names = self._lines(f"manifests/v{version:010d}")
        return T.StructType.fromJson(json.loads(schema)), names

    def segment(self, name: str) -> list[Shard]:
        return [Shard(**json.loads(s)) for s in self._lines(f"segments/{name}")]

    def manifest(self, version: int | None = None) -> tuple[T.StructType | None, list[Shard]]:
        """Schema and shards of a version (the latest one)."""
        schema, names = self.segments(self.latest() if version is None else version)
        return schema, [s for n in names for s in self.segment(n)]

    def _new_segment(self, shards: list[Shard]) -> list[str]:
        if not shards:
            return []
        name = uuid.uuid4().hex
        self._write(f"segments/{name}", [json.dumps(asdict(s)) for s in shards])
        return [name]

    def commit(self, schema: T.StructType, segments: list[str], base: int) -> int:
        """Publish version ``base + 1``, or raise CommitConflict if it is there already."""
        lines, target = [schema.json(), *segments], f"manifests/v{base + 1:010d}"
        if not self._publish(lines, target):
            raise CommitConflict(f"version {base + 1} exists")
        return base + 1

    def _publish(self, lines: list[str], target: str) -> bool:
        """Create a file with its whole content if it is absent; False if it is there."""
        if isinstance(self.where, fs.LocalFileSystem):
            return self._link(lines, target)
        try:
            (self._rename if self.root.startswith(("hdfs:", "viewfs:")) else self._create)(lines, target)
            return True
        except Exception as e:
            if any(x in str(e) for x in ("AlreadyExists", "PreconditionFailed", "Precondition Failed")):
                return False
            raise

    def _link(self, lines: list[str], target: str) -> bool:
        name = f"manifests/.tmp-{uuid.uuid4().hex}"
        self._write(name, lines)
        try:
            os.link(f"{self.base}/{name}", f"{self.base}/{target}")
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(f"{self.base}/{name}")

    def _rename(self, lines: list[str], target: str) -> None:
        name, jvm = f"manifests/.tmp-{uuid.uuid4().hex}", self.spark._jvm.org.apache.hadoop.fs
        self._write(name, lines)
        src, dst = jvm.Path(f"{self.root}/{name}"), jvm.Path(f"{self.root}/{target}")
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 0)
        try:
            jvm.FileContext.getFileContext(dst.toUri(), self.spark._jsc.hadoopConfiguration()).rename(src, dst, options)
        except Exception:
            self.where.delete_file(f"{self.base}/{name}")
            raise

    def _create(self, lines: list[str], target: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{target}")
        where = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = where.createFile(path).overwrite(False).opt("fs.option.create.conditional.overwrite", True).build()
        out.write(bytearray("\n".join(lines).encode()))
        out.close()

    # --- writing ------------------------------------------------------------------

    @contextmanager
    def _intent(self) -> Iterator[str]:
        """The prefix of a writer's data files, which vacuum leaves alone until it is done."""
        writer = uuid.uuid4().hex
        self._write(f"intents/{writer}", [])
        try:
            yield writer
        finally:
            self.where.delete_file(f"{self.base}/intents/{writer}")

    def _check(self, shards: list[Shard]) -> None:
        found = self.where.get_file_info([f"{self.base}/data/{s.path.rpartition('/')[2]}" for s in shards])
        if lost := [f.path for f in found if f.type != fs.FileType.File]:
            raise RuntimeError(f"{len(lost)} files that were written are gone, such as {lost[0]}")

    def append(self, df: DataFrame, shard_bytes: int = SHARD_BYTES) -> int:
        """Write ``df`` as small shards and commit them after those that are there."""
        root, schema = self.root, merged(None, df.schema)
        merged(self.segments(self.latest())[0], schema)  # a conflict shows before anything is written

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done, out, size = [], None, 0
            for whole in batches:
                for batch in _pieces(whole, shard_bytes):
                    if not batch.num_rows:
                        continue
                    if out is None or size + batch.nbytes > shard_bytes:
                        if out is not None:
                            done.append(out.close())
                        out, size = _Writer(root, writer, batch.schema), 0
                    out.add(batch)
                    size += batch.nbytes
            if out is not None:
                done.append(out.close())
            if done:
                yield _shard_batch(done)

        with self._intent() as writer:
            new = sorted((Shard(*r) for r in df.mapInArrow(run, _SHARD).collect()), key=lambda s: s.path)
            self._check(new)
            added = self._new_segment(new)
            for k in range(RETRIES):
                base = self.latest()
                before, names = self.segments(base)
                try:
                    return self.commit(merged(before, schema), names + added, base)
                except CommitConflict:
                    time.sleep(0.01 * 2 ** min(k, 7))
        raise CommitConflict(f"lost {RETRIES} times to other writers")

    def compact(self, target: int = TARGET_BYTES, fan_in: int = FAN_IN) -> int:
        """Merge until no tier has a run left to merge; one commit per pass.

        Appends that come in between stay.  If another compaction took some of the same
        shards, the pass is planned anew.
        """
        root = self.root
        while True:
            base = self.latest()
            schema, shards = self.manifest(base)
            groups = plan(shards, target, fan_in)
            if not groups:
                return base
            with self._intent() as writer:
                probe = self.spark.createDataFrame([], schema)

                def run(batches: Iterator[pa.RecordBatch], writer: str = writer, arrow: pa.Schema = probe.toArrow().schema) -> Iterator[pa.RecordBatch]:
                    for batch in batches:
                        for paths in column(batch, "paths").to_pylist():
                            out = None
                            for uri in paths:
                                where, path = fs.FileSystem.from_uri(uri)
                                with where.open_input_file(path) as f:
                                    for piece in pq.ParquetFile(f).iter_batches(batch_size=1024):
                                        out = out or _Writer(root, writer, arrow)
                                        out.add(_fit(piece, arrow))
                            if out is not None:
                                yield _shard_batch([out.close()])

                todo = self.spark.createDataFrame([([s.path for s in g],) for g in groups], "paths array<string>").repartition(len(groups))
                made = sorted((Shard(*r) for r in todo.mapInArrow(run, _SHARD).collect()), key=lambda s: s.path)
                gone = {s.path for g in groups for s in g}
                if sum(s.rows for s in made) != sum(s.rows for s in shards if s.path in gone):
                    raise RuntimeError("a merge lost rows")
                self._check(made)
                for k in range(RETRIES):
                    try:
                        self._replace(gone, made)
                        break
                    except CommitConflict:
                        time.sleep(0.01 * 2 ** min(k, 7))
                else:
                    raise CommitConflict(f"lost {RETRIES} times to other writers")

    def _replace(self, gone: set[str], made: list[Shard]) -> bool:
        """Commit ``made`` in place of ``gone``; False if some of those are no longer there."""
        base = self.latest()
        schema, names = self.segments(base)
        held = {n: self.segment(n) for n in names}
        if not gone <= {s.path for shards in held.values() for s in shards}:
            return False
        whole = [n for n, shards in held.items() if not any(s.path in gone for s in shards)]
        rest = [s for n, shards in held.items() if n not in whole for s in shards if s.path not in gone]
        self.commit(schema, whole + self._new_segment(rest + made), base)
        return True

    def vacuum(self, keep: int = 1, stale: float = STALE_INTENT) -> int:
        """Delete data files that none of the last ``keep`` versions names and no writer is at work on; how many went.

        The files are listed first, then the intents, then the versions: a file whose
        writer has committed in between is named by a version that is read after it.
        Readers of older versions than the kept ones may fail.
        """
        files = self.where.get_file_info(fs.FileSelector(f"{self.base}/data"))
        busy = set()
        for f in self.where.get_file_info(fs.FileSelector(f"{self.base}/intents")):
            if time.time() - f.mtime_ns / 1e9 < stale:
                busy.add(f.base_name)
            else:
                self.where.delete_file(f.path)
        live = {s.path.rpartition("/")[2] for v in self.versions()[-keep:] for s in self.manifest(v)[1]}
        dead = [f.path for f in files if f.base_name not in live and f.base_name.partition("-")[0] not in busy]
        for path in dead:
            self.where.delete_file(path)
        return len(dead)

    # --- reading ------------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of one version (the latest one)."""
        schema, shards = self.manifest(version)
        if schema is None:
            raise ValueError("the table has no version yet")
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(s.path for s in shards))


def op1_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard, compact and read back the whole table: every row with the digest of its text."""
    docs = table(spark, sf_dir, "documents")
    shards = ShardTable(spark, fresh_dir(spark, "shards"))
    shards.append(docs)
    shards.compact()
    return shards.read().select("doc_id", "lang", "source", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_compaction": op1_compaction}
SQL: dict[str, str] = {"op1_compaction": "SELECT doc_id, lang, source, n_chars, sha256(encode(text)) AS text_sha256 FROM documents"}
