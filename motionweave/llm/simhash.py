"""SimHash near-duplicates, joined exactly at four differing bits through Golay keys.

A fingerprint is cut into three segments of 22, 21 and 21 bits.  If two fingerprints
differ in at most four bits, the two segments with fewest errors have (0,0), (0,1),
(1,1) or (0,2) of them:

* at most one error in each of two segments: the codewords of one fingerprint are
  among the key pairs of the other (``pair`` keys, 24 bits);
* (0,2), and then the third segment has two as well: one segment is equal and the next
  one shares a key (``same`` keys, 33 bits).

So the keys lose no link.  Equal fingerprints are merged before the join.  Keys go to
the joining tasks in packed blocks, each candidate is verified by its differing bits,
and a task sends on a spanning forest of its links, never all pairs of a group: rows
stay proportional to the fingerprints.  Components come from the forests.

Null texts are empty; texts without words have fingerprint zero and are linked like
others.  Rows without an id take part, but only ids that are there can name a
component (null if there is none).  Repeated rows get equal results; an empty table gives
none.  Extra columns do not matter, but for the two names in ``_FP`` and ``_ROW``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motionweave.llm import golay
from motionweave.llm.common import column, materialise, record, slices, table, text_bytes
from motionweave.llm.components import connected, stars

WORDS, SEED, DISTANCE = 4, 42, 4
_SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Key rows that a joining task should get; they take 16 bytes each.
TASK_ROWS = 2_000_000
_BLOCK = 1 << 20
#: Columns that a row gets on its way; any other name is free for the table's own columns.
_FP, _ROW = "_simhash_fp", "_simhash_row"


def fingerprint(text: bytes) -> int:
    """64 bits; a bit is set if it is set in over half of the shingles' XXH64."""
    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - WORDS + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(WORDS, len(words)) - 1 :] - 1).tolist()
    count, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, n, 1 << 16):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[k : k + (1 << 16)], stops[k : k + (1 << 16)])], np.uint64)
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                fps = np.array([fingerprint(t) for t in text_bytes(column(batch, "text"))], np.uint64).view(np.int64)
                yield record(out, doc_id=column(batch, "doc_id").cast(pa.int64()), fp=fps)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def join_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, fingerprint, role) rows; role 0 is looked up, 1 looks up, 2 does both."""
    words = [(fps >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in _SEGMENTS]
    near, own = [golay.keys(w) for w in words], [golay.decode_table()[w].astype(np.int64) for w in words]
    key, fp, role = [], [], []
    for n, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        (a, am), (b, bm) = near[i], near[j]
        mask = am[:, :, None] & bm[:, None, :]
        at = np.nonzero(mask)[0]
        key += [n << 24 | own[i] << 12 | own[j], (n << 24 | a[:, :, None] << 12 | b[:, None, :])[mask]]
        fp += [fps, fps[at]]
        role += [np.zeros(len(fps), np.uint8), np.ones(len(at), np.uint8)]
    for i in range(3):
        b, bm = near[(i + 1) % 3]
        key.append(((4 + i) << 36 | words[i][:, None] << 12 | b)[bm])
        fp.append(fps[np.nonzero(bm)[0]])
        role.append(np.full(len(key[-1]), 2, np.uint8))
    return np.concatenate(key), np.concatenate(fp), np.concatenate(role)


def close_pairs(key: np.ndarray, fp: np.ndarray, role: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the rows of equal keys."""
    order = np.lexsort((role, key))
    key, fp, role = key[order], fp[order], role[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    stop = np.append(first[1:], len(key))
    asks = np.add.reduceat((role > 0).astype(np.int64), first) if len(first) else first
    kept = np.add.reduceat((role != 1).astype(np.int64), first) if len(first) else first
    # Rows of a group are ordered: looked up (0), looking up (1); or all of role 2.
    both = role[first] == 2 if len(first) else np.zeros(0, bool)
    ask_at, pairs = np.where(both, first, stop - asks), asks * kept
    links: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def found(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal held, links
        good = (np.bitwise_count(x ^ y) <= distance) & (x < y)
        if good.any():
            links.append((x[good], y[good]))
            held += int(good.sum())
            if held > _BLOCK:
                links = [stars(*map(np.concatenate, zip(*links)))]
                held = len(links[0][0])

    small = np.flatnonzero((pairs > 0) & (pairs <= 1 << 14))
    if len(small):
        sums = np.cumsum(pairs[small])
        cut = 0
        while cut < len(small):
            to = max(cut + 1, int(np.searchsorted(sums, (sums[cut - 1] if cut else 0) + _BLOCK, "right")))
            g = small[cut:to]
            n = pairs[g]
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            ask, hold = np.repeat(ask_at[g], n) + at // np.repeat(kept[g], n), np.repeat(first[g], n) + at % np.repeat(kept[g], n)
            x, y = fp[ask], fp[hold]
            found(np.minimum(x, y), np.maximum(x, y))
            cut = to
    # A large group is skipped once its members are connected, and else compared in blocks.
    joined: dict[int, int] = {}
    for g in np.flatnonzero(pairs > 1 << 14):
        a, b = fp[ask_at[g] : ask_at[g] + asks[g]], fp[first[g] : first[g] + kept[g]]
        members = np.unique(np.concatenate([a, b]))
        roots = {joined.get(m, m) for m in members.tolist()}
        if len(roots) == 1:
            continue
        here: list[tuple[np.ndarray, np.ndarray]] = []
        step = max(1, _BLOCK // len(b))
        for k in range(0, len(a), step):
            x, y = np.nonzero(np.bitwise_count(a[k : k + step, None] ^ b[None, :]) <= distance)
            x, y = a[k : k + step][x], b[y]
            far = x != y
            if far.any():
                here.append(stars(x[far], y[far]))
        if here:
            p, q = stars(*map(np.concatenate, zip(*here)))
            links.append((p, q))
            known = [(m, joined[m]) for m in members.tolist() if m in joined]
            if known:
                k, v = (np.array(c, np.uint64) for c in zip(*known))
                p, q = np.concatenate([p, k]), np.concatenate([q, v])
            node, root = stars(p, q)
            joined |= dict(zip(node.tolist(), root.tolist()))
            joined |= {r: r for r in set(root.tolist())}
    if not links:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return stars(*map(np.concatenate, zip(*links)))


def links(fps: DataFrame, n: int) -> DataFrame:
    """Edges (a, b) that connect the fingerprints (column fp, distinct) at most four bits apart."""
    parts = max(8, -(-n * 120 // TASK_ROWS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = column(batch, "fp").to_numpy().view(np.uint64)
            for k in range(0, len(values), 8192):
                key, fp, role = join_keys(values[k : k + 8192])
                part = (key * 0x9E3779B1 >> 13) % parts
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(cuts)):
                    at = order[cuts[p] : cuts[p + 1]]
                    blob = key[at].astype("<i8").tobytes() + fp[at].astype("<u8").tobytes() + role[at].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([blob], pa.binary())], names=["part", "blob"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, blob in zip(column(batch, "part").to_pylist(), column(batch, "blob").to_pylist()):
                rows.setdefault(part, []).append(blob)
        for part in list(rows):
            blobs = rows.pop(part)
            size = [len(b) // 17 for b in blobs]
            key = np.concatenate([np.frombuffer(b, "<i8", n) for b, n in zip(blobs, size)])
            fp = np.concatenate([np.frombuffer(b, "<u8", n, 8 * n) for b, n in zip(blobs, size)])
            role = np.concatenate([np.frombuffer(b, np.uint8, n, 16 * n) for b, n in zip(blobs, size)])
            a, b = close_pairs(key, fp, role)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return fps.select("fp").mapInArrow(pack, "part int, blob binary").repartition(parts, "part").mapInArrow(verify, "a long, b long")


def linked(groups: DataFrame) -> DataFrame:
    """``groups`` (fp, n, ...; one row per fingerprint) with ``root``, the smallest fingerprint of its component."""
    roots = connected(links(groups, groups.count()))
    return groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def components(fps: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of every row of ``fps`` (doc_id, fp)."""
    named = linked(materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "fingerprints"))
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"), F.sum("n").alias("rows")).filter("rows > 1")
    # Both are written first, so that each join has exchanges of its own and a large
    # component, or a frequent fingerprint, can be split.
    several = named.select("fp", "root").join(materialise(smallest, "components"), "root").select("fp", "component_id")
    several = materialise(several.withColumn("grouped", F.lit(True)), "groups")
    joined = fps.join(several, "fp", "left")
    return joined.select("doc_id", "fp", F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    found = components(materialise(fingerprints(docs), "simhash"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _with_fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with a last column for the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                fps = np.array([fingerprint(t) for t in text_bytes(column(batch, "text"))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps)], names=[*batch.schema.names, _FP])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(_FP, T.LongType())]))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id.

    Rows are judged by themselves and not by their ids, so rows that share an id and
    differ in text lose nothing.  Ids come before null; between rows of one id the smallest
    fingerprint stays, and between equal fingerprints the smallest hash of the text.
    """
    stamped = materialise(_with_fingerprints(docs).withColumn(_ROW, F.monotonically_increasing_id()), "stamped")
    rows = stamped.select(F.col(_FP).alias("fp"), F.col(_ROW).alias("row"), F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(_FP), F.xxhash64("text"), F.col(_ROW).alias("row")).alias("first"))
    groups = materialise(rows.groupBy("fp").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n")), "fingerprints")
    named = linked(groups)
    winners = named.groupBy("root").agg(F.min("first")["row"].alias("stays"), F.sum("n").alias("rows")).filter("rows > 1")
    several = named.select("fp", "root").join(materialise(winners, "components"), "root").select("fp", "stays")
    gone = rows.select("fp", "row").join(materialise(several, "groups"), "fp").filter("row <> stays").select(F.col("row").alias(_ROW))
    return stamped.join(materialise(gone, "gone"), _ROW, "left_anti").select(docs.columns)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_simhash": op4_simhash}
SQL: dict[str, str] = {}
