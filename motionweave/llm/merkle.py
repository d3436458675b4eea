"""Merkle manifest of a table: a root for each group, one over all groups, and every row's proof.

Leaves are digests of rows.  Within a group they ascend by the order columns; while a level has
several nodes, every ``FAN`` consecutive ones (the last run may be shorter, even one node)
become the digest of their hex digests.  The roots of the groups, in order of the group, are the
leaves of a tree of the same kind.

How Spark does it:

1. Leaves are range-sorted by (group, order, leaf, row) over partitions, so a frequent group or
   a repeated id is dealt over many of them.  Counts by (partition, group), summed up, give the
   offset of each group's part in a partition, hence every leaf's position.
2. A partition builds the complete aligned subtrees of its leaves, up to ``HEIGHT`` levels
   (``tops``).  What it can not complete, at most ``2 * (FAN - 1)`` nodes a level, is shuffled by
   the coordinate (group, ancestor at the next multiple of ``HEIGHT`` levels) and finished there;
   higher levels follow in the same way, ``HEIGHT`` levels a shuffle.
3. Proofs come down: the upper part of a proof is joined to each of these nodes only, and the
   sorted leaves get the rest from their own partition's subtrees.

A task holds one range partition of leaves (digests, no texts) or at most ``FAN ** HEIGHT``
nodes.  The driver sees the number of leaves and the height.

Missing groups and order values come first.  Equal order values are ordered by leaf, equal
leaves by their row's number when they were written, which changes no digest.  An empty table
has no root and gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motionweave.llm.common import crc_mod, materialise, table

FAN, HEIGHT = 8, 5
#: Leaves that a range partition should have.
PART = 100_000
#: Rows of proofs in one Arrow batch.
_ROWS = 4096
_STEPS = "array<struct<left:string,right:string>>"
_STEP = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_UPPER = "abcdefghijklmnopqrstuvwxyz".upper()


def digest(*columns: Column) -> Column:
    """SHA-256 of a row's values: ``-`` if missing, else byte count, ``:`` and value."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]), 256)


def _hash(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _size(total: int, level: int) -> int:
    """Nodes of a level over ``total`` leaves."""
    for _ in range(level):
        total = -(-total // FAN)
    return total


def _height(total: int) -> int:
    h = 0
    while total > 1:
        total, h = -(-total // FAN), h + 1
    return h


def subtrees(first: int, leaves: list[str], total: int, top: int) -> list[tuple[int, list[str]]]:
    """Complete nodes over leaves ``first`` and following: per level up to ``top``, the first index and the digests."""
    levels = [(first, leaves)]
    top = min(top, _height(total))
    while len(levels) <= top:
        at, nodes = levels[-1]
        size = _size(total, len(levels) - 1)
        begin = -(-at // FAN)
        stop = -(-size // FAN) if at + len(nodes) == size else (at + len(nodes)) // FAN
        if begin >= stop:
            break
        levels.append((begin, [_hash(nodes[max(0, FAN * i - at) : FAN * i + FAN - at]) for i in range(begin, stop)]))
    return levels


def ragged(levels: list[tuple[int, list[str]]]) -> Iterator[tuple[int, int, str]]:
    """(level, index, digest) of the nodes that have no complete parent."""
    for level, (at, nodes) in enumerate(levels):
        begin, stop = (levels[level + 1][0] * FAN, (levels[level + 1][0] + len(levels[level + 1][1])) * FAN) if level + 1 < len(levels) else (at, at)
        for k, node in enumerate(nodes):
            if not begin <= at + k < stop:
                yield level, at + k, node


def finish(nodes: dict[tuple[int, int], str], top: int) -> tuple[dict[tuple[int, int], str], dict[tuple[int, int], list[dict[str, str]]]]:
    """All nodes up to level ``top`` over given ones that cover whole runs, and the steps of each given one up to there."""
    known = dict(nodes)
    for level in range(min(k for k, _ in nodes), top):
        for parent in {i // FAN for k, i in known if k == level}:
            run = [known[level, i] for i in range(FAN * parent, FAN * parent + FAN) if (level, i) in known]
            known[level + 1, parent] = _hash(run)
    steps = {}
    for level, i in nodes:
        own, at = [], i
        for k in range(level, top):
            run = range(at // FAN * FAN, at // FAN * FAN + FAN)
            own.append({"left": "".join(known[k, j] for j in run if j < at), "right": "".join(known[k, j] for j in run if j > at and (k, j) in known)})
            at //= FAN
        steps[level, i] = own
    return known, steps


@dataclass
class Forest:
    """Trees of all groups.

    ``leaves``: the sorted leaves with their part.  ``rounds``: tables of nodes (g, level, idx,
    parent, steps to the parent), the lowest first; those of the first have their part, offset
    and total.  ``roots``: g, hash, total and ``level``, the height.
    """

    leaves: DataFrame
    rounds: list[DataFrame]
    roots: DataFrame


def _sorted_parts(leaves: DataFrame, order: list[str], part: int) -> DataFrame:
    """Leaves with the number of their range partition and their place in it."""
    leaves = materialise(leaves.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    parts = max(leaves.sparkSession.sparkContext.defaultParallelism, -(-leaves.count() // part))
    by = [F.col(c).asc_nulls_first() for c in ("g", *order, "leaf", "row")]
    dealt = leaves.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return materialise(dealt.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "merkle-sorted")


def _spans(leaves: DataFrame) -> DataFrame:
    """part, g, size, offset of the group's leaves in a part, and the group's total."""
    counts = materialise(leaves.groupBy("part", "g").agg(F.count(F.lit(1)).alias("size")), "merkle-counts")
    w = Window.partitionBy("g")
    return counts.withColumns({"offset": F.sum("size").over(w.orderBy("part")) - F.col("size"), "total": F.sum("size").over(w)})


def _parts_of(t: pa.Table) -> Iterator[tuple[int, int]]:
    """Runs of rows of one group in a sorted table."""
    groups, start = t["g"].to_pylist(), 0
    for k in range(1, len(groups) + 1):
        if k == len(groups) or groups[k] != groups[start]:
            yield start, k
            start = k


def _tops(leaves: DataFrame, spans: DataFrame, height: int) -> DataFrame:
    """The nodes that every part can complete and whose parents it can not."""
    g = leaves.schema["g"].dataType.simpleString()
    names = ["part", "g", "offset", "total", "level", "idx", "hash"]

    def build(own: pa.Table, span: pa.Table) -> pa.Table:
        out = {c: [] for c in names}
        own = own.sort_by("place")
        where = {r["g"]: r for r in span.to_pylist()}
        for a, b in _parts_of(own):
            r = where[own["g"][a].as_py()]
            for level, i, node in ragged(subtrees(r["offset"], own["leaf"][a:b].to_pylist(), r["total"], height)):
                for c, v in zip(names, (r["part"], r["g"], r["offset"], r["total"], level, i, node)):
                    out[c].append(v)
        types = [pa.int32(), own.schema.field("g").type, pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
        return pa.table([pa.array(out[c], t) for c, t in zip(names, types)], names=names)

    pair = leaves.select("part", "g", "leaf", "place").groupBy("part").cogroup(spans.select("part", "g", "offset", "total").groupBy("part"))
    return pair.applyInArrow(build, f"part int, g {g}, offset long, total long, level int, idx long, hash string")


def _climb(nodes: DataFrame, top: int, height: int) -> DataFrame:
    """Every node with the digest and index of its ancestor at level ``top`` (or its root) and its steps there."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema) + f", top int, parent long, parent_hash string, steps {_STEPS}"
    coordinate = F.call_function("shiftright", F.col("idx"), 3 * (F.lit(top) - F.col("level")))

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).drop_columns("_at")
        level, idx, total = t["level"].to_pylist(), t["idx"].to_pylist(), t["total"][0].as_py()
        to = min(top, _height(total))
        known, steps = finish(dict(zip(zip(level, idx), t["hash"].to_pylist())), to)
        parent = [i // FAN ** (to - k) for k, i in zip(level, idx)]
        more = [pa.array([to] * len(idx), pa.int32()), pa.array(parent, pa.int64()), pa.array([known[to, p] for p in parent], pa.string()), pa.array([steps[k] for k in zip(level, idx)], _STEP)]
        whole = pa.table([*t.columns, *more], names=[*t.column_names, "top", "parent", "parent_hash", "steps"])
        yield from whole.to_batches(_ROWS)

    return nodes.withColumn("_at", coordinate).groupBy("g", "_at").applyInArrow(up, schema)


def build(leaves: DataFrame, order: list[str], part: int = PART, height: int = HEIGHT) -> Forest:
    """Trees over rows (g, the order columns, leaf); other columns are kept with the leaves."""
    if FAN != 8:
        raise ValueError("coordinates are shifted by three bits a level")
    leaves = _sorted_parts(leaves, order, part)
    spans = materialise(_spans(leaves), "merkle-spans")
    highest = _height(spans.agg(F.max("total")).first()[0] or 0)
    nodes, rounds = _tops(leaves, spans, height), []
    for top in range(height, max(highest, 1) + height, height):
        climbed = materialise(_climb(nodes, top, height), "merkle-nodes")
        rounds.append(climbed)
        nodes = climbed.select("g", "total", F.col("top").alias("level"), F.col("parent").alias("idx"), F.col("parent_hash").alias("hash")).distinct()
    return Forest(leaves, rounds, nodes.select("g", "hash", "level", "total"))


def proofs(forest: Forest, upper: DataFrame | None = None) -> DataFrame:
    """The leaves with position, subroot and steps, the siblings' digests left and right, level by level.

    ``upper`` gives further steps and a root per group, as columns g, upper and root.
    """
    ends = forest.roots.select("g", F.col("hash").alias("subroot"))
    if upper is None:
        ends = ends.withColumns({"upper": F.array().cast(_STEPS), "root": F.col("subroot")})
    else:
        ends = _null_safe(ends, upper.select("g", "upper", "root"), [])
    tails = ends.withColumn("idx", F.lit(0).cast("long"))
    for k, nodes in reversed(list(enumerate(forest.rounds))):
        above = tails.withColumnRenamed("idx", "parent")
        extra = ["part", "offset", "total"] if k == 0 else []
        joined = _null_safe(nodes.select("g", "level", "idx", "parent", "steps", *extra), above, ["parent"])
        joined = joined.withColumn("upper", F.concat("steps", "upper")).drop("steps", "parent")
        tails = materialise(joined if k == 0 else joined.drop("level"), "merkle-tails")
    return _down(forest.leaves, tails)


def _null_safe(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on the group, missing or not, and other columns."""
    b = b.withColumnsRenamed({c: f"_{c}" for c in ("g", *on)})
    match = F.col("g").eqNullSafe(F.col("_g"))
    for c in on:
        match = match & (F.col(c) == F.col(f"_{c}"))
    return a.join(b, match).drop("_g", *[f"_{c}" for c in on])


def _down(leaves: DataFrame, tails: DataFrame) -> DataFrame:
    """Proofs of the sorted leaves, each part with its own nodes' upper steps."""
    keep = [f for f in leaves.schema if f.name not in ("row", "part", "place")]
    known = ["level", "idx", "offset", "total", "upper", "subroot", "root"]
    # One table for both, so that a part streams out in batches; each kind has the other's columns empty.
    a = leaves.select("part", "place", *[f.name for f in keep], *[F.lit(None).cast(tails.schema[c].dataType).alias(c) for c in known])
    b = tails.select("part", F.lit(None).cast("long").alias("place"), *[F.col("g") if f.name == "g" else F.lit(None).cast(f.dataType).alias(f.name) for f in keep], *known)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep) + f", position long, subroot string, root string, steps {_STEPS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        is_leaf = t["place"].is_valid()
        own = t.filter(is_leaf).sort_by("place")
        above: dict = {}
        for r in t.filter(t["place"].is_null()).select(["g", *known]).to_pylist():
            above.setdefault(r["g"], {})[r["level"], r["idx"]] = r
        for a, b in _parts_of(own):
            mine = above[own["g"][a].as_py()]
            r = next(iter(mine.values()))
            offset, digests = r["offset"], own["leaf"][a:b].to_pylist()
            levels = subtrees(offset, digests, r["total"], max(level for level, _ in mine))
            for at in range(a, b, _ROWS):
                rows = own.slice(at, min(_ROWS, b - at))
                steps = [_steps(offset + at - a + k, levels, mine) for k in range(rows.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [*[rows[f.name].combine_chunks() for f in keep], pa.array(range(offset + at - a, offset + at - a + rows.num_rows), pa.int64()), pa.array([r["subroot"]] * rows.num_rows, pa.string()), pa.array([r["root"]] * rows.num_rows, pa.string()), pa.array(steps, _STEP)],
                    names=[*[f.name for f in keep], "position", "subroot", "root", "steps"],
                )

    return a.unionByName(b).groupBy("part").applyInArrow(run, schema)


def _steps(i: int, levels: list[tuple[int, list[str]]], above: dict) -> list[dict[str, str]]:
    """Steps of leaf ``i``: within the part's complete subtrees up to a node that ``above`` has, then that node's."""
    out, level = [], 0
    while (level, i) not in above:
        at, nodes = levels[level]
        run = i // FAN * FAN - at
        out.append({"left": "".join(nodes[run : i - at]), "right": "".join(nodes[i - at + 1 : run + FAN])})
        i, level = i // FAN, level + 1
    return out + above[level, i]["upper"]


def fold(leaf: str | Column, steps: str | Column) -> Column:
    """The root that a leaf and its proof lead to."""
    leaf = F.col(leaf) if isinstance(leaf, str) else leaf
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def manifest(rows: DataFrame, order: list[str], part: int = PART, height: int = HEIGHT) -> DataFrame:
    """Rows (g, order columns, leaf, ...) with position, subroot, root and steps from the leaf to the root."""
    forest = build(rows, order, part, height)
    top = build(forest.roots.select(F.lit(0).alias("g"), F.col("g").alias("member"), F.col("hash").alias("leaf")), ["member"], part, height)
    upper = proofs(top).select(F.col("member").alias("g"), F.col("steps").alias("upper"), "root")
    return proofs(forest, materialise(upper, "merkle-upper"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    fields = lambda text: digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    tampered = F.when(crc_mod("doc_id", 3) == 0, fields(F.translate("text", _UPPER, _UPPER.lower())))
    leaves = docs.select(F.col("lang").alias("g"), "doc_id", fields(F.col("text")).alias("leaf"), tampered.alias("tampered"))
    done = manifest(leaves, ["doc_id"])
    siblings = F.aggregate("steps", F.lit(""), lambda s, x: F.concat(s, x["left"], x["right"]))
    folded = fold(F.coalesce("tampered", "leaf"), "steps")
    out = done.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op13_merkle": op13_merkle}
SQL: dict[str, str] = {}
