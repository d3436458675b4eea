"""Graph analytics on edge tables (keys, i < j, w); a graph is one value of ``keys``.

Graphs are small (at most some hundred nodes) and many: everything is partitioned by the
graph's key, and per-graph algorithms run on arrays inside one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionweave.functions import kernels
from motionweave.operators.matrix import both_ways, key_schema


def shifted(edges: DataFrame, keys: list[str], bound: float | None = None) -> DataFrame:
    """Weights moved up so that the smallest cell is zero (the diagonal is 1), then bounded."""
    low = F.least(F.min("w").over(Window.partitionBy(*keys)), F.lit(1.0))
    out = edges.withColumn("w", F.col("w") + F.greatest(-low, F.lit(0.0))).filter("w is not null")
    return out if bound is None else out.filter(F.col("w") >= bound)


def nodes_of(graphs: DataFrame, keys: list[str], n: int) -> DataFrame:
    return graphs.select(*keys).distinct().withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def weighted_degree(edges: DataFrame, keys: list[str], nodes: DataFrame) -> DataFrame:
    """Sum of incident weights; isolated nodes have 0."""
    sums = both_ways(edges, keys, "w").groupBy(*keys, "node").agg(F.sum("w").alias("degree"))
    return nodes.join(sums, [*keys, "node"], "left").withColumn("degree", F.coalesce("degree", F.lit(0.0)))


def at_thresholds(edges: DataFrame, thresholds: list[float]) -> DataFrame:
    """The edges that reach each threshold (a narrow expansion, no join)."""
    return edges.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).filter(F.col("w") >= F.col("threshold"))


def clustering(edges: DataFrame, keys: list[str], nodes: DataFrame) -> DataFrame:
    """Local clustering coefficient 2T / k(k-1), 0 below two neighbours.

    Neighbour sets are gathered once per node; a triangle is an edge's common neighbours.
    """
    sets = both_ways(edges, keys, "w").groupBy(*keys, "node").agg(F.collect_set("other").alias("near"))
    a = sets.select(*keys, F.col("node").alias("i"), F.col("near").alias("_a"))
    b = sets.select(*keys, F.col("node").alias("j"), F.col("near").alias("_b"))
    common = edges.join(a, [*keys, "i"]).join(b, [*keys, "j"]).withColumn("t", F.size(F.array_intersect("_a", "_b")))
    twice = both_ways(common, keys, "t").groupBy(*keys, "node").agg(F.sum("t").alias("t2"))
    k = F.coalesce(F.size("near"), F.lit(0))
    joined = nodes.join(sets, [*keys, "node"], "left").join(twice, [*keys, "node"], "left")
    return joined.select(*keys, "node", F.when(k >= 2, F.coalesce("t2", F.lit(0)) / (k * (k - 1)).cast("double")).otherwise(F.lit(0.0)).alias("coefficient"))


def components(edges: DataFrame, keys: list[str], n: int, thresholds: list[float] | None = None) -> DataFrame:
    """(keys[, threshold], node, component) with the smallest node as label; isolated nodes stand alone.

    A graph's edges are gathered once; each threshold filters that array, and each edge
    merges two labels in an array of n, so one pass over the edges is exact.  No join, and
    no row per edge and threshold.
    """
    cells = F.collect_list(F.struct(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "w"))
    packed = edges.groupBy(*keys).agg(cells.alias("_e"))
    linked, out = F.col("_e"), list(keys)
    if thresholds is not None:
        packed, out = packed.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))), [*keys, "threshold"]
        linked = F.filter("_e", lambda e: e["w"] >= F.col("threshold"))

    def merge(labels: Column, e: Column) -> Column:
        a, b = F.get(labels, e["i"]), F.get(labels, e["j"])
        return F.transform(labels, lambda x: F.when(x == F.greatest(a, b), F.least(a, b)).otherwise(x))

    labels = F.aggregate(linked, F.sequence(F.lit(0), F.lit(n - 1)), merge)
    return packed.select(*out, F.posexplode(labels).alias("node", "component"))


def component_sizes(members: DataFrame, keys: list[str]) -> DataFrame:
    """Number of components and size of the largest one."""
    sizes = members.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("components"), F.max("size").alias("largest"))


def allegiance(memberships: DataFrame, keys: list[str], run: str, n: int) -> DataFrame:
    """Share of partitions in which i < j are together; ``memberships`` has community per node.

    A partition's communities are one array, expanded into pairs inside the row.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col("node").cast("int").alias("node"), "community")))
    whole = memberships.groupBy(*keys, run).agg(F.transform(rows, lambda r: r["community"]).alias("_c"))
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(n) for j in range(i + 1, n)])
    flat = whole.select(*keys, "_c", F.explode(pairs).alias("_p"))
    same = (F.get("_c", F.col("_p.i")) == F.get("_c", F.col("_p.j"))).cast("int")
    return flat.groupBy(*keys, F.col("_p.i").alias("i"), F.col("_p.j").alias("j")).agg(F.avg(same).alias("w"))


def group_allegiance(own: DataFrame, keys: list[str], group: list[str], n: int) -> DataFrame:
    """Mean and deviation of the subjects' allegiance; matrices that lack cells or have no value are left out."""
    w = Window.partitionBy(*keys)
    valid = own.withColumns({"_n": F.count(F.lit(1)).over(w), "_v": F.count("w").over(w)}).filter((F.col("_n") == n * (n - 1) // 2) & (F.col("_v") > 0))
    return valid.groupBy(*group, "i", "j").agg(F.avg("w").alias("w"), F.stddev_pop("w").alias("std"))


#: Louvain runs of a graph that one task makes.
RUN_BLOCK = 25


def louvain_memberships(edges: DataFrame, keys: list[str], n: int, runs: int) -> DataFrame:
    """(keys, run, node, community) of seeded Louvain runs: seeds come from the graph's key and the run.

    A graph's runs are dealt over tasks in blocks, so few graphs use many tasks as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        w = np.zeros((n, n))
        i, j = t["i"].to_numpy(), t["j"].to_numpy()
        w[i, j] = w[j, i] = np.nan_to_num(t["w"].to_numpy(zero_copy_only=False).astype(float))
        block = t["_block"][0].as_py() * RUN_BLOCK
        mine = range(block, min(runs, block + RUN_BLOCK))
        out = [kernels.louvain(w, np.random.default_rng([t["_seed"][0].as_py() & (1 << 63) - 1, k])) for k in mine]
        size = len(mine) * n
        yield pa.RecordBatch.from_arrays(
            [pa.array([t[k][0].as_py()] * size, t[k].type) for k in keys]
            + [pa.array(np.repeat(np.array(mine), n)), pa.array(np.tile(np.arange(n), len(mine))), pa.array(np.concatenate(out).astype(np.int64))],
            names=[*keys, "run", "node", "community"],
        )

    block = F.explode(F.sequence(F.lit(0), F.lit((runs - 1) // RUN_BLOCK))).alias("_block")
    seeded = edges.withColumn("_seed", F.xxhash64(*keys)).select(*keys, "_seed", "i", "j", "w", block)
    return seeded.groupBy(*keys, "_block").applyInArrow(run, key_schema(edges, keys) + ", run long, node long, community long")


def modularity(edges: DataFrame, members: DataFrame, keys: list[str], self_loop: float = 1.0, alone: bool = False) -> DataFrame:
    """Newman modularity; a self-loop counts once in a community's weight and twice in degrees.

    NULL where all nodes are one community, unless ``alone`` asks for that score too.
    """
    a = members.select(*keys, F.col("node").alias("i"), F.col("community").alias("_a"))
    b = members.select(*keys, F.col("node").alias("j"), F.col("community").alias("_b"))
    ends = edges.join(a, [*keys, "i"]).join(b, [*keys, "j"])
    side = F.explode(F.array(F.struct(F.col("_a").alias("c"), F.col("_b").alias("o")), F.struct(F.col("_b").alias("c"), F.col("_a").alias("o"))))
    flat = ends.select(*keys, "w", side.alias("s")).groupBy(*keys, F.col("s.c").alias("community"))
    sums = flat.agg(F.sum("w").alias("degree"), (F.sum(F.when(F.col("s.c") == F.col("s.o"), F.col("w")).otherwise(0.0)) / 2).alias("inside"))
    size = members.groupBy(*keys, "community").agg(F.count(F.lit(1)).alias("size"))
    all_ = size.join(sums, [*keys, "community"], "left").fillna(0.0, ["degree", "inside"])
    all_ = all_.withColumns({"degree": F.col("degree") + 2 * self_loop * F.col("size"), "inside": F.col("inside") + self_loop * F.col("size")})
    m = F.sum("degree").over(Window.partitionBy(*keys)) / 2
    term = F.col("inside") / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), 2)
    return all_.withColumn("m", m).groupBy(*keys).agg(F.when((F.count(F.lit(1)) > 1) | F.lit(alone), F.sum(term)).alias("modularity"), F.count(F.lit(1)).alias("communities"))


def community_density(edges: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Mean weight inside each community; 0 for a single node."""
    a = members.select(*keys, F.col("node").alias("i"), "community")
    b = members.select(*keys, F.col("node").alias("j"), "community")
    inside = edges.join(a, [*keys, "i"]).join(b, [*keys, "j", "community"]).groupBy(*keys, "community").agg(F.avg("w").alias("density"))
    every = members.groupBy(*keys, "community").agg(F.count(F.lit(1)).alias("size"))
    return every.join(inside, [*keys, "community"], "left").withColumn("density", F.coalesce("density", F.lit(0.0)))


def adjusted_rand(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Adjusted Rand index of two labelings of the same nodes; 1 if it is not defined.

    The pairs within a row total n_a are the sum of n (n_a - 1) / 2 over its cells, so the
    contingency table is read once, with windows instead of joins.
    """
    cell = pairs.groupBy(*keys, a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = lambda *c: F.sum("n").over(Window.partitionBy(*keys, *c))
    cell = cell.withColumns({"_a": total(a), "_b": total(b)})
    two = lambda m: F.sum(F.col("n") * (F.col(m) - 1) / 2)
    both = cell.groupBy(*keys).agg(two("n").alias("index"), two("_a").alias("ra"), two("_b").alias("rb"), F.sum("n").alias("total"))
    expected = F.try_divide(F.col("ra") * F.col("rb"), F.nullif(F.col("total") * (F.col("total") - 1) / 2, F.lit(0.0)))
    most = (F.col("ra") + F.col("rb")) / 2
    return both.select(*keys, F.coalesce(F.try_divide(F.col("index") - expected, F.nullif(most - expected, F.lit(0.0))), F.lit(1.0)).alias("ari"))


def jaccard(sets: DataFrame, a: str, b: str) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))
