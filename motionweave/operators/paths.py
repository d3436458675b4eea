"""Subgraphs, greedy paths and path patterns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def induced(edges: DataFrame, chosen: list[int]) -> DataFrame:
    """Edges with both ends among the chosen nodes."""
    return edges.filter(F.col("i").isin(chosen) & F.col("j").isin(chosen))


def steps_of(paths: DataFrame, path: str, closed: bool = False) -> DataFrame:
    """One row per step of a path: step, u, v (and the closing one for a cycle)."""
    whole = F.concat(path, F.slice(path, 1, 1)) if closed else F.col(path)
    u = paths.withColumn("_w", whole).select("*", F.posexplode(F.slice("_w", 1, F.size("_w") - 1)).alias("step", "u"))
    return u.withColumn("v", F.get("_w", F.col("step") + 1)).drop("_w")


def along(edges: DataFrame, steps: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Weights of the steps that are edges (or NULL for the others, with ``how='left'``)."""
    low, high = F.least("u", "v").alias("i"), F.greatest("u", "v").alias("j")
    return steps.select("*", low, high).join(edges.select(*keys, "i", "j", "w"), [*keys, "i", "j"], how)


def dense(edges: DataFrame, keys: list[str], n: int, directed: bool = False) -> DataFrame:
    """(keys, matrix): weights as array of arrays, NULL where there is no edge."""
    cell = F.struct((F.col("i") * n + F.col("j")).cast("int").alias("k"), "w")
    back = F.struct((F.col("j") * n + F.col("i")).cast("int").alias("k"), "w")
    rows = edges.select(*keys, F.explode(F.array(cell) if directed else F.array(cell, back)).alias("c"))
    packed = rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list("c")).alias("m"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda a: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.try_element_at("m", a * n + b)))
    return packed.select(*keys, grid.alias("matrix"))


def greedy(start: Column, length: int, strongest: bool = True) -> Column:
    """The greedy path of up to ``length`` nodes: next is the unvisited neighbour with the largest
    absolute (or the smallest) weight, ties to the smallest node.  A shorter path is a prefix.

    Reads the column ``matrix`` of :func:`dense`."""
    def step(path: Column, _: Column) -> Column:
        row = F.get("matrix", F.element_at(path, -1))
        if strongest:
            options = F.transform(row, lambda w, k: F.when(w.isNotNull() & ~F.array_contains(path, k), F.struct(F.round(F.abs(w), 9).alias("w"), (-k).alias("k"))))
            best = -F.array_max(options)["k"]
        else:
            options = F.transform(row, lambda w, k: F.when(w.isNotNull() & ~F.array_contains(path, k), F.struct(F.round(w, 9).alias("w"), k.alias("k"))))
            best = F.array_min(options)["k"]
        return F.when(best.isNotNull(), F.concat(path, F.array(best))).otherwise(path)

    return F.aggregate(F.sequence(F.lit(2), F.lit(length)), F.array(start.cast("int")), step)


def group_pattern(paths: DataFrame, edges: DataFrame, keys: list[str], group: list[str], n: int, start: int, length: int) -> DataFrame:
    """Per group: mean weight of each directed step over all members' paths, then a greedy walk.

    Where no step of the group's paths touches ``start``, the walk begins at the smallest node that one touches.
    """
    steps = along(edges, steps_of(paths, "path"), keys)
    mean = steps.groupBy(*group, F.col("u").alias("i"), F.col("v").alias("j")).agg(F.avg("w").alias("w"))
    whole = dense(mean, group, n, directed=True)
    touched = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.exists(F.get("matrix", k), lambda w: w.isNotNull()) | F.exists("matrix", lambda row: F.get(row, k).isNotNull()))
    whole = whole.withColumn("_t", touched)
    begin = F.when(F.get("_t", F.lit(start)), F.lit(start)).otherwise(F.array_position("_t", True) - 1)
    return whole.select(*group, greedy(begin, length).alias("pattern"))


def score_patterns(patterns: DataFrame, edges: DataFrame, pattern_keys: list[str], graph_keys: list[str], on: list[str] = []) -> DataFrame:
    """Sum of a pattern's weights in every graph (NULL if an edge is missing) and its weakest link.

    With ``on``, graph keys that patterns have as well, a pattern is scored in the graphs that share them.
    """
    steps = steps_of(patterns, "pattern").select(*on, *pattern_keys, "step", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.size("pattern").alias("_n"))
    low, high = F.least("u", "v").alias("i"), F.greatest("u", "v").alias("j")
    joined = edges.join(steps.select(*on, *pattern_keys, "step", "u", "v", "_n", low, high), [*on, "i", "j"])
    link = F.concat_ws("-", F.col("u").cast("string"), F.col("v").cast("string"))
    scored = joined.groupBy(*pattern_keys, *graph_keys, "_n").agg(
        F.sum("w").alias("_s"), F.count("w").alias("_c"), F.min_by(link, F.struct(F.round("w", 9), "step")).alias("weakest_link")
    )
    return scored.select(*pattern_keys, *graph_keys, F.when(F.col("_c") == F.col("_n") - 1, F.col("_s")).alias("path_sum"), "weakest_link")


def most_frequent(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mode per key, ties to the smallest value."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), value)
    return counts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


#: Steps of the greedy walk that gives the search a length to beat, for each start.
WALK_STEPS = 400
#: Ends of the search, (node, nodes within reach), that it remembers not to enter again.
KNOWN_ENDS = 2_000_000


def _bits(s: int) -> Iterator[int]:
    while s:
        low = s & -s
        yield low.bit_length() - 1
        s ^= low


def _reached(near: list[int], at: int, free: int) -> int:
    """Free nodes that a walk from ``at`` can come to."""
    found = front = near[at] & free
    while front:
        more = 0
        for k in _bits(front):
            more |= near[k]
        front = more & free & ~found
        found |= front
    return found


def _reach_bound(near: list[int], at: int, free: int) -> int:
    """No simple path from ``at`` takes more of the free nodes than this.

    A path leaves a block (a part without cut nodes) once, by a cut node, so it follows one chain
    of the block-cut tree that hangs on ``at``: the heaviest chain of nodes is the bound.  It is
    exact on trees.
    """
    number, low, best = {at: 0}, {at: 0}, {at: 0}
    stack, path = [], [(at, near[at] & free)]
    while path:
        v, left = path[-1]
        if left:
            k = (left & -left).bit_length() - 1
            path[-1] = (v, left & (left - 1))
            if k in number:
                low[v] = min(low[v], number[k])
                continue
            number[k] = low[k] = len(number)
            best[k] = 0
            stack.append(k)
            path.append((k, near[k] & (free | 1 << at) & ~(1 << v)))
            continue
        path.pop()
        if not path:
            break
        u = path[-1][0]
        low[u] = min(low[u], low[v])
        if low[v] >= number[u]:  # u cuts off a block
            size = below = 0
            while True:
                k = stack.pop()
                size, below = size + 1, max(below, best[k])
                if k == v:
                    break
            best[u] = max(best[u], size + below)
    return best[at]


def _greedy_length(near: list[int], start: int, every: int) -> int:
    """Nodes on the longest path that a walk towards nodes of few free neighbours finds within ``WALK_STEPS``."""
    order = lambda v, free: sorted(_bits(near[v] & free), key=lambda k: (near[k] & free).bit_count(), reverse=True)
    free = every & ~(1 << start)
    path, left, longest = [start], [order(start, free)], 1
    for _ in range(WALK_STEPS):
        if not path or not free:
            break
        if left[-1]:
            k = left[-1].pop()
            free &= ~(1 << k)
            path.append(k)
            left.append(order(k, free))
            longest = max(longest, len(path))
        else:
            free |= 1 << path.pop()
            left.pop()
    return longest


def longest_in(near: dict[int, list[int]]) -> list[int]:
    """Longest simple path of a connected graph (sorted neighbours by node); the first by node order on a tie.

    Branch and bound in node order: a partial path is left as soon as the block-cut tree of what
    it can still reach says that no longer path follows from it, or if the search came to the same
    node with the same nodes in reach before and got no further.  Greedy walks give the length to
    beat beforehand, and a path over all nodes ends the search.  Exact at any size; a graph
    that is neither nearly a tree nor dense may take long, as the problem is NP-hard.
    """
    nodes = sorted(near)
    place = {v: k for k, v in enumerate(nodes)}
    masks = [sum(1 << place[x] for x in near[v]) for v in nodes]
    n, every = len(nodes), (1 << len(nodes)) - 1
    target = 0
    for start in sorted(range(n), key=lambda k: masks[k].bit_count()):
        target = max(target, _greedy_length(masks, start, every))
        if target == n:
            break
    best: list[int] = []
    wanted = target  # a path of so many nodes is known to be there
    known: dict[tuple[int, int], int] = {}  # nodes that may follow on an end at most
    for start in range(n):
        path, left, free = [], [1 << start], every
        ends: list[tuple[int, int]] = []
        while left:
            if left[-1]:
                k = (left[-1] & -left[-1]).bit_length() - 1
                left[-1] &= left[-1] - 1
                free &= ~(1 << k)
                path.append(k)
                if len(path) >= wanted:
                    best, wanted = list(path), len(path) + 1
                    if len(best) == n:
                        return [nodes[k] for k in best]
                reached = _reached(masks, k, free)
                ends.append((k, reached))
                more = min(reached.bit_count(), known.get(ends[-1], n))
                if len(path) + more >= wanted:
                    more = _reach_bound(masks, k, reached)
                left.append(masks[k] & free if len(path) + more >= wanted else 0)
            else:
                left.pop()
                if path:
                    if len(known) < KNOWN_ENDS:
                        known[ends[-1]] = min(known.get(ends[-1], n), wanted - 1 - len(path))
                    ends.pop()
                    free |= 1 << path.pop()
    return [nodes[k] for k in best]


def longest_path_exact(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Longest simple path of whole graphs, dense or sparse; the first one by node order on a tie."""
    head = ", ".join(f"{k} {edges.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        near: dict[int, set[int]] = {}
        for a, b in zip(t["i"].to_pylist(), t["j"].to_pylist()):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        found, seen = [], set()
        for v in near:
            if v in seen:
                continue
            part, todo = {v}, [v]
            while todo:
                fresh = near[todo.pop()] - part
                part |= fresh
                todo += fresh
            seen |= part
            found.append(longest_in({k: sorted(near[k]) for k in part}))
        best = min(found, key=lambda p: (-len(p), p))
        yield pa.RecordBatch.from_arrays([pa.array([t[k][0].as_py()], t[k].type) for k in keys] + [pa.array([best], pa.list_(pa.int64()))], names=[*keys, "path"])

    return edges.select(*keys, "i", "j").groupBy(*keys).applyInArrow(run, f"{head}, path array<bigint>")


def linear_layout(nodes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Positions (t, 1 - t) along a diagonal, by rank."""
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy(order)) - 1
    t = F.coalesce(rank / F.nullif(F.count(F.lit(1)).over(w) - 1, F.lit(0)), F.lit(0.0))
    return nodes.withColumn("x", t).withColumn("y", 1 - F.col("x"))
