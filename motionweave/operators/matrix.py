"""Association matrices as edge tables (i < j), and their algebra.

A sample is a row with an array of channel values.  A group's samples stream through a
kernel that holds pairwise sums, so building a matrix shuffles the samples once and no pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionweave.functions import kernels
from motionweave.functions.core import poisoned_avg, poisoned_std

#: Samples up to which distance correlations come from distance matrices (in blocks); beyond, from sorted sums.
SMALL = 256


class _Moments:
    """Running pairwise moments of channels around a shift, over batches of samples with gaps."""

    def __init__(self, k: int) -> None:
        self.shift = np.full(k, np.nan)
        self.sums = np.zeros((4, k, k))  # of pairs: how many, x, x squared, x times y

    def add(self, x: np.ndarray) -> None:
        for c in np.flatnonzero(np.isnan(self.shift) & ~np.isnan(x).all(0)):
            self.shift[c] = x[~np.isnan(x[:, c]), c][0]
        there = ~np.isnan(x)
        d, w = np.where(there, x - self.shift, 0.0), there.astype(float)
        self.sums += np.stack([w.T @ w, d.T @ w, (d * d).T @ w, d.T @ d])

    def merge(self, shift: np.ndarray, sums: np.ndarray) -> None:
        """Add moments that were taken around another shift."""
        self.shift = np.where(np.isnan(self.shift), shift, self.shift)
        d = np.nan_to_num(shift - self.shift)
        n, x, xx, xy = sums
        xy = xy + d[None, :] * x + d[:, None] * x.T + d[:, None] * d[None, :] * n
        self.sums += np.stack([n, x + d[:, None] * n, xx + 2 * d[:, None] * x + d[:, None] ** 2 * n, xy])

    def correlations(self) -> np.ndarray:
        n, x, xx, xy = self.sums
        with np.errstate(all="ignore"):
            cov, var = xy / n - x * x.T / n**2, xx / n - (x / n) ** 2
            spread = np.sqrt(np.where(var > 0, var, np.nan))
            return cov / (spread * spread.T)


def _rows(column: pa.ChunkedArray | pa.Array, k: int) -> np.ndarray:
    """A list column of ``k`` values each as a matrix; NULL is NaN, and so is a row that has no list."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if flat.null_count:
        flat = pa.array([v if v is not None else [None] * k for v in flat.to_pylist()], pa.list_(pa.float64()))
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, k)


def pearson(df: DataFrame, keys: list[str], values: str, n: int, salt: int = 1) -> DataFrame:
    """Pearson correlation of every pair of channels per ``keys``, over samples that have both.

    A group's samples stream through in batches and only pairwise sums are held, so memory
    does not grow with a group.  With ``salt`` a frequent key is dealt over that many tasks,
    whose sums are then merged.
    """
    cells = [(i, j) for i in range(n) for j in range(i + 1, n)]
    left, right = (np.array(c, np.int32) for c in zip(*cells)) if cells else (np.zeros(0, np.int32),) * 2
    edge_schema = key_schema(df, keys) + ", i int, j int, w double"

    def edges_of(head: list[pa.Array], m: _Moments) -> pa.RecordBatch:
        w = pa.array(m.correlations()[left, right], from_pandas=True)
        return pa.RecordBatch.from_arrays([pa.array([h[0].as_py()] * len(left), h.type) for h in head] + [pa.array(left), pa.array(right), w], names=[*keys, "i", "j", "w"])

    def sums_of(batches: Iterator[pa.RecordBatch]) -> tuple[list[pa.Array], _Moments]:
        m, head = _Moments(n), []
        for batch in batches:
            head = head or [batch.column(k) for k in keys]
            m.add(_rows(batch.column(values), n))
        return head, m

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield edges_of(*sums_of(batches))

    rows = df.select(*keys, F.col(values).cast("array<double>").alias(values))
    if salt <= 1:
        return rows.groupBy(*keys).applyInArrow(whole, edge_schema)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, m = sums_of(batches)
        packed = pa.array([m.shift.tobytes() + m.sums.tobytes()], pa.binary())
        yield pa.RecordBatch.from_arrays([h.slice(0, 1) for h in head] + [packed], names=[*keys, "_m"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, head = _Moments(n), []
        for batch in batches:
            head = head or [batch.column(k) for k in keys]
            for blob in batch.column("_m").to_pylist():
                v = np.frombuffer(blob)
                m.merge(v[:n], v[n:].reshape(4, n, n))
        yield edges_of(head, m)

    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salt)))
    parts = salted.groupBy(*keys, "_salt").applyInArrow(part, key_schema(df, keys) + ", _m binary")
    return parts.groupBy(*keys).applyInArrow(merge, edge_schema)


def _pair_kernel(df: DataFrame, keys: list[str], order: str, values: str, schema: str, f: Callable[[np.ndarray], list[np.ndarray]]) -> DataFrame:
    """Run ``f`` (samples x channels to columns over pairs) per group as an Arrow kernel."""
    names = [x.split()[0] for x in schema.split(", ")][len(keys) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by(order)
        m = t[values].combine_chunks()
        columns = f(_rows(m, pc.max(pc.list_value_length(m)).as_py()))
        head = [pa.array([t[k][0].as_py()] * len(columns[0]), t[k].type) for k in keys]
        yield pa.RecordBatch.from_arrays(head + [pa.array(c, from_pandas=True) for c in columns], names=keys + names)

    return df.select(*keys, order, values).groupBy(*keys).applyInArrow(run, schema)


def key_schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def lagged(df: DataFrame, keys: list[str], order: str, values: str) -> DataFrame:
    """Largest cross-correlation of every pair, its lag, and the lag in percent (half to even).

    A group's channels are transformed once, and all pairs come from their spectra.
    """

    def f(m: np.ndarray) -> list[np.ndarray]:
        i, j = np.triu_indices(m.shape[1], 1)
        lag, r = kernels.cross_correlations(m, i, j)
        return [i, j, lag, r, np.round(lag / len(m) * 100)]

    return _pair_kernel(df, keys, order, values, key_schema(df, keys) + ", i long, j long, lag long, r double, lag_pct double", f)


def distance_correlations(df: DataFrame, keys: list[str], order: str, values: str) -> DataFrame:
    """Distance correlation of every pair i <= j; 0 if a channel is constant.

    Up to ``SMALL`` samples all pairs come from one product of the centred distances; longer
    groups take n log n time and n memory a pair.
    """

    def f(m: np.ndarray) -> list[np.ndarray]:
        if len(m) > SMALL:
            gram = kernels.distance_covariances(m)
        else:
            gram = kernels.distance_products(m)
        i, j = np.triu_indices(m.shape[1])
        own = np.diag(gram)[i] * np.diag(gram)[j]
        with np.errstate(all="ignore"):
            return [i, j, np.where(own > 0, np.sqrt(np.maximum(0.0, gram[i, j]) / np.sqrt(own)), 0.0)]

    return _pair_kernel(df, keys, order, values, key_schema(df, keys) + ", i long, j long, dcor double", f)


def relabel(edges: DataFrame, new_index: DataFrame, on: list[str], keys: list[str]) -> DataFrame:
    """Edges under new node numbers: ``new_index`` maps (on, old) to new; i < j is restored."""
    a = new_index.select(*on, F.col("old").alias("i"), F.col("new").alias("_i"))
    b = new_index.select(*on, F.col("old").alias("j"), F.col("new").alias("_j"))
    moved = edges.join(a, [*on, "i"]).join(b, [*on, "j"])
    return moved.select(*keys, F.least("_i", "_j").alias("i"), F.greatest("_i", "_j").alias("j"), "w")


def relabel_by(edges: DataFrame, facts: DataFrame, on: list[str], keys: list[str], new: Callable[[Column, Column], Column], directed: tuple[str, ...] = ()) -> DataFrame:
    """Edges under the node numbers ``new(old, facts)``, told from the column ``facts`` per ``on``; i < j is restored.

    Facts are joined once, as they are, and always by a shuffle: a table of all subjects may be
    far larger than the estimate that would have Spark broadcast it.  ``directed`` values change
    their sign where the two ends change places; other values stay.
    """
    there = facts.select(*on, F.col("facts").alias("_facts")).hint("merge")
    moved = edges.join(there, on).withColumns({"_p": new(F.col("i"), F.col("_facts")), "_q": new(F.col("j"), F.col("_facts"))})
    values = [c for c in edges.columns if c not in (*keys, *on, "i", "j")]
    turned = [F.when(F.col("_p") > F.col("_q"), -F.col(c)).otherwise(F.col(c)).alias(c) if c in directed else F.col(c) for c in values]
    return moved.select(*keys, F.least("_p", "_q").alias("i"), F.greatest("_p", "_q").alias("j"), *turned)


def cycle_statistics(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population deviation over cycles; a missing value makes both missing."""
    return edges.groupBy(*keys, "i", "j").agg(poisoned_avg("w").alias("avg"), poisoned_std("w").alias("std"), F.count(F.lit(1)).alias("n"))


def group_mean(stats: DataFrame, keys: list[str], value: str = "avg", digits: int = 3) -> DataFrame:
    """Mean over subjects, missing ones left out, rounded half to even."""
    return stats.groupBy(*keys, "i", "j").agg(F.bround(F.avg(value), digits).alias("avg"), F.bround(F.stddev_pop(value), digits).alias("std"))


def difference(means: DataFrame, keys: list[str], group: str, first, second) -> DataFrame:
    """Group ``first`` less group ``second``, by conditional aggregation (no self-join)."""
    a, b = (F.max(F.when(F.col(group) == g, F.col("avg"))) for g in (first, second))
    return means.groupBy(*keys, "i", "j").agg((a - b).alias("d"))


def both_ways(edges: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every edge seen from either end: node, other, value."""
    ends = F.explode(F.array(F.struct(F.col("i").alias("node"), F.col("j").alias("other")), F.struct(F.col("j").alias("node"), F.col("i").alias("other"))))
    return edges.select(*keys, ends.alias("_e"), F.col(value).alias(value)).select(*keys, "_e.node", "_e.other", value)


def difference_rank(diff: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes by their sum of absolute differences, largest first, ties by number."""
    total = both_ways(diff, keys, "d").groupBy(*keys, "node").agg(F.round(F.sum(F.abs("d")), 9).alias("total"))
    return total.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("total").desc(), "node")))


def full_grid(edges: DataFrame, keys: list[str], value: str, diagonal: Column, n: int) -> DataFrame:
    """All cells (a, b) of the symmetric matrix; the diagonal is given."""
    cells = both_ways(edges, keys, value).select(*keys, F.col("node").alias("a"), F.col("other").alias("b"), value)
    own = edges.select(*keys).distinct().withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(*keys, "a", F.col("a").alias("b"), diagonal.alias(value))
    return cells.unionByName(own)


def _mapped(grid: DataFrame, keys: list[str], value: str, names: dict[int, str], a: str, b: str) -> DataFrame:
    """Mean of the cells of every pair of names (missing if one is); nodes without a name are left out."""
    name = F.create_map(*[F.lit(v) for k in sorted(names) for v in (k, names[k])])
    cells = grid.select(*keys, name[F.col("a").cast("int")].alias(a), name[F.col("b").cast("int")].alias(b), value).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return cells.groupBy(*keys, a, b).agg(poisoned_avg(value).alias(value), F.count(F.lit(1)).alias("cells"))


def summarise_regions(grid: DataFrame, keys: list[str], value: str, markers: list[str], regions: dict[str, list[str]]) -> DataFrame:
    """Mean of the cells within and between regions, which are lists of marker names.

    ``markers`` names the nodes in order; markers of no region are left out.
    """
    of = {m: r for r, members in regions.items() for m in members}
    return _mapped(grid, keys, value, {k: of[m] for k, m in enumerate(markers) if m in of}, "region_a", "region_b")


def merged_sides(markers: list[str]) -> list[str]:
    """Name after merging sides: ``avg_x`` for l_x and r_x where both are there, else the marker itself."""
    there = set(markers)
    other = {"l_": "r_", "r_": "l_"}
    return [f"avg_{m[2:]}" if m[:2] in other and other[m[:2]] + m[2:] in there else m for m in markers]


def symmetric_pairs(grid: DataFrame, keys: list[str], value: str, markers: list[str]) -> DataFrame:
    """Left and right markers merged by name: the mean of their four cells; solo markers stand alone.

    The mean of a solo marker's cells counts each once, which equals counting it on both sides.
    """
    return _mapped(grid, keys, value, dict(enumerate(merged_sides(markers))), "a", "b").drop("cells")


def histogram(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """Counts in equal bins between the smallest and the largest value of each key."""
    limits = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    place = F.least(F.floor((F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    return df.join(limits, keys).select(*keys, F.coalesce(place, F.lit(0)).cast("long").alias("bin")).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


def merge_cycles(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Values of all cycles as one list, in cycle order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return df.groupBy(*keys).agg(F.transform(rows, lambda r: r["v"]).alias("values"))


def to_frame(edges: DataFrame, n: int) -> pd.DataFrame:
    """One graph's edges as a dense matrix on the driver (for exports of a single matrix of ``n`` nodes)."""
    rows = edges.select("i", "j", "w").limit(n * n + 1).collect()
    if len(rows) > n * n:
        raise ValueError(f"more than one matrix of {n} nodes")
    m = np.eye(n)
    for r in rows:
        m[r.i, r.j] = m[r.j, r.i] = np.nan if r.w is None else r.w
    return pd.DataFrame(m)
