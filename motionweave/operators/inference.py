"""Rank correlation, permutation and bootstrap tables, classical tests, multiplicity.

Random tables are made by ranking md5 digests of (seed, iteration, item): the same on any
engine and any cluster, without a driver loop.  Moments and statistics are aggregations;
permutations and bootstraps run as matrices in Arrow kernels, as do tail probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionweave.functions import kernels, special
from motionweave.functions.core import safe_corr


#: Iterations of a random table that one kernel call takes as a matrix.
BLOCK = 500
#: Items that one task of a bootstrap sums up, and numbers that its sums may have.
ITEMS, STATE_CELLS = 2_000, 2_000_000


def average_rank(value: str, keys: list[str]) -> Column:
    """Rank with ties at their mean."""
    w = Window.partitionBy(*keys)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return F.rank().over(w.orderBy(value)) + (ties - 1) / F.lit(2.0)


def spearman(pairs: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Rank correlation of x and y per key."""
    pairs = pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = pairs.withColumns({"_x": average_rank(x, keys), "_y": average_rank(y, keys)})
    return ranked.groupBy(*keys).agg(safe_corr("_x", "_y").alias("rho"))


def digest_order(seed: str, *parts: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(p).cast("string") for p in parts]).cast("binary"))


def permutation_table(nodes: DataFrame, iterations: int, seed: str, block: str = "block") -> DataFrame:
    """(iter, old, new): labels shuffled within each block of nodes (node, block)."""
    rows = nodes.withColumn("iter", F.explode(F.sequence(F.lit(1), F.lit(iterations))))
    a = Window.partitionBy("iter", block).orderBy("node")
    b = Window.partitionBy("iter", block).orderBy(digest_order(seed, "iter", "node"), "node")
    left = rows.select("iter", block, F.col("node").alias("old"), F.row_number().over(a).alias("k"))
    right = rows.select("iter", block, F.col("node").alias("new"), F.row_number().over(b).alias("k"))
    return left.join(right, ["iter", block, "k"]).select("iter", "old", "new")


def _cells(pairs: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per key with its edges as an array (at most n squared of them)."""
    return pairs.groupBy(*keys).agg(F.collect_list(F.struct(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), *[F.col(v).cast("double").alias(v) for v in values])).alias("_e"))


def _blocks(packed: DataFrame, iterations: int) -> DataFrame:
    """Every key's row once per block of iterations, dealt over the tasks."""
    rows = packed.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit((iterations - 1) // BLOCK))))
    return rows.repartition(F.col("_b"))


def _dense(cells: list[dict], n: int, value: str) -> np.ndarray:
    m = np.full((n, n), np.nan)
    for c in cells:
        v = c[value]
        m[c["i"], c["j"]] = m[c["j"], c["i"]] = np.nan if v is None else v
    return m


def _moved(m: np.ndarray, to: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """(iterations x edges) values that lie on each edge (i, j) after the nodes move to ``to``."""
    back = np.argsort(to, axis=1)
    return m[back[:, i], back[:, j]]


def permutation_test(pairs: DataFrame, keys: list[str], blocks: list[int], iterations: int, seed: str) -> DataFrame:
    """(keys, rho, p_value): rank correlation of x and y over edges, and its permutation p.

    p is (#{|observed| <= |permuted|} + 1) / (iterations + 1) at 9 decimals, with the labels of
    x shuffled within ``blocks`` (one for each node).  A key's edges travel as one array; a
    block of iterations is one matrix, so no edge is repeated per iteration.
    """
    head = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            out = []
            for cells, b in zip(batch.column("_e").to_pylist(), batch.column("_b").to_pylist()):
                first = b * BLOCK + 1
                if b not in tables:
                    tables[b] = kernels.permutations(seed, range(first, min(first + BLOCK, iterations + 1)), blocks)
                x, y = (_dense(cells, len(blocks), v) for v in "xy")
                i, j = (np.array([c[v] for c in cells]) for v in "ij")
                rho = kernels.spearman_rows(x[i, j], y[i, j])[0]
                moved = kernels.spearman_rows(_moved(x, tables[b], i, j), y[i, j])
                out.append((None if np.isnan(rho) else float(rho), int((np.round(abs(rho), 9) <= np.round(np.abs(moved), 9)).sum())))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.int64())], names=[*keys, "rho", "hits"])

    found = _blocks(_cells(pairs, keys, ["x", "y"]), iterations).mapInArrow(run, f"{head}, rho double, hits long")
    return found.groupBy(*keys).agg(F.max("rho").alias("rho"), ((F.sum("hits") + 1) / F.lit(iterations + 1)).alias("p_value"))


def edge_permutation_test(edges: DataFrame, keys: list[str], value: str, blocks: list[int], iterations: int, seed: str) -> DataFrame:
    """(keys, i, j, value, p_value): share of the permutations whose value on the edge is as large, in absolute terms."""
    head = ", ".join(f"{k} {edges.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (cells, b) in enumerate(zip(batch.column("_e").to_pylist(), batch.column("_b").to_pylist())):
                first = b * BLOCK + 1
                to = kernels.permutations(seed, range(first, min(first + BLOCK, iterations + 1)), blocks)
                m = _dense(cells, len(blocks), value)
                i, j = (np.array([c[v] for c in cells]) for v in "ij")
                moved = _moved(m, to, i, j)
                hits = (np.round(np.abs(moved), 9) >= np.round(np.abs(m[i, j]), 9)).sum(0)
                size = len(cells)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(k)[row].as_py()] * size, batch.column(k).type) for k in keys]
                    + [pa.array(i.astype(np.int64)), pa.array(j.astype(np.int64)), pa.array([c[value] for c in cells], pa.float64()), pa.array(hits.astype(np.int64)), pa.array((~np.isnan(moved)).sum(0).astype(np.int64))],
                    names=[*keys, "i", "j", value, "hits", "of"],
                )

    found = _blocks(_cells(edges, keys, [value]), iterations).mapInArrow(run, f"{head}, i long, j long, {value} double, hits long, of long")
    return found.groupBy(*keys, "i", "j").agg(F.max(value).alias(value), F.try_divide(F.sum("hits"), F.sum("of").cast("double")).alias("p_value"))


def bootstrap(vectors: DataFrame, keys: list[str], group: str, item: str, groups: tuple, size: int, iterations: int, share: float, seed: str, shares: list[float] | None = None) -> DataFrame:
    """(keys, [share,] iter, rho): rank correlation of two groups' means over samples of their items.

    ``vectors`` has keys, group, item and ``v`` (an array of ``size`` values).  Which iterations
    draw an item is one array per item, so neither values nor items are repeated per iteration.
    Items are dealt over as many tasks as their group needs (``ITEMS`` each); a task holds the
    sums and counts of all iterations (at most ``STATE_CELLS`` numbers, else the iterations are
    dealt as well), and these states are merged by blocks of iterations in a second step.  With
    ``shares`` every share is sampled anew.
    """
    every = shares or [share]
    who = vectors.select(group, item).distinct().withColumn("_share", F.explode(F.array(*[F.lit(x) for x in every])))
    n = F.count(F.lit(1)).over(Window.partitionBy("_share", group))
    rows = who.withColumn("_n", n).withColumn("iter", F.explode(F.sequence(F.lit(1), F.lit(iterations))))
    parts = ("iter", "_share", item) if shares else ("iter", item)
    order = Window.partitionBy("iter", "_share", group).orderBy(digest_order(seed, *parts), item)
    drawn = rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * F.col("_share"))))
    picks = drawn.groupBy("_share", group, item).agg(F.collect_list("iter").alias("_its"), F.first("_n").alias("_n"))
    stripe = max(BLOCK, STATE_CELLS // size // BLOCK * BLOCK)
    salt = F.pmod(F.xxhash64(item), F.ceil(F.col("_n") / F.lit(ITEMS)).cast("long"))
    joined = vectors.join(picks, [group, item]).withColumns({"_salt": salt, "_stripe": F.explode(F.sequence(F.lit(0), F.lit((iterations - 1) // stripe)))})
    head = ", ".join(f"{k} {vectors.schema[k].dataType.simpleString()}" for k in keys)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            if sums is None:
                head, low = [batch.column(k).slice(0, 1) for k in [*keys, "_share"]], batch.column("_stripe")[0].as_py() * stripe
                own = min(stripe, iterations - low)
                sums, counts = np.zeros((2, own, size)), np.zeros((2, own, size), np.int32)
            for g, v, its in zip(batch.column(group).to_pylist(), batch.column("v").to_pylist(), batch.column("_its")):
                if g in groups:
                    v, at, side = np.array(v, float), its.values.to_numpy() - 1 - low, groups.index(g)
                    at = at[(at >= 0) & (at < own)]
                    sums[side][at] += np.nan_to_num(v)
                    counts[side][at] += ~np.isnan(v)
        for at in range(0, own, BLOCK):
            packed = [pa.array([x[:, at : at + BLOCK].tobytes()], pa.binary()) for x in (sums, counts)]
            yield pa.RecordBatch.from_arrays([*head, pa.array([low + at], pa.int64()), *packed], names=[*keys, "share", "first", "sums", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, head = 0.0, 0, None
        for batch in batches:
            head = head or [batch.column(k).slice(0, 1) for k in [*keys, "share", "first"]]
            for s, c in zip(batch.column("sums"), batch.column("counts")):
                sums = sums + np.frombuffer(s.as_buffer()).reshape(2, -1, size)
                counts = counts + np.frombuffer(c.as_buffer(), np.int32).reshape(2, -1, size)
        with np.errstate(all="ignore"):
            rho = kernels.spearman_rows(*np.where(counts > 0, sums / counts, np.nan))
        first = head.pop()[0].as_py()
        columns = [pa.array([h[0].as_py()] * len(rho), h.type) for h in head]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(first + 1, first + 1 + len(rho))), pa.array(rho, from_pandas=True)], names=[*keys, "share", "iter", "rho"])

    states = joined.select(*keys, "_share", "_salt", "_stripe", group, "v", "_its").groupBy(*keys, "_share", "_salt", "_stripe").applyInArrow(part, f"{head}, share double, first long, sums binary, counts binary")
    out = states.groupBy(*keys, "share", "first").applyInArrow(merge, f"{head}, share double, iter long, rho double")
    return out if shares else out.drop("share")


def two_group_moments(df: DataFrame, keys: list[str], group: str, value: str, first, second) -> DataFrame:
    """n, mean, sample variance and median of both groups in one row per key."""
    out = []
    for k, g in (("1", first), ("2", second)):
        v = F.when(F.col(group) == g, F.col(value))
        out += [F.count(v).alias("n" + k), F.avg(v).alias("mean" + k), F.var_samp(v).alias("var" + k), F.median(v).alias("median" + k)]
    return df.groupBy(*keys).agg(*out)


def welch(moments: DataFrame) -> DataFrame:
    """t and degrees of freedom without equal variances, and Cohen's d (0 if the spread is 0)."""
    a, b = F.col("var1") / F.col("n1"), F.col("var2") / F.col("n2")
    gap = F.col("mean1") - F.col("mean2")
    t = F.try_divide(gap, F.sqrt(a + b))
    df = F.try_divide(F.pow(a + b, 2), a * a / F.nullif(F.col("n1") - 1, F.lit(0)) + b * b / F.nullif(F.col("n2") - 1, F.lit(0)))
    d = F.coalesce(F.try_divide(gap, F.sqrt((F.col("var1") + F.col("var2")) / 2)), F.lit(0.0))
    return moments.withColumns({"t": t, "df": df, "cohens_d": d})


def mann_whitney_u(df: DataFrame, keys: list[str], group: str, value: str, first, second) -> DataFrame:
    """U of the first group and the rank-biserial effect 1 - 2U / (n1 n2)."""
    rows = df.filter(F.col(group).isin(first, second) & F.col(value).isNotNull()).withColumn("_r", average_rank(value, keys))
    one = F.col(group) == first
    sums = rows.groupBy(*keys).agg(F.sum(F.when(one, F.col("_r"))).alias("_s"), F.count_if(one).alias("n1"), F.count_if(~one).alias("n2"))
    u = F.col("_s") - F.col("n1") * (F.col("n1") + 1) / 2
    return sums.select(*keys, "n1", "n2", u.alias("u"), (1 - 2 * u / F.nullif(F.col("n1") * F.col("n2"), F.lit(0))).alias("rank_biserial"))


def levene_w(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """Levene's statistic around the medians, for any number of groups."""
    middle = df.groupBy(*keys, group).agg(F.median(value).alias("_m"))
    z = df.join(middle, [*keys, group]).withColumn("_z", F.abs(F.col(value) - F.col("_m")))
    part = z.groupBy(*keys, group).agg(F.count("_z").alias("n"), F.avg("_z").alias("m"), F.var_pop("_z").alias("v"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    grand = F.sum(F.col("n") * F.col("m")).over(Window.partitionBy(*keys)) / total
    sums = part.withColumns({"_t": total, "_g": grand}).groupBy(*keys).agg(
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("_g"), 2)).alias("b"), F.sum(F.col("n") * F.col("v")).alias("w"), F.max("_t").alias("t"), F.count(F.lit(1)).alias("k")
    )
    stat = F.try_divide((F.col("t") - F.col("k")) * F.col("b"), F.nullif((F.col("k") - 1) * F.col("w"), F.lit(0.0)))
    return sums.select(*keys, stat.alias("levene_w"))


def bonferroni(p: str, keys: list[str]) -> Column:
    return F.least(F.lit(1.0), F.col(p) * F.count(p).over(Window.partitionBy(*keys)))


def benjamini_hochberg(df: DataFrame, p: str, keys: list[str], tie: str, name: str = "p_adjusted") -> DataFrame:
    """Step-up adjusted p: the running minimum of p n / rank, from the largest p down."""
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy(p, tie))
    scaled = df.withColumns({"_n": F.count(p).over(w), "_k": rank}).withColumn("_s", F.col(p) * F.col("_n") / F.col("_k"))
    down = w.orderBy(F.col("_k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return scaled.withColumn(name, F.least(F.lit(1.0), F.min("_s").over(down))).drop("_n", "_k", "_s")


def two_stage(df: DataFrame, p: str, keys: list[str], screen: float = 0.01) -> DataFrame:
    """Screen at ``screen``, then Bonferroni over what is left of each family."""
    kept = df.filter(F.col(p) < screen)
    return kept.withColumn("p_adjusted", bonferroni(p, keys))


def p_welch(t: Column, df: Column) -> Column:
    """Two-sided p of t, in Arrow batches."""

    @F.pandas_udf("double")
    def tail(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([special.t_two_sided(a, b) if a == a and b == b and b > 0 else None for a, b in zip(t, df)], dtype=float)

    return tail(t, df)


def lag_tests(lags: DataFrame, keys: list[str], group: str, value: str, first, second) -> DataFrame:
    """Welch tests of every pair (i, j) per ``keys``: p, adjusted per base marker i, significance and bands."""
    w = welch(two_group_moments(lags, [*keys, "i", "j"], group, value, first, second))
    p = w.withColumn("p_value", p_welch(F.col("t"), F.col("df"))).filter("p_value is not null")
    out = benjamini_hochberg(p, "p_value", [*keys, "i"], "j")
    band = F.when(F.col("p_adjusted") < 0.01, "below 0.01").when(F.col("p_adjusted") < 0.05, "0.01 to 0.05").otherwise("0.05 and above")
    gap = (F.col("mean1") - F.col("mean2")).alias("mean_diff")
    return out.select(*keys, "i", "j", "p_value", "cohens_d", gap, "mean1", "mean2", "p_adjusted", (F.col("p_adjusted") < 0.05).alias("significant"), band.alias("band"))


_TEST = "n1 long, n2 long, mean1 double, mean2 double, normal boolean, test string, statistic double, p_value double, effect_size double"


def _compare(x: np.ndarray, y: np.ndarray, least: int, gate_n: int, equal_gate: bool, less: bool) -> dict | None:
    if len(x) < least or len(y) < least:
        return None
    normal = special.shapiro(x)[1] > 0.05 and special.shapiro(y)[1] > 0.05
    if normal and min(len(x), len(y)) > gate_n:
        equal = True if not equal_gate else not special.levene(x, y)[1] <= 0.05
        stat, p = special.t_test(x, y, equal, less)
        test = "student" if equal else "welch"
    else:
        stat, p = special.mann_whitney(x, y, less)
        test = "mann-whitney"
    if normal:
        pooled = np.sqrt(((len(x) - 1) * x.var(ddof=1) + (len(y) - 1) * y.var(ddof=1)) / (len(x) + len(y) - 2))
        effect = (x.mean() - y.mean()) / pooled if pooled else 0.0
    else:
        effect = 1 - 2 * special.mann_whitney(x, y)[0] / (len(x) * len(y))
    return {"n1": len(x), "n2": len(y), "mean1": x.mean(), "mean2": y.mean(), "normal": bool(normal), "test": test, "statistic": stat, "p_value": p, "effect_size": effect}


def compare_groups(
    df: DataFrame, keys: list[str], group: str, value: str, first, second, *, least: int = 3, gate_n: int = 5, equal_gate: bool = True, less: bool = False
) -> DataFrame:
    """Normality gate, then t-test or Mann-Whitney, one row per key with enough values.

    A key's values are its subjects' scores, some hundreds at most, so they fit one kernel call.
    """
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", " + _TEST

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[value])
        x, y = (np.sort(pdf.loc[pdf[group] == g, value].to_numpy(float)) for g in (first, second))
        found = _compare(x, y, least, gate_n, equal_gate, less)
        names = [c.split()[0] for c in schema.split(", ")]
        return pd.DataFrame([[pdf[k].iloc[0] for k in keys] + list(found.values())] if found else [], columns=names)

    return df.select(*keys, group, value).groupBy(*keys).applyInPandas(run, schema)


def summary(df: DataFrame, keys: list[str], value: str, observed: str | Column) -> DataFrame:
    """Mean, population deviation, coefficient of variation in percent, bias and n."""
    m, s = F.avg(value), F.stddev_pop(value)
    observed = F.max(observed)
    return df.groupBy(*keys).agg(
        F.round(observed, 4).alias("observed"), F.round(m, 4).alias("mean"), F.round(s, 4).alias("std"),
        F.round(F.try_divide(s, F.nullif(m, F.lit(0.0))) * 100, 4).alias("cv_percent"), F.round(m - observed, 4).alias("bias"), F.count(value).alias("n"),
    )


