"""Operators on long trials, many subjects and many pairs, against plain forms."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from motionweave.functions import kernels
from motionweave.operators import graph, inference, matrix, paths, signal
from motionweave.plans import drivers, registry


def test_interval_join_of_one_long_trial(spark):
    """20,000 frames and 600 overlapping cycles, one of them long: pairs looked at stay near those kept."""
    rng = np.random.default_rng(1)
    start = np.sort(rng.integers(0, 19_000, 600))
    stop = np.minimum(start + rng.integers(1, 90, 600), 20_000)
    stop[5] = start[5] + 3_000
    frames = spark.range(20_000).selectExpr("1 as trial", "id as frame")
    cycles = spark.createDataFrame(pd.DataFrame({"trial": 1, "start": start, "stop": stop}))
    cut = signal.segment(frames, cycles, ["trial"])
    want = sorted((int(a), int(b), f) for a, b in zip(start, stop) for f in range(a, b))
    assert sorted((r.start, r.stop, r.frame) for r in cut.collect()) == want
    width = round(float((stop - start).mean()))
    assert signal.same_bin(frames, cycles, ["trial"], "frame", width).count() <= 3 * len(want)
    none = signal.segment(frames, cycles.filter("stop < start"), ["trial"])
    assert none.count() == 0


def test_resampling_of_ragged_curves(spark):
    rng = np.random.default_rng(2)
    rows = [(g, p, None if g == 3 and p == 1 else float(rng.normal())) for g in range(600) for p in range(1 + g % 9)]
    out = signal.resample(spark.createDataFrame(rows, "g long, p long, v double"), ["g"], "p", "v", 7).toPandas()
    for g, own in out.groupby("g"):
        y = np.array([np.nan if v is None else v for k, _, v in rows if k == g])
        t = np.arange(7) * (len(y) - 1) / 6
        low = np.floor(t).astype(int)
        high = np.minimum(low + 1, len(y) - 1)
        assert own.sort_values("k")["v"].to_numpy() == pytest.approx(y[low] + (y[high] - y[low]) * (t - low), nan_ok=True)


def test_spectra_give_all_pairs():
    rng = np.random.default_rng(3)
    m = rng.normal(size=(57, 12))
    m[:, 4], m[:, 5] = 2.0, np.roll(m[:, 1], 9)
    i, j = np.triu_indices(12, 1)
    lag, r = kernels.cross_correlations(m, i, j)
    for a, b, found, value in zip(i, j, lag, r):
        x, y = m[:, a] - m[:, a].mean(), m[:, b] - m[:, b].mean()
        norm = np.sqrt((x * x).sum() * (y * y).sum())
        if 4 in (a, b):
            assert found == 0 and np.isnan(value)
            continue
        full = np.correlate(x, y, "full") / norm
        k = int(np.abs(full).round(9).argmax())
        assert (found, value) == (k - 56, pytest.approx(full[k], abs=1e-12))
    assert kernels.cross_correlations(m[:1], i, j)[0].tolist() == [0] * len(i)


@pytest.mark.parametrize("n", [1, 2, 3, 64, 301])
def test_distance_sums(n):
    rng = np.random.default_rng(n)
    m = rng.normal(size=(n, 4))
    m[:, 1], m[:, 2] = m[:, 1].round(0), m[:, 0] ** 2
    m[:, 3] = 1.1
    d = np.abs(m[:, None] - m[None])
    assert kernels.distance_product_sum(m[:, 0], m[:, 1]) == pytest.approx((d[:, :, 0] * d[:, :, 1]).sum())
    centred = d - d.mean(0) - d.mean(1)[:, None] + d.mean((0, 1))
    want = np.einsum("abi,abj->ij", centred, centred) / n**2
    assert kernels.distance_covariances(m) == pytest.approx(want, abs=1e-12)


def test_distance_correlation_of_long_groups(spark, monkeypatch):
    """Sorted sums and distance matrices agree; a long group takes no quadratic memory."""
    rng = np.random.default_rng(5)
    long = rng.normal(size=(20_000, 2))
    long[:, 1] = np.abs(long[:, 0])
    gram = kernels.distance_covariances(long)
    assert 0.3 < np.sqrt(gram[0, 1] / np.sqrt(gram[0, 0] * gram[1, 1])) < 0.7
    rows = [(k % 3, k, [float(v) for v in rng.normal(size=4)]) for k in range(900)]
    df = spark.createDataFrame(rows, "g long, k long, v array<double>")
    both = []
    for small in (10_000, 1):
        monkeypatch.setattr(matrix, "SMALL", small)
        both.append({(r.g, r.i, r.j): r.dcor for r in matrix.distance_correlations(df, ["g"], "k", "v").collect()})
    assert both[0] == pytest.approx(both[1], abs=1e-9) and len(both[0]) == 30


def test_bootstrap_states_merge(spark, monkeypatch):
    """Many tasks and stripes of iterations give the rows of one task."""
    rng = np.random.default_rng(6)
    rows = [(d, k % 2, k, [None if k == 5 and c == 2 else float(v) for c, v in enumerate(rng.normal(size=6))]) for d in range(2) for k in range(40)]
    df = spark.createDataFrame(rows, "d long, grp int, item long, v array<double>")
    found = []
    for items, cells in ((2_000, 2_000_000), (3, 60)):
        monkeypatch.setattr(inference, "ITEMS", items)
        monkeypatch.setattr(inference, "STATE_CELLS", cells)
        monkeypatch.setattr(inference, "BLOCK", 10)
        out = inference.bootstrap(df, ["d"], "grp", "item", (0, 1), 6, 35, 0.5, "s", [0.3, 0.8])
        found.append({(r.d, r.share, r.iter): r.rho for r in out.collect()})
    assert len(found[0]) == 2 * 2 * 35 and found[0] == pytest.approx(found[1])


def _joined(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return {k: sorted(v) for k, v in near.items()}


def test_longest_path_of_66_nodes():
    """A tree (its diameter), cliques in a chain, a dense graph: known lengths beyond any table of node sets."""
    rng = np.random.default_rng(9)
    tree = _joined([(k, int(rng.integers(max(0, k - 6), k))) for k in range(1, 66)])

    def far(v):
        depth, todo = {v: 1}, [v]
        for k in todo:
            for x in tree[k]:
                if x not in depth:
                    depth[x] = depth[k] + 1
                    todo.append(x)
        return depth

    length = max(max(far(v).values()) for v in tree)
    path = paths.longest_in(tree)
    assert len(path) == length and path[0] == min(v for v in tree if max(far(v).values()) == length)
    cliques = _joined([(a, b) for base in range(0, 63, 9) for a in range(base, base + 10) for b in range(a)if b >= base])
    assert len(paths.longest_in(cliques)) == 64
    star = _joined([(0, c * 11 + k) for c in range(6) for k in range(1, 11)] + [(c * 11 + a, c * 11 + b) for c in range(6) for a in range(1, 11) for b in range(1, a)])
    assert len(paths.longest_in(star)) == 21  # two of the six cliques and the node between them
    dense = _joined([(a, b) for a in range(66) for b in range(a) if rng.random() < 0.4])
    path = paths.longest_in(dense)
    assert len(set(path)) == 66 and path[0] == 0 and all(b in dense[a] for a, b in zip(path, path[1:]))


@pytest.mark.parametrize("block", [16, 50, 8192])
def test_filter_by_blocks_is_the_whole_filter(spark, block):
    """Long signals in blocks, with gaps, of many lengths: equal to the filter of the whole."""
    rng, rows, want = np.random.default_rng(11), [], {}
    for k, n in enumerate([1, 9, 10, 15, 16, 31, 32, 33, 100, 333, 1000, 257]):
        for m in range(2):
            v = rng.normal(size=n).cumsum()
            if k == 9 and m:
                v[200] = np.nan
            want[k, m] = kernels.filtfilt(v, 6.0, 200.0)
            rows += [(k, m, f, None if np.isnan(x) else float(x)) for f, x in enumerate(v)]
    df = spark.createDataFrame(rows, "trial long, m int, frame long, value double").repartition(5)
    out = signal.low_pass(df, ["trial"], "frame", "value", 6.0, 200.0, ["m"], block).toPandas()
    assert len(out) == len(rows)
    for key, own in out.groupby(["trial", "m"]):
        assert own.sort_values("frame")["value"].to_numpy() == pytest.approx(want[key], abs=1e-9, nan_ok=True)


def test_filter_of_a_trial_that_arrives_in_parts():
    """A signal of many times what the filter remembers, some parts empty or tiny: equal to the filter of the whole, and held in bounds."""
    rng, f = np.random.default_rng(12), kernels.LowPass(20.0, 200.0)
    v = rng.normal(size=60_000).cumsum()
    stream, got, at, most = kernels.Stream(f), [], 0, 0
    for size in [0, 3, 4, 2, 1, 0, 700, *[2500] * 24]:
        got.append(stream.push(v[at : at + size]))
        at += size
        most = max(most, len(stream.pending))
    got.append(stream.finish())
    assert at >= len(v) and len(got[12]) > 0 and most <= 2 * f.memory + 2500
    assert np.concatenate(got) == pytest.approx(kernels.filtfilt(v, 20.0, 200.0), abs=1e-9)


@pytest.mark.parametrize("block", [300, 1 << 16])
def test_columns_are_filtered_without_their_missing_samples(spark, block):
    """Rows of a trial longer than the filter's memory go out once, each column by its own samples."""
    rng, rows, want = np.random.default_rng(13), [], {}
    for k, n in enumerate([1, 12, 299, 9000, 40, 0, 700]):
        v = rng.normal(size=(n, 3)).cumsum(0)
        v[rng.random((n, 3)) < 0.2] = np.nan
        v[100:4000, 1] = np.nan
        rows += [(k, f, *[None if np.isnan(x) else float(x) for x in own]) for f, own in enumerate(v)]
        for c in range(3):
            v[~np.isnan(v[:, c]), c] = kernels.filtfilt(v[~np.isnan(v[:, c]), c], 40.0, 200.0)
        want[k] = v
    df = spark.createDataFrame(rows, "trial long, frame long, a double, b double, c double").repartition(5)
    out = signal.low_pass_columns(df, ["trial"], "frame", ["a", "b", "c"], 40.0, 200.0, block).toPandas()
    assert len(out) == len(rows)
    for k, own in out.groupby("trial"):
        own = own.sort_values("frame")
        assert own["frame"].tolist() == list(range(len(want[k])))
        assert own[["a", "b", "c"]].to_numpy() == pytest.approx(want[k], abs=1e-9, nan_ok=True)


def test_preprocessing_reads_its_frames_once(spark):
    """Frames are read once for the whole chain, and no window walks to the end of a trial from every row."""
    plan = registry.QUERIES["preprocess_acceleration"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and "unboundedfollowing" not in plan.lower()


def _fill(x, limit):
    at, out = np.flatnonzero(~np.isnan(x)), x.copy()
    for a, z in zip(at, at[1:]):
        if z - a - 1 <= limit:
            out[a : z + 1] = np.where(np.isnan(x[a : z + 1]), x[a] + (x[z] - x[a]) * (np.arange(z - a + 1) / (z - a)), x[a : z + 1])
    return out


def test_preprocessing_is_the_chain_of_its_steps(spark):
    got = registry.QUERIES["preprocess_acceleration"](spark, "/root/testdata/sf0.001").toPandas()
    t = pd.read_parquet("/root/testdata/sf0.001/lineitem.parquet").sort_values(["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])
    total = 0
    for key, own in t.groupby("l_suppkey"):
        q, p = own.l_quantity.where(own.l_discount > 0.02), own.l_extendedprice.where(own.l_tax > 0.01)
        x = np.stack([_fill(c.to_numpy(float), 271) for c in (q, p, own.l_discount, own.l_tax)], 1)
        for c in range(4):
            x[~np.isnan(x[:, c]), c] = kernels.filtfilt(x[~np.isnan(x[:, c]), c], 6.0, 200.0)
        frame = np.arange(len(x))
        for factor in (200.0 / 1000, 200.0):
            x = np.diff(x, axis=0, prepend=np.nan) * factor
            whole = ~np.isnan(x).any(1)
            x, frame = x[whole], frame[whole]
        x = kernels.filtfilt(x, 4.0, 200.0)
        mine = got[got.l_suppkey == key].pivot(index="frame", columns="channel", values="value")
        assert mine.index.tolist() == frame.tolist() and mine[["q", "p", "d", "t"]].to_numpy() == pytest.approx(x, abs=2e-4)
        total += len(x) * 4
    assert total == len(got) > 0


def _partitions(n):
    """All partitions of n nodes, as labels."""
    def grow(labels, k):
        if len(labels) == n:
            yield labels
            return
        for c in range(k + 1):
            yield from grow([*labels, c], max(k, c + 1))

    return grow([0], 1)


def _newman(w, labels):
    """Modularity of a matrix whose diagonal are self-loops."""
    labels = np.array(labels)
    loops = np.diag(w)
    degree = w.sum(1) + loops
    same = labels[:, None] == labels[None, :]
    return ((w + np.diag(loops)) * same).sum() / degree.sum() - sum((degree[labels == c].sum() / degree.sum()) ** 2 for c in set(labels.tolist()))


@pytest.mark.parametrize("seed", range(3))
def test_louvain_reaches_the_best_partition(seed):
    rng = np.random.default_rng(seed)
    w = rng.uniform(0, 0.4, (8, 8))
    group = np.array([0, 0, 0, 1, 1, 1, 2, 2])
    w += 0.6 * (group[:, None] == group[None, :]) * rng.uniform(0.5, 1, (8, 8))
    w = np.triu(w, 1)
    w += w.T + np.eye(8) * rng.uniform(0, 0.2, 8)
    best = max(_newman(w, p) for p in _partitions(8))
    found = [_newman(w, kernels.louvain(w, np.random.default_rng(k))) for k in range(20)]
    assert abs(max(found) - best) < 1e-9 and min(found) > 0.8 * best


def test_louvain_runs_are_the_same_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(g, i, j, float(rng.uniform(0, 1))) for g in range(3) for i in range(7) for j in range(i + 1, 7)]
    edges = spark.createDataFrame(rows, "g long, i long, j long, w double")
    found = []
    for size in (100, 4):
        monkeypatch.setattr(graph, "RUN_BLOCK", size)
        found.append(sorted(map(tuple, graph.louvain_memberships(edges, ["g"], 7, 10).collect())))
    assert found[0] == found[1] and len(found[0]) == 3 * 10 * 7


def test_group_pattern_begins_elsewhere_without_its_start(spark):
    edges = spark.createDataFrame([(k, i, j, 1.0 + i + j) for k in range(2) for i in range(5) for j in range(i + 1, 5)], "k long, i long, j long, w double")
    walks = spark.createDataFrame([(0, 0, [3, 1, 2]), (1, 0, [3, 1, 4])], "k long, grp long, path array<int>")
    from_edges = edges.withColumn("grp", F.lit(0).cast("long"))

    def pattern(start):
        return [r.pattern for r in paths.group_pattern(walks, from_edges, ["k", "grp"], ["grp"], 5, start, 3).collect()]

    assert pattern(3) == [[3, 1, 4]]
    assert pattern(0) == [[1, 4]]  # no path touches node 0
    assert pattern(4) == [[4]]  # reached, but no step leaves it


def test_whole_allegiance_has_three_nodes_a_marker(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(s % 2, s, "walk", 0, i, j, float(0.2 + 0.7 * (i // 3 == j // 3) + 0.05 * rng.uniform())) for s in range(6) for i in range(9) for j in range(i + 1, 9)]
    edges = spark.createDataFrame(rows, "grp long, sub_id long, task string, cycle long, i long, j long, w double")
    out = drivers.modular_organisation(edges, ["sub_id", "task", "cycle"], 3, str(tmp_path / "a"), runs=3, blocks=[0, 0, 0], permutations=50, full=True)
    mean = {(r.grp, r.i, r.j): r.w for r in out["group_allegiance"].collect()}
    assert len(mean) == 2 * 36 and all(w == float(i // 3 == j // 3) for (_, i, j), w in mean.items())
    assert [r.community for r in out["group_communities"].filter("grp = 0").orderBy("node").collect()] == [0, 0, 0, 3, 3, 3, 6, 6, 6]
    assert out["permutation"].count() == 1
