"""Queries that do the whole job, against brute force on small tables of their own."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from motionweave.functions import kernels
from motionweave.operators import paths
from motionweave.plans import registry
from tests.oracle import rows_of, spark_rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def recordings(tmp_path_factory):
    """Four subjects of 12 frames: 21 channels in three directions, one of them constant."""
    folder, rng = tmp_path_factory.mktemp("recordings"), np.random.default_rng(3)
    v = rng.normal(size=(48, 64)).round(3)
    v[:, 20] = 1.0
    pd.DataFrame({"vec_id": range(48), "label": np.repeat(range(4), 12), "embedding": list(v)}).to_parquet(f"{folder}/embeddings.parquet")
    return str(folder), v[:, :63].reshape(4, 12, 3, 21)


def test_distance_correlation_of_all_pairs(spark, recordings):
    folder, v = recordings
    got = {(r.label, r.cycle, r.direction, r.i, r.j): r.dcor for r in registry.QUERIES["distance_corr"](spark, folder).collect()}
    assert len(got) == 4 * 3 * 3 * 231

    def centred(x):
        d = np.abs(np.subtract.outer(x, x))
        return d - d.mean(0) - d.mean(1)[:, None] + d.mean()

    for (label, cycle, direction, i, j), dcor in got.items():
        a, b = (centred(v[label, 4 * cycle : 4 * cycle + 4, direction, k]) for k in (i, j))
        scale = np.sqrt((a * a).mean() * (b * b).mean())
        want = np.sqrt(max(0.0, (a * b).mean()) / scale) if scale > 0 else 0.0
        assert dcor == pytest.approx(want, abs=2e-6)


def _longest(near):
    """By trying all paths."""
    best = []

    def walk(path):
        nonlocal best
        best = min(best, list(path), key=lambda p: (-len(p), p))
        for k in near[path[-1]]:
            if k not in path:
                walk(path + [k])

    for v in sorted(near):
        walk([v])
    return best


def test_longest_path_of_whole_graphs(spark, monkeypatch):
    rng, rows, want = np.random.default_rng(8), [], {}
    for g in range(12):
        edges = [(i, j) for i in range(8) for j in range(i + 1, 8) if rng.random() < 0.1 + 0.05 * g] or [(0, 7)]
        near = {v: sorted({b for a, b in edges if a == v} | {a for a, b in edges if b == v}) for e in edges for v in e}
        rows, want[g] = rows + [(g, i, j, 0.5) for i, j in edges], _longest(near)
        part = {want[g][0]}
        while more := {k for v in part for k in near[v]} - part:
            part |= more
        for steps in (0, paths.WALK_STEPS):
            with monkeypatch.context() as m:
                m.setattr(paths, "WALK_STEPS", steps)
                assert paths.longest_in({k: near[k] for k in part}) == want[g]
    found = paths.longest_path_exact(spark.createDataFrame(rows, "g long, i long, j long, w double"), ["g"])
    assert {r.g: list(r.path) for r in found.collect()} == want
    star = {0: list(range(1, 21))} | {k: [0] for k in range(1, 21)}
    assert paths.longest_in(star) == [1, 0, 2]


def test_longest_path_sees_all_nodes(spark, recordings):
    rows = registry.QUERIES["longest_simple_path"](spark, recordings[0]).collect()
    assert len({(r.label, r.direction) for r in rows}) == 12 and max(int(k) for r in rows for k in r.path.split("-")) > 6


def test_lags_of_all_pairs(spark, recordings):
    folder, v = recordings
    lags = {}
    for label, cycle, direction in np.ndindex(4, 3, 3):
        x = v[label, 4 * cycle : 4 * cycle + 4, direction]
        x = x - x.mean(0)
        for i in range(21):
            for j in range(i + 1, 21):
                norm = np.sqrt((x[:, i] ** 2).sum() * (x[:, j] ** 2).sum())
                r = np.correlate(x[:, i], x[:, j], "full") / norm if norm > 0 else np.zeros(7)
                lags[label, cycle, direction, i, j] = int(np.abs(r).round(9).argmax()) - 3 if norm > 0 else 0
    rows = registry.QUERIES["lagged_xcorr"](spark, folder).collect()
    assert {(r.label, r.cycle, r.direction, r.i, r.j): r.lag for r in rows} == lags and len(rows) == len(lags)
    mean = {k: np.mean([lags[k[0], c, *k[1:]] * 25 for c in range(3)]) for k in {(a, *b) for a, _, *b in lags}}
    groups = registry.QUERIES["lag_group_statistics"](spark, folder).collect()
    assert len(groups) == 2 * 630
    for r in groups:
        assert r["mean"] == pytest.approx(np.mean([mean[k, r.direction, r.i, r.j] for k in (r.grp, r.grp + 2)]), abs=2e-6)
    found = registry.QUERIES["time_lag_statistics"](spark, folder).collect()
    assert len(found) == 630
    tests = registry.QUERIES["time_lag_tests"](spark, folder).toPandas()
    assert set(tests.direction) == {0, 1, 2} and tests.j.max() > 5
    for _, t in tests.groupby(["direction", "i"]):
        p = np.sort(t.p_value.to_numpy())
        want = np.minimum(1, np.minimum.accumulate((p * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1])
        assert np.sort(t.p_adjusted.to_numpy()) == pytest.approx(want)


def test_low_pass_of_all_channels(spark, recordings):
    rows = registry.QUERIES["butter_lowpass"](spark, recordings[0]).collect()
    assert len(rows) == 4 * 12 * 63 and {(r.direction, r.m) for r in rows} == {(d, m) for d in range(3) for m in range(21)}
    v = recordings[1]
    for direction, m in ((0, 2), (1, 3), (2, 20)):
        got = [r.value for r in sorted((r for r in rows if (r.label, r.direction, r.m) == (1, direction, m)), key=lambda r: r.frame)]
        assert got == pytest.approx(kernels.filtfilt(v[1, :, direction, m], 6.0, 200.0), abs=2e-6)


def test_sides_come_from_one_row_a_person(spark, recordings, tmp_path):
    """No row per node is made of a person, and people, few of whom are recorded, are not broadcast."""
    folder, v = recordings
    (tmp_path / "embeddings.parquet").symlink_to(f"{folder}/embeddings.parquet")
    keys = [k for k in range(3000) if k != 2] + [3, None]  # subject 2 is unknown, subject 3 there twice
    nations = [None if k == 1 else 4 if n == 2999 else 1 for n, k in enumerate(keys)]
    people = {"c_custkey": pd.array(keys, "Int64"), "c_nationkey": pd.array(nations, "Int32"), "c_acctbal": 0.0, "c_mktsegment": "BUILDING"}
    pd.DataFrame(people).to_parquet(tmp_path / "customer.parquet")
    found = registry.QUERIES["affected_side_reorder"](spark, str(tmp_path))
    got = spark_rows(found)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Generate explode" not in plan
    con = duckdb.connect()
    for t in ("customer", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = con.execute(registry.SQL["affected_side_reorder"]).fetchall()
    columns = [d[0] for d in con.description]
    assert got == (sorted(columns), rows_of(columns, want)) and len(want) == 3 * 210 * (1 + 1 + 2 * 2)
    # subject 0 (0 points right, 1 left; not right-handed) is affected on the left: 0 and 1 change places, 20 stays
    moved = {(r.i, r.j): r.w for r in found.filter("label = 0 AND direction = 1").collect()}
    mean = np.mean([np.corrcoef(x, rowvar=False) for x in v[0, :, 1].reshape(3, 4, 21)], 0)
    assert [moved[0, 20], moved[1, 20], moved[2, 17]] == pytest.approx([mean[1, 20], mean[0, 20], mean[3, 16]], abs=2e-6)


def test_pivot_of_all_edges(spark, recordings):
    folder, v = recordings
    rows = registry.QUERIES["pivot_edge_table"](spark, folder).collect()
    assert len(rows) == 12 and len(rows[0]) == 2 + 210
    for r in rows:
        x = v[r.label, :, r.direction].reshape(3, 4, 21)
        for i, j in ((0, 1), (5, 17), (18, 19)):
            want = np.mean([np.corrcoef(x[c, :, i], x[c, :, j])[0, 1] for c in range(3)])
            assert float(r[f"e{i}_{j}"]) == pytest.approx(want, abs=0.0051)
        assert r.e0_20 == ("nan" if r.direction == 0 else r.e0_20)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_pattern_grid_has_all_lengths(spark):
    rows = registry.QUERIES["pattern_grid_tests"](spark, SF).select("length").distinct().collect()
    assert sorted(r.length for r in rows) == list(range(2, 21))
