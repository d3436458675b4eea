"""A tiny synthetic walker through the whole chain, from frames to matrices and tests."""

import numpy as np
import pandas as pd
import pytest

from motionweave.operators import graph
from motionweave.plans import drivers

MARKERS = ["l_sho", "r_sho", "ster", "l_asis", "r_asis", "l_th"]


@pytest.fixture(scope="module")
def recording(spark):
    t = np.arange(600) / 200
    rows = []
    raw = ["l_sho", "r_sho", "m_ster1", "m_ster2", "l_asis", "r_asis", "l_psis", "r_psis", "l_th1", "l_th2", "l_heel"]
    for s in range(3):
        for k, m in enumerate(raw):
            for a, axis in enumerate("xyz"):
                v = (10 + k) * np.sin(2 * np.pi * t + 0.3 * k + a) + (400 * t if axis == "x" else 90 * t if axis == "y" else 0)
                if m == "l_sho":
                    v[100:120] = np.nan  # fillable
                if m == "r_sho" and s == 2:
                    v[60:360] = np.nan  # above the limit
                rows.append(pd.DataFrame({"sub_id": f"pp{s:03d}", "task": "walk", "run": "on", "tracksys": "omc", "frame": np.arange(600), "marker": m, "axis": axis, "value": v}))
    motion = pd.concat(rows).astype({"value": object}).where(lambda d: d.notna(), None)
    motion = spark.createDataFrame(motion, "sub_id string, task string, run string, tracksys string, frame long, marker string, axis string, value double")
    e = [(50, "start"), (550, "stop")] + [(x, "initial_contact_right") for x in (60, 260, 460)] + [(x, "initial_contact_left") for x in (160, 360, 540)]
    events = spark.createDataFrame([(f"pp{s:03d}", "walk", "on", "omc", o, k) for s in range(3) for o, k in e], "sub_id string, task string, run string, tracksys string, onset long, event_type string")
    return motion, events


def test_cycles_from_events(spark, recording):
    motion, events = recording
    frames = motion.filter("marker = 'l_sho' AND axis = 'x'").selectExpr("sub_id", "task", "run", "tracksys", "frame AS pos")
    got = {(r.sub_id, r.start, r.stop) for r in drivers.gait_cycles(events, frames).collect()}
    assert got == {(f"pp{s:03d}", a, b) for s in range(3) for a, b in ((10, 310), (210, 490))}


def test_chain(spark, recording):
    motion, events = recording
    acc = drivers.preprocess(motion, events, "acc").cache()
    lengths = {r.sub_id: r.n for r in acc.groupBy("sub_id").agg({"pos": "max"}).withColumnRenamed("max(pos)", "n").collect()}
    assert lengths["pp000"] == lengths["pp001"] == 497  # 500 frames less two differences
    assert lengths["pp002"] < 497  # the long gap of one marker empties whole frames
    markers = {r.marker for r in acc.select("marker").distinct().collect()}
    assert {"ster", "l_th", "l_sho"} <= markers and not any("heel" in m or m.endswith("1") for m in markers)
    edges = drivers.build_matrices(acc, events, MARKERS, points=100).collect()
    assert all(r.w is None or abs(r.w) <= 1 + 1e-9 for r in edges)
    per_cycle = {}
    for r in edges:
        per_cycle[r.sub_id, r.start, r.direction] = per_cycle.get((r.sub_id, r.start, r.direction), 0) + 1
    assert set(per_cycle.values()) == {15}
    assert ("pp000", 10, 0) in per_cycle and ("pp000", 210, 2) in per_cycle
    full = drivers.build_matrices(acc, events, MARKERS, points=50, full=True)
    assert {r["count"] for r in full.groupBy("sub_id", "start").count().collect()} == {153}
    assert drivers.build_matrices(acc, events, [*MARKERS, "absent"], points=50).count() == 0


def test_methods_of_the_matrix(spark, recording):
    motion, events = recording
    acc = drivers.preprocess(motion, events, "acc").cache()
    cross = drivers.build_matrices(acc, events, MARKERS, method="cross", points=60).toPandas()
    dcor = drivers.build_matrices(acc, events, MARKERS, method="dcor", points=60).toPandas()
    pears = drivers.build_matrices(acc, events, MARKERS, points=60).toPandas()
    keys = ["sub_id", "start", "direction", "i", "j"]
    both = pears.merge(cross, on=keys).merge(dcor, on=keys, suffixes=("", "_dcor"))
    assert len(both) == len(pears) == len(cross) and len(dcor) == len(pears) // 15 * 21
    assert (both.w_y.abs() >= both.w_x.abs() - 1e-6).all() and (both.w.dropna() >= 0).all()
    assert (both.lag_pct.abs() < 100).all() and (both.lag_pct != 0).any()
    with pytest.raises(ValueError):
        drivers.build_matrices(acc, events, MARKERS, method="none")


def _edges(spark, n=8):
    rng, rows = np.random.default_rng(0), []
    for grp in (0, 1):
        for s in range(3):
            for c in range(2):
                for i in range(n):
                    for j in range(i + 1, n):
                        w = (0.8 if (i < n // 2) == (j < n // 2) else -0.4) + rng.normal(0, 0.02)
                        rows.append((grp, f"pp{grp}{s}", c, 0, i, j, float(w), float(round(10 * w * (grp + 1)))))
    return spark.createDataFrame(rows, "grp int, sub_id string, cycle int, direction int, i int, j int, w double, lag_pct double")


def test_group_comparison(spark):
    out = drivers.compare_between_groups(_edges(spark), ["direction"], [0] * 8, permutations=50, bootstraps=40, shares=[0.5, 1.0])
    r = out["permutation"].first()
    assert r.rho > 0.5 and r.p_value < 0.2
    b = out["bootstrap"].first()
    assert b.n == 40 and b.observed == pytest.approx(r.rho, abs=1e-4) and 0 < b["mean"] <= 1
    sweep = {r.share: r for r in out["sweep"].collect()}
    assert set(sweep) == {0.5, 1.0} and sweep[1.0]["std"] == 0 and sweep[1.0].bias == 0
    assert drivers.expand_blocks([0, 1], True) == [0, 0, 0, 1, 1, 1]
    full = drivers.compare_between_groups(_edges(spark, 6), ["direction"], [0, 0], permutations=20, bootstraps=10, full=True)
    assert full["permutation"].first().rho > 0.3


def test_time_lags(spark):
    out = drivers.time_lags(_edges(spark), ["direction"])
    mean = _edges(spark).groupBy("grp", "sub_id", "i", "j").avg("lag_pct").toPandas().groupby(["grp", "i", "j"])["avg(lag_pct)"].mean()
    for r in out["groups"].collect():
        assert r.avg == pytest.approx(mean[r.grp, r.i, r.j])
    tests = out["tests"].toPandas()
    assert 0 < len(tests) <= 28 and (tests.p_adjusted >= tests.p_value - 1e-12).all()


def test_modules(spark, tmp_path):
    call = lambda: drivers.modular_organisation(_edges(spark), ["sub_id", "cycle", "direction"], 8, f"file://{tmp_path}/allegiance", runs=5, blocks=[0] * 8, permutations=30)
    out = call()
    assert {r.community for r in out["group_communities"].collect()} == {0, 4}
    assert all(r.ari == 1 for r in out["fit"].collect())
    assert all(r.modularity > 0.2 for r in out["modularity"].collect() + out["group_modularity"].collect())
    assert all(r.density > 0.9 for r in out["density"].collect())
    assert out["fit_tests"].count() <= 1 and out["modularity_tests"].count() <= 1 and out["permutation"].first().p_value <= 1
    before = {p.name for p in (tmp_path / "allegiance").iterdir()}
    call()
    assert {p.name for p in (tmp_path / "allegiance").iterdir()} == before


def test_modularity_of_one_community_is_missing(spark):
    e = spark.createDataFrame([(1, 0, 1, 0.5)], "g long, i int, j int, w double")
    m = spark.createDataFrame([(1, 0, 0), (1, 1, 0)], "g long, node int, community int")
    assert graph.modularity(e, m, ["g"]).first().modularity is None
    assert graph.modularity(e, m, ["g"], alone=True).first().modularity == pytest.approx(0)


RAW = ["l_sho", "r_sho", "m_ster1", "m_ster2", "l_asis", "r_asis", "l_psis", "r_psis", "l_th1", "l_th2"]


def _record(folder, sub, run, tracksys, seed, order):
    """A recording and its event file; ``run`` and ``seed`` make its signals its own."""
    t, rng, wide = np.arange(600) / 200, np.random.default_rng(seed), {}
    for k, m in enumerate(RAW):
        for a, axis in enumerate("xyz"):
            wide[f"{m}_POS_{axis}"] = (10 + k) * np.sin(2 * np.pi * t + 0.3 * k * (seed % 3) + a) + 300 * t * (a < 2) * (1 + a) + rng.normal(0, 0.3, 600)
    named = f"_run-{run}" if run else ""
    pd.DataFrame(wide)[sorted(wide, reverse=order)].round(4).to_csv(folder / f"sub-{sub}_task-walk{named}_tracksys-{tracksys}_motion.tsv", sep="\t", index=False)
    e = [(50, "start"), (550, "stop")] + [(x, "initial_contact_right") for x in (60, 260, 460)] + [(x, "initial_contact_left") for x in (160, 360, 540)]
    pd.DataFrame(e, columns=["onset", "event_type"]).to_csv(folder / f"sub-{sub}_task-walk{named}_events.tsv", sep="\t", index=False)


def _analysed(spark, folder, **options):
    return drivers.analyse(spark, f"{folder}/*motion.tsv", f"{folder}/*events.tsv", f"{folder}/people.csv", MARKERS, f"file://{folder}/out", task="walk", direction=0, points=60, longest=4, **options)


def _values(df):
    return {(r.sub_id, r.tracksys, r.start, r.direction, r.i, r.j): r.w for r in df.collect()}


def test_whole_analysis_from_files(spark, tmp_path):
    """Runs and tracking systems stay apart: the result equals that of a folder with the asked run alone."""
    both, picked = tmp_path / "both", tmp_path / "picked"
    scores = ["updrs_3_3_rigidity_rue", "updrs_3_3_rigidity_lue", "updrs_3_3_rigidity_rle", "updrs_3_3_rigidity_lle"]
    people = pd.DataFrame({"id": range(8), "age": range(60, 68), "med_state": "on", "diagnosis_parkinson": [1] * 4 + [0] * 4, "diagnosis_old": [0] * 4 + [1] * 4, "diagnosis_young": 0, "handedness": 0})
    people[scores] = [[k % 2, 1 - k % 2, 1, 0] for k in range(8)]
    people.loc[3, scores] = [2, 2, 2, 2]  # a tie goes to the left of a right-handed person
    people = pd.concat([people, people.head(4).assign(med_state="off").assign(**{scores[0]: 9})])
    for folder in (both, picked):
        folder.mkdir()
        people.to_csv(folder / "people.csv", index=False)
        for s in range(8):
            for system in ("omc", "imu"):
                if s < 3 and folder == both:
                    _record(folder, f"pp{s:03d}", "off", system, 50 + s, False)
                # Patient 3 was measured 'on', though the file does not say so; controls have no run.
                _record(folder, f"pp{s:03d}", "on" if s < 3 else None, system, s + 20 * (system == "imu"), bool(s % 2))
    out = _analysed(spark, both, on_ids=["pp003"])
    got = _values(out["matrices"])
    assert len({k[:3] for k in got}) == 32 and {r.run for r in out["matrices"].filter("sub_id < 'pp004'").select("run").distinct().collect()} == {"on"}
    assert {(r.sub_id, r.grp) for r in out["groups"].collect()} == {(f"pp{k:03d}", int(k < 4)) for k in range(8)}
    tests = spark.read.csv(f"file://{both}/out/pattern-tests", header=True, inferSchema=True)
    assert {r.length for r in tests.collect()} <= {2, 3, 4} and {r.tracksys for r in tests.collect()} == {"omc", "imu"} and tests.count() == out["tests"].count() > 0
    assert _values(_analysed(spark, picked, on_ids=["pp003"])["matrices"]) == pytest.approx(got)
    # Matrices as they were before their nodes were reordered.
    subjects = spark.createDataFrame([(f"pp{s:03d}", "on", "on" if s < 4 else None) for s in range(8)], "sub_id string, asked string, run string")
    motion, events = drivers.chosen_recordings(spark, f"{both}/*motion.tsv", f"{both}/*events.tsv", subjects, MARKERS)
    plain = drivers.build_matrices(drivers.preprocess(motion, events, "acc"), events, MARKERS, points=60)
    more = {s: ("right" if s % 2 else "left", "right") for s in range(8)} | {3: ("left", "left")}
    assert drivers.affected_order(MARKERS) == ["ster", "sho_la", "sho_ma", "asis_la", "asis_ma", "th_ma"]
    for (sub, system, start, d, i, j), w in _values(plain).items():
        upper, lower = more[int(sub[2:])]
        order = ["ster", *(["r_sho", "l_sho"] if upper == "left" else ["l_sho", "r_sho"]), *(["r_asis", "l_asis"] if lower == "left" else ["l_asis", "r_asis"]), "l_th"]
        a, b = sorted(order.index(MARKERS[k]) for k in (i, j))
        assert got[sub, system, start, d, a, b] == pytest.approx(w)
    with pytest.raises(ValueError, match="head"):
        drivers.chosen_recordings(spark, f"{both}/*motion.tsv", f"{both}/*events.tsv", subjects, ["head"])


def test_lags_turn_with_their_ends(spark):
    e = spark.createDataFrame([("pp001", 0, 1, 0.5, 7.0), ("pp001", 1, 2, 0.4, -3.0)], "sub_id string, i int, j int, w double, lag_pct double")
    sides = spark.createDataFrame([("pp001", "left", "left")], "sub_id string, upper_side string, lower_side string")
    got = drivers.by_affected_side(e, sides, ["l_sho", "r_sho", "head"])
    assert sorted((r.i, r.j, r.w, r.lag_pct) for r in got.collect()) == [(0, 1, 0.4, 3.0), (1, 2, 0.5, -7.0)]
    full = drivers.by_affected_side(e, sides, ["l_sho", "r_sho", "head"], full=True)
    assert sorted((r.i, r.j) for r in full.collect()) == [(6, 7), (7, 8)]


def test_patterns_have_their_length(spark):
    """A path graph: walks that end early are no patterns of the length asked for."""
    rows = [(g, s, i, i + 1, 1.0 + i + g) for g in (0, 1) for s in (0, 1) for i in range(3)]
    graphs = spark.createDataFrame(rows, "grp int, label int, i int, j int, w double")
    found = {(r.length, r.start): list(r.pattern) for r in drivers.pattern_grid(graphs, ["label"], 5, 6).filter("grp = 0").collect()}
    assert found == {(2, 0): [0, 1], (3, 0): [0, 1, 2], (4, 0): [0, 1, 2, 3], (2, 1): [1, 2], (3, 1): [1, 2, 3], (2, 2): [2, 3], (2, 3): [3, 2], (3, 3): [3, 2, 1], (4, 3): [3, 2, 1, 0]}
