"""Hand-checked cases and invariants of the operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from motionweave.operators import cohort, graph, inference, matrix, paths, signal
from motionweave.sources import catalog
from motionweave.streaming import cycles


def contacts(spark, rights, lefts, n):
    rows = [(1, r, "R", n) for r in rights] + [(1, x, "L", n) for x in lefts]
    return spark.createDataFrame(rows, "trial long, frame long, side string, n long")


def loop_cycles(rights, lefts, n):
    out = []
    for r in sorted(rights)[:-1]:
        after = [x for x in sorted(lefts) if x > r]
        if len(after) >= 2 and after[1] <= n:
            out.append((r, after[1]))
    return out


def test_cycles(spark):
    found = signal.cycles_right_left_left(contacts(spark, [10, 110, 210], [60, 160, 260], 300), ["trial"])
    assert sorted((r.start, r.stop) for r in found.collect()) == [(10, 160), (110, 260)]
    rng = np.random.default_rng(0)
    for _ in range(4):
        frames = rng.permutation(60)[:24].tolist()
        r, x = frames[:11], frames[11:]
        found = signal.cycles_right_left_left(contacts(spark, r, x, 55), ["trial"])
        assert sorted((q.start, q.stop) for q in found.collect()) == sorted(loop_cycles(r, x, 55))


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = pd.DataFrame({"user_id": 1, "frame": np.arange(80), "side": rng.choice(["R", "L", "-"], 80)})
    rows = rows[rows.side != "-"]
    for k, part in enumerate(np.array_split(np.arange(len(rows)), 3)):
        spark.createDataFrame(rows.iloc[part]).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    source = spark.readStream.schema("user_id long, frame long, side string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = cycles.stream_cycles(source).writeStream.format("memory").queryName("cyc").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.start, r.stop) for r in spark.table("cyc").collect())
    r, x = rows.frame[rows.side == "R"].tolist(), rows.frame[rows.side == "L"].tolist()
    assert got == sorted(loop_cycles(r, x, 10**9))


def test_gaps(spark):
    rows = [(1, k, v) for k, v in enumerate([None, 1.0, None, None, 4.0, None, None, None, 8.0, None])]
    df = spark.createDataFrame(rows, "t long, f long, v double")
    assert signal.longest_gap(df, ["t"], "f", "v").first().longest_gap == 3
    filled = [r.v for r in signal.fill_gaps(df, ["t"], "f", "v", 2).orderBy("f").collect()]
    assert filled == [None, 1.0, 2.0, 3.0, 4.0, None, None, None, 8.0, None]
    assert signal.longest_gap(df.filter("f > 100"), ["t"], "f", "v").count() == 0


def test_trim_and_derivatives(spark):
    f = spark.createDataFrame([(1, k, float(k * k)) for k in range(10)], "t long, frame long, v double")
    e = spark.createDataFrame([(1, 2, "start"), (1, 7, "stop"), (1, 9, "start")], "t long, onset long, event_type string")
    cut = signal.trim(f, e, ["t"], "start", "stop")
    assert sorted((r.frame, r.v) for r in cut.collect()) == [(k - 2, float(k * k)) for k in range(2, 7)]
    v = signal.velocity(f, ["t"], ["frame"], ["v"], 200.0).orderBy("frame").collect()
    assert len(v) == 9 and v[0].v == pytest.approx(0.2)
    a = signal.acceleration(f, ["t"], ["frame"], ["v"], 200.0).collect()
    assert len(a) == 8 and all(r.v == pytest.approx(80.0) for r in a)


def test_rotation_keeps_length(spark):
    rng = np.random.default_rng(1)
    xy = rng.normal(size=(50, 2)) @ np.array([[3, 1], [0, 0.5]])
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in xy], "t long, x double, y double")
    got = np.array([(r.axis1, r.axis2) for r in signal.rotate(df, ["t"], "x", "y").collect()])
    assert np.allclose(np.sort(np.hypot(*got.T)), np.sort(np.hypot(*xy.T)))
    assert abs(np.cov(got.T)[0, 1]) < 1e-9 and np.var(got[:, 0]) > np.var(got[:, 1])


def test_pearson_guards_constants(spark):
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(size=30), rng.normal(size=30), np.ones(30)])
    df = spark.createDataFrame([(1, [float(v) for v in r]) for r in x], "k long, v array<double>")
    w = {(r.i, r.j): r.w for r in matrix.pearson(df, ["k"], "v", 3).collect()}
    assert w[0, 1] == pytest.approx(np.corrcoef(x[:, 0], x[:, 1])[0, 1])
    assert w[0, 2] is None and w[1, 2] is None


def test_pearson_with_gaps_and_salt(spark):
    rng = np.random.default_rng(4)
    x = 1e6 + rng.normal(size=(300, 4)).cumsum(0)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 3] = 7.0
    rows = [(k % 2, None if k == 5 else [None if np.isnan(v) else float(v) for v in r]) for k, r in enumerate(x)]
    x[5] = np.nan
    df = spark.createDataFrame(rows, "k long, v array<double>").repartition(7)
    for salt in (1, 5):
        w = {(r.k, r.i, r.j): r.w for r in matrix.pearson(df, ["k"], "v", 4, salt).collect()}
        for k in (0, 1):
            want = pd.DataFrame(x[k::2]).corr()
            assert len(w) == 12 and all(w[k, i, 3] is None for i in range(3))
            assert all(w[k, i, j] == pytest.approx(want[i][j], abs=1e-9) for i in range(3) for j in range(i + 1, 3))


def test_regions_and_sides_by_name(spark):
    names = ["l_a", "r_a", "m_b", "l_c", "x"]
    grid = spark.createDataFrame([(1, a, b, float(10 * a + b)) for a in range(5) for b in range(5)], "k long, a int, b int, d double")
    got = {(r.region_a, r.region_b): (r.d, r.cells) for r in matrix.summarise_regions(grid, ["k"], "d", names, {"A": ["l_a", "r_a"], "B": ["m_b", "gone"]}).collect()}
    assert got == {("A", "A"): (5.5, 4), ("A", "B"): (7.0, 2), ("B", "A"): (20.5, 2), ("B", "B"): (22.0, 1)}
    assert matrix.merged_sides(names) == ["avg_a", "avg_a", "m_b", "l_c", "x"]
    got = {(r.a, r.b): r.d for r in matrix.symmetric_pairs(grid, ["k"], "d", names).collect()}
    assert len(got) == 16 and got["avg_a", "l_c"] == 8.0 and got["x", "avg_a"] == 40.5


def edges_of(spark, rows):
    return spark.createDataFrame([(1, i, j, w) for i, j, w in rows], "g long, i int, j int, w double")


def test_shifted_graph(spark):
    got = {(r.i, r.j): r.w for r in graph.shifted(edges_of(spark, [(0, 1, -0.5), (0, 2, 0.2), (1, 2, 0.8)]), ["g"]).collect()}
    assert got == {(0, 1): 0.0, (0, 2): pytest.approx(0.7), (1, 2): pytest.approx(1.3)}


def test_greedy_path_and_prefix(spark):
    e = edges_of(spark, [(0, 1, 0.3), (0, 2, 0.9), (1, 2, 0.5)])
    m = paths.dense(e, ["g"], 3)
    assert m.select(paths.greedy(F.lit(0), 3)).first()[0] == [0, 2, 1]
    assert m.select(paths.greedy(F.lit(0), 2)).first()[0] == [0, 2]
    assert m.select(paths.greedy(F.lit(0), 3, False)).first()[0] == [0, 1, 2]


def test_components_and_clustering(spark):
    e = edges_of(spark, [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (3, 4, 1.0)])
    c = {r.node: r.component for r in graph.components(e, ["g"], 6).collect()}
    assert c == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}
    k = {r.node: r.coefficient for r in graph.clustering(e, ["g"], graph.nodes_of(e, ["g"], 6)).collect()}
    assert k == {0: 1, 1: 1, 2: 1, 3: 0, 4: 0, 5: 0}


def test_adjusted_rand(spark):
    df = spark.createDataFrame([(1, a, b) for a, b in ((0, 5), (0, 5), (1, 6), (1, 6))], "g long, a int, b int")
    assert graph.adjusted_rand(df, ["g"]).first().ari == 1.0
    one = spark.createDataFrame([(1, 0, 0), (1, 0, 0)], "g long, a int, b int")
    assert graph.adjusted_rand(one, ["g"]).first().ari == 1.0


def test_corrections(spark):
    df = spark.createDataFrame([(1, k, p) for k, p in enumerate([0.01, 0.02, 0.04])], "f long, t long, p double")
    b = [r.q for r in df.select("t", inference.bonferroni("p", ["f"]).alias("q")).orderBy("t").collect()]
    assert b == pytest.approx([0.03, 0.06, 0.12])
    h = [r.p_adjusted for r in inference.benjamini_hochberg(df, "p", ["f"], "t").orderBy("t").collect()]
    assert h == pytest.approx([0.03, 0.03, 0.04])


def test_permutations_stay_in_their_block(spark):
    nodes = spark.createDataFrame([(k, int(k >= 14)) for k in range(21)], "node long, block int")
    t = inference.permutation_table(nodes, 5, "x").toPandas()
    for _, g in t.groupby("iter"):
        assert sorted(g.old) == sorted(g.new) == list(range(21))
        assert ((g.old >= 14) == (g.new >= 14)).all()


def test_relabel_is_a_permutation(spark):
    e = edges_of(spark, [(0, 1, 0.1), (0, 2, 0.2), (1, 2, 0.3)])
    m = spark.createDataFrame([(1, 0, 2), (1, 1, 1), (1, 2, 0)], "g long, old int, new int")
    got = sorted((r.i, r.j, r.w) for r in matrix.relabel(e, m, ["g"], ["g"]).collect())
    assert got == [(0, 1, 0.3), (0, 2, 0.2), (1, 2, 0.1)]


def test_affected_side_ties(spark):
    df = spark.createDataFrame([(1, 0, 1, 2, 2, 1), (2, 1, 3, 3, 1, 1), (3, None, 3, 3, 1, 1)], "id long, handedness int, upper_right int, upper_left int, lower_right int, lower_left int")
    got = {r.id: (r.upper_side, r.lower_side) for r in cohort.more_affected(df).collect()}
    assert got == {1: ("left", "right"), 2: ("right", "right"), 3: ("left", "left")}


def test_motion_and_event_files(spark, tmp_path):
    (tmp_path / "sub-pp001_task-walk_run-on_tracksys-omc_motion.tsv").write_text("l_sho_POS_x\tl_sho_POS_x_err\tstart_1_POS_x\n1.5\t0\t9\nNaN\t0\t9\n2.5\t0\t9\n")
    m = catalog.read_motion(spark, str(tmp_path / "*motion.tsv")).orderBy("frame").collect()
    assert [(r.frame, r.marker, r.axis, r.value) for r in m] == [(0, "l_sho", "x", 1.5), (1, "l_sho", "x", None), (2, "l_sho", "x", 2.5)]
    (tmp_path / "sub-pp001_task-walk_run-on_events.tsv").write_text("onset\tevent_type\n3\tstart\n9\tstop\n")
    e = catalog.read_events(spark, str(tmp_path / "*events.tsv")).orderBy("onset").collect()
    assert [(r.sub_id, r.task, r.run, r.onset, r.event_type) for r in e] == [("pp001", "walk", "on", 3, "start"), ("pp001", "walk", "on", 9, "stop")]


def test_matrix_table_prunes(spark, tmp_path):
    e = edges_of(spark, [(0, 1, 0.5)]).select("*", *[F.lit(v).alias(k) for k, v in zip(catalog.MATRIX_KEYS, ("walk", "acc", "pears", "no", "yes"))])
    path = str(tmp_path / "m")
    catalog.write_matrices(e, path)
    assert catalog.read_matrices(spark, path, task="walk", kin="acc").count() == 1
    assert catalog.read_matrices(spark, path, task="run").count() == 0


def test_matrix_table_keeps_other_conditions(spark, tmp_path):
    """A second condition leaves the first in place; a large one is written by several tasks."""
    path, rows = str(tmp_path / "m"), spark.range(60_000).selectExpr("id AS g", "CAST(id % 9 AS INT) AS i", "9 AS j", "rand(3) AS w")
    parts = lambda kin, df: df.select("*", *[F.lit(v).alias(k) for k, v in zip(catalog.MATRIX_KEYS, ("walk", kin, "pears", "no", "yes"))])
    catalog.write_matrices(parts("acc", rows.limit(7)), path)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        catalog.write_matrices(parts("vel", rows), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert catalog.read_matrices(spark, path, kin="acc").count() == 7 and catalog.read_matrices(spark, path, kin="vel").count() == 60_000
    assert len(list((tmp_path / "m").glob("task=walk/kin=vel/**/*.parquet"))) > 2
    catalog.write_matrices(parts("vel", rows.limit(3)), path)
    assert catalog.read_matrices(spark, path, kin="acc").count() == 7 and catalog.read_matrices(spark, path, kin="vel").count() == 3


def test_cache_is_keyed_by_input_and_parameters(spark, tmp_path):
    e, path, calls = edges_of(spark, [(0, 1, 0.5), (1, 2, 0.25)]), str(tmp_path / "c"), []

    def read(table, runs):
        build = lambda: calls.append(runs) or table.withColumn("runs", F.lit(runs))
        return catalog.cached_table(spark, path, build, {"input": catalog.content_key(table), "runs": runs})

    for table, runs in ((e, 5), (e.orderBy(F.desc("i")), 5), (e, 6), (e.limit(1), 5), (e, 5)):
        got = read(table, runs)
        assert got.count() == table.count() and {r.runs for r in got.collect()} == {runs}
    assert calls == [5, 6, 5]
    assert not [p for p in (tmp_path / "c").iterdir() if p.name.startswith("_")]
    # A writer that finds another's table in place leaves it.
    other = lambda: read(e.limit(0), 7) and e.limit(0)
    assert catalog.cached_table(spark, path, other, {"input": catalog.content_key(e.limit(0)), "runs": 7}).columns[-1] == "runs"


def test_listing_chooses_before_reading(spark, tmp_path):
    for name in ("sub-pp001_task-walk_run-on_tracksys-omc_motion.tsv", "sub-pp001_task-walk_run-off_tracksys-omc_motion.tsv", "sub-pp002_task-walk_tracksys-omc_motion.tsv", "sub-pp003_task-walk_tracksys-omc_motion.tsv"):
        (tmp_path / name).write_text("l_sho_POS_x\tr_sho_POS_x\n1\t2\n" if "pp001" in name else "r_sho_POS_x\n3\n")
    for name in ("sub-pp001_task-walk_run-on_events.tsv", "sub-pp001_task-walk_run-off_events.tsv", "sub-pp002_task-walk_events.tsv"):
        (tmp_path / name).write_text("onset\tevent_type\n")
    subjects = spark.createDataFrame([("pp001", "off", "off"), ("pp002", "off", None), ("pp003", "off", None)], "sub_id string, asked string, run string")
    got = catalog.choose_recordings(catalog.listing(spark, f"{tmp_path}/*motion.tsv"), catalog.listing(spark, f"{tmp_path}/*events.tsv"), subjects)
    assert {(r.sub_id, r.run, r.name, r.log) for r in got.collect()} == {
        ("pp001", "off", "sub-pp001_task-walk_run-off_tracksys-omc_motion.tsv", "sub-pp001_task-walk_run-off_events.tsv"),
        ("pp002", None, "sub-pp002_task-walk_tracksys-omc_motion.tsv", "sub-pp002_task-walk_events.tsv"),
    }
    heads = catalog.layouts(spark, [str(p) for p in tmp_path.glob("*motion.tsv")])
    assert {h: len(f) for h, f in heads.items()} == {"l_sho_POS_x\tr_sho_POS_x": 2, "r_sho_POS_x": 2}
