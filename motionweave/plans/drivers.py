"""Whole analyses as single lazy plans, over tables in the engine's own layout.

Inputs: ``motion`` (sub_id, task, run, tracksys, frame, marker, axis, value), ``events`` (the
same keys, onset, event_type), ``demographics``, and edge tables (grp, sub_id, task, tracksys,
kin, cycle, direction, i, j, w).  The nested loops over subjects, tasks, runs and directions are key
columns, so one plan covers them all.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motionweave.functions.core import poisoned_avg, poisoned_std
from motionweave.operators import cohort, graph, inference, matrix, paths, signal
from motionweave.sources import catalog

TRIAL = ["sub_id", "task", "run", "tracksys"]
#: Keys of a graph that tell its condition; patterns are found and compared within one.
CONDITION = ("task", "tracksys", "kin", "direction")
AXES = ("x", "y", "z")
METHODS = ("pears", "cross", "dcor")
#: Marker patterns of the clusters that become one midpoint each.
CLUSTERS = (
    (r"^([lr])_th\d+$", "_th"), (r"^([lr])_sk\d+$", "_sk"), (r"^m_ster\d+$", "ster"), (r"^[lr][bf]_hd$", "head"), (r"^([lr])_wr[ru]$", "_wrist"),
)
DROPPED = r"_(ua|frm|heel)\d*$"


#: Order of the markers once sides are told by how affected they are: less, then more.
UPPER, LOWER = ("sho", "elbl", "wrist", "hand"), ("asis", "psis", "th", "sk", "ank", "toe")
AFFECTED_ORDER = ["head", "ster", *[f"{m}_{side}" for m in (*UPPER, *LOWER) for side in ("la", "ma")]]


def cluster_of(marker: Column) -> Column:
    """Midpoint name of a marker; itself if it is in no cluster, null if it is left out."""
    out = F.when(marker.rlike(DROPPED), F.lit(None).cast("string"))
    for pattern, name in CLUSTERS:
        named = F.concat(F.regexp_extract(marker, pattern, 1), F.lit(name)) if "([lr])" in pattern else F.lit(name)
        out = out.when(marker.rlike(pattern), named)
    return out.otherwise(marker)


def midpoint_names(columns: list[str]) -> set[str]:
    """Names that the position columns of a recording have after ``cluster_of``."""
    out = set()
    for marker in {m[1] for c in columns if (m := re.match(r"^(.*)_POS_[xyz]$", c))}:
        named = next((re.sub(p, (r"\1" if "([lr])" in p else "") + name, marker) for p, name in CLUSTERS if re.match(p, marker)), marker)
        out |= set() if re.search(DROPPED, marker) else {named}
    return out


def affected_names(markers: list[str], upper: str, lower: str) -> list[str]:
    """Names of the markers by affected side, in their own order; ``upper`` and ``lower`` are the more affected sides."""
    side = {"l": "left", "r": "right"}
    more = {m: upper for m in UPPER} | {m: lower for m in LOWER}
    return [f"{m[2:]}_{'ma' if side[m[0]] == more[m[2:]] else 'la'}" if m[1:2] == "_" and m[0] in side and m[2:] in more else m for m in markers]


def affected_order(markers: list[str], upper: str = "left", lower: str = "left") -> list[str]:
    """Names of the nodes after :func:`by_affected_side`: the fixed order first, then any other markers."""
    place = {m: k for k, m in enumerate(AFFECTED_ORDER)}
    return sorted(affected_names(markers, upper, lower), key=lambda m: place.get(m, len(place)))


def by_affected_side(edges: DataFrame, sides: DataFrame, markers: list[str], full: bool = False) -> DataFrame:
    """Matrices with their nodes in ``affected_order``; ``sides`` has sub_id, upper_side and lower_side.

    Lags change their sign where the two ends of an edge change places.
    """
    where = {(u, w): [affected_order(markers, u, w).index(m) for m in affected_names(markers, u, w)] for u in ("left", "right") for w in ("left", "right")}
    if full:
        where = {k: [3 * to + d for to in v for d in range(3)] for k, v in where.items()}
    moved = F.create_map(*[x for (u, w), v in where.items() for x in (F.lit(f"{u},{w}"), F.array(*map(F.lit, v)))])
    facts = sides.select("sub_id", F.concat_ws(",", "upper_side", "lower_side").alias("facts"))
    keys = [c for c in edges.columns if c not in ("i", "j", "w", "lag_pct")]
    return matrix.relabel_by(edges, facts, ["sub_id"], keys, lambda old, f: F.get(moved[f], old.cast("int")), ("lag_pct",))


def preprocess(motion: DataFrame, events: DataFrame, kinematics: str = "acc", *, fs: float = 200.0, max_gap: int = 271, rotate: bool = True) -> DataFrame:
    """Trim, midpoints, gap filling, low-pass, rotation, derivatives: (trial, pos, marker, axis, value).

    ``kinematics`` is pos, vel or acc.  Trials that a step cannot handle drop out of the plan.
    """
    channel = [*TRIAL, "marker", "axis"]
    cut = signal.trim(motion, events, TRIAL, "start", "stop")
    mid = signal.cluster_means(cut, [*TRIAL, "frame", "axis"], cluster_of(F.col("marker"))).withColumnRenamed("cluster", "marker")
    filled = signal.fill_gaps(mid, channel, "frame", "value", max_gap)
    smooth = signal.low_pass(filled, TRIAL, "frame", "value", 6.0, fs, ["marker", "axis"])
    if rotate:
        smooth = rotate_trials(smooth)
    if kinematics == "pos":
        return signal.number_frames(smooth, channel, ["frame"], "pos")
    v = complete_frames(_difference(smooth, channel, fs / 1000))
    if kinematics == "acc":
        v = signal.low_pass(complete_frames(_difference(v, channel, fs)), TRIAL, "frame", "value", 4.0, fs, ["marker", "axis"])
    return signal.number_frames(v, channel, ["frame"], "pos")


def _difference(df: DataFrame, channel: list[str], factor: float) -> DataFrame:
    w = signal.ordered(channel, "frame")
    return df.withColumn("value", (F.col("value") - F.lag("value").over(w)) * factor)


def complete_frames(df: DataFrame) -> DataFrame:
    """Frames in which no channel is missing (rows with any missing value go)."""
    w = signal.Window.partitionBy(*TRIAL, "frame")
    return df.withColumn("_ok", F.count(F.lit(1)).over(w) == F.count("value").over(w)).filter("_ok").drop("_ok")


def rotate_trials(df: DataFrame, pelvis: tuple[str, ...] = ("l_asis", "r_asis", "l_psis", "r_psis")) -> DataFrame:
    """Turn x and y of all markers onto the principal axes of the mid-hip track."""
    hip = df.filter(F.col("marker").isin(*pelvis) & F.col("axis").isin("x", "y")).groupBy(*TRIAL, "frame", "axis").agg(F.avg("value").alias("v"), F.count("value").alias("n"))
    at = lambda a: F.max(F.when(F.col("axis") == a, F.when(F.col("n") == len(pelvis), F.col("v"))))
    track = hip.groupBy(*TRIAL, "frame").agg(at("x").alias("x"), at("y").alias("y"))
    angle = track.groupBy(*TRIAL).agg((F.atan2(2 * F.covar_samp("x", "y"), F.var_samp("x") - F.var_samp("y")) / 2).alias("t"), (F.count(F.lit(1)) == F.count(F.col("x") + F.col("y"))).alias("whole"))
    angle = angle.filter("whole AND t IS NOT NULL").drop("whole")
    c, s = F.cos("t"), F.sin("t")
    one = F.when(F.abs(c) >= F.abs(s), F.signum(c)).otherwise(F.signum(s))
    two = F.when(F.abs(s) >= F.abs(c), F.signum(-s)).otherwise(F.signum(c))
    wide = df.groupBy(*TRIAL, "frame", "marker").agg(*[F.max(F.when(F.col("axis") == a, F.col("value"))).alias(a) for a in AXES])
    turned = wide.join(angle, TRIAL).select(*TRIAL, "frame", "marker", (one * (F.col("x") * c + F.col("y") * s)).alias("x"), (two * (F.col("y") * c - F.col("x") * s)).alias("y"), "z")
    return turned.unpivot([*TRIAL, "frame", "marker"], list(AXES), "axis", "value")


def gait_cycles(events: DataFrame, frames: DataFrame) -> DataFrame:
    """Cycles of every trial, numbered from its start event; ``frames`` (trial, pos) gives lengths."""
    start = events.filter("event_type = 'start'").groupBy(*TRIAL).agg(F.min("onset").alias("s"))
    stop = events.filter("event_type = 'stop'").groupBy(*TRIAL).agg(F.min("onset").alias("z"))
    n = frames.groupBy(*TRIAL).agg((F.max("pos") + 1).alias("n"))
    side = F.when(F.col("event_type") == "initial_contact_right", "R").when(F.col("event_type") == "initial_contact_left", "L")
    rows = events.withColumn("side", side).filter("side IS NOT NULL").join(start, TRIAL).join(stop, TRIAL).join(n, TRIAL)
    rows = rows.filter((F.col("onset") >= F.col("s")) & (F.col("onset") <= F.col("z"))).select(*TRIAL, (F.col("onset") - F.col("s")).alias("frame"), "side", "n")
    return signal.cycles_right_left_left(rows, TRIAL)


def build_matrices(signals: DataFrame, events: DataFrame, markers: list[str], *, method: str = "pears", interpol: bool = True, points: int = 500, full: bool = False) -> DataFrame:
    """Association matrices of every gait cycle: (trial, start, stop[, direction], i, j, w).

    ``method`` is pears (Pearson), cross (largest lagged cross-correlation, with its lag in
    percent as ``lag_pct``) or dcor (distance correlation; also the diagonal).  A cycle that
    lacks one of ``markers`` is left out.  With ``full`` channels of all directions form one
    matrix (index marker * 3 + direction).
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {', '.join(METHODS)}")
    number = F.create_map(*[F.lit(v) for k, m in enumerate(markers) for v in (m, k)])
    rows = signals.withColumns({"m": number[F.col("marker")], "direction": F.array_position(F.array(*map(F.lit, AXES)), F.col("axis")) - 1}).filter("m IS NOT NULL")
    cut = signal.segment(rows, gait_cycles(events, signals), TRIAL, "pos")
    keys = [*TRIAL, "start", "stop"]
    if interpol:
        cut = signal.resample(cut, [*keys, "m", "direction"], "pos", "value", points).withColumnRenamed("k", "pos")
    group = keys if full else [*keys, "direction"]
    index = F.col("m") * 3 + F.col("direction") if full else F.col("m")
    size = len(markers) * (3 if full else 1)
    packed = cut.groupBy(*group, "pos").agg(F.map_from_entries(F.collect_list(F.struct(index.cast("int").alias("k"), "value"))).alias("_m"), F.count(F.lit(1)).alias("_n"))
    whole = packed.filter(F.col("_n") == size)
    array = whole.select(*group, "pos", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.try_element_at("_m", k)).alias("v"))
    if method == "cross":
        return matrix.lagged(array, group, "pos", "v").withColumnRenamed("r", "w").drop("lag")
    if method == "dcor":
        return matrix.distance_correlations(array, group, "pos", "v").withColumnRenamed("dcor", "w")
    return matrix.pearson(array, group, "v", size)


def calculate_matrices(motion: DataFrame, events: DataFrame, markers: list[str], path: str, *, kinematics: list[str] = ["acc"], method: str = "pears", interpol: bool = True, points: int = 500, full: bool = False, sides: DataFrame | None = None, **options) -> None:
    """From recordings to a matrix table at ``path``, partitioned by condition; one plan for each kind of kinematics.

    With ``sides`` every matrix is reordered by its subject's affected side before it is written.
    """
    parts = []
    for kin in kinematics:
        edges = build_matrices(preprocess(motion, events, kin, **options), events, markers, method=method, interpol=interpol, points=points, full=full)
        if sides is not None:
            edges = by_affected_side(edges, sides, markers, full)
        condition = {"kin": kin, "method": method, "full": "full" if full else "split", "interpol": "yes" if interpol else "no"}
        parts.append(edges.withColumns({k: F.lit(v) for k, v in condition.items()}))
    catalog.write_matrices(reduce(DataFrame.unionByName, parts), path)


def grouped(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edge tables with the subjects' groups (``groups``: sub_id, grp) and a number for each cycle."""
    w = Window.partitionBy(*[c for c in (*TRIAL, "kin", "direction") if c in edges.columns], "i", "j")
    return edges.join(groups, "sub_id").withColumn("cycle", F.row_number().over(w.orderBy("start")) - 1)


def pattern_grid(graphs: DataFrame, keys: list[str], n: int, longest: int = 20, starts: list[int] | None = None) -> DataFrame:
    """Group patterns of every (length, start) and condition: (grp, condition, length, start, pattern).

    Each graph is walked once per start; shorter paths are prefixes.  Edge means are taken
    anew for each length, as a longer path adds steps.  A walk that ends before its length is no
    pattern of that length and is left out.
    """
    group = ["grp", *[k for k in keys if k in CONDITION]]
    start = F.explode(F.array(*map(F.lit, starts if starts is not None else range(n))))
    walked = paths.dense(graphs, ["grp", *keys], n).withColumn("start", start)
    walked = walked.select("grp", *keys, "start", paths.greedy(F.col("start"), longest).alias("whole"))
    cut = walked.withColumn("length", F.explode(F.sequence(F.lit(2), F.lit(longest)))).filter("size(whole) >= length")
    steps = paths.steps_of(cut.withColumn("path", F.slice("whole", 1, F.col("length"))).drop("whole"), "path")
    mean = paths.along(graphs, steps, ["grp", *keys]).groupBy(*group, "length", "start", F.col("u").alias("i"), F.col("v").alias("j")).agg(F.avg("w").alias("w"))
    m = paths.dense(mean, [*group, "length", "start"], n, directed=True)
    # The fold runs to the longest length; the slice is the group's own greedy path of that length.
    found = m.select(*group, "length", "start", F.slice(paths.greedy(F.col("start"), longest), 1, F.col("length")).alias("pattern"))
    return found.filter(F.size("pattern") == F.col("length"))


def analyse_patterns(graphs: DataFrame, keys: list[str], n: int, *, longest: int = 20, starts: list[int] | None = None, pattern_grp: int = 0, groups: tuple[int, int] = (1, 0), two_stage: bool = False) -> DataFrame:
    """Patterns of one group scored in every graph of their condition, both groups compared, p corrected per condition and length."""
    patterns = pattern_grid(graphs, keys, n, longest, starts).filter(F.col("grp") == pattern_grp).drop("grp")
    condition = [k for k in keys if k in CONDITION]
    scores = paths.score_patterns(patterns, graphs, ["length", "start"], ["grp", *keys], condition)
    tests = inference.compare_groups(scores, ["length", "start", *condition], "grp", "path_sum", *groups).withColumn("p_value", F.bround("p_value", 3))
    if two_stage:
        return inference.two_stage(tests, "p_value", ["length", *condition])
    return tests.withColumn("p_adjusted", inference.bonferroni("p_value", ["length", *condition]))


def expand_blocks(blocks: list[int], full: bool) -> list[int]:
    """Blocks of nodes to shuffle; in a full matrix each marker has three nodes, one per direction."""
    return [b for b in blocks for _ in range(3 if full else 1)]


def _sides(means: DataFrame, keys: list[str], first, second) -> DataFrame:
    side = lambda g: F.max(F.when(F.col("grp") == g, F.col("avg")))
    return means.groupBy(*keys, "i", "j").agg(side(first).alias("x"), side(second).alias("y"))


def compare_between_groups(
    edges: DataFrame, keys: list[str], blocks: list[int], *, value: str = "avg", first=0, second=1, permutations: int = 10_000, bootstraps: int = 5_000, share: float = 0.8,
    shares: list[float] | None = None, full: bool = False, seed: str = "compare",
) -> dict[str, DataFrame]:
    """Rank correlation of two groups' mean (or deviation) matrices, per ``keys``.

    ``permutation`` has rho with its permutation p, ``bootstrap`` the summary over samples of
    ``share`` of each group's subjects, and ``sweep`` (with ``shares``) that for every share.
    ``blocks`` has one entry for each marker; ``full`` matrices have three nodes for each.
    """
    nodes = expand_blocks(blocks, full)
    stats = matrix.cycle_statistics(edges, ["grp", "sub_id", *keys])
    pairs = _sides(stats.groupBy("grp", *keys, "i", "j").agg(F.avg(value).alias("avg")), keys, first, second)
    cells = F.array_sort(F.collect_list(F.struct("i", "j", F.col(value).alias("v"))))
    vectors = stats.groupBy("grp", "sub_id", *keys).agg(F.transform(cells, lambda c: c["v"]).alias("v"))
    size = len(nodes) * (len(nodes) - 1) // 2
    observed = inference.spearman(pairs, keys).withColumnRenamed("rho", "obs")

    def samples(shares: list[float] | None) -> DataFrame:
        rho = inference.bootstrap(vectors.filter(F.size("v") == size), keys, "grp", "sub_id", (first, second), size, bootstraps, share, seed, shares)
        return inference.summary(rho.join(observed, keys), [*keys, "share"] if shares else keys, "rho", "obs")

    out = {"permutation": inference.permutation_test(pairs, keys, nodes, permutations, seed), "bootstrap": samples(None)}
    return out | ({"sweep": samples(shares)} if shares else {})


def time_lags(edges: DataFrame, keys: list[str], *, first=0, second=1) -> dict[str, DataFrame]:
    """Lag matrices (column ``lag_pct`` per cycle): means of subjects and groups, and the tests between groups."""
    subjects = edges.groupBy("grp", "sub_id", *keys, "i", "j").agg(poisoned_avg("lag_pct").alias("avg"), poisoned_std("lag_pct").alias("std"))
    groups = subjects.groupBy("grp", *keys, "i", "j").agg(F.avg("avg").alias("avg"), F.stddev_pop("avg").alias("std"))
    return {"subjects": subjects, "groups": groups, "tests": inference.lag_tests(subjects, keys, "grp", "avg", first, second)}


def modular_organisation(
    edges: DataFrame, graph_keys: list[str], n: int, path: str, *, runs: int = 100, threshold: float = 0.6, first=1, second=0, blocks: list[int] | None = None, permutations: int = 5_000, full: bool = False
) -> dict[str, DataFrame]:
    """Louvain allegiance per subject, communities, fit, modularity and density, with their tests.

    ``edges`` has grp, sub_id, the graph keys (one of them ``cycle``) and i, j, w.  The
    allegiance is built once for the same edges, keys, nodes and runs, as a table below ``path``
    that later calls read; all else comes from it.  With ``blocks`` the groups' matrices are also compared by permutation.
    ``n`` and ``blocks`` are by marker; ``full`` matrices have three nodes for each.
    """
    n *= 3 if full else 1
    keys = [k for k in graph_keys if k != "cycle"]

    def build() -> DataFrame:
        members = graph.louvain_memberships(graph.shifted(edges, ["grp", *graph_keys]), ["grp", *graph_keys], n, runs)
        return graph.allegiance(members.withColumn("_run", F.struct("cycle", "run")), ["grp", *keys], "_run", n)

    key = {"edges": catalog.content_key(edges.select("grp", *graph_keys, "i", "j", "w")), "keys": graph_keys, "nodes": n, "runs": runs}
    own = catalog.cached_table(edges.sparkSession, path, build, key)
    shared = [k for k in keys if k != "sub_id"]
    mean = graph.group_allegiance(own, ["grp", *keys], ["grp", *shared], n)

    def communities(e: DataFrame, k: list[str]) -> DataFrame:
        return graph.components(e, k, n, [threshold]).drop("threshold").withColumnRenamed("component", "community")

    group_c, subject_c = communities(mean, ["grp", *shared]), communities(own, ["grp", *keys])
    spread = own.select("grp", *keys).distinct().join(group_c, ["grp", *shared])
    labels = subject_c.withColumnRenamed("community", "a").join(group_c.withColumnRenamed("community", "b"), ["grp", *shared, "node"])
    fit, scores = graph.adjusted_rand(labels, ["grp", *keys]), graph.modularity(own, spread, ["grp", *keys])
    out = {
        "allegiance": own,
        "group_allegiance": mean,
        "group_communities": group_c,
        "subject_communities": subject_c,
        "fit": fit,
        "fit_tests": inference.compare_groups(fit, shared, "grp", "ari", first, second, gate_n=0, equal_gate=False, less=True),
        "modularity": scores,
        "group_modularity": graph.modularity(mean.select("grp", *shared, "i", "j", "w"), group_c, ["grp", *shared], alone=True),
        "modularity_tests": inference.compare_groups(scores, shared, "grp", "modularity", first, second, gate_n=0, equal_gate=False),
        "density": graph.community_density(own, spread, ["grp", *keys]),
        "group_density": graph.community_density(mean.select("grp", *shared, "i", "j", "w"), group_c, ["grp", *shared]),
    }
    if blocks:
        pairs = _sides(mean.withColumnRenamed("w", "avg"), shared, first, second)
        out["permutation"] = inference.permutation_test(pairs, shared, expand_blocks(blocks, full), permutations, "allegiance")
    return out


def chosen_recordings(spark: SparkSession, recordings: str, logs: str, subjects: DataFrame, markers: list[str]) -> tuple[DataFrame, DataFrame]:
    """Motion and events of the subjects' recordings, one for each task and tracking system; no other file is read.

    ``subjects`` has sub_id, asked and run.  A marker that no recording has is an error.
    """
    chosen = catalog.choose_recordings(catalog.listing(spark, recordings), catalog.listing(spark, logs), subjects)
    files = chosen.collect()  # a row a recording: the reader takes their paths
    keys = spark.createDataFrame([(*[r[k] or "" for k in TRIAL], r["name"], r["log"]) for r in files], ", ".join(f"{k} string" for k in TRIAL) + ", name string, log string")
    paths_, logs_ = sorted({r.path for r in files}), sorted({r.log_path for r in files})
    seen = set().union(*[midpoint_names(head.split("\t")) for head in catalog.layouts(spark, paths_)])
    if missing := [m for m in markers if m not in seen]:
        raise ValueError(f"no recording has {', '.join(missing)}")
    motion = catalog.read_motion(spark, paths_).join(keys.drop("log"), "name").drop("name")
    rows = catalog.read_events(spark, logs_).select(F.col("name").alias("log"), "onset", "event_type")
    return motion, rows.join(keys.drop("name"), "log").drop("log")


def analyse(
    spark: SparkSession, recordings: str, logs: str, demographics: str, markers: list[str], out: str, *, diagnosis: str = "diagnosis_parkinson", run: str = "on", on_ids: list[str] = [],
    kinematics: str = "acc", task: str | None = None, direction: int | None = None, points: int = 500, longest: int = 20, two_stage: bool = False, **options,
) -> dict[str, DataFrame]:
    """The whole analysis: recordings to matrices, written below ``out``, to patterns that are tested and corrected.

    Files are chosen by subject, task, tracking system and run before any is read: patients have
    the asked run (``on_ids``: 'on', as their files do not say so), controls the files without
    one.  Every matrix is reordered by affected side (``affected_order`` names its nodes).  ``task`` and
    ``direction`` choose the condition that is tested (each by itself without them).  The tests
    are stored by their input and parameters.  Returns the matrices (as they were written and
    read back), the groups, and the tests.
    """
    people = catalog.read_demographics(spark, demographics)
    patients = cohort.select_subjects(people, [diagnosis], run).count()  # as many controls; demographics are a small table
    named = cohort.define_groups(people, diagnosis, run, patients)
    asked = F.when(F.col("sub_id").isin(on_ids), "on").otherwise(run)
    subjects = cohort.resolve_run(named.withColumns({"run": F.lit(run), "asked": asked}), on_ids).select("sub_id", "asked", "run")
    motion, events = chosen_recordings(spark, recordings, logs, subjects, markers)
    sides = cohort.affected_sides(people, subjects)
    calculate_matrices(motion, events, markers, f"{out}/matrices", kinematics=[kinematics], points=points, sides=sides, **options)
    matrices = catalog.read_matrices(spark, f"{out}/matrices", kin=kinematics, method="pears")
    groups = named.select("sub_id", F.when(F.col("grp") == "control", 0).otherwise(1).alias("grp"))
    wanted = F.lit(True)
    for c, v in (("task", task), ("direction", direction)):
        wanted = wanted & (F.col(c) == v) if v is not None else wanted
    edges, keys = grouped(matrices.filter(wanted), groups), ["sub_id", "task", "tracksys", "direction"]
    mean = matrix.cycle_statistics(edges, ["grp", *keys]).select("grp", *keys, "i", "j", F.col("avg").alias("w"))
    parameters = {"graphs": catalog.content_key(mean), "nodes": len(markers), "longest": longest, "two_stage": two_stage}
    build = lambda: analyse_patterns(graph.shifted(mean, ["grp", *keys]), keys, len(markers), longest=longest, two_stage=two_stage)
    tests = catalog.cached_table(spark, f"{out}/pattern-statistics", build, parameters)
    catalog.write_csv(tests, f"{out}/pattern-tests")
    return {"matrices": matrices, "groups": groups, "tests": tests}
