"""Queries on matrices, graphs and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motionweave.functions.core import r6
from motionweave.operators import cohort, graph, matrix, paths
from motionweave.plans.adapters import (
    CHANNELS, DEMO, DIFF, E, EDGE_KEYS, GRPM, MARKERS, S, SGRAPH, SHIFT, SUBJ, SUBJECT_KEYS, channel_rows, demographics, differences, directed_samples, edges, group_means, query, samples,
    shifted_graphs, subject_edges, subject_graphs,
)
from motionweave.sources import catalog

THRESHOLDS = [0.2, 0.4, 0.6, 0.8]
#: Cuts of the dense networks that make the partitions of which allegiance is the mean.
COMMUNITY_THRESHOLDS = [0.9, 1.0, 1.1, 1.2]


@query("pearson_matrix", f"WITH {E} SELECT label, cycle, direction, i, j, round(w, 6) + 0.0 AS w FROM edges")
def pearson_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _ij(edges(spark, sf)).withColumn("w", r6("w"))


def _ij(df: DataFrame) -> DataFrame:
    return df.withColumns({"i": F.col("i").cast("long"), "j": F.col("j").cast("long")})


@query(
    "pearson_matrix_full",
    f"""WITH {S} SELECT a.label, a.direction * 21 + a.m AS i, b.direction * 21 + b.m AS j, round(CASE WHEN stddev_pop(a.v) > 0 AND stddev_pop(b.v) > 0 THEN corr(a.v, b.v) END, 6) + 0.0 AS w
FROM lng a JOIN lng b ON a.label = b.label AND a.frame = b.frame AND a.direction * 21 + a.m < b.direction * 21 + b.m GROUP BY ALL""",
)
def pearson_matrix_full(spark: SparkSession, sf: str) -> DataFrame:
    return _ij(matrix.pearson(samples(spark, sf), ["label"], "v", 63)).withColumn("w", r6("w"))


_LAG = f"""{S}, x AS (SELECT label, cycle, direction, frame, m, v - avg(v) OVER w AS v, count(*) OVER w AS n FROM lng WINDOW w AS (PARTITION BY label, cycle, direction, m)),
nrm AS (SELECT label, cycle, direction, m, sum(v * v) AS q FROM x GROUP BY ALL),
r AS (SELECT a.label, a.cycle, a.direction, a.m AS i, b.m AS j, a.n, a.frame - b.frame AS lag, sum(a.v * b.v) AS c FROM x a JOIN x b ON a.label = b.label AND a.cycle = b.cycle AND a.direction = b.direction AND a.m < b.m GROUP BY ALL),
k AS (SELECT r.label, r.cycle, r.direction, i, j, n, lag, c / sqrt(p.q * q.q) AS r FROM r JOIN nrm p ON p.label = r.label AND p.cycle = r.cycle AND p.direction = r.direction AND p.m = i
  JOIN nrm q ON q.label = r.label AND q.cycle = r.cycle AND q.direction = r.direction AND q.m = j WHERE p.q * q.q > 0),
lagged AS (SELECT label, cycle, direction, i, j, lag, r, round_even(lag / n * 100, 0) AS lag_pct FROM (SELECT *, row_number() OVER (PARTITION BY label, cycle, direction, i, j ORDER BY round(abs(r), 9) DESC, lag) AS rk FROM k) WHERE rk = 1),
slag AS (SELECT label, direction, i, j, avg(lag_pct) AS lag_pct FROM lagged GROUP BY ALL)"""


def _lagged(spark: SparkSession, sf: str) -> DataFrame:
    """Lags of every pair of channels of every subject, cycle and direction."""
    return matrix.lagged(directed_samples(spark, sf), EDGE_KEYS, "frame", "v")


def _subject_lags(spark: SparkSession, sf: str) -> DataFrame:
    """Mean lag over the cycles of every subject and direction."""
    return _lagged(spark, sf).groupBy((F.col("label") % 2).alias("grp"), *SUBJECT_KEYS, "i", "j").agg(F.avg("lag_pct").alias("lag_pct"))


@query("lagged_xcorr", f"WITH {_LAG} SELECT label, cycle, direction, i, j, lag, round(r, 6) + 0.0 AS r, lag_pct + 0.0 AS lag_pct FROM lagged")
def lagged_xcorr(spark: SparkSession, sf: str) -> DataFrame:
    return _lagged(spark, sf).withColumns({"r": r6("r"), "lag_pct": F.col("lag_pct") + F.lit(0.0)})


@query("lag_group_statistics", f"WITH {_LAG} SELECT label % 2 AS grp, direction, i, j, round(avg(lag_pct), 6) + 0.0 AS mean, round(stddev_pop(lag_pct), 6) + 0.0 AS std FROM slag GROUP BY ALL")
def lag_group_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return _subject_lags(spark, sf).groupBy("grp", "direction", "i", "j").agg(r6(F.avg("lag_pct")).alias("mean"), r6(F.stddev_pop("lag_pct")).alias("std"))


@query(
    "distance_corr",
    f"""WITH {S}, x AS (SELECT label, cycle, direction, frame, m, v FROM lng),
d AS (SELECT a.label, a.cycle, a.direction, a.m, a.frame AS f, b.frame AS g, abs(a.v - b.v) AS d FROM x a JOIN x b ON a.label = b.label AND a.cycle = b.cycle AND a.direction = b.direction AND a.m = b.m),
c AS (SELECT label, cycle, direction, m, f, g, d - avg(d) OVER (PARTITION BY label, cycle, direction, m, f) - avg(d) OVER (PARTITION BY label, cycle, direction, m, g) + avg(d) OVER (PARTITION BY label, cycle, direction, m) AS a FROM d),
p AS (SELECT x.label, x.cycle, x.direction, x.m AS i, y.m AS j, avg(x.a * y.a) AS xy, avg(x.a * x.a) AS xx, avg(y.a * y.a) AS yy FROM c x JOIN c y ON x.label = y.label AND x.cycle = y.cycle AND x.direction = y.direction AND x.f = y.f AND x.g = y.g AND x.m <= y.m GROUP BY ALL)
SELECT label, cycle, direction, i, j, round(CASE WHEN xx * yy > 0 THEN sqrt(greatest(xy, 0.0) / sqrt(xx * yy)) ELSE 0.0 END, 6) + 0.0 AS dcor FROM p""",
)
def distance_corr(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.distance_correlations(directed_samples(spark, sf), EDGE_KEYS, "frame", "v").withColumn("dcor", r6("dcor"))


_SIDE = f"""{SUBJ}, {DEMO}, side AS (SELECT id AS label, CASE WHEN upper_right > upper_left THEN 'right' WHEN upper_right < upper_left THEN 'left' WHEN handedness = 1 THEN 'right' ELSE 'left' END AS u,
  CASE WHEN lower_right > lower_left THEN 'right' WHEN lower_right < lower_left THEN 'left' WHEN handedness = 1 THEN 'right' ELSE 'left' END AS l FROM demo),
map AS (SELECT label, o AS old, CASE WHEN o = 20 THEN 20 WHEN (o < 14 AND u = 'left') OR (o >= 14 AND l = 'left') THEN o + 1 - 2 * (o % 2) ELSE o END AS new FROM side, range(21) t(o))"""


@query(
    "affected_side_reorder",
    f"WITH {_SIDE} SELECT s.label, s.direction, least(a.new, b.new) AS i, greatest(a.new, b.new) AS j, round(s.avg, 6) + 0.0 AS w FROM subj s JOIN map a ON a.label = s.label AND a.old = s.i JOIN map b ON b.label = s.label AND b.old = s.j",
)
def affected_side_reorder(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes 2k and 2k+1 are the right and left marker; the less affected side comes first."""
    side = cohort.more_affected(demographics(spark, sf))
    facts = side.select(F.col("id").alias("label"), F.struct(*[(F.col(f"{part}_side") == "left").alias(part) for part in ("upper", "lower")]).alias("facts"))

    def new(old: Column, facts: Column) -> Column:
        left = F.when(old < 14, facts["upper"]).otherwise(facts["lower"])
        return F.when((old < 20) & left, old + 1 - 2 * (old % 2)).otherwise(old)

    mean = subject_edges(spark, sf).select("label", "direction", "i", "j", F.col("avg").alias("w"))
    return _ij(matrix.relabel_by(mean, facts, ["label"], SUBJECT_KEYS, new)).withColumn("w", r6("w"))


@query("cycle_mean_std_matrix", f"WITH {SUBJ} SELECT grp, label, direction, i, j, round(avg, 6) + 0.0 AS avg, round(std, 6) + 0.0 AS std, n FROM subj")
def cycle_mean_std_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _ij(subject_edges(spark, sf)).withColumns({"avg": r6("avg"), "std": r6("std")})


@query("group_mean_matrix", f"WITH {GRPM} SELECT grp, direction, i, j, avg + 0.0 AS avg, std + 0.0 AS std FROM grpm")
def group_mean_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _ij(group_means(spark, sf))


@query("group_edge_weights", f"WITH {SUBJ} SELECT grp, direction, i, j, round(avg(avg), 6) + 0.0 AS w, count(avg) AS n FROM subj GROUP BY ALL")
def group_edge_weights(spark: SparkSession, sf: str) -> DataFrame:
    return _ij(subject_edges(spark, sf)).groupBy("grp", "direction", "i", "j").agg(r6(F.avg("avg")).alias("w"), F.count("avg").alias("n"))


@query("rollup_means", f"WITH {SUBJ} SELECT grp, direction, round(avg(avg), 6) + 0.0 AS w, count(*) AS n FROM subj GROUP BY ROLLUP (grp, direction)")
def rollup_means(spark: SparkSession, sf: str) -> DataFrame:
    return subject_edges(spark, sf).rollup("grp", "direction").agg(r6(F.avg("avg")).alias("w"), F.count(F.lit(1)).alias("n"))


@query("difference_matrix", f"WITH {DIFF} SELECT direction, i, j, round(d, 6) + 0.0 AS d FROM diff")
def difference_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _ij(differences(spark, sf)).withColumn("d", r6("d"))


_RANK = f"""{DIFF}, rk AS (SELECT direction, node, total, row_number() OVER (PARTITION BY direction ORDER BY total DESC, node) AS rank FROM (
  SELECT direction, node, round(sum(abs(d)), 9) AS total FROM (SELECT direction, i AS node, d FROM diff UNION ALL SELECT direction, j, d FROM diff) GROUP BY ALL))"""


@query("difference_rank", f"WITH {_RANK} SELECT direction, node, round(total, 6) + 0.0 AS total, rank FROM rk")
def difference_rank(spark: SparkSession, sf: str) -> DataFrame:
    out = matrix.difference_rank(differences(spark, sf), ["direction"])
    return out.select("direction", F.col("node").cast("long").alias("node"), r6("total").alias("total"), F.col("rank").cast("long").alias("rank"))


_GRID = f"""{DIFF}, grid AS (SELECT direction, i AS a, j AS b, d FROM diff UNION ALL SELECT direction, j, i, d FROM diff UNION ALL SELECT direction, m, m, 0.0 FROM range(3) x(direction), range(21) y(m))"""


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.full_grid(differences(spark, sf), ["direction"], "d", F.lit(0.0), CHANNELS)


#: Anatomical regions by marker (fixed values); sides are named as right and left here.
REGIONS = {
    "trunk": ["head", "m_ster"],
    "pelvis": ["l_psis", "r_psis", "l_asis", "r_asis"],
    "left arm": ["l_sho", "l_elbl", "l_wrist", "l_hand"],
    "right arm": ["r_sho", "r_elbl", "r_wrist", "r_hand"],
    "left leg": ["l_th", "l_sk", "l_ank", "l_toe"],
    "right leg": ["r_th", "r_sk", "r_ank", "r_toe"],
}
_NAMES = f"{_GRID}, names AS (SELECT row_number() OVER () - 1 AS node, name FROM (SELECT unnest({MARKERS}) AS name))"


@query(
    "region_summary",
    f"""WITH {_NAMES}, reg AS (SELECT node, CASE WHEN name IN ('head', 'm_ster') THEN 'trunk' WHEN name[3:] IN ('psis', 'asis') THEN 'pelvis' WHEN name[3:] IN ('sho', 'elbl', 'wrist', 'hand') THEN if(name[:1] = 'l', 'left', 'right') || ' arm'
  WHEN name[3:] IN ('th', 'sk', 'ank', 'toe') THEN if(name[:1] = 'l', 'left', 'right') || ' leg' END AS region FROM names)
SELECT direction, p.region AS region_a, q.region AS region_b, round(avg(d), 7) + 0.0 AS d, count(*) AS cells FROM grid JOIN reg p ON p.node = a JOIN reg q ON q.node = b WHERE p.region IS NOT NULL AND q.region IS NOT NULL GROUP BY ALL""",
)
def region_summary(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.summarise_regions(_grid(spark, sf), ["direction"], "d", MARKERS, REGIONS).withColumn("d", F.round("d", 7))


@query(
    "symmetric_pair_average",
    f"""WITH {_NAMES}, side AS (SELECT l.node AS l, r.node AS r, 'avg_' || l.name[3:] AS name FROM names l JOIN names r ON l.name[:2] = 'l_' AND r.name = 'r_' || l.name[3:]),
ends AS (SELECT name, l AS one, r AS two FROM side UNION ALL SELECT name, node, node FROM names WHERE node NOT IN (SELECT l FROM side UNION ALL SELECT r FROM side)),
v AS (SELECT direction, a AS x, b AS y, d FROM grid)
SELECT p.direction, m.name AS a, n.name AS b, round((p.d + q.d + s.d + t.d) / 4, 6) + 0.0 AS d FROM ends m, ends n JOIN v p ON p.x = m.one AND p.y = n.one JOIN v q ON q.direction = p.direction AND q.x = m.one AND q.y = n.two
JOIN v s ON s.direction = p.direction AND s.x = m.two AND s.y = n.one JOIN v t ON t.direction = p.direction AND t.x = m.two AND t.y = n.two""",
)
def symmetric_pair_average(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.symmetric_pairs(_grid(spark, sf), ["direction"], "d", MARKERS).withColumn("d", r6("d"))


@query(
    "difference_histogram",
    f"""WITH {DIFF}, m AS (SELECT direction, min(d) AS lo, max(d) AS hi FROM diff GROUP BY ALL)
SELECT direction, coalesce(least(floor((d - lo) / nullif(hi - lo, 0) * 20), 19), 0)::BIGINT AS bin, count(*) AS n FROM diff JOIN m USING (direction) GROUP BY ALL""",
)
def difference_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.histogram(differences(spark, sf), ["direction"], "d", 20)


@query("difference_p98", f"WITH {DIFF} SELECT direction, round(quantile_cont(abs(d), 0.98), 6) + 0.0 AS bound, round(avg(d), 6) + 0.0 AS mean FROM diff GROUP BY ALL")
def difference_p98(spark: SparkSession, sf: str) -> DataFrame:
    return differences(spark, sf).groupBy("direction").agg(r6(F.percentile(F.abs("d"), 0.98)).alias("bound"), r6(F.avg("d")).alias("mean"))


@query("matrix_bounds", f"WITH {SUBJ} SELECT grp, direction, round(min(avg), 6) + 0.0 AS low, round(max(avg), 6) + 0.0 AS high FROM subj GROUP BY ALL")
def matrix_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return subject_edges(spark, sf).groupBy("grp", "direction").agg(r6(F.min("avg")).alias("low"), r6(F.max("avg")).alias("high"))


@query("expanded_markers", f"WITH {S} SELECT DISTINCT m AS marker, direction, 'm' || m || '_' || ['AP', 'ML', 'V'][direction + 1] AS name, m * 3 + direction AS idx FROM lng")
def expanded_markers(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of a full matrix: every channel that the samples have, in each of its directions."""
    rows = channel_rows(spark, sf).select(F.col("m").alias("marker"), "direction").distinct()
    axis = F.element_at(F.array(F.lit("AP"), F.lit("ML"), F.lit("V")), F.col("direction").cast("int") + 1)
    return rows.select("marker", "direction", F.concat(F.lit("m"), F.col("marker").cast("string"), F.lit("_"), axis).alias("name"), (F.col("marker") * 3 + F.col("direction")).alias("idx"))


_EDGES = [(i, j) for i in range(CHANNELS) for j in range(i + 1, CHANNELS)]


@query("pivot_edge_table", "SELECT label, direction, " + ", ".join(
    f"coalesce(max(CASE WHEN i = {i} AND j = {j} THEN printf('%.2f', round(avg, 2) + 0.0) END), 'nan') AS e{i}_{j}" for i, j in _EDGES
) + f" FROM (WITH {SUBJ} SELECT * FROM subj) GROUP BY label, direction")
def pivot_edge_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = subject_edges(spark, sf).withColumn("edge", F.format_string("e%d_%d", "i", "j"))
    return catalog.pivot_edges(rows, SUBJECT_KEYS, "edge", "avg", [f"e{i}_{j}" for i, j in _EDGES])


# --- graphs -----------------------------------------------------------------------------


@query("shifted_graph", f"WITH {SHIFT} SELECT label, cycle, direction, i, j, round(w, 6) + 0.0 AS w FROM shifted WHERE w >= 0.3")
def shifted_graph(spark: SparkSession, sf: str) -> DataFrame:
    return _ij(graph.shifted(edges(spark, sf), EDGE_KEYS, 0.3)).withColumn("w", r6("w"))


_DEG = f"""{SHIFT}, deg AS (SELECT g.label, g.cycle, g.direction, n.m AS node, coalesce(sum(e.w), 0.0) AS degree FROM (SELECT DISTINCT label, cycle, direction FROM edges) g, range(21) n(m)
  LEFT JOIN (SELECT label, cycle, direction, i AS node, w FROM shifted UNION ALL SELECT label, cycle, direction, j, w FROM shifted) e ON e.label = g.label AND e.cycle = g.cycle AND e.direction = g.direction AND e.node = n.m GROUP BY ALL)"""


def _degrees(spark: SparkSession, sf: str) -> DataFrame:
    g = shifted_graphs(spark, sf)
    return graph.weighted_degree(g, EDGE_KEYS, graph.nodes_of(g, EDGE_KEYS, CHANNELS))


@query("weighted_degree", f"WITH {_DEG} SELECT label, cycle, direction, node, round(degree, 6) + 0.0 AS degree FROM deg")
def weighted_degree(spark: SparkSession, sf: str) -> DataFrame:
    return _degrees(spark, sf).withColumns({"degree": r6("degree"), "node": F.col("node").cast("long")})


@query("subject_centrality", f"WITH {_DEG} SELECT label % 2 AS grp, label, direction, node, round(avg(degree), 6) + 0.0 AS degree FROM deg GROUP BY ALL")
def subject_centrality(spark: SparkSession, sf: str) -> DataFrame:
    out = _degrees(spark, sf).groupBy((F.col("label") % 2).alias("grp"), "label", "direction", F.col("node").cast("long").alias("node"))
    return out.agg(r6(F.avg("degree")).alias("degree"))


@query(
    "centrality_lists",
    f"""WITH {_DEG}, m AS (SELECT label, direction, node, round(avg(degree), 4) + 0.0 AS d FROM deg GROUP BY ALL)
SELECT label % 2 AS grp, direction, node, array_to_string(list(printf('%.4f', d) ORDER BY label), ',') AS degrees FROM m GROUP BY ALL""",
)
def centrality_lists(spark: SparkSession, sf: str) -> DataFrame:
    mean = _degrees(spark, sf).groupBy("label", "direction", F.col("node").cast("long").alias("node")).agg(F.round(F.avg("degree"), 4).alias("d"))
    listed = matrix.merge_cycles(mean.withColumn("grp", F.col("label") % 2), ["grp", "direction", "node"], "label", "d")
    return listed.select("grp", "direction", "node", F.array_join(F.transform("values", lambda v: F.format_string("%.4f", v)), ",").alias("degrees"))


def _thr(values: list[float]) -> str:
    return f"""{SHIFT}, thr AS (SELECT s.label, s.cycle, s.direction, t.threshold, s.i, s.j FROM shifted s, (SELECT unnest({values})::DOUBLE AS threshold) t WHERE s.w >= t.threshold),
both_ AS (SELECT label, cycle, direction, threshold, i AS a, j AS b FROM thr UNION ALL SELECT label, cycle, direction, threshold, j, i FROM thr),
graphs AS (SELECT DISTINCT label, cycle, direction, threshold FROM shifted, (SELECT unnest({values})::DOUBLE AS threshold))"""


_THR = _thr(THRESHOLDS)
_TKEYS = [*EDGE_KEYS, "threshold"]


def _thresholds(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    g = shifted_graphs(spark, sf)
    all_ = g.select(*EDGE_KEYS).distinct().withColumn("threshold", F.explode(F.array(*map(F.lit, THRESHOLDS))))
    return graph.at_thresholds(g, THRESHOLDS), all_


@query(
    "clustering_coefficient_sweep",
    f"""WITH {_THR}, k AS (SELECT label, cycle, direction, threshold, a AS node, count(*) AS k FROM both_ GROUP BY ALL),
t AS (SELECT x.label, x.cycle, x.direction, x.threshold, x.a AS node, count(*) AS t FROM both_ x JOIN both_ y USING (label, cycle, direction, threshold) JOIN thr z USING (label, cycle, direction, threshold)
  WHERE x.a = y.a AND z.i = x.b AND z.j = y.b GROUP BY ALL)
SELECT g.label, g.cycle, g.direction, g.threshold, n.m AS node, round(CASE WHEN k.k >= 2 THEN 2 * coalesce(t.t, 0) / (k.k * (k.k - 1)) ELSE 0 END, 6) + 0.0 AS coefficient FROM graphs g CROSS JOIN range(21) n(m)
LEFT JOIN k ON k.label = g.label AND k.cycle = g.cycle AND k.direction = g.direction AND k.threshold = g.threshold AND k.node = n.m
LEFT JOIN t ON t.label = g.label AND t.cycle = g.cycle AND t.direction = g.direction AND t.threshold = g.threshold AND t.node = n.m""",
)
def clustering_coefficient_sweep(spark: SparkSession, sf: str) -> DataFrame:
    e, all_ = _thresholds(spark, sf)
    out = graph.clustering(e, _TKEYS, graph.nodes_of(all_, _TKEYS, CHANNELS))
    return out.withColumns({"coefficient": r6("coefficient"), "node": F.col("node").cast("long")})


def _comp(values: list[float]) -> str:
    return f"""WITH RECURSIVE {_thr(values)}, reach AS (SELECT label, cycle, direction, threshold, m AS a, m AS b FROM graphs, range(21) n(m)
  UNION SELECT r.label, r.cycle, r.direction, r.threshold, r.a, e.b FROM reach r JOIN both_ e ON e.label = r.label AND e.cycle = r.cycle AND e.direction = r.direction AND e.threshold = r.threshold AND e.a = r.b),
comp AS (SELECT label, cycle, direction, threshold, a AS node, min(b) AS component FROM reach GROUP BY ALL)"""


_COMP = _comp(THRESHOLDS)


def _communities(spark: SparkSession, sf: str, values: list[float] = THRESHOLDS) -> DataFrame:
    return graph.components(shifted_graphs(spark, sf), EDGE_KEYS, CHANNELS, values)


@query("threshold_communities", f"{_COMP} SELECT * FROM comp")
def threshold_communities(spark: SparkSession, sf: str) -> DataFrame:
    return _communities(spark, sf).withColumns({"node": F.col("node").cast("long"), "component": F.col("component").cast("long")})


@query(
    "component_count_sweep",
    f"{_COMP} SELECT label, cycle, direction, threshold, count(*) AS components, max(size) AS largest FROM (SELECT label, cycle, direction, threshold, component, count(*) AS size FROM comp GROUP BY ALL) GROUP BY ALL",
)
def component_count_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return graph.component_sizes(_communities(spark, sf), _TKEYS)


_ALLEG = f"""{_comp(COMMUNITY_THRESHOLDS)}, runs AS (SELECT label, direction, cycle, threshold, node, component FROM comp),
alleg AS (SELECT a.label, a.direction, a.node AS i, b.node AS j, avg(CASE WHEN a.component = b.component THEN 1.0 ELSE 0.0 END) AS w FROM runs a JOIN runs b
  ON a.label = b.label AND a.direction = b.direction AND a.cycle = b.cycle AND a.threshold = b.threshold AND a.node < b.node GROUP BY ALL)"""


def _allegiance(spark: SparkSession, sf: str) -> DataFrame:
    """Allegiance over the partitions of all cycles and thresholds of a subject."""
    m = _communities(spark, sf, COMMUNITY_THRESHOLDS).withColumns({"community": F.col("component"), "run": F.struct("cycle", "threshold")})
    return graph.allegiance(m, SUBJECT_KEYS, "run", CHANNELS)


@query("allegiance_from_memberships", f"{_ALLEG} SELECT label, direction, i, j, round(w, 6) + 0.0 AS w FROM alleg")
def allegiance_from_memberships(spark: SparkSession, sf: str) -> DataFrame:
    return _ij(_allegiance(spark, sf)).withColumn("w", r6("w"))


@query("group_allegiance", f"{_ALLEG} SELECT label % 2 AS grp, direction, i, j, round(avg(w), 6) + 0.0 AS mean, round(stddev_pop(w), 6) + 0.0 AS std FROM alleg GROUP BY ALL")
def group_allegiance(spark: SparkSession, sf: str) -> DataFrame:
    own = _allegiance(spark, sf).withColumn("grp", F.col("label") % 2)
    mean = graph.group_allegiance(own, ["grp", *SUBJECT_KEYS], ["grp", "direction"], CHANNELS)
    return _ij(mean).select("grp", "direction", "i", "j", r6("w").alias("mean"), r6("std").alias("std"))


_GCOMM = f"""{_ALLEG}, ga AS (SELECT label % 2 AS grp, direction, i, j, avg(w) AS w FROM alleg GROUP BY ALL), ge AS (SELECT grp, direction, i AS a, j AS b FROM ga WHERE w >= 0.6 UNION ALL SELECT grp, direction, j, i FROM ga WHERE w >= 0.6),
greach AS (SELECT g.grp, d.direction, m AS a, m AS b FROM (SELECT x::INTEGER AS grp FROM range(2) t(x)) g, range(3) d(direction), range(21) n(m) UNION SELECT r.grp, r.direction, r.a, e.b FROM greach r JOIN ge e ON e.grp = r.grp AND e.direction = r.direction AND e.a = r.b),
gcomm AS (SELECT grp, direction, a AS node, min(b) AS community FROM greach GROUP BY ALL),
se AS (SELECT label, direction, i AS a, j AS b FROM alleg WHERE w >= 0.6 UNION ALL SELECT label, direction, j, i FROM alleg WHERE w >= 0.6),
sreach AS (SELECT label, direction, m AS a, m AS b FROM (SELECT DISTINCT label, direction FROM alleg), range(21) n(m) UNION SELECT r.label, r.direction, r.a, e.b FROM sreach r JOIN se e ON e.label = r.label AND e.direction = r.direction AND e.a = r.b),
scomm AS (SELECT label, direction, a AS node, min(b) AS community FROM sreach GROUP BY ALL)"""


def _group_communities(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Subject allegiance, subject communities and group communities, at a threshold of 0.6."""
    a = _allegiance(spark, sf).withColumn("grp", F.col("label") % 2)
    mean = a.groupBy("grp", "direction", "i", "j").agg(F.avg("w").alias("w"))
    of = lambda e, k: graph.components(e, k, CHANNELS, [0.6]).drop("threshold").withColumnRenamed("component", "community")
    return a, of(a, ["grp", *SUBJECT_KEYS]), of(mean, ["grp", "direction"])


@query("group_communities", f"{_GCOMM} SELECT * FROM gcomm")
def group_communities(spark: SparkSession, sf: str) -> DataFrame:
    return _group_communities(spark, sf)[2].withColumns({"node": F.col("node").cast("long"), "community": F.col("community").cast("long")})


_MOD = f"""{_GCOMM}, cells AS (SELECT label, direction, i, j, w FROM alleg UNION ALL SELECT label, direction, m, m, 1.0 FROM (SELECT DISTINCT label, direction FROM alleg), range(21) n(m)),
c AS (SELECT x.label, x.direction, a.community AS ca, b.community AS cb, w FROM cells x JOIN gcomm a ON a.grp = x.label % 2 AND a.direction = x.direction AND a.node = x.i JOIN gcomm b ON b.grp = x.label % 2 AND b.direction = x.direction AND b.node = x.j),
m AS (SELECT label, direction, sum(w) AS m FROM c GROUP BY ALL),
dg AS (SELECT label, direction, community, sum(w) AS deg FROM (SELECT label, direction, ca AS community, w FROM c UNION ALL SELECT label, direction, cb, w FROM c) GROUP BY ALL),
inn AS (SELECT label, direction, ca AS community, sum(w) AS l FROM c WHERE ca = cb GROUP BY ALL)"""


def _modularity(spark: SparkSession, sf: str) -> DataFrame:
    a, _, g = _group_communities(spark, sf)
    members = a.select("grp", *SUBJECT_KEYS).distinct().join(g, ["grp", "direction"])
    return graph.modularity(a, members, ["grp", *SUBJECT_KEYS])


@query(
    "modularity_score",
    f"""{_MOD} SELECT dg.label % 2 AS grp, dg.label, dg.direction, round(CASE WHEN count(*) > 1 THEN sum(inn.l / m.m - power(dg.deg / (2 * m.m), 2)) END, 6) + 0.0 AS modularity, count(*) AS communities
FROM dg JOIN inn USING (label, direction, community) JOIN m USING (label, direction) GROUP BY ALL""",
)
def modularity_score(spark: SparkSession, sf: str) -> DataFrame:
    return _modularity(spark, sf).withColumn("modularity", r6("modularity"))


@query(
    "group_modularity",
    f"""WITH RECURSIVE {_GCOMM.removeprefix("WITH RECURSIVE ")}, cells AS (SELECT grp, direction, i, j, w FROM ga UNION ALL SELECT grp, direction, m, m, 1.0 FROM (SELECT DISTINCT grp, direction FROM ga), range(21) n(m)),
c AS (SELECT x.grp, x.direction, a.community AS ca, b.community AS cb, w FROM cells x JOIN gcomm a ON a.grp = x.grp AND a.direction = x.direction AND a.node = x.i JOIN gcomm b ON b.grp = x.grp AND b.direction = x.direction AND b.node = x.j),
m AS (SELECT grp, direction, sum(w) AS m FROM c GROUP BY ALL),
dg AS (SELECT grp, direction, community, sum(w) AS deg FROM (SELECT grp, direction, ca AS community, w FROM c UNION ALL SELECT grp, direction, cb, w FROM c) GROUP BY ALL),
inn AS (SELECT grp, direction, ca AS community, sum(w) AS l FROM c WHERE ca = cb GROUP BY ALL)
SELECT grp, direction, round(sum(inn.l / m.m - power(dg.deg / (2 * m.m), 2)), 6) + 0.0 AS modularity, count(*) AS communities FROM dg JOIN inn USING (grp, direction, community) JOIN m USING (grp, direction) GROUP BY ALL""",
)
def group_modularity(spark: SparkSession, sf: str) -> DataFrame:
    """The score of a group's own mean matrix, whatever the number of its communities."""
    a, _, g = _group_communities(spark, sf)
    mean = a.groupBy("grp", "direction", "i", "j").agg(F.avg("w").alias("w"))
    return graph.modularity(mean, g, ["grp", "direction"], alone=True).withColumn("modularity", r6("modularity"))


@query(
    "community_density",
    f"""{_GCOMM}, p AS (SELECT x.label, x.direction, a.community, avg(w) AS d FROM alleg x JOIN gcomm a ON a.grp = x.label % 2 AND a.direction = x.direction AND a.node = x.i
  JOIN gcomm b ON b.grp = a.grp AND b.direction = x.direction AND b.node = x.j AND a.community = b.community GROUP BY ALL)
SELECT s.label % 2 AS grp, s.label, s.direction, g.community, g.size, round(coalesce(p.d, 0), 6) + 0.0 AS density FROM (SELECT DISTINCT label, direction FROM alleg) s
JOIN (SELECT grp, direction, community, count(*) AS size FROM gcomm GROUP BY ALL) g ON g.grp = s.label % 2 AND g.direction = s.direction LEFT JOIN p ON p.label = s.label AND p.direction = s.direction AND p.community = g.community""",
)
def community_density(spark: SparkSession, sf: str) -> DataFrame:
    a, _, g = _group_communities(spark, sf)
    members = a.select("grp", *SUBJECT_KEYS).distinct().join(g, ["grp", "direction"])
    out = graph.community_density(a, members, ["grp", *SUBJECT_KEYS])
    return out.withColumns({"density": r6("density"), "community": F.col("community").cast("long")})


_ARI = f"""{_GCOMM}, n AS (SELECT s.label, s.direction, s.community AS a, g.community AS b, count(*)::DOUBLE AS n FROM scomm s JOIN gcomm g ON g.grp = s.label % 2 AND g.direction = s.direction AND g.node = s.node GROUP BY ALL),
x AS (SELECT label, direction, sum(n * (n - 1) / 2) AS idx, sum(n) AS t FROM n GROUP BY ALL),
ra AS (SELECT label, direction, sum(n * (n - 1) / 2) AS ra FROM (SELECT label, direction, a, sum(n) AS n FROM n GROUP BY ALL) GROUP BY ALL),
rb AS (SELECT label, direction, sum(n * (n - 1) / 2) AS rb FROM (SELECT label, direction, b, sum(n) AS n FROM n GROUP BY ALL) GROUP BY ALL)"""


def _fit(spark: SparkSession, sf: str) -> DataFrame:
    _, s, g = _group_communities(spark, sf)
    pairs = s.withColumnRenamed("community", "a").join(g.withColumnRenamed("community", "b"), ["grp", "direction", "node"])
    return graph.adjusted_rand(pairs, ["grp", *SUBJECT_KEYS])


@query(
    "adjusted_rand_index",
    f"""{_ARI} SELECT label % 2 AS grp, label, direction, round(coalesce((idx - ra * rb / (t * (t - 1) / 2)) / nullif((ra + rb) / 2 - ra * rb / (t * (t - 1) / 2), 0), 1), 6) + 0.0 AS ari FROM x JOIN ra USING (label, direction) JOIN rb USING (label, direction)""",
)
def adjusted_rand_index(spark: SparkSession, sf: str) -> DataFrame:
    return _fit(spark, sf).withColumn("ari", r6("ari"))


@query(
    "jaccard_communities",
    f"""{_GCOMM}, sl AS (SELECT label, direction, community, list(node) AS n FROM scomm GROUP BY ALL), gl AS (SELECT grp, direction, community, list(node) AS n FROM gcomm GROUP BY ALL)
SELECT sl.label, sl.direction, sl.community AS a, gl.community AS b, round(len(list_intersect(sl.n, gl.n)) / len(list_distinct(list_concat(sl.n, gl.n))), 6) + 0.0 AS jaccard FROM sl JOIN gl ON gl.grp = sl.label % 2 AND gl.direction = sl.direction""",
)
def jaccard_communities(spark: SparkSession, sf: str) -> DataFrame:
    _, s, g = _group_communities(spark, sf)
    a = s.groupBy("grp", *SUBJECT_KEYS, F.col("community").cast("long").alias("a")).agg(F.collect_list("node").alias("na"))
    b = g.groupBy("grp", "direction", F.col("community").cast("long").alias("b")).agg(F.collect_list("node").alias("nb"))
    pairs = a.join(b, ["grp", "direction"])
    return pairs.select("label", "direction", "a", "b", r6(graph.jaccard(pairs, "na", "nb")).alias("jaccard"))


@query("louvain_allegiance")
def louvain_allegiance(spark: SparkSession, sf: str) -> DataFrame:
    """Allegiance over 100 seeded Louvain runs of every subject's mean network."""
    g = subject_graphs(spark, sf)
    return graph.allegiance(graph.louvain_memberships(g, SUBJECT_KEYS, CHANNELS, 100), SUBJECT_KEYS, "run", CHANNELS)


# --- paths ------------------------------------------------------------------------------


@query("induced_subgraph", f"WITH {SGRAPH} SELECT label, direction, i, j, round(w, 6) + 0.0 AS w FROM sg WHERE i IN (0, 2, 5, 7) AND j IN (0, 2, 5, 7)")
def induced_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    return _ij(paths.induced(subject_graphs(spark, sf), [0, 2, 5, 7])).select("label", "direction", "i", "j", r6("w").alias("w"))


_PATH = [0, 5, 2, 7, 11]


def _along(spark: SparkSession, sf: str, closed: bool) -> DataFrame:
    g = subject_graphs(spark, sf)
    p = g.select(*SUBJECT_KEYS).distinct().withColumn("path", F.array(*map(F.lit, _PATH)))
    out = paths.along(g, paths.steps_of(p, "path", closed), SUBJECT_KEYS)
    return out.select("label", "direction", *[F.col(c).cast("long").alias(c) for c in ("step", "u", "v")], r6("w").alias("w"))


_STEPS = "p AS (SELECT * FROM (VALUES (0, 0, 5), (1, 5, 2), (2, 2, 7), (3, 7, 11), (4, 11, 0)) t(step, u, v))"


@query("path_subgraph", f"WITH {SGRAPH}, {_STEPS} SELECT label, direction, step::BIGINT AS step, u::BIGINT AS u, v::BIGINT AS v, round(w, 6) + 0.0 AS w FROM sym JOIN p ON a = u AND b = v WHERE step < 4")
def path_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    return _along(spark, sf, False)


@query("cycle_subgraph", f"WITH {SGRAPH}, {_STEPS} SELECT label, direction, step::BIGINT AS step, u::BIGINT AS u, v::BIGINT AS v, round(w, 6) + 0.0 AS w FROM sym JOIN p ON a = u AND b = v")
def cycle_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    return _along(spark, sf, True)


@query(
    "last_cycle_weights",
    f"WITH {SHIFT}, {_STEPS} SELECT label, direction, i, j, round(arg_max(w, cycle), 6) + 0.0 AS w, round(avg(w), 6) + 0.0 AS mean FROM shifted JOIN p ON i = least(u, v) AND j = greatest(u, v) WHERE step < 4 GROUP BY ALL",
)
def last_cycle_weights(spark: SparkSession, sf: str) -> DataFrame:
    g = shifted_graphs(spark, sf)
    p = g.select(*EDGE_KEYS).distinct().withColumn("path", F.array(*map(F.lit, _PATH)))
    out = _ij(paths.along(g, paths.steps_of(p, "path"), EDGE_KEYS)).groupBy("label", "direction", "i", "j")
    return out.agg(r6(F.max_by("w", "cycle")).alias("w"), r6(F.avg("w")).alias("mean"))


def _walk(order: str, length: int, starts: str = "range(21) n(m)") -> str:
    return f"""walk AS (SELECT label, direction, m AS start, [m] AS path FROM (SELECT DISTINCT label, direction FROM sg), {starts}
  UNION ALL SELECT label, direction, start, path FROM (SELECT w.label, w.direction, w.start, list_append(w.path, e.b) AS path, row_number() OVER (PARTITION BY w.label, w.direction, w.start ORDER BY {order}, e.b) AS k
    FROM walk w JOIN sym e ON e.label = w.label AND e.direction = w.direction AND e.a = w.path[len(w.path)] WHERE len(w.path) < {length} AND NOT list_contains(w.path, e.b)) WHERE k = 1)"""


_STRONG, _WEAK = "round(abs(e.w), 9) DESC", "round(e.w, 9)"


def _greedy(spark: SparkSession, sf: str, length: int, strongest: bool) -> DataFrame:
    m = paths.dense(subject_graphs(spark, sf), SUBJECT_KEYS, CHANNELS).withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(CHANNELS - 1))))
    return m.select(*SUBJECT_KEYS, F.col("start").cast("long").alias("start"), paths.greedy(F.col("start"), length, strongest).alias("path"))


@query("greedy_strongest_path", f"WITH RECURSIVE {SGRAPH}, {_walk(_STRONG, 8)} SELECT label, direction, start, array_to_string(path, '-') AS path FROM walk WHERE len(path) = 8")
def greedy_strongest_path(spark: SparkSession, sf: str) -> DataFrame:
    return _greedy(spark, sf, 8, True).withColumn("path", F.array_join(F.col("path").cast("array<string>"), "-"))


@query("greedy_min_path", f"WITH RECURSIVE {SGRAPH}, {_walk(_WEAK, 6)} SELECT label, direction, start, array_to_string(path, '-') AS path FROM walk WHERE len(path) = 6")
def greedy_min_path(spark: SparkSession, sf: str) -> DataFrame:
    return _greedy(spark, sf, 6, False).withColumn("path", F.array_join(F.col("path").cast("array<string>"), "-"))


@query("path_lengths", f"WITH RECURSIVE {SGRAPH}, {_walk(_STRONG, 20, '(SELECT 0::BIGINT AS m)')} SELECT label, direction, len(path)::BIGINT AS length, array_to_string(path, '-') AS path FROM walk WHERE len(path) >= 2")
def path_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """All lengths 2..20 from one walk: a greedy path's prefixes are the shorter greedy paths."""
    m = paths.dense(subject_graphs(spark, sf), SUBJECT_KEYS, CHANNELS).withColumn("whole", paths.greedy(F.lit(0), 20))
    rows = m.select(*SUBJECT_KEYS, "whole", F.explode(F.sequence(F.lit(2), F.size("whole"))).alias("length"))
    return rows.select(*SUBJECT_KEYS, F.col("length").cast("long").alias("length"), F.array_join(F.slice("whole", 1, F.col("length")).cast("array<string>"), "-").alias("path"))


_GPAT = f"""WITH RECURSIVE {SGRAPH}, {_walk(_STRONG, 6, '(SELECT 0::BIGINT AS m)')}, steps AS (SELECT label % 2 AS grp, label, direction, path[k] AS u, path[k + 1] AS v FROM walk, range(1, 6) t(k) WHERE len(path) = 6),
mean AS (SELECT s.grp, u, v, avg(w) AS w FROM steps s JOIN sym e ON e.label = s.label AND e.direction = s.direction AND e.a = u AND e.b = v GROUP BY ALL),
gw AS (SELECT x::INTEGER AS grp, [0::BIGINT] AS path FROM range(2) t(x) UNION ALL SELECT grp, path FROM (SELECT w.grp, list_append(w.path, e.v) AS path, row_number() OVER (PARTITION BY w.grp ORDER BY round(abs(e.w), 9) DESC, e.v) AS k
  FROM gw w JOIN mean e ON e.grp = w.grp AND e.u = w.path[len(w.path)] WHERE len(w.path) < 6 AND NOT list_contains(w.path, e.v)) WHERE k = 1),
gpat AS (SELECT grp AS pattern_grp, path FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY len(path) DESC) AS k FROM gw) WHERE k = 1)"""


def _patterns(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    g = subject_graphs(spark, sf)
    own = paths.dense(g, ["grp", *SUBJECT_KEYS], CHANNELS).select("grp", *SUBJECT_KEYS, paths.greedy(F.lit(0), 6).alias("path"))
    return paths.group_pattern(own, g, ["grp", *SUBJECT_KEYS], ["grp"], CHANNELS, 0, 6).withColumnRenamed("grp", "pattern_grp"), g


@query("group_pattern", f"{_GPAT} SELECT pattern_grp, array_to_string(path, '-') AS pattern FROM gpat")
def group_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return _patterns(spark, sf)[0].withColumn("pattern", F.array_join(F.col("pattern").cast("array<string>"), "-"))


_SCORE = f"""{_GPAT}, ps AS (SELECT pattern_grp, k - 1 AS step, path[k] AS u, path[k + 1] AS v, len(path) AS n FROM gpat, range(1, 6) t(k) WHERE k < len(path)),
score AS (SELECT p.pattern_grp, e.grp, e.label, e.direction, CASE WHEN count(w) = max(n) - 1 THEN sum(w) END AS path_sum, arg_min(u || '-' || v, round(w, 9) * 1000 + step * 1e-9) AS weakest_link FROM ps p JOIN sym e ON e.a = p.u AND e.b = p.v GROUP BY ALL)"""


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    p, g = _patterns(spark, sf)
    return paths.score_patterns(p, g, ["pattern_grp"], ["grp", *SUBJECT_KEYS])


@query("pattern_scores", f"{_SCORE} SELECT pattern_grp, grp, label, direction, round(path_sum, 6) + 0.0 AS path_sum, weakest_link FROM score")
def pattern_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).withColumn("path_sum", r6("path_sum"))


@query(
    "weakest_link_mode",
    f"{_SCORE}, wl AS (SELECT pattern_grp, weakest_link, count(*) AS n FROM score GROUP BY ALL) SELECT pattern_grp, weakest_link, n FROM (SELECT *, row_number() OVER (PARTITION BY pattern_grp ORDER BY n DESC, weakest_link) AS k FROM wl) WHERE k = 1",
)
def weakest_link_mode(spark: SparkSession, sf: str) -> DataFrame:
    return paths.most_frequent(_scores(spark, sf), ["pattern_grp"], "weakest_link")


@query("longest_simple_path")
def longest_simple_path(spark: SparkSession, sf: str) -> DataFrame:
    """Longest path of every subject's whole graph at each threshold."""
    g = graph.at_thresholds(subject_graphs(spark, sf), THRESHOLDS)
    return paths.longest_path_exact(g, [*SUBJECT_KEYS, "threshold"]).withColumn("path", F.array_join(F.col("path").cast("array<string>"), "-"))


@query(
    "linear_positions",
    f"WITH {_RANK} SELECT direction, node, round((rank - 1) / 20, 6) + 0.0 AS x, round(1 - (rank - 1) / 20, 6) + 0.0 AS y FROM rk",
)
def linear_positions(spark: SparkSession, sf: str) -> DataFrame:
    out = paths.linear_layout(matrix.difference_rank(differences(spark, sf), ["direction"]), ["direction"], "rank")
    return out.select("direction", F.col("node").cast("long").alias("node"), r6("x").alias("x"), r6("y").alias("y"))
