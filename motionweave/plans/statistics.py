"""Queries on permutation, bootstrap, group tests and multiplicity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionweave.functions.core import r6
from motionweave.operators import inference
from motionweave.plans import drivers
from motionweave.plans.adapters import BLOCKS, CHANNELS, DIFF, GRPM, S, SUBJ, SUBJECT_KEYS, channel_rows, differences, group_means, query, subject_edges, subject_graphs, table
from motionweave.plans.matrices import _ARI, _LAG, _MOD, _SCORE, _fit, _modularity, _scores, _subject_lags

PERMUTATIONS, BOOTSTRAPS, SWEEP = 10_000, 5_000, 1_000
SHARES = [k / 10 for k in range(1, 10)]

_PAIRS = f"{GRPM}, pr AS (SELECT a.direction, a.i, a.j, a.avg AS x, b.avg AS y FROM grpm a JOIN grpm b ON a.direction = b.direction AND a.i = b.i AND a.j = b.j AND a.grp = 0 AND b.grp = 1)"


def _rho(source: str, keys: str, name: str = "rho") -> str:
    """SQL for the rank correlation of x and y per keys."""
    rank = lambda c: f"rank() OVER (PARTITION BY {keys} ORDER BY {c}) + (count(*) OVER (PARTITION BY {keys}, {c}) - 1) / 2.0"
    return f"SELECT {keys}, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS {name} FROM (SELECT {keys}, {rank('x')} AS rx, {rank('y')} AS ry FROM {source} WHERE x IS NOT NULL AND y IS NOT NULL) GROUP BY ALL"


def _group_pairs(means: DataFrame, keys: list[str]) -> DataFrame:
    side = lambda g: F.max(F.when(F.col("grp") == g, F.col("avg")))
    return means.groupBy(*keys, "i", "j").agg(side(0).alias("x"), side(1).alias("y"))


@query("spearman_matrix_similarity", f"WITH {_PAIRS} SELECT direction, round(rho, 6) + 0.0 AS rho FROM ({_rho('pr', 'direction')})")
def spearman_matrix_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return inference.spearman(_group_pairs(group_means(spark, sf), ["direction"]), ["direction"]).withColumn("rho", r6("rho"))


_PERM = f"""tb AS (SELECT it AS iter, n AS node, CASE WHEN n < 14 THEN 0 ELSE 1 END AS block FROM range(1, {PERMUTATIONS + 1}) a(it), range(21) b(n)),
pt AS (SELECT o.iter, o.node AS old, w.node AS new FROM (SELECT *, row_number() OVER (PARTITION BY iter, block ORDER BY node) AS k FROM tb) o
  JOIN (SELECT *, row_number() OVER (PARTITION BY iter, block ORDER BY md5('perm:' || iter || ':' || node), node) AS k FROM tb) w USING (iter, block, k))"""


@query("permutation_table", f"""WITH {S}, {_PERM.replace("range(21) b(n)", "(SELECT DISTINCT m AS n FROM lng) b")} SELECT iter, old, new FROM pt""")
def permutation_table(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of the channels that the samples have, shuffled within their blocks."""
    nodes = channel_rows(spark, sf).select(F.col("m").alias("node")).distinct()
    table = inference.permutation_table(nodes.withColumn("block", (F.col("node") >= 14).cast("int")), PERMUTATIONS, "perm")
    return table.withColumn("iter", F.col("iter").cast("long"))


@query(
    "permutation_p",
    f"""WITH {_PAIRS}, {_PERM}, m AS (SELECT p.direction, a.iter, least(a.new, b.new) AS i, greatest(a.new, b.new) AS j, p.x FROM pr p JOIN pt a ON a.old = p.i JOIN pt b ON b.iter = a.iter AND b.old = p.j),
mp AS (SELECT m.direction, m.iter, m.x, p.y FROM m JOIN pr p USING (direction, i, j)), perm AS ({_rho('mp', 'direction, iter')}), obs AS ({_rho('pr', 'direction')})
SELECT o.direction, round(max(o.rho), 6) + 0.0 AS rho, round((count(*) FILTER (round(abs(o.rho), 9) <= round(abs(p.rho), 9)) + 1) / (count(*) + 1), 6) + 0.0 AS p_value FROM obs o JOIN perm p USING (direction) GROUP BY ALL""",
)
def permutation_p(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _group_pairs(group_means(spark, sf), ["direction"])
    out = inference.permutation_test(pairs, ["direction"], BLOCKS, PERMUTATIONS, "perm")
    return out.select("direction", r6("rho").alias("rho"), r6("p_value").alias("p_value"))


@query(
    "difference_permutation",
    f"""WITH {DIFF}, {_PERM}, m AS (SELECT p.direction, a.iter, least(a.new, b.new) AS i, greatest(a.new, b.new) AS j, p.d AS pd FROM diff p JOIN pt a ON a.old = p.i JOIN pt b ON b.iter = a.iter AND b.old = p.j)
SELECT direction, i, j, round(max(d), 6) + 0.0 AS d, round(avg(CASE WHEN round(abs(pd), 9) >= round(abs(d), 9) THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS p_value FROM m JOIN diff USING (direction, i, j) GROUP BY ALL""",
)
def difference_permutation(spark: SparkSession, sf: str) -> DataFrame:
    out = inference.edge_permutation_test(differences(spark, sf), ["direction"], "d", BLOCKS, PERMUTATIONS, "perm")
    return out.select("direction", "i", "j", r6("d").alias("d"), r6("p_value").alias("p_value"))


def _boot(iterations: int, seed: str, shares: list[float], digest: str = "it") -> str:
    return f"""{SUBJ}, who AS (SELECT DISTINCT grp, label FROM subj), shares AS (SELECT unnest({shares})::DOUBLE AS share),
pick AS (SELECT iter, share, grp, label FROM (SELECT it AS iter, share, grp, label, row_number() OVER (PARTITION BY it, share, grp ORDER BY md5('{seed}:' || {digest} || ':' || label), label) AS k,
  count(*) OVER (PARTITION BY it, share, grp) AS n FROM who, shares, range(1, {iterations + 1}) r(it)) WHERE k <= greatest(1, floor(n * share))),
bm AS (SELECT iter, share, grp, direction, i, j, avg(avg) AS a FROM subj JOIN pick USING (grp, label) GROUP BY ALL), bp AS (SELECT iter, share, direction, i, j, max(a) FILTER (grp = 0) AS x, max(a) FILTER (grp = 1) AS y FROM bm GROUP BY ALL),
om AS (SELECT direction, i, j, avg(avg) FILTER (grp = 0) AS x, avg(avg) FILTER (grp = 1) AS y FROM subj GROUP BY ALL)"""


def _summary_sql(keys: str) -> str:
    return f"""SELECT {keys}, round(max(obs), 4) + 0.0 AS observed, round(avg(rho), 4) + 0.0 AS mean, round(stddev_pop(rho), 4) + 0.0 AS std, round(stddev_pop(rho) / nullif(avg(rho), 0) * 100, 4) + 0.0 AS cv_percent,
  round(avg(rho) - max(obs), 4) + 0.0 AS bias, count(rho) AS n FROM b JOIN o USING (direction) GROUP BY ALL"""


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Edge weights of a subject and direction as one array."""
    cells = F.array_sort(F.collect_list(F.struct("i", "j", "avg")))
    return subject_edges(spark, sf).groupBy("grp", "label", "direction").agg(F.transform(cells, lambda c: c["avg"]).alias("v"))


def _bootstrap(spark: SparkSession, sf: str, iterations: int, share: float, seed: str, shares: list[float] | None = None) -> DataFrame:
    return inference.bootstrap(_vectors(spark, sf), ["direction"], "grp", "label", (0, 1), CHANNELS * (CHANNELS - 1) // 2, iterations, share, seed, shares)


def _observed(spark: SparkSession, sf: str) -> DataFrame:
    means = subject_edges(spark, sf).groupBy("grp", "direction", "i", "j").agg(F.avg("avg").alias("avg"))
    return inference.spearman(_group_pairs(means, ["direction"]), ["direction"]).withColumnRenamed("rho", "obs")


@query("bootstrap_rho", f"WITH {_boot(BOOTSTRAPS, 'boot', [0.8])}, b AS ({_rho('bp', 'iter, direction')}) SELECT iter, direction, round(rho, 6) + 0.0 AS rho FROM b")
def bootstrap_rho(spark: SparkSession, sf: str) -> DataFrame:
    return _bootstrap(spark, sf, BOOTSTRAPS, 0.8, "boot").select("iter", "direction", r6("rho").alias("rho"))


@query("bootstrap_summary", f"WITH {_boot(BOOTSTRAPS, 'boot', [0.8])}, b AS ({_rho('bp', 'iter, direction')}), o AS ({_rho('om', 'direction', 'obs')}) {_summary_sql('direction')}")
def bootstrap_summary(spark: SparkSession, sf: str) -> DataFrame:
    return inference.summary(_bootstrap(spark, sf, BOOTSTRAPS, 0.8, "boot").join(_observed(spark, sf), "direction"), ["direction"], "rho", "obs")


@query("sample_size_sweep", f"""WITH {_boot(SWEEP, 'sweep', SHARES, "it || ':' || share")}, b AS ({_rho('bp', 'share, iter, direction')}), o AS ({_rho('om', 'direction', 'obs')}) {_summary_sql('share, direction')}""")
def sample_size_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Bootstrap summaries over all nine sampling shares, as one plan with a share dimension."""
    rho = _bootstrap(spark, sf, SWEEP, 0.0, "sweep", SHARES)
    return inference.summary(rho.join(_observed(spark, sf), "direction"), ["share", "direction"], "rho", "obs")


# --- group tests ------------------------------------------------------------------------


_VAL = "val AS (SELECT o_orderpriority AS test, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS grp, o_totalprice AS v FROM orders WHERE o_orderstatus IN ('F', 'O'))"


def _values(spark: SparkSession, sf: str) -> DataFrame:
    grp = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1)
    return table(spark, sf, "orders").filter("o_orderstatus IN ('F', 'O')").select(F.col("o_orderpriority").alias("test"), grp.alias("grp"), F.col("o_totalprice").alias("v"))


@query("descriptive_stats", f"WITH {_VAL} SELECT test, grp, round(avg(v), 1) + 0.0 AS mean, round(stddev_samp(v), 1) + 0.0 AS std, round(median(v), 1) + 0.0 AS median, count(*) AS n FROM val GROUP BY ALL")
def descriptive_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = _values(spark, sf).groupBy("test", "grp")
    return out.agg(F.round(F.avg("v"), 1).alias("mean"), F.round(F.stddev_samp("v"), 1).alias("std"), F.round(F.median("v"), 1).alias("median"), F.count(F.lit(1)).alias("n"))


_MOM = f"""{_VAL}, mom AS (SELECT test, count(v) FILTER (grp = 0) AS n1, avg(v) FILTER (grp = 0) AS mean1, var_samp(v) FILTER (grp = 0) AS var1, count(v) FILTER (grp = 1) AS n2, avg(v) FILTER (grp = 1) AS mean2, var_samp(v) FILTER (grp = 1) AS var2 FROM val GROUP BY ALL),
wt AS (SELECT test, (mean1 - mean2) / sqrt(var1 / n1 + var2 / n2) AS t, power(var1 / n1 + var2 / n2, 2) / (power(var1 / n1, 2) / (n1 - 1) + power(var2 / n2, 2) / (n2 - 1)) AS df, (mean1 - mean2) / sqrt((var1 + var2) / 2) AS d FROM mom)"""


@query("welch_t", f"WITH {_MOM} SELECT test, round(t, 6) + 0.0 AS t, round(df, 4) + 0.0 AS df FROM wt")
def welch_t(spark: SparkSession, sf: str) -> DataFrame:
    w = inference.welch(inference.two_group_moments(_values(spark, sf), ["test"], "grp", "v", 0, 1))
    return w.select("test", r6("t").alias("t"), F.round("df", 4).alias("df"))


@query("cohens_d", f"WITH {_MOM} SELECT test, round(d, 6) + 0.0 AS cohens_d FROM wt")
def cohens_d(spark: SparkSession, sf: str) -> DataFrame:
    w = inference.welch(inference.two_group_moments(_values(spark, sf), ["test"], "grp", "v", 0, 1))
    return w.select("test", r6("cohens_d").alias("cohens_d"))


@query(
    "mann_whitney_u",
    f"""WITH {_VAL}, r AS (SELECT test, grp, rank() OVER (PARTITION BY test ORDER BY v) + (count(*) OVER (PARTITION BY test, v) - 1) / 2.0 AS r FROM val),
u AS (SELECT test, count(*) FILTER (grp = 0) AS n1, count(*) FILTER (grp = 1) AS n2, sum(r) FILTER (grp = 0) - count(*) FILTER (grp = 0) * (count(*) FILTER (grp = 0) + 1) / 2 AS u FROM r GROUP BY ALL)
SELECT test, n1, n2, u + 0.0 AS u, round(1 - 2 * u / (n1 * n2), 6) + 0.0 AS rank_biserial FROM u""",
)
def mann_whitney_u(spark: SparkSession, sf: str) -> DataFrame:
    return inference.mann_whitney_u(_values(spark, sf), ["test"], "grp", "v", 0, 1).withColumn("rank_biserial", r6("rank_biserial"))


@query(
    "levene_stat",
    f"""WITH {_VAL}, z AS (SELECT test, grp, abs(v - median(v) OVER (PARTITION BY test, grp)) AS z FROM val), g AS (SELECT test, grp, count(*) AS n, avg(z) AS m, var_pop(z) AS s FROM z GROUP BY ALL),
t AS (SELECT test, sum(n) AS t, sum(n * m) / sum(n) AS gm FROM g GROUP BY ALL) SELECT test, round((max(t) - count(*)) * sum(n * power(m - gm, 2)) / ((count(*) - 1) * sum(n * s)), 6) + 0.0 AS levene_w FROM g JOIN t USING (test) GROUP BY ALL""",
)
def levene_stat(spark: SparkSession, sf: str) -> DataFrame:
    return inference.levene_w(_values(spark, sf), ["test"], "grp", "v").withColumn("levene_w", r6("levene_w"))


_P = "p AS (SELECT p_brand AS family, p_partkey AS test, ((p_partkey * 7919) % 10007 + 0.5) / 10007.0 * ((p_partkey * 104729) % 997 + 1) / 997.0 AS p FROM part)"


def _p_values(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    p = ((k * 7919) % 10007 + F.lit(0.5)) / F.lit(10007.0) * ((k * 104729) % 997 + 1) / F.lit(997.0)
    return table(spark, sf, "part").select(F.col("p_brand").alias("family"), k.alias("test"), p.cast("double").alias("p"))


@query("bonferroni", f"WITH {_P} SELECT family, test, round(least(1.0, p::DOUBLE * count(*) OVER (PARTITION BY family)), 6) + 0.0 AS p_adjusted FROM p")
def bonferroni(spark: SparkSession, sf: str) -> DataFrame:
    return _p_values(spark, sf).select("family", "test", r6(inference.bonferroni("p", ["family"])).alias("p_adjusted"))


@query(
    "bh_fdr",
    f"""WITH {_P}, r AS (SELECT family, test, p::DOUBLE AS p, row_number() OVER (PARTITION BY family ORDER BY p, test) AS k, count(*) OVER (PARTITION BY family) AS n FROM p)
SELECT family, test, round(least(1.0, min(p * n / k) OVER (PARTITION BY family ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) + 0.0 AS p_adjusted FROM r""",
)
def bh_fdr(spark: SparkSession, sf: str) -> DataFrame:
    return inference.benjamini_hochberg(_p_values(spark, sf), "p", ["family"], "test").select("family", "test", r6("p_adjusted").alias("p_adjusted"))


@query("two_stage_correction", f"WITH {_P} SELECT family, test, round(least(1.0, p::DOUBLE * count(*) OVER (PARTITION BY family)), 6) + 0.0 AS p_adjusted FROM p WHERE p < 0.01")
def two_stage_correction(spark: SparkSession, sf: str) -> DataFrame:
    return inference.two_stage(_p_values(spark, sf), "p", ["family"]).select("family", "test", r6("p_adjusted").alias("p_adjusted"))


_LT = f"""{_LAG}, lm AS (SELECT direction, i, j, count(*) FILTER (label % 2 = 0) AS n1, avg(lag_pct) FILTER (label % 2 = 0) AS mean1, var_samp(lag_pct) FILTER (label % 2 = 0) AS var1, count(*) FILTER (label % 2 = 1) AS n2, avg(lag_pct) FILTER (label % 2 = 1) AS mean2, var_samp(lag_pct) FILTER (label % 2 = 1) AS var2 FROM slag GROUP BY ALL)"""


@query(
    "time_lag_statistics",
    f"""WITH {_LT} SELECT direction, i, j, round(mean1 - mean2, 6) + 0.0 AS mean_diff, round((mean1 - mean2) / nullif(sqrt(var1 / n1 + var2 / n2), 0), 6) + 0.0 AS t, round(coalesce((mean1 - mean2) / nullif(sqrt((var1 + var2) / 2), 0), 0), 6) + 0.0 AS cohens_d FROM lm""",
)
def time_lag_statistics(spark: SparkSession, sf: str) -> DataFrame:
    w = inference.welch(inference.two_group_moments(_subject_lags(spark, sf), ["direction", "i", "j"], "grp", "lag_pct", 0, 1))
    return w.select("direction", "i", "j", r6(F.col("mean1") - F.col("mean2")).alias("mean_diff"), r6("t").alias("t"), r6("cohens_d").alias("cohens_d"))


@query("time_lag_tests")
def time_lag_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Welch tests of every pair and direction with p, adjusted per base marker, significance and bands."""
    return inference.lag_tests(_subject_lags(spark, sf), ["direction"], "grp", "lag_pct", 0, 1)


@query("pattern_group_test")
def pattern_group_test(spark: SparkSession, sf: str) -> DataFrame:
    """Pattern sums of both groups, compared behind a normality gate, per pattern and direction."""
    return inference.compare_groups(_scores(spark, sf), ["pattern_grp", "direction"], "grp", "path_sum", 1, 0).withColumn("p_value", F.bround("p_value", 3))


@query("pattern_group_means", f"{_SCORE} SELECT pattern_grp, direction, grp, round(avg(path_sum), 4) + 0.0 AS mean, round(stddev_samp(path_sum), 4) + 0.0 AS std, round(median(path_sum), 4) + 0.0 AS median, count(path_sum) AS n FROM score GROUP BY ALL")
def pattern_group_means(spark: SparkSession, sf: str) -> DataFrame:
    out = _scores(spark, sf).groupBy("pattern_grp", "direction", "grp")
    return out.agg(F.round(F.avg("path_sum"), 4).alias("mean"), F.round(F.stddev_samp("path_sum"), 4).alias("std"), F.round(F.median("path_sum"), 4).alias("median"), F.count("path_sum").alias("n"))


@query("community_fit_test")
def community_fit_test(spark: SparkSession, sf: str) -> DataFrame:
    """Is the fit to the group's communities lower in group 1? (one-sided)"""
    return inference.compare_groups(_fit(spark, sf), ["direction"], "grp", "ari", 1, 0, gate_n=0, equal_gate=False, less=True)


@query("community_fit_means", f"""{_ARI}, f AS (SELECT label % 2 AS grp, direction, coalesce((idx - ra * rb / (t * (t - 1) / 2)) / nullif((ra + rb) / 2 - ra * rb / (t * (t - 1) / 2), 0), 1) AS ari FROM x JOIN ra USING (label, direction) JOIN rb USING (label, direction))
SELECT grp, direction, round(avg(ari), 6) + 0.0 AS mean, count(*) AS n FROM f GROUP BY ALL""")  # fmt: skip
def community_fit_means(spark: SparkSession, sf: str) -> DataFrame:
    return _fit(spark, sf).groupBy("grp", "direction").agg(r6(F.avg("ari")).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("modularity_test")
def modularity_test(spark: SparkSession, sf: str) -> DataFrame:
    """Two-sided comparison of modularity between the groups."""
    return inference.compare_groups(_modularity(spark, sf), ["direction"], "grp", "modularity", 1, 0, gate_n=0, equal_gate=False)


@query(
    "modularity_means",
    f"""{_MOD}, q AS (SELECT dg.label, dg.direction, sum(inn.l / m.m - power(dg.deg / (2 * m.m), 2)) AS q, count(*) AS c FROM dg JOIN inn USING (label, direction, community) JOIN m USING (label, direction) GROUP BY ALL HAVING count(*) > 1),
all_ AS (SELECT DISTINCT s.label, s.direction, q.q FROM (SELECT DISTINCT label, direction FROM alleg) s LEFT JOIN q ON q.label = s.label AND q.direction = s.direction)
SELECT label % 2 AS grp, direction, round(avg(q), 6) + 0.0 AS mean, round(stddev_pop(q), 6) + 0.0 AS std, count(q) AS n FROM all_ GROUP BY ALL""",
)
def modularity_means(spark: SparkSession, sf: str) -> DataFrame:
    return _modularity(spark, sf).groupBy("grp", "direction").agg(r6(F.avg("modularity")).alias("mean"), r6(F.stddev_pop("modularity")).alias("std"), F.count("modularity").alias("n"))


@query("pattern_grid_tests")
def pattern_grid_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Patterns of all lengths up to 20 from every start, tested and corrected per length."""
    return drivers.analyse_patterns(subject_graphs(spark, sf), SUBJECT_KEYS, CHANNELS, longest=20)
