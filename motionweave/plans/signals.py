"""Queries on cohorts, files and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionweave.functions.core import r6
from motionweave.operators import cohort, signal
from motionweave.plans.adapters import CON, CYC, DEMO, EV, S, SUP, channel_rows, contacts, demographics, event_frames, query, samples, supply_frames, table
from motionweave.sources import catalog


@query(
    "cohort_select",
    f"""WITH {DEMO} SELECT DISTINCT 'diagnosis_parkinson' AS diagnosis, printf('pp%03d', id) AS sub_id FROM demo WHERE diagnosis_parkinson = 1 AND med_state = 'on'
UNION ALL SELECT DISTINCT 'diagnosis_old', printf('pp%03d', id) FROM demo WHERE diagnosis_old = 1
UNION ALL SELECT DISTINCT 'diagnosis_young', printf('pp%03d', id) FROM demo WHERE diagnosis_young = 1""",
)
def cohort_select(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.select_subjects(demographics(spark, sf), ["diagnosis_parkinson", "diagnosis_old", "diagnosis_young"], "on")


@query(
    "cohort_oldest_n",
    f"WITH {DEMO} SELECT DISTINCT sub_id FROM (SELECT printf('pp%03d', id) AS sub_id FROM demo WHERE diagnosis_old = 1 OR diagnosis_young = 1 ORDER BY age DESC, id, med_state LIMIT 40)",
)
def cohort_oldest_n(spark: SparkSession, sf: str) -> DataFrame:
    d = demographics(spark, sf)
    return cohort.oldest_controls(d, cohort.select_subjects(d, ["diagnosis_old", "diagnosis_young"]).select("sub_id"), 40)


@query(
    "cohort_groups",
    f"""WITH {DEMO} SELECT DISTINCT 'patient' AS grp, printf('pp%03d', id) AS sub_id FROM demo WHERE diagnosis_parkinson = 1 AND med_state = 'on'
UNION ALL SELECT DISTINCT 'control', sub_id FROM (SELECT printf('pp%03d', id) AS sub_id FROM demo WHERE diagnosis_old = 1 OR diagnosis_young = 1 ORDER BY age DESC, id, med_state LIMIT 25)""",
)
def cohort_groups(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.define_groups(demographics(spark, sf), "diagnosis_parkinson", "on", 25)


@query(
    "run_resolution",
    f"""WITH {DEMO} SELECT printf('pp%03d', id) AS sub_id, CASE WHEN id IN (2, 4, 7) THEN 'on' WHEN diagnosis_parkinson = 1 THEN 'off' END AS run FROM demo""",
)
def run_resolution(spark: SparkSession, sf: str) -> DataFrame:
    grp = F.when(F.col("diagnosis_parkinson") == 1, "patient").otherwise("control")
    asked = demographics(spark, sf).select(cohort.subject_code().alias("sub_id"), grp.alias("grp"), F.lit("off").alias("run"))
    return cohort.resolve_run(asked, ["pp002", "pp004", "pp007"]).select("sub_id", "run")


@query(
    "demographics_row",
    f"""WITH {DEMO}, asked AS (SELECT printf('pp%03d', o_custkey) AS sub_id, o_custkey AS id, CASE o_orderstatus WHEN 'F' THEN 'on' WHEN 'O' THEN 'off' END AS run FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders))
SELECT a.sub_id, a.run, d.id, round(d.age, 6) + 0.0 AS age, upper(d.med_state) AS state FROM asked a JOIN demo d ON a.id = d.id WHERE a.run IS NULL OR upper(a.run) = upper(d.med_state)""",
)
def demographics_row(spark: SparkSession, sf: str) -> DataFrame:
    run = F.when(F.col("o_orderstatus") == "F", "on").when(F.col("o_orderstatus") == "O", "off")
    asked = table(spark, sf, "orders").select("o_custkey", "o_orderstatus").distinct().select(cohort.subject_code("o_custkey").alias("sub_id"), run.alias("run"))
    return cohort.demographics_row(asked, demographics(spark, sf)).withColumn("age", r6("age"))


@query(
    "affected_side",
    f"""WITH {DEMO}, o AS (SELECT *, CASE WHEN coalesce(handedness, 0) IN (0, 999) THEN 'left' WHEN handedness = 1 THEN 'right' END AS other FROM demo)
SELECT id, CASE WHEN upper_right > upper_left THEN 'right' WHEN upper_right < upper_left THEN 'left' ELSE other END AS upper_side,
  CASE WHEN lower_right > lower_left THEN 'right' WHEN lower_right < lower_left THEN 'left' ELSE other END AS lower_side FROM o""",
)
def affected_side(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.more_affected(demographics(spark, sf)).select("id", "upper_side", "lower_side")


@query("semi_join_controls", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_join_controls(spark: SparkSession, sf: str) -> DataFrame:
    urgent = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(urgent, "c_custkey", "left_semi").select("c_custkey", "c_name")


_FILES = """files AS (SELECT printf('sub-pp%03d_task-walk%s_%stracksys-%s_acc_kinct%d-%d_%s.npy', c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Fast' WHEN 1 THEN 'Slow' ELSE 'Preferred' END,
  CASE c_custkey % 4 WHEN 0 THEN 'run-on_' WHEN 1 THEN 'run-off_' ELSE '' END, CASE WHEN c_custkey % 7 = 0 THEN 'imu' ELSE 'omc' END, c_custkey % 900, c_custkey % 900 + 200,
  CASE c_custkey % 5 WHEN 0 THEN 'pears_interpol' WHEN 1 THEN 'pears_full' WHEN 2 THEN 'cross' ELSE 'pears' END) AS name FROM customer)"""


def _files(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    task = F.when(k % 3 == 0, "Fast").when(k % 3 == 1, "Slow").otherwise("Preferred")
    run = F.when(k % 4 == 0, "run-on_").when(k % 4 == 1, "run-off_").otherwise("")
    method = F.when(k % 5 == 0, "pears_interpol").when(k % 5 == 1, "pears_full").when(k % 5 == 2, "cross").otherwise("pears")
    name = F.format_string("sub-pp%03d_task-walk%s_%stracksys-%s_acc_kinct%d-%d_%s.npy", k, task, run, F.when(k % 7 == 0, "imu").otherwise("omc"), k % 900, k % 900 + 200, method)
    return table(spark, sf, "customer").select(name.alias("name"))


@query(
    "filename_key_extract",
    f"""WITH {_FILES} SELECT name, regexp_extract(name, 'sub-([^_]+)', 1) AS sub_id, regexp_extract(name, 'task-([^_]+)', 1) AS task, nullif(regexp_extract(name, 'run-([^_]+)', 1), '') AS run,
  regexp_extract(name, 'tracksys-([^_]+)', 1) AS tracksys, CAST(regexp_extract(name, 'kinct(\\d+)-(\\d+)', 1) AS BIGINT) AS start, CAST(regexp_extract(name, 'kinct(\\d+)-(\\d+)', 2) AS BIGINT) AS stop FROM files""",
)
def filename_key_extract(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.file_keys(_files(spark, sf)).select("name", "sub_id", "task", "run", "tracksys", "start", "stop")


@query(
    "matrix_file_filter",
    f"""WITH {_FILES} SELECT name, CAST(regexp_extract(name, 'kinct(\\d+)-', 1) AS BIGINT) AS start FROM files
WHERE contains(name, 'task-walkFast') AND contains(name, 'tracksys-omc') AND contains(name, '_acc_') AND contains(name, 'pears') AND contains(name, 'run-on') AND NOT contains(name, 'full') AND NOT contains(name, 'interpol')""",
)
def matrix_file_filter(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.pick_matrices(_files(spark, sf), "walkFast", "omc", "acc", "pears", run="on").select("name", "start")


@query(
    "event_file_pick",
    f"""WITH {_FILES}, k AS (SELECT name, regexp_extract(name, 'task-([^_]+)', 1) AS task, regexp_extract(name, 'tracksys-([^_]+)', 1) AS tracksys, nullif(regexp_extract(name, 'run-([^_]+)', 1), '') AS run FROM files)
SELECT task, tracksys, min(name) AS name FROM (SELECT *, bool_or(run IS NOT NULL) OVER (PARTITION BY task, tracksys) AS any_run FROM k) WHERE (any_run AND run = 'off') OR (NOT any_run AND run IS NULL) GROUP BY ALL""",
)
def event_file_pick(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.first_of_run(catalog.file_keys(_files(spark, sf)), ["task", "tracksys"], "off").select("task", "tracksys", "name")


@query(
    "page_url_keys",
    "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{2})/', 1) AS lang, regexp_extract(url, '/(\\d+)', 1) AS number FROM pages",
)
def page_url_keys(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, sf, "pages").select("page_id", part("^[a-z]+://([^/?#]+)").alias("host"), part("^[a-z]+://[^/]+/([a-z]{2})/").alias("lang"), part(r"/(\d+)").alias("number"))


@query(
    "unpivot_channels",
    f"""WITH {SUP} SELECT l_suppkey, channel, count(v) AS n, round(sum(v), 3) + 0.0 AS total FROM (SELECT l_suppkey, 'q' AS channel, q AS v FROM sup UNION ALL SELECT l_suppkey, 'p', p FROM sup UNION ALL SELECT l_suppkey, 'd', d FROM sup UNION ALL SELECT l_suppkey, 't', t FROM sup) GROUP BY ALL""",
)
def unpivot_channels(spark: SparkSession, sf: str) -> DataFrame:
    rows = supply_frames(spark, sf).unpivot(["l_suppkey"], ["q", "p", "d", "t"], "channel", "v")
    return rows.groupBy("l_suppkey", "channel").agg(F.count("v").alias("n"), F.round(F.sum("v"), 3).alias("total"))


@query(
    "missing_marker_anti",
    f"""WITH {EV}, have AS (SELECT DISTINCT user_id, event_type FROM ev WHERE value > 60)
SELECT u.user_id, t.event_type AS missing FROM (SELECT DISTINCT user_id FROM ev) u, (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS event_type) t
WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.user_id = u.user_id AND h.event_type = t.event_type)""",
)
def missing_marker_anti(spark: SparkSession, sf: str) -> DataFrame:
    types = F.array(*map(F.lit, ["click", "error", "purchase", "signup", "view"]))
    e = table(spark, sf, "events").select("user_id", "event_type", "value")
    # One aggregation gives what a trial has; the rest of the list is the anti-join.
    have = e.groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 60, F.col("event_type"))).alias("have"))
    return have.select("user_id", F.explode(F.array_except(types, "have")).alias("missing"))


@query(
    "complete_trials",
    f"WITH {EV} SELECT user_id, count(DISTINCT event_type) AS markers, count(*) AS frames FROM ev WHERE value > 60 GROUP BY user_id HAVING count(DISTINCT event_type) = 5",
)
def complete_trials(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").filter("value > 60").groupBy("user_id").agg(F.size(F.collect_set("event_type")).cast("long").alias("markers"), F.count(F.lit(1)).alias("frames"))
    return e.filter("markers = 5")


@query(
    "trial_trim",
    f"""WITH {EV}, m AS (SELECT user_id, min(frame) FILTER (event_type = 'signup') AS a, min(frame) FILTER (event_type = 'error') AS z FROM ev GROUP BY user_id)
SELECT user_id, frame - a AS frame, event_type, round(value, 6) + 0.0 AS value FROM ev JOIN m USING (user_id) WHERE frame >= a AND frame < z""",
)
def trial_trim(spark: SparkSession, sf: str) -> DataFrame:
    f = event_frames(spark, sf)
    cut = signal.trim(f, f.select("user_id", F.col("frame").alias("onset"), "event_type"), ["user_id"], "signup", "error")
    return cut.select("user_id", "frame", "event_type", r6("value").alias("value"))


@query(
    "cluster_midpoint_avg",
    f"""WITH {S} SELECT label, frame, direction, cluster, round(avg(v), 6) + 0.0 AS value FROM (SELECT label, frame, direction, CASE WHEN m < 18 THEN m // 3 END AS cluster, CASE WHEN abs(v) < 0.25 THEN v END AS v FROM lng)
WHERE cluster IS NOT NULL GROUP BY ALL""",
)
def cluster_midpoint_avg(spark: SparkSession, sf: str) -> DataFrame:
    rows = channel_rows(spark, sf).withColumn("value", F.when(F.abs("value") < 0.25, F.col("value")))
    means = signal.cluster_means(rows, ["label", "frame", "direction"], F.when(F.col("m") < 18, F.floor(F.col("m") / 3).cast("long")))
    return means.withColumn("value", r6("value"))


@query("hip_midpoint", f"WITH {S} SELECT label, frame, direction, m // 2 AS side, round(avg(v), 6) + 0.0 AS value FROM lng WHERE m < 4 GROUP BY ALL")
def hip_midpoint(spark: SparkSession, sf: str) -> DataFrame:
    rows = channel_rows(spark, sf).filter("m < 4")
    means = signal.cluster_means(rows, ["label", "frame", "direction"], F.floor(F.col("m") / 2).cast("long"))
    return means.select("label", "frame", "direction", F.col("cluster").alias("side"), r6("value").alias("value"))


@query(
    "nan_streaks",
    f"""WITH {SUP}, i AS (SELECT l_suppkey, frame, q, count(q) OVER (PARTITION BY l_suppkey ORDER BY frame) AS island FROM sup)
SELECT l_suppkey, max(gap) AS longest_gap FROM (SELECT l_suppkey, island, count(*) FILTER (q IS NULL) AS gap FROM i GROUP BY ALL) GROUP BY l_suppkey""",
)
def nan_streaks(spark: SparkSession, sf: str) -> DataFrame:
    return signal.longest_gap(supply_frames(spark, sf), ["l_suppkey"], "frame", "q")


_FILL = f"""{SUP}, g AS (SELECT *, max(CASE WHEN q IS NOT NULL THEN frame END) OVER (PARTITION BY l_suppkey ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
  min(CASE WHEN q IS NOT NULL THEN frame END) OVER (PARTITION BY l_suppkey ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS z FROM sup),
filled AS (SELECT g.l_suppkey, g.frame, coalesce(g.q, CASE WHEN g.z - g.a - 1 <= 2 THEN x.q + (y.q - x.q) * ((g.frame - g.a) / (g.z - g.a)) END) AS q FROM g
  LEFT JOIN sup x ON x.l_suppkey = g.l_suppkey AND x.frame = g.a LEFT JOIN sup y ON y.l_suppkey = g.l_suppkey AND y.frame = g.z)"""


@query("gap_fill_linear", f"WITH {_FILL} SELECT l_suppkey, frame, round(q, 6) + 0.0 AS q FROM filled")
def gap_fill_linear(spark: SparkSession, sf: str) -> DataFrame:
    return signal.fill_gaps(supply_frames(spark, sf).select("l_suppkey", "frame", "q"), ["l_suppkey"], "frame", "q", 2).withColumn("q", r6("q"))


@query(
    "residual_nan_streaks",
    f"""WITH {_FILL}, i AS (SELECT l_suppkey, frame, q, count(q) OVER (PARTITION BY l_suppkey ORDER BY frame) AS island FROM filled)
SELECT l_suppkey, max(gap) AS longest_gap FROM (SELECT l_suppkey, island, count(*) FILTER (q IS NULL) AS gap FROM i GROUP BY ALL) GROUP BY l_suppkey""",
)
def residual_nan_streaks(spark: SparkSession, sf: str) -> DataFrame:
    filled = signal.fill_gaps(supply_frames(spark, sf).select("l_suppkey", "frame", "q"), ["l_suppkey"], "frame", "q", 2)
    return signal.longest_gap(filled, ["l_suppkey"], "frame", "q")


@query(
    "rigid_cluster_fill",
    f"""WITH {SUP}, x AS (SELECT l_suppkey, frame, q AS a, p AS b, d AS c FROM sup), k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY frame DESC) AS k FROM x WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL),
o AS (SELECT l_suppkey, avg(a - b) AS ab, avg(a - c) AS ac, avg(b - a) AS ba, avg(b - c) AS bc FROM k WHERE k <= 5 GROUP BY ALL)
SELECT x.l_suppkey, frame, round(coalesce(a, b + ab, c + ac), 6) + 0.0 AS a, round(coalesce(b, a + ba, c + bc), 6) + 0.0 AS b, round(c, 6) + 0.0 AS c FROM x LEFT JOIN o USING (l_suppkey)""",
)
def rigid_cluster_fill(spark: SparkSession, sf: str) -> DataFrame:
    x = supply_frames(spark, sf).select("l_suppkey", "frame", F.col("q").alias("a"), F.col("p").alias("b"), F.col("d").alias("c"))
    return signal.fill_from_cluster(x, ["l_suppkey"], "frame", ["a", "b", "c"]).withColumns({c: r6(c) for c in "abc"})


_V = f"""{SUP}, v AS (SELECT l_suppkey, frame, (p - lag(p) OVER w) * 200.0 / 1000 AS p, (t - lag(t) OVER w) * 200.0 / 1000 AS t FROM sup WINDOW w AS (PARTITION BY l_suppkey ORDER BY frame)),
vel AS (SELECT * FROM v WHERE p IS NOT NULL AND t IS NOT NULL)"""


@query("velocity", f"WITH {_V} SELECT l_suppkey, frame, round(p, 6) + 0.0 AS p, round(t, 6) + 0.0 AS t FROM vel")
def velocity(spark: SparkSession, sf: str) -> DataFrame:
    v = signal.velocity(supply_frames(spark, sf).select("l_suppkey", "frame", "p", "t"), ["l_suppkey"], ["frame"], ["p", "t"], 200.0)
    return v.withColumns({"p": r6("p"), "t": r6("t")})


@query(
    "acceleration_raw",
    f"""WITH {_V}, a AS (SELECT l_suppkey, frame, (p - lag(p) OVER w) * 200.0 AS p, (t - lag(t) OVER w) * 200.0 AS t FROM vel WINDOW w AS (PARTITION BY l_suppkey ORDER BY frame))
SELECT l_suppkey, frame, round(p, 4) + 0.0 AS p, round(t, 6) + 0.0 AS t FROM a WHERE p IS NOT NULL AND t IS NOT NULL""",
)
def acceleration_raw(spark: SparkSession, sf: str) -> DataFrame:
    a = signal.acceleration(supply_frames(spark, sf).select("l_suppkey", "frame", "p", "t"), ["l_suppkey"], ["frame"], ["p", "t"], 200.0)
    return a.withColumns({"p": F.round("p", 4), "t": r6("t")})


@query(
    "pca_rotate_2d",
    f"""WITH {S}, x AS (SELECT label, frame, embedding[1]::DOUBLE AS x, embedding[22]::DOUBLE AS y FROM s), t AS (SELECT label, atan2(2 * covar_samp(x, y), var_samp(x) - var_samp(y)) / 2 AS t FROM x GROUP BY label HAVING count(*) = count(x + y)),
c AS (SELECT label, cos(t) AS c, sin(t) AS s FROM t WHERE t IS NOT NULL)
SELECT label, frame, round((CASE WHEN abs(c) >= abs(s) THEN sign(c) ELSE sign(s) END) * (x * c + y * s), 6) + 0.0 AS axis1, round((CASE WHEN abs(s) >= abs(c) THEN sign(-s) ELSE sign(c) END) * (y * c - x * s), 6) + 0.0 AS axis2 FROM x JOIN c USING (label)""",
)
def pca_rotate_2d(spark: SparkSession, sf: str) -> DataFrame:
    x = samples(spark, sf).select("label", "frame", F.col("v")[0].alias("x"), F.col("v")[21].alias("y"))
    return signal.rotate(x, ["label"], "x", "y").select("label", "frame", r6("axis1").alias("axis1"), r6("axis2").alias("axis2"))


@query("gait_cycles_rll", f"WITH {CYC} SELECT * FROM cyc")
def gait_cycles_rll(spark: SparkSession, sf: str) -> DataFrame:
    return signal.cycles_right_left_left(contacts(spark, sf), ["user_id"])


@query(
    "gait_cycles_same_side",
    f"WITH {CON} SELECT user_id, side, start, stop FROM (SELECT user_id, side, frame AS start, lead(frame) OVER (PARTITION BY user_id, side ORDER BY frame) AS stop FROM con) WHERE stop IS NOT NULL",
)
def gait_cycles_same_side(spark: SparkSession, sf: str) -> DataFrame:
    return signal.cycles_same_side(contacts(spark, sf), ["user_id"])


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    cycles = signal.cycles_right_left_left(contacts(spark, sf), ["user_id"])
    return signal.segment(event_frames(spark, sf).select("user_id", "frame", "value"), cycles, ["user_id"])


@query(
    "cycle_segment_range_join",
    f"WITH {CYC} SELECT user_id, start, stop, count(*) AS frames, round(avg(value), 6) + 0.0 AS mean FROM ev JOIN cyc USING (user_id) WHERE frame >= start AND frame < stop GROUP BY ALL",
)
def cycle_segment_range_join(spark: SparkSession, sf: str) -> DataFrame:
    return _segments(spark, sf).groupBy("user_id", "start", "stop").agg(F.count(F.lit(1)).alias("frames"), r6(F.avg("value")).alias("mean"))


@query(
    "cycle_segment_shifted",
    f"""WITH {CYC}, v AS (SELECT user_id, frame - 1 AS pos, (value - lag(value) OVER (PARTITION BY user_id ORDER BY frame)) * 200.0 / 1000 AS v FROM ev)
SELECT user_id, start, stop, count(*) AS frames, round(avg(v), 6) + 0.0 AS mean FROM v JOIN cyc USING (user_id) WHERE v IS NOT NULL AND pos >= start AND pos < stop GROUP BY ALL""",
)
def cycle_segment_shifted(spark: SparkSession, sf: str) -> DataFrame:
    """Positions count from the first row that differentiation leaves, one after the event's frame."""
    v = signal.velocity(event_frames(spark, sf).select("user_id", "frame", "value"), ["user_id"], ["frame"], ["value"], 200.0)
    v = signal.number_frames(v, ["user_id"], ["frame"], "pos")
    cycles = signal.cycles_right_left_left(contacts(spark, sf), ["user_id"])
    cut = signal.segment(v, cycles, ["user_id"], "pos")
    return cut.groupBy("user_id", "start", "stop").agg(F.count(F.lit(1)).alias("frames"), r6(F.avg("value")).alias("mean"))


@query(
    "resample_lerp",
    f"""WITH {CYC}, p AS (SELECT user_id, start, row_number() OVER (PARTITION BY user_id, start ORDER BY frame) - 1 AS p, count(*) OVER (PARTITION BY user_id, start) AS n, value FROM ev JOIN cyc USING (user_id) WHERE frame >= start AND frame < stop),
k AS (SELECT DISTINCT user_id, start, n, k, k::DOUBLE * (n - 1) / 499 AS t FROM p, range(500) r(k)), q AS (SELECT *, floor(t)::BIGINT AS lo, least(floor(t)::BIGINT + 1, n - 1) AS hi FROM k)
SELECT q.user_id, q.start, k, round(a.value + (b.value - a.value) * (t - lo), 6) + 0.0 AS value FROM q JOIN p a ON a.user_id = q.user_id AND a.start = q.start AND a.p = lo JOIN p b ON b.user_id = q.user_id AND b.start = q.start AND b.p = hi""",
)
def resample_lerp(spark: SparkSession, sf: str) -> DataFrame:
    out = signal.resample(_segments(spark, sf), ["user_id", "start"], "frame", "value", 500)
    return out.select("user_id", "start", F.col("k").cast("long").alias("k"), r6("value").alias("value"))


@query("butter_lowpass")
def butter_lowpass(spark: SparkSession, sf: str) -> DataFrame:
    rows = channel_rows(spark, sf).select("label", "direction", "m", "frame", "value")
    return signal.low_pass(rows, ["label"], "frame", "value", 6.0, 200.0, ["direction", "m"]).withColumn("value", r6("value"))


@query("preprocess_acceleration")
def preprocess_acceleration(spark: SparkSession, sf: str) -> DataFrame:
    """The whole chain on all channels: gap filling, low-pass, two derivatives of complete frames, low-pass."""
    names, key = ["q", "p", "d", "t"], ["l_suppkey"]
    filled = signal.fill_gaps(supply_frames(spark, sf).select(*key, "frame", *names), key, "frame", names, 271)
    smooth = signal.low_pass_columns(filled.dropna("all", subset=names), key, "frame", names, 6.0, 200.0)
    a = signal.low_pass_columns(signal.acceleration(smooth, key, ["frame"], names, 200.0), key, "frame", names, 4.0, 200.0)
    return a.unpivot([*key, "frame"], names, "channel", "value").select(*key, "channel", "frame", F.round("value", 4).alias("value"))
