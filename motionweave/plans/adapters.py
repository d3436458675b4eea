"""Bindings of the engine's concepts (subject, frame, channel, cycle) to the test tables.

``embeddings``: a label is a subject (group: label mod 2), its vectors in id order are
frames, dimensions 0..62 are 21 channels in three directions, and each subject has three
cycles.  ``events``: a user is a trial, events in time order are frames.  ``lineitem``: a
supplier is a trial with four channels.  The SQL texts bind the same for the oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motionweave.operators import graph, matrix

CHANNELS, DIRECTIONS, CYCLES = 21, 3, 3
#: Names of the channels: right and left in turn, the last one alone; and the block that its labels are shuffled in.
PAIRED = "sho elbl wrist hand asis psis th sk ank toe".split()
MARKERS = [side + m for m in PAIRED for side in ("r_", "l_")] + ["m_ster"]
BLOCKS = [int(k >= 14) for k in range(CHANNELS)]
EDGE_KEYS = ["label", "cycle", "direction"]
SUBJECT_KEYS = ["label", "direction"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its oracle."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, frame (from 1), cycle, v: all 63 channels of a sample as doubles."""
    w = Window.partitionBy("label")
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.slice("embedding", 1, 63).cast("array<double>").alias("v"))
    e = e.withColumns({"frame": F.row_number().over(w.orderBy("vec_id")).cast("long"), "n": F.count(F.lit(1)).over(w)})
    return e.select("label", "frame", F.floor((F.col("frame") - 1) * CYCLES / F.col("n")).cast("long").alias("cycle"), "v")


def directed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples per direction, with its 21 channels."""
    parts = F.array(*[F.slice("v", 1 + k * CHANNELS, CHANNELS) for k in range(DIRECTIONS)])
    return samples(spark, sf_dir).select("label", "frame", "cycle", F.posexplode(parts).alias("direction", "v")).withColumn("direction", F.col("direction").cast("long"))


def channel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, frame, cycle, direction, m, value."""
    return directed_samples(spark, sf_dir).select("label", "frame", "cycle", "direction", F.posexplode("v").alias("m", "value")).withColumn("m", F.col("m").cast("long"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation network of every subject, cycle and direction."""
    return matrix.pearson(directed_samples(spark, sf_dir), EDGE_KEYS, "v", CHANNELS)


def subject_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean network of every subject and direction."""
    return matrix.cycle_statistics(edges(spark, sf_dir), SUBJECT_KEYS).withColumn("grp", F.col("label") % 2)


def shifted_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shifted(edges(spark, sf_dir), EDGE_KEYS)


def subject_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = subject_edges(spark, sf_dir).select("grp", *SUBJECT_KEYS, "i", "j", F.col("avg").alias("w"))
    return graph.shifted(mean, SUBJECT_KEYS)


def group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.group_mean(subject_edges(spark, sf_dir), ["grp", "direction"])


def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.difference(group_means(spark, sf_dir), ["direction"], "grp", 0, 1)


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, frame (from 0), n, event_type, value."""
    w = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts", "event_id")
    e = e.withColumns({"frame": (F.row_number().over(w.orderBy("ts", "event_id")) - 1).cast("long"), "n": F.count(F.lit(1)).over(w)})
    return e.select("user_id", "frame", "n", "event_type", "value")


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("event_type") == "view", "R").when(F.col("event_type") == "click", "L")
    return event_frames(spark, sf_dir).withColumn("side", side).filter("side is not null").select("user_id", "frame", "n", "side")


def supply_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a supplier, with missing samples where the discount is 0 or the tax is 0."""
    cols = ["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus"]
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select(*cols).withColumn("frame", (F.row_number().over(w) - 1).cast("long"))
    gap = F.col("l_discount") <= 0.02
    return rows.select(
        "l_suppkey", "frame", "l_linestatus", F.when(~gap, F.col("l_quantity")).alias("q"), F.when(F.col("l_tax") > 0.01, F.col("l_extendedprice")).alias("p"),
        F.col("l_discount").alias("d"), F.col("l_tax").alias("t"),
    )


def demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as people: segment gives the diagnosis, the parity of the key the run."""
    c = table(spark, sf_dir, "customer")
    flag = lambda *s: F.col("c_mktsegment").isin(*s).cast("int")
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("age"), F.when(F.col("c_custkey") % 2 == 0, "on").otherwise("off").alias("med_state"),
        flag("AUTOMOBILE", "MACHINERY").alias("diagnosis_parkinson"), flag("BUILDING").alias("diagnosis_old"), flag("FURNITURE").alias("diagnosis_young"),
        F.when(F.col("c_custkey") % 10 == 0, 999).otherwise((F.col("c_custkey") % 3 == 0).cast("int")).alias("handedness"),
        (F.col("c_custkey") % 5).alias("upper_right"), (F.col("c_nationkey") % 5).cast("long").alias("upper_left"),
        (F.col("c_custkey") % 7).alias("lower_right"), (F.col("c_nationkey") % 7).cast("long").alias("lower_left"),
    )


#: The same bindings as common table expressions.
S = """
s AS (SELECT label, frame, ((frame - 1) * 3) // n AS cycle, embedding FROM (
  SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS frame, count(*) OVER (PARTITION BY label) AS n FROM embeddings)),
lng AS (SELECT label, frame, cycle, d // 21 AS direction, d % 21 AS m, embedding[d + 1]::DOUBLE AS v FROM s, range(63) t(d))"""
E = S + """,
edges AS (SELECT a.label, a.cycle, a.direction, a.m AS i, b.m AS j, CASE WHEN stddev_pop(a.v) > 0 AND stddev_pop(b.v) > 0 THEN corr(a.v, b.v) END AS w
  FROM lng a JOIN lng b ON a.label = b.label AND a.frame = b.frame AND a.direction = b.direction AND a.m < b.m GROUP BY ALL)"""
SUBJ = E + """,
subj AS (SELECT label, label % 2 AS grp, direction, i, j, CASE WHEN count(*) = count(w) THEN avg(w) END AS avg, CASE WHEN count(*) = count(w) THEN stddev_pop(w) END AS std, count(*) AS n FROM edges GROUP BY ALL)"""
GRPM = SUBJ + """,
grpm AS (SELECT grp, direction, i, j, round_even(avg(avg), 3) AS avg, round_even(stddev_pop(avg), 3) AS std FROM subj GROUP BY ALL)"""
DIFF = GRPM + """,
diff AS (SELECT direction, i, j, max(avg) FILTER (grp = 0) - max(avg) FILTER (grp = 1) AS d FROM grpm GROUP BY ALL)"""
SHIFT = E + """,
shifted AS (SELECT label, cycle, direction, i, j, w + greatest(-least(min(w) OVER (PARTITION BY label, cycle, direction), 1.0), 0.0) AS w FROM edges WHERE w IS NOT NULL)"""
SGRAPH = SUBJ + """,
sg AS (SELECT grp, label, direction, i, j, avg + greatest(-least(min(avg) OVER (PARTITION BY label, direction), 1.0), 0.0) AS w FROM subj WHERE avg IS NOT NULL),
sym AS (SELECT grp, label, direction, i AS a, j AS b, w FROM sg UNION ALL SELECT grp, label, direction, j, i, w FROM sg)"""
EV = """
ev AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, count(*) OVER (PARTITION BY user_id) AS n FROM events)"""
CON = EV + """,
con AS (SELECT user_id, frame, n, CASE event_type WHEN 'view' THEN 'R' ELSE 'L' END AS side FROM ev WHERE event_type IN ('view', 'click'))"""
CYC = CON + """,
l AS (SELECT user_id, frame AS l, lead(frame) OVER (PARTITION BY user_id ORDER BY frame) AS l2 FROM con WHERE side = 'L'),
r AS (SELECT user_id, frame AS r, n, lead(frame) OVER (PARTITION BY user_id ORDER BY frame) AS r2 FROM con WHERE side = 'R'),
cyc AS (SELECT user_id, r AS start, l2 AS stop FROM (
  SELECT r.user_id, r.r, r.n, l.l2, row_number() OVER (PARTITION BY r.user_id, r.r ORDER BY l.l) AS k FROM r JOIN l ON l.user_id = r.user_id AND l.l > r.r WHERE r.r2 IS NOT NULL)
  WHERE k = 1 AND l2 IS NOT NULL AND l2 <= n)"""
SUP = """
sup AS (SELECT l_suppkey, l_linestatus, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS frame,
  CASE WHEN l_discount > 0.02 THEN l_quantity END AS q, CASE WHEN l_tax > 0.01 THEN l_extendedprice END AS p, l_discount AS d, l_tax AS t FROM lineitem)"""
DEMO = """
demo AS (SELECT c_custkey AS id, c_acctbal AS age, CASE WHEN c_custkey % 2 = 0 THEN 'on' ELSE 'off' END AS med_state,
  CAST(c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') AS INT) AS diagnosis_parkinson, CAST(c_mktsegment = 'BUILDING' AS INT) AS diagnosis_old, CAST(c_mktsegment = 'FURNITURE' AS INT) AS diagnosis_young,
  CASE WHEN c_custkey % 10 = 0 THEN 999 ELSE CAST(c_custkey % 3 = 0 AS INT) END AS handedness,
  c_custkey % 5 AS upper_right, c_nationkey % 5 AS upper_left, c_custkey % 7 AS lower_right, c_nationkey % 7 AS lower_left FROM customer)"""
