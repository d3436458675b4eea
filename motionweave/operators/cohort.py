"""Cohort selection: diagnoses, controls, medication runs and demographic rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def subject_code(c: str = "id") -> Column:
    return F.format_string("pp%03d", F.col(c))


def subject_number(c: str = "sub_id") -> Column:
    return F.substring(c, 3, 20).cast("long")


def select_subjects(demographics: DataFrame, diagnoses: list[str], run: str | None = None) -> DataFrame:
    """(diagnosis, sub_id), distinct within each diagnosis; a run narrows Parkinson patients."""
    parts = []
    for d in diagnoses:
        part = demographics.filter(F.col(d) == 1)
        if run is not None and "parkinson" in d:
            part = part.filter(F.col("med_state") == run)
        parts.append(part.select(F.lit(d).alias("diagnosis"), subject_code().alias("sub_id")).distinct())
    return reduce(DataFrame.unionByName, parts)


def oldest_controls(demographics: DataFrame, controls: DataFrame, n: int) -> DataFrame:
    """Distinct ids among the first ``n`` control rows by age, oldest first; ties by id.

    A top-n sort: tasks keep n rows each, so nothing is sorted as a whole.
    """
    rows = demographics.withColumn("sub_id", subject_code()).join(controls, "sub_id", "left_semi")
    return rows.orderBy(F.col("age").desc(), F.col("id"), F.col("med_state")).limit(n).select("sub_id").distinct()


def define_groups(demographics: DataFrame, diagnosis: str, run: str, n: int) -> DataFrame:
    """(grp, sub_id): patients of one run, and as many of the oldest controls."""
    patients = select_subjects(demographics, [diagnosis], run).select("sub_id")
    controls = select_subjects(demographics, ["diagnosis_old", "diagnosis_young"]).select("sub_id")
    chosen = oldest_controls(demographics, controls, n)
    return patients.select(F.lit("patient").alias("grp"), "sub_id").union(chosen.select(F.lit("control").alias("grp"), "sub_id"))


def resolve_run(subjects: DataFrame, on_ids: list[str]) -> DataFrame:
    """Patients known to be 'on' get that run, controls none, others the asked one."""
    run = F.when(F.col("sub_id").isin(on_ids), F.lit("on")).when(F.col("grp") == "control", F.lit(None)).otherwise(F.col("run"))
    return subjects.withColumn("run", run)


def demographics_row(asked: DataFrame, demographics: DataFrame) -> DataFrame:
    """The demographic rows of (sub_id, run); without a run every state matches."""
    left = asked.withColumn("id", subject_number())
    right = demographics.select("id", "age", F.upper("med_state").alias("state"))
    joined = left.join(right, "id")
    return joined.filter(F.col("run").isNull() | (F.upper("run") == F.col("state"))).select("sub_id", "run", "id", "age", "state")


def more_affected(df: DataFrame) -> DataFrame:
    """More affected side of arms and legs from part sums; a tie goes to the side not dominant."""
    other = F.when(F.coalesce(F.col("handedness"), F.lit(0)).isin(0, 999), "left").when(F.col("handedness") == 1, "right")

    def side(right: str, left: str) -> Column:
        return F.when(F.col(right) > F.col(left), "right").when(F.col(right) < F.col(left), "left").otherwise(other)

    return df.withColumns({"upper_side": side("upper_right", "upper_left"), "lower_side": side("lower_right", "lower_left")})


#: Columns of the scores whose sums tell the affected side of arms and legs.
SCORES = {
    "upper_right": ["updrs_3_3_rigidity_rue", "updrs_3_4_finger_taps_r", "updrs_3_5_hand_movement_r", "updrs_3_6_pro_sub_hand_r"],
    "upper_left": ["updrs_3_3_rigidity_lue", "updrs_3_4_finger_taps_l", "updrs_3_5_hand_movement_l", "updrs_3_6_pro_sub_hand_l"],
    "lower_right": ["updrs_3_3_rigidity_rle", "updrs_3_7_foot_tap_r", "updrs_3_8_leg_agility_r"],
    "lower_left": ["updrs_3_3_rigidity_lle", "updrs_3_7_foot_tap_l", "updrs_3_8_leg_agility_l"],
}


def affected_sides(demographics: DataFrame, subjects: DataFrame) -> DataFrame:
    """(sub_id, upper_side, lower_side) from the scores of each subject's run, or of all its rows without one.

    Missing scores, and scores that the table has no column for, count as zero.
    """
    has = set(demographics.columns)
    total = {name: reduce(Column.__add__, [F.coalesce(F.col(c), F.lit(0)) for c in parts if c in has], F.lit(0)) for name, parts in SCORES.items()}
    handedness = F.col("handedness") if "handedness" in has else F.lit(None).cast("int")
    rows = demographics.select(subject_code().alias("sub_id"), F.lower("med_state").alias("_state"), handedness.alias("handedness"), *[v.alias(k) for k, v in total.items()])
    own = subjects.select("sub_id", F.col("run").alias("_run")).join(rows, "sub_id").filter(F.col("_run").isNull() | (F.col("_run") == F.col("_state")))
    sums = own.groupBy("sub_id").agg(F.max("handedness").alias("handedness"), *[F.sum(k).alias(k) for k in SCORES])
    return more_affected(sums).select("sub_id", "upper_side", "lower_side")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows per key; the ranking keeps n rows per task before its shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
