"""Counts and values in the windows before and after the index date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.constants import MISSING_LAB, PREVALENCE_SHARE
from cohortloom.functions.columns import encounter_key, flag
from cohortloom.operators.joins import stored_join
from cohortloom.operators.windows import pre_post_pair

DEMOGRAPHICS = ("apprx_age", "sex", "race", "ethn")
HISTORY_FLAGS = ("diabetes_ind", "kidney_ind", "CHF_ind", "ChronicPulm_ind")


def facts_in_windows(facts: DataFrame, cohort: DataFrame, date: str) -> DataFrame:
    """Facts dated in a person's earlier or later window, with span = 'pre' or 'post'.

    A person is one row that carries both windows, so facts meet it by person alone and are read
    once; facts stored by person are not shuffled."""
    day = F.col(date)
    hit = F.filter(F.col("_spans"), lambda s: day.between(s["span_start"], s["span_end"]))
    return (facts.join(cohort.select("person_id", pre_post_pair().alias("_spans")), "person_id")
            .select(*facts.columns, F.explode(F.transform(hit, lambda s: s["span"])).alias("span")))


def pre_post_counts(facts: DataFrame, cohort: DataFrame, visit_map: DataFrame, concept: tuple[str, str], date: str,
                    names: tuple[str, str]) -> DataFrame:
    """Distinct encounters per person and concept in each window, side by side.

    `concept` names the id and name columns, `names` the two outputs. Facts are reduced to one
    row per encounter before the final count, so both counts come from one pass.
    A fact whose visit is unknown is not counted."""
    placed = facts_in_windows(facts.filter(F.col("visit_occurrence_id").isNotNull())
                              .select("person_id", *concept, date, "visit_occurrence_id"), cohort, date)
    visits = visit_map.select("visit_occurrence_id", encounter_key("macrovisit_id", "visit_occurrence_id").alias("enc"))
    return _encounters(placed.join(visits, "visit_occurrence_id"), concept, names)


def window_counts(facts: DataFrame, cohort: DataFrame, concept: tuple[str, str], date: str, names: tuple[str, str]) -> DataFrame:
    """The same counts of facts that carry their encounter (column enc)."""
    return _encounters(facts_in_windows(facts.select("person_id", *concept, date, "enc"), cohort, date), concept, names)


def _encounters(placed: DataFrame, concept: tuple[str, str], names: tuple[str, str]) -> DataFrame:
    per_encounter = (placed.groupBy("person_id", *concept, "enc")
                     .agg(F.max(flag(F.col("span") == "pre")).alias("_pre"),
                          F.max(flag(F.col("span") == "post")).alias("_post")))
    return (per_encounter.groupBy("person_id", *concept)
            .agg(F.sum("_pre").alias(names[0]), F.sum("_post").alias(names[1])))


def inpatient_days(cohort: DataFrame, visit_map: DataFrame) -> DataFrame:
    """Days in episodes that start in the later window, each episode once.

    -> person_id, post_window_start_dt, post_window_end_dt, tot_ip_days"""
    spans = cohort.select("person_id", "post_window_start_dt", "post_window_end_dt")
    stays = (visit_map.filter(F.col("macrovisit_start_date").isNotNull())
             .select("person_id", "macrovisit_start_date", "macrovisit_end_date").distinct())
    day = F.col("macrovisit_start_date")
    inside = stays.join(spans, "person_id").filter(day.between(F.col("post_window_start_dt"), F.col("post_window_end_dt")))
    return (inside.groupBy("person_id", "post_window_start_dt", "post_window_end_dt")
            .agg(F.sum(F.datediff("macrovisit_end_date", "macrovisit_start_date") + 1).alias("tot_ip_days")))


def attach_demographics(counts: DataFrame, cohort: DataFrame, ip_days: DataFrame) -> DataFrame:
    """Counts with demographics, observed span and the two visit ratios of the person."""
    history = [c for c in HISTORY_FLAGS if c in cohort.columns]
    person = (cohort.join(ip_days.select("person_id", "tot_ip_days"), "person_id", "left")
              .select("person_id", "patient_group", *DEMOGRAPHICS, *history, "tot_long_data_days",
                      F.col("post_visits_per_pt_day").alias("op_post_visit_ratio"),
                      F.try_divide(F.coalesce("tot_ip_days", F.lit(0)), "tot_post_days").alias("ip_post_visit_ratio")))
    return counts.join(person, "person_id")


def labs_of_cohort(measurements: DataFrame, cohort: DataFrame, sets: DataFrame) -> DataFrame:
    """Measurements of cohort persons under each concept set they belong to."""
    members = sets.select(F.col("concept_id").alias("measurement_concept_id"), "concept_set_name")
    return stored_join(measurements.join(members, "measurement_concept_id"), cohort.select("person_id"), how="left_semi")


def pre_post_labs(labs: DataFrame, cohort: DataFrame, missing: float = MISSING_LAB) -> DataFrame:
    """Least, greatest and mean lab value per person and set in each window; a side without a
    value gets the sentinel."""
    placed = (facts_in_windows(
        labs.select("person_id", "concept_set_name", "measurement_date", "visit_occurrence_id",
                    "harmonized_value_as_number", "harmonized_unit_concept_id"), cohort, "measurement_date")
        .distinct())
    value = F.col("harmonized_value_as_number")
    cells = []
    for name, fn in (("min", F.min), ("max", F.max), ("avg", F.avg)):
        for span in ("pre", "post"):
            inside = F.when(F.col("span") == span, value)
            cells.append(F.coalesce(fn(inside), F.lit(missing)).alias(f"{span}_{name}_val"))
    return placed.groupBy("person_id", "concept_set_name").agg(*cells)


def lab_population(labs: DataFrame) -> DataFrame:
    """Mean and standard deviation of each lab set and unit."""
    value = F.col("harmonized_value_as_number")
    return (labs.filter(value.isNotNull()).groupBy("concept_set_name", "harmonized_unit_concept_id")
            .agg(F.avg(value).alias("pop_avg"), F.stddev_samp(value).alias("stddev")))


def prevalent_concepts(counts: DataFrame, concept: tuple[str, str], share: float = PREVALENCE_SHARE) -> DataFrame:
    """Concepts held by at least a share of all persons in the table."""
    everyone = counts.agg(F.count_distinct("person_id")).scalar()
    return (counts.groupBy(*concept).agg(F.count_distinct("person_id").alias("pt_count"))
            .filter(F.col("pt_count") >= everyone * share))


def training_prevalence(dx_counts: DataFrame, cohort: DataFrame, more_than: int = 3) -> DataFrame:
    """Later-window diagnoses of training persons held by more than a few of them."""
    training = cohort.filter(F.col("patient_type") == "TRAINING").select("person_id").distinct()
    return (dx_counts.filter(F.col("post_dx_count") > 0).join(training, "person_id", "left_semi")
            .groupBy("condition_concept_id", "condition_concept_name")
            .agg(F.count_distinct("person_id").alias("dxct")).filter(F.col("dxct") > more_than))


def with_post_flags(counts: DataFrame, pre: str, post: str, post_only: str) -> DataFrame:
    """Flags: nothing before the index, and more after than before."""
    return (counts.withColumn(post_only, F.when(F.col(pre) > 0, 0).otherwise(1))
            .withColumn("more_in_post", flag(F.col(post) > F.col(pre))))


def above_threshold(counts: DataFrame, kept: DataFrame, on: str) -> DataFrame:
    """Counts of prevalent concepts only."""
    return counts.join(kept.select(on), on, "left_semi")


def distinct_count(df: DataFrame, column: str, name: str) -> DataFrame:
    """One-row check count."""
    return df.agg(F.count_distinct(column).alias(name))


def rows_by(df: DataFrame, *columns: str, name: str = "row_count") -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias(name))
