"""The index-anchored cohort: eligibility, hospital group, windows and visit rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.constants import (
    FOLLOW_UP_DAYS, HISTORY_DAYS, LATEST_BIRTH_YEAR, NEAR_INDEX_DAYS, RATE_DIVISOR_DAYS, RESEARCH_FOLLOW_UP_DAYS,
)
from cohortloom.functions.columns import approximate_age
from cohortloom.operators.first_dates import is_acute_dx
from cohortloom.operators.intervals import episodes_of
from cohortloom.operators.joins import stored_join
from cohortloom.operators.windows import clinic_ended_windows, pre_post_windows

COMORBIDITIES = ("diabetes_ind", "kidney_ind", "CHF_ind", "ChronicPulm_ind")


# ---------------------------------------------------------------- eligibility
def collect_cohort(index_dates: DataFrame, person: DataFrame, manifest: DataFrame, death: DataFrame,
                   follow_up_days: int = FOLLOW_UP_DAYS, cutoff: str | None = None) -> DataFrame:
    """Persons with enough days between their earliest evidence (or death) and the site's
    last refresh, with demographics. `cutoff` sets one refresh date for all sites.

    -> person_id, apprx_age, sex, race, ethn, site_id, min_covid_dt, run_date"""
    if cutoff is not None:
        manifest = manifest.withColumn("run_date", F.lit(cutoff).cast("date"))
    deaths = death.groupBy("person_id").agg(F.min("death_date").alias("death_date"))
    return (index_dates
            .join(person, "person_id")
            .join(manifest, "data_partner_id")
            .join(deaths, "person_id", "left")
            .filter(F.datediff("run_date", F.least("pos_test_idx", "u07_any_idx", "death_date")) >= follow_up_days)
            .select("person_id", approximate_age("run_date", "year_of_birth").alias("apprx_age"),
                    F.col("gender_concept_name").alias("sex"), F.col("race_concept_name").alias("race"),
                    F.col("ethnicity_concept_name").alias("ethn"), F.col("data_partner_id").alias("site_id"),
                    F.least("pos_test_idx", "u07_any_idx").alias("min_covid_dt"), "run_date")
            .distinct())


# ---------------------------------------------------------------- hospital group
def near_index_persons(cohort: DataFrame, visit_map: DataFrame, days: int = NEAR_INDEX_DAYS) -> DataFrame:
    """Persons with an episode starting within `days` of their index date."""
    spans = cohort.select("person_id", F.date_add("min_covid_dt", -days).alias("near_start"),
                          F.date_add("min_covid_dt", days).alias("near_end"))
    starts = visit_map.filter(F.col("macrovisit_start_date").isNotNull()) \
        .select("person_id", "macrovisit_start_date").distinct()
    near = F.col("macrovisit_start_date").between(F.col("near_start"), F.col("near_end"))
    return starts.join(spans, "person_id").filter(near).select("person_id").distinct()


def acute_episode_persons(visit_map: DataFrame, conditions: DataFrame) -> DataFrame:
    """Persons with an acute diagnosis recorded at a visit inside an episode."""
    acute = conditions.filter(is_acute_dx()).select("visit_occurrence_id").distinct()
    return (visit_map.filter(F.col("macrovisit_id").isNotNull())
            .join(acute, "visit_occurrence_id", "left_semi").select("person_id").distinct())


def hospital_persons(cohort: DataFrame, visit_map: DataFrame, conditions: DataFrame) -> DataFrame:
    """Distinct persons who meet either hospital rule."""
    return near_index_persons(cohort, visit_map).unionByName(acute_episode_persons(visit_map, conditions)).distinct()


def hospitalised_cases(cohort: DataFrame, visit_map: DataFrame, conditions: DataFrame) -> DataFrame:
    """Cohort rows that meet either hospital rule. The persons are stored first, so that the sorts of the rules
    and those of the cohort are not held by one task at the same time."""
    return stored_join(cohort, hospital_persons(cohort, visit_map, conditions), how="left_semi")


def non_hospitalised_cases(cohort: DataFrame, hospitalised: DataFrame) -> DataFrame:
    return cohort.join(hospitalised.select("person_id"), "person_id", "left_anti")


def with_hospital_group(cohort: DataFrame, visit_map: DataFrame, conditions: DataFrame) -> DataFrame:
    """Add patient_group: CASE_HOSP where a hospital rule is met, else CASE_NONHOSP. Stored as in `hospitalised_cases`."""
    cases = hospital_persons(cohort, visit_map, conditions).withColumn("_hosp", F.lit(True))
    return (stored_join(cohort, cases, how="left")
            .withColumn("patient_group", F.when(F.col("_hosp"), "CASE_HOSP").otherwise("CASE_NONHOSP"))
            .drop("_hosp"))


# ---------------------------------------------------------------- visit rates
def _visit_days(visit_map: DataFrame) -> DataFrame:
    """One row per person and visit date: was any visit of that day outside every episode?"""
    return visit_map.groupBy("person_id", "visit_start_date").agg(
        F.max(F.col("macrovisit_id").isNull()).alias("outpatient_day"))


def with_visit_rates(windowed: DataFrame, visit_map: DataFrame, rate_days: int | None = RATE_DIVISOR_DAYS) -> DataFrame:
    """Add the observed span, the number of outpatient dates in the later window and their rate.

    Both come from one join to the person's visit days. `rate_days=None` divides by the length
    of the window instead of a constant (null for an empty window). Persons observed for a
    single day or less are dropped."""
    day = F.col("visit_start_date")
    in_post = F.col("outpatient_day") & day.between(F.col("post_window_start_dt"), F.col("post_window_end_dt"))
    out = (windowed.join(_visit_days(visit_map), "person_id")
           .groupBy(*windowed.columns)
           .agg(F.datediff(F.max(day), F.min(day)).alias("tot_long_data_days"),
                F.count(F.when(in_post, 1)).alias("post_visits_count"))
           .filter(F.col("tot_long_data_days") > 1)
           .withColumn("tot_post_days", F.datediff("post_window_end_dt", "post_window_start_dt")))
    divisor = F.lit(rate_days) if rate_days is not None else F.col("tot_post_days")
    return out.withColumn("post_visits_per_pt_day", F.try_divide("post_visits_count", divisor))


def feature_table_builder(index_dates: DataFrame, person: DataFrame, manifest: DataFrame, death: DataFrame,
                          visit_map: DataFrame, conditions: DataFrame) -> DataFrame:
    """Eligible persons with group, windows, observed span and visit rate; at least one
    outpatient date in the later window."""
    cohort = collect_cohort(index_dates, person, manifest, death)
    grouped = with_hospital_group(cohort, visit_map, conditions)
    windowed = pre_post_windows(grouped).drop("run_date")
    return with_visit_rates(windowed, visit_map).filter(F.col("post_visits_count") >= 1)


# ---------------------------------------------------------------- research variant
def comorbidity_patients(conditions: DataFrame, concepts: DataFrame) -> DataFrame:
    """Persons with the listed codes on at least two dates: number of dates and the first."""
    listed = concepts.select(F.col("concept_id").alias("condition_concept_id"))
    return (conditions.join(listed, "condition_concept_id", "left_semi")
            .groupBy("person_id")
            .agg(F.count_distinct("condition_start_date").alias("dx_count"),
                 F.min("condition_start_date").alias("earliest_dx"))
            .filter(F.col("dx_count") >= 2))


def all_comorbidities(conditions: DataFrame, sets: dict[str, DataFrame]) -> DataFrame:
    """The same for several code sets in one scan of the conditions.

    -> person_id and, per set, <name>_earliest (null where the rule is not met)"""
    listed = None
    for name, members in sets.items():
        part = members.select(F.col("concept_id").alias("condition_concept_id"), F.lit(name).alias("set_name"))
        listed = part if listed is None else listed.unionByName(part)
    dated = (conditions.select("person_id", "condition_concept_id", "condition_start_date")
             .join(listed.distinct(), "condition_concept_id")
             .select("person_id", "set_name", "condition_start_date").distinct())
    met = (dated.groupBy("person_id", "set_name")
           .agg(F.count("condition_start_date").alias("n"), F.min("condition_start_date").alias("earliest"))
           .filter(F.col("n") >= 2))
    return met.groupBy("person_id").agg(
        *[F.min(F.when(F.col("set_name") == name, F.col("earliest"))).alias(f"{name}_earliest") for name in sets])


def with_comorbidity_flags(cohort: DataFrame, comorbid: DataFrame, names: tuple[str, ...] = COMORBIDITIES) -> DataFrame:
    """Yes/No per comorbidity: present, and first seen before the index date."""
    out = cohort.join(comorbid, "person_id", "left")
    for name in names:
        earlier = F.col("min_covid_dt") > F.col(f"{name}_earliest")
        out = out.withColumn(name, F.when(earlier, "Yes").otherwise("No"))
    return out.drop(*[f"{name}_earliest" for name in names])


def followed_up(index: DataFrame, person: DataFrame, manifest: DataFrame, days: int = RESEARCH_FOLLOW_UP_DAYS,
                latest_birth_year: int = LATEST_BIRTH_YEAR) -> DataFrame:
    """Persons born early enough and followed long enough after the index date."""
    return (index.join(person.filter(F.col("year_of_birth") <= latest_birth_year), "person_id")
            .join(manifest, "data_partner_id")
            .withColumn("days_since_covid", F.datediff("run_date", "min_covid_dt"))
            .filter(F.col("days_since_covid") >= days)
            .select("person_id", "min_covid_dt", "gender_concept_name", "year_of_birth", "race_concept_name",
                    "ethnicity_concept_name", "data_partner_id", "days_since_covid"))


def any_history(index: DataFrame) -> DataFrame:
    """First history rule: every distinct indexed person passes."""
    return index.distinct()


def sufficient_history(index: DataFrame, visits: DataFrame, conditions: DataFrame, manifest: DataFrame,
                       days: int = HISTORY_DAYS) -> DataFrame:
    """Second history rule: looking back from the index over diagnosed visits covers at least
    as long as the follow-up, or at least `days`.

    `visits` carries data_partner_id. -> person_id, min_covid_dt, run_date, min_visit_dt, HX_DAYS"""
    diagnosed = conditions.filter(F.col("visit_occurrence_id").isNotNull()).select("visit_occurrence_id").distinct()
    first_visit = (visits.join(diagnosed, "visit_occurrence_id", "left_semi")
                   .groupBy("person_id", "data_partner_id").agg(F.min("visit_start_date").alias("d")))
    seen = (first_visit.join(manifest, "data_partner_id")
            .groupBy("person_id", "run_date").agg(F.min("d").alias("min_visit_dt")))
    lookback = F.datediff("min_covid_dt", "min_visit_dt")
    return (index.join(seen, "person_id")
            .filter((lookback >= F.datediff("run_date", "min_covid_dt")) | (lookback >= days))
            .select("person_id", "min_covid_dt", "run_date", "min_visit_dt",
                    F.datediff("run_date", "min_visit_dt").alias("HX_DAYS")))


def research_cohort(followed: DataFrame, comorbid: DataFrame, anchor_year: int = 2021) -> DataFrame:
    """Demographics with age at a fixed year and the comorbidity flags."""
    base = followed.filter(F.col("year_of_birth").isNotNull()).select(
        "person_id", (F.lit(anchor_year) - F.col("year_of_birth")).alias("apprx_age"),
        F.col("gender_concept_name").alias("sex"), F.col("race_concept_name").alias("race"),
        F.col("ethnicity_concept_name").alias("ethn"), F.col("data_partner_id").alias("site_id"), "min_covid_dt")
    return with_comorbidity_flags(base, comorbid).distinct()


def research_feature_table(cohort: DataFrame, hospitalised: DataFrame, clinic: DataFrame,
                           visit_map: DataFrame) -> DataFrame:
    """Group and training flag in one pass, windows ended by the clinic date, visit rate per
    window day."""
    cases = hospitalised.select("person_id", F.lit(True).alias("_hosp")).distinct()
    grouped = (cohort.join(cases, "person_id", "left")
               .withColumn("patient_group", F.when(F.col("_hosp"), "CASE_HOSP").otherwise("CASE_NONHOSP"))
               .join(clinic, "person_id", "left"))
    windowed = clinic_ended_windows(grouped).drop("_hosp", "first_LC_clin_dt")
    return with_visit_rates(windowed, visit_map, rate_days=None)


def flagged_only(features: DataFrame, clinic: DataFrame) -> DataFrame:
    return features.join(clinic.select("person_id"), "person_id", "left_semi").distinct()


def not_flagged_only(features: DataFrame, clinic: DataFrame) -> DataFrame:
    return features.join(clinic.select("person_id"), "person_id", "left_anti")


def cohort_episodes(cohort: DataFrame, visit_map: DataFrame) -> DataFrame:
    """Distinct episodes of cohort persons."""
    return episodes_of(visit_map).join(cohort.select("person_id"), "person_id", "left_semi")
