"""Rolling-window cohort: first flag dates, chains of repeat infections, blackout spans, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.constants import (
    BLACKOUT_DAYS, CLINIC_OBSERVATION, FACT_DATE_FLOOR, INFECTIOUS_SEQUELA_DX, LABEL_DATE_FLOOR,
    REPEAT_GAP_DAYS, ROLLING_SEQUEL_DX,
)
from cohortloom.operators.first_dates import first_dates


def covid_cohort(facts: DataFrame, date_floor: str = FACT_DATE_FLOOR) -> DataFrame:
    """First date of each of seven kinds of evidence since the floor, in one aggregate.

    The two components of the antiviral count only when flagged on the same row.
    -> person_id, seven first dates, earliest of test and diagnosis"""
    def on(c: str):
        return F.col(c) == 1

    rules = {
        "COVID_first_PCR_or_AG_lab_positive": on("PCR_AG_Pos"),
        "COVID_first_diagnosis_date": on("LL_COVID_diagnosis"),
        "Long_COVID_first_diagnosis_date": on("LL_Long_COVID_diagnosis"),
        "B94_8_first_diagnosis_date": on("B94_8"),
        "first_pax_date": on("PAXLOVID") | (on("PAX1_NIRMATRELVIR") & on("PAX2_RITONAVIR")),
        "first_rem_date": on("REMDISIVIR"),
        "MISC_first_diagnosis_date": on("LL_MISC"),
    }
    recent = facts.filter(F.col("date") >= F.lit(date_floor).cast("date"))
    return first_dates(recent, "date", rules).withColumn(
        "COVID_first_poslab_or_diagnosis_date",
        F.least("COVID_first_PCR_or_AG_lab_positive", "COVID_first_diagnosis_date"))


def greedy_chain(anchors: DataFrame, events: DataFrame, anchor: str, date: str, gap_days: int = REPEAT_GAP_DAYS,
                 key: str = "person_id", keep_unanchored: bool = False) -> DataFrame:
    """Chain of dates more than `gap_days` apart: the anchor, then each time the first event
    date more than `gap_days` after the date last taken.

    The dates of a key are made distinct before they are collected, so an array holds at most
    one entry per calendar day. -> key, chain_date, chain_number (0 = anchor)"""
    dates = (events.select(key, F.col(date).alias("_d")).filter(F.col("_d").isNotNull()).distinct()
             .groupBy(key).agg(F.array_sort(F.collect_list("_d")).alias("_dates")))
    start = anchors.select(key, F.col(anchor).alias("_start"))
    if not keep_unanchored:
        start = start.filter(F.col("_start").isNotNull())
    chain = F.aggregate(
        F.coalesce("_dates", F.array().cast("array<date>")), F.array(F.col("_start")),
        lambda taken, d: F.when(F.datediff(d, F.element_at(taken, -1)) > gap_days, F.concat(taken, F.array(d)))
        .otherwise(taken))
    return (start.join(dates, key, "left")
            .select(key, F.posexplode(chain).alias("chain_number", "chain_date"))
            .select(key, "chain_date", "chain_number"))


def infection_dates(cohort: DataFrame, facts: DataFrame, gap_days: int = REPEAT_GAP_DAYS,
                    compat: bool = False) -> DataFrame:
    """Infection 0 is the earliest test or diagnosis; each further one the first positive test
    more than `gap_days` after the one before. `compat` keeps persons without a first date as
    one row with a null date."""
    chain = greedy_chain(cohort, facts.filter(F.col("PCR_AG_Pos") == 1), "COVID_first_poslab_or_diagnosis_date",
                         "date", gap_days, keep_unanchored=compat)
    return chain.select("person_id", F.col("chain_date").alias("infection_date"),
                        F.col("chain_number").alias("infection_number"))


def cohort_and_idx(cohort: DataFrame) -> DataFrame:
    """Index date = earliest of test, diagnosis and antiviral; persons with none are dropped."""
    return (cohort
            .select("person_id", F.col("COVID_first_PCR_or_AG_lab_positive").alias("pos_test_idx"),
                    F.col("COVID_first_diagnosis_date").alias("u07_any_idx"),
                    F.least("first_pax_date", "first_rem_date").alias("pax_or_rem_idx"))
            .withColumn("covid_index_date", F.least("pos_test_idx", "u07_any_idx", "pax_or_rem_idx"))
            .filter(F.col("covid_index_date").isNotNull()))


def blackout_dates(index: DataFrame, infections: DataFrame, blackout_before_days: int = BLACKOUT_DAYS[0],
                   blackout_after_days: int = BLACKOUT_DAYS[1]) -> DataFrame:
    """Spans round every infection and round the inferred index date, without duplicates."""
    known = infections.select("person_id", "infection_date").join(index.select("person_id"), "person_id", "left_semi")
    inferred = index.select("person_id", F.col("covid_index_date").alias("infection_date"))
    return (known.unionByName(inferred).distinct()
            .withColumn("blackout_begin", F.date_add("infection_date", -blackout_before_days))
            .withColumn("blackout_end", F.date_add("infection_date", blackout_after_days)))


def repeat_labels(conditions: DataFrame, grid: DataFrame, observations: DataFrame, compat: bool = False,
                  date_floor: str = LABEL_DATE_FLOOR) -> DataFrame:
    """Persons of the grid with a sequel diagnosis, its broader code, or a clinic visit on at
    least two dates; the label date is the earliest first date among the rules that hold.

    `compat=True` reproduces counts taken over the joined grid instead: every date counts once
    per window of the person and, for diagnoses, once per date of the other code; the broader
    code does not label; and the clinic date goes before the diagnosis date."""
    dated = conditions.filter(
        F.col("condition_concept_id").isin(ROLLING_SEQUEL_DX, INFECTIOUS_SEQUELA_DX)
        & (F.col("condition_start_date") >= F.lit(date_floor).cast("date"))
    ).select("person_id", F.col("condition_concept_id").alias("code"), F.col("condition_start_date").alias("d"))
    clinic = observations.filter(
        (F.col("observation_concept_id") == CLINIC_OBSERVATION) & F.col("observation_date").isNotNull()
    ).select("person_id", F.col("observation_concept_id").alias("code"), F.col("observation_date").alias("d"))
    seen = dated.unionByName(clinic).distinct()

    def dates_of(code: int):
        return F.when(F.col("code") == code, F.col("d"))

    per_person = seen.groupBy("person_id").agg(
        F.count(dates_of(ROLLING_SEQUEL_DX)).alias("num_u09s"), F.min(dates_of(ROLLING_SEQUEL_DX)).alias("min_u09_date"),
        F.count(dates_of(INFECTIOUS_SEQUELA_DX)).alias("num_b948s"),
        F.min(dates_of(INFECTIOUS_SEQUELA_DX)).alias("min_b948_date"),
        F.count(dates_of(CLINIC_OBSERVATION)).alias("TRAIN_num_lc_clinic_visits"),
        F.min(dates_of(CLINIC_OBSERVATION)).alias("TRAIN_min_lc_clinic_date"))
    u09, b948, visits = F.col("num_u09s"), F.col("num_b948s"), F.col("TRAIN_num_lc_clinic_visits")
    if compat:
        out = per_person.join(grid.groupBy("person_id").agg(F.count("*").alias("_windows")), "person_id")
        # a left join of both codes repeats each side once per date of the other
        out = (out.withColumns({
            "num_u09s": u09 * F.greatest(b948, F.lit(1)) * F.col("_windows"),
            "num_b948s": b948 * F.greatest(u09, F.lit(1)) * F.col("_windows"),
            "TRAIN_num_lc_clinic_visits": visits * F.col("_windows")}))
        labelled = out.withColumn("label", (visits >= 2) | (u09 >= 2)).withColumn(
            "label_date", F.when(visits >= 2, F.col("TRAIN_min_lc_clinic_date")).otherwise(F.col("min_u09_date")))
    else:
        out = per_person.join(grid.select("person_id").distinct(), "person_id", "left_semi")
        labelled = out.withColumn("label", (u09 >= 2) | (b948 >= 2) | (visits >= 2)).withColumn(
            "label_date", F.least(F.when(u09 >= 2, F.col("min_u09_date")), F.when(b948 >= 2, F.col("min_b948_date")),
                                  F.when(visits >= 2, F.col("TRAIN_min_lc_clinic_date"))))
    return labelled.filter("label").drop("_windows")
