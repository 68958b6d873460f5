"""First dates per person, all from one conditional aggregate per source."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.constants import (
    ACUTE_DX_CODE, INDEX_VISIT_TYPES, POSITIVE_RESULT_CODES, SEQUEL_DX_CODES, SEQUEL_SOURCE_PATTERN, TEST_CODES,
)


def first_dates(facts: DataFrame, date: str, rules: Mapping[str, Column], key: str = "person_id") -> DataFrame:
    """First date per key for each named rule; keys that meet no rule are left out."""
    any_rule = reduce(lambda a, b: a | b, rules.values())
    return facts.filter(any_rule).groupBy(key).agg(
        *[F.min(F.when(rule, F.col(date))).alias(name) for name, rule in rules.items()])


def is_sequel_dx() -> Column:
    return (F.col("condition_concept_id").isin(*SEQUEL_DX_CODES)
            | F.col("condition_source_value").like(SEQUEL_SOURCE_PATTERN))


def is_acute_dx(code: int = ACUTE_DX_CODE) -> Column:
    return F.col("condition_concept_id") == code


def is_positive_test() -> Column:
    return (F.col("measurement_concept_id").isin(*TEST_CODES)
            & F.col("value_as_concept_id").isin(*POSITIVE_RESULT_CODES))


def all_index_dates(conditions: DataFrame, measurements: DataFrame) -> DataFrame:
    """One row per person with any of the three kinds of evidence, and its first dates.

    -> person_id, pos_test_idx, u07_any_idx, u099_idx"""
    dx = first_dates(conditions, "condition_start_date", {"u07_any_idx": is_acute_dx(), "u099_idx": is_sequel_dx()})
    lab = first_dates(measurements, "measurement_date", {"pos_test_idx": is_positive_test()})
    both = dx.unionByName(lab, allowMissingColumns=True)
    return both.groupBy("person_id").agg(*[F.min(c).alias(c) for c in ("pos_test_idx", "u07_any_idx", "u099_idx")])


def site_lab_index(measurements: DataFrame, tests: DataFrame, positives: DataFrame, sites: list[int]) -> DataFrame:
    """First positive test at the given sites; the code lists are concept-set tables."""
    kept = (measurements.filter(F.col("data_partner_id").isin(*sites))
            .join(tests.select(F.col("concept_id").alias("measurement_concept_id")),
                  "measurement_concept_id", "left_semi")
            .join(positives.select(F.col("concept_id").alias("value_as_concept_id")),
                  "value_as_concept_id", "left_semi"))
    return kept.groupBy("person_id").agg(F.min("measurement_date").alias("PCR_INDEX_DT"))


def site_dx_index(conditions: DataFrame, visit_map: DataFrame, sites: list[int],
                  visit_types: tuple[int, ...] = INDEX_VISIT_TYPES) -> DataFrame:
    """First acute diagnosis at the given sites, for persons who have a visit of a qualifying
    type at any time (the visit is matched by person, not by visit id)."""
    seen = visit_map.filter(F.col("visit_concept_id").isin(*visit_types)).select("person_id").distinct()
    return (conditions.filter(is_acute_dx() & F.col("data_partner_id").isin(*sites))
            .groupBy("person_id").agg(F.min("condition_start_date").alias("DX_INDEX_DT"))
            .join(seen, "person_id", "left_semi"))


def clinic_dates(clinic_visits: DataFrame, date: str = "long_covid_clinic_date") -> DataFrame:
    """First clinic visit per person."""
    return clinic_visits.groupBy("person_id").agg(F.min(date).alias("first_LC_clin_dt"))


def living_earliest_index(dx: DataFrame, lab: DataFrame, death: DataFrame) -> DataFrame:
    """Earliest of diagnosis and test index, deceased persons removed."""
    both = dx.select("person_id", F.col("DX_INDEX_DT").alias("d")).unionByName(
        lab.select("person_id", F.col("PCR_INDEX_DT").alias("d")))
    return (both.groupBy("person_id").agg(F.min("d").alias("min_covid_dt"))
            .join(death.select("person_id").distinct(), "person_id", "left_anti"))
