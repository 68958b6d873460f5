"""The function surface, under the names and with the parameters users of such pipelines know.

Rolling windows: `generate_window_spans` ... `model_scores`. Index-anchored steps: the ten
`build_*`/`process`/`compute` functions and their helpers. Everything takes and returns
DataFrames; nothing is collected except column names, model coefficients and feature ids."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from cohortloom.constants import BLACKOUT_DAYS, BLOCKED_ANCESTORS, BLOCKED_DESCENDANTS
from cohortloom.operators import counts as _ct
from cohortloom.operators import features as _ft
from cohortloom.operators import hierarchy as _hi
from cohortloom.operators import infections as _inf
from cohortloom.operators import models as _mo
from cohortloom.operators import rolling as _ro
from cohortloom.operators import sampling as _sa
from cohortloom.operators import windows as _wi
from cohortloom.sources.tables import read_feature_list


# ================================================================ rolling windows
def generate_window_spans(start: tuple[int, int], end: tuple[int, int], window_length: int = 100,
                          spark: SparkSession | None = None) -> DataFrame:
    return _wi.calendar_windows(spark or SparkSession.builder.getOrCreate(), start, end, window_length)


def covid_cohort(fact_table: DataFrame) -> DataFrame:
    return _inf.covid_cohort(fact_table)


def infection_dates(covid_cohort: DataFrame, fact_table: DataFrame) -> DataFrame:
    return _inf.infection_dates(covid_cohort, fact_table)


def cohort_and_idx(covid_cohort: DataFrame) -> DataFrame:
    return _inf.cohort_and_idx(covid_cohort)


def blackout_dates(cohort_and_idx: DataFrame, infection_dates: DataFrame,
                   blackout_before_days: int = BLACKOUT_DAYS[0], blackout_after_days: int = BLACKOUT_DAYS[1]) -> DataFrame:
    return _inf.blackout_dates(cohort_and_idx, infection_dates, blackout_before_days, blackout_after_days)


def basic_cohort(person_table: DataFrame, cohort_and_idx: DataFrame, window_spans: DataFrame, min_age: int = 18,
                 max_age: int = 100) -> DataFrame:
    return _wi.person_window_grid(person_table, cohort_and_idx, window_spans, min_age, max_age)


def labels(condition_occurrence: DataFrame, basic_cohort: DataFrame, observation_table: DataFrame,
           compat: bool = False) -> DataFrame:
    return _inf.repeat_labels(condition_occurrence, basic_cohort, observation_table, compat)


def post_visit_counts_in_windows(basic_cohort: DataFrame, blackout_dates: DataFrame, visit_table: DataFrame,
                                 window_spans: DataFrame) -> DataFrame:
    return _ro.post_visit_counts_in_windows(basic_cohort, blackout_dates, visit_table, window_spans)


def conditions_for_the_cohort(basic_cohort: DataFrame, blackout_dates: DataFrame, condition_occurrence: DataFrame,
                              observation: DataFrame, cohort_only: bool = True) -> DataFrame:
    return _ro.conditions_for_the_cohort(basic_cohort, blackout_dates, condition_occurrence, observation, cohort_only)


def selected_features(conditions_for_the_cohort: DataFrame, concept_ancestor: DataFrame, concept_table: DataFrame,
                      cutoff_value: int, ancestor_blacklist: Iterable[int] = BLOCKED_ANCESTORS,
                      descendant_blacklist: Iterable[int] = BLOCKED_DESCENDANTS) -> DataFrame:
    return _hi.selected_features(conditions_for_the_cohort, concept_ancestor, concept_table, cutoff_value,
                                 ancestor_blacklist, descendant_blacklist)


def condition_features(conditions_for_the_cohort: DataFrame, selected_features: DataFrame, window_spans: DataFrame,
                       basic_cohort: DataFrame) -> DataFrame:
    return _ro.condition_features(conditions_for_the_cohort, selected_features, window_spans, basic_cohort)


def training_set(basic_cohort: DataFrame, labels: DataFrame, window_spans: DataFrame) -> DataFrame:
    return _sa.training_set(basic_cohort, labels, window_spans)


def feature_downselect(training_set: DataFrame, selected_features: DataFrame, condition_features_alt: DataFrame,
                       threshold: float = 0.0025) -> DataFrame:
    return _ro.feature_downselect(training_set, selected_features, condition_features_alt, threshold)


def train_data_full(training_set: DataFrame, post_visit_counts_in_windows: DataFrame, feature_downselect: DataFrame,
                    condition_features_alt: DataFrame, rand_seed: int = 1234, validation_share: float = 0.05) -> DataFrame:
    return _ro.train_data_full(training_set, post_visit_counts_in_windows, _ro.feature_ids(feature_downselect),
                               condition_features_alt, rand_seed, validation_share)


def train_model(data: DataFrame, colsample_bytree: float = 0.1, gamma: float = 0.4, learning_rate: float = 0.09,
                max_depth: int = 12, min_child_weight: int = 0, n_estimators: int = 400, subsample: float = 0.9,
                random_state: int = 42) -> PipelineModel:
    return _mo.train_boosted_trees(data, "label", colsample_bytree, gamma, learning_rate, max_depth,
                                   min_child_weight, n_estimators, subsample, random_state)


def process_data_full(basic_cohort: DataFrame, post_visit_counts_in_windows: DataFrame, feature_downselect: DataFrame,
                      condition_features_alt: DataFrame) -> DataFrame:
    return _ro.process_data_full(basic_cohort, post_visit_counts_in_windows, _ro.feature_ids(feature_downselect),
                                 condition_features_alt)


def model_scores(input_data: DataFrame, model: PipelineModel) -> DataFrame:
    return _mo.model_scores(input_data, model)


# ================================================================ index-anchored steps
def build_pre_post_med_final_distinct(pre_post_med_clean: DataFrame) -> DataFrame:
    return _ft.med_flags(pre_post_med_clean)


def build_add_labels(pre_post_dx_count_clean: DataFrame, pre_post_med_count_clean: DataFrame,
                     long_covid_patients: DataFrame,
                     categories: Mapping[str, Iterable[str]] | None = None) -> DataFrame:
    persons = _ft.person_constants(pre_post_dx_count_clean, pre_post_med_count_clean)
    return _ft.add_labels(persons, long_covid_patients, categories)


def build_pre_post_more_in_dx_calc(pre_post_dx_count_clean: DataFrame) -> DataFrame:
    return _ct.with_post_flags(pre_post_dx_count_clean, "pre_dx_count", "post_dx_count", "post_only_dx")


def build_condition_rollup(long_covid_patients: DataFrame, pre_post_dx_count_clean: DataFrame,
                           concept_ancestor: DataFrame, concept: DataFrame, mode: str = "either") -> DataFrame:
    return _hi.rollup_candidates(pre_post_dx_count_clean, long_covid_patients, concept_ancestor, concept, mode)


def build_parent_condition_rollup(condition_rollup: DataFrame) -> DataFrame:
    return _hi.parent_totals(condition_rollup)


def process(parent_conditions: DataFrame, condition_rollup: DataFrame) -> DataFrame:
    return _hi.final_rollup(parent_conditions, condition_rollup)


def build_add_alt_rollup(pre_post_dx_more_in_post: DataFrame, final_rollups: DataFrame) -> DataFrame:
    return _hi.apply_rollup(pre_post_dx_more_in_post, final_rollups)


def build_pre_post_dx_final(add_alt_rollup: DataFrame) -> DataFrame:
    return _ft.dx_final(_ft.just_cases(add_alt_rollup))


def build_count_dx_pre_and_post(pre_post_dx_final: DataFrame) -> DataFrame:
    return _ft.count_dx_pre_and_post(pre_post_dx_final)


def compute(training_data: Iterable[str], add_labels: DataFrame, pre_post_med_final: DataFrame,
            pre_post_dx_final: DataFrame, count_dx_pre_and_post: DataFrame) -> DataFrame:
    return _ft.feature_table(training_data, add_labels, pre_post_med_final, pre_post_dx_final, count_dx_pre_and_post)


def read_model_columns(path: str | None = None, spark: SparkSession | None = None) -> list[str]:
    return read_feature_list(spark or SparkSession.builder.getOrCreate(), path)


def pivot_dx(dx_df: DataFrame, cols_for_model: Iterable[str]) -> DataFrame:
    return _ft.pivot_dx(dx_df, cols_for_model)


def pivot_meds(med_df: DataFrame, cols_for_model: Iterable[str]) -> DataFrame:
    return _ft.pivot_meds(med_df, cols_for_model)


def build_final_feature_table(med_df: DataFrame, dx_df: DataFrame, add_labels: DataFrame,
                              count_dx_pre_and_post: DataFrame) -> DataFrame:
    return _ft.assemble_matrix(add_labels, med_df, dx_df, count_dx_pre_and_post)
