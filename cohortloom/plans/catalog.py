"""Named queries: one per operator or group of operators, over the star-schema test tables.

Each takes (spark, folder) and returns a DataFrame over whole tables. Dates leave as ISO text
and inexact doubles rounded, so that another engine's result compares byte for byte."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions.columns import date_text, encounter_key, key_uniform
from cohortloom.operators import cohort as co
from cohortloom.operators import counts as ct
from cohortloom.operators import evaluation as ev
from cohortloom.operators import features as ft
from cohortloom.operators import first_dates as fd
from cohortloom.operators import hierarchy as hi
from cohortloom.operators import infections as inf
from cohortloom.operators import intervals as iv
from cohortloom.operators import models as mo
from cohortloom.operators import rolling as ro
from cohortloom.operators import sampling as sa
from cohortloom.operators import windows as wi
from cohortloom.plans.index_anchored import DX, IndexAnchored
from cohortloom.plans.research_cohort import ResearchCohort
from cohortloom.plans.rolling_windows import RollingWindows
from cohortloom.session import materialise, remember, shared_folder, tune
from cohortloom.sources import concept_sets as cs
from cohortloom.sources import layout as ly
from cohortloom.sources import tables as tb
from cohortloom.sources.star_adapter import GROUP_BASE, TYPE_BASE, StarTables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# settings of the registered queries that depend on the test tables
WINDOW_RANGE = ((2020, 1), (2024, 6))
SITES = list(range(12))
CUTOFF = 500
THRESHOLD = 0.00001
COMORBID_SETS = {"diabetes_ind": ("Brand#1", "Brand#2"), "kidney_ind": ("Brand#3",), "CHF_ind": ("Brand#4",),
                 "ChronicPulm_ind": ("Brand#5",)}
TEST_SET, POSITIVE_SUPPLIERS = "Brand#6", (45884084,)
MATRIX_FEATURES = (["apprx_age", "op_post_visit_ratio", "ip_post_visit_ratio", "hospitalized", "sex_male"]
                   + [f"group_{i}" for i in range(1, 26)] + [f"type_{i}" for i in range(1, 7)]
                   + [f"ingredient_{i}" for i in range(1, 26)] + ["total_pre_dx", "total_post_dx", "never_seen"])
CATEGORIES = {"sex": ["FEMALE", "MALE", "unknown"],
              "race": ["Black or African American", "Chinese", "No information", "Other Race", "White"],
              "ethn": ["Hispanic or Latino", "No matching concept", "Not Hispanic or Latino"]}


def _plain(df: DataFrame) -> DataFrame:
    """Dates as ISO text."""
    return df.select(*[F.date_format(f.name, "yyyy-MM-dd").alias(f.name) if isinstance(f.dataType, T.DateType)
                       else F.col(f.name) for f in df.schema.fields])


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def query(fn: Callable[[StarTables], DataFrame]) -> Callable[[StarTables], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _plain(fn(StarTables(tune(spark), folder)))

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def anchored(st: StarTables, *targets: str) -> IndexAnchored:
    """The flow; its steps are shared and written as needed for the targets, without any it is all lazy."""
    make = partial(IndexAnchored.stored, targets) if targets else IndexAnchored
    return make(person=st.person(), manifest=st.manifest(), death=st.death(), visits=st.visits(),
                conditions=st.conditions(), measurements=st.measurements(), drugs=st.drugs(),
                concept=st.concepts(), closure=st.closure(), sequel=st.sequel_persons())


def windows_of(st: StarTables) -> DataFrame:
    return wi.calendar_windows(st.spark, *WINDOW_RANGE)


def rolling(st: StarTables, *targets: str) -> RollingWindows:
    """The flow; its steps are shared and written as needed for the targets, without any it is all lazy."""
    make = partial(RollingWindows.stored, targets) if targets else RollingWindows
    return make(person=st.person(), facts=st.fact_flags(), visits=st.visits(), conditions=st.conditions(),
                observations=st.observations(), concept=st.concepts(), closure=st.closure(),
                windows=windows_of(st), cutoff_value=CUTOFF, threshold=THRESHOLD)


def research(st: StarTables, *targets: str) -> ResearchCohort:
    """The flow; its steps are shared and written as needed for the targets, without any it is all lazy."""
    make = partial(ResearchCohort.stored, targets) if targets else ResearchCohort
    sets = st.concept_sets()
    return make(person=st.person(), manifest=st.manifest(), death=st.death(), visits=st.visits(),
                conditions=st.with_site(st.conditions()), measurements=st.with_site(st.measurements()),
                tests=cs.latest_members(sets, TEST_SET).select("concept_id"),
                positives=st.concepts().select(F.lit(POSITIVE_SUPPLIERS[0]).cast("long").alias("concept_id")).distinct(),
                comorbidity_sets={k: cs.latest_members(sets, *v) for k, v in COMORBID_SETS.items()},
                clinic_visits=st.clinic_visits(), sites=SITES)


# ================================================================ visits and episodes
@query
def scaffold_filter(st: StarTables) -> DataFrame:
    return iv.scaffold_filter(st.visits()).select(
        "visit_occurrence_id", "person_id", "visit_concept_id", "visit_start_date", "visit_end_date")


@query
def merge_intervals(st: StarTables) -> DataFrame:
    return iv.merge_intervals(iv.scaffold_filter(st.visits()))


@query
def map_visits_to_episodes(st: StarTables) -> DataFrame:
    return iv.visits_with_episodes(st.visits()).select(
        "visit_occurrence_id", "person_id", "visit_start_date", *iv.EPISODE_COLUMNS)


@query
def link_facts_to_episodes(st: StarTables) -> DataFrame:
    visit_map = materialise(iv.visits_with_episodes(st.visits()), "visit_map")
    out = None
    for kind, facts, fact_id, date in (
            ("condition", st.conditions(), "condition_occurrence_id", "condition_start_date"),
            ("measurement", st.measurements(), "measurement_id", "measurement_date"),
            ("procedure", st.procedures(), "procedure_occurrence_id", "procedure_date")):
        linked = iv.link_facts(facts.select(
            F.col(fact_id).alias("fact_id"), "person_id", F.col(date).alias("fact_date"), "visit_occurrence_id"),
            visit_map, "fact_date").withColumn("kind", F.lit(kind))
        out = linked if out is None else out.unionByName(linked)
    return out


@query
def episode_drilldown(st: StarTables) -> DataFrame:
    return iv.episode_drilldown(iv.visits_with_episodes(st.visits()), 7, "2020-01-01", "2026-12-31")


@query
def calendar_windows(st: StarTables) -> DataFrame:
    """Windows with the visits that start in each."""
    windows = windows_of(st)
    days = st.visits().groupBy(F.col("visit_start_date").alias("day")).agg(F.count("*").alias("n"))
    seen = days.join(wi.window_days(windows), "day").groupBy("window").agg(F.sum("n").alias("n_visits"))
    return (windows.join(seen, F.col("window_name") == F.col("window"), "left").drop("window")
            .fillna(0, ["n_visits"]))


# ================================================================ code lists
@query
def concept_set_members(st: StarTables) -> DataFrame:
    members = cs.latest_members(st.concept_sets(), "Brand#1", "Brand#2", "Brand#6")
    return cs.with_domain(members, st.concepts())


@query
def ingredient_concepts(st: StarTables) -> DataFrame:
    return cs.ingredient_concepts(st.concepts())


# ================================================================ index dates and cohort
@query
def first_event_dates(st: StarTables) -> DataFrame:
    return fd.all_index_dates(st.conditions(), st.measurements())


@query
def site_index(st: StarTables) -> DataFrame:
    r = research(st, "index", "clinic")
    return r.index.join(r.clinic, "person_id", "left")


@query
def earliest_index(st: StarTables) -> DataFrame:
    a = anchored(st, "index_dates")
    return co.collect_cohort(a.index_dates, a.person, a.manifest, a.death)


@query
def grouped_cohort(st: StarTables) -> DataFrame:
    a = anchored(st, "index_dates", "visit_map")
    base = co.collect_cohort(a.index_dates, a.person, a.manifest, a.death)
    return co.with_hospital_group(base, a.visit_map, a.conditions).select("person_id", "min_covid_dt", "patient_group")


@query
def case_split(st: StarTables) -> DataFrame:
    """Hospitalised and other cases as two disjoint sets. Both are read more than once, so they are stored."""
    a = anchored(st, "index_dates", "visit_map")
    base = materialise(co.collect_cohort(a.index_dates, a.person, a.manifest, a.death), "base")
    hosp = materialise(co.hospitalised_cases(base, a.visit_map, a.conditions), "hosp")
    other = co.non_hospitalised_cases(base, hosp)
    return (hosp.select("person_id", F.lit("hosp").alias("part"))
            .unionByName(other.select("person_id", F.lit("nonhosp").alias("part"))))


@query
def pre_post_windows(st: StarTables) -> DataFrame:
    a = anchored(st, "index_dates")
    base = co.collect_cohort(a.index_dates, a.person, a.manifest, a.death)
    return wi.pre_post_windows(base).drop("apprx_age", "sex", "race", "ethn", "site_id", "run_date")


@query
def visit_rates(st: StarTables) -> DataFrame:
    return anchored(st, "cohort").cohort


@query
def comorbidity_flags(st: StarTables) -> DataFrame:
    return research(st, "cohort").cohort


@query
def comorbidity_patients(st: StarTables) -> DataFrame:
    return co.comorbidity_patients(st.conditions(), cs.latest_members(st.concept_sets(), "Brand#1", "Brand#2"))


@query
def history_filter(st: StarTables) -> DataFrame:
    r = research(st, "index")
    return co.sufficient_history(r.index, st.with_site(r.visits), r.conditions, r.manifest)


@query
def follow_up_filter(st: StarTables) -> DataFrame:
    r = research(st, "index")
    return co.followed_up(co.any_history(r.index), r.person, r.manifest)


@query
def research_features(st: StarTables) -> DataFrame:
    return research(st, "features").features


@query
def flagged_split(st: StarTables) -> DataFrame:
    r = research(st, "features", "clinic", "features", "clinic")
    return (co.flagged_only(r.features, r.clinic).select("person_id", F.lit("flagged").alias("part"))
            .unionByName(co.not_flagged_only(r.features, r.clinic).select("person_id", F.lit("other").alias("part"))))


@query
def normalise_groups(st: StarTables) -> DataFrame:
    r = research(st, "features", "features", "clinic")
    return ft.persons_for_summary(r.features, co.flagged_only(r.features, r.clinic))


@query
def training_prevalence(st: StarTables) -> DataFrame:
    r = research(st, "dx_counts", "features")
    return ct.training_prevalence(r.dx_counts, r.features, more_than=0)


@query
def training_prevalence_over_few(st: StarTables) -> DataFrame:
    """With the usual limit: held by more than three training persons."""
    r = research(st, "dx_counts", "features")
    return ct.training_prevalence(r.dx_counts, r.features)


@query
def check_counts(st: StarTables) -> DataFrame:
    """Counts used as checks between steps."""
    a = anchored(st, "dx_counts", "cohort", "cohort")
    return (ct.distinct_count(a.dx_counts, "condition_concept_name", "n").withColumn("what", F.lit("conditions"))
            .unionByName(ct.distinct_count(a.cohort, "person_id", "n").withColumn("what", F.lit("persons")))
            .unionByName(ct.rows_by(a.cohort, "patient_group", name="n")
                         .select("n", F.col("patient_group").alias("what"))))


# ================================================================ windowed counts
@query
def ingredient_rollup(st: StarTables) -> DataFrame:
    return anchored(st, "ingredients").ingredients


@query
def pre_post_counts(st: StarTables) -> DataFrame:
    return anchored(st, "dx_counts").dx_counts


@query
def pre_post_counts_by_person(st: StarTables) -> DataFrame:
    """The same from facts and encounters stored by person: windows, encounters and both counts need
    no shuffle of the facts."""
    a = anchored(st, "cohort", "visit_map", "cohort", "ip_days")
    encounters = a.visit_map.select("visit_occurrence_id", encounter_key("macrovisit_id", "visit_occurrence_id").alias("enc"))
    known = st.conditions().join(encounters, "visit_occurrence_id")
    facts = ly.store_by_person(known.select("person_id", *DX, "condition_start_date", "enc"), "conditions")
    counts = facts.each(lambda part: ct.window_counts(part, a.cohort, DX, "condition_start_date",
                                                      ("pre_dx_count", "post_dx_count")))
    return ct.attach_demographics(counts, a.cohort, a.ip_days)


@query
def pre_post_med_counts(st: StarTables) -> DataFrame:
    return anchored(st, "med_counts").med_counts


@query
def inpatient_days(st: StarTables) -> DataFrame:
    return anchored(st, "ip_days").ip_days


@query
def pre_post_labs(st: StarTables) -> DataFrame:
    a = anchored(st, "cohort", "cohort")
    labs = ct.labs_of_cohort(st.measurements(), a.cohort, st.concept_sets().filter("is_most_recent_version"))
    return _rounded(ct.pre_post_labs(labs, a.cohort), "pre_avg_val", "post_avg_val")


@query
def lab_population(st: StarTables) -> DataFrame:
    a = anchored(st, "cohort")
    labs = ct.labs_of_cohort(st.measurements(), a.cohort, st.concept_sets().filter("is_most_recent_version"))
    return _rounded(ct.lab_population(labs), "pop_avg", "stddev")


@query
def prevalence(st: StarTables) -> DataFrame:
    a = anchored(st, "dx_counts")
    return ct.prevalent_concepts(a.dx_counts, ("condition_concept_id", "condition_concept_name"))


@query
def post_only_flags(st: StarTables) -> DataFrame:
    """Prevalent medications with their flags."""
    a = anchored(st, "med_counts", "med_counts")
    kept = ct.prevalent_concepts(a.med_counts, ("ancestor_drug_concept_id", "ancestor_drug_concept_name"))
    counts = ct.above_threshold(a.med_counts, kept, "ancestor_drug_concept_id")
    return ct.with_post_flags(counts, "pre_med_count", "post_med_count", "post_only_med").select(
        "person_id", "ancestor_drug_concept_id", "pre_med_count", "post_med_count", "post_only_med", "more_in_post")


@query
def med_flags(st: StarTables) -> DataFrame:
    return anchored(st, "med_flags").med_flags


# ================================================================ features
@query
def one_hot(st: StarTables) -> DataFrame:
    return anchored(st, "labelled").labelled(CATEGORIES)


@query
def one_hot_discovered(st: StarTables) -> DataFrame:
    """Columns made of the values that occur, as rows: person, column, 0 or 1."""
    wide = anchored(st, "labelled").labelled()
    made = [c for c in wide.columns if c.startswith(("sex_", "race_", "ethn_"))]
    return wide.select("person_id", *made).unpivot("person_id", made, "name", "value")


@query
def rollup_candidates(st: StarTables) -> DataFrame:
    return anchored(st, "candidates").candidates


@query
def rollup_candidates_parent_rule(st: StarTables) -> DataFrame:
    a = anchored(st, "dx_counts")
    return hi.rollup_candidates(a.dx_counts, a.sequel, a.closure, a.concept, mode="parent_only")


@query
def final_rollup(st: StarTables) -> DataFrame:
    return anchored(st, "rollup").rollup


@query
def apply_rollup(st: StarTables) -> DataFrame:
    return anchored(st, "dx_final").dx_final


def _as_csv(df: DataFrame) -> str:
    """Write a table as CSV with header into the shared folder; its path."""
    path = remember(f"{shared_folder(df.sparkSession)}/csv-{uuid.uuid4().hex}")
    df.write.csv(path, header=True, ignoreTrailingWhiteSpace=False)
    return path


@query
def vocabulary_files(st: StarTables) -> DataFrame:
    """Concepts and hierarchy written as vocabulary files and read back, joined by ancestor."""
    concepts = st.concepts()
    names = tb.read_concepts_csv(st.spark, _as_csv(concepts.drop("standard_concept")), standard_concept="S")
    closure = tb.read_closure_csv(st.spark, _as_csv(st.closure()))
    return closure.join(names, F.col("ancestor_concept_id") == F.col("concept_id")).select(
        "ancestor_concept_id", "descendant_concept_id", "min_levels_of_separation", "concept_name", "domain_id",
        "vocabulary_id", "concept_class_id", "standard_concept")


@query
def feature_list_file(st: StarTables) -> DataFrame:
    """Names of the concept groups written one per line, read back as a feature list."""
    names = st.concepts().filter("concept_class_id = 'Group'").select(F.col("concept_name").alias("value"))
    path = remember(f"{shared_folder(st.spark)}/list-{uuid.uuid4().hex}")
    names.write.text(path)
    return st.spark.createDataFrame([(n,) for n in tb.read_feature_list(st.spark, path)], "feature string")


@query
def apply_label_map(st: StarTables) -> DataFrame:
    """Labels from a supplied map instead of the closure; a blank at the end is trimmed."""
    a = anchored(st, "dx_counts")
    label_map = tb.read_label_map(st.spark, _as_csv(st.raw("part").select(
        F.concat(F.lit("part "), "p_partkey").alias("condition_concept_name"),
        F.when(F.col("p_type") == "PROMO", "EXCLUDE").otherwise(F.concat("p_type", F.lit(" "))).alias("high_level_condition"))))
    flagged = ct.with_post_flags(a.dx_counts, "pre_dx_count", "post_dx_count", "post_only_dx")
    return ft.dx_final(ft.just_cases(hi.apply_label_map(flagged, label_map)))


@query
def dx_totals(st: StarTables) -> DataFrame:
    return anchored(st, "dx_totals").dx_totals


@query
def pivot_features(st: StarTables) -> DataFrame:
    """Diagnosis and medication pivots side by side."""
    a = anchored(st, "dx_final", "med_flags")
    return ft.pivot_both(a.med_flags, a.dx_final, [f"ingredient_{i}" for i in range(1, 26)],
                         [f"group_{i}" for i in range(1, 26)])


@query
def pivot_cases(st: StarTables) -> DataFrame:
    return ft.pivot_cases(anchored(st, "dx_final").dx_final, [f"group_{i}" for i in range(1, 26)])


@query
def aligned_matrix(st: StarTables) -> DataFrame:
    return anchored(st, "matrix").matrix(MATRIX_FEATURES, CATEGORIES)


@query
def label_checks(st: StarTables) -> DataFrame:
    """Labelled persons with their group, and those absent from the counts."""
    a = anchored(st, "dx_counts", "dx_counts")
    people = st.person()
    labels = ft.flagged_persons(people.select(
        "person_id", "data_partner_id", F.when(F.col("person_id") % 6 == 0, 1).otherwise(0).alias("marked")), "marked")
    return (ft.labelled_with_group(labels, a.dx_counts)
            .unionByName(ft.labelled_without_features(labels, a.dx_counts)
                         .select("person_id", F.lit("absent").alias("patient_group"))))


@query
def date_placeholder(st: StarTables) -> DataFrame:
    return st.person().join(st.sequel_persons(), "person_id", "left").select(
        "person_id", date_text("min_long_covid_date").alias("min_long_covid_date"))


@query
def drug_features(st: StarTables) -> DataFrame:
    a = anchored(st, "med_counts")
    return ft.drug_features(ct.with_post_flags(a.med_counts, "pre_med_count", "post_med_count", "post_only_med"))


@query
def regression_input(st: StarTables) -> DataFrame:
    """Age band and ratios of the aligned matrix, by person."""
    matrix = anchored(st, "matrix").matrix(MATRIX_FEATURES[:5], CATEGORIES)
    doubles = ft.double_features(matrix, ["apprx_age", "op_post_visit_ratio", "ip_post_visit_ratio"])
    return ft.regression_input(doubles).groupBy("apprx_age", "op_post_visit_ratio", "long_covid", "hospitalized").agg(
        F.count("*").alias("n"), F.round(F.sum("ip_post_visit_ratio"), 6).alias("ip_sum"))


@query
def fixed_cutoff_cohort(st: StarTables) -> DataFrame:
    a = anchored(st, "index_dates")
    return co.collect_cohort(a.index_dates, a.person, a.manifest, a.death, cutoff="2022-06-22")


@query
def demographic_features(st: StarTables) -> DataFrame:
    return ft.demographic_features(anchored(st, "dx_counts").dx_counts)


# ================================================================ rolling windows
@query
def index_dates(st: StarTables) -> DataFrame:
    r = rolling(st, "covid_cohort", "index")
    return r.covid_cohort.join(r.index.select("person_id", "pax_or_rem_idx", "covid_index_date"), "person_id", "left")


@query
def greedy_chain(st: StarTables) -> DataFrame:
    return rolling(st, "infections").infections


@query
def greedy_chain_as_coded(st: StarTables) -> DataFrame:
    """Persons without a first date stay as one row with a null date."""
    r = rolling(st, "covid_cohort")
    return inf.infection_dates(r.covid_cohort, r.facts, compat=True)


@query
def blackout_spans(st: StarTables) -> DataFrame:
    return rolling(st, "blackout").blackout


@query
def person_window_grid(st: StarTables) -> DataFrame:
    return rolling(st, "grid").grid


@query
def repeat_labels(st: StarTables) -> DataFrame:
    return rolling(st, "labels").labels


@query
def repeat_labels_as_coded(st: StarTables) -> DataFrame:
    r = rolling(st, "grid")
    return inf.repeat_labels(r.conditions, r.grid, r.observations, compat=True)


@query
def blackout_anti_join(st: StarTables) -> DataFrame:
    r = rolling(st, "grid", "blackout")
    return ro.conditions_for_the_cohort(r.grid, r.blackout, r.conditions, r.observations)


@query
def blackout_anti_join_by_person(st: StarTables) -> DataFrame:
    """The same from facts stored by person: they meet persons and spans without a shuffle."""
    r = rolling(st, "grid", "blackout")
    facts = ly.store_by_person(ft.pool_facts(st.observations(), st.conditions()), "pooled_facts")
    return facts.each(lambda part: iv.open_facts_of(r.grid, part, r.blackout, "condition_start_date"))


@query
def blackout_anti_join_all(st: StarTables) -> DataFrame:
    """Blackout removed from everybody's facts, in the cohort or not."""
    r = rolling(st, "grid", "blackout")
    return ro.conditions_for_the_cohort(r.grid, r.blackout, r.conditions, r.observations, cohort_only=False)


@query
def window_visit_counts(st: StarTables) -> DataFrame:
    return rolling(st, "visit_counts").visit_counts


@query
def pool_facts(st: StarTables) -> DataFrame:
    return ft.pool_facts(st.observations(), st.conditions())


@query
def closure_counts(st: StarTables) -> DataFrame:
    pooled = ft.pool_facts(st.observations(), st.conditions())
    return hi.ancestor_counts(hi.concept_counts(pooled), hi.closure_edges(st.closure(), st.concepts()))


@query
def select_ancestors(st: StarTables) -> DataFrame:
    return hi.selected_features(rolling(st, "pooled").pooled, st.closure(), st.concepts(), CUTOFF,
                                ancestor_blacklist=(TYPE_BASE + 4,), descendant_blacklist=(GROUP_BASE + 3, 17))


@query
def window_features(st: StarTables) -> DataFrame:
    return rolling(st, "features").features


@query
def windowed_labels(st: StarTables) -> DataFrame:
    r = rolling(st, "labels")
    return sa.windowed_labels(r.labels, r.windows)


@query
def balanced_sample(st: StarTables) -> DataFrame:
    r = rolling(st, "grid", "labels")
    return sa.training_set(r.grid, r.labels, r.windows)


@query
def covariance_select(st: StarTables) -> DataFrame:
    return _rounded(rolling(st, "downselected").downselected, "label_covariance", "true_covariance", digits=8)


def _joined(matrix: DataFrame) -> DataFrame:
    """The kept concepts of a row as one text."""
    return matrix.withColumn("concepts", F.array_join("concepts", ","))


@query
def training_matrix(st: StarTables) -> DataFrame:
    return _joined(rolling(st, "training_matrix").training_matrix)


@query
def scoring_matrix(st: StarTables) -> DataFrame:
    return _joined(rolling(st, "scoring_matrix").scoring_matrix)


# ================================================================ samples
@query
def class_sample(st: StarTables) -> DataFrame:
    a = anchored(st, "labelled")
    pool = sa.training_pool(a.labelled(CATEGORIES), hospital_share=0.5, other_share=0.25)
    return pool.select("person_id", "long_covid", "hospitalized", F.round("random", 9).alias("random"))


@query
def hash_split(st: StarTables) -> DataFrame:
    a = anchored(st, "labelled")
    train, test = sa.split_pool(sa.training_pool(a.labelled(CATEGORIES), 0.5, 0.25))
    return (train.select("person_id", F.lit("train").alias("part"))
            .unionByName(test.select("person_id", F.lit("test").alias("part"))))


@query
def class_balance(st: StarTables) -> DataFrame:
    return sa.class_counts(anchored(st, "labelled").labelled(CATEGORIES), "long_covid", "hospitalized")


# ================================================================ models and evaluation
def _pseudo_scores(st: StarTables) -> DataFrame:
    """Grid rows with a score derived from the key, in steps of 0.001 so that ties occur."""
    r = rolling(st, "grid")
    return r.grid.select(
        "person_id", "window", (F.col("person_id") % 6 == 0).alias("label"),
        (F.floor(key_uniform("person_id", "window", seed=7) * 1000) / 1000).alias("model_score"))


@query
def best_window(st: StarTables) -> DataFrame:
    return mo.best_window(_pseudo_scores(st))


@query
def roc_table(st: StarTables) -> DataFrame:
    return _rounded(ev.roc_table(_pseudo_scores(st)), "FPR", "TPR", digits=9)


@query
def roc_table_any_scores(st: StarTables) -> DataFrame:
    """Scores between -7 and 13, some of them missing."""
    scores = _pseudo_scores(st).withColumn(
        "model_score", F.when(F.col("person_id") % 11 != 0, F.col("model_score") * 20 - 7))
    return _rounded(ev.roc_table(scores), "FPR", "TPR", digits=9)


@query
def roc_area(st: StarTables) -> DataFrame:
    return _rounded(ev.roc_area(_pseudo_scores(st)), "auc", digits=9)


@query
def model_file(st: StarTables) -> DataFrame:
    """A model saved, loaded and used: rows with the same score from both, where a label is known."""
    r = rolling(st, "training_matrix")
    model = mo.train_boosted_trees(r.training_matrix, n_estimators=2, max_depth=3)
    path = remember(f"{shared_folder(st.spark)}/model-{uuid.uuid4().hex}")
    tb.save_model(model, path)
    loaded = mo.model_scores(r.training_matrix, tb.load_model(path)).withColumnRenamed("model_score", "loaded_score")
    return (mo.model_scores(r.training_matrix, model).join(loaded, ["person_id", "window"])
            .select("person_id", "window", (F.col("model_score") == F.col("loaded_score")).alias("same_score")))


AUC_BOUND = 0.9


@query
def gbt_scores(st: StarTables) -> DataFrame:
    """Train the full model, score every person and window; whether the score is a probability and
    whether the area under the training rows' ROC curve is over its bound."""
    r = rolling(st, "training_matrix", "training_matrix", "scoring_matrix")
    model = r.fit()
    training = mo.model_scores(r.training_matrix, model).join(r.training_matrix.select("person_id", "window", "label"), ["person_id", "window"])
    area = ev.roc_area(training).first()["auc"]
    return r.scores(model).select("person_id", "window", F.col("model_score").between(0, 1).alias("is_probability"),
                                  F.lit(area is not None and area > AUC_BOUND).alias("auc_over_bound"))


@query
def forest_importance(st: StarTables) -> DataFrame:
    """The full forest's importances: none is negative, they sum to one, and a column that is the
    same in all rows has none (null for the others)."""
    a = anchored(st, "matrix", "matrix")
    found = a.importances(MATRIX_FEATURES, CATEGORIES)
    total = found.agg(F.sum("importance")).scalar()
    constant = a.matrix(MATRIX_FEATURES, CATEGORIES).agg(
        *[(F.min(c).cast("double") == F.max(c).cast("double")).alias(c) for c in MATRIX_FEATURES]).unpivot([], MATRIX_FEATURES, "feature", "constant")
    return found.join(constant, "feature").select(
        "feature", (F.col("importance") >= 0).alias("not_negative"), (F.abs(total - 1) < 1e-6).alias("sums_to_one"),
        F.when(F.col("constant"), F.col("importance") == 0).alias("constant_has_none"))


@query
def age_quantiles(st: StarTables) -> DataFrame:
    r = research(st, "features", "features", "clinic")
    persons = ft.persons_for_summary(r.features, co.flagged_only(r.features, r.clinic))
    return _rounded(ev.age_quantiles(persons, ("Long-COVID Clinic HOSP", "Long-COVID Clinic NONHOSP")), "age")


ODDS_COLUMNS = [f"{s}_{k}" for s in ev.STRATA for k in ("odds", "upper_ci", "lower_ci")]


def _regression_odds(st: StarTables) -> DataFrame:
    matrix = anchored(st, "matrix").matrix(MATRIX_FEATURES, CATEGORIES)
    doubles = ft.double_features(matrix, ["apprx_age", "op_post_visit_ratio", "ip_post_visit_ratio"])
    return ev.logistic_odds(ft.regression_input(doubles))


@query
def logistic_odds(st: StarTables) -> DataFrame:
    return _rounded(_regression_odds(st), *ODDS_COLUMNS, digits=4)


def _odds(st: StarTables) -> DataFrame:
    matrix = anchored(st, "matrix").matrix(MATRIX_FEATURES, CATEGORIES)
    return ev.odds_2x2(matrix, ["sex_male", *[f"group_{i}" for i in range(1, 26)]])


@query
def odds_2x2(st: StarTables) -> DataFrame:
    return _rounded(_odds(st), *ODDS_COLUMNS)


def _importances(st: StarTables) -> DataFrame:
    """Three importance tables made from the part sizes of each brand."""
    per_brand = st.raw("part").groupBy(
        F.concat(F.lit("GROUP_"), F.substring("p_brand", 7, 4)).alias("feature")).agg(
        F.sum("p_size").cast("double").alias("total"), F.max("p_size").cast("double").alias("hosp"),
        F.min("p_size").cast("double").alias("other"))
    return ev.join_importances(*[per_brand.select("feature", F.col(c).alias("importance"))
                                 for c in ("total", "hosp", "other")])


@query
def odds_with_importance(st: StarTables) -> DataFrame:
    """Regression and two-by-two odds with the importances of the feature of the same name."""
    return ev.combine_odds(_regression_odds(st), _odds(st), _importances(st))


@query
def top_features(st: StarTables) -> DataFrame:
    return ev.top_features(_importances(st), "hosp_imp")


SUMMARY_CATEGORIES = ["sex_norm", "race_norm", "ethn_norm", "age_group", "diabetes_ind", "kidney_ind", "CHF_ind",
                      "ChronicPulm_ind"]
SUMMARY_NUMBERS = ["apprx_age", "post_visits_per_pt_day"]


@query
def table_one(st: StarTables) -> DataFrame:
    r = research(st, "features", "features", "clinic")
    persons = ft.persons_for_summary(r.features, co.flagged_only(r.features, r.clinic))
    return _rounded(ev.table_one(persons, SUMMARY_CATEGORIES, SUMMARY_NUMBERS), "pct", "mean", "sd")


@query
def table_one_tests(st: StarTables) -> DataFrame:
    r = research(st, "features", "features", "clinic")
    persons = materialise(ft.persons_for_summary(r.features, co.flagged_only(r.features, r.clinic)), "summary")
    tests = ev.group_differences(persons, SUMMARY_CATEGORIES, SUMMARY_NUMBERS)
    return _rounded(_rounded(tests, "statistic", digits=5), "p_value")


@query
def group_variance(st: StarTables) -> DataFrame:
    r = research(st, "features", "features", "clinic")
    persons = ft.persons_for_summary(r.features, co.flagged_only(r.features, r.clinic))
    return _rounded(ev.analysis_of_variance(persons, SUMMARY_NUMBERS), "f_value")
