"""Rolling-window counts, features and matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.columns import key_uniform
from cohortloom.operators import daybits as db
from cohortloom.operators.features import derived_bins, pool_facts
from cohortloom.operators.intervals import drop_blacked_out, open_facts_of
from cohortloom.operators.windows import window_days


def post_visit_counts_in_windows(grid: DataFrame, blackout: DataFrame, visits: DataFrame, windows: DataFrame) -> DataFrame:
    """Distinct visit dates per person and window, outpatient and inpatient, blackout removed;
    windows without visits keep 0.

    Visit days are bits of 64-day words, so the visits are shuffled once, already reduced to a row
    per person and word; blackout spans and windows are masks of such words. Blackout is laid out
    over the days of the windows only."""
    hospital = F.col("likely_hospitalization")
    days = db.days_of(visits, "person_id", "visit_start_date", out_days=hospital.isNull(),
                      in_days=F.coalesce(hospital == 1, F.lit(False)))
    edges = windows.agg(F.min("window_start").alias("first"), F.max("window_end").alias("last"))
    shut = (db.span_masks(blackout.filter("blackout_begin <= blackout_end"),
                          F.greatest(F.col("blackout_begin"), edges.select("first").scalar()),
                          F.least(F.col("blackout_end"), edges.select("last").scalar()))
            .groupBy("person_id", "word").agg(F.bit_or("mask").alias("shut")))
    open_ = F.bitwise_not(F.coalesce("shut", F.lit(0).cast("long")))
    spans = db.span_masks(windows.select(F.col("window_name").alias("window"), "window_start", "window_end"),
                          F.col("window_start"), F.col("window_end"), "inside").select("window", "word", "inside")
    seen = lambda kind: F.sum(F.bit_count(F.col(kind).bitwiseAND(F.col("inside"))).cast("long"))
    counts = (days.join(shut, ["person_id", "word"], "left")
              .select("person_id", "word", *[F.col(c).bitwiseAND(open_).alias(c) for c in ("out_days", "in_days")])
              .join(spans, "word").groupBy("person_id", "window")
              .agg(seen("out_days").alias("post_nonhosp_visit_count"), seen("in_days").alias("post_hosp_count")))
    return (grid.select("person_id", "window").join(counts, ["person_id", "window"], "left")
            .fillna(0, ["post_nonhosp_visit_count", "post_hosp_count"]))


def conditions_for_the_cohort(grid: DataFrame, blackout: DataFrame, conditions: DataFrame, observations: DataFrame,
                              cohort_only: bool = True) -> DataFrame:
    """Pooled facts outside every blackout span; of cohort persons only unless told otherwise."""
    pooled = pool_facts(observations, conditions)
    if cohort_only:
        return open_facts_of(grid, pooled, blackout, "condition_start_date")
    return drop_blacked_out(pooled, blackout, "condition_start_date")


def condition_features(facts: DataFrame, selected: DataFrame, windows: DataFrame, grid: DataFrame) -> DataFrame:
    """Chosen ancestors seen per person and window, distinct.

    -> person_id, window, concept_id"""
    chosen = selected.select(F.col("descendant_concept_id").alias("condition_concept_id"),
                             F.col("ancestor_concept_id").alias("concept_id"))
    seen = (facts.select("person_id", "condition_concept_id", F.col("condition_start_date").alias("day")).distinct()
            .join(chosen, "condition_concept_id")
            .join(window_days(windows), "day")
            .select("person_id", "window", "concept_id").distinct())
    return seen.join(grid.select("person_id", "window"), ["person_id", "window"], "left_semi")


def feature_downselect(training: DataFrame, selected: DataFrame, features: DataFrame, threshold: float = 0.0025) -> DataFrame:
    """Features whose label covariance exceeds the threshold.

    label_covariance weighs each present row by (1 - mean), as the rule this reproduces does;
    true_covariance is the plain one. Both follow from two counts per feature.
    -> concept_id, label_covariance, true_covariance, concept_name"""
    rows = training.agg(F.count("*").alias("n"), F.count(F.when(F.col("label"), 1)).alias("n1"))
    n, n1 = rows.select("n").scalar(), rows.select("n1").scalar()
    present = features.join(training.select("person_id", "window", "label"), ["person_id", "window"])
    per_feature = (present.groupBy("concept_id")
                   .agg(F.count("*").alias("seen"), F.count(F.when(F.col("label"), 1)).alias("seen1"))
                   .withColumn("true_covariance",
                               (F.col("seen1") - F.col("seen") * F.try_divide(n1.cast("double"), n)) / n)
                   .withColumn("label_covariance", (F.lit(1) - F.col("seen") / n) * F.col("true_covariance")))
    names = selected.select(F.col("ancestor_concept_id").alias("concept_id"),
                            F.col("anc_concept_name").alias("concept_name")).distinct()
    return (per_feature.filter(F.col("label_covariance") > threshold).join(names, "concept_id")
            .select("concept_id", "label_covariance", "true_covariance", "concept_name"))


def feature_ids(downselected: DataFrame) -> DataFrame:
    """The kept concept ids, one row each."""
    return downselected.select("concept_id").distinct()


def _with_features(base: DataFrame, features: DataFrame, kept: DataFrame, visit_counts: DataFrame) -> DataFrame:
    """Grid-like rows with the derived bins and `concepts`, the sorted kept concept ids seen in the
    window as text; the model turns them into a sparse vector, so their number has no bound."""
    keys = ["person_id", "window"]
    seen = (features.join(kept.select("concept_id"), "concept_id", "left_semi").join(base.select(*keys), keys, "left_semi")
            .groupBy(*keys).agg(F.sort_array(F.collect_set("concept_id")).alias("concepts")))
    named = F.transform(F.coalesce("concepts", F.expr("cast(array() as array<bigint>)")), lambda c: c.cast("string"))
    return derived_bins(base.join(seen, keys, "left").withColumn("concepts", named).join(visit_counts, keys))


def train_data_full(training: DataFrame, visit_counts: DataFrame, kept: DataFrame, features: DataFrame,
                    rand_seed: int = 1234, validation_share: float = 0.05) -> DataFrame:
    """Training rows with a reproducible hold-out flag."""
    return _with_features(training, features, kept, visit_counts).withColumn(
        "hold_for_val", key_uniform("person_id", "window", seed=rand_seed) < validation_share)


def process_data_full(grid: DataFrame, visit_counts: DataFrame, kept: DataFrame, features: DataFrame) -> DataFrame:
    """The same columns for every person and window, ready for scoring."""
    return _with_features(grid, features, kept, visit_counts)
