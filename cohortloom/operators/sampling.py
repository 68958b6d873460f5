"""Labelled windows and reproducible samples.

A row is in a sample or not by a hash of its key, so the result does not depend on how the
data is partitioned, on ordering, or on retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.columns import key_uniform
from cohortloom.operators.windows import window_days


def windowed_labels(labels: DataFrame, windows: DataFrame) -> DataFrame:
    """The latest window holding each person's label date; persons without one drop out."""
    return (labels.select("person_id", "label", "label_date")
            .join(window_days(windows), F.col("label_date") == F.col("day"))
            .groupBy("person_id", "label", "label_date")
            .agg(F.max("window").alias("window")))


def training_set(grid: DataFrame, labels: DataFrame, windows: DataFrame, seed: int = 42) -> DataFrame:
    """Every labelled person's labelled window, and about as many windows of other persons.

    The share of negatives is positives / negatives, at most 1, from two scalar subqueries.
    -> person_id, sex, window, window_age, label"""
    positives = windowed_labels(labels, windows).select("person_id", "window").distinct()
    others = grid.join(positives.select("person_id").distinct(), "person_id", "left_anti")
    share = F.least(F.lit(1.0), F.try_divide(positives.agg(F.count("*")).scalar(), others.agg(F.count("*")).scalar()))
    negative_rows = others.filter(key_uniform("person_id", "window", seed=seed) < share) \
        .withColumn("label", F.lit(False))
    positive_rows = grid.join(positives, ["person_id", "window"], "left_semi").withColumn("label", F.lit(True))
    return negative_rows.unionByName(positive_rows)


def sample_by_key(df: DataFrame, fraction: float | Column, *keys: str, seed: int = 42) -> DataFrame:
    return df.filter(key_uniform(*keys, seed=seed) < fraction)


def training_pool(labelled: DataFrame, hospital_share: float = 0.05, other_share: float = 0.0037,
                  seed: int = 42) -> DataFrame:
    """All positives with class-wise samples of negatives, and a `random` column for the split."""
    draw = key_uniform("person_id", seed=seed)
    positive = F.col("long_covid") == 1
    share = F.when(F.col("hospitalized") == 1, hospital_share).otherwise(other_share)
    return (labelled.filter(positive | (draw < share)).drop("patient_group")
            .withColumn("random", key_uniform("person_id", seed=seed + 1)))


def split_pool(pool: DataFrame, train_share: float = 0.77) -> tuple[DataFrame, DataFrame]:
    """(training, test) rows by the `random` column."""
    return pool.filter(F.col("random") <= train_share), pool.filter(F.col("random") > train_share)


def class_counts(df: DataFrame, *columns: str, name: str = "num_patients") -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias(name))
