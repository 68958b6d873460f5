"""Code lists: named, versioned concept sets and vocabulary subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_members(members: DataFrame, *names: str) -> DataFrame:
    """Members of the newest version of the named sets."""
    return members.filter(F.col("concept_set_name").isin(*names) & F.col("is_most_recent_version"))


def with_domain(members: DataFrame, concept: DataFrame) -> DataFrame:
    """Set members with the domain of each concept."""
    return members.join(concept.select("concept_id", "domain_id"), "concept_id")


def ingredient_concepts(concept: DataFrame) -> DataFrame:
    """Standard drug ingredients of the drug vocabulary."""
    return concept.filter(
        (F.col("domain_id") == "Drug") & (F.lower("vocabulary_id") == "rxnorm")
        & (F.col("concept_class_id") == "Ingredient") & (F.col("standard_concept") == "S"))


def snomed_features(concept: DataFrame, domains: tuple[str, ...] = ("Condition", "Observation")) -> DataFrame:
    """Standard clinical concepts that may become features."""
    return concept.filter(
        (F.col("vocabulary_id") == "SNOMED") & (F.col("standard_concept") == "S")
        & F.col("domain_id").isin(*domains)).select("concept_id", "concept_name")
