"""Concept roll-ups through the stored transitive closure: equi-joins only, no graph walk.

Facts are counted or made distinct before they meet the closure, so what is joined is of
vocabulary size, except where facts themselves must be re-labelled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.constants import (
    BLOCKED_ANCESTORS, BLOCKED_DESCENDANTS, GENERIC_PARENTS, GENERIC_WORDS, LATERALITY_WORDS,
)
from cohortloom.operators.joins import stored_join
from cohortloom.session import materialise
from cohortloom.sources.concept_sets import ingredient_concepts, snomed_features


# ---------------------------------------------------------------- drugs to ingredients
def cohort_facts(facts: DataFrame, cohort: DataFrame) -> DataFrame:
    """Facts of cohort persons."""
    return stored_join(facts, cohort.select("person_id"), how="left_semi")


def ingredient_rollup(drugs: DataFrame, closure: DataFrame, concept: DataFrame) -> DataFrame:
    """Each drug fact under every ingredient it descends from, distinct."""
    edges = (closure.select(F.col("ancestor_concept_id").alias("ancestor_drug_concept_id"),
                            F.col("descendant_concept_id").alias("original_drug_concept_id"))
             .join(ingredient_concepts(concept).select(
                 F.col("concept_id").alias("ancestor_drug_concept_id"),
                 F.col("concept_name").alias("ancestor_drug_concept_name")), "ancestor_drug_concept_id"))
    given = drugs.select("person_id", "drug_exposure_start_date", "visit_occurrence_id",
                         F.col("drug_concept_id").alias("original_drug_concept_id"),
                         F.col("drug_concept_name").alias("original_drug_concept_name")).distinct()
    return given.join(edges.distinct(), "original_drug_concept_id")


# ---------------------------------------------------------------- diagnosis roll-up (index-anchored)
def _mentions(name: str, word: str):
    return F.lower(F.col(name)).contains(word)


def rollup_candidates(dx: DataFrame, labelled: DataFrame, closure: DataFrame, concept: DataFrame,
                      mode: str = "either", max_level: int = 2) -> DataFrame:
    """Parents up to `max_level` levels above the diagnoses of labelled persons, without generic
    parents, with the number of persons behind each pair.

    mode 'either' drops a pair when parent or child carries a generic word; 'parent_only' keeps
    it when the child carries the same word."""
    parent, child = "parent_concept_name", "child_concept_name"
    pairs = (dx.select("person_id", F.col("condition_concept_id").alias("child_concept_id"),
                       F.col("condition_concept_name").alias(child)).distinct()
             .join(labelled.select("person_id").distinct(), "person_id", "left_semi"))
    names = concept.filter(~F.col("concept_name").isin(*GENERIC_PARENTS))
    for word in LATERALITY_WORDS:
        names = names.filter(~_mentions("concept_name", word))
    edges = (closure.filter(F.col("min_levels_of_separation").between(0, max_level))
             .join(names.select(F.col("concept_id").alias("ancestor_concept_id"),
                                F.col("concept_name").alias(parent)), "ancestor_concept_id")
             .select(F.col("descendant_concept_id").alias("child_concept_id"), parent,
                     F.col("min_levels_of_separation").alias("min_hops_bt_parent_child"),
                     F.col("max_levels_of_separation").alias("max_hops_bt_parent_child")))
    # persons per child first: every edge of a child has the same persons behind it, unless
    # two ancestors share a name, which the distinct edges below rule out
    per_child = pairs.groupBy("child_concept_id", child).agg(F.count("person_id").alias("ptct_training"))
    out = per_child.join(edges.distinct(), "child_concept_id")
    for word in GENERIC_WORDS:
        if mode == "either":
            out = out.filter(~_mentions(parent, word) & ~_mentions(child, word))
        elif mode == "parent_only":
            out = out.filter(~_mentions(parent, word) | _mentions(child, word))
        else:
            raise ValueError(f"unknown mode {mode}")
    return out.select(parent, child, "child_concept_id", "min_hops_bt_parent_child", "max_hops_bt_parent_child",
                      "ptct_training")


def parent_totals(candidates: DataFrame, least_persons: int = 3) -> DataFrame:
    """Parents whose summed person counts reach the threshold."""
    return (candidates.groupBy("parent_concept_name").agg(F.sum("ptct_training").alias("total_pts"))
            .filter(F.col("total_pts") >= least_persons))


def final_rollup(parents: DataFrame, candidates: DataFrame) -> DataFrame:
    """Distinct (parent, child) name pairs of kept parents."""
    return (candidates.join(parents.select("parent_concept_name"), "parent_concept_name", "left_semi")
            .select("parent_concept_name", "child_concept_name").distinct())


def apply_rollup(dx: DataFrame, rollup: DataFrame) -> DataFrame:
    """Add high_level_condition: one row per parent of the diagnosis, null where it has none."""
    pairs = rollup.select(F.col("child_concept_name").alias("condition_concept_name"),
                          F.col("parent_concept_name").alias("high_level_condition"))
    return dx.join(pairs, "condition_concept_name", "left")


def apply_label_map(dx: DataFrame, label_map: DataFrame) -> DataFrame:
    """The fixed-map variant: `label_map` is a table (condition_concept_name,
    high_level_condition) supplied by the caller; labels are trimmed, unmapped names get null."""
    labels = label_map.select("condition_concept_name", F.trim("high_level_condition").alias("high_level_condition"))
    return dx.join(labels.distinct(), "condition_concept_name", "left")


# ---------------------------------------------------------------- closure selection (rolling windows)
def closure_edges(closure: DataFrame, concept: DataFrame) -> DataFrame:
    """Closure between standard feature concepts, with both names."""
    allowed = snomed_features(concept)
    return (closure
            .join(allowed.select(F.col("concept_id").alias("ancestor_concept_id"),
                                 F.col("concept_name").alias("anc_concept_name")), "ancestor_concept_id")
            .join(allowed.select(F.col("concept_id").alias("descendant_concept_id"),
                                 F.col("concept_name").alias("des_concept_name")), "descendant_concept_id"))


def concept_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy(F.col("condition_concept_id").alias("descendant_concept_id")).agg(
        F.count("*").alias("descendant_count"))


def ancestor_counts(counts: DataFrame, edges: DataFrame) -> DataFrame:
    """Sum of the descendants' fact counts per ancestor (itself included at level 0)."""
    return (edges.join(counts, "descendant_concept_id")
            .groupBy("ancestor_concept_id").agg(F.sum("descendant_count").alias("ancestor_count")))


def blocked_concepts(closure: DataFrame, ancestors=BLOCKED_ANCESTORS, descendants=BLOCKED_DESCENDANTS) -> DataFrame:
    """Every closure descendant of a listed ancestor, and every listed descendant."""
    return (closure.filter(F.col("ancestor_concept_id").isin(*ancestors)
                           | F.col("descendant_concept_id").isin(*descendants))
            .select(F.col("descendant_concept_id").alias("concept_id")).distinct())


def selected_features(facts: DataFrame, closure: DataFrame, concept: DataFrame, cutoff_value: int,
                      ancestor_blacklist=BLOCKED_ANCESTORS, descendant_blacklist=BLOCKED_DESCENDANTS) -> DataFrame:
    """For each concept with facts, the ancestors at the least level at which some ancestor's
    total reaches the cutoff; edges touching a blocked concept on either end are removed.

    The counts per concept are read several times, so they are stored: the facts are scanned
    once and the rest is of vocabulary size."""
    edges = closure_edges(closure, concept)
    counts = materialise(concept_counts(facts), "concept_counts")
    kept = ancestor_counts(counts, edges).filter(F.col("ancestor_count") >= cutoff_value)
    candidates = edges.join(kept, "ancestor_concept_id").join(counts, "descendant_concept_id")
    least = candidates.groupBy("descendant_concept_id").agg(
        F.min("min_levels_of_separation").alias("min_levels_of_separation"))
    chosen = candidates.join(least, ["descendant_concept_id", "min_levels_of_separation"], "left_semi")
    blocked = blocked_concepts(closure, ancestor_blacklist, descendant_blacklist)
    clear = reduce(
        lambda df, c: df.join(blocked.withColumnRenamed("concept_id", c), c, "left_anti"),
        ("descendant_concept_id", "ancestor_concept_id"), chosen)
    return clear.select("ancestor_concept_id", "descendant_concept_id", "des_concept_name", "anc_concept_name",
                        "min_levels_of_separation", "descendant_count", "ancestor_count")
