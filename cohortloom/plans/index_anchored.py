"""The index-anchored flow: visits -> episodes -> cohort -> counts -> matrix.

Each step is a method that builds its DataFrame once; see `steps` for which are written."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from cohortloom.operators import cohort as co
from cohortloom.operators import counts as ct
from cohortloom.operators import features as ft
from cohortloom.operators import hierarchy as hi
from cohortloom.operators import models as mo
from cohortloom.operators.first_dates import all_index_dates
from cohortloom.operators.intervals import visits_with_episodes
from cohortloom.plans.steps import Flow, step

DX = ("condition_concept_id", "condition_concept_name")
DRUG = ("ancestor_drug_concept_id", "ancestor_drug_concept_name")


class IndexAnchored(Flow):
    """All steps over one set of clinical tables."""

    READS = {
        "cohort": ("index_dates", "visit_map"),
        "ip_days": ("cohort", "visit_map"),
        "dx_counts": ("cohort", "visit_map", "cohort", "ip_days"),
        "ingredients": ("cohort",),
        "med_counts": ("ingredients", "cohort", "visit_map", "cohort", "ip_days"),
        "candidates": ("dx_counts",),
        "rollup": ("candidates", "candidates"),
        "dx_final": ("dx_counts", "rollup"),
        "dx_totals": ("dx_final",),
        "med_flags": ("med_counts",),
        "labelled": ("dx_counts", "med_counts"),
        "matrix": ("labelled", "med_flags", "dx_final"),
    }

    def __init__(self, *, person: DataFrame, manifest: DataFrame, death: DataFrame, visits: DataFrame,
                 conditions: DataFrame, measurements: DataFrame, drugs: DataFrame, concept: DataFrame,
                 closure: DataFrame, sequel: DataFrame):
        self.person, self.manifest, self.death, self.visits = person, manifest, death, visits
        self.conditions, self.measurements, self.drugs = conditions, measurements, drugs
        self.concept, self.closure, self.sequel = concept, closure, sequel

    @step
    def visit_map(self) -> DataFrame:
        return visits_with_episodes(self.visits)

    @step
    def index_dates(self) -> DataFrame:
        return all_index_dates(self.conditions, self.measurements)

    @step
    def cohort(self) -> DataFrame:
        return co.feature_table_builder(
            self.index_dates, self.person, self.manifest, self.death, self.visit_map, self.conditions)

    @step
    def ip_days(self) -> DataFrame:
        return ct.inpatient_days(self.cohort, self.visit_map)

    @step
    def dx_counts(self) -> DataFrame:
        counts = ct.pre_post_counts(self.conditions, self.cohort, self.visit_map, DX, "condition_start_date",
                                    ("pre_dx_count", "post_dx_count"))
        return ct.attach_demographics(counts, self.cohort, self.ip_days)

    @step
    def ingredients(self) -> DataFrame:
        return hi.ingredient_rollup(hi.cohort_facts(self.drugs, self.cohort), self.closure, self.concept)

    @step
    def med_counts(self) -> DataFrame:
        counts = ct.pre_post_counts(self.ingredients, self.cohort, self.visit_map, DRUG,
                                    "drug_exposure_start_date", ("pre_med_count", "post_med_count"))
        return ct.attach_demographics(counts, self.cohort, self.ip_days)

    @step
    def candidates(self) -> DataFrame:
        return hi.rollup_candidates(self.dx_counts, self.sequel, self.closure, self.concept)

    @step
    def rollup(self) -> DataFrame:
        return hi.final_rollup(hi.parent_totals(self.candidates), self.candidates)

    @step
    def dx_final(self) -> DataFrame:
        flagged = ct.with_post_flags(self.dx_counts, "pre_dx_count", "post_dx_count", "post_only_dx")
        rolled = hi.apply_rollup(flagged, self.rollup)
        return ft.dx_final(ft.just_cases(rolled))

    @step
    def dx_totals(self) -> DataFrame:
        return ft.count_dx_pre_and_post(self.dx_final)

    @step
    def med_flags(self) -> DataFrame:
        return ft.med_flags(self.med_counts)

    def labelled(self, categories: dict[str, list[str]] | None = None) -> DataFrame:
        return ft.add_labels(ft.person_constants(self.dx_counts, self.med_counts), self.sequel, categories)

    def matrix(self, features: Iterable[str], categories: dict[str, list[str]] | None = None) -> DataFrame:
        """The aligned feature matrix: person_id, long_covid, then the listed features in order."""
        features = list(features)
        name = f"matrix-{hash((tuple(features), repr(categories))) & 0xFFFFFFFF:08x}"
        return self.keep(name, lambda: ft.align_columns(ft.feature_table(
            features, self.labelled(categories), self.med_flags, self.dx_final), features))

    def importances(self, features: Iterable[str], categories: dict[str, list[str]] | None = None,
                    stratum: str = "TRUE", **settings) -> DataFrame:
        """Importances of a forest fitted on the matrix rows that meet a condition; flows that share steps share the fit."""
        features = list(features)
        rows = self.once(f"forest {stratum} {sorted(settings.items())} {features} {categories}", lambda: mo.feature_importance(
            mo.train_forest(self.matrix(features, categories).filter(stratum), **settings)).collect())
        return self.person.sparkSession.createDataFrame(rows, "feature string, importance double")
