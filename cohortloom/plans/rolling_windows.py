"""The rolling-window flow: flags -> infections -> blackout -> grid -> features -> scores."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from cohortloom.operators import hierarchy as hi
from cohortloom.operators import infections as inf
from cohortloom.operators import models as mo
from cohortloom.operators import rolling as ro
from cohortloom.operators.sampling import training_set
from cohortloom.operators.windows import person_window_grid
from cohortloom.plans.steps import Flow, step


class RollingWindows(Flow):
    """All steps over one set of clinical tables."""

    READS = {
        "infections": ("covid_cohort",),
        "index": ("covid_cohort",),
        "blackout": ("index", "infections"),
        "grid": ("index",),
        "labels": ("grid",),
        "visit_counts": ("grid", "blackout"),
        "pooled": ("grid", "blackout"),
        "selected": ("pooled",),
        "features": ("pooled", "selected", "grid"),
        "training": ("grid", "labels"),
        "downselected": ("training", "selected", "features"),
        "training_matrix": ("downselected", "training", "visit_counts", "features"),
        "scoring_matrix": ("grid", "visit_counts", "downselected", "features"),
    }

    def __init__(self, *, person: DataFrame, facts: DataFrame, visits: DataFrame, conditions: DataFrame,
                 observations: DataFrame, concept: DataFrame, closure: DataFrame, windows: DataFrame,
                 cutoff_value: int, threshold: float = 0.0025):
        self.person, self.facts, self.visits = person, facts, visits
        self.conditions, self.observations = conditions, observations
        self.concept, self.closure, self.windows = concept, closure, windows
        self.cutoff_value, self.threshold = cutoff_value, threshold

    @step
    def covid_cohort(self) -> DataFrame:
        return inf.covid_cohort(self.facts)

    @step
    def infections(self) -> DataFrame:
        return inf.infection_dates(self.covid_cohort, self.facts)

    @step
    def index(self) -> DataFrame:
        return inf.cohort_and_idx(self.covid_cohort)

    @step
    def blackout(self) -> DataFrame:
        return inf.blackout_dates(self.index, self.infections)

    @step
    def grid(self) -> DataFrame:
        return person_window_grid(self.person, self.index, self.windows)

    @step
    def labels(self) -> DataFrame:
        return inf.repeat_labels(self.conditions, self.grid, self.observations)

    @step
    def visit_counts(self) -> DataFrame:
        return ro.post_visit_counts_in_windows(self.grid, self.blackout, self.visits, self.windows)

    @step
    def pooled(self) -> DataFrame:
        return ro.conditions_for_the_cohort(
            self.grid, self.blackout, self.conditions, self.observations)

    @step
    def selected(self) -> DataFrame:
        return hi.selected_features(self.pooled, self.closure, self.concept, self.cutoff_value)

    @step
    def features(self) -> DataFrame:
        return ro.condition_features(self.pooled, self.selected, self.windows, self.grid)

    @step
    def training(self) -> DataFrame:
        return training_set(self.grid, self.labels, self.windows)

    @step
    def downselected(self) -> DataFrame:
        return ro.feature_downselect(self.training, self.selected, self.features, self.threshold)

    @step
    def training_matrix(self) -> DataFrame:
        kept = ro.feature_ids(self.downselected)
        return ro.train_data_full(self.training, self.visit_counts, kept, self.features)

    @step
    def scoring_matrix(self) -> DataFrame:
        return ro.process_data_full(self.grid, self.visit_counts, ro.feature_ids(self.downselected), self.features)

    def fit(self, **settings) -> PipelineModel:
        """Train on the rows that are not held out; flows that share steps share the model."""
        return self.once(f"model {sorted(settings.items())}", lambda: mo.train_boosted_trees(
            self.training_matrix.filter("not hold_for_val"), **settings))

    def scores(self, model: PipelineModel) -> DataFrame:
        return mo.model_scores(self.scoring_matrix, model)
