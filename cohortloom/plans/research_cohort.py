"""The research variant of the index-anchored cohort: site-limited index dates, history and
follow-up rules, comorbidities, clinic-ended windows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cohortloom.operators import cohort as co
from cohortloom.operators import counts as ct
from cohortloom.operators import first_dates as fd
from cohortloom.operators.intervals import visits_with_episodes
from cohortloom.plans.index_anchored import DX
from cohortloom.plans.steps import Flow, step


class ResearchCohort(Flow):
    """All steps; facts carry the site (data_partner_id) of their rows."""

    READS = {
        "index": ("visit_map",),
        "cohort": ("index", "comorbid"),
        "hospitalised": ("cohort", "visit_map"),
        "features": ("cohort", "hospitalised", "clinic", "visit_map"),
        "dx_counts": ("features", "visit_map", "features", "features", "visit_map"),
    }

    def __init__(self, *, person: DataFrame, manifest: DataFrame, death: DataFrame, visits: DataFrame,
                 conditions: DataFrame, measurements: DataFrame, tests: DataFrame, positives: DataFrame,
                 comorbidity_sets: dict[str, DataFrame], clinic_visits: DataFrame, sites: list[int]):
        self.person, self.manifest, self.death, self.visits = person, manifest, death, visits
        self.conditions, self.measurements = conditions, measurements
        self.tests, self.positives = tests, positives
        self.comorbidity_sets, self.clinic_visits, self.sites = comorbidity_sets, clinic_visits, sites

    @step
    def visit_map(self) -> DataFrame:
        return visits_with_episodes(self.visits)

    @step
    def index(self) -> DataFrame:
        dx = fd.site_dx_index(self.conditions, self.visit_map, self.sites)
        lab = fd.site_lab_index(self.measurements, self.tests, self.positives, self.sites)
        return fd.living_earliest_index(dx, lab, self.death)

    @step
    def comorbid(self) -> DataFrame:
        return co.all_comorbidities(self.conditions, self.comorbidity_sets)

    @step
    def cohort(self) -> DataFrame:
        followed = co.followed_up(co.any_history(self.index), self.person, self.manifest)
        return co.research_cohort(followed, self.comorbid)

    @step
    def hospitalised(self) -> DataFrame:
        return co.hospitalised_cases(self.cohort, self.visit_map, self.conditions)

    @step
    def clinic(self) -> DataFrame:
        return fd.clinic_dates(self.clinic_visits)

    @step
    def features(self) -> DataFrame:
        return co.research_feature_table(
            self.cohort, self.hospitalised, self.clinic, self.visit_map)

    @step
    def dx_counts(self) -> DataFrame:
        counts = ct.pre_post_counts(self.conditions, self.features, self.visit_map, DX, "condition_start_date",
                                    ("pre_dx_count", "post_dx_count"))
        return ct.attach_demographics(
            counts, self.features, ct.inpatient_days(self.features, self.visit_map))
