"""Whole fitted models: the settings of the registered queries, and the combined odds against their parts."""

import random

import pytest

import __spark_entry__ as entry
from cohortloom import session
from cohortloom.operators import evaluation as ev
from cohortloom.operators import models as mo
from cohortloom.plans import catalog, fitted
from cohortloom.plans.steps import lease

FOLDER = "/root/testdata/sf0.001"


def test_registered_queries_fit_full_models_once(spark, monkeypatch):
    """Settings of the fits are the full ones, and queries of one session share them."""
    seen, fit = [], mo._fit

    def small(data, label, classifier):
        size = "maxIter" if classifier.hasParam("maxIter") else "numTrees"
        seen.append((classifier.getOrDefault(size), classifier.getOrDefault("maxDepth")))
        return fit(data, label, classifier.copy({classifier.getParam(size): 3, classifier.getParam("maxDepth"): 3}))

    monkeypatch.setattr(mo, "_fit", small)
    with lease(spark):
        for name in ("gbt_scores", "gbt_model_scores", "forest_importance", "forest_model_importance", "top_fitted_features"):
            assert entry.queries()[name](spark, FOLDER).count() > 0, name
        assert catalog.anchored(catalog.StarTables(session.tune(spark), FOLDER), "matrix")._shelf.made
    assert seen == [(400, 12), (1000, 15), (1000, 15), (1000, 15)]


def test_whole_odds_against_the_parts(spark):
    rng = random.Random(31)
    groups = [f"group_{i}" for i in range(1, 26)]
    rows = []
    for i in range(600):
        sick = rng.random() < 0.4
        rows.append((i, rng.randint(19, 90), rng.random(), rng.random(), int(rng.random() < 0.5), int(rng.random() < 0.5),
                     *[int(rng.random() < (0.5 if sick else 0.3)) for _ in groups], int(sick)))
    names = ["person_id", "apprx_age", "op_post_visit_ratio", "ip_post_visit_ratio", "hospitalized", "sex_male", *groups, "long_covid"]
    matrix = spark.createDataFrame(rows, names).coalesce(2).cache()
    settings = {"n_estimators": 3, "max_depth": 3}
    strata = {"total_imp": "TRUE", "hosp_imp": fitted.HOSPITAL, "nohosp_imp": fitted.OTHER}
    parts = {c: mo.feature_importance(mo.train_forest(matrix.filter(where), **settings)) for c, where in strata.items()}
    got = {(r.concept, r.subgroup): r.asDict() for r in fitted.whole_odds(matrix, list(parts.values())).collect()}
    doubles = fitted.ft.double_features(matrix, names[1:4])
    regression = {(r.concept, r.subgroup): r.asDict() for r in ev.logistic_odds(fitted.ft.regression_input(doubles)).collect()}
    assert regression.keys() <= got.keys() and len(got) == len(regression) + 26
    for key, want in regression.items():
        for c in catalog.ODDS_COLUMNS:
            assert got[key][c] == pytest.approx(want[c], abs=1e-3, rel=1e-6) if want[c] is not None else got[key][c] is None
    for column, part in parts.items():
        want = {r.feature: r.importance for r in part.collect()}
        for (concept, _), r in got.items():
            assert r[column] == pytest.approx(want.get(concept), abs=1e-12)


def test_shared_importances_are_those_of_the_rows(spark):
    """The flow's fit on a condition equals a fit on the filtered matrix."""
    with lease(spark):
        flow = catalog.anchored(catalog.StarTables(session.tune(spark), FOLDER), "matrix", "matrix")
        settings = {"n_estimators": 2, "max_depth": 2}
        got = {r.feature: r.importance for r in flow.importances(catalog.MATRIX_FEATURES, catalog.CATEGORIES, **settings).collect()}
        matrix = session.materialise(flow.matrix(catalog.MATRIX_FEATURES, catalog.CATEGORIES), "again")
        want = {r.feature: r.importance for r in mo.feature_importance(mo.train_forest(matrix, **settings)).collect()}
    assert got.keys() == want.keys() and sum(got.values()) == pytest.approx(1)


def test_rows_of_a_forest_keep_their_nodes(spark, monkeypatch):
    """No level walks the rows down from the roots again, and the forest is the one without that."""
    rng = random.Random(32)
    rows = [(i, rng.random(), rng.randint(0, 3), int(rng.random() < 0.4)) for i in range(300)]
    data = spark.createDataFrame([(*r, int(r[1] + 0.2 * r[2] > 0.7)) for r in rows], "person_id int, x double, y int, z int, long_covid int").coalesce(1)
    kept, fit = [], mo._fit

    def walked(rows, label, classifier):
        kept.append(classifier.getCacheNodeIds())
        return fit(rows, label, classifier.copy({classifier.cacheNodeIds: False}))

    importances = lambda: {r.feature: r.importance for r in mo.feature_importance(mo.train_forest(data, n_estimators=7, max_depth=6)).collect()}
    got = importances()
    monkeypatch.setattr(mo, "_fit", walked)
    assert importances() == pytest.approx(got, abs=1e-12) and kept == [True]
