import random
from pathlib import Path

import pytest
from conftest import plus, rows
from pyspark.sql import functions as F

from cohortloom.constants import MODEL_FEATURES
from cohortloom.functions.columns import date_text, key_uniform, normalise_name
from cohortloom.operators import evaluation as ev
from cohortloom.operators import features as ft
from cohortloom.operators import models as mo
from cohortloom.operators import rolling as ro
from cohortloom.operators import sampling as sa
from cohortloom.operators.windows import calendar_windows
from cohortloom.sources import tables


def test_names_dates_uniform(spark):
    df = spark.createDataFrame([("Major depression, single", plus(0)), ("a-b", None)], "n string, d date")
    assert rows(df.select(normalise_name("n"), date_text("d"))) == [("a_b", "0000-00-00"), ("major_depression__single", "2021-01-01")]
    u = spark.range(4000).select(key_uniform("id", seed=1).alias("u")).agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= u[0] < 0.01 and 0.99 < u[1] < 1 and abs(u[2] - 0.5) < 0.03


def test_one_hot_and_labels(spark):
    schema = ("person_id long, sex string, patient_group string, apprx_age int, race string, ethn string, "
              "tot_long_data_days int, op_post_visit_ratio double, ip_post_visit_ratio double")
    dx = spark.createDataFrame([(1, "MALE", "CASE_HOSP", 40, "White", "No", 5, .1, .2), (2, "Gender unknown", "CASE_NONHOSP", 50, None, "No", 5, .1, .2)], schema)
    med = dx.filter("person_id = 1")
    sequel = spark.createDataFrame([(1, plus(0)), (2, None)], "person_id long, min_long_covid_date date")
    got = ft.add_labels(ft.person_constants(dx, med), sequel)
    assert {"sex_male", "sex_unknown", "race_white", "ethn_no"} <= set(got.columns)
    assert rows(got, "person_id", "sex_male", "sex_unknown", "race_white", "long_covid", "hospitalized") == [
        (1, 1, 0, 1, 1, 1), (2, 0, 1, 0, 0, 0)]


def test_dx_final_flags(spark):
    schema = "person_id long, patient_group string, condition_concept_name string, high_level_condition string, pre_dx_count long, post_dx_count long"
    rolled = spark.createDataFrame([
        (1, "CASE_HOSP", "a", "Chest Pain", 1, 1), (1, "CASE_HOSP", "b", "Chest Pain", 0, 1), (1, "CASE_HOSP", "c", "Even", 2, 2),
        (2, "CASE_HOSP", "c", "Even", 0, 3), (2, "CASE_HOSP", "d", "EXCLUDE", 0, 3), (2, "CASE_HOSP", "e", None, 0, 3),
        (2, "CASE_HOSP", "f", "COVID x", 0, 3), (2, "OTHER", "c", "Even", 0, 3), (3, "CASE_NONHOSP", "c", "Even", 0, 0),
        (3, "CASE_NONHOSP", "g", "Post-infectious disorder", 0, 1)], schema)
    final = ft.dx_final(ft.just_cases(rolled, drop_post_infectious=True))
    assert rows(final, "person_id", "high_level_condition", "pre_dx_count_sum", "greater_in_post", "only_in_post") == [
        (1, "chest_pain", 1, 1, 0), (1, "even", 2, 0, 0), (2, "even", 0, 1, 1), (3, "even", 0, 0, 0)]
    assert "post_infectious_disorder" in {r[0] for r in rows(ft.dx_final(ft.just_cases(rolled)), "high_level_condition")}
    assert rows(ft.count_dx_pre_and_post(final)) == [(1, 3, 4), (2, 0, 3), (3, 0, 0)]
    wide = ft.pivot_dx(final, ["even", "chest_pain", "unseen"])
    assert wide.columns == ["person_id", "even", "chest_pain", "unseen"]
    assert rows(wide) == [(1, 0, 1, 0), (2, 1, 0, 0), (3, 0, 0, 0)]
    assert ft.pivot_cases(final, ["even"]).columns == ["person_id", "patient_group", "even_greater_in_post", "even_only_in_post"]


def test_matrix_and_alignment(spark):
    labelled = spark.createDataFrame([(1, "CASE_HOSP", 1, 0, 1, 0, 40), (2, "CASE_HOSP", 0, 1, 0, 1, 50)],
                                     "person_id long, patient_group string, sex_male int, sex_female int, long_covid int, race_white int, apprx_age int")
    meds = spark.createDataFrame([(1, "aspirin", 1)], "person_id long, ingredient string, post_only_med int")
    dx = spark.createDataFrame([(2, "cough", 1)], "person_id long, high_level_condition string, greater_in_post int")
    totals = spark.createDataFrame([(2, 3, 4)], "person_id long, total_pre_dx long, total_post_dx long")
    features = ["cough", "aspirin", "never", "sex_male", "chronic_disease_of_respiratory_systemx"]
    wide = ft.feature_table(features[:3], labelled, meds, dx, totals)
    assert not {"sex_female", "race_white", "patient_group"} & set(wide.columns)
    aligned = ft.align_columns(wide.withColumn("chronic_disease_of_respiratory_system", F.lit(7)), features)
    assert aligned.columns == ["person_id", "long_covid", *features]
    assert rows(aligned) == [(1, 1, 0, 1, 0, 1, 7), (2, 0, 1, 0, 0, 0, 7)]


def test_training_set_is_reproducible_and_whole(spark):
    w = calendar_windows(spark, (2021, 1), (2021, 7))
    grid = spark.range(60).selectExpr("id as person_id", "explode(sequence(0, 5)) as window", "'F' as sex", "30 as window_age")
    labels = spark.createDataFrame([(p, True, plus(95)) for p in range(5)] + [(50, True, plus(900))],
                                   "person_id long, label boolean, label_date date")
    got = rows(sa.windowed_labels(labels, w), "person_id", "window")
    assert got == [(p, 3) for p in range(5)]        # the latest of the overlapping windows
    a = rows(sa.training_set(grid, labels, w))
    b = rows(sa.training_set(grid.repartition(7), labels.repartition(3), w))
    assert a == b and sum(r[-1] for r in a) == 5
    assert not {r[0] for r in a if not r[-1]} & set(range(5))
    # more positives than others: the share stops at 1, nothing fails
    few = sa.training_set(grid.filter("person_id < 6"), spark.createDataFrame(
        [(p, True, plus(95)) for p in range(6)], "person_id long, label boolean, label_date date"), w)
    assert few.count() == 6


def test_pool_and_split(spark):
    df = spark.range(2000).selectExpr("id as person_id", "cast(id % 20 = 0 as int) as long_covid", "cast(id % 2 as int) as hospitalized",
                                      "'g' as patient_group")
    pool = sa.training_pool(df)
    assert pool.filter("long_covid = 1").count() == 100
    train, test = sa.split_pool(pool)
    assert train.count() + test.count() == pool.count()
    assert abs(train.count() / pool.count() - 0.77) < 0.12


def test_covariance(spark):
    train = spark.createDataFrame([(p, 0, p < 4) for p in range(10)], "person_id long, window int, label boolean")
    feats = spark.createDataFrame([(p, 0, 1) for p in range(4)] + [(p, 0, 2) for p in range(4, 10)] + [(p, 0, 3) for p in range(10)]
                                  + [(77, 0, 1)], "person_id long, window int, concept_id long")
    sel = spark.createDataFrame([(i, f"n{i}") for i in (1, 2, 3)], "ancestor_concept_id long, anc_concept_name string")
    got = {r[0]: r for r in ro.feature_downselect(train, sel, feats, threshold=-1).collect()}
    assert got[1]["true_covariance"] == pytest.approx(0.4 * 0.6)
    assert got[1]["label_covariance"] == pytest.approx(0.6 * 0.24)
    assert got[2]["true_covariance"] == pytest.approx(-0.24) and got[3]["label_covariance"] == pytest.approx(0)
    assert rows(ro.feature_downselect(train, sel, feats, 0.01), "concept_id") == [(1,)]


def test_matrix_bins(spark):
    grid = spark.createDataFrame([(1, 0, "FEMALE", 19), (1, 1, "FEMALE", 20), (2, 0, "male", 30), (2, 1, "male", 31)],
                                 "person_id long, window int, sex string, window_age int")
    visits = spark.createDataFrame([(1, 0, 1, 9), (1, 1, 2, 10), (2, 0, 0, 0), (2, 1, 10, 1)],
                                   "person_id long, window int, post_nonhosp_visit_count long, post_hosp_count long")
    feats = spark.createDataFrame([(1, 0, 5), (2, 1, 6)], "person_id long, window int, concept_id long")
    kept = spark.createDataFrame([(5,), (6,), (7,)], "concept_id long")
    got = ro.process_data_full(grid, visits, kept, feats.union(feats.selectExpr("person_id", "window", "8L")))
    assert rows(got, "person_id", "window", "concepts", "is_female", "age_bin", "op_visit_bin", "ip_visit_bin") == [
        (1, 0, ["5"], 1, 1, 0, 1), (1, 1, [], 1, 2, 1, 2), (2, 0, [], 0, 3, 0, 0), (2, 1, ["6"], 0, 3, 2, 0)]


def _auc(pairs):
    pos = [s for s, y in pairs if y]
    neg = [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_roc_without_scores_and_outside_the_unit_range(spark):
    pairs = [(-3.0, False), (12.5, True), (0.2, True), (0.2, False), (40.0, True), (-1.0, False)]
    odd = [(None, True), (float("nan"), False), (None, False), (7.0, None)]
    df = spark.createDataFrame(pairs + odd, "model_score double, label boolean")
    assert ev.roc_area(df).first()[0] == pytest.approx(_auc(pairs))
    last = min((r for r in ev.roc_table(df).collect() if r["threshold"] is not None), key=lambda r: r["threshold"])
    assert (last["FPR"], last["TPR"]) == (1, 1)
    one = spark.createDataFrame([(0.5, True), (0.5, False)], "model_score double, label boolean")
    assert ev.roc_area(one).first()[0] == 0.5 and ev.roc_table(one).count() == 2


def test_roc_with_ties(spark):
    rng = random.Random(2)
    pairs = [(round(rng.random(), 2) if i % 3 else rng.random() * 1e-7, rng.random() < 0.3) for i in range(600)] + [(1.0, True), (0.0, False)]
    df = spark.createDataFrame(pairs, "model_score double, label boolean")
    assert ev.roc_area(df).first()[0] == pytest.approx(_auc(pairs))
    curve = sorted(ev.roc_table(df).collect(), key=lambda r: -(2 if r["threshold"] is None else r["threshold"]))
    assert (curve[0]["FPR"], curve[0]["TPR"]) == (0, 0) and (curve[-1]["FPR"], curve[-1]["TPR"]) == (1, 1)
    assert len(curve) == len({s for s, _ in pairs}) + 1
    cut = curve[5]["threshold"]
    assert curve[5]["TPR"] == pytest.approx(sum(y for s, y in pairs if s >= cut) / sum(y for _, y in pairs))
    trapezoid = sum((b["FPR"] - a["FPR"]) * (a["TPR"] + b["TPR"]) / 2 for a, b in zip(curve, curve[1:]))
    assert trapezoid == pytest.approx(_auc(pairs))


def test_roc_one_class(spark):
    df = spark.createDataFrame([(0.2, True), (0.4, True)], "model_score double, label boolean")
    assert all(r["FPR"] is None for r in ev.roc_table(df).collect())
    assert ev.roc_area(df).first()[0] is None


def test_odds_and_zero_cell(spark):
    data = [(1, 1, 1, 0)] * 3 + [(1, 1, 0, 0)] * 2 + [(0, 1, 1, 0)] * 4 + [(0, 1, 0, 0)] * 6 + [(1, 0, 1, 1)] * 2 + [(0, 0, 0, 1)] * 2
    df = spark.createDataFrame(data, "long_covid int, hospitalized int, f int, g int")
    got = {r["concept"]: r for r in ev.odds_2x2(df, ["f", "g"]).collect()}
    f = got["f"]
    assert f["hosp_odds"] == pytest.approx((3 / 2) / (4 / 6))
    half = 1.96 * (1 / 3 + 1 / 2 + 1 / 4 + 1 / 6) ** 0.5
    import math
    assert f["hosp_upper_ci"] == pytest.approx(math.exp(math.log(2.25) + half))
    assert f["nonhosp_odds"] is None and got["g"]["hosp_odds"] is None
    assert f["total_odds"] == pytest.approx((5 / 2) / (4 / 8))


def test_logistic_matches_two_by_two(spark):
    """With one 0/1 predictor the fitted odds ratio is the one of the 2x2 table."""
    ages = {"18-25": (10, 20), "26-45": (15, 10), "46-55": (8, 9), "56-65": (5, 7), "66+": (6, 6)}
    data = [(b, 0.1 * (i % 7), 0.05 * (i % 5), y, i % 2) for b, (p, n) in ages.items() for y, k in ((1, p), (0, n)) for i in range(k)]
    df = spark.createDataFrame(data, "apprx_age string, op_post_visit_ratio double, ip_post_visit_ratio double, long_covid int, hospitalized int")
    got = {r["subgroup"]: r for r in ev.logistic_odds(df).collect()}
    assert len(got) == 6
    assert got["Age (26-45)"]["total_odds"] == pytest.approx((15 / 10) / (10 / 20), rel=1e-6)
    assert got["Age (66+)"]["total_lower_ci"] < got["Age (66+)"]["total_odds"] < got["Age (66+)"]["total_upper_ci"]


def test_top_and_importances(spark):
    df = spark.createDataFrame([(f"f{i}", float(i // 2)) for i in range(60)], "feature string, importance double")
    j = ev.join_importances(df, df, df.filter("feature <> 'f59'"))
    assert j.count() == 59
    assert ev.top_features(df, "importance").count() == 24      # a tie at the cut is kept
    odds = spark.createDataFrame([("F59", 1.23456)], "concept string, total_odds double")
    none = odds.limit(0).withColumn("subgroup", F.lit(""))
    combined = ev.combine_odds(none, odds, df).first()
    assert combined["total_odds"] == 1.235 and combined["importance"] == 29.0


def test_summary_and_tail(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 5.0), ("b", "x", None)], "theGroup string, c string, v double")
    got = {(r["grp"], r["variable"], r["value"]): r for r in ev.table_one(df, ["c"], ["v"]).collect()}
    assert got[("a", "c", "x")]["pct"] == 50 and got[("b", "c", "x")]["pct"] == 100
    assert got[("a", "v", None)]["mean"] == 2.0 and got[("b", "v", None)]["n"] == 1
    # upper tails of the F distribution from printed tables
    f = spark.createDataFrame([(3.0984, 3.0, 20.0), (4.3512, 1.0, 20.0), (161.4476, 1.0, 1.0), (2.604926, 3.0, 1e8), (0.0, 2.0, 9.0)],
                              "f double, a double, b double")
    tails = [r[0] for r in f.select(ev.f_tail("f", "a", "b")).collect()]
    assert tails[:4] == pytest.approx([0.05] * 4, abs=2e-6) and tails[4] == pytest.approx(1)
    q = ev.age_quantiles(spark.createDataFrame([("g", a) for a in range(11)], "theGroup string, apprx_age int"), ["g"])
    assert rows(q) == [(0.01, 0.1), (0.25, 2.5), (0.5, 5.0), (0.85, 8.5), (1.0, 10.0)]


def test_models_round_trip(spark, tmp_path):
    df = spark.range(300).selectExpr("id as person_id", "cast(id % 3 as int) as window", "id % 2 = 0 as label",
                                     "if(id % 2 = 0, array('5', '9'), array('9')) as concepts", "cast(id % 7 as double) as `6`",
                                     "false as hold_for_val")
    model = mo.train_boosted_trees(df, n_estimators=3, max_depth=2, colsample_bytree=1.0, gamma=0.0)
    scores = mo.model_scores(df, model)
    assert scores.filter("model_score < 0 or model_score > 1").count() == 0
    labelled = scores.join(df.select("person_id", "label"), "person_id")
    assert ev.roc_area(labelled).first()[0] == 1.0
    tables.save_model(model, f"{tmp_path}/m")
    again = mo.model_scores(df, tables.load_model(f"{tmp_path}/m"))
    assert rows(again) == rows(scores)
    assert mo.best_window(scores).count() == 300
    forest = mo.train_forest(df.withColumn("long_covid", F.col("label").cast("int")), n_estimators=3, max_depth=3)
    top = mo.feature_importance(forest, top=1).collect()
    assert top[0]["feature"] == "5"


def test_sources(spark, tmp_path):
    from cohortloom.session import materialise, shared_folder
    assert tables.read_feature_list(spark) == MODEL_FEATURES and len(set(MODEL_FEATURES)) == 199
    (tmp_path / "list.txt").write_text("a\n b \n\nc\n")
    assert tables.read_feature_list(spark, str(tmp_path / "list.txt")) == ["a", "b", "c"]
    (tmp_path / "concept.csv").write_text("concept_id,concept_name,domain_id,concept_class_id\n7,Cough,Condition,Finding\n")
    got = tables.read_concepts_csv(spark, str(tmp_path / "concept.csv"), vocabulary_id="SNOMED", standard_concept="S")
    assert rows(got) == [(7, "Cough", "Condition", "SNOMED", "Finding", "S")]
    (tmp_path / "ca.csv").write_text("a,d,x,y\n1,2,0,1\n")
    assert rows(tables.read_closure_csv(spark, str(tmp_path / "ca.csv"))) == [(1, 2, 0, 1)]
    stored = tables.store_table(got, "concept", str(tmp_path / "out"))
    assert rows(tables.read_table(spark, "concept", str(tmp_path / "out"))) == rows(stored)
    from cohortloom.session import release
    gone = materialise(got, "gone").inputFiles()[0]
    release(spark)
    assert not Path(gone.removeprefix("file://")).exists()
    kept = materialise(got, "step")
    assert rows(kept) == rows(got) and shared_folder(spark).removeprefix("file:") in kept.inputFiles()[0]


def test_tails_against_integrals(spark):
    """Both tails to six places against Simpson's rule, small and large degrees of freedom."""
    import math

    from cohortloom.functions.tails import chi_square_tail, f_tail

    def simpson(density, low, high, parts=20_000):
        step = (high - low) / parts
        return step / 3 * sum((1 if i in (0, parts) else 4 if i % 2 else 2) * density(low + i * step) for i in range(parts + 1))

    def chi(x, k):
        return simpson(lambda u: 2 * math.exp((k - 1) * math.log(max(u, 1e-300)) - u * u / 2 - k / 2 * math.log(2) - math.lgamma(k / 2)),
                       math.sqrt(x), math.sqrt(x) + math.sqrt(k) + 12)

    def fisher(f, a, b):
        low, beta = math.asin(math.sqrt(a * f / (b + a * f))), math.lgamma(a / 2) + math.lgamma(b / 2) - math.lgamma((a + b) / 2)
        return simpson(lambda u: 2 * math.exp((a - 1) * math.log(max(math.sin(u), 1e-300)) + (b - 1) * math.log(max(math.cos(u), 1e-300)) - beta),
                       low, min(math.pi / 2, low + 40 / math.sqrt(b)))

    cases = [(x, k) for k in (1, 2, 3, 10, 51, 300) for x in (0.01, 0.7 * k, float(k), 1.4 * k, 3.0 * k + 20)]
    df = spark.createDataFrame([(float(x), k) for x, k in cases] + [(None, 3), (1.0, 0), (-1.0, 2)], "x double, k int")
    got = [r[0] for r in df.coalesce(1).select(chi_square_tail("x", "k")).collect()]
    assert got[:-3] == pytest.approx([chi(*c) for c in cases], abs=1e-6) and got[-3:] == [None] * 3
    cases = [(f, a, b) for a in (1, 2, 5, 40) for b in (1, 4, 30, 2000) for f in (0.02, 0.9, 1.1, 4.0, 50.0)]
    df = spark.createDataFrame([(float(f), a, b) for f, a, b in cases], "f double, a int, b int")
    got = [r[0] for r in df.coalesce(1).select(f_tail("f", "a", "b")).collect()]
    assert got == pytest.approx([fisher(*c) for c in cases], abs=1e-6)


def test_a_value_of_the_data_gets_its_column(spark):
    persons = spark.createDataFrame([(1, "MALE", "a b", "CASE_HOSP"), (2, "Unknown", "new", "x"), (3, None, None, "x")],
                                    "person_id long, sex string, race string, patient_group string").withColumn("ethn", F.lit("e"))
    none = spark.createDataFrame([], "person_id long, min_long_covid_date date")
    wide = ft.add_labels(persons, none)
    assert {"sex_male", "sex_unknown", "race_a_b", "race_new", "ethn_e"} <= set(wide.columns)
    assert rows(wide, "person_id", "sex_male", "sex_unknown", "race_a_b", "race_new") == [(1, 1, 0, 1, 0), (2, 0, 1, 0, 1), (3, 0, 0, 0, 0)]


def test_rows_of_a_fit_fill_their_tasks(spark):
    """A boosted tree's few rows lie in one task, a large forest's in several; all rows are there."""
    data = spark.range(3000, numPartitions=12).selectExpr("id AS person_id", "id % 2 AS label")
    rows, n = mo.rows_of_fit(data, 1)
    assert n == 3000 and rows.rdd.getNumPartitions() == 1 and rows.distinct().count() == 3000
    rows, _ = mo.rows_of_fit(data, 100)
    assert rows.rdd.getNumPartitions() == 3 and rows.distinct().count() == 3000
