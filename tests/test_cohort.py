from conftest import day, plus, rows

from cohortloom.operators import cohort as co
from cohortloom.operators import first_dates as fd
from cohortloom.operators import windows as wi

COND = ("person_id long, condition_concept_id long, condition_source_value string, condition_start_date date, "
        "visit_occurrence_id long, data_partner_id int")
MEAS = "person_id long, measurement_concept_id long, value_as_concept_id long, measurement_date date, data_partner_id int"
MAP = ("visit_occurrence_id long, person_id long, visit_concept_id int, visit_start_date date, macrovisit_id string, "
       "macrovisit_start_date date, macrovisit_end_date date")


def test_index_dates_by_code_text_and_test(spark):
    c = spark.createDataFrame([
        (1, 710706, "", plus(5), None, 1), (1, 705076, "", plus(3), None, 1),
        (2, 1, "x U09.9 y", plus(8), None, 1), (3, 37311061, "U09.9", plus(9), None, 1), (4, 5, "other", plus(1), None, 1)], COND)
    m = spark.createDataFrame([
        (3, 706163, 9191, plus(7), 1), (3, 706163, 1, plus(2), 1), (5, 37310257, 45877985, plus(4), 1),
        (6, 1, 9191, plus(4), 1)], MEAS)
    got = rows(fd.all_index_dates(c, m), "person_id", "pos_test_idx", "u07_any_idx", "u099_idx")
    assert got == [(1, None, None, plus(3)), (2, None, None, plus(8)), (3, plus(7), plus(9), plus(9)),
                   (5, plus(4), None, None)]


def _cohort_inputs(spark, ids):
    person = spark.createDataFrame([(i, 1980, "F", "r", "e", 1) for i in ids],
                                   "person_id long, year_of_birth int, gender_concept_name string, race_concept_name string, "
                                   "ethnicity_concept_name string, data_partner_id int")
    manifest = spark.createDataFrame([(1, plus(200))], "data_partner_id int, run_date date")
    return person, manifest


def test_follow_up_bounds_and_death(spark):
    idx = spark.createDataFrame([(1, plus(100), None, None), (2, plus(101), None, None), (3, plus(150), None, None),
                                 (4, None, None, plus(0)), (5, plus(150), plus(90), None)],
                                "person_id long, pos_test_idx date, u07_any_idx date, u099_idx date")
    person, manifest = _cohort_inputs(spark, range(1, 6))
    death = spark.createDataFrame([(3, plus(50))], "person_id long, death_date date")
    got = rows(co.collect_cohort(idx, person, manifest, death), "person_id", "min_covid_dt", "apprx_age")
    assert got == [(1, plus(100), 41), (3, plus(150), 41), (5, plus(90), 41)]


def test_hospital_group_edges(spark):
    cohort = spark.createDataFrame([(i, plus(100)) for i in range(1, 6)], "person_id long, min_covid_dt date")
    vm = spark.createDataFrame([
        (1, 1, 9201, plus(86), "a", plus(86), plus(90)), (2, 2, 9201, plus(85), "b", plus(85), plus(99)),
        (3, 3, 9201, plus(114), "c", plus(114), plus(114)), (4, 4, 9201, plus(300), "d", plus(300), plus(301)),
        (5, 5, 9201, plus(300), None, None, None)], MAP)
    c = spark.createDataFrame([(4, 37311061, "", plus(300), 4, 1), (5, 37311061, "", plus(300), 5, 1)], COND)
    got = dict(rows(co.with_hospital_group(cohort, vm, c), "person_id", "patient_group"))
    assert got == {1: "CASE_HOSP", 2: "CASE_NONHOSP", 3: "CASE_HOSP", 4: "CASE_HOSP", 5: "CASE_NONHOSP"}
    hosp = co.hospitalised_cases(cohort, vm, c)
    assert [r[0] for r in rows(co.non_hospitalised_cases(cohort, hosp), "person_id")] == [2, 5]


def test_hospital_persons_are_stored_before_the_cohort_meets_them(spark):
    """Otherwise one task holds the sorts of both rules beside those of the cohort."""
    cohort = spark.range(50).selectExpr("id AS person_id", "date'2021-01-10' AS min_covid_dt")
    v = spark.range(90).selectExpr("id % 45 AS person_id", "id AS visit_occurrence_id", "if(id % 3 = 0, 'e', null) AS macrovisit_id",
                                   "date'2021-01-01' + cast(id AS int) AS macrovisit_start_date")
    c = spark.range(90).selectExpr("id AS visit_occurrence_id", "37311061L AS condition_concept_id", "'x' AS condition_concept_name")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cases = co.hospitalised_cases(cohort, v, c)
        grouped = co.with_hospital_group(cohort, v, c)
        for df in (cases, grouped):
            assert df._jdf.queryExecution().executedPlan().toString().count("Sort ") == 2
        want = rows(co.hospital_persons(cohort, v, c).filter("person_id < 50"), "person_id")
        assert rows(cases, "person_id") == want == rows(grouped.filter("patient_group = 'CASE_HOSP'"), "person_id")
        assert 0 < len(want) < grouped.count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_windows(spark):
    c = spark.createDataFrame([(1, plus(0), plus(400), None), (2, plus(0), plus(200), plus(30)), (3, plus(0), plus(300), plus(100))],
                              "person_id long, min_covid_dt date, run_date date, first_LC_clin_dt date")
    got = rows(wi.pre_post_windows(c), "person_id", "pre_window_start_dt", "pre_window_end_dt", "post_window_start_dt",
               "post_window_end_dt")
    assert got == [(1, plus(-365), plus(-45), plus(45), plus(300)), (2, plus(-365), plus(-45), plus(45), plus(200)),
                   (3, plus(-365), plus(-45), plus(45), plus(300))]
    got = rows(wi.clinic_ended_windows(c), "person_id", "post_window_end_dt", "patient_type")
    assert got == [(1, plus(365), "TEST"), (2, plus(45), "TRAINING"), (3, plus(99), "TRAINING")]


def test_visit_rates(spark):
    w = spark.createDataFrame([(p, plus(45), plus(300 if p != 4 else 45)) for p in (1, 2, 3, 4)],
                              "person_id long, post_window_start_dt date, post_window_end_dt date")
    vm = spark.createDataFrame(
        [(i, p, 1, plus(d), m, None, None) for i, (p, d, m) in enumerate([
            (1, 0, None), (1, 50, None), (1, 50, None), (1, 45, None), (1, 300, None), (1, 301, None), (1, 60, "e"),
            (2, 0, None), (2, 1, None), (3, 0, None), (3, 9, None), (4, 0, None), (4, 45, None)])], MAP)
    got = rows(co.with_visit_rates(w, vm), "person_id", "tot_long_data_days", "post_visits_count", "post_visits_per_pt_day")
    assert got == [(1, 301, 3, 0.01), (3, 9, 0, 0.0), (4, 45, 1, 1 / 300)]
    by_day = dict(rows(co.with_visit_rates(w, vm, rate_days=None), "person_id", "post_visits_per_pt_day"))
    assert by_day[4] is None and by_day[1] == 3 / 255


def test_comorbidities_need_two_dates_before_index(spark):
    c = spark.createDataFrame([(1, 7, "", plus(1), None, 1), (1, 7, "", plus(1), None, 1), (2, 7, "", plus(1), None, 1),
                               (2, 8, "", plus(9), None, 1), (3, 7, "", plus(50), None, 1), (3, 7, "", plus(51), None, 1)], COND)
    codes = spark.createDataFrame([(7,), (8,)], "concept_id long")
    assert rows(co.comorbidity_patients(c, codes)) == [(2, 2, plus(1)), (3, 2, plus(50))]
    cohort = spark.createDataFrame([(i, plus(50)) for i in (1, 2, 3)], "person_id long, min_covid_dt date")
    flags = co.with_comorbidity_flags(cohort, co.all_comorbidities(c, {"dm": codes}), names=("dm",))
    assert rows(flags, "person_id", "dm") == [(1, "No"), (2, "Yes"), (3, "No")]


def test_history_rule(spark):
    idx = spark.createDataFrame([(1, plus(180)), (2, plus(179)), (3, plus(100))], "person_id long, min_covid_dt date")
    v = spark.createDataFrame([(i, i, plus(0), 1 if i < 3 else 2) for i in (1, 2, 3)],
                              "visit_occurrence_id long, person_id long, visit_start_date date, data_partner_id int")
    c = spark.createDataFrame([(i, 1, "", plus(0), i, 1) for i in (1, 2, 3)], COND)
    m = spark.createDataFrame([(1, plus(1000)), (2, plus(200))], "data_partner_id int, run_date date")
    got = rows(co.sufficient_history(idx, v, c, m), "person_id", "HX_DAYS")
    assert got == [(1, 1000), (3, 200)]


def test_site_index(spark):
    c = spark.createDataFrame([(1, 37311061, "", plus(5), None, 1), (2, 37311061, "", plus(5), None, 9),
                               (3, 37311061, "", plus(5), None, 1), (4, 37311061, "", plus(6), None, 1)], COND)
    vm = spark.createDataFrame([(i, i, 9201 if i != 3 else 9202, plus(0), None, None, None) for i in (1, 2, 3, 4)], MAP)
    dx = fd.site_dx_index(c, vm, [1])
    assert rows(dx) == [(1, plus(5)), (4, plus(6))]
    m = spark.createDataFrame([(1, 50, 60, plus(2), 1), (5, 50, 60, plus(3), 1), (6, 50, 61, plus(3), 1), (7, 50, 60, plus(3), 9)], MEAS)
    one = spark.createDataFrame([(50,)], "concept_id long")
    lab = fd.site_lab_index(m, one, spark.createDataFrame([(60,)], "concept_id long"), [1])
    death = spark.createDataFrame([(4,)], "person_id long")
    assert rows(fd.living_earliest_index(dx, lab, death)) == [(1, plus(2)), (5, plus(3))]
    assert day("2021-01-03") == plus(2)
