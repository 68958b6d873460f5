import random

from conftest import day, plus, rows
from pyspark.sql import functions as F

from cohortloom.operators import infections as inf
from cohortloom.operators import rolling as ro
from cohortloom.operators import windows as wi
from cohortloom.session import materialise

FLAGS = ("PCR_AG_Pos LL_COVID_diagnosis PAX1_NIRMATRELVIR PAX2_RITONAVIR PAXLOVID REMDISIVIR "
         "LL_Long_COVID_diagnosis B94_8 LL_MISC").split()
SCHEMA = "person_id long, date date, " + ", ".join(f"{f} int" for f in FLAGS)


def fact(person, date, *on):
    return (person, date, *[int(f in on) for f in FLAGS])


def test_first_flags(spark):
    f = spark.createDataFrame([
        fact(1, plus(0), "PCR_AG_Pos"), fact(1, plus(-5), "LL_COVID_diagnosis"), fact(2, plus(1), "PAX1_NIRMATRELVIR"),
        fact(2, plus(2), "PAX2_RITONAVIR"), fact(3, plus(3), "PAX1_NIRMATRELVIR", "PAX2_RITONAVIR"),
        fact(3, plus(2), "REMDISIVIR"), fact(4, day("2020-02-28"), "PCR_AG_Pos"), fact(5, plus(9), "B94_8")], SCHEMA)
    c = inf.covid_cohort(f)
    assert [r[0] for r in rows(c, "person_id")] == [1, 3, 5]
    assert rows(inf.cohort_and_idx(c), "person_id", "covid_index_date") == [(1, plus(-5)), (3, plus(2))]
    assert rows(inf.infection_dates(c, f)) == [(1, plus(-5), 0)]
    assert rows(inf.infection_dates(c, f, compat=True)) == [(1, plus(-5), 0), (3, None, 0), (5, None, 0)]


def naive_chain(start, dates, gap=60):
    out = [start]
    while True:
        later = [d for d in dates if (d - out[-1]).days > gap]
        if not later:
            return out
        out.append(min(later))


def test_chain_gaps_and_random(spark):
    rng = random.Random(1)
    cases = {1: (0, [60, 61]), 2: (0, [30, 61, 62, 122, 123, 200, 300]), 3: (10, []), 4: (5, [1, 2, 3])}
    for p in range(5, 30):
        cases[p] = (rng.randrange(50), [rng.randrange(0, 900) for _ in range(rng.randrange(0, 40))])
    a = spark.createDataFrame([(p, plus(s)) for p, (s, _) in cases.items()] + [(99, None)], "person_id long, s date")
    e = spark.createDataFrame([(p, plus(d)) for p, (_, ds) in cases.items() for d in ds] + [(99, plus(3))],
                              "person_id long, d date")
    got = rows(inf.greedy_chain(a, e, "s", "d"), "person_id", "chain_number", "chain_date")
    want = sorted((p, i, d) for p, (s, ds) in cases.items() for i, d in enumerate(naive_chain(plus(s), [plus(x) for x in ds])))
    assert got == want


def test_blackout_spans(spark):
    idx = spark.createDataFrame([(1, plus(10)), (2, plus(20))], "person_id long, covid_index_date date")
    i = spark.createDataFrame([(1, plus(10), 0), (1, plus(90), 1), (3, plus(5), 0)],
                              "person_id long, infection_date date, infection_number int")
    assert rows(inf.blackout_dates(idx, i)) == [
        (1, plus(10), plus(3), plus(38)), (1, plus(90), plus(83), plus(118)), (2, plus(20), plus(13), plus(48))]


def test_calendar_and_grid(spark):
    w = wi.calendar_windows(spark, (2020, 11), (2021, 2))
    assert rows(w) == [(0, day("2020-11-01"), day("2021-02-09")), (1, day("2020-12-01"), day("2021-03-11")),
                       (2, day("2021-01-01"), day("2021-04-11"))]
    assert wi.window_days(w).count() == 3 * 101
    assert wi.calendar_windows(spark, (2021, 2), (2021, 2)).count() == 0
    p = spark.createDataFrame([(1, 2003, "F"), (2, 2002, "F"), (3, 1921, "M"), (4, 1920, "M"), (5, 1980, "M")],
                              "person_id long, year_of_birth int, gender_concept_name string")
    idx = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "person_id long")
    got = rows(wi.person_window_grid(p, idx, w), "person_id", "window", "window_age")
    assert got == [(1, 2, 18), (2, 0, 18), (2, 1, 18), (2, 2, 19), (3, 0, 99), (3, 1, 99)]
    assert wi.person_window_grid(p, idx, w, min_age=50, max_age=50).count() == 0


def test_grid_is_laid_out_by_as_many_tasks_as_its_rows_fill(spark, monkeypatch):
    monkeypatch.setattr(wi, "GRID_ROWS_A_TASK", 500)
    w = wi.calendar_windows(spark, (2020, 1), (2024, 1))
    p = spark.range(100).selectExpr("id AS person_id", "1980 AS year_of_birth", "'F' AS gender_concept_name")
    grid = wi.person_window_grid(p, p.select("person_id"), w)
    sizes = [r.n for r in grid.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert grid.rdd.getNumPartitions() == -(-100 * 48 // 500) and sum(sizes) == 100 * 48 and max(sizes) <= 4 * 500
    # What is worked out person by person needs no further shuffle of the grid.
    plan = grid.groupBy("person_id").agg(F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == plan.count("REPARTITION_BY_NUM") == 1


def _labels(spark, compat):
    grid = spark.createDataFrame([(p, w) for p in range(1, 7) for w in (0, 1)], "person_id long, window int")
    c = spark.createDataFrame([
        (1, 705076, plus(1)), (2, 705076, plus(1)), (2, 705076, plus(1)), (3, 705076, plus(1)), (3, 705076, plus(4)),
        (4, 36714927, plus(2)), (4, 36714927, plus(3)), (9, 705076, plus(1)), (9, 705076, plus(2))],
        "person_id long, condition_concept_id long, condition_start_date date")
    o = spark.createDataFrame([(5, 2004207791, plus(7)), (5, 2004207791, plus(8)), (3, 2004207791, plus(-9)),
                               (3, 2004207791, plus(-8)), (6, 1, plus(8))],
                              "person_id long, observation_concept_id long, observation_date date")
    return inf.repeat_labels(c, grid, o, compat)


def test_labels_by_documented_rules(spark):
    got = rows(_labels(spark, False), "person_id", "label_date")
    assert got == [(3, plus(-9)), (4, plus(2)), (5, plus(7))]


def test_labels_as_coded_count_once_per_window(spark):
    got = rows(_labels(spark, True), "person_id", "num_u09s", "TRAIN_num_lc_clinic_visits", "label_date")
    assert got == [(1, 2, 0, plus(1)), (2, 2, 0, plus(1)), (3, 4, 4, plus(-9)), (5, 0, 4, plus(7))]


def test_labels_empty(spark):
    assert _labels(spark, False).filter("person_id > 100").count() == 0


def test_window_visit_counts(spark):
    w = wi.calendar_windows(spark, (2021, 1), (2021, 3))
    grid = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "person_id long, window int")
    v = spark.createDataFrame([
        (1, 1, plus(0), None), (2, 1, plus(0), None), (3, 1, plus(40), 1), (4, 1, plus(40), None), (5, 1, plus(20), None),
        (6, 1, plus(100), 1), (7, 1, plus(50), 0)],
        "visit_occurrence_id long, person_id long, visit_start_date date, likely_hospitalization int")
    b = spark.createDataFrame([(1, plus(15), plus(25))], "person_id long, blackout_begin date, blackout_end date")
    assert rows(ro.post_visit_counts_in_windows(grid, b, v, w)) == [(1, 0, 2, 2), (1, 1, 1, 2), (2, 0, 0, 0)]


def test_a_long_grid_does_not_pass_as_small(spark):
    """A stored grid of five million rows is a few megabytes as a file; it must not be broadcast for that."""
    grid = materialise(spark.range(100_000).selectExpr("id AS person_id", "explode(sequence(0, 52)) AS window"), "grid")
    conditions = spark.createDataFrame([(1, 705076, plus(0))], "person_id long, condition_concept_id long, condition_start_date date")
    observations = spark.createDataFrame([(1, 2004207791, plus(0))], "person_id long, observation_concept_id long, observation_date date")
    plan = inf.repeat_labels(conditions, grid, observations)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
