import datetime as dt
import random

import pytest
from conftest import day, plus, rows

from cohortloom.operators import intervals as iv

VISIT = "visit_occurrence_id long, person_id long, visit_concept_id int, visit_start_date date, visit_end_date date"


def visits(spark, *tuples):
    return spark.createDataFrame(
        [(i, p, k, plus(a) if a is not None else None, plus(b) if b is not None else None)
         for i, (p, k, a, b) in enumerate(tuples)], VISIT)


def test_scaffold_edges(spark):
    v = visits(spark, (1, 9201, 0, None), (1, 9201, 5, 4), (1, 9202, 0, 0), (1, 9202, 0, 1), (1, 9202, 0, 2),
               (1, 9203, 0, 0), (1, 9203, 0, 1), (1, 9201, 0, 0), (1, 581477, 0, 3), (1, 262, None, 3))
    assert [r[0] for r in rows(iv.scaffold_filter(v), "visit_occurrence_id")] == [3, 6, 7]


def naive_merge(spans):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("spans", [
    [(0, 10), (2, 3)],                 # nested
    [(0, 5), (5, 8)],                  # touching
    [(0, 5), (6, 8)],                  # a day apart
    [(0, 1), (0, 9), (4, 5)],          # equal starts
    [(0, 30), (2, 4), (20, 22), (31, 33)],
])
def test_merge_edges(spark, spans):
    df = spark.createDataFrame([(1, plus(a), plus(b)) for a, b in spans],
                               "person_id long, visit_start_date date, visit_end_date date")
    got = rows(iv.merge_intervals(df), "group_number", "macrovisit_start_date", "macrovisit_end_date")
    want = [(i + 1, plus(a), plus(b)) for i, (a, b) in enumerate(naive_merge(spans))]
    assert got == want


def test_merge_random_against_naive(spark):
    rng = random.Random(3)
    spans = [(p, a, a + rng.randrange(0, 12)) for p in range(40) for a in [rng.randrange(0, 200) for _ in range(15)]]
    df = spark.createDataFrame([(p, plus(a), plus(b)) for p, a, b in spans],
                               "person_id long, visit_start_date date, visit_end_date date")
    got = rows(iv.merge_intervals(df), "person_id", "macrovisit_start_date", "macrovisit_end_date")
    want = sorted((p, plus(a), plus(b)) for p in range(40) for a, b in naive_merge([(a, b) for q, a, b in spans if q == p]))
    assert got == want
    assert iv.merge_intervals(df).select("macrovisit_id").distinct().count() == len(want)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("bits", [2, 6])
def test_interval_join_against_all_pairs(spark, how, bits):
    rng = random.Random(5)
    points = [(i, rng.randrange(5), rng.randrange(-40, 120) if i % 9 else None) for i in range(200)]
    spans = [(k, s, s + rng.randrange(-2, 30)) for k in range(5) for s in [rng.randrange(-30, 100) for _ in range(6)]]
    p = spark.createDataFrame([(i, k, plus(d, "1970-01-10") if d is not None else None) for i, k, d in points],
                              "id long, person_id long, d date")
    s = spark.createDataFrame([(k, plus(a, "1970-01-10"), plus(b, "1970-01-10")) for k, a, b in spans],
                              "person_id long, a date, b date")
    got = iv.interval_join(p, s, "d", "a", "b", how=how, bucket_bits=bits)
    hits = [(i, a, b) for i, k, d in points for q, a, b in spans if q == k and d is not None and a <= d <= b]
    hit_ids = {i for i, _, _ in hits}
    if how == "inner":
        assert got.count() == len(hits)
    elif how == "left":
        assert got.count() == len(hits) + len(points) - len(hit_ids)
    else:
        want = hit_ids if how == "left_semi" else {i for i, _, _ in points} - hit_ids
        assert [r[0] for r in rows(got, "id")] == sorted(want)


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_spans_without_end_cost_few_rows(spark, how):
    """Ends in the year 9999, starts in the year 1 and dates far outside all spans."""
    rng = random.Random(6)
    base = dt.date(2020, 1, 1)
    near = lambda: base + dt.timedelta(days=rng.randrange(2000))
    spans = [(k, a, a + dt.timedelta(days=rng.randrange(90))) for k in range(6) for a in [near() for _ in range(8)]]
    spans += [(1, near(), dt.date(9999, 12, 31)), (2, dt.date(1, 1, 1), near()), (3, dt.date(1, 1, 1), dt.date(9999, 12, 31)),
              (4, dt.date(7000, 1, 1), dt.date(9999, 12, 31)), (5, None, near()), (5, near(), None), (0, near(), dt.date(3, 1, 1))]
    points = [(i, rng.randrange(7), near()) for i in range(150)]
    points += [(200 + i, k, d) for i, (k, d) in enumerate(
        (k, d) for k in range(6) for d in (dt.date(2, 2, 2), dt.date(1900, 1, 1), dt.date(2500, 1, 1), dt.date(8000, 1, 1), None))]
    p = spark.createDataFrame(points, "id long, person_id long, d date")
    s = spark.createDataFrame(spans, "person_id long, a date, b date")
    got = iv.interval_join(p, s, "d", "a", "b", how=how)
    inside = lambda d, a, b: None not in (d, a, b) and a <= d <= b
    hits = sorted((i, a, b) for i, k, d in points for q, a, b in spans if q == k and inside(d, a, b))
    missed = [i for i, _, _ in points if i not in {h[0] for h in hits}]
    want = {"inner": hits, "left": hits + [(i, None, None) for i in missed], "left_anti": [(i,) for i in missed]}[how]
    columns = ["id"] if how == "left_anti" else ["id", "a", "b"]
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want, key=str)
    low, high = iv._bucket_range(s.filter("a <= b"), "a", "b", 6)
    first, last = spark.range(1).select(low, high).first()
    assert last - first < 200


def test_dates_are_read_once(spark, tmp_path):
    spark.createDataFrame([(1, plus(3))], "person_id long, d date").write.parquet(f"{tmp_path}/points")
    spans = spark.createDataFrame([(1, plus(0), plus(9))], "person_id long, a date, b date")
    joined = iv.interval_join(spark.read.parquet(f"{tmp_path}/points"), spans, "d", "a", "b")
    assert joined.count() == 1
    assert joined._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1


def test_visits_to_episodes_edges(spark):
    v = visits(spark,
               (1, 9201, 10, 20),          # 0 carries an episode
               (1, 581477, 9, 9),          # 1 the day before
               (1, 581477, 10, 40),        # 2 on its first day
               (1, 581477, 20, None),      # 3 on its last day, no end
               (1, 581477, 21, 21),        # 4 the day after
               (1, 9202, 50, 51),          # 5 outpatient overnight only: no qualifying visit
               (1, 581477, None, 52),      # 6 no start
               (2, 581477, 12, 12))        # 7 somebody else
    got = dict(rows(iv.visits_with_episodes(v), "visit_occurrence_id", "macrovisit_start_date"))
    assert got == {0: plus(10), 1: None, 2: plus(10), 3: plus(10), 4: None, 5: None, 6: None, 7: None}


def test_one_pass_equals_four_steps(spark):
    rng = random.Random(11)
    kinds = [9201, 9202, 9203, 581477, 262]
    v = visits(spark, *[(rng.randrange(20), rng.choice(kinds), s, s + rng.randrange(-1, 8) if rng.random() < .9 else None)
                        for s in [rng.randrange(0, 150) for _ in range(500)]])
    mapped = iv.map_visits_to_spans(v, iv.merge_intervals(iv.scaffold_filter(v)))
    steps = iv.attach_episodes(v, iv.qualifying_episodes(mapped))
    once = iv.visits_with_episodes(v).select(*steps.columns)
    assert steps.exceptAll(once).count() == 0 and once.exceptAll(steps).count() == 0
    spans = rows(iv.episodes_of(once), "person_id", "macrovisit_start_date", "macrovisit_end_date")
    assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(spans, spans[1:]))  # disjoint per person


def test_link_facts(spark):
    v = visits(spark, (1, 9201, 10, 20), (1, 581477, 40, 40))
    m = iv.visits_with_episodes(v)
    facts = spark.createDataFrame(
        [(1, 1, plus(99), 0), (2, 1, plus(15), None), (3, 1, plus(30), None), (4, 1, None, None), (5, 1, plus(12), 1),
         (2, 1, plus(15), None)], "fact_id long, person_id long, d date, visit_occurrence_id long")
    got = rows(iv.link_facts(facts, m, "d"), "fact_id", "macrovisit_start_date")
    assert got == [(1, plus(10)), (2, plus(10)), (5, None)]


def test_blackout_edges(spark):
    spans = spark.createDataFrame([(1, plus(0), plus(10)), (1, plus(5), plus(20))],
                                  "person_id long, blackout_begin date, blackout_end date")
    facts = spark.createDataFrame(
        [(1, 1, plus(-1)), (2, 1, plus(0)), (3, 1, plus(20)), (4, 1, plus(21)), (5, 1, None), (6, 2, plus(5)), (7, 3, plus(5))],
        "id long, person_id long, d date")
    assert [r[0] for r in rows(iv.drop_blacked_out(facts, spans, "d"), "id")] == [1, 4, 5, 6, 7]
    persons = spark.createDataFrame([(1,), (2,), (2,)], "person_id long")
    assert [r[0] for r in rows(iv.open_facts_of(persons, facts, spans, "d"), "id")] == [1, 4, 5, 6]


def test_drilldown(spark):
    v = visits(spark, (1, 9201, 10, 20), (1, 581477, 12, 12), (1, 581477, 12, 12), (2, 9201, 10, 11)) \
        .selectExpr("*", "'x' as visit_concept_name")
    got = iv.episode_drilldown(iv.visits_with_episodes(v), 1, "2021-01-01", "2021-12-31").collect()
    assert [r["visit_start_date"] for r in got] == [plus(10), plus(12)]
    assert day("2021-01-11") == plus(10)
