"""Facts stored by person, and days as bits."""

import datetime as dt
import random

from pyspark.sql import functions as F

from cohortloom import session
from cohortloom.operators import daybits as db
from cohortloom.operators import intervals as iv
from cohortloom.operators import rolling as ro
from cohortloom.sources import layout as ly

from conftest import plus, rows


def facts(spark, n=3000, hot=0.35, seed=1):
    rng = random.Random(seed)
    data = [(7 if rng.random() < hot else rng.choice([None, *range(60)]), i, plus(rng.randrange(400))) for i in range(n)]
    return spark.createDataFrame(data, "person_id long, id long, d date")


def test_large_persons_are_stored_apart(spark):
    table = facts(spark)
    stored = ly.store_by_person(table, "facts", buckets=16)
    apart = {r.person_id for r in stored.apart.select("person_id").distinct().collect()}
    assert apart == {7, None}
    assert rows(stored.whole()) == rows(table)
    few = ly.store_by_person(facts(spark, hot=0).filter("person_id is not null"), "even", buckets=4)
    assert few.apart is None or few.apart.count() < 1500
    assert rows(ly.store_by_person(table.limit(0), "none", buckets=4).whole()) == []
    name = ly._tables[-1][1]
    session.release(spark)
    assert not ly._tables and not spark.catalog.tableExists(name)


def test_stored_facts_are_not_shuffled(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = facts(spark)
        spans = spark.createDataFrame([(p, plus(40 * p % 300), plus(40 * p % 300 + 30)) for p in range(0, 60, 2)],
                                      "person_id long, blackout_begin date, blackout_end date")
        persons = spark.createDataFrame([(p,) for p in range(50)], "person_id long")
        stored = ly.store_by_person(table, "facts", buckets=16)
        out = stored.each(lambda part: iv.open_facts_of(persons, part, spans, "d"))
        assert rows(out) == rows(iv.open_facts_of(persons, table, spans, "d"))
        counts = stored.bucketed.join(persons, "person_id").groupBy("person_id", "d").agg(F.count("*").alias("n"))
        assert counts.count() > 100
        for df in (iv.open_facts_of(persons, stored.bucketed, spans, "d"), counts):
            df.collect()
            assert ly.exchanges_over(df, "facts_") == []
        assert ly.exchanges_over(table.groupBy("person_id").count(), "facts_") == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        session.release(spark)


def test_masks_of_spans(spark):
    rng = random.Random(2)
    base = dt.date(1969, 12, 1)
    spans = [(i, base + dt.timedelta(days=a), base + dt.timedelta(days=a + rng.choice([-3, 0, 1, 40, 63, 64, 200])))
             for i, a in enumerate(rng.randrange(300) for _ in range(60))]
    df = spark.createDataFrame(spans, "i int, a date, b date")
    got = {}
    for r in db.span_masks(df, F.col("a"), F.col("b")).collect():
        got.setdefault(r.i, set()).update(64 * r.word + k for k in range(64) if r["mask"] >> k & 1)
    day = lambda d: (d - dt.date(1970, 1, 1)).days
    assert got == {i: set(range(day(a), day(b) + 1)) for i, a, b in spans if a <= b}


def test_visit_counts_in_windows_against_plain_ones(spark):
    rng = random.Random(3)
    windows = [(n, plus(30 * n - 40), plus(30 * n + 60)) for n in range(12)]
    black = [(p, plus(a), plus(a + 60)) for p in range(12) for a in rng.sample(range(0, 400, 70), 2)]
    black += [(3, None, plus(900)), (4, plus(0), None), (5, plus(10), plus(5)), (6, plus(-4000), plus(-20)), (7, plus(300), dt.date(9999, 12, 31))]
    visits = [(p, plus(d) if rng.random() < 0.95 else None, rng.choice([None, 1, 0]))
              for p in range(14) for d in [rng.randrange(-60, 450) for _ in range(40)]]
    grid = [(p, n) for p in range(13) for n in range(11)]
    shut = lambda p, d: any(q == p and None not in (a, b) and a <= d <= b for q, a, b in black)
    want = []
    for p, n in grid:
        days = [(d, h) for q, d, h in visits if q == p and d and windows[n][1] <= d <= windows[n][2] and not shut(p, d)]
        want.append((p, n, len({d for d, h in days if h is None}), len({d for d, h in days if h == 1})))
    got = ro.post_visit_counts_in_windows(
        spark.createDataFrame(grid, "person_id long, window int"),
        spark.createDataFrame(black, "person_id long, blackout_begin date, blackout_end date"),
        spark.createDataFrame(visits, "person_id long, visit_start_date date, likely_hospitalization int"),
        spark.createDataFrame(windows, "window_name int, window_start date, window_end date"))
    assert rows(got, "person_id", "window", "post_nonhosp_visit_count", "post_hosp_count") == sorted(want)
