"""Batched logistic fits and profile limits against plain ones by bisection."""

import math
import random

import pytest

from cohortloom.operators import evaluation as ev
from cohortloom.operators.logit import HALF_CHI_SQUARE_95, odds_with_limits


def likelihood(rows, a, b):
    return sum(y * (a + b * x) - n * (max(a + b * x, 0) + math.log1p(math.exp(-abs(a + b * x)))) for x, n, y in rows)


def best_intercept(rows, b):
    low, high = -60.0, 60.0
    for _ in range(100):
        a = (low + high) / 2
        slope = sum(y - n / (1 + math.exp(-max(-500.0, min(500.0, a + b * x)))) for x, n, y in rows)
        low, high = (a, high) if slope > 0 else (low, a)
    return low


def profile(rows, b):
    return likelihood(rows, best_intercept(rows, b), b)


def plain(rows):
    """Slope and limits by golden section and bisection on the profile likelihood."""
    low, high, g = -20.0, 20.0, (math.sqrt(5) - 1) / 2
    for _ in range(120):
        c, d = high - g * (high - low), low + g * (high - low)
        low, high = (low, d) if profile(rows, c) > profile(rows, d) else (c, high)
    b = (low + high) / 2
    goal = profile(rows, b) - HALF_CHI_SQUARE_95
    ends = []
    for far in (30.0, -30.0):
        near, away = b, b + far
        for _ in range(80):
            middle = (near + away) / 2
            near, away = (middle, away) if profile(rows, middle) > goal else (near, middle)
        ends.append(near)
    return [math.exp(v) for v in (b, *ends)]


def test_fits_and_limits(spark):
    rng = random.Random(1)
    models = {}
    for m in range(5):
        slope = rng.uniform(-2, 2)
        rows = {}
        for _ in range(150):
            x = round(rng.uniform(0, 3), 1)
            hit = rng.random() < 1 / (1 + math.exp(0.5 - slope * x))
            n, y = rows.get(x, (0, 0))
            rows[x] = (n + 1, y + hit)
        models[f"m{m}"] = [(x, n, y) for x, (n, y) in rows.items()]
    models["few"] = [(0.0, 5, 2), (1.0, 4, 3)]
    models |= {"separated": [(0.0, 5, 0), (1.0, 4, 4)], "touching": [(0.0, 5, 0), (1.0, 4, 2)], "one class": [(0.0, 5, 5), (1.0, 4, 4)],
               "constant": [(1.0, 9, 4)]}
    df = spark.createDataFrame([(m, *r) for m, rows in models.items() for r in rows], "model string, x double, n long, y long")
    got = odds_with_limits(df.repartition(3))
    assert got.keys() == {"m0", "m1", "m2", "m3", "m4", "few"}
    for m, found in got.items():
        assert found == pytest.approx(plain(models[m]), rel=1e-5), m
    assert odds_with_limits(df.limit(0)) == {}


def test_separated_strata_give_null(spark):
    data = [("18-25", 0.1 * i, None, i % 2, 1) for i in range(12)] + [("26-45", 0.1 * i, 0.5, 1, 1) for i in range(5)]
    data += [("66+", 0.3 * i, 0.2 * i, int(i > 3), 0) for i in range(9)] + [("18-25", 0.2, 0.3, 1, 0), ("unknown", 9.0, 0.0, 0, None)]
    df = spark.createDataFrame(data, "apprx_age string, op_post_visit_ratio double, ip_post_visit_ratio double, long_covid int, hospitalized int")
    got = {r.subgroup: r for r in ev.logistic_odds(df).collect()}
    assert len(got) == 6
    assert got["Age (26-45)"].hosp_odds is None and got["Age (46-55)"].total_odds is None
    assert got["Age (66+)"].total_odds is not None and got["Age (66+)"].nonhosp_odds is None
    assert got["op_post_visit_ratio"].total_lower_ci < got["op_post_visit_ratio"].total_odds < got["op_post_visit_ratio"].total_upper_ci
    assert ev.logistic_odds(df.limit(0)).count() == 6
