"""Many logistic models of one predictor each, fitted together, with profile-likelihood limits.

All models share one table of sufficient counts: a row per model and distinct value of the predictor,
with the number of rows and of positives. Each Newton step of all models is one aggregate over it;
only a few sums per model come back. Limits solve two equations, the likelihood's maximum over the
intercept and a fall of half a chi-square quantile below the fit, by Newton steps of the same kind."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.session import materialise

NORMAL_975 = 1.959963984540054
HALF_CHI_SQUARE_95 = 1.920729410347062  # half the 95 % quantile with one degree of freedom
STEPS = 25
CLOSE = 1e-9  # of a step; the error left is about its square


def usable_models(counts: DataFrame) -> dict[str, tuple[float, float]]:
    """Rows and positives of each model that has a finite fit: both outcomes, and values of the
    predictor that overlap between them."""
    neg, pos = F.col("n") > F.col("y"), F.col("y") > 0
    found = counts.groupBy("model").agg(
        F.sum("n").alias("n"), F.sum("y").alias("y"),
        *[f(F.when(where, F.col("x"))).alias(name) for name, f, where in (
            ("low0", F.min, neg), ("high0", F.max, neg), ("low1", F.min, pos), ("high1", F.max, pos))])
    return {r.model: (r.n, r.y) for r in found.collect()
            if 0 < r.y < r.n and r.high0 > r.low1 and r.high1 > r.low0}


def _sums(counts: DataFrame, points: dict[tuple[str, str], tuple[float, float]]) -> dict[tuple[str, str], dict[str, float]]:
    """For points (model, name) -> (intercept, slope): log-likelihood, its gradient and the weights' moments."""
    spark = counts.sparkSession
    at = spark.createDataFrame([(*k, float(a), float(b)) for k, (a, b) in points.items()], "model string, point string, a double, b double")
    x, n, y = F.col("x"), F.col("n"), F.col("y")
    line = F.col("a") + F.col("b") * x
    chance = F.lit(1.0) / (F.lit(1.0) + F.exp(-line))
    weight, left = n * chance * (F.lit(1.0) - chance), y - n * chance
    soft = F.greatest(line, F.lit(0.0)) + F.log1p(F.exp(-F.abs(line)))
    rows = (counts.join(F.broadcast(at), "model").groupBy("model", "point").agg(  # a row per model and limit
        F.sum(y * line - n * soft).alias("ll"), F.sum(left).alias("g0"), F.sum(left * x).alias("g1"),
        F.sum(weight).alias("s0"), F.sum(weight * x).alias("s1"), F.sum(weight * x * x).alias("s2"))).collect()
    return {(r.model, r.point): r.asDict() for r in rows}


def _walk(counts: DataFrame, points: dict, step) -> dict:
    """Move all points until none moves; points that run away are left out."""
    for _ in range(STEPS):
        sums, moved = _sums(counts, points), 0.0
        for k, (a, b) in list(points.items()):
            d = step(k, sums[k])
            if d is None or not all(map(math.isfinite, d)):
                del points[k]
                continue
            points[k] = (a + d[0], b + d[1])
            moved = max(moved, abs(d[0]), abs(d[1]))
        if not points or moved < CLOSE:
            break
    return points


def odds_with_limits(counts: DataFrame) -> dict[str, tuple[float | None, float | None, float | None]]:
    """model -> (odds ratio, upper, lower limit) of the slope; None where it has no finite value.

    counts: model, x, n, y with a row per model and value."""
    counts = materialise(counts.select("model", "x", F.col("n").cast("double"), F.col("y").cast("double")), "logit-counts")
    models = usable_models(counts)

    def newton(_, s):
        d = s["s0"] * s["s2"] - s["s1"] ** 2
        return ((s["s2"] * s["g0"] - s["s1"] * s["g1"]) / d, (s["s0"] * s["g1"] - s["s1"] * s["g0"]) / d) if d > 0 else None

    fits = {(m, "fit"): (math.log(y / (n - y)), 0.0) for m, (n, y) in models.items()}
    fits = _walk(counts, fits, newton) if fits else {}
    best = _sums(counts, fits) if fits else {}
    target, limits = {}, {}
    for (m, _), s in best.items():
        error = math.sqrt(s["s0"] / (s["s0"] * s["s2"] - s["s1"] ** 2))
        a, b = fits[m, "fit"]
        for name, side in (("upper", 1), ("lower", -1)):
            away = side * NORMAL_975 * error
            limits[m, name] = (a - away * s["s1"] / s["s0"], b + away)
            target[m, name] = s["ll"] - HALF_CHI_SQUARE_95

    def fall(k, s):
        miss, d = s["ll"] - target[k], s["s1"] * s["g0"] - s["s0"] * s["g1"]
        return (-(s["g1"] * s["g0"] + s["s1"] * miss) / d, (s["g0"] ** 2 + s["s0"] * miss) / d) if d else None

    limits = _walk(counts, limits, fall) if limits else {}
    odds = lambda points, k: math.exp(min(points[k][1], 700.0)) if k in points else None
    return {m: (odds(fits, (m, "fit")), odds(limits, (m, "upper")), odds(limits, (m, "lower"))) for m in models}
