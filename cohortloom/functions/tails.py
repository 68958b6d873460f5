"""Upper tails of the chi-square and F distributions as column expressions.

Regularised incomplete gamma and beta functions by continued fractions, folded over a sequence of
steps inside the JVM; the logarithm of the gamma function by Stirling's series after shifting its
argument up. Missing or impossible arguments give null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-300
SHIFT = 9


def _number(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def _one(x: float) -> Column:
    return F.lit(float(x))


def log_gamma(x: Column) -> Column:
    """For x > 0, to about 12 digits."""
    z = x + _one(SHIFT)
    series = sum((_one(c) / F.pow(z, _one(k)) for c, k in ((1 / 12, 1), (-1 / 360, 3), (1 / 1260, 5), (-1 / 1680, 7))), _one(0))
    shifted = sum((F.log(x + _one(k)) for k in range(SHIFT)), _one(0))
    return (z - _one(0.5)) * F.log(z) - z + _one(0.5 * math.log(2 * math.pi)) + series - shifted


def _away_from_zero(x: Column) -> Column:
    return F.when(F.abs(x) < TINY, _one(TINY)).otherwise(x)


def _fraction(start: Column, steps: Column, terms) -> Column:
    """A continued fraction by the modified Lentz method; terms(i) gives pairs (numerator, denominator)
    that step i adds in turn. `start` is the first denominator."""
    def one_step(state: Column, i: Column) -> Column:
        h, c, d = state["h"], state["c"], state["d"]
        for top, bottom in terms(i):
            d = _one(1) / _away_from_zero(bottom + top * d)
            c = _away_from_zero(bottom + top / c)
            h = h * c * d
        return F.struct(h.alias("h"), c.alias("c"), d.alias("d"))

    first = _away_from_zero(start)
    return F.aggregate(F.sequence(F.lit(1), steps.cast("int")), F.struct(first.alias("h"), first.alias("c"), _one(0).alias("d")),
                       one_step, lambda state: state["h"])


def chi_square_tail(x: Column | str, df: Column | str) -> Column:
    """P(X > x) with df degrees of freedom."""
    x, df = _number(x), _number(df)
    a, t = df / 2, x / 2
    front = F.exp(a * F.log(t) - t - log_gamma(a))
    steps = _one(60) + 12 * F.sqrt(F.greatest(a, t))
    low = F.aggregate(  # the series for small t: 1 - P
        F.sequence(F.lit(1), steps.cast("int")), F.struct((_one(1) / a).alias("s"), (_one(1) / a).alias("term")),
        lambda state, i: F.struct((state["s"] + state["term"] * t / (a + i)).alias("s"), (state["term"] * t / (a + i)).alias("term")),
        lambda state: state["s"])
    high = _one(1) / _fraction(t + 1 - a, steps, lambda i: [(i * (a - i), t + 1 - a + 2 * i)])
    return F.when((df > 0) & (x == 0), _one(1)).when((df > 0) & (x > 0), F.when(t < a + 1, _one(1) - front * low).otherwise(front * high))


def _beta_part(a: Column, b: Column, x: Column) -> Column:
    """I_x(a, b) for x below (a + 1) / (a + b + 2)."""
    front = F.exp(a * F.log(x) + b * F.log1p(-x) + log_gamma(a + b) - log_gamma(a) - log_gamma(b)) / a
    steps = _one(40) + 3 * F.sqrt(F.greatest(a, b))

    def terms(i: Column):
        m = i - 1
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        even = i * (b - i) * x / ((a + 2 * i - 1) * (a + 2 * i))
        return [(odd, _one(1)), (even, _one(1))]

    return front / _fraction(_one(1), steps, terms)


def f_tail(f: Column | str, df1: Column | str, df2: Column | str) -> Column:
    """P(F > f) with df1 and df2 degrees of freedom."""
    f, df1, df2 = _number(f), _number(df1), _number(df2)
    a, b = df2 / 2, df1 / 2
    x = 2 * a / (2 * a + 2 * b * f)
    lower = F.when(x < (a + 1) / (a + b + 2), _beta_part(a, b, x)).otherwise(_one(1) - _beta_part(b, a, _one(1) - x))
    sound = (df1 > 0) & (df2 > 0)
    return F.when(sound & (f == 0), _one(1)).when(sound & (f > 0), lower)
