"""Sets of days as bits: one row per key and 64-day word.

A day is bit (day mod 64) of word (day div 64), counted from 1970-01-01. Facts of a key and a word
become one 64-bit number by `bit_or`, which is pre-aggregated before any shuffle and counts a day
once however many facts it has. Spans become masks, so "days of A inside span B and outside C" is
`bit_count(a & b & ~c)`, summed over the few words of the span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL_BITS = -1


def word(day: Column | str) -> Column:
    return F.shiftright(F.unix_date(day), 6)


def bit(day: Column | str) -> Column:
    """The number whose only bit is the day's."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.unix_date(day), F.lit(64)))


def days_of(rows: DataFrame, key: str, day: str, **kinds: Column) -> DataFrame:
    """key, word and, for each kind, the days on which some row meets its condition."""
    return (rows.filter(F.col(day).isNotNull()).groupBy(key, word(day).alias("word"))
            .agg(*[F.bit_or(F.when(condition, bit(day)).otherwise(F.lit(0).cast("long"))).alias(name)
                   for name, condition in kinds.items()]))


def mask(number: Column, first: Column, last: Column) -> Column:
    """The bits of word `number` whose days lie in first..last."""
    one, full = F.lit(ALL_BITS).cast("long"), F.lit(64)
    above = F.unix_date(first) - number * full  # bits below this one are off
    below = number * full + 63 - F.unix_date(last)  # as many at the top are off
    from_first = F.when(above > 0, F.call_function("shiftleft", one, above)).otherwise(one)
    to_last = F.when(below > 0, F.call_function("shiftrightunsigned", one, below)).otherwise(one)
    return from_first.bitwiseAND(to_last)


def span_masks(spans: DataFrame, first: Column, last: Column, name: str = "mask") -> DataFrame:
    """The spans' rows with `word` and the mask of each word they touch; reversed or unbounded spans have none."""
    number = F.col("word")
    return (spans.filter(first <= last).withColumn("word", F.explode(F.sequence(word(first), word(last))))
            .withColumn(name, mask(number, first, last)))
