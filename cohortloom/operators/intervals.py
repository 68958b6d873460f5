"""Visit spans, episodes and everything that asks "does this date lie in that span?".

Two rules keep these operators flat when one person owns a large share of all rows:

* windows run only on rows first reduced to one per (person, day). A person has no more of
  those than there are days in the calendar, however many facts they own;
* joins between dates and spans use a day-bucket as second equi-key, so a person's rows are
  spread over buckets and a date only meets the spans that touch its own bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.constants import (
    EMERGENCY_TYPE, EPISODE_QUALIFYING_TYPES, INPATIENT_TYPES, OUTPATIENT_TYPE,
)
from cohortloom.functions.columns import flag
from cohortloom.operators.joins import stored_join

EPISODE_COLUMNS = ("macrovisit_id", "macrovisit_start_date", "macrovisit_end_date")


# ---------------------------------------------------------------- scaffold and merge
def scaffold_condition() -> Column:
    """Visits that may carry an episode: dated both ways, not reversed, and inpatient, or
    outpatient overnight, or emergency lasting into another day."""
    kind = F.col("visit_concept_id")
    days = F.datediff("visit_end_date", "visit_start_date")
    return (days >= 0) & (
        kind.isin(*INPATIENT_TYPES)
        | ((kind == OUTPATIENT_TYPE) & (days == 1))
        | ((kind == EMERGENCY_TYPE) & (days >= 1)))


def scaffold_filter(visits: DataFrame) -> DataFrame:
    return visits.filter(scaffold_condition())


def _number_islands(days: DataFrame, key: str, day: str, reach: str) -> DataFrame:
    """Add `island` (running number of islands) and `upto` (furthest end seen so far).

    `days` holds one row per (key, day); `reach` may be null on days that open no span. A
    new island opens where the day lies beyond every earlier end; touching spans merge."""
    ordered = Window.partitionBy(key).orderBy(day)
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (days
            .withColumn("_before", F.max(reach).over(earlier))
            .withColumn("_opens", flag(F.col(reach).isNotNull()
                                       & (F.col("_before").isNull() | (F.col(day) > F.col("_before")))))
            .withColumn("island", F.sum("_opens").over(so_far))
            .withColumn("upto", F.greatest("_before", reach))
            .drop("_before", "_opens"))


def merge_intervals(spans: DataFrame, key: str = "person_id", start: str = "visit_start_date",
                    end: str = "visit_end_date") -> DataFrame:
    """Merge overlapping or touching spans per key.

    -> key, group_number, macrovisit_start_date, macrovisit_end_date, macrovisit_id"""
    days = spans.groupBy(key, start).agg(F.max(end).alias("reach"))
    return (_number_islands(days, key, start, "reach")
            .groupBy(key, F.col("island").alias("group_number"))
            .agg(F.min(start).alias("macrovisit_start_date"), F.max("reach").alias("macrovisit_end_date"))
            .withColumn("macrovisit_id", _episode_id(key, "group_number")))


def _episode_id(key: str, number: str) -> Column:
    return F.concat_ws("_", F.col(key), F.col(number), F.date_format("macrovisit_start_date", "yyyyMMdd"))


# ---------------------------------------------------------------- date-in-span joins
BUCKET_MARGIN = 24  # buckets beyond the edges of nearly all spans

def _bucket(day: str, bits: int) -> Column:
    """Number of the 2**bits-day bucket a date falls in."""
    return F.shiftright(F.unix_date(F.col(day)), bits)


def _bucket_range(spans: DataFrame, start: str, end: str, bits: int) -> tuple[Column, Column]:
    """First and last bucket that are told apart; what lies before or after counts as in them.

    Any range gives the same join, as dates are compared in the end, so it is taken from the spans
    alone: a margin beyond nearly all of their starts and ends. A span without end, or one with a
    mistyped year, then costs a few rows, and the dated rows are read once, for the join only."""
    edges = spans.agg(F.percentile_approx(_bucket(end, bits), 0.05).alias("first_end"),
                      F.percentile_approx(_bucket(start, bits), 0.95).alias("last_start"))
    edges = edges.select((F.least("first_end", "last_start") - BUCKET_MARGIN).alias("low"),
                         (F.col("last_start") + BUCKET_MARGIN).alias("high"))
    return edges.select("low").scalar(), edges.select("high").scalar()


def _clip(bucket: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(bucket, low), high)


def interval_join(points: DataFrame, spans: DataFrame, date: str, start: str, end: str,
                  key: str = "person_id", how: str = "inner", bucket_bits: int = 6) -> DataFrame:
    """Join dated rows to the spans of the same key that contain the date (both ends in).

    how: inner, left, left_semi or left_anti. A missing date or bound matches nothing. Each
    pair meets in exactly one bucket, that of the date, so no pair is produced twice."""
    clash = [c for c in spans.columns if c in points.columns and c != key]
    if clash and how in ("inner", "left"):
        raise ValueError(f"columns on both sides: {clash}")
    spans = spans.filter(F.col(start) <= F.col(end))
    low, high = _bucket_range(spans, start, end, bucket_bits)
    s = (spans.withColumn("_bucket", F.explode(F.sequence(_clip(_bucket(start, bucket_bits), low, high),
                                                          _clip(_bucket(end, bucket_bits), low, high))))
         .withColumnRenamed(key, "_key").withColumnRenamed("_bucket", "_span_bucket"))
    if how in ("left_semi", "left_anti"):
        s = s.select("_key", "_span_bucket", F.col(start).alias("_lo"), F.col(end).alias("_hi"))
        lo, hi = "_lo", "_hi"
    else:
        lo, hi = start, end
    p = points.withColumn("_bucket", F.when(F.col(date).isNotNull(), _clip(_bucket(date, bucket_bits), low, high)))
    matched = ((F.col(key) == F.col("_key")) & (F.col("_bucket") == F.col("_span_bucket"))
               & F.col(date).between(F.col(lo), F.col(hi)))
    return p.join(s, matched, how).drop("_bucket", "_key", "_span_bucket")


# ---------------------------------------------------------------- visits to episodes
def map_visits_to_spans(visits: DataFrame, spans: DataFrame) -> DataFrame:
    """Every visit with the merged span its start lies in, or null (left join)."""
    return interval_join(visits, spans.select("person_id", *EPISODE_COLUMNS), "visit_start_date",
                         "macrovisit_start_date", "macrovisit_end_date", how="left")


def qualifying_episodes(mapped: DataFrame, types: tuple[int, ...] = EPISODE_QUALIFYING_TYPES) -> DataFrame:
    """Mapped visits of episodes with at least one visit of the given types."""
    ids = mapped.filter(F.col("visit_concept_id").isin(*types) & F.col("macrovisit_id").isNotNull()) \
        .select("macrovisit_id").distinct()
    return mapped.join(ids, "macrovisit_id", "left_semi")


def attach_episodes(visits: DataFrame, qualified: DataFrame) -> DataFrame:
    """All visits, with the qualified episode of each or nulls."""
    return visits.join(qualified.select("visit_occurrence_id", *EPISODE_COLUMNS), "visit_occurrence_id", "left")


def visits_with_episodes(visits: DataFrame, types: tuple[int, ...] = EPISODE_QUALIFYING_TYPES) -> DataFrame:
    """Scaffold, merge, map, qualify and re-attach in one pass.

    The same rows as the four steps above, but the span of each visit date is read off the
    running windows that build the spans: a visit lies in the current island exactly when its
    day is not beyond the furthest end so far. Visits are shuffled once, by (person, day)."""
    days = visits.filter(F.col("visit_start_date").isNotNull()).groupBy("person_id", "visit_start_date").agg(
        F.max(F.when(scaffold_condition(), F.col("visit_end_date"))).alias("reach"),
        F.max(flag(F.col("visit_concept_id").isin(*types))).alias("qualifies"))
    whole = Window.partitionBy("person_id", "island")
    episodes = (
        _number_islands(days, "person_id", "visit_start_date", "reach")
        .filter(F.col("visit_start_date") <= F.col("upto"))
        .select("person_id", "visit_start_date", "island",
                F.max("qualifies").over(whole).alias("qualifies"),
                F.min("visit_start_date").over(whole).alias("macrovisit_start_date"),
                F.max("reach").over(whole).alias("macrovisit_end_date"))
        .filter(F.col("qualifies") == 1)
        .withColumn("macrovisit_id", _episode_id("person_id", "island"))
        .select("person_id", "visit_start_date", *EPISODE_COLUMNS))
    return visits.join(episodes, ["person_id", "visit_start_date"], "left")


def episodes_of(visit_map: DataFrame) -> DataFrame:
    """Distinct episodes found in a visit-to-episode map."""
    return visit_map.filter(F.col("macrovisit_id").isNotNull()).select("person_id", *EPISODE_COLUMNS).distinct()


def episode_drilldown(visit_map: DataFrame, person_id: int, first: str, last: str) -> DataFrame:
    """The episode visits of one person between two dates, in date order."""
    day = F.col("visit_start_date")
    return (visit_map
            .filter((F.col("person_id") == person_id) & F.col("macrovisit_id").isNotNull()
                    & day.between(F.lit(first).cast("date"), F.lit(last).cast("date")))
            .select("visit_start_date", "visit_end_date", "visit_concept_name",
                    "macrovisit_start_date", "macrovisit_end_date")
            .distinct().orderBy("visit_start_date"))


# ---------------------------------------------------------------- facts to episodes
def link_by_visit(facts: DataFrame, visit_map: DataFrame) -> DataFrame:
    """Facts that name a visit, with that visit's episode (null outside any)."""
    return facts.join(visit_map.select("visit_occurrence_id", *EPISODE_COLUMNS), "visit_occurrence_id") \
        .select(*facts.columns, *EPISODE_COLUMNS)


def link_by_date(facts: DataFrame, visit_map: DataFrame, date: str) -> DataFrame:
    """Facts without a visit, placed by date into the person's episodes."""
    undated = facts.filter(F.col("visit_occurrence_id").isNull() & F.col(date).isNotNull())
    return interval_join(undated, episodes_of(visit_map), date, "macrovisit_start_date", "macrovisit_end_date")


def link_facts(facts: DataFrame, visit_map: DataFrame, date: str) -> DataFrame:
    """Both ways of linking, without duplicates (equal fact rows count once, whichever way).

    The two ways share no fact: one names a visit, the other does not. So each is made distinct by
    itself: for the first, rows lie by visit already and are not dealt anew; the second holds the few
    facts without a visit, and equal ones are reduced to one before they meet the episodes."""
    by_date = link_by_date(facts.filter(F.col("visit_occurrence_id").isNull()).distinct(), visit_map, date)
    return link_by_visit(facts, visit_map).distinct().unionByName(by_date)


# ---------------------------------------------------------------- blackout
def drop_blacked_out(facts: DataFrame, spans: DataFrame, date: str) -> DataFrame:
    """Remove facts dated inside any blackout span of their person; undated facts stay."""
    return interval_join(facts, spans, date, "blackout_begin", "blackout_end", how="left_anti")


def open_facts_of(persons: DataFrame, facts: DataFrame, spans: DataFrame, date: str) -> DataFrame:
    """Facts of the given persons outside their blackout spans, in one shuffle of the facts.

    Each person becomes one row holding their spans: infections lie more than 60 days apart,
    so the array is bounded by the calendar. One join on person then restricts the
    facts and brings the spans."""
    shut = spans.groupBy("person_id").agg(F.collect_list(F.struct("blackout_begin", "blackout_end")).alias("_shut"))
    people = persons.select("person_id").distinct().join(shut, "person_id", "left")
    day = F.col(date)
    hit = F.exists("_shut", lambda s: day.between(s["blackout_begin"], s["blackout_end"]))
    return stored_join(facts, people).filter(~F.coalesce(hit, F.lit(False))).select(*facts.columns)
