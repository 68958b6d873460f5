"""Calendar windows, windows round an index date, and the person-by-window grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.constants import POST_WINDOW_DAYS, PRE_WINDOW_DAYS, RESEARCH_POST_DAYS

GRID_ROWS_A_TASK = 1_000_000  # of the person-by-window grid, about; a sort of so many takes some 100 MB


def calendar_windows(spark: SparkSession, start: tuple[int, int], end: tuple[int, int],
                     length: int = 100) -> DataFrame:
    """One window per month from `start` up to but excluding `end`, each (year, month).

    -> window_name, window_start (first of the month), window_end (start + length, inclusive)"""
    months = (end[0] - start[0]) * 12 + end[1] - start[1]
    first = F.lit(f"{start[0]:04d}-{start[1]:02d}-01").cast("date")
    return (spark.range(max(months, 0))
            .select(F.col("id").cast("int").alias("window_name"))
            .withColumn("window_start", F.add_months(first, F.col("window_name")))
            .withColumn("window_end", F.date_add("window_start", length)))


def window_days(windows: DataFrame) -> DataFrame:
    """Windows laid out by day: (day, window). Turns "date inside window" into an equi-join
    against a table no larger than windows x days per window."""
    return windows.select(
        F.explode(F.sequence("window_start", "window_end")).alias("day"), F.col("window_name").alias("window"))


def person_window_grid(persons: DataFrame, index: DataFrame, windows: DataFrame, min_age: int = 18,
                       max_age: int = 100) -> DataFrame:
    """Every indexed person in every window in which their age is in [min_age, max_age).

    A person is laid out by the years of that age, one row each, and meets the windows that
    start in the year: an equi-join with a small table and no bound on the number of windows.
    Persons are dealt to so many tasks that none lays out more than about GRID_ROWS_A_TASK rows: by
    their own size, before they are laid out, a task could hold millions of them.

    -> person_id, sex, window, window_age"""
    tasks = max(1, -(-persons.count() * windows.count() // GRID_ROWS_A_TASK))
    people = persons.join(index.select("person_id").distinct(), "person_id", "left_semi").repartition(tasks, "person_id")
    born = F.col("year_of_birth")
    years = people.filter(F.lit(max_age > min_age)).select(
        "person_id", F.col("gender_concept_name").alias("sex"), "year_of_birth",
        F.explode(F.sequence(born + min_age, born + max(max_age - 1, min_age))).alias("_year"))
    starts = windows.select(F.col("window_name").alias("window"), F.year("window_start").alias("_year"))
    return years.join(starts, "_year").select("person_id", "sex", "window",
                                              (F.col("_year") - born).alias("window_age"))


def pre_post_windows(cohort: DataFrame, index: str = "min_covid_dt", run_date: str = "run_date") -> DataFrame:
    """Observation windows before and after the index date; the later one stops at the
    site's refresh date."""
    d = F.col(index)
    return (cohort
            .withColumn("pre_window_start_dt", F.date_add(d, PRE_WINDOW_DAYS[0]))
            .withColumn("pre_window_end_dt", F.date_add(d, PRE_WINDOW_DAYS[1]))
            .withColumn("post_window_start_dt", F.date_add(d, POST_WINDOW_DAYS[0]))
            .withColumn("post_window_end_dt",
                        F.when(F.date_add(d, POST_WINDOW_DAYS[1]) < F.col(run_date),
                               F.date_add(d, POST_WINDOW_DAYS[1])).otherwise(F.col(run_date))))


def clinic_ended_windows(cohort: DataFrame, index: str = "min_covid_dt",
                         clinic: str = "first_LC_clin_dt") -> DataFrame:
    """The research variant: the later window ends the day before the first clinic visit, a
    year after the index for persons without one, and never before it starts."""
    d, c = F.col(index), F.col(clinic)
    opening = F.date_add(d, RESEARCH_POST_DAYS[0])
    return (cohort
            .withColumn("pre_window_start_dt", F.date_add(d, PRE_WINDOW_DAYS[0]))
            .withColumn("pre_window_end_dt", F.date_add(d, PRE_WINDOW_DAYS[1]))
            .withColumn("post_window_start_dt", opening)
            .withColumn("post_window_end_dt",
                        F.when(c < opening, opening)
                        .otherwise(F.coalesce(F.date_add(c, -1), F.date_add(d, RESEARCH_POST_DAYS[1]))))
            .withColumn("patient_type", F.when(c.isNotNull(), "TRAINING").otherwise("TEST")))


def pre_post_pair() -> Column:
    """The two windows of a person's row as an array of (span, span_start, span_end); span is 'pre' or 'post'."""
    return F.array(*[F.struct(F.lit(k).alias("span"), F.col(f"{k}_window_start_dt").alias("span_start"),
                              F.col(f"{k}_window_end_dt").alias("span_end")) for k in ("pre", "post")])


def pre_post_spans(cohort: DataFrame) -> DataFrame:
    """The two windows of each person as rows: person_id, span ('pre'/'post'), span_start, span_end."""
    return cohort.select("person_id", F.inline(pre_post_pair()))
