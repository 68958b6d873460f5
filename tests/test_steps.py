"""Which steps of a flow are written, who shares them, and that nothing is left."""

import os
import shutil
from collections import Counter
from pathlib import Path

import pytest

from cohortloom import session
from cohortloom.plans import catalog, steps
from cohortloom.plans.steps import Flow, lease, reader_counts, step
from cohortloom.sources.star_adapter import StarTables

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


class Small(Flow):
    READS = {"doubled": ("base",), "total": ("base", "doubled")}

    def __init__(self, *, numbers, more=1):
        self.numbers, self.more = numbers, more

    @step
    def base(self):
        return self.numbers.selectExpr(f"n + {self.more} AS n")

    @step
    def doubled(self):
        return self.base.selectExpr("2 * n AS n")

    @step
    def total(self):
        return self.base.unionByName(self.doubled).selectExpr("sum(n) AS n")


@pytest.fixture
def new_files(spark):
    """Files in the shared folder that were not there before the test."""
    session.release(spark)
    root = Path(session.shared_folder(spark).removeprefix("file:"))
    before = set(root.rglob("*.parquet"))
    return lambda: set(root.rglob("*.parquet")) - before


def written(flow):
    return set(flow._shelf.written)


def test_readers_are_counted_from_the_targets():
    reads = {"a": ("b", "b"), "c": ("a", "d"), "d": ("b",)}
    assert reader_counts(reads, ["c"]) == Counter(c=1, a=1, d=1, b=3)
    assert reader_counts(reads, ["a", "d"]) == Counter(a=1, d=1, b=3)
    assert reader_counts(reads, ["x"]) == Counter(x=1)


def test_steps_with_two_readers_are_written_and_shared(spark, tmp_path, new_files):
    spark.range(5).selectExpr("id AS n").write.parquet(f"{tmp_path}/t")
    table = lambda: spark.read.parquet(f"{tmp_path}/t")
    assert Small(numbers=table()).total.first().n == 45 and not new_files()
    with lease(spark):
        one = Small.stored("doubled", numbers=table())
        assert one.doubled.count() == 5 and not written(one)
        with lease(spark):
            two = Small.stored("total", numbers=table())
            assert two.total.first().n == 45 and written(two) == {"base", "doubled"}  # asked for by both queries
        assert two._shelf is one._shelf and new_files()
        for path, _ in two._shelf.written.values():  # the shared folder is cleaned up by somebody else
            shutil.rmtree(path.removeprefix("file:"))
        assert Small.stored("total", numbers=table()).total.first().n == 45
        other = Small.stored("total", numbers=table(), more=2)
        assert other.total.first().n == 60 and other._shelf is not one._shelf
        spark.range(3).selectExpr("id AS n").write.mode("overwrite").parquet(f"{tmp_path}/t")
        anew = Small.stored("total", numbers=spark.read.parquet(f"{tmp_path}/t"))
        assert anew._shelf is not one._shelf and anew.total.first().n == 18
        filtered = Small.stored("total", numbers=table().filter("n > 0"))
        assert filtered._shelf is not anew._shelf
    assert not new_files() and not steps._shelves


@needs_tables
@pytest.mark.parametrize("build", ["anchored", "research", "rolling"])
def test_reads_name_what_steps_use(spark, build):
    flow = getattr(catalog, build)(StarTables(session.tune(spark), FOLDER))
    kind, stack, seen = type(flow), [], Counter()

    class Recorded(kind):
        def keep(self, name, make):
            stack.append(name)
            df = make()
            stack.pop()
            return df

        def __getattribute__(self, name):
            if stack and isinstance(getattr(kind, name, None), steps.cached_property):
                seen[stack[-1], name] += 1
            return super().__getattribute__(name)

    flow.__class__ = Recorded
    for name in [n for n in dir(kind) if isinstance(getattr(kind, n), steps.cached_property)]:
        getattr(flow, name)
    declared = Counter((s, r) for s, rs in kind.READS.items() for r in rs)
    for pair, n in seen.items():
        assert declared[pair] >= min(n, 1), pair
    assert {p for p in declared if p[0] not in ("labelled", "matrix")} == set(seen)


@needs_tables
@pytest.mark.parametrize("name", ["aligned_matrix", "covariance_select"])
def test_a_query_alone_takes_few_jobs_and_leaves_nothing(spark, new_files, name):
    context = spark.sparkContext
    with lease(spark):
        context.setJobGroup(f"jobs-{name}-{os.getpid()}", name)
        catalog.QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        jobs = len(context.statusTracker().getJobIdsForGroup(f"jobs-{name}-{os.getpid()}"))
        context.setJobGroup("", "")
    print(name, jobs, "jobs")
    assert not new_files()
