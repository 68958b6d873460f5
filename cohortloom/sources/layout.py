"""Facts laid out by person, so that joins and aggregates by person need no shuffle of them.

A table is stored twice over: persons of ordinary size bucketed and sorted by person, one file a
bucket, and the few who own more than a bucket's share of all rows apart from them, in files of even
size. Whatever is worked out person by person can be applied to both parts and united: the first runs
on bucketed scans without an exchange of the facts, the second goes through Spark's usual joins,
where adaptive execution splits a person's rows over tasks."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom import session

HOT_SHARE = 1.0  # of the rows of an average bucket, beyond which a person's rows are stored apart

_tables: list[tuple[SparkSession, str]] = []


def _drop_tables() -> None:
    while _tables:
        spark, name = _tables.pop()
        spark.sql(f"DROP TABLE IF EXISTS {name}")


session.on_release(_drop_tables)


@dataclass
class ByPerson:
    """`bucketed` holds most persons, `apart` the large ones (None where there are none)."""

    bucketed: DataFrame
    apart: DataFrame | None
    key: str

    def each(self, operate: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """`operate` of the whole table, for operators that treat every person on their own."""
        out = operate(self.bucketed)
        return out if self.apart is None else out.unionByName(operate(self.apart))

    def whole(self) -> DataFrame:
        return self.each(lambda part: part)


def store_by_person(facts: DataFrame, name: str, key: str = "person_id", buckets: int | None = None) -> ByPerson:
    """Store facts by person in the shared folder, removed with the other steps by `session.release`.

    Buckets: as many as shuffle partitions unless given; for large tables choose it so that a bucket
    fits a task. Persons are counted exactly, with sums in the tasks first; fewer than `buckets` of
    them can own more than a bucket's share. Rows without a key are stored apart too."""
    spark = facts.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = session.materialise(facts.groupBy(key).agg(F.count("*").alias("n")), "persons")
    share = HOT_SHARE * (sizes.agg(F.sum("n")).head()[0] or 0) / buckets
    large = sizes.filter(F.col(key).isNull() | (F.col("n") > share)).select(F.col(key).alias("_key"))
    is_large = F.col(key).eqNullSafe(F.col("_key"))
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = session.remember(f"{session.shared_folder(spark).rstrip('/')}/{table}")
    few = facts.join(F.broadcast(large), is_large, "left_anti")  # broadcast: fewer rows than buckets
    (few.repartition(buckets, key).write.option("path", path).bucketBy(buckets, key).sortBy(key)
     .format("parquet").saveAsTable(table))
    _tables.append((spark, table))
    apart = None if large.isEmpty() else session.materialise(facts.join(F.broadcast(large), is_large, "left_semi"), f"{name}-apart")
    return ByPerson(spark.table(table), apart, key)


def exchanges_over(df: DataFrame, table_path: str) -> list[str]:
    """Operators of the executed plan that deal out rows read from a path before any aggregate or
    join has used them; empty where the layout saves the shuffle. For tests and tuning."""
    plan = df._jdf.queryExecution().executedPlan()
    found: list[str] = []

    def walk(node, exchanges: tuple[str, ...]):
        name = node.nodeName()
        children = node.children()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan(), exchanges)
        if name.endswith("QueryStage"):
            return walk(node.plan(), exchanges)
        if "Exchange" in name:
            exchanges += (name,)
        elif "Join" in name or "Aggregate" in name:
            exchanges = ()
        if children.size() == 0 and "Scan" in name and table_path in node.toString():
            found.extend(exchanges)
        for i in range(children.size()):
            walk(children.apply(i), exchanges)

    walk(plan, ())
    return found
