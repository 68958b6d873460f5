"""Session settings the operators rely on, and the place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings only, so they can be applied to a session somebody else started.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot persons and hot concepts: split their shuffle partitions even where the
    # operator above the join then has to shuffle once more.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Stored tables are some 7 to 30 times smaller than their rows in memory, so that tens of millions of
    # rows would pass as small enough to broadcast; what is small indeed is broadcast by measured size.
    "spark.sql.sources.fileCompressionFactor": "16.0",
    # Pivoted matrices are a few hundred columns wide.
    "spark.sql.codegen.maxFields": "400",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "cohortloom", **settings: str) -> SparkSession:
    """Create (or fetch) a session with the runtime settings already in place."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**RUNTIME_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: `spark.checkpoint.dir`, else the context's own
    checkpoint folder; a temporary folder is made only where neither is set (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if not current:  # iterative fits cut their lineage there as well
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cohortloom-"))
    return spark.sparkContext.getCheckpointDir()


_stored: list[str] = []
_told: list[Callable[[], None]] = []


def on_release(forget: Callable[[], None]) -> None:
    """Have `forget` called when stored steps are removed."""
    _told.append(forget)


def remember(path: str) -> str:
    """Note a folder made for a step, for `release`."""
    _stored.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Remove the steps stored so far. For callers who have written or collected all results that
    read them; results not yet computed would miss their input."""
    for forget in _told:
        forget()
    context = spark.sparkContext
    while _stored:
        path = context._jvm.org.apache.hadoop.fs.Path(_stored.pop())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def write_step(df: DataFrame, name: str, partition_by: list[str] | None = None) -> str:
    """Write a step to the shared folder; its path."""
    path = remember(f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def is_there(spark: SparkSession, path: str) -> bool:
    """Whether a written step still exists; the shared folder may be cleaned up by others."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return path.getFileSystem(context._jsc.hadoopConfiguration()).exists(path)


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a step to the shared folder and read it back.

    The result has no lineage, so a lost executor costs a re-read and several consumers
    do not recompute the step."""
    return df.sparkSession.read.schema(df.schema).parquet(write_step(df, name, partition_by))
