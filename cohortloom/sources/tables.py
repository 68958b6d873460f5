"""Reading inputs, storing steps, vocabulary files, feature lists and model artifacts."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.constants import MODEL_FEATURES
from cohortloom.sources.schemas import TABLES, dates_only


def read_table(spark: SparkSession, name: str, folder: str | None = None) -> DataFrame:
    """A clinical table by name: parquet below `folder`, else from the catalogue."""
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet") if folder else spark.table(name)
    return dates_only(df)


def store_table(df: DataFrame, name: str, folder: str | None = None,
                partition_by: list[str] | None = None, mode: str = "overwrite") -> DataFrame:
    """Store a step under a name and return it as read back."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if folder is None:
        writer.saveAsTable(name)
        return df.sparkSession.table(name)
    path = f"{folder.rstrip('/')}/{name}.parquet"
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def read_concepts_csv(spark: SparkSession, path: str, **constants: str) -> DataFrame:
    """Vocabulary file; columns left out of it to save room are added as constants."""
    wanted = TABLES["concept"]
    present = [f for f in wanted.fields if f.name not in constants]
    df = spark.read.csv(path, header=True, schema=type(wanted)(present))
    for name, value in constants.items():
        df = df.withColumn(name, F.lit(value))
    return df.select(*wanted.fieldNames())


def read_closure_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=TABLES["concept_ancestor"])


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """Label map file: condition name and its label; labels are trimmed, EXCLUDE stays."""
    rows = spark.read.csv(path, header=True, schema="condition_concept_name string, high_level_condition string")
    return rows.withColumn("high_level_condition", F.trim("high_level_condition"))


def read_feature_list(spark: SparkSession, path: str | None = None) -> list[str]:
    """Feature names, one per line; without a path, those of the pre-trained model."""
    if path is None:
        return list(MODEL_FEATURES)
    return [r["value"] for r in spark.read.text(path).select(F.trim("value").alias("value"))
            .filter(F.length("value") > 0).collect()]


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
