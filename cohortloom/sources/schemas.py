"""Explicit schemas of the clinical inputs; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(spec: str) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "str": T.StringType(),
             "date": T.DateType(), "dbl": T.DoubleType(), "bool": T.BooleanType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (f.split(":") for f in spec.split())])


TABLES: dict[str, T.StructType] = {
    "person": _schema(
        "person_id:long year_of_birth:int gender_concept_name:str race_concept_name:str "
        "ethnicity_concept_name:str data_partner_id:int"),
    "manifest": _schema("data_partner_id:int run_date:date"),
    "death": _schema("person_id:long death_date:date"),
    "visit_occurrence": _schema(
        "visit_occurrence_id:long person_id:long visit_concept_id:int visit_concept_name:str "
        "visit_start_date:date visit_end_date:date likely_hospitalization:int"),
    "condition_occurrence": _schema(
        "condition_occurrence_id:long person_id:long condition_concept_id:long condition_concept_name:str "
        "condition_source_value:str condition_start_date:date visit_occurrence_id:long data_partner_id:int"),
    "measurement": _schema(
        "measurement_id:long person_id:long measurement_concept_id:long value_as_concept_id:long "
        "measurement_date:date visit_occurrence_id:long harmonized_value_as_number:dbl "
        "harmonized_unit_concept_id:int data_partner_id:int"),
    "procedure_occurrence": _schema(
        "procedure_occurrence_id:long person_id:long procedure_date:date visit_occurrence_id:long"),
    "drug_exposure": _schema(
        "person_id:long drug_concept_id:long drug_concept_name:str drug_exposure_start_date:date "
        "visit_occurrence_id:long"),
    "observation": _schema(
        "observation_id:long person_id:long observation_concept_id:long observation_concept_name:str "
        "observation_date:date"),
    "concept": _schema(
        "concept_id:long concept_name:str domain_id:str vocabulary_id:str concept_class_id:str "
        "standard_concept:str"),
    "concept_ancestor": _schema(
        "ancestor_concept_id:long descendant_concept_id:long min_levels_of_separation:int "
        "max_levels_of_separation:int"),
    "concept_set_members": _schema("concept_set_name:str concept_id:long is_most_recent_version:bool"),
}


def dates_only(df: DataFrame) -> DataFrame:
    """Cast timestamp columns to dates at the boundary."""
    return df.select(*[
        F.col(f.name).cast("date").alias(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) else F.col(f.name)
        for f in df.schema.fields])
