"""The star-schema test tables presented as clinical tables.

Every view is a deterministic projection (plus one key join) of whole tables; dates are
moved by 25 years so that the calendar constants of the operators apply unchanged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHIFT_DAYS = 9131
GROUP_BASE, TYPE_BASE, INGREDIENT_BASE = 10_000_000, 20_000_000, 30_000_000


def _day(c: str) -> Column:
    return F.date_add(F.col(c).cast("date"), SHIFT_DAYS)


def _pick(key: Column, *pairs: tuple[object, object], other: object = None) -> Column:
    out = F.lit(other) if not isinstance(other, Column) else other
    for value, result in pairs:
        out = F.when(key == value, F.lit(result)).otherwise(out)
    return out


class StarTables:
    """Clinical views over one folder of star-schema parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._read: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]

    def person(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").select(
            key.alias("person_id"),
            (F.lit(1925) + key % 85).cast("int").alias("year_of_birth"),
            _pick(key % 10, (9, "No matching concept"), other=_pick(key % 2, (0, "FEMALE"), other="MALE"))
            .alias("gender_concept_name"),
            _pick(F.col("c_mktsegment"), ("AUTOMOBILE", "Chinese"), ("BUILDING", "Black or African American"),
                  ("FURNITURE", "White"), ("HOUSEHOLD", "Other Race"), other="No information")
            .alias("race_concept_name"),
            _pick(key % 3, (0, "Hispanic or Latino"), (1, "Not Hispanic or Latino"), other="No matching concept")
            .alias("ethnicity_concept_name"),
            F.col("c_nationkey").alias("data_partner_id"))

    def manifest(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_nationkey").alias("data_partner_id"), F.lit("2026-08-01").cast("date").alias("run_date"))

    def death(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").filter(key % 97 == 0).select(
            key.alias("person_id"),
            F.date_add(F.lit("2024-01-01").cast("date"), (key % 500).cast("int")).alias("death_date"))

    def visits(self) -> DataFrame:
        key = F.col("o_orderkey")
        start = _day("o_orderdate")
        return self.raw("orders").select(
            key.alias("visit_occurrence_id"), F.col("o_custkey").alias("person_id"),
            _pick(F.col("o_orderpriority"), ("1-URGENT", 9201), ("2-HIGH", 9203), ("3-MEDIUM", 9202),
                  other=581477).alias("visit_concept_id"),
            F.col("o_orderpriority").alias("visit_concept_name"),
            start.alias("visit_start_date"),
            F.when(key % 41 != 0, F.date_add(start, (key % 200).cast("int") - 2)).alias("visit_end_date"),
            F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(1)).alias("likely_hospitalization"))

    def with_site(self, df: DataFrame) -> DataFrame:
        """Add the site of each row's person."""
        return df.join(self.person().select("person_id", "data_partner_id"), "person_id")

    def _lines(self, flag: str | None = None) -> DataFrame:
        lines = self.raw("lineitem")
        if flag:
            lines = lines.filter(F.col("l_returnflag") == flag)
        orders = self.raw("orders").select(
            F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("person_id"), "o_orderdate")
        return (lines.join(orders, "l_orderkey")
                .withColumn("fact_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
                .withColumn("fact_date", F.date_add(_day("o_orderdate"), F.col("l_linenumber")))
                .withColumn("fact_visit", F.when(F.col("l_linestatus") != "O", F.col("l_orderkey"))))

    def conditions(self) -> DataFrame:
        part = F.col("l_partkey")
        return self._lines().select(
            F.col("fact_id").alias("condition_occurrence_id"), "person_id",
            _pick(part % 100, (1, 37311061), (2, 705076), (3, 36714927), other=part)
            .alias("condition_concept_id"),
            leaf_name(part).alias("condition_concept_name"),
            F.when(part % 333 == 5, F.lit("U09.9")).otherwise(F.concat(F.lit("S"), F.col("l_suppkey")))
            .alias("condition_source_value"),
            F.col("fact_date").alias("condition_start_date"),
            F.col("fact_visit").alias("visit_occurrence_id"))

    def drugs(self) -> DataFrame:
        return self._lines("N").select(
            "person_id", F.col("l_partkey").alias("drug_concept_id"),
            leaf_name(F.col("l_partkey")).alias("drug_concept_name"),
            F.col("fact_date").alias("drug_exposure_start_date"),
            F.col("fact_visit").alias("visit_occurrence_id"))

    def measurements(self) -> DataFrame:
        part = F.col("l_partkey")
        return self._lines("R").select(
            F.col("fact_id").alias("measurement_id"), "person_id",
            _pick(part % 10, (4, 706163), other=part).alias("measurement_concept_id"),
            _pick(F.col("l_suppkey") % 5, (0, 45884084), other=45878583).alias("value_as_concept_id"),
            F.col("fact_date").alias("measurement_date"),
            F.col("fact_visit").alias("visit_occurrence_id"),
            F.when(F.col("l_suppkey") % 7 != 0, F.col("l_quantity")).alias("harmonized_value_as_number"),
            (F.col("l_linenumber") % 2).alias("harmonized_unit_concept_id"))

    def procedures(self) -> DataFrame:
        return self._lines("A").select(
            F.col("fact_id").alias("procedure_occurrence_id"), "person_id",
            F.col("fact_date").alias("procedure_date"), F.col("fact_visit").alias("visit_occurrence_id"))

    def observations(self) -> DataFrame:
        kind = F.col("event_type")
        return self.raw("events").select(
            F.col("event_id").alias("observation_id"), F.col("user_id").alias("person_id"),
            _pick(kind, ("purchase", 2004207791), ("view", GROUP_BASE + 1), ("click", GROUP_BASE + 2),
                  ("signup", GROUP_BASE + 3), other=GROUP_BASE + 4).cast("long").alias("observation_concept_id"),
            kind.alias("observation_concept_name"),
            F.date_sub(F.col("ts").cast("date"), 500).alias("observation_date"))

    def fact_flags(self) -> DataFrame:
        """A dated row per order; each flag stands for a kind of order (status, priority, price band)."""
        status, priority, price = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_totalprice")
        kinds = {
            "PCR_AG_Pos": (status == "F") & priority.isin("1-URGENT", "2-HIGH"),
            "LL_COVID_diagnosis": (status == "O") & (priority == "1-URGENT") & (price >= 250_000),
            "PAX1_NIRMATRELVIR": (status == "P") & (price < 120_000),
            "PAX2_RITONAVIR": (status == "P") & (price >= 60_000) & (price < 150_000),
            "PAXLOVID": (status == "P") & (priority == "5-LOW") & (price >= 400_000),
            "REMDISIVIR": (priority == "3-MEDIUM") & (price >= 450_000),
            "LL_Long_COVID_diagnosis": (status == "F") & (priority == "5-LOW") & (price >= 400_000),
            "B94_8": (status == "O") & (priority == "5-LOW") & (price < 30_000),
            "LL_MISC": (priority == "4-NOT SPECIFIED") & (price < 40_000),
        }
        return self.raw("orders").select(
            F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("visit_occurrence_id"),
            _day("o_orderdate").alias("date"),
            *[F.when(kind, 1).otherwise(0).alias(name) for name, kind in kinds.items()])

    def _brand_no(self) -> Column:
        return F.substring("p_brand", 7, 4).cast("long")

    def _type_no(self) -> Column:
        return _pick(F.col("p_type"), ("ECONOMY", 1), ("LARGE", 2), ("MEDIUM", 3), ("PROMO", 4),
                     ("SMALL", 5), other=6).cast("long")

    def concepts(self) -> DataFrame:
        part = self.raw("part")
        key = F.col("p_partkey")

        def rows(df: DataFrame, cid: Column, name: Column, domain: object, vocab: str, cls: str) -> DataFrame:
            return df.select(cid.alias("concept_id"), name.alias("concept_name"),
                             (domain if isinstance(domain, Column) else F.lit(domain)).alias("domain_id"),
                             F.lit(vocab).alias("vocabulary_id"), F.lit(cls).alias("concept_class_id"),
                             F.lit("S").alias("standard_concept"))

        brands = part.select(self._brand_no().alias("b")).distinct()
        types = part.select(self._type_no().alias("t")).distinct()
        b, t = F.col("b"), F.col("t")
        leaves = rows(part, key, leaf_name(key),
                      _pick(key % 11, (0, "Drug"), other=_pick(key % 3, (0, "Observation"), other="Condition")),
                      "SNOMED", "Leaf")
        groups = rows(brands, b + GROUP_BASE,
                      F.concat(F.lit("group "), b, _pick(b % 10, (0, " finding"), other="")),
                      "Condition", "SNOMED", "Group")
        kinds = rows(types, t + TYPE_BASE,
                     _pick(t, (4, "Chronic disease"), (5, "Left side"), other=F.concat(F.lit("type "), t)),
                     "Condition", "SNOMED", "Type")
        ingredients = rows(brands, b + INGREDIENT_BASE, F.concat(F.lit("Ingredient-"), b),
                           "Drug", "RxNorm", "Ingredient")
        return leaves.unionByName(groups).unionByName(kinds).unionByName(ingredients)

    def closure(self) -> DataFrame:
        part = self.raw("part")
        key = F.col("p_partkey")

        def edges(df: DataFrame, anc: Column, des: Column, level: int) -> DataFrame:
            return df.select(anc.alias("ancestor_concept_id"), des.alias("descendant_concept_id"),
                             F.lit(level).alias("min_levels_of_separation"),
                             F.lit(level).alias("max_levels_of_separation"))

        brands = part.select(self._brand_no().alias("b")).distinct()
        types = part.select(self._type_no().alias("t")).distinct()
        parts = [edges(part, key, key, 0), edges(part, self._brand_no() + GROUP_BASE, key, 1),
                 edges(part, self._type_no() + TYPE_BASE, key, 2),
                 edges(part, self._brand_no() + INGREDIENT_BASE, key, 1)]
        for base in (GROUP_BASE, INGREDIENT_BASE):
            parts.append(edges(brands, F.col("b") + base, F.col("b") + base, 0))
        parts.append(edges(types, F.col("t") + TYPE_BASE, F.col("t") + TYPE_BASE, 0))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def concept_sets(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_brand").alias("concept_set_name"), F.col("p_partkey").alias("concept_id"),
            (F.col("p_size") >= 10).alias("is_most_recent_version"))

    def clinic_visits(self) -> DataFrame:
        """Clinic visits as dated rows per person."""
        return (self.observations().filter(F.col("observation_concept_id") == 2004207791)
                .select("person_id", F.col("observation_date").alias("long_covid_clinic_date")))

    def sequel_persons(self) -> DataFrame:
        """Persons known to have the outcome, with the first date (seeded on the key)."""
        key = F.col("c_custkey")
        return self.raw("customer").filter(key % 6 == 0).select(
            key.alias("person_id"),
            F.date_add(F.lit("2021-06-01").cast("date"), (key % 700).cast("int")).alias("min_long_covid_date"))


def leaf_name(key: Column) -> Column:
    return F.concat(F.lit("part "), key, _pick(key % 50, (7, " finding"), other=""))
