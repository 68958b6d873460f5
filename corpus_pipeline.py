"""The corpus pipeline over the documents.

Quality rules turn away bad texts, of near-duplicates one stays, repeated passages are cut from all
texts but the first, documents with benchmark items go, and the rest is packed into sequences.
Near duplicates are those of the SimHash operator: 3-word shingles, 3 differing bits or fewer."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cohortloom.llm import decontaminate, packing, quality_rules, simhash, suffix_dedup
from cohortloom.llm.common import read
from cohortloom.session import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.drop_repeats(docs)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("benchmark decontamination", benchmark_items),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what each keeps is stored and read by the next."""
    docs = read(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{n}")
    return docs


ORACLE_SQL = None  # the certified cutoffs, fingerprints and retrieval scores have no SQL form
