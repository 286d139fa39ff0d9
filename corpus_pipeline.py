"""The corpus pipeline: quality, near-duplicates, benchmark leaks, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as
Parquet to the shared folder and reads again for the next stage. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontam, mixing, pii, quality_model, simhash
from quern.llm.common import free_name, table, written


#: Jaccard similarity over five-word shingles from which documents are near-duplicates.
SIMILAR = 0.8
#: Differing bits of fingerprints up to which near-duplicates are searched in the whole corpus at once: eight routes of eight bits.
NEAR = 7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least ``quality_model.GOOD``."""
    model = quality_model.train(docs, table(spark, sf_dir, "labels"))
    scored = quality_model.score(docs, model, to=(to := free_name(docs, "quality_score")))
    return scored.filter(scored[to] >= quality_model.GOOD).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, Jaccard at least 0.8), that of the smallest id."""
    return simhash.deduplicated(docs, near=NEAR, similar=SIMILAR)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontam.cleaned(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix of sources takes, with ``mix_copies``."""
    return mixing.mixture(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("personal_data", personal_data), ("mix", mix)]

#: Trained trees and fingerprints of XXH64 can't be stated in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
