"""Corpus pipeline: quality rules, near-duplicates, decontamination, personal data, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before kept.
Filters keep all columns of ``documents``; the last stage returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigil.llm import decontaminate, neardup, packing, pii, quality
from vigil.llm.common import materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base limits and the trees fitted to ``labels``."""
    return quality.filter_documents(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 0.8 of five-word shingles: the smallest id."""
    return neardup.drop_near_duplicates(docs, words=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of ``benchmark``."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data generalised or removed in ``text``."""
    return pii.sanitise(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most 2048 ids."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup),
          ("benchmark_decontamination", benchmark_decontamination), ("personal_data", personal_data), ("best_fit_packing", best_fit_packing)]
#: SQL has no fitted trees, MinHash or BPE; tests/llm hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
