"""From raw documents to a mixed training corpus: five stages, each written before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rayloom.lineage import cleared, last_made, stored
from rayloom.llm import decontam, mixing, neardup, quality, secrets
from rayloom.llm.common import table

#: Jaccard, in hundredths, from which two documents are near copies in the pipeline; the query of op10 has its own.
NEAR_JACCARD = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return neardup.keep_one(docs, least=NEAR_JACCARD)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts."""
    return decontam.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by marks."""
    return secrets.redact_secrets(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus at its target weights: a row for each pass over a document, with ``epoch``."""
    return mixing.mix_corpus(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
]

#: The stages on words, shingles and indexes have no SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with cleared(spark) as kept:  # what the stage stored on its way isn't needed any more
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
            kept.append(last_made())
    return STAGES[-1][1](spark, docs, sf_dir)
