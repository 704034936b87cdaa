"""The training-corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Defined results: all stages keep documents without text or words, one of them after exact deduplication; rows of
repeated or null ids are documents of their own, told apart by their texts and, if these are equal, one is kept; columns
of any other name come through; empty tables give an empty corpus, and without labels the seed lexicon decides.

No SQL states the toxicity stage, whose model is learned from the rows at hand; tests/llm holds the pipeline against a
brute-force version instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import toxicity
from quillspark.llm.common import materialize, table
from quillspark.llm.decontaminate import decontaminate
from quillspark.llm.exact_dedup import deduplicate
from quillspark.llm.mixing import mix
from quillspark.llm.ngram_join import deduplicate_near

REJECT = 0.3  # toxicity scores from here on


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below REJECT."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_texts(docs, model)
    return scored.where(F.col(f"`{scored.columns[-1]}`") < REJECT).select(*[f"`{c}`" for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each group of equal texts."""
    return deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each component of documents with similar shingle sets."""
    return deduplicate_near(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
