"""A training-data pipeline over ``documents``: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet
in the folder that all executors share and reads it again as the next one's documents.  The first four return the columns of
``documents``; the last returns the tokens of each document with their digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm.common import Scratch, table
from leafmill.llm.queries import public_vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    from leafmill.llm.quality import quality_filter

    return quality_filter(docs).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays whose shingles of five words are similar to 0.8 or more."""
    from leafmill.llm.shingles import keep_one_similar

    return keep_one_similar(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with too large a part inside benchmark passages go."""
    from leafmill.llm.decontam import decontaminate

    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; no document goes."""
    from leafmill.llm.credentials import redact_secrets

    return redact_secrets(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed token ids of each document, and digests of them and of what they decode to."""
    from leafmill.llm.bpe import decode, digests, encode

    vocabulary = public_vocabulary()
    coded = decode(encode(docs.select("doc_id", "lang", "source", "text"), vocabulary), vocabulary)
    return coded.select("doc_id", "lang", "source", "tokens", *digests())


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("secret scans", secrets), ("byte-level BPE", tokens)]

#: SQL expresses none of the last four stages; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; what a stage wrote goes once the next one has read it."""
    docs, tmp = table(spark, sf_dir, "documents"), Scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = tmp.table(str(i), stage(spark, docs, sf_dir))
        tmp.drop(*[str(i - 1)] if i else [])
    return docs
