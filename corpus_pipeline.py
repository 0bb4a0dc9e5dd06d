"""The corpus pipeline: its stages in order, each over all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import mixing, ngram_join, packing, pii, toxicity
from tickloom.llm.common import stored, table


# Every stage but the last returns the columns of its documents, whatever they are called and whatever else stands beside the
# five of the table. Nulls, empty and very long texts, repeated rows and empty tables have the results that each states.


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects (score 0.5 or more) go.

    Null and empty texts have no sign of toxicity and stay; rows without doc_id are judged by their text; repeated rows go or
    stay together; an empty table stays empty.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link by shingles, the one with the smallest doc_id stays.

    Null and empty texts link with nothing and stay, as do rows without doc_id and repeated rows of the smallest doc_id; of
    different texts under one doc_id each is judged by its own group; an empty table stays empty.
    """
    return ngram_join.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes its kind in brackets; every row stays.

    Null and empty texts are as before; repeated rows and rows without doc_id are masked alike; n_chars follows the text.
    """
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Domains, languages and sources by their target weights; three quarters of the tokens at hand, two epochs at most.

    Null languages and sources are leaves of their own; null and empty texts hold no tokens and are not taken; repeated rows and
    rows without doc_id are taken one by one; an empty table stays empty.
    """
    return mixing.mixture(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids: a row a piece.

    Null and empty texts are one id; repeated rows and rows without doc_id are packed each on their own; an empty table gives no
    rows.
    """
    return packing.pack(docs)


#: Bytes of the batches that Python tasks are given: texts are long, and as many stand in an executor's direct memory.
BATCH = "2m"
#: How Python workers allocate: what they free goes back to the system, and not to pools that they keep from stage to stage.
WORKERS = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "4194304"}


def _in_little_memory(stage: Callable) -> Callable:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
        for name, value in WORKERS.items():
            spark.sparkContext.environment.setdefault(name, value)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("toxicity", _in_little_memory(drop_toxic)),
    ("ngram_join", _in_little_memory(keep_one_of_each_group)),
    ("pii", _in_little_memory(mask_personal_data)),
    ("mixing", _in_little_memory(mix_sources)),
    ("packing", _in_little_memory(pack_sequences)),
]
#: Tokenizers, trees and components have no SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
