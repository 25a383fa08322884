"""The corpus pipeline: language ID, exact dedup, near dedup, surrogates for personal data, packing.

Each stage takes (spark, docs, sf_dir), docs having the columns of `documents`, works on all that the stage before kept,
and returns the same columns, but for the last, which returns the packed pieces. Columns beside those, whatever their names,
pass through. Nulls in any column but text change nothing; empty tables stay empty; texts are read whole however long.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.llm import exact_dedup, langid, near_dedup, packing, pii
from orelode.llm.common import delete, shared_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language can be told.

    Null and empty texts and those without letters go; repeated rows stay or go together. If no row has a lang, none stays.
    """
    return langid.keep_identified(docs, langid.train(docs))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of equal texts the document with the largest doc_id; null counts as empty.

    Of rows that repeat doc_id and text one stays; a null doc_id stays only where all of its text have none.
    """
    return exact_dedup.keep_one_of_each(docs)


def near_deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of linked documents the one with the smallest doc_id.

    Null and empty texts are linked with nothing and stay; rows that repeat doc_id and text stay or go together.
    """
    return near_dedup.keep_one_of_each_group(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put surrogates for personal data into the texts; n_chars follows where it was known.

    Null and empty texts stay so; equal entities, in repeated rows too, have equal surrogates.
    """
    done = pii.pseudonymise(docs, counts=False)
    if "n_chars" not in docs.columns:
        return done
    return done.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of all texts into windows; a null or empty text is the end token alone, a repeated row a document of its own."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", deduplicate),
    ("near_dedup", near_deduplicate),
    ("pii", replace_personal_data),
    ("packing", pack),
]

ORACLE_SQL = None  # sketches, keyed surrogates and tokens have no SQL form; tests/llm compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder, read by the next and then deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    last = None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{base}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            delete(spark, last)
        last = path
    return docs
