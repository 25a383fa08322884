"""Exact deduplication against a persistent digest index, bucketed and sorted by digest.

Only built-in expressions run: the index is a bucketed table, new digests come from a sort-merge anti-join, and the
decision for each document is an equi-join with the index. Texts never take part in a shuffle here, their digests do.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.llm.common import Scratch, cut, text_or_empty, tidied, unused

BUCKETS = 64


class DigestIndex:
    """A table (digest, keep_id, group_size), bucketed and sorted by digest; one row for each text seen so far.

    digest is the SHA-256 of the text in UTF-8, keep_id the largest doc_id among the rows of the batch that brought the
    text first, group_size that batch's number of such rows. A hot digest is one row here, however often it occurs. The
    table is made empty if there is none of that name, so every batch is anti-joined with it.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.scratch = Scratch(spark)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, group_size BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame) -> None:
        """Add groups (digest, keep_id, group_size) whose digest the index lacks."""
        fresh = groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        with tidied(self.spark):
            fresh.select("digest", "keep_id", "group_size").repartition(self.buckets, "digest").write.insertInto(self.name)

    def drop(self) -> None:
        """Delete the index, and what batches have left in the shared folder."""
        self.scratch.close()
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def digests(self, docs: DataFrame) -> DataFrame:
        return self.scratch.cut(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.sha2(text_or_empty(), 256)).alias("digest")), "digests")

    def deduplicate(self, docs: DataFrame) -> DataFrame:
        """Judge a batch and append its new digests.

        Gives a row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, seen_before. Null text counts
        as empty. A text that an earlier batch brought has kept false throughout and keep_id of that batch. Within the
        batch the largest doc_id stays; a null doc_id stays only if all of its group are null. Rows that repeat both
        doc_id and text are one document and get the same decision. Long texts are read whole; an empty batch gives no rows.
        """
        batch = self.digests(docs)
        groups = grouped(batch)
        old = self.scratch.cut(groups.select("digest").join(self.read().select("digest").hint("merge"), "digest", "left_semi"), "seen")
        self.append(groups)
        seen = F.coalesce(F.col("seen"), F.lit(False))
        judged = batch.join(self.read(), "digest").join(old.select("digest", F.lit(True).alias("seen")), "digest", "left")
        return judged.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~seen).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), seen.alias("seen_before"))

    def deduplicate_whole(self, docs: DataFrame) -> DataFrame:
        """Judge a whole table in two batches, the larger half of the doc_ids first, through an index without its texts.

        As deduplicate(), but group_size counts both halves and nothing is seen before: the second half's texts that the
        index has go in favour of the larger doc_id there. Null doc_ids are in the second half.
        """
        batch = self.digests(docs)
        middle = batch.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
        late = F.coalesce(F.col("doc_id") >= F.lit(middle), F.lit(False))
        for half in (batch.where(late), batch.where(~late)):
            self.append(grouped(half))
        sizes = batch.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
        judged = batch.join(self.read().select("digest", "keep_id").hint("merge"), "digest").join(sizes, "digest")
        return judged.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def grouped(batch: DataFrame) -> DataFrame:
    return batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def keep_one_of_each(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The documents that stay, with all their columns as they were: of equal texts the row with the largest doc_id.

    Fully repeated (doc_id, text) rows leave one row. Null counts as empty. Texts that the index holds from earlier batches
    are left out; without an index one is made for this table and deleted again. An empty table stays empty, texts may
    have any length and columns any names.
    """
    own = index is None
    index = index or DigestIndex(docs.sparkSession)
    judged = index.deduplicate(docs.select("doc_id", "text")).where("kept")
    digest, win, times = unused(docs.columns, "digest", "win", "times")
    winners = cut(judged.groupBy("text_sha256").agg(F.max("doc_id").alias(win), F.count(F.lit(1)).alias(times))
                  .select(F.unhex("text_sha256").alias(digest), win, times), "winners")
    if own:
        index.drop()
    rows = (docs.withColumn(digest, F.unhex(F.sha2(text_or_empty(), 256))).join(winners, digest)
            .where(F.col("doc_id").cast("bigint").eqNullSafe(F.col(win))))
    once = rows.where(F.col(times) == 1).select(*docs.columns)
    again = rows.where(F.col(times) > 1).dropDuplicates([digest]).select(*docs.columns)
    return once.unionByName(again)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return DigestIndex(spark).deduplicate_whole(docs)


OP1_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
