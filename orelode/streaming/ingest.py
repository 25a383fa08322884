"""Incremental ingest of documents into a chunk table: only new or changed sources, whole pages at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.operators.chunks import page_chunks
from orelode.sources.files import exists


def manifest_of(docs: DataFrame) -> DataFrame:
    """source, fingerprint from documents (source, text): the number of texts and the sum of their digests, so no source is gathered."""
    part = F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("decimal(28,0)")
    return docs.groupBy("source").agg(F.concat_ws(":", F.count("text").cast("string"), F.sum(part).cast("string")).alias("fingerprint"))


def changed(manifest: DataFrame, known: DataFrame) -> DataFrame:
    """Sources whose fingerprint isn't known."""
    return manifest.join(known, ["source", "fingerprint"], "left_anti")


class ChunkTable:
    """Chunks in a folder of Parquet, dealt into buckets by source. Writing pages replaces all that they had, so no stale chunk stays.

    A change rewrites the buckets of its sources only: they are written beside the table first, then put in place, so a
    change that breaks off can be made again.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64("source"), F.lit(self.buckets)).cast("int"))

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def _replace(self, rows: DataFrame, touched: list[int]) -> None:
        beside = f"{self.path}.staged"
        rows.write.mode("overwrite").parquet(beside)
        staged = self.spark.read.parquet(beside)
        left = {r.bucket for r in staged.select("bucket").distinct().collect()}
        staged.write.option("partitionOverwriteMode", "dynamic").partitionBy("bucket").mode("overwrite").parquet(self.path)
        for bucket in set(touched) - left:
            self._delete(f"{self.path}/bucket={bucket}")
        self._delete(beside)

    def exists(self) -> bool:
        return exists(self.spark, self.path)

    def read(self) -> DataFrame:
        return self.spark.read.option("basePath", self.path).parquet(self.path).drop("bucket")

    def upsert(self, chunks: DataFrame, pages: DataFrame | None = None) -> None:
        """Put chunks in place of those that their pages had; `pages` (source, page) names pages that may have none now."""
        pages = self._bucketed((chunks if pages is None else pages).select("source", "page").distinct())
        touched = [r.bucket for r in pages.select("bucket").distinct().collect()]
        rows = self._bucketed(chunks.dropDuplicates(["chunk_id"]))
        if self.exists():
            old = self.spark.read.parquet(self.path).where(F.col("bucket").isin(touched))
            rows = old.join(pages.select("source", "page"), ["source", "page"], "left_anti").unionByName(rows, allowMissingColumns=True)
        self._replace(rows, touched)

    def delete(self, sources: list[str]) -> None:
        """Remove all chunks of some sources."""
        gone = self._bucketed(self.spark.createDataFrame([(x,) for x in sources], "source string"))
        touched = [r.bucket for r in gone.select("bucket").distinct().collect()]
        old = self.spark.read.parquet(self.path).where(F.col("bucket").isin(touched))
        self._replace(old.join(gone.select("source"), "source", "left_anti"), touched)


def ingest_stream(spark: SparkSession, folder: str, schema, table: ChunkTable, checkpoint: str) -> None:
    """Take what is new in a folder of page files (source, page, text) and stop; a rerun takes only files added since."""
    pages = spark.readStream.schema(schema).parquet(folder)

    def put(batch: DataFrame, _: int) -> None:
        table.upsert(page_chunks(batch), batch)

    pages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
