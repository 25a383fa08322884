"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROOT = str(Path(__file__).resolve().parents[2])
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever the driver was started."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/.checkpoints"
    return base.rstrip("/")


def cut(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with tidied(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Inside, shuffle files go as soon as the query that made them has ended: what it wrote is all that is read again."""
    before = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(TIDY, before)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables written to the shared folder for one run. drop() and close() delete those that nothing will read again."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def cut(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        self.paths.setdefault(label, []).append(path)
        return cut(df, label, path)

    def drop(self, *labels: str, keep: int = 0) -> None:
        """Delete the tables of these labels, but for the last `keep` of each."""
        for label in labels:
            mine = self.paths.get(label, [])
            while len(mine) > keep:
                delete(self.spark, mine.pop(0))

    def close(self) -> None:
        self.drop(*self.paths)


def unused(names: list[str], *wanted: str) -> list[str]:
    """The wanted column names, each lengthened until it differs from all of `names` in any case."""
    taken, out = {n.lower() for n in names}, []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return out


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, UPPER.lower())


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
