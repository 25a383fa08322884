"""Vector search under metadata filters, keyword rerank, and gathering over sets of queries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from orelode.functions.text import context_label, overlap


MOST_QUERIES = 4096  # that are sent to every task


def metadata_filter(sources=None, items=None, types=None) -> Column | None:
    """All given clauses together; items below 1 are left out, and a clause without values says nothing."""
    items = [i for i in items or [] if i > 0]
    clauses = [F.col(c).isin(list(v)) for c, v in (("source", sources), ("ni_item", items), ("type", types)) if v]
    return reduce(lambda a, b: a & b, clauses) if clauses else None


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v)


def over_fetch(k: int, count: int) -> int:
    return min(max(4 * k, k + 12), count)


def nearest(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """For each query (query_id, query) its k nearest chunks: query_id, dist, fetch_rank and all columns of chunks.

    chunks has id and embedding; chunks without one are never near. Up to MOST_QUERIES queries go to the tasks, which
    compare whole batches of vectors and pass on k rows of each query and those as far as the last of them. More queries
    meet the chunks by a cross join; then, too, only k rows of each leave a task. Both give the same.
    """
    few = queries.select("query_id", "query").limit(MOST_QUERIES + 1).collect()
    if len(few) > MOST_QUERIES:
        both = chunks.crossJoin(queries.select("query_id", "query"))
        both = both.withColumn("dist", squared_distance(F.col("embedding"), F.col("query"))).drop("query").where("dist is not null")
    else:
        both = _near_in_batches(chunks, few, queries.schema["query_id"].dataType, k)
    w = Window.partitionBy("query_id").orderBy("dist", "id")
    return both.withColumn("fetch_rank", F.row_number().over(w)).where(F.col("fetch_rank") <= k)


def _near_in_batches(chunks: DataFrame, queries: list, kind: T.DataType, k: int) -> DataFrame:
    ids, vectors = [q[0] for q in queries], np.array([q[1] for q in queries], dtype=np.float64)
    place, id_type = chunks.columns.index("embedding"), to_arrow_type(kind)
    schema = T.StructType([*chunks.schema.fields, T.StructField("query_id", kind), T.StructField("dist", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(place).is_valid())
            if not batch.num_rows or not ids:
                continue
            data = batch.column(place).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            rows, of, far = [], [], []
            for i, v in enumerate(vectors):
                d = np.square(data - v).sum(1)
                last = np.partition(d, k - 1)[k - 1] if k < len(d) else np.inf
                at = np.flatnonzero(d <= last)
                rows.append(at)
                of += [i] * len(at)
                far.append(d[at])
            out = batch.take(pa.array(np.concatenate(rows)))
            told = pa.array(ids, id_type).take(pa.array(of))
            yield pa.RecordBatch.from_arrays([*out.columns, told, pa.array(np.concatenate(far))], names=[*batch.schema.names, "query_id", "dist"])

    return chunks.mapInArrow(run, schema)


def reranked(hits: DataFrame, words: Column, k: int, by: str = "query_id") -> DataFrame:
    """The k best of each query by keyword overlap, tables two higher, then distance, then rank of the fetch."""
    score = overlap(F.col("text"), words) + F.when(F.col("type") == "table", 2).otherwise(0)
    w = Window.partitionBy(by).orderBy(F.desc("score"), "dist", "fetch_rank")
    return hits.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_seen(hits: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    return hits.withColumn("seen_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("seen_ = 1").drop("seen_")


def context(hits: DataFrame, by: str = "query_id") -> DataFrame:
    """The labelled texts of each query, in rank order, with blank lines between."""
    label = context_label(F.col("rank"), F.col("source"), F.col("ni_item"), F.col("section_title"), F.col("page"), F.col("text"))
    rows = hits.select(by, "rank", label.alias("part"))
    return rows.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "part"))), lambda x: x.part), "\n\n").alias("context"))


def relaxed(strict: DataFrame, loose: DataFrame, by: str = "query_id") -> DataFrame:
    """The strict hits of each query, or the loose ones if it has none."""
    return strict.unionByName(loose.join(strict.select(by).distinct(), by, "left_anti"), allowMissingColumns=True)
