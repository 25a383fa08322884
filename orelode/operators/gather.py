"""Gathering of context over catalogues of queries: topics, items, and filtered variants with an unfiltered one behind them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orelode.functions.text import context_label, keywords, truncated
from orelode.operators import retrieval

KEY = ["source", "page", "chunk"]


def of_item(item: str = "item", tag: str = "ni_item"):
    """Whether a chunk's tag is that item, or it has none."""
    return F.coalesce(F.col(tag), F.lit(0)).isin(0) | (F.col(tag) == F.col(item))


def per_file(chunks: DataFrame, queries: DataFrame, k: int, stop: list[str] = ()) -> DataFrame:
    """For every source of chunks, as `file`, the k best of its chunks for each query (query_id, question, query, ...).

    Chunks meet queries of their own source's copy of the catalogue only; nearest ones are reranked by the question's words.
    """
    names = [c for c in queries.columns if c not in ("query", "question", "query_id")]
    asked = queries.select("query_id", "query", F.struct(*names, keywords(F.col("question"), list(stop)).alias("words"), "question").alias("asked"))
    hits = chunks.crossJoin(asked).withColumn("dist", retrieval.squared_distance(F.col("embedding"), F.col("query"))).drop("query")
    w = Window.partitionBy("source", "query_id").orderBy("dist", "id")
    hits = hits.withColumn("fetch_rank", F.row_number().over(w)).where(F.col("fetch_rank") <= retrieval.over_fetch(k, 2**31))
    best = retrieval.reranked(hits.withColumn("by_", F.struct("source", "query_id")), F.col("asked.words"), k, "by_").drop("by_")
    return best.select(*(c for c in best.columns if c != "asked"), F.col("source").alias("file"), "asked.question", *(F.col(f"asked.{n}").alias(n) for n in names))


def blocks(hits: DataFrame, order: list[str], heading: str, most: int | None = None, marker: str = "\n… [context truncated]") -> DataFrame:
    """file, context: the chunks that each file's hits (file, block, rank, ...) find first, under a heading for each block.

    `order` puts hits in order within a file; a chunk counts where it comes first. Blocks that are left empty are not named.
    """
    seen = retrieval.first_seen(hits, ["file", *KEY], order)
    label = context_label(F.col("rank"), F.col("source"), F.col("ni_item"), F.col("section_title"), F.col("page"), F.col("text"))
    place = F.row_number().over(Window.partitionBy("file").orderBy(*order))
    rows = seen.select("file", "block_ord", F.col(heading).alias("name"), place.alias("place"), label.alias("part"))
    listed = lambda key, part: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, part))), lambda x: x[part]), "\n\n")
    each = rows.groupBy("file", "block_ord", "name").agg(listed("place", "part").alias("parts"))
    each = each.select("file", "block_ord", F.concat(F.lit("### Context for: "), "name", F.lit("\n"), "parts").alias("block"))
    whole = each.groupBy("file").agg(listed("block_ord", "block").alias("context"))
    return whole if most is None else whole.withColumn("context", truncated(F.col("context"), most, marker))


def for_topics(chunks: DataFrame, catalogue: DataFrame, k: int = 12, stop: list[str] = ()) -> DataFrame:
    """file, context over a catalogue (query_id, block_ord, topic, item, query_ord, question, query) for every source of chunks.

    Rows with an item take chunks of that item or without one, of the k that the query finds in the file; the block's name
    then is "Item n". Chunks are deduplicated over the whole catalogue, in its order.
    """
    best = per_file(chunks, catalogue, k, stop).where(F.col("item").isNull() | of_item())
    named = best.withColumn("name_", F.coalesce(F.concat(F.lit("Item "), F.col("item").cast("string")), "topic"))
    return blocks(named, ["block_ord", "query_ord", "rank"], "name_")


def with_variants(chunks: DataFrame, queries: DataFrame, k: int = 12, types: list[str] = (), items: list[int] = (), most: int = 100_000) -> DataFrame:
    """file, context: each query (query_id, block_ord, question, query) under the given filters first, then without; cut at `most` characters."""
    clauses = [c for c in (retrieval.metadata_filter(types=list(types)), retrieval.metadata_filter(items=list(items))) if c is not None]
    parts = [per_file(chunks.where(c), queries, k).withColumn("turn", F.lit(i)) for i, c in enumerate([*clauses, F.lit(True)])]
    return blocks(reduce(DataFrame.unionByName, parts), ["block_ord", "turn", "rank"], "question", most)


def distinct_queries(queries: DataFrame) -> DataFrame:
    """Each question once, with the ids that ask it, so that it is embedded once."""
    return queries.groupBy("question").agg(F.sort_array(F.collect_list("query_id")).alias("query_ids"))


def gallery(sources: DataFrame, most: int = 8) -> DataFrame:
    """The first `most` sources of each answer (id, pos, source, page), on pages from 1."""
    first = sources.where("page >= 1").withColumn("r_", F.row_number().over(Window.partitionBy("id").orderBy("pos")))
    return first.where(F.col("r_") <= most).drop("r_")
