"""Packed token-id matrices: best-fit-decreasing packing with a segment tree over capacities, written as Parquet.

A row of the matrix is `size` ids. Beside it stand the cumulative segment lengths, the positions, which start at 0 in each
segment, and where each segment comes from, so that the texts' ids can be put together again without loss.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.llm.common import shared_dir, text_or_empty, with_workers
from orelode.llm.tokens import batches_of, default_tokenizer, encoder

WINDOW, END, PAD = 1024, 0, 0
BLOCK = 4_000_000  # ids that are sorted and packed together
SHIFT = 40
ROWS = pa.schema([("sequence_id", pa.int64()), ("input_ids", pa.binary()), ("position_ids", pa.binary()),
                  ("cu_seqlens", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64()))])
DDL = "sequence_id bigint, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<bigint>, starts array<bigint>, doc_tokens array<bigint>"


class BestFit:
    """Bins of `size`. A segment tree over remaining capacities tells the smallest one that has a bin and is large enough."""

    def __init__(self, size: int):
        self.size = size
        self.leaves = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)  # number of bins below each node
        self.bins: list[list[list]] = [[] for _ in range(size + 1)]
        self.all: list[list] = []

    def _change(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.tree[node] += by
            node >>= 1

    def find(self, least: int) -> int:
        """The smallest capacity of at least `least` that some bin has, or -1."""
        tree, node = self.tree, self.leaves + least
        if tree[node]:
            return least
        while node > 1:
            if not node & 1 and tree[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return -1

    def add(self, item, length: int) -> None:
        capacity = self.find(length)
        if capacity < 0:
            capacity, content = self.size, []
            self.all.append(content)
        else:
            content = self.bins[capacity].pop()
            self._change(capacity, -1)
        content.append(item)
        if capacity > length:
            self.bins[capacity - length].append(content)
            self._change(capacity - length, 1)


def pack_block(docs: list[tuple], size: int) -> list[list[tuple]]:
    """Bins of (document, start, length) for documents (doc_id, ids); long ones are cut into windows and a rest."""
    items = []
    for doc in docs:
        n = len(doc[1])
        items += [(doc, start, min(size, n - start)) for start in range(0, n, size)]
    items.sort(key=lambda x: -x[2])  # stable: equal lengths stay in order
    fit = BestFit(size)
    for item in items:
        fit.add(item, item[2])
    return fit.all


def packed(docs: DataFrame, size: int = WINDOW, tokenizer: str | None = None, end: int = END, pad: int = PAD) -> DataFrame:
    """Rows of packed ids; 16-bit little-endian where the vocabulary allows, else 32-bit. Positions are 16- or 32-bit too.

    Null and empty texts are the end id alone, repeated rows are documents of their own, a null doc_id stays null, and an
    empty table gives no rows. Each task packs its own partition in blocks of BLOCK ids, so memory is bounded.
    """
    spark = with_workers(docs.sparkSession)
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, base = encoder(path), TaskContext.get().partitionId() << SHIFT
        kind, place = ("<u2" if enc.size <= 1 << 16 else "<u4"), ("<u2" if size <= 1 << 16 else "<u4")
        number = 0

        def rows(block: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            out: list[tuple] = []
            for content in pack_block(block, size):
                ids = np.full(size, pad, dtype=kind)
                positions = np.zeros(size, dtype=place)
                ends, at = [0], 0
                for doc, start, length in content:
                    ids[at : at + length] = doc[1][start : start + length]
                    positions[at : at + length] = np.arange(length)
                    at += length
                    ends.append(at)
                out.append((base | number, ids.tobytes(), positions.tobytes(), ends, [x[0][0] for x in content], [x[1] for x in content], [len(x[0][1]) for x in content]))
                number += 1
                if len(out) == 2048:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), ROWS, strict=True)], schema=ROWS)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), ROWS, strict=True)], schema=ROWS)

        block, held = [], 0
        for batch in batches:
            for part in batches_of(batch):
                for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode_many(part.column(1)), strict=True):
                    ids = np.frombuffer(ids, dtype="<u4").astype(kind)
                    block.append((doc_id, np.append(ids, np.array(end, dtype=kind))))
                    held += len(ids) + 1
                    if held >= BLOCK:
                        yield from rows(block)
                        block, held = [], 0
        yield from rows(block)

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, DDL)


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """Write the matrix and its index to a folder of Parquet files, zstd-compressed; any file system that Spark knows.

    Null, empty, long and repeated rows as in packed(); an empty table is a folder without rows.
    """
    packed(docs, **options).write.option("compression", "zstd").parquet(path)


def segments(matrix: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row for each segment of a written matrix, with the CRC-32 of its stored ids and whether its positions restart at 0.

    Widths of ids and positions are told by the rows themselves. Repeated rows and null doc_ids stay; an empty matrix has none.
    """
    n = F.size("doc_ids")
    each = F.explode(F.arrays_zip(
        F.col("doc_ids").alias("doc_id"), F.col("starts").alias("start"), F.col("doc_tokens").alias("doc_tokens"),
        F.slice("cu_seqlens", 1, n).alias("offset"), F.slice("cu_seqlens", F.lit(2), n).alias("stop"))).alias("s")
    width = F.expr(f"cast(length(input_ids) / {size} as int)")
    place = F.expr(f"cast(length(position_ids) / {size} as int)")
    rows = matrix.select("sequence_id", "input_ids", "position_ids", width.alias("width"), place.alias("place"), each)
    rows = rows.select("sequence_id", "input_ids", "position_ids", "width", "place", "s.*")
    return rows.select(
        "doc_id", "start", F.expr("cast(stop - offset as bigint)").alias("length"), "doc_tokens", "sequence_id",
        F.col("offset").cast("bigint").alias("offset"),
        F.expr("crc32(substring(input_ids, offset * width + 1, (stop - offset) * width))").alias("ids_crc32"),
        F.expr("hex(substring(position_ids, offset * place + 1, place)) = repeat('00', place)").alias("restarts"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = f"{shared_dir(spark)}/packed-{uuid.uuid4().hex}"
    write_packed(docs, path)
    return segments(spark.read.parquet(path))
