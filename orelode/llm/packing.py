"""Online packing of token sequences into windows by the sum-of-squares rule.

Each task packs the documents of its own partition as they come, so nothing is shuffled and a lost task is simply run
again with the same result. A document is cut only where it is longer than a window; its rest goes to the fill level for
which the sum of squared counts of partially filled windows becomes least. Those counts are one array indexed by level.
What is still open at the end of a partition is closed without padding: windows are topped up from the last ones, and the
very last is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from orelode.llm.common import text_or_empty, with_workers
from orelode.llm.tokens import batches_of, default_tokenizer, encoder

WINDOW, END = 1024, 0
SHIFT = 40  # sequence ids: partition << SHIFT | number
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
DDL = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class SumOfSquares:
    """Windows of `size`; add() places an item of 1 to size tokens and gives back the window that it filled, if any.

    counts[h] is the number of open windows filled to h. Moving one from h to h + s changes the sum of squares by
    2 * (counts[h + s] - counts[h]) + 2, and less if the window becomes full. Of equal choices the fullest window is
    taken. A window is a list of items.
    """

    def __init__(self, size: int):
        self.size = size
        self.counts = np.zeros(size + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(size + 1)]

    def add(self, item, length: int):
        n, c = self.size, self.counts
        if length == n:
            return [item]
        last = n - length  # the fullest level that has room
        levels = np.flatnonzero(c[1 : last + 1]) + 1
        after = 2 * c[length] + 1  # a new window
        level = 0
        if levels.size:
            change = 2 * (c[levels + length] - c[levels]) + 2
            if levels[-1] == last:
                change[-1] = 1 - 2 * c[last]
            best = change.size - 1 - int(np.argmin(change[::-1]))
            if change[best] <= after:
                level = int(levels[best])
        window = []
        if level:
            window = self.open[level].pop()
            c[level] -= 1
        window.append(item)
        if level + length == n:
            return window
        c[level + length] += 1
        self.open[level + length].append(window)
        return None

    def rest(self) -> Iterator[list]:
        """The open windows, the fullest first."""
        for level in range(self.size, 0, -1):
            yield from self.open[level]


def close(windows: list[list], size: int) -> Iterator[list]:
    """Recut the open windows so that each is full or has a power of two of tokens; items are (document, start, length)."""
    rest = []
    for w in windows:
        n = sum(x[2] for x in w)
        if n & (n - 1):
            rest.append(w)
        else:
            yield w
    flat = [x for w in rest for x in w]
    left = sum(x[2] for x in flat)
    at, used = 0, 0
    while left:
        room = size if left >= size else 1 << (left.bit_length() - 1)
        left -= room
        window = []
        while room:
            doc, start, length = flat[at]
            take = min(room, length - used)
            window.append((doc, start + used, take))
            room, used = room - take, used + take
            if used == length:
                at, used = at + 1, 0
        yield window


def pack_stream(docs: Iterator[tuple], size: int) -> Iterator[list]:
    """Windows of (document, start, length) from documents (doc_id, ids as 32-bit bytes)."""
    packer = SumOfSquares(size)
    for doc in docs:
        n = len(doc[1]) // 4
        whole = n - n % size
        for start in range(0, whole, size):
            yield [(doc, start, size)]
        if n > whole and (full := packer.add((doc, whole, n - whole), n - whole)):
            yield full
    yield from close(list(packer.rest()), size)


def pack(docs: DataFrame, size: int = WINDOW, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """Pack the texts of docs (doc_id, text); one row for each piece, with its sequence and place there.

    Null and empty texts are the end id alone. Every row of docs is a document of its own, also if it repeats; a null
    doc_id stays null. Other columns are not read. An empty table gives no rows.
    """
    spark = with_workers(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base = encoder(path).encode_many, TaskContext.get().partitionId() << SHIFT

        def texts():
            for batch in batches:
                for part in batches_of(batch):
                    for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1)), strict=True):
                        yield doc_id, ids + tail

        rows: list[tuple] = []
        for number, window in enumerate(pack_stream(texts(), size)):
            offset = 0
            for (doc_id, ids), start, length in window:
                rows.append((doc_id, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), len(ids) // 4, base | number, offset))
                offset += length
            if len(rows) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, DDL)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
