"""Removal of long byte strings that occur more than once, by suffix arrays built in two stages.

Equal strings of `length` bytes have equal smallest hashed anchors, so windows are dealt by anchor: maximal runs of windows
with one anchor in one place are segments, and only segments whose anchor occurs elsewhere are sorted at all. Equal segments count once.
Each task puts the segments of many anchors into one text, sorts its suffixes (directly only those smaller than their
successors, the rest by scanning the buckets), and compares neighbours in that order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.llm.common import Scratch, cut, text_or_empty, tidied, with_workers

LENGTH, ANCHOR = 400, 48
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE2 = np.uint64(0xC2B2AE3D27D4EB4F | 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse, for i up to n at least."""
    key = int(base)
    if key not in _powers or len(_powers[key][0]) < n:
        n = max(n, 1 << 16)
        inverse = np.uint64(pow(key, -1, 2**64))
        up, down = np.full(n, base), np.full(n, inverse)
        up[0] = down[0] = 1
        _powers[key] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[key]


def sums(data: np.ndarray, base: np.uint64) -> np.ndarray:
    """Prefix sums from which the hash of any part follows: see part_hash()."""
    up, _ = _power(base, len(data))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def part_hash(total: np.ndarray, base: np.uint64, start, stop) -> np.ndarray:
    _, down = _power(base, len(total))
    return (total[stop] - total[start]) * down[start]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def window_keys(data: np.ndarray, total: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """For each start of `length` bytes the smallest hash of its `anchor`-byte parts, and whether its first part is that."""
    at = np.arange(len(data) - anchor + 1)
    hashed = _mixed(part_hash(total, BASE, at, at + anchor))
    keys = sliding_min(hashed, length - anchor + 1)
    return keys, hashed[: len(keys)] == keys


def segments_of(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """(text number, first window, windows, key, two hashes of the bytes) for the texts data[bounds[i]:bounds[i + 1]]."""
    total, total2 = sums(data, BASE), sums(data, BASE2)
    keys, leaves = window_keys(data, total, length, anchor) if len(data) >= length else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool))
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(keys)]
    inside = np.arange(len(keys)) + length <= bounds[1:][owner]
    change = np.flatnonzero(leaves[:-1] | (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])) + 1
    starts = np.concatenate([[0], change])[: len(keys) or 0].astype(np.int64)
    counts = np.diff(np.append(starts, len(keys)))
    valid = inside[starts] if len(starts) else np.zeros(0, dtype=bool)
    starts, counts = starts[valid], counts[valid]
    stop = starts + counts + length - 1
    one, two = part_hash(total, BASE, starts, stop), part_hash(total2, BASE2, starts, stop)
    return owner[starts], starts - bounds[owner[starts]], counts, keys[starts], _mixed(one + counts.astype(np.uint64)), _mixed(two)


def suffix_order(text: bytes, depth: int) -> np.ndarray:
    """All suffixes in the order of their first `depth` bytes at least, by two-stage sorting.

    Type B are suffixes smaller than their successors; they are sorted directly. The others follow by one scan over the
    buckets of first bytes: whenever a suffix gets its place, the one that begins a byte earlier, if of type A, takes the
    next free place at the front part of its bucket. A bucket is scanned at once, equal first bytes in rounds.
    """
    data = np.frombuffer(text, dtype=np.uint8)
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64)
    sign = np.append(np.sign(data[1:].astype(np.int16) - data[:-1]), -1)
    last = np.where(sign != 0, np.arange(n), n)
    following = np.minimum.accumulate(last[::-1])[::-1]  # where the run of equal bytes ends
    is_b = sign[following] > 0
    starts = np.flatnonzero(is_b).tolist()
    direct = np.array(sorted(starts, key=lambda i: text[i : i + depth]), dtype=np.int64)
    bounds_b = np.searchsorted(data[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[data[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        front = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, dtype=np.int64)
        rounds = [front]
        while len(front):
            front = front[front > 0] - 1
            front = front[data[front] == c]
            rounds.append(front)
        bucket = np.concatenate([*rounds, direct[bounds_b[c] : bounds_b[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        first = data[before]
        before, first = before[first > c], first[first > c]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.searchsorted(first, np.arange(c + 1, 257))
        for b in np.unique(first).tolist():
            waiting[b].append(before[cuts[b - c - 1] : cuts[b - c]])
    return np.concatenate(out)


def repeated_windows(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each part, which of its windows of `length` bytes start anywhere else in the parts."""
    text = b"".join(parts)
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    ends = np.cumsum(sizes)
    valid = np.arange(len(text)) + length <= np.repeat(ends, sizes)
    order = suffix_order(text, length + 8)
    order = order[valid[order]]
    words = np.ndarray((len(text) + 1,), dtype="<u8", buffer=text + bytes(16), strides=(1,))
    tail = length % 8
    a, b = order[:-1], order[1:]
    alive = np.arange(len(a))
    for at in range(0, length - tail, 8):  # common prefixes of neighbours, as far as they matter
        alive = alive[words[a[alive] + at] == words[b[alive] + at]]
    if tail:
        keep = np.uint64((1 << (8 * tail)) - 1)
        at = length - tail
        alive = alive[(words[np.minimum(a[alive] + at, len(text))] & keep) == (words[np.minimum(b[alive] + at, len(text))] & keep)]
    hit = np.zeros(len(text), dtype=bool)
    hit[a[alive]] = hit[b[alive]] = True
    return [hit[e - s : e - s + max(0, s - length + 1)] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]


def runs(hit: np.ndarray) -> list[int]:
    """Starts and stops of the runs of True, in turn."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edge.tolist()


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64), pa.int64())


BLOCK = 250_000  # bytes whose suffixes are sorted together
KINDS = 512  # different segments of one anchor that are still sorted together
STEP = 8  # windows that hot segments are dealt by


class Repeats:
    """The steps over one table; `length` bytes that occur twice anywhere are found, none other."""

    def __init__(self, docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR):
        with_workers(docs.sparkSession)
        self.scratch = Scratch(docs.sparkSession)
        self.length, self.anchor = length, min(anchor, length)
        self.docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).withColumn("th", F.xxhash64("text"))

    def segments(self) -> DataFrame:
        """Where each segment is: key, h1, h2 (its bytes), doc_id, th, start, windows.

        Texts shorter than `length` have none, however many they are; each row of a repeated text has its own.
        """
        length, anchor = self.length, self.anchor
        schema = pa.schema([("key", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("windows", pa.int32())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from orelode.llm.tokens import batches_of

            for whole in batches:
                for batch in batches_of(whole, 700_000):
                    text = batch.column(2).cast(pa.large_binary())
                    data = np.frombuffer(b"".join(text.to_pylist()), dtype=np.uint8)
                    bounds = np.concatenate([[0], np.cumsum([len(x) for x in text.to_pylist()])]).astype(np.int64)
                    owner, start, count, key, h1, h2 = segments_of(data, bounds, length, anchor)
                    rows = pa.array(owner, pa.int64())
                    yield pa.RecordBatch.from_arrays([_as_long(key), _as_long(h1), _as_long(h2), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(start, pa.int32()), pa.array(count, pa.int32())], schema=schema)

        docs = self.docs.where(F.octet_length("text") >= length).select("doc_id", "th", "text")
        return docs.mapInArrow(run, "key bigint, h1 bigint, h2 bigint, doc_id bigint, th bigint, start int, windows int")

    def sorted_parts(self, parts: DataFrame) -> DataFrame:
        """key, h1, h2, runs of repeated windows, from the bytes of segments, dealt by key."""
        length = self.length
        schema = pa.schema([("key", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("runs", pa.list_(pa.int32()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids: list[tuple] = []
            held: list[bytes] = []
            size, last = 0, None

            def flush():
                found = [(k, runs(hit)) for k, hit in zip(ids, repeated_windows(held, length), strict=True)]
                found = [(*k, r) for k, r in found if r]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

            for batch in batches:
                for i in range(0, batch.num_rows, 512):
                    part = batch.slice(i, 512)
                    for key, h1, h2, data in zip(*(part.column(c).to_pylist() for c in range(4)), strict=True):
                        if key != last and size >= BLOCK:
                            yield from flush()
                            ids, held, size = [], [], 0
                        ids.append((key, h1, h2))
                        held.append(data)
                        size, last = size + len(data), key
            if held:
                yield from flush()

        return parts.repartition("key").sortWithinPartitions("key", "h1", "h2").mapInArrow(run, "key bigint, h1 bigint, h2 bigint, runs array<int>")

    def dealt_windows(self, parts: DataFrame) -> DataFrame:
        """For segments of hot anchors: blocks of windows with what all windows of a block share, and each window's hash.

        Windows are dealt by their distance to the anchor, STEP distances to a block. Equal windows have equal distances, so
        they fall into blocks with an equal shared core; blocks whose core occurs once, and equal blocks, are done without a
        look at windows.
        """
        length, anchor = self.length, self.anchor
        schema = pa.schema([("key", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("core", pa.string()), ("at", pa.int32()), ("hashes", pa.list_(pa.string()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for j in range(0, batch.num_rows, 256):
                    part = batch.slice(j, 256)
                    out: list[tuple] = []
                    for key, h1, h2, raw in zip(*(part.column(c).to_pylist() for c in range(4)), strict=True):
                        data = np.frombuffer(raw, dtype=np.uint8)
                        total, total2 = sums(data, BASE), sums(data, BASE2)
                        at = np.arange(len(data) - anchor + 1)
                        hashed = _mixed(part_hash(total, BASE, at, at + anchor))
                        n = len(data) - length + 1
                        spot = np.where(hashed == hashed.min(), at, len(data))
                        nearest = np.minimum.accumulate(spot[::-1])[::-1][:n]  # the first anchor at or after each window's start
                        start = np.arange(n)
                        block = (nearest - start) // STEP
                        group = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (nearest[1:] != nearest[:-1])]))
                        core_a = nearest[group] - STEP * block[group]
                        core_b = core_a - (STEP - 1) + length
                        c1, c2 = part_hash(total, BASE, core_a, core_b), part_hash(total2, BASE2, core_a, core_b)
                        w1, w2 = part_hash(total, BASE, start, start + length), part_hash(total2, BASE2, start, start + length)
                        names = [f"{x:x}.{y:x}" for x, y in zip(w1.tolist(), w2.tolist(), strict=True)]
                        stops = [*group[1:].tolist(), n]
                        out += [(key, h1, h2, f"{b}.{x:x}.{y:x}", a, names[a:z]) for a, z, b, x, y in zip(group.tolist(), stops, block[group].tolist(), c1.tolist(), c2.tolist(), strict=True)]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        blocks = self.scratch.cut(parts.select("key", "h1", "h2", "data").mapInArrow(run, "key bigint, h1 bigint, h2 bigint, core string, at int, hashes array<string>"), "blocks")
        blocks = blocks.withColumn("content", F.md5(F.array_join("hashes", ",")))
        again = blocks.groupBy("key", "core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "core")
        blocks = self.scratch.cut(blocks.join(self.scratch.cut(again, "core-keys"), ["key", "core"]), "cores")
        same = blocks.groupBy("key", "content").agg(F.count(F.lit(1)).alias("n"), F.min("hashes").alias("hashes"))
        twice = same.select("key", "n", F.explode("hashes").alias("w")).groupBy("key", "w").agg(F.sum("n").alias("n")).where("n > 1").select("key", "w")
        whole = blocks.join(same.where("n > 1").select("key", "content"), ["key", "content"]).select("key", "h1", "h2", F.array("at", F.col("at") + F.size("hashes")).alias("r"))
        lone = blocks.join(same.where("n = 1").select("key", "content"), ["key", "content"]).select("key", "h1", "h2", "at", F.posexplode("hashes").alias("i", "w"))
        lone = lone.join(twice, ["key", "w"]).select("key", "h1", "h2", F.array(F.col("at") + F.col("i"), F.col("at") + F.col("i") + 1).alias("r"))
        return whole.union(lone).groupBy("key", "h1", "h2").agg(F.flatten(F.sort_array(F.collect_list("r"))).alias("runs"))

    def spans(self) -> DataFrame:
        """doc_id, th, spans: where windows that occur elsewhere start, as (first, past the last) in turn, for each text.

        What is joined with rows of a hot key is written before, so that Spark can split the rows of that key.
        """
        length, scratch = self.length, self.scratch
        placed = scratch.cut(self.segments(), "segments")
        again = scratch.cut(placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "keys")
        placed = scratch.cut(placed.join(again, "key", "left_semi"), "again")
        scratch.drop("segments", "keys")
        kinds = placed.groupBy("key", "h1", "h2").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th", "start")).alias("of"), F.first("windows").alias("windows"))
        kinds = scratch.cut(kinds, "kinds")
        many = scratch.cut(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "many")
        mixed = kinds.join(many, "key")
        need = mixed.groupBy(F.col("of.doc_id").alias("d"), F.col("of.th").alias("t")).agg(F.collect_list(F.struct("key", "h1", "h2", "kinds", "of.start", "windows")).alias("s"))
        cutter = self.docs.join(need, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).select("s", F.encode("text", "UTF-8").alias("raw"))
        parts = (cutter.select("raw", F.explode("s").alias("s")).select("s.*", F.expr(f"substring(raw, s.start + 1, s.windows + {length - 1})").alias("data"))
                 .select("key", "h1", "h2", "data", "kinds"))
        parts = scratch.cut(parts, "parts")
        found = self.sorted_parts(parts.where(F.col("kinds") <= KINDS))
        hot = parts.where(F.col("kinds") > KINDS)
        if not hot.isEmpty():
            found = found.union(self.dealt_windows(hot))
        copies = kinds.where("n > 1").select("key", "h1", "h2", F.array(F.lit(0), F.col("windows")).alias("runs"))
        found = scratch.cut(found, "found")
        scratch.drop("parts", "blocks", "cores", "core-keys", "many")
        single = found.join(kinds.where("n = 1").select("key", "h1", "h2"), ["key", "h1", "h2"])
        marks = scratch.cut(copies.union(single.select("key", "h1", "h2", "runs")), "marks")
        where = placed.join(marks, ["key", "h1", "h2"]).select("doc_id", "th", F.transform("runs", lambda x: x + F.col("start")).alias("runs"))
        return where.groupBy("doc_id", "th").agg(F.flatten(F.sort_array(F.collect_set("runs"))).alias("spans"))

    def judged(self) -> DataFrame:
        length = self.length
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import hashlib

            for batch in batches:
                for j in range(0, batch.num_rows, 512):
                    part, out = batch.slice(j, 512), []
                    for doc_id, raw, spans in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True):
                        merged: list[list[int]] = []
                        for a, b in zip(spans[::2], spans[1::2], strict=True):
                            b += length - 1
                            if merged and a <= merged[-1][1]:
                                merged[-1][1] = max(b, merged[-1][1])
                            else:
                                merged.append([a, b])
                        left, at = [], 0
                        for a, b in merged:
                            left.append(raw[at:a])
                            at = b
                        kept = b"".join([*left, raw[at:]])
                        out.append((doc_id, len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        with tidied(self.docs.sparkSession):
            spans = cut(self.spans(), "repeats").withColumnsRenamed({"doc_id": "d", "th": "t"})
        self.scratch.close()
        rows = self.docs.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
        rows = rows.select("doc_id", F.encode("text", "UTF-8").alias("raw"), F.coalesce("spans", F.array().cast("array<int>")).alias("spans"))
        return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept, the bytes that stay.

    A byte goes if some `length` bytes that cover it also start anywhere else, in the same or another row. Null counts as
    empty; repeated rows are copies of each other and lose all from `length` bytes on. Shorter texts stay whole. An empty
    table stays empty. Other columns are not read.
    """
    return Repeats(docs, length).judged()


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("kept")
