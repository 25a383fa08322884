"""Near-duplicate documents by bottom-k sketches of one hash function.

Documents with equal shingle sets are one class first, so copies cost nothing further. The smallest retained values of each
class make inverted lists. Classes too few of whose retained values occur anywhere else can't have a link and go at once.
The others are compared with the leaders of some of their lists, which joins large groups of near copies by a number of pairs
that grows with the group only; then short lists make their pairs, and long ones are compared block by block, both between
different components only. A sketch of the union estimates each likeness, and what may be a link is confirmed on full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orelode.llm.common import Scratch, cut, text_or_empty, tidied, unused, with_workers
from orelode.llm.fingerprints import resemblance
from orelode.llm.tokens import batches_of

WORDS, PERCENT = 5, 75
K = 96  # retained values of a class
WIDE = 512  # values retained for blocks; a set of no more is compared exactly there
POSTED = 16  # retained values, the smallest, that are posted in inverted lists: linked classes share none once in 4 billion times
LONG_LIST = 48  # classes in a list that still makes all its pairs
SIGMAS = 4.5  # standard deviations by which an estimate may be low
STARS, ROUNDS = 2, 2  # lists whose leader a class meets, and rounds of that in long lists
FEW = 1_000_000  # edges that one task joins to components; more are joined in rounds
BLOCK = 1024  # classes of a long list that are compared at once
P = np.uint64(0x9E3779B97F4A7C15)
TOP = np.uint64(1 << 63)


def lowest(percent: int, k: int) -> float:
    """The smallest estimate from k values that a link may have."""
    p = percent / 100
    return p - SIGMAS * (p * (1 - p) / k) ** 0.5


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int = WORDS) -> list[np.ndarray]:
    """For each text its ascending distinct shingle hashes: A-Z lower-cased, words between ASCII white space, `width` in a row.

    Fewer words are one shingle; without words the set is empty, as for null.
    """
    import xxhash

    texts = pc.ascii_lower(pc.fill_null(texts, ""))
    lists = pc.split_pattern(pc.replace_substring_regex(texts, "[\\x09-\\x0D]", " "), " ")
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    hashed = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)
    real = np.array([w != "" for w in words], dtype=bool)
    at = coded.indices.to_numpy()
    kept = real[at] if len(at) else np.zeros(0, dtype=bool)
    cum = np.concatenate([[0], np.cumsum(kept)])[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
    each = hashed[at[kept]] if len(at) else hashed
    code = np.zeros(max(0, len(each) - width + 1), dtype=np.uint64)
    for i in range(width):
        code = code * P + each[i : i + len(code)]
    code = _mixed(code)
    out = []
    for a, b in zip(cum[:-1].tolist(), cum[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(code[a : b - width + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for x in each[a:b]:
                whole = np.uint64((int(whole) * int(P) + int(x)) % 2**64)
            out.append(_mixed(np.array([whole])))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def sketched(docs: DataFrame, k: int = K, width: int = WORDS) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest of the whole set and sketch for each row of docs (doc_id, text).

    Values of a sketch have their highest bit turned, so that signed order is that of the hashes.
    """
    with_workers(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, 1_000_000):
                sets = shingle_sets(batch.column(2), width)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([(s[:k] ^ TOP).view(np.int64) for s in sets], pa.list_(pa.int64()))], schema=schema)

    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text"))
    return text.mapInArrow(run, "doc_id bigint, text_hash bigint, n_shingles bigint, digest binary, sketch array<bigint>")


def forest(edges: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root of all edges (a, b) by union and find; the root is the smallest node."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = x = above.setdefault(above[x], above[x])
        return x

    for batch in edges:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(a), top(b)
            above[max(a, b)] = min(a, b)
    nodes = sorted(above)
    for i in range(0, len(nodes), 100_000):
        some = nodes[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([top(x) for x in some], pa.int64())], names=["node", "root"])


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root for every node of edges (a, b): root is the smallest node reachable.

    Up to FEW edges go through one task. More take large-star and small-star rounds, each written to the shared folder, so
    neither lineage nor driver memory grows. Both give the same.
    """
    with_workers(edges.sparkSession)
    edges = scratch.cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"), "stars")
    if edges.count() <= FEW:
        found = scratch.cut(edges.coalesce(1).mapInArrow(forest, "node bigint, root bigint"), "components")
        scratch.drop("stars")
        scratch.drop("components", keep=1)
        return found
    edges = scratch.cut(edges.distinct(), "stars")
    scratch.drop("stars", keep=1)

    def size(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = size(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.least("u", "m").alias("b"))
        large = scratch.cut(large.where("a <> b").distinct(), "large-stars")
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = scratch.cut(small.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "stars")
        scratch.drop("large-stars")
        scratch.drop("stars", keep=1)
        now = size(edges)
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    found = scratch.cut(nodes, "components")
    scratch.drop("stars")
    scratch.drop("components", keep=1)
    return found


def least_shared(percent: int, k: int) -> int:
    """The fewest of k values that a link leaves shared, but for once in a million."""
    p, total, prob = percent / 100, 0.0, (1 - percent / 100) ** k
    for shared in range(k + 1):
        total += prob
        if total > 1e-6:
            return shared
        prob *= (k - shared) / (shared + 1) * p / (1 - p) if p < 1 else 0
    return k


def overlaps(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """How many values each of `one` shares with each of `two`; every array is without repeats."""
    flat = np.concatenate([*one, *two])
    row = np.repeat(np.arange(len(one) + len(two)), [len(x) for x in [*one, *two]])
    _, code = np.unique(flat, return_inverse=True)
    mine = row < len(one)
    n = int(code.max()) + 1 if len(code) else 0
    times = np.bincount(code[mine], minlength=n) * np.bincount(code[~mine], minlength=n)
    out = np.zeros((len(one), len(two)), dtype=np.float32)
    shared = np.flatnonzero(times)
    place = np.full(n, -1)
    place[shared] = np.arange(len(shared))
    code = place[code]
    for begin in range(0, len(shared), 4096):
        here = (code >= begin) & (code < begin + 4096)
        width = min(4096, len(shared) - begin)
        a, b = np.zeros((len(one), width), dtype=np.float32), np.zeros((len(two), width), dtype=np.float32)
        a[row[here & mine], code[here & mine] - begin] = 1
        b[row[here & ~mine] - len(one), code[here & ~mine] - begin] = 1
        out += a @ b.T
    return out.astype(np.int64)


def near_in_block(rows: pa.Table, percent: int = PERCENT) -> pa.Table:
    """Pairs (a, b, sure) of an outer and another class of a block, in different components, that are or may be links.

    Where both sketches are whole sets the answer is exact, and of such links those are given that join components here;
    others are given if the sketch of their union lets them be links. A pair is looked at in the list of its smallest
    common posted value only, and two outer ones once.
    """
    cid, root = (rows[c].to_numpy() for c in ("cid", "root"))
    whole, outer, inner = (np.array(rows[c].to_pylist(), dtype=bool) for c in ("whole", "outer", "inner"))
    lists = rows["sketch"].combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sketch = np.split(lists.flatten().to_numpy(), (np.asarray(lists.offsets)[1:-1] - lists.offsets[0].as_py())) if len(lists) else []
    out: list[tuple] = []
    y, x = np.flatnonzero(outer), np.flatnonzero(~outer)
    if len(y) and len(x):
        v = rows["v"][0].as_py()
        both = overlaps([sketch[i] for i in y], [sketch[i] for i in x])
        end = np.array([np.iinfo(np.int64).max if w else s[-1] for s, w in zip(sketch, whole.tolist(), strict=True)])
        part = np.minimum(end[y][:, None], end[x][None, :])
        size = -both
        for i, j in enumerate(y.tolist()):
            size[i] += np.searchsorted(sketch[j], part[i], "right")
        for i, j in enumerate(x.tolist()):
            size[:, i] += np.searchsorted(sketch[j], part[:, i], "right")
        exact = whole[y][:, None] & whole[x][None, :]
        p = percent / 100
        near = np.where(exact, 100 * both >= percent * size, both >= size * (p - SIGMAS * np.sqrt(p * (1 - p) / np.maximum(size, 1))))
        near &= (both > 0) & (root[y][:, None] != root[x][None, :]) & (inner[x][None, :] | (cid[x][None, :] > cid[y][:, None]))
        i, j = np.nonzero(near)
        posted = np.full((len(sketch), POSTED), np.iinfo(np.int64).max)
        for k, s in enumerate(sketch):
            posted[k, : min(POSTED, len(s))] = s[:POSTED]
        first = np.zeros(len(i), dtype=bool)
        for k in range(0, len(i), 50_000):
            a, b = posted[y[i[k : k + 50_000]]], posted[x[j[k : k + 50_000]]]
            first[k : k + 50_000] = ~((a[:, :, None] == b[:, None, :]) & (a < v)[:, :, None]).any((1, 2))
        i, j = i[first], j[first]
        above: dict[int, int] = {}

        def top(r: int) -> int:
            while above.get(r, r) != r:
                above[r] = above.get(above[r], above[r])
                r = above[r]
            return r

        for sure in (True, False):
            for a, b in zip(y[i[exact[i, j] == sure]].tolist(), x[j[exact[i, j] == sure]].tolist(), strict=True):
                ra, rb = top(int(root[a])), top(int(root[b]))
                if ra != rb:
                    out.append((int(cid[a]), int(cid[b]), sure))
                    if sure:
                        above[ra] = rb
    a, b, sure = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "sure": pa.array(sure, pa.bool_())})


class NearDuplicates:
    """Links between the classes of one table; the steps share the tables that they write, and judged() deletes them."""

    def __init__(self, docs: DataFrame, percent: int = PERCENT, width: int = WORDS):
        self.docs, self.percent, self.width = docs, percent, width
        self.scratch = Scratch(docs.sparkSession)
        self.rows = self.scratch.cut(sketched(docs, K, width), "sketches")
        classes = (self.rows.where("n_shingles > 0").groupBy("digest")
                   .agg(F.min(F.struct("doc_id", "text_hash")).alias("of"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n"), F.min("doc_id").alias("least")))
        self.classes = self.scratch.cut(classes.select("digest", "of.doc_id", "of.text_hash", "sketch", "n", "least", F.monotonically_increasing_id().alias("cid")), "classes")

    def with_partners(self, classes: DataFrame, k: int, least: int) -> DataFrame:
        """The classes of whose k smallest values enough occur in another class too: a link leaves a quarter unshared.

        `least` of k is what a link has at least but for once in a million; whole sets have an exact bound.
        """
        values = classes.select("cid", F.explode(F.slice("sketch", 1, k)).alias("v"))
        again = self.scratch.cut(values.groupBy("v").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("v"), "again")
        shared = values.join(again, "v").groupBy("cid").agg(F.count(F.lit(1)).alias("shared"))
        enough = F.when(F.col("n") <= k, 100 * F.col("shared") >= self.percent * F.col("n")).otherwise(F.col("shared") >= least)
        return classes.join(shared, "cid").where(enough).drop("shared")

    def lists(self) -> None:
        """Classes that may have links, and where they stand in lists of two or more: (v, cid, times)."""
        some = self.scratch.cut(self.with_partners(self.classes.select("cid", "doc_id", "text_hash", "sketch", "n"), POSTED, least_shared(self.percent, POSTED)), "some")
        self.live = self.scratch.cut(self.with_partners(some, K, least_shared(self.percent, K)), "live")
        self.scratch.drop("again", "some")
        posted = self.live.select("cid", F.explode(F.slice("sketch", 1, POSTED)).alias("v"))
        times = self.scratch.cut(posted.groupBy("v").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "times")
        self.posted = self.scratch.cut(posted.join(times, "v").select("v", "cid", "times"), "lists")
        self.scratch.drop("times")

    def estimated(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that their union's sketch lets be links."""
        side = self.live.select("cid", "sketch")
        both = (pairs.join(side.withColumnsRenamed({"cid": "a", "sketch": "sa"}), "a")
                .join(side.withColumnsRenamed({"cid": "b", "sketch": "sb"}), "b"))
        return resemblance(both, "sa", "sb", "like", K).where(F.col("like") >= lowest(self.percent, K)).select("a", "b")

    def texts_of(self, cids: DataFrame) -> DataFrame:
        need = cids.select("cid", F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
        docs = self.docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
        docs = docs.join(need, F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("h")))
        return docs.select("cid", "text").dropDuplicates(["cid"])

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are links by their full shingle sets."""
        percent, width = self.percent, self.width

        @F.arrow_udf("boolean")
        def linked(x: pa.Array, y: pa.Array) -> pa.Array:
            out = []
            for i in range(0, len(x), 64):
                for a, b in zip(shingle_sets(x[i : i + 64], width), shingle_sets(y[i : i + 64], width), strict=True):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    out.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both))
            return pa.array(out, pa.bool_())

        both = (pairs.select("a", "b").join(self.texts.withColumnsRenamed({"cid": "a", "text": "ta"}), "a")
                .join(self.texts.withColumnsRenamed({"cid": "b", "text": "tb"}), "b"))
        return self.scratch.cut(both.where(linked("ta", "tb")).select("a", "b"), "links")

    def joined(self, links: DataFrame) -> None:
        """Take new links into the components."""
        if not links.isEmpty():
            old = self.found.select(F.col("node").alias("a"), F.col("root").alias("b"))
            self.found = components(old.union(links.select("a", "b")), self.scratch)
        self.scratch.drop("links")

    def across(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose ends are in different components."""
        r = self.found.select(F.col("node").alias("n_"), F.col("root").alias("r_"))
        p = pairs.join(r.withColumnsRenamed({"n_": "a", "r_": "ra"}), "a", "left").join(r.withColumnsRenamed({"n_": "b", "r_": "rb"}), "b", "left")
        return p.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")

    def stars(self, posted: DataFrame, turn: int) -> DataFrame:
        """Each class with the leaders of a few of its lists, the shortest first."""
        lead = posted.groupBy("v").agg(F.min_by("cid", F.xxhash64("cid", "v", F.lit(turn))).alias("b"))
        order = Window.partitionBy("cid").orderBy("times", F.xxhash64("v", F.lit(turn)))
        some = posted.withColumn("r", F.row_number().over(order)).where(F.col("r") <= STARS)
        return some.join(lead, "v").where("cid <> b").select(F.col("cid").alias("a"), "b").distinct()

    def roots(self) -> DataFrame:
        """node, root of every class with a link. Pairs inside a component that is already known aren't looked at again."""
        self.lists()
        scratch = self.scratch
        self.found = self.live.select(F.col("cid").alias("node"), F.col("cid").alias("root")).limit(0)
        self.texts = scratch.cut(self.texts_of(self.live), "texts")
        self.joined(self.confirmed(self.estimated(self.stars(self.posted, 0))))
        lists = self.posted.where(F.col("times") <= LONG_LIST).groupBy("v").agg(F.sort_array(F.collect_list("cid")).alias("l"))
        pairs = lists.select("l", F.posexplode("l").alias("i", "a")).select("a", F.explode(F.slice("l", F.col("i") + 2, F.size("l"))).alias("b")).distinct()
        self.joined(self.confirmed(self.estimated(self.across(pairs))))
        long = scratch.cut(self.posted.where(F.col("times") > LONG_LIST), "long-lists")
        if not long.isEmpty():
            for turn in range(1, ROUNDS + 1):
                self.joined(self.confirmed(self.estimated(self.across(self.stars(long, turn)))))
            self.joined(self.in_blocks(long))
        return self.found

    def in_blocks(self, long: DataFrame) -> DataFrame:
        """Links between components among classes of one long list, none left out.

        Of every list each class outside its largest component is compared, block by block, with all classes of the list
        in other components.
        """
        scratch, percent, width = self.scratch, self.percent, self.width
        with_workers(self.docs.sparkSession)

        def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in batches_of(whole, 1_000_000):
                    sets = shingle_sets(batch.column(1), width)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) <= WIDE for s in sets], pa.bool_()),
                                                      pa.array([(s[:WIDE] ^ TOP).view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["cid", "whole", "sketch"])

        placed = long.join(self.found.withColumnRenamed("node", "cid"), "cid", "left").select("v", "cid", F.coalesce("root", "cid").alias("root"))
        placed = scratch.cut(placed, "placed")
        share = placed.groupBy("v", "root").agg(F.count(F.lit(1)).alias("n"))
        lists = share.groupBy("v").agg(F.max(F.struct("n", "root")).alias("x"), F.count(F.lit(1)).alias("roots"), F.sum("n").alias("n")).where("roots > 1")
        lists = scratch.cut(lists.select("v", F.col("x.root").alias("main"), F.ceil(F.col("n") / BLOCK).cast("int").alias("ins"),
                                         F.ceil((F.col("n") - F.col("x.n")) / BLOCK).cast("int").alias("outs")), "open-lists")
        rows = scratch.cut(placed.join(lists, "v"), "dealt")
        wide = self.texts.join(rows.select("cid").distinct(), "cid", "left_semi").select("cid", "text").mapInArrow(widen, "cid bigint, whole boolean, sketch array<bigint>")
        rows = rows.join(scratch.cut(wide, "wide"), "cid")
        outer = F.col("root") != F.col("main")
        mine = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
        fields = ["cid", "root", "whole", "sketch"]
        one = rows.select("v", mine("ins").alias("i"), F.explode(F.sequence(F.lit(0), F.col("outs") - 1)).alias("o"), F.lit(False).alias("outer"), (~outer).alias("inner"), *fields)
        two = rows.where(outer).select("v", F.explode(F.sequence(F.lit(0), F.col("ins") - 1)).alias("i"), mine("outs").alias("o"), F.lit(True).alias("outer"), F.lit(False).alias("inner"), *fields)

        def compare(block: pa.Table) -> pa.Table:
            return near_in_block(block, percent)

        pairs = scratch.cut(one.union(two).groupBy("v", "i", "o").applyInArrow(compare, "a bigint, b bigint, sure boolean").distinct(), "blocked")
        return self.confirmed(pairs.where("not sure")).union(pairs.where("sure").select("a", "b"))

    def judged(self) -> DataFrame:
        """doc_id, text_hash, n_shingles, component_id, kept for each row; reads one written table, all others are deleted."""
        with tidied(self.docs.sparkSession):
            roots = self.roots()
        owner = self.classes.select("digest", "cid", "least").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
        owner = owner.select("digest", "least", F.coalesce("root", "cid").alias("root"))
        smallest = owner.groupBy("root").agg(F.min("least").alias("component_id"))
        owner = self.scratch.cut(owner.join(smallest, "root").select("digest", "component_id"), "owners")
        rows = self.rows.select("doc_id", "text_hash", "n_shingles", "digest")
        some = rows.where("n_shingles > 0").join(owner, "digest").select("doc_id", "text_hash", "n_shingles", "component_id")
        none = rows.where("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
        done = cut(some.union(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "near")
        self.scratch.close()
        return done


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text); linked documents share a component.

    A link is 100 * intersection >= percent * union of the shingle sets; component_id is the smallest doc_id reachable over
    links, of non-null ones. Texts without words, and null, have an empty set and only themselves. Repeated rows share all.
    A null doc_id is kept only if its whole component is null. Other columns are not read.
    """
    return NearDuplicates(docs, percent, width).judged().drop("text_hash")


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """docs without near copies, all columns as they were: of each component the document with the smallest doc_id.

    Null and empty texts stay, each a document of its own; repeated rows stay or go together; an empty table stays empty.
    Long texts are read whole, and columns of docs may have any names.
    """
    gone = NearDuplicates(docs.select("doc_id", "text")).judged().where("not kept")
    of, hashed = unused(docs.columns, "of", "hashed")
    gone = gone.select(F.col("doc_id").alias(of), F.col("text_hash").alias(hashed)).distinct()
    return docs.join(gone, F.col("doc_id").cast("bigint").eqNullSafe(F.col(of)) & (F.xxhash64(text_or_empty()) == F.col(hashed)), "left_anti")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
