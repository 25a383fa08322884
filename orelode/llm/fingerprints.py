"""Document fingerprints: bottom-k sketches of hashed five-word shingles, by built-in expressions only.

A sketch is an ascending array of the k smallest distinct 64-bit shingle hashes. Sketches of parts merge into the sketch
of the whole, and estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orelode.llm.common import text_or_empty

K, WORDS = 256, 5
SPACES = r"[\x20\x09-\x0D]+"
IDS = 1024  # doc_ids per block when the next document is looked up


def add_sketch(df: DataFrame, text: str, out: str, k: int = K, width: int = WORDS) -> DataFrame:
    """Add the sketch of a text column: lower-cased words, `width` in a row; fewer words are one shingle, none an empty sketch.

    Null has a null sketch. Rows stay as they are, repeated ones too, however long; an empty table stays empty. The names
    `out`, <out>_words and <out>_hashes are taken: columns of df with these names are replaced or dropped.
    """
    w, h = f"{out}_words", f"{out}_hashes"
    df = df.withColumn(w, F.filter(F.split(F.lower(F.col(text)), SPACES), lambda x: x != ""))
    df = df.withColumn(h, F.transform(w, lambda x: F.xxhash64(x))).drop(w)
    hashes = F.col(h)
    runs = F.transform(F.slice(hashes, 1, F.size(h) - (width - 1)),
                       lambda x, i: F.xxhash64(x, *(F.get(hashes, i + j) for j in range(1, width))))
    shingles = (F.when(F.size(h) == 0, F.slice(hashes, 1, 0)).when(F.size(h) < width, F.array(F.xxhash64(hashes)))
                .otherwise(runs))
    return df.withColumn(out, F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)).drop(h)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(df: DataFrame, a: str, b: str, out: str, k: int = K) -> DataFrame:
    """Add the estimated Jaccard likeness of two sketches: the part of the union's k smallest that both hold. Two empty ones: 1."""
    u = f"{out}_union"
    df = df.withColumn(u, merged(F.col(a), F.col(b), k))
    both = F.size(F.array_intersect(F.array_intersect(F.col(u), F.col(a)), F.col(b)))
    return df.withColumn(out, F.when(F.size(u) == 0, 1.0).otherwise(both / F.size(u))).drop(u)


def distinct_count(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    top = (F.element_at(sketch, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / top)


def containment(a: Column, b: Column, likeness: Column, k: int = K) -> Column:
    """Estimated part of a's shingles that b has, from the resemblance and both counts."""
    na, nb = distinct_count(a, k), distinct_count(b, k)
    both = likeness * (na + nb) / (1.0 + likeness)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / na))


def merge_groups(df: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """One sketch for each group of rows: distinct values, of which each task passes on k per group at most."""
    values = df.select(*keys, F.explode(sketch).alias("value_")).distinct()
    ranked = values.withColumn("rank_", F.row_number().over(Window.partitionBy(*keys).orderBy("value_"))).where(F.col("rank_") <= k)
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list("value_")).alias(sketch))


def as_text(sketch: Column) -> Column:
    """The values in order, eight bytes each, in base 64."""
    return F.translate(F.base64(F.unhex(F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), ""))), "\r\n", "")


def block_ends(ids: DataFrame) -> DataFrame:
    """block, last_id, next_id for each block of IDS ids (column doc_id): its largest id, and the smallest of the next block.

    After the last block comes the first. Null ids are a block before all others. Blocks are put in order in groups of
    65,536, and those groups in one task.
    """
    ends = ids.withColumn("block", block_of(F.col("doc_id"))).groupBy("block").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    ends = ends.withColumn("wide", F.floor(F.col("block") / (1 << 16)))
    groups = ends.groupBy("wide").agg(F.min_by("first_id", "block").alias("first_id"))
    whole = Window.orderBy("wide")
    start = F.first(F.struct("first_id")).over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = groups.select(F.col("wide").alias("wide_"), F.coalesce(F.lead(F.struct("first_id")).over(whole), start).alias("after"))
    follows = F.lead(F.struct("first_id")).over(Window.partitionBy("wide").orderBy("block"))
    return (ends.withColumn("follows", follows).join(after, F.col("wide") == F.col("wide_"))
            .select("block", "last_id", F.coalesce("follows", "after")["first_id"].alias("next_id")))


def block_of(doc_id: Column) -> Column:
    return F.coalesce(F.floor(doc_id / IDS).cast("bigint"), F.lit(-(2**62)))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and next_text, that of the next row by (doc_id, text); after the last comes the first.

    docs has doc_id and text (not null); other columns are dropped. Texts are shuffled once, by blocks of IDS ids; only the
    last and the next block's first text of each block are looked up, by their ids. Null ids come first, in one block, as do
    all rows of one id. Repeated rows follow each other. One row is its own next; an empty table stays empty; texts may have any length.
    """
    docs = docs.select("doc_id", "text")
    here = Window.partitionBy("block").orderBy("doc_id", "text")
    rows = docs.withColumn("block", block_of(F.col("doc_id"))).select("doc_id", "text", F.lead("text").over(here).alias("next_text"))
    ends = block_ends(docs.select("doc_id"))
    wanted = ends.select("block", "last_id", F.explode(F.array(F.struct(F.lit(True).alias("last"), F.col("last_id").alias("id")), F.struct(F.lit(False).alias("last"), F.col("next_id").alias("id")))).alias("w"))
    found = docs.join(wanted.select("block", "last_id", "w.last", "w.id"), F.col("doc_id").eqNullSafe(F.col("id")))
    edges = found.groupBy("block").agg(F.first("last_id").alias("doc_id"), F.max(F.when(F.col("last"), F.col("text"))).alias("text"), F.min(F.when(~F.col("last"), F.col("text"))).alias("next_text"))
    return rows.where("next_text is not null").union(edges.select("doc_id", "text", "next_text"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text) its fingerprint, that of its edited text, and how near that and the next row's are.

    The edited text has its last floor(n_chars / 4) code points replaced by as many of the next row's first, or all if it
    has fewer. Null counts as empty; an empty text is its own edited text. Order, ties, null ids and repeats as in
    with_next(); two texts without words are alike (1). Other columns are not read.
    """
    rows = with_next(docs.select("doc_id", text_or_empty().alias("text"))).withColumn("n_chars", F.length("text"))
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, n_chars - cast(floor(n_chars / 4) as int)), substring(next_text, 1, cast(floor(n_chars / 4) as int)))"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    for text, sketch in (("text", "fp"), ("edited", "edited_fp"), ("next_text", "next_fp")):
        rows = add_sketch(rows, text, sketch).drop(text)
    rows = resemblance(resemblance(rows, "fp", "edited_fp", "near_edited"), "fp", "next_fp", "near_next")
    return rows.select("doc_id", F.col("n_chars").cast("bigint").alias("n_chars"), "edited_sha256", as_text(F.col("fp")).alias("fingerprint"),
                       as_text(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
