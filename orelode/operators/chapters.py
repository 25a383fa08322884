"""Numbered headings in pages, their page ranges, and tagging of pages and chunks with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orelode.functions.text import clean_title

MOST = 27  # chapters that a report can have
NEAR_TOP = 200  # characters in which a bare "Item n" counts


def _first(found: Column) -> Column:
    return F.get(found, F.lit(0))


def heading(text: Column, most: int = MOST, titles: dict[int, str] | None = None) -> Column:
    """struct(item, title) of the first numbered heading line; item is null if there is none.

    A line is a heading if it begins with a number of one or two digits, perhaps after "Item", then a mark (. : - – —) and
    a title of 3 to 80 characters. Only the first such line counts; if its number is not 1 to `most`, or there is no such
    line, the first bare "Item n" near the top does, with its title from `titles`. A title's line may follow empty ones.
    """
    lines = F.regexp_extract_all(text, F.lit(r"(?im)^\s*((?:item\s*)?\d{1,2}\s*[-.:–—]\s*[^\n]{3,80})"), F.lit(1))
    line = _first(lines)
    number = F.regexp_extract(line, r"(\d{1,2})", 1).try_cast("int")
    title = F.regexp_replace(line, r"(?is)^(item\s*)?\d{1,2}\s*[-.:–—]\s*", "")
    bare = _first(F.regexp_extract_all(F.substring(text, 1, NEAR_TOP), F.lit(r"(?im)^\s*item\s*(\d{1,2})\b"), F.lit(1))).try_cast("int")
    listed = F.create_map(*(F.lit(x) for k, v in (titles or {}).items() for x in (k, v))) if titles else None
    named = F.concat(F.lit("Item "), bare.cast("string"))
    named = F.coalesce(F.try_element_at(listed, bare), named) if titles else named
    good, fair = number.between(1, most), bare.between(1, most)
    return F.struct(F.when(good, number).when(fair, bare).alias("item"), F.when(good, clean_title(title)).when(fair, named).alias("title"))


def chapter_ranges(pages: DataFrame, titles: dict[int, str] | None = None) -> DataFrame:
    """source, ord, item, title, page_start, page_end from pages (source, page, text); the last chapter is open."""
    found = pages.select("source", "page", heading(F.col("text"), titles=titles).alias("h")).where("h.item is not null").select("source", "page", "h.*")
    w = Window.partitionBy("source").orderBy("page", "item", "title")
    found = found.withColumn("before", F.lag(F.struct("item", "page")).over(w)).where(~F.struct("item", "page").eqNullSafe(F.col("before")))
    following = F.lead("page").over(w)
    return found.select("source", F.row_number().over(w).alias("ord"), "item", "title", F.col("page").alias("page_start"),
                        F.when(following.isNotNull(), F.greatest("page", following - 1)).alias("page_end"))


def tag_pages(pages: DataFrame, chapters: DataFrame, text: str | None = None, titles: dict[int, str] | None = None) -> DataFrame:
    """pages (source, page, ...) with ni_item and section_title, as ranges made by chapter_ranges() say.

    On a page where chapters start the first of them counts, on later ones the last. A page before all chapters has a
    heading of its own in the column `text`, if that is given, else item 0 and an empty title. Starts and pages are merged
    in one order, so the work grows with their number, and repeated rows stay.
    """
    c = chapters.where("page_start is not null").groupBy("source", F.col("page_start").cast("int").alias("page")).agg(F.min_by(F.struct("item", "title"), "ord").alias("first"), F.max_by(F.struct("item", "title"), "ord").alias("last"))
    p = pages.select("source", F.col("page").cast("int").alias("page"), F.lit(1).alias("kind"), F.struct(*pages.columns).alias("row"))
    both = p.unionByName(c.select("source", "page", F.lit(0).alias("kind"), F.struct("page", "first", "last").alias("start")), allowMissingColumns=True)
    order = Window.partitionBy("source").orderBy("page", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("at", F.last("start", ignorenulls=True).over(order)).where("kind = 1")
    tag = F.when(F.col("page") > 0, F.when(F.col("page") == F.col("at.page"), F.col("at.first")).otherwise(F.col("at.last")))
    rows = rows.select("row.*", tag.alias("tag_"))
    if text:
        rows = rows.withColumn("tag_", F.coalesce(F.col("tag_"), F.when(heading(F.col(text), titles=titles)["item"].isNotNull(), heading(F.col(text), titles=titles))))
    return rows.select(*pages.columns, F.coalesce("tag_.item", F.lit(0)).alias("ni_item"), F.coalesce("tag_.title", F.lit("")).alias("section_title"))


def retagged(chunks: DataFrame, pages: DataFrame, titles: dict[int, str] | None = None) -> DataFrame:
    """chunks of the sources in pages with their tags found anew; nothing else of a chunk changes, and other sources' stay as they are."""
    rest = [c for c in chunks.columns if c not in ("ni_item", "section_title")]
    mine = chunks.join(pages.select("source").distinct(), "source", "left_semi").select(*rest)
    fresh = tag_pages(mine, chapter_ranges(pages, titles), "text", titles).select(*chunks.columns)
    return fresh.unionByName(chunks.join(pages.select("source").distinct(), "source", "left_anti").select(*chunks.columns))
