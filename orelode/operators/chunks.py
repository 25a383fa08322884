"""Paragraph chunks of page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orelode.functions.html import split_tables
from orelode.functions.text import chunk_id, strip

FIRST_TABLE = 1000  # the number of a source's first table


def chunks(text: Column, size: int = 1400, overlap: int = 0) -> Column:
    """Paragraphs packed greedily up to `size`; the next chunk begins with the last `overlap` characters and is cut at `size`."""
    paragraphs = F.filter(F.transform(F.split(strip(text), r"\n\s*\n"), strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def step(s, p):
        joined = F.when(s.buf == "", p).otherwise(F.concat(s.buf, F.lit("\n\n"), p))
        tail = strip(F.substring(s.buf, -overlap, overlap)) if overlap else F.lit("")
        fresh = F.when((s.buf == "") | (tail == ""), p).otherwise(strip(F.concat(tail, F.lit("\n\n"), p)))
        fits = F.length(joined) <= size
        return F.struct(F.when(fits | (s.buf == ""), s.out).otherwise(F.concat(s.out, F.array(s.buf))).alias("out"),
                        F.when(fits, joined).otherwise(F.substring(fresh, 1, size)).alias("buf"))

    end = F.aggregate(paragraphs, start, step)
    return F.filter(F.concat(end.out, F.array(end.buf)), lambda c: strip(c) != "")


def page_chunks(pages: DataFrame, size: int = 1400, overlap: int = 150) -> DataFrame:
    """source, page, chunk, type, text, chunk_id from pages (source, page, text)."""
    rows = pages.select("source", "page", F.posexplode(chunks(F.col("text"), size, overlap)).alias("chunk", "text"))
    return rows.withColumn("type", F.lit("text")).withColumn("chunk_id", chunk_id(F.col("source"), F.col("page"), F.col("chunk"), F.col("text")))


def page_parts(pages: DataFrame, size: int = 1400, overlap: int = 150) -> DataFrame:
    """source, page, chunk, type, text, chunk_id from pages (source, page, text, is_diagram), tables apart from text.

    Text without its tables makes text chunks, but not on pages that are diagrams. The tables of a page are one chunk;
    those of a source are numbered in page order from 1000. Pages without text give none.
    """
    rows = pages.where(F.coalesce("text", F.lit("")) != "").select("source", "page", "is_diagram", split_tables(F.col("text")).alias("s")).select("source", "page", "is_diagram", "s.body", "s.tables")
    text = rows.where(F.col("body").isNotNull() & ~F.coalesce("is_diagram", F.lit(False))).select("source", "page", F.posexplode(chunks(F.col("body"), size, overlap)).alias("chunk", "text"), F.lit("text").alias("type"))
    number = F.row_number().over(Window.partitionBy("source").orderBy("page")) + (FIRST_TABLE - 1)
    tables = rows.where("tables is not null").select("source", "page", number.alias("chunk"), F.col("tables").alias("text"), F.lit("table").alias("type"))
    both = text.unionByName(tables)
    return both.select("source", "page", "chunk", "type", "text", chunk_id(F.col("source"), F.col("page"), F.col("chunk"), F.col("text")).alias("chunk_id"))
