"""Merging of partial records: rows (source_file, pass, fields...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_known(parts: DataFrame, by: str = "source_file", order: str = "pass") -> DataFrame:
    """Per field the first value in order that is neither null nor an empty list; structs are taken whole."""
    out = []
    for f in parts.schema.fields:
        if f.name not in (by, order):
            known = F.col(f.name).isNotNull()
            if isinstance(f.dataType, T.ArrayType):
                known = known & (F.size(f.name) > 0)
            out.append(F.min_by(f.name, F.when(known, F.col(order))).alias(f.name))
    return parts.groupBy(by).agg(*out)


def concatenated(parts: DataFrame, lists: list[str], scalars: list[str], notes: str = "notes", by: str = "source_file", order: str = "pass") -> DataFrame:
    """Lists joined in order, scalars first known and not blank, distinct notes joined by bars, confirmed always false."""
    joined = [F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(order, F.coalesce(c, F.array()).alias("x")))), lambda s: s.x)).alias(c) for c in lists]
    firsts = [F.min_by(c, F.when(F.nullif(F.col(c).cast("string"), F.lit("")).isNotNull(), F.col(order))).alias(c) for c in scalars]
    told = F.transform(F.sort_array(F.collect_list(F.when(F.coalesce(notes, F.lit("")) != "", F.struct(order, notes)))), lambda s: s[notes])
    return parts.groupBy(by).agg(*joined, *firsts, F.array_join(F.array_distinct(told), " | ").alias(notes)).withColumn("confirmed", F.lit(False))


def as_list(c, blank=("", "null")):
    """A string as a list: blank or "null" is empty."""
    low = F.lower(F.trim(c))
    return F.when(c.isNull() | low.isin(*blank), F.array().cast("array<string>")).otherwise(F.array(F.trim(c)))
