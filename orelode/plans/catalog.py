"""Registered queries over the provided tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orelode.plans import drill_queries, more_queries, portfolio_queries, record_queries, text_queries

ALL = {**text_queries.QUERIES, **portfolio_queries.QUERIES, **drill_queries.QUERIES, **more_queries.QUERIES, **record_queries.QUERIES}


def queries():
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in ALL.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_queries.hybrid(spark, sf_dir)
