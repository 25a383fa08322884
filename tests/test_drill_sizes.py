"""Drill queries where ids of holes repeat and order numbers are long, and how results are rounded."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from orelode.operators import drill
from orelode.plans import drill_queries


def test_a_hole_has_one_trace_whatever_the_number_of_its_collars(spark):
    surveys = spark.createDataFrame([("H", 0, 0.0, 0.0, -90.0), ("H", 1, 50.0, None, -90.0)], "hole_id string, ord int, depth_m double, azimuth double, dip double")
    rows = [("H", o, float(o), 0.0, 100.0 * o, None, None, 80.0) for o in (2, 0, 9, 10, 1)] + [("H", 11, None, 0.0, 0.0, None, None, 80.0), ("I", 3, 7.0, 0.0, None, None, None, 5.0)]
    collars = spark.createDataFrame(rows, "hole_id string, ord int, x double, y double, z double, azimuth double, dip double, total_depth double")
    found = sorted((r.hole_id, r.ord, r.md, r.x, round(r.z, 6)) for r in drill.stations(surveys, collars).collect())
    assert found == [("H", 1, 0.0, 10.0, 1000.0), ("H", 2, 50.0, 10.0, 950.0), ("H", 3, 80.0, 10.0, 920.0), ("I", 1, 0.0, 7.0, 0.0), ("I", 2, 5.0, 7.0, -5.0)]
    assert drill.stations(surveys, collars.drop("ord")).count() == 5


@pytest.fixture(scope="module")
def long_numbers(spark, tmp_path_factory):
    """Orders whose numbers have up to seven digits, of which ids of holes keep six, with four items each."""
    d = str(tmp_path_factory.mktemp("long"))
    keys, day = [7, 100000, 100001, 1000000, 1000001, 1000012], datetime.datetime(2000, 1, 1)
    spark.createDataFrame([(k, k % 9, float(k % 1000)) for k in keys], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{d}/orders.parquet")
    items = [(k, n, n, n, day, float(n), 10.0 + n, "ANRA"[n - 1], 0.0, 0.0, "O") for k in keys for n in range(1, 5)]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate timestamp, l_extendedprice double, l_quantity double, l_returnflag string, l_discount double, l_tax double, l_linestatus string").write.parquet(f"{d}/lineitem.parquet")
    return d


def both(spark, d, name):
    query, sql = drill_queries.QUERIES[name]
    c = duckdb.connect()
    for t in ("orders", "lineitem"):
        c.execute(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    found = query(spark, d)
    return sorted(tuple(r) for r in found.collect()), sorted(c.execute(f"select {', '.join(found.columns)} from ({sql})").fetchall())


def test_intervals_of_long_numbers_find_holes_with_six_digits(spark, long_numbers):
    found, expected = both(spark, long_numbers, "matched_holes")
    assert found == expected and ("H1000012", 1, "H-100001") in found and ("H7", 1, "H-000007") in found


def test_surfaces_of_holes_without_a_collar_count(spark, long_numbers):
    found, expected = both(spark, long_numbers, "supported_surfaces")
    assert found == expected == [("A", 6), ("N", 6), ("R", 6)]


def test_places_are_rounded_as_duckdb_rounds(spark):
    values = [4178.3007935, 147487.26266849999, -4178.3007935, 0.0000005, 2.5, -0.1, None]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", drill_queries.rounded(F.col("v"), 6).alias("r")).collect()
    c = duckdb.connect()
    assert [r.r for r in rows] == [c.execute("select round(?::double, 6)", [r.v]).fetchone()[0] for r in rows]
