"""Relations derived from the provided tables. Each is SQL that both engines run: tables stand in braces."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

PAGES = """
SELECT n.source AS source, page,
       CASE WHEN page % 7 = 1 THEN concat('Item ', CAST(floor((page - 1) / 7) AS INT) % 27 + 1, ' - Section ', page, '\n\n', text) ELSE text END AS text
FROM (SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS page FROM {documents}) n JOIN {documents} d ON n.doc_id = d.doc_id
"""

RESOURCES = """
SELECT l_partkey AS report,
       CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_extendedprice) AS INT) AS ord,
       CASE l_returnflag WHEN 'A' THEN 'Measured' WHEN 'N' THEN 'Indicated' ELSE 'Inferred' END AS category,
       l_linestatus AS zone, l_quantity AS tonnes, CASE WHEN l_discount > 0.01 THEN l_discount END AS grade, l_extendedprice AS metal,
       CASE WHEN l_tax > 0.04 THEN 'g/t' ELSE '%' END AS grade_unit
FROM {lineitem}
"""

REPORTS = """
SELECT p_partkey AS report, concat('part-', p_partkey, '.pdf') AS source_file, concat('Report on ', p_name) AS report_title, p_brand AS issuer, p_name AS project_name,
       CASE WHEN p_partkey % 11 = 0 THEN 'usa' WHEN p_partkey % 11 = 1 THEN ' UK ' ELSE n_name END AS country,
       CASE p_size % 7 WHEN 0 THEN 'Operating mine' WHEN 1 THEN 'Under construction' WHEN 2 THEN 'Feasibility' WHEN 3 THEN 'Pre-feasibility' WHEN 4 THEN 'PEA' WHEN 5 THEN 'Exploration' END AS project_stage,
       CASE p_partkey % 5 WHEN 0 THEN 'Au' WHEN 1 THEN 'Copper' WHEN 2 THEN 'U3O8' WHEN 3 THEN p_type ELSE 'coal' END AS commodity,
       CASE p_partkey % 4 WHEN 0 THEN concat('US$', CAST(CAST(floor(p_retailprice) AS INT) AS VARCHAR(20)), ' million') WHEN 1 THEN concat('C$', CAST(CAST(floor(p_retailprice) AS INT) AS VARCHAR(20)), ' k') WHEN 2 THEN '' END AS post_tax_npv,
       CASE p_partkey % 3 WHEN 0 THEN concat('A$1.', p_size, ' billion') WHEN 1 THEN concat('EUR ', p_size, ',500') END AS pre_tax_npv,
       CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) / 2 END AS life_years, CASE WHEN p_partkey % 4 > 0 THEN CAST(p_size AS DOUBLE) * CAST(1.5 AS DOUBLE) - 30 END AS latitude,
       p_type AS deposit_type, p_brand AS mining_method, CAST(p_size AS DOUBLE) AS irr
FROM {part} JOIN {nation} ON n_nationkey = p_partkey % 25
"""

HOLES = """
SELECT concat('H-', lpad(CAST(o_orderkey AS VARCHAR(20)), 6, '0')) AS hole_id, o_orderkey AS ord, CAST(o_custkey AS DOUBLE) AS x, CAST(o_orderkey AS DOUBLE) AS y,
       CASE WHEN o_orderkey % 9 > 0 THEN o_totalprice / 1000 END AS z
FROM {orders}
"""

INTERVALS = """
SELECT concat('H', CAST(l_orderkey AS VARCHAR(20))) AS hole_id, CAST(o AS INT) AS ord, CAST(t - l_quantity AS DOUBLE) AS from_m, CAST(t AS DOUBLE) AS to_m, l_returnflag AS unit,
       CAST(l_partkey % 360 AS DOUBLE) AS azimuth, CAST(45 + l_suppkey % 45 AS DOUBLE) AS dip
FROM (SELECT *, row_number() OVER w AS o, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t
      FROM {lineitem} WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice))
"""


def load(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql.replace("\n", " ").replace("VARCHAR(20)", "STRING") if "'\n" not in sql else sql.replace("VARCHAR(20)", "STRING"), **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def duck(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)
