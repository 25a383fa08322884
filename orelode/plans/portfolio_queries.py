"""Queries over reports, resources and peers: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from orelode.functions import text
from orelode.operators import merge, peers, portfolio
from orelode.plans import relations as rel

R, S = rel.duck(rel.REPORTS), rel.duck(rel.RESOURCES)
ten = lambda c: F.round(c, 10)


def reports(spark, d):
    return portfolio.canonical(rel.load(spark, d, rel.REPORTS).withColumn("commodities", F.array("commodity")))


CANON = f"""
r AS ({R}),
c AS (SELECT *, CASE WHEN lower(trim(country)) = 'usa' THEN 'United States' WHEN lower(trim(country)) = 'uk' THEN 'United Kingdom' ELSE trim(country) END AS canon_country,
  CASE project_stage WHEN 'Operating mine' THEN 'Operating' WHEN 'Under construction' THEN 'Construction' WHEN 'Feasibility' THEN 'Feasibility' WHEN 'Pre-feasibility' THEN 'Pre-Feasibility' WHEN 'PEA' THEN 'PEA' WHEN 'Exploration' THEN 'Exploration' ELSE 'Other' END AS canon_stage,
  CASE WHEN commodity = 'Au' THEN 'Gold' WHEN commodity = 'Copper' THEN 'Copper' WHEN commodity = 'U3O8' THEN 'Uranium' WHEN commodity = 'coal' THEN 'Cobalt'
       ELSE coalesce((SELECT first(label ORDER BY o) FROM (VALUES (1,'au','Gold'),(2,'gold','Gold'),(3,'cu','Copper'),(4,'copper','Copper'),(5,'ag','Silver'),(6,'silver','Silver'),(7,'li','Lithium'),(8,'lithium','Lithium'),(9,'ni','Nickel'),(10,'nickel','Nickel'),(11,'zn','Zinc'),(12,'zinc','Zinc'),
       (13,'pb','Lead'),(14,'lead','Lead'),(15,'fe','Iron'),(16,'iron','Iron'),(17,'co','Cobalt'),(18,'cobalt','Cobalt'),(19,'mo','Molybdenum'),(20,'molybdenum','Molybdenum'),(21,'u','Uranium'),(22,'uranium','Uranium')) v(o, k, label)
       WHERE starts_with(regexp_replace(lower(commodity), '[^a-z0-9]', '', 'g'), k)), trim(commodity)) END AS canon_commodity,
  coalesce(nullif(post_tax_npv, ''), nullif(pre_tax_npv, '')) AS npv_text FROM r),
m AS (SELECT *, CASE WHEN regexp_matches(npv_text, 'billion') THEN TRY_CAST(regexp_extract(replace(npv_text, ',', ''), '(\\d+(?:\\.\\d+)?)', 1) AS DOUBLE) * 1000 WHEN regexp_matches(npv_text, ' k$') THEN TRY_CAST(regexp_extract(npv_text, '(\\d+)', 1) AS DOUBLE) / 1000
       ELSE TRY_CAST(regexp_extract(replace(npv_text, ',', ''), '(\\d+(?:\\.\\d+)?)', 1) AS DOUBLE) END AS npv,
  CASE WHEN npv_text IS NULL THEN NULL WHEN npv_text LIKE 'C$%' THEN 'CAD' WHEN npv_text LIKE 'A$%' THEN 'AUD' WHEN npv_text LIKE 'EUR%' THEN 'EUR' ELSE 'USD' END AS currency FROM c)
"""


def canonical(spark, d):
    n = portfolio.npv(F.col("post_tax_npv"), F.col("pre_tax_npv"))
    return reports(spark, d).select("report", "canon_country", "canon_stage", F.col("canon_commodities")[0].alias("canon_commodity"), n.alias("n")).select("report", "canon_country", "canon_stage", "canon_commodity", F.round("n.value", 6).alias("npv"), "n.currency")


CANONICAL = f"WITH {CANON} SELECT report, canon_country, canon_stage, canon_commodity, round(npv, 6) AS npv, currency FROM m"


def screened(spark, d):
    return portfolio.matching(reports(spark, d), "cop", "", "Feasibility", "blue").select("report", "source_file")


SCREENED = f"WITH {CANON} SELECT report, source_file FROM m WHERE contains(lower(canon_commodity), 'cop') AND canon_stage = 'Feasibility' AND contains(lower(concat_ws(' ', report_title, issuer, project_name, country, source_file)), 'blue')"


def grade_rollup(spark, d):
    return portfolio.by_category(rel.load(spark, d, rel.RESOURCES), ["report"]).select("report", "category", "tonnes", ten("grade").alias("grade"), F.round("metal", 2).alias("metal"), "n", "grade_unit")


ROLL = "sum(tonnes) AS tonnes, round(CASE WHEN sum(tonnes) > 0 THEN sum(coalesce(grade, 0) * tonnes) / sum(tonnes) END, 10) AS grade, round(nullif(sum(metal), 0), 2) AS metal, count(*) AS n"
GRADE_ROLLUP = f"WITH s AS ({S}) SELECT report, category, {ROLL}, arg_min(grade_unit, ord) AS grade_unit FROM s GROUP BY report, category"


def totals(spark, d):
    return portfolio.with_totals(rel.load(spark, d, rel.RESOURCES), ["report"]).select("report", "category", "kind", "ord", "tonnes", ten("grade").alias("grade"), F.round("metal", 2).alias("metal"))


TOTALS = f"""
WITH s AS ({S}) SELECT report, category, 'row' AS kind, ord, tonnes, round(grade, 10) AS grade, round(metal, 2) AS metal FROM s
UNION ALL SELECT report, category, 'total', NULL, tonnes, grade, metal FROM (SELECT report, category, {ROLL} FROM s GROUP BY report, category) WHERE n > 1
"""


def category_shares(spark, d):
    return portfolio.shares(rel.load(spark, d, rel.RESOURCES)).select("category", "tonnes", ten("percent").alias("percent"))


SHARES = f"WITH s AS ({S}), g AS (SELECT category, sum(tonnes) AS tonnes FROM s GROUP BY category) SELECT category, tonnes, round(greatest(2, tonnes / greatest(1, max(tonnes) OVER ()) * 100), 10) AS percent FROM g"


def kpi_row(spark, d):
    n = rel.load(spark, d, rel.RESOURCES).groupBy("report").agg(F.count(F.lit(1)).alias("n_resources"))
    return portfolio.kpis(reports(spark, d).join(n, "report", "left"))


KPIS = f"""
WITH {CANON}, s AS ({S}), n AS (SELECT report, count(*) AS k FROM s GROUP BY report)
SELECT count(*) AS reports, count(*) FILTER (WHERE k > 0) AS with_resources, count(*) FILTER (WHERE npv_text IS NOT NULL) AS with_economics, count(DISTINCT nullif(canon_country, '')) AS countries,
  count(*) FILTER (WHERE latitude IS NOT NULL) AS located, count(DISTINCT nullif(canon_commodity, '')) AS commodities FROM m LEFT JOIN n USING (report)
"""


def histogram(column, top):
    def run(spark, d):
        r = reports(spark, d).withColumn("canon_commodity", F.explode("canon_commodities"))
        return portfolio.histogram(r.where(F.col(column) != ""), column, top)

    sql = f"WITH {CANON} SELECT {column}, count(*) AS n FROM m WHERE {column} <> '' GROUP BY {column}" + (f" ORDER BY n DESC, {column} LIMIT {top}" if top else "")
    return run, sql


def mi_tonnes(spark, d):
    s = rel.load(spark, d, rel.RESOURCES).where(portfolio.is_measured_or_indicated(F.col("category")))
    return s.groupBy("report").agg(F.sum("tonnes").alias("mi")).select("report", "mi", F.round(text.marker_radius(F.col("mi") * 1e4), 9).alias("radius"))


MI = f"WITH s AS ({S}) SELECT report, sum(tonnes) AS mi, round(greatest(6.0, least(30.0, 6 + sqrt(sum(tonnes) * 1e4 / 1e6) * 2.5)), 9) AS radius FROM s WHERE category IN ('Measured', 'Indicated') GROUP BY report"


def ranked(spark, d):
    return portfolio.ranked(reports(spark, d), "life_years").select("report", F.col("place"))


RANKED = f"WITH r AS ({R}) SELECT report, CAST(row_number() OVER (ORDER BY coalesce(life_years, 0) DESC, source_file) AS INT) AS place FROM r"


def top_npv(spark, d):
    n = reports(spark, d).withColumn("npv", portfolio.npv(F.col("post_tax_npv"), F.col("pre_tax_npv"))["value"])
    return n.where("npv is not null").orderBy(F.desc("npv"), "report").limit(10).select("report", F.round("npv", 6).alias("npv"))


TOP_NPV = f"WITH {CANON} SELECT report, round(npv, 6) AS npv FROM m WHERE npv IS NOT NULL ORDER BY npv DESC, report LIMIT 10"


def tonnage_labels(spark, d):
    return rel.load(spark, d, rel.RESOURCES).select("report", "ord", text.tonnes_text(F.col("tonnes") * 1000).alias("t"), text.category_class(F.col("category")).alias("class"))


LABELS = f"WITH s AS ({S}) SELECT report, ord, CASE WHEN tonnes * 1000 >= 1e6 THEN printf('%.3f Mt', tonnes * 1000 / 1e6) ELSE printf('%.1f kt', tonnes * 1000 / 1e3) END AS t, lower(category) AS class FROM s"


def compared(spark, d):
    return portfolio.compared(rel.load(spark, d, rel.REPORTS), ["part-7.pdf", "part-3.pdf", "part-11.pdf"], ["project_name", "country", "deposit_type"])


COMPARED = f"""
WITH r AS ({R}), x AS (SELECT source_file, unnest(['project_name', 'country', 'deposit_type']) AS field, unnest([project_name, country, deposit_type]) AS v FROM r)
SELECT field, max(v) FILTER (WHERE source_file = 'part-7.pdf') AS r1, max(v) FILTER (WHERE source_file = 'part-3.pdf') AS r2, max(v) FILTER (WHERE source_file = 'part-11.pdf') AS r3 FROM x GROUP BY field
"""


def peer_table(spark, d):
    r = rel.load(spark, d, rel.REPORTS)
    return r.select("source_file", *(peers.first_known(F.col(a)).alias(b) for a, b in (("commodity", "commodity"), ("deposit_type", "deposit_type"), ("country", "country"), ("project_stage", "study_stage"), ("mining_method", "mining_method"))))


PEER_CTE = f"r AS ({R}), p AS (SELECT source_file, lower(trim(commodity)) AS commodity, lower(trim(deposit_type)) AS deposit_type, lower(trim(country)) AS country, coalesce(lower(trim(project_stage)), '') AS study_stage, lower(trim(mining_method)) AS mining_method FROM r)"
SCORED = """s AS (SELECT a.source_file, 4 * CAST(a.commodity = t.commodity AS INT) + 3 * CAST(a.deposit_type = t.deposit_type AS INT) + 2 * CAST(a.country = t.country AS INT) + CAST(a.study_stage = t.study_stage AND t.study_stage <> '' AS INT) + CAST(a.mining_method = t.mining_method AS INT) AS score, a.country
  FROM p a, p t WHERE t.source_file = 'part-42.pdf' AND a.source_file <> t.source_file)"""


def peers_of(spark, d):
    return peers.peers(peer_table(spark, d), "Part-42.pdf", {"country": "nation_1"})


PEERS = f"WITH {PEER_CTE}, {SCORED} SELECT source_file, score, 0 AS tier, CAST(row_number() OVER (ORDER BY score DESC, source_file) AS INT) AS place FROM s WHERE contains(country, 'nation_1') ORDER BY score DESC, source_file LIMIT 8"


def peers_relaxed(spark, d):
    return peers.peers(peer_table(spark, d), "part-42.pdf", {"country": "nowhere"}, 12)


RELAXED = f"WITH {PEER_CTE}, {SCORED} SELECT source_file, score, 1 AS tier, CAST(row_number() OVER (ORDER BY score DESC, source_file) AS INT) AS place FROM s ORDER BY score DESC, source_file LIMIT 12"


def benchmarked(spark, d):
    r = rel.load(spark, d, rel.REPORTS)
    v = r.select(F.col("deposit_type").alias("field"), "source_file", F.col("irr").alias("value"), (F.col("report") % 97 == 0).alias("is_target"))
    return peers.benchmark(v).select("field", "count", "low", "high", "median", "outliers")


BENCH = f"""
WITH r AS ({R}), v AS (SELECT deposit_type AS field, irr AS value, report % 97 = 0 AS t FROM r), s AS (SELECT field, count(*) FILTER (WHERE NOT t) AS n, min(value) FILTER (WHERE NOT t) AS low, max(value) FILTER (WHERE NOT t) AS high, median(value) FILTER (WHERE NOT t) AS median FROM v GROUP BY field)
SELECT field, n AS count, low, high, median, (SELECT count(*) FROM v WHERE v.field = s.field AND t AND (value < low - 0.25 * (high - low) OR value > high + 0.25 * (high - low)))::INT AS outliers FROM s
"""


def merged(spark, d):
    s = rel.load(spark, d, rel.RESOURCES).select(F.concat(F.lit("r"), "report").alias("source_file"), F.col("ord").alias("pass"), "grade", F.when(F.col("ord") % 3 > 0, F.array("category")).otherwise(F.array().cast("array<string>")).alias("names"))
    return merge.first_known(s).select("source_file", "grade", F.array_join("names", ",").alias("names"))


MERGED = f"WITH s AS ({S}) SELECT 'r' || report AS source_file, arg_min(grade, ord) FILTER (WHERE grade IS NOT NULL) AS grade, arg_min(category, ord) FILTER (WHERE ord % 3 > 0) AS names FROM s GROUP BY report"


def concatenated(spark, d):
    s = rel.load(spark, d, rel.RESOURCES).select(F.concat(F.lit("r"), "report").alias("source_file"), F.col("ord").alias("pass"), F.array("category", "zone").alias("names"), F.when(F.col("ord") > 2, F.col("grade_unit")).alias("system"), F.when(F.col("ord") % 2 == 0, F.col("category")).alias("notes"))
    return merge.concatenated(s, ["names"], ["system"]).select("source_file", F.array_join("names", ",").alias("names"), "system", F.coalesce("notes", F.lit("")).alias("notes"), "confirmed")


CONCAT = f"""
WITH s AS ({S}), n AS (SELECT report, category, min(ord) AS o FROM s WHERE ord % 2 = 0 GROUP BY report, category)
SELECT 'r' || report AS source_file, string_agg(category || ',' || zone, ',' ORDER BY ord) AS names, arg_min(grade_unit, ord) FILTER (WHERE ord > 2) AS system,
  coalesce((SELECT string_agg(category, ' | ' ORDER BY o) FROM n WHERE n.report = s.report), '') AS notes, false AS confirmed FROM s GROUP BY report
"""

QUERIES = {
    "canonical_reports": (canonical, CANONICAL), "screened_reports": (screened, SCREENED), "grade_rollup": (grade_rollup, GRADE_ROLLUP), "resource_totals": (totals, TOTALS), "category_shares": (category_shares, SHARES),
    "portfolio_kpis": (kpi_row, KPIS), "commodity_histogram": histogram("canon_commodity", 10), "country_histogram": histogram("canon_country", 10), "stage_histogram": histogram("canon_stage", None), "mi_tonnes": (mi_tonnes, MI),
    "ranked_reports": (ranked, RANKED), "top_npv": (top_npv, TOP_NPV), "tonnage_labels": (tonnage_labels, LABELS), "compared_reports": (compared, COMPARED), "peers": (peers_of, PEERS), "peers_relaxed": (peers_relaxed, RELAXED),
    "benchmark_fields": (benchmarked, BENCH), "merged_first_known": (merged, MERGED), "merged_lists": (concatenated, CONCAT),
}
