"""Queries over whole report documents and their views: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orelode.functions import text
from orelode.operators import estimates, peers, views
from orelode.plans import relations as rel
from orelode.plans.portfolio_queries import CANON, S
from orelode.schema import REPORT


def _filled(kind: StructType, **known):
    """A struct of the kind; fields that aren't known are null."""
    return F.struct(*(known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields))


def records(spark, d) -> DataFrame:
    """Documents with the report schema from the reports and their resources; a third have no date, an eighth no resources."""
    kind = {f.name: f.dataType for f in REPORT.fields}
    estimate = kind["mineral_resources"].elementType
    grade = F.array(_filled(estimate["grades"].dataType.elementType, commodity=F.col("zone"), grade_value=F.col("grade"), grade_unit=F.col("grade_unit"), contained_metal=F.col("metal"), contained_metal_unit=F.lit("oz")))
    one = _filled(estimate, category=F.col("category"), commodity=F.col("zone"), zone=F.col("zone"), tonnes=F.col("tonnes"), grades=grade, cut_off_grade=F.when(F.col("ord") == 1, F.col("grade").cast("string")))
    rows = rel.load(spark, d, rel.RESOURCES).where("report % 8 <> 0").groupBy("report").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", one.alias("e")))), lambda x: x["e"]).alias("mineral_resources"))
    r = rel.load(spark, d, rel.REPORTS).join(rows, "report", "left")
    c = F.col
    known = {
        "source_file": c("source_file"), "report_title": c("report_title"), "issuer": c("issuer"), "report_date": F.when(c("report") % 3 > 0, F.concat(F.lit("20"), F.lpad((c("report") % 90 + 10).cast("string"), 2, "0"), F.lit("-01"))),
        "property_info": _filled(kind["property_info"], project_name=c("project_name"), country=c("country"), project_stage=c("project_stage"), commodities=F.array("commodity"), latitude=c("latitude"), longitude=F.when(c("report") % 5 > 0, c("life_years"))),
        "economics": _filled(kind["economics"], post_tax_npv=c("post_tax_npv"), pre_tax_npv=c("pre_tax_npv"), irr=c("irr").cast("string"), mine_life_years=c("life_years"), initial_capex=F.when(c("report") % 2 == 0, F.lit("")).otherwise(c("post_tax_npv")), total_capex=F.lit("75.5")),
        "geology": _filled(kind["geology"], deposit_type=c("deposit_type")), "mining_method": _filled(kind["mining_method"], method=c("mining_method")),
        "mineral_resources": c("mineral_resources"), "mineral_reserves": F.array()}
    return r.select("report", *(known.get(n, F.lit(None)).cast(t).alias(n) for n, t in kind.items()))


MI = f"mi AS (SELECT report, sum(tonnes) FILTER (WHERE category IN ('Measured', 'Indicated')) AS mi FROM ({S}) WHERE report % 8 <> 0 GROUP BY report)"
BASE = f"WITH {CANON}, {MI}, b AS (SELECT m.*, coalesce(mi, 0) AS mi, CASE WHEN report % 3 > 0 THEN '20' || (report % 90 + 10) || '-01' ELSE '' END AS report_date, CASE WHEN report % 5 > 0 THEN life_years END AS longitude FROM m LEFT JOIN mi USING (report))"


def portfolio_export(spark, d):
    return views.portfolio(records(spark, d)).withColumn("npv_millions", F.round("npv_millions", 6))


EXPORT = f"""{BASE} SELECT source_file, report_title, issuer, canon_country AS country, canon_stage AS stage, canon_commodity AS commodities, nullif(mi, 0) AS mi_tonnes, coalesce(npv_text, '') AS npv_raw, round(npv, 6) AS npv_millions,
CAST(irr AS VARCHAR) AS irr, life_years AS mine_life_years, report_date, latitude, longitude FROM b"""


def portfolio_sorted(key):
    def run(spark, d):
        return views.sorted_portfolio(views.portfolio(records(spark, d)), key).limit(50).select("source_file", F.round(views.SORT_KEYS[key], 6).alias("value"))

    value = {"mi": "nullif(mi, 0)", "npv": "npv", "life": "life_years"}[key]
    return run, f"{BASE} SELECT source_file, round({value}, 6) AS value FROM b ORDER BY coalesce({value}, 0) DESC, source_file LIMIT 50"


def filter_values(spark, d):
    return views.filter_values(records(spark, d))


FILTER_VALUES = f"{BASE} SELECT DISTINCT 'commodity' AS kind, canon_commodity AS value FROM b UNION SELECT 'country', canon_country FROM b UNION SELECT 'stage', canon_stage FROM b WHERE project_stage IS NOT NULL"


def recent(spark, d):
    return views.recent(records(spark, d)).select("source_file", "name", "told", "stage")


RECENT = f"{BASE} SELECT source_file, project_name AS name, concat_ws(' · ', issuer, nullif(report_date, '')) AS told, canon_stage AS stage FROM b ORDER BY report_date DESC, source_file LIMIT 12"


def searched(spark, d):
    return views.searched(records(spark, d), " BLUE ")


SEARCHED = f"{BASE} SELECT source_file, project_name AS name, concat_ws(' · ', issuer, country) AS told FROM b WHERE contains(lower(concat_ws(' ', report_title, issuer, project_name, source_file)), 'blue') ORDER BY source_file LIMIT 12"


def map_marks(spark, d):
    return views.map_marks(records(spark, d), "", "feasibility").withColumn("radius", F.round("radius", 9))


MARKS = f"""{BASE} SELECT source_file, latitude, longitude, project_name AS name, round(CASE WHEN mi > 0 THEN greatest(6.0, least(30.0, 6 + sqrt(mi / 1e6) * 2.5)) ELSE 8 END, 9) AS radius,
CASE WHEN commodity = 'Au' THEN '#F59E0B' WHEN commodity = 'Copper' THEN '#C2410C' WHEN commodity = 'U3O8' THEN '#84CC16' WHEN commodity = 'coal' THEN '#06B6D4' ELSE
  coalesce((SELECT first(c ORDER BY o) FROM (VALUES (1,'au','#F59E0B'),(2,'gold','#F59E0B'),(3,'cu','#C2410C'),(4,'copper','#C2410C'),(5,'ag','#9CA3AF'),(6,'silver','#9CA3AF'),(7,'li','#3B82F6'),(8,'lithium','#3B82F6'),(9,'ni','#10B981'),(10,'nickel','#10B981'),
  (11,'zn','#8B5CF6'),(12,'zinc','#8B5CF6'),(13,'pb','#6B7280'),(14,'lead','#6B7280'),(15,'fe','#EF4444'),(16,'iron','#EF4444'),(17,'co','#06B6D4'),(18,'cobalt','#06B6D4'),(19,'mo','#F97316'),(20,'molybdenum','#F97316'),(21,'u3o8','#84CC16'),(22,'uranium','#84CC16')) v(o, k, c)
  WHERE contains(regexp_replace(lower(commodity), '[^a-z0-9]', '', 'g'), k)), '#9CA3AF') END AS colour
FROM b WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND canon_stage = 'Feasibility'"""

CHOSEN = ["part-7.pdf", "part-3.pdf", "part-16.pdf", "part-12.pdf", "part-5.pdf"]


def comparison(spark, d):
    return views.compared(records(spark, d), CHOSEN)


def _years(c, word="yr"):
    return f"regexp_replace(CAST({c} AS VARCHAR), '\\.0$', '') || ' {word}'"


TONNES = "CASE WHEN mi >= 1e6 THEN printf('%.2f Mt', mi / 1e6) WHEN mi >= 1e3 THEN printf('%.1f kt', mi / 1e3) WHEN mi > 0 THEN printf('%.0f t', mi) END"
COMPARISON = f"""{BASE}, x AS (SELECT source_file, unnest(range(11)) AS pos, unnest(['Company', 'Country', 'Stage', 'Commodity', 'Deposit Type', 'M+I Tonnes', 'Post-Tax NPV', 'IRR', 'Initial CapEx', 'Mine Life', 'Qualified Persons']) AS label,
  unnest([issuer, canon_country, canon_stage, canon_commodity, deposit_type, {TONNES}, npv_text, CAST(irr AS VARCHAR), nullif(CASE WHEN report % 2 > 0 THEN post_tax_npv END, ''), {_years('life_years')}, '0']) AS v FROM b)
SELECT CAST(pos AS INT) AS pos, label, {', '.join(f"max(coalesce(v, '—')) FILTER (WHERE source_file = '{c}') AS r{i + 1}" for i, c in enumerate(CHOSEN[:4]))} FROM x GROUP BY pos, label"""


def economics_view(spark, d):
    return views.economics(records(spark, d)).where("pos in (0, 3, 8)").select("source_file", "label", "value")


ECONOMICS = f"""{BASE} SELECT source_file, 'Post-Tax NPV' AS label, coalesce(nullif(post_tax_npv, ''), '—') AS value FROM b UNION ALL SELECT source_file, 'Initial CapEx', coalesce(nullif(CASE WHEN report % 2 > 0 THEN post_tax_npv END, ''), '—') FROM b
UNION ALL SELECT source_file, 'Mine Life', coalesce({_years('life_years', 'years')}, '—') FROM b"""


def estimate_rows(spark, d):
    return views.estimates(records(spark, d)).select("source_file", F.col("ord").cast("int").alias("ord"), "category", "cut_off_grade", "grades")


ESTIMATES = f"""WITH s AS ({S}) SELECT 'part-' || report || '.pdf' AS source_file, ord - 1 AS ord, category, CASE WHEN ord = 1 AND grade IS NOT NULL THEN CAST(grade AS VARCHAR) ELSE '—' END AS cut_off_grade,
CASE WHEN grade IS NULL THEN '—' ELSE zone || ': ' || printf('%.2f', grade) || ' ' || grade_unit END AS grades FROM s JOIN part ON p_partkey = report WHERE report % 8 <> 0"""


def field_values(spark, d):
    """Values of a capital cost, a recovery and a cut-off grade; of the first the text that isn't blank counts, number or not."""
    r = records(spark, d)
    return estimates.values(r, "capex").union(estimates.values(r, "recovery")).union(estimates.values(r, "cutoff_grade"))


VALUES = f"""WITH r AS ({rel.duck(rel.REPORTS)}), s AS ({S})
SELECT source_file, 'capex' AS field, CAST(75.5 AS DOUBLE) AS value, 'USD' AS unit FROM r WHERE report % 2 = 0 OR coalesce(post_tax_npv, '') = ''
UNION ALL SELECT 'part-' || report || '.pdf', 'cutoff_grade', grade, '' FROM s JOIN part ON p_partkey = report WHERE ord = 1 AND grade IS NOT NULL AND report % 8 <> 0"""


def described(spark, d):
    return peers.descriptions(records(spark, d))


DESCRIBED = f"WITH r AS ({rel.duck(rel.REPORTS)}) SELECT source_file, lower(trim(commodity)) AS commodity, lower(trim(deposit_type)) AS deposit_type, lower(trim(country)) AS country, coalesce(lower(trim(project_stage)), '') AS study_stage, lower(trim(mining_method)) AS mining_method FROM r"


def range_texts(spark, d):
    v = records(spark, d).select(F.substring(F.col("geology.deposit_type"), 1, 3).alias("field"), F.round(F.col("economics.irr").cast("double") / 8, 3).alias("value"), (F.col("report") % 9 == 0).alias("is_target"))
    return peers.range_texts(v)


def _g(c):
    return f"regexp_replace(regexp_replace(printf('%.3f', round({c}, CASE WHEN {c} >= 10 THEN 2 WHEN {c} >= 1 THEN 3 ELSE 4 END)), '0+$', ''), '\\.$', '')"


RANGES = f"""WITH v AS (SELECT substr(p_type, 1, 3) AS field, round(CAST(p_size AS DOUBLE) / 8, 3) AS value FROM part WHERE p_partkey % 9 > 0), s AS (SELECT field, count(*) AS n, min(value) AS lo, max(value) AS hi, median(value) AS med FROM v GROUP BY field)
SELECT field, 'Field ''' || field || ''': peer_n=' || n || ', peer_range=[' || {_g('lo')} || ', ' || {_g('hi')} || '], peer_median=' || {_g('med')} || '.' AS text FROM s"""


def all_shares(spark, d):
    s = rel.load(spark, d, rel.RESOURCES)
    return views.category_shares(s.unionByName(s.where("ord = 1").withColumn("category", F.lit("Probable")))).select("category", "tonnes", F.round("percent", 9).alias("percent"), "place")


ALL_SHARES = f"""WITH s AS ({S}), u AS (SELECT category, tonnes FROM s UNION ALL SELECT 'Probable', tonnes FROM s WHERE ord = 1), g AS (SELECT category, sum(tonnes) AS tonnes FROM u GROUP BY category)
SELECT category, tonnes, round(greatest(2, tonnes / greatest(1, max(tonnes) OVER ()) * 100), 9) AS percent, CAST(row_number() OVER (ORDER BY CASE category WHEN 'Measured' THEN 1 WHEN 'Indicated' THEN 2 WHEN 'Proven' THEN 3 WHEN 'Probable' THEN 4 ELSE 5 END) AS INT) AS place FROM g"""


def assessment_classes(spark, d):
    a = F.element_at(F.array(*(F.lit(x) for x in ("No-Go", "Conditional Go", "Further Work", "Go", ""))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", text.assessment_class(a).alias("class"))


CLASSES = "SELECT p_partkey, ['nogo', 'conditional', 'further', 'go', ''][p_partkey % 5 + 1] AS class FROM part"

QUERIES = {
    "portfolio_export": (portfolio_export, EXPORT), "sorted_by_tonnes": portfolio_sorted("mi"), "sorted_by_npv": portfolio_sorted("npv"), "sorted_by_life": portfolio_sorted("life"), "filter_values": (filter_values, FILTER_VALUES), "recent_reports": (recent, RECENT),
    "searched_reports": (searched, SEARCHED), "map_marks": (map_marks, MARKS), "comparison": (comparison, COMPARISON), "economics_view": (economics_view, ECONOMICS), "estimate_rows": (estimate_rows, ESTIMATES), "field_values": (field_values, VALUES),
    "described_reports": (described, DESCRIBED), "range_texts": (range_texts, RANGES), "all_category_shares": (all_shares, ALL_SHARES), "assessment_classes": (assessment_classes, CLASSES),
}
