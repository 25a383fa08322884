"""Screening and roll-ups of report records; resources are rows (report, ord, category, tonnes, grade, metal, units)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orelode.functions.text import commodity, country, money, stage

NULL_IF_ZERO = lambda c: F.when(c != 0, c)


def is_measured_or_indicated(category: Column) -> Column:
    return F.rlike(F.coalesce(category, F.lit("")), F.lit("(?i)measured|indicated"))


def npv(post: Column, pre: Column) -> Column:
    """Post-tax value, or pre-tax where that is blank."""
    return money(F.coalesce(F.nullif(post, F.lit("")), F.nullif(pre, F.lit(""))))


def canonical(reports: DataFrame) -> DataFrame:
    """Add canon_country, canon_stage and canon_commodities to reports (country, project_stage, commodities)."""
    return reports.select("*", country(F.col("country")).alias("canon_country"), stage(F.col("project_stage")).alias("canon_stage"),
                          F.transform("commodities", commodity).alias("canon_commodities"))


def matching(reports: DataFrame, wanted: str = "", where: str = "", at: str = "", search: str = "") -> DataFrame:
    """Canonical reports by commodity part, country, stage and a part of the joined names; blank criteria say nothing."""
    out = reports
    if wanted:
        out = out.where(F.exists("canon_commodities", lambda c: F.contains(F.lower(c), F.lit(wanted.lower()))))
    if where:
        out = out.where(F.lower("canon_country") == where.lower())
    if at:
        out = out.where(F.lower("canon_stage") == at.lower())
    if search:
        names = F.lower(F.concat_ws(" ", *(F.nullif(F.col(c), F.lit("")) for c in ("report_title", "issuer", "project_name", "country", "source_file"))))
        out = out.where(F.contains(names, F.lit(search.lower())))
    return out


def summed(tonnes: str = "tonnes", grade: str = "grade", metal: str = "metal") -> list[Column]:
    """Total tonnes, tonnage-weighted grade and total metal. Rows without grade weigh in with 0; a metal total of 0 is null."""
    t, g, m = (F.coalesce(F.col(c), F.lit(0.0)) for c in (tonnes, grade, metal))
    return [F.sum(t).alias("tonnes"), F.when(F.sum(t) > 0, F.sum(g * t) / F.sum(t)).alias("grade"), NULL_IF_ZERO(F.sum(m)).alias("metal")]


def category_of(c: str = "category") -> Column:
    return F.trim(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("Other")))


def by_category(resources: DataFrame, keys: list[str]) -> DataFrame:
    return resources.groupBy(*keys, category_of().alias("category")).agg(*summed(), F.count(F.lit(1)).alias("n"), F.min_by("grade_unit", "ord").alias("grade_unit"))


def with_totals(resources: DataFrame, keys: list[str]) -> DataFrame:
    """Detail rows, and a total for each category of more than one row; kind tells them apart."""
    detail = resources.select(*keys, category_of().alias("category"), F.lit("row").alias("kind"), "ord", "tonnes", "grade", "metal")
    total = by_category(resources, keys).where("n > 1").select(*keys, "category", F.lit("total").alias("kind"), F.lit(None).cast("int").alias("ord"), "tonnes", "grade", "metal")
    return detail.unionByName(total)


def shares(resources: DataFrame) -> DataFrame:
    """Tonnes by category and their percent of the largest, 2 at least."""
    sums = resources.groupBy(category_of().alias("category")).agg(F.sum(F.coalesce("tonnes", F.lit(0.0))).alias("tonnes"))
    most = sums.agg(F.greatest(F.lit(1.0), F.max("tonnes")).alias("most"))
    return sums.crossJoin(F.broadcast(most)).select("category", "tonnes", F.greatest(F.lit(2.0), F.col("tonnes") / F.col("most") * 100).alias("percent"))


def kpis(reports: DataFrame) -> DataFrame:
    """One row of counts over canonical reports (n_resources, post_tax_npv, pre_tax_npv, latitude)."""
    any_npv = (F.coalesce(F.nullif("post_tax_npv", F.lit("")), F.nullif("pre_tax_npv", F.lit("")))).isNotNull()
    base = reports.agg(F.count(F.lit(1)).alias("reports"), F.count_if(F.col("n_resources") > 0).alias("with_resources"), F.count_if(any_npv).alias("with_economics"),
                       F.countDistinct(F.nullif("canon_country", F.lit(""))).alias("countries"), F.count_if(F.col("latitude").isNotNull()).alias("located"))
    goods = reports.select(F.explode("canon_commodities").alias("c")).where("c <> ''").agg(F.countDistinct("c").alias("commodities"))
    return base.crossJoin(goods)


def histogram(values: DataFrame, column: str, top: int | None = None) -> DataFrame:
    counted = values.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counted if top is None else counted.orderBy(F.desc("n"), column).limit(top)


def ranked(reports: DataFrame, key: str, descending: bool = True) -> DataFrame:
    """Reports with their place by a key, null as 0; equal ones by source_file."""
    value = F.coalesce(F.col(key), F.lit(0.0))
    return reports.withColumn("place", F.row_number().over(Window.orderBy(value.desc() if descending else value.asc(), "source_file")))


def csv_export(reports: DataFrame, path: str) -> None:
    reports.write.option("header", True).option("quote", '"').option("escape", '"').mode("overwrite").csv(path)


def compared(reports: DataFrame, chosen: list[str], fields: list[str], most: int = 4) -> DataFrame:
    """A row for each field, a column r1.. for each chosen report, in the order chosen."""
    chosen = list(dict.fromkeys(chosen))[:most]
    place = F.array_position(F.array(*(F.lit(c) for c in chosen)), F.col("source_file"))
    rows = reports.where(F.col("source_file").isin(chosen)).select(place.alias("place"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("x"))
    return rows.groupBy(F.col("x.field").alias("field")).agg(*(F.max(F.when(F.col("place") == i + 1, F.col("x.value"))).alias(f"r{i + 1}") for i in range(len(chosen))))
