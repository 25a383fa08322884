"""Views of report documents (with the report schema): tables of one or many reports, as people read them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orelode.functions.text import commodity, commodity_colour, country, grades_text, marker_radius, money, or_dash, primary_grade, short_tonnes_text, stage, strip
from orelode.operators.portfolio import category_of, is_measured_or_indicated

P, E = "property_info", "economics"


def blank(c: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(c.cast("string"), F.lit(""))


def goods() -> Column:
    return F.transform(F.coalesce(F.col(P)["commodities"], F.array().cast("array<string>")), commodity)


def mi_tonnes() -> Column:
    """Measured and indicated tonnes of a report's resources, rows without tonnes as 0."""
    rows = F.filter(F.coalesce(F.col("mineral_resources"), F.array()), lambda r: is_measured_or_indicated(r["category"]))
    return F.aggregate(rows, F.lit(0.0), lambda s, r: s + F.coalesce(r["tonnes"], F.lit(0.0)))


def npv_text() -> Column:
    return F.coalesce(blank(F.col(E)["post_tax_npv"]), blank(F.col(E)["pre_tax_npv"]))


def project_name() -> Column:
    return F.coalesce(blank(F.col(P)["project_name"]), blank(F.col("report_title")), blank(F.col("source_file")))


def portfolio(reports: DataFrame) -> DataFrame:
    """The fourteen columns of the portfolio's export. No measured or indicated tonnes are blank, as is an IRR of nothing."""
    npv = money(npv_text())
    return reports.select("source_file", "report_title", "issuer", country(F.coalesce(F.col(P)["country"], F.lit(""))).alias("country"), stage(F.col(P)["project_stage"]).alias("stage"), F.array_join(goods(), "; ").alias("commodities"),
                          F.when(mi_tonnes() != 0, mi_tonnes()).alias("mi_tonnes"), F.coalesce(strip(npv_text()), F.lit("")).alias("npv_raw"), npv["value"].alias("npv_millions"), blank(F.col(E)["irr"]).alias("irr"),
                          F.col(E)["mine_life_years"].alias("mine_life_years"), F.coalesce("report_date", F.lit("")).alias("report_date"), F.col(P)["latitude"].alias("latitude"), F.col(P)["longitude"].alias("longitude"))


# The keys that a portfolio is sorted by, and their columns.
SORT_KEYS = {"mi": "mi_tonnes", "npv": "npv_millions", "life": "mine_life_years"}


def sorted_portfolio(table: DataFrame, key: str = "mi", descending: bool = True) -> DataFrame:
    """The portfolio in order of a key, missing values as 0, equal ones by source_file."""
    value = F.coalesce(F.col(SORT_KEYS[key]), F.lit(0.0))
    return table.orderBy(value.desc() if descending else value.asc(), "source_file")


def filter_values(reports: DataFrame) -> DataFrame:
    """kind, value: the different commodities, countries and stages that reports can be filtered by."""
    c = reports.select(F.lit("commodity").alias("kind"), F.explode(goods()).alias("value"))
    n = reports.where(blank(F.col(P)["country"]).isNotNull()).select(F.lit("country").alias("kind"), country(F.col(P)["country"]).alias("value"))
    s = reports.where(blank(F.col(P)["project_stage"]).isNotNull()).select(F.lit("stage").alias("kind"), stage(F.col(P)["project_stage"]).alias("value"))
    return reduce(DataFrame.union, (c, n, s)).distinct()


def recent(reports: DataFrame, most: int = 12) -> DataFrame:
    """The reports with the greatest dates as text, a missing one as empty; equal ones by source_file."""
    return reports.orderBy(F.coalesce("report_date", F.lit("")).desc(), "source_file").limit(most).select(
        "source_file", project_name().alias("name"), F.concat_ws(" · ", blank(F.col("issuer")), blank(F.col("report_date"))).alias("told"), stage(F.col(P)["project_stage"]).alias("stage"))


def searched(reports: DataFrame, needle: str, most: int = 12) -> DataFrame:
    """The first reports by source_file whose title, issuer, project or file has the text; a blank one finds none."""
    text = needle.strip().lower()
    joined = F.lower(F.concat_ws(" ", *(blank(c) for c in (F.col("report_title"), F.col("issuer"), F.col(P)["project_name"], F.col("source_file")))))
    hits = reports.where(F.contains(joined, F.lit(text)) & F.lit(bool(text))).orderBy("source_file").limit(most)
    return hits.select("source_file", project_name().alias("name"), F.concat_ws(" · ", blank(F.col("issuer")), blank(F.col(P)["country"])).alias("told"))


def map_marks(reports: DataFrame, wanted: str = "", at: str = "") -> DataFrame:
    """A mark for each report with a place, of a commodity and stage if they are given: place, name, radius, colour."""
    rows = reports.where(F.col(P)["latitude"].isNotNull() & F.col(P)["longitude"].isNotNull())
    if wanted:
        rows = rows.where(F.exists(goods(), lambda c: F.contains(F.lower(c), F.lit(wanted.lower()))))
    if at:
        rows = rows.where(F.lower(stage(F.col(P)["project_stage"])) == at.lower())
    first = F.get(F.col(P)["commodities"], F.lit(0))
    return rows.select("source_file", F.col(P)["latitude"].alias("latitude"), F.col(P)["longitude"].alias("longitude"), F.coalesce(project_name(), F.lit("Project")).alias("name"), marker_radius(mi_tonnes()).alias("radius"), commodity_colour(first).alias("colour"))


def years(c: Column, word: str = "yr") -> Column:
    return F.concat(F.regexp_replace(c.cast("string"), r"\.0$", ""), F.lit(f" {word}"))


def compare_fields() -> dict[str, Column]:
    """The lines of a comparison and what they show."""
    e, mi = F.col(E), mi_tonnes()
    return {"Company": F.col("issuer"), "Country": country(F.coalesce(F.col(P)["country"], F.lit(""))), "Stage": stage(F.col(P)["project_stage"]), "Commodity": F.array_join(goods(), ", "), "Deposit Type": F.col("geology.deposit_type"),
            "M+I Tonnes": F.when(mi > 0, short_tonnes_text(mi)), "Post-Tax NPV": npv_text(), "IRR": e["irr"], "Initial CapEx": e["initial_capex"], "Mine Life": years(e["mine_life_years"]),
            "Qualified Persons": F.size(F.coalesce(F.col("qualified_persons"), F.array())).cast("string")}


def lines(reports: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """source_file, pos, label, value: a line for each field of each report, blank ones as a dash."""
    each = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(k).alias("label"), or_dash(v.cast("string")).alias("value")) for i, (k, v) in enumerate(fields.items())))
    return reports.select("source_file", F.explode(each).alias("x")).select("source_file", "x.*")


def compared(reports: DataFrame, chosen: list[str], most: int = 4) -> DataFrame:
    """pos, label, r1..: the comparison of the first `most` chosen reports, a column for each in the order chosen."""
    chosen = list(dict.fromkeys(chosen))[:most]
    rows = lines(reports.where(F.col("source_file").isin(chosen)), compare_fields())
    return rows.groupBy("pos", "label").agg(*(F.max(F.when(F.col("source_file") == c, F.col("value"))).alias(f"r{i + 1}") for i, c in enumerate(chosen)))


def overview(reports: DataFrame) -> DataFrame:
    """The head of a report: its title, place, numbers of estimates and key figures."""
    e, mi = F.col(E), mi_tonnes()
    n = lambda c: F.size(F.coalesce(F.col(c), F.array()))
    plus = F.when(blank(e["sustaining_capex"]).isNotNull(), F.concat(F.lit("+"), e["sustaining_capex"], F.lit(" sustaining")))
    return lines(reports, {
        "Title": F.coalesce(blank(F.col("report_title")), blank(F.col("source_file")), F.lit("Report")), "Location": F.concat_ws(", ", blank(F.col(P)["country"]), blank(F.col(P)["region"])), "Stage": F.col(P)["project_stage"],
        "Resource rows": n("mineral_resources"), "Reserve rows": n("mineral_reserves"), "Post-Tax NPV": e["post_tax_npv"], "IRR": e["irr"], "Study type": e["study_type"], "Initial CapEx": e["initial_capex"], "Sustaining": plus,
        "Mine Life": years(e["mine_life_years"]), "Payback": years(e["payback_years"]), "M+I Resources": F.when(mi > 0, short_tonnes_text(mi)), "Qualified Persons": n("qualified_persons")})


def economics(reports: DataFrame) -> DataFrame:
    """The figures of a report's study, and its metal prices; reports without one have no lines."""
    e = F.col(E)
    return lines(reports.where(e.isNotNull()), {
        "Post-Tax NPV": e["post_tax_npv"], "Pre-Tax NPV": e["pre_tax_npv"], "IRR": e["irr"], "Initial CapEx": e["initial_capex"], "Sustaining CapEx": e["sustaining_capex"], "OpEx": e["opex"], "Study Type": e["study_type"],
        "Discount Rate": e["discount_rate"], "Mine Life": years(e["mine_life_years"], "years"), "Payback": years(e["payback_years"], "years"), "Metal prices": F.array_join(e["metal_price_assumptions"], ", ")})


def property_and_geology(reports: DataFrame) -> DataFrame:
    p, g = F.col(P), F.col("geology")
    return lines(reports, {
        "Project": p["project_name"], "Country": p["country"], "Region": p["region"], "Commodities": F.array_join(p["commodities"], ", "), "Area (ha)": p["area_hectares"], "Tenure": p["tenure_status"], "Coordinates": p["coordinates"],
        "Ownership": p["ownership"], "Deposit type": g["deposit_type"], "Host rock": g["host_rock"], "Mineralization style": g["mineralization_style"], "Structural controls": g["structural_controls"], "Alteration": g["alteration"]})


def exploration(reports: DataFrame) -> DataFrame:
    x = F.col("exploration")
    return lines(reports.where(x.isNotNull()), {
        "Drill holes": x["total_drill_holes"], "Metres drilled": x["total_metres_drilled"], "Last program": x["last_program_date"], "Drilling types": F.array_join(x["drilling_types"], ", "), "Sampling": x["sampling_methods"],
        "Notable intercepts": F.array_join(x["notable_intercepts"], "; "), "Surveys": F.array_join(x["geophysical_surveys"], ", ")})


def estimates(reports: DataFrame, column: str = "mineral_resources") -> DataFrame:
    """A row for each estimate of each report, with its first grade and all grades as text; blank values as dashes."""
    rows = reports.select("source_file", F.posexplode(column).alias("ord", "e"))
    g = primary_grade(F.col("e.grades"))
    amount = lambda v, u: F.trim(F.concat(or_dash(v.cast("string")), F.lit(" "), F.coalesce(u, F.lit(""))))
    return rows.select("source_file", "ord", *(or_dash(F.col(f"e.{c}").cast("string")).alias(c) for c in ("category", "commodity", "zone", "cut_off_grade", "tonnes", "effective_date")), amount(g["grade_value"], g["grade_unit"]).alias("grade"),
                       amount(g["contained_metal"], g["contained_metal_unit"]).alias("contained_metal"), grades_text(F.col("e.grades")).alias("grades"))


# The order in which categories are shown; others follow.
CATEGORY_ORDER = ["Measured", "Indicated", "Proven", "Probable", "Inferred"]


def category_shares(estimate_rows: DataFrame) -> DataFrame:
    """category, tonnes, percent of the largest (2 at least) and place over resources and reserves (category, tonnes)."""
    sums = estimate_rows.groupBy(category_of().alias("category")).agg(F.sum(F.coalesce("tonnes", F.lit(0.0))).alias("tonnes"))
    most = sums.agg(F.greatest(F.lit(1.0), F.max("tonnes")).alias("most"))
    known = F.array_position(F.array(*(F.lit(c) for c in CATEGORY_ORDER)), F.col("category"))
    place = F.row_number().over(Window.orderBy(F.when(known > 0, known).otherwise(99), "category"))
    return sums.crossJoin(F.broadcast(most)).select("category", "tonnes", F.greatest(F.lit(2.0), F.col("tonnes") / F.col("most") * 100).alias("percent"), place.alias("place"))
