"""Peers of a report by likeness of its metadata, and benchmarks of a numeric field against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orelode.functions.text import has_any, norm

# Points for each equal field.
POINTS = {"commodity": 4, "deposit_type": 3, "country": 2, "study_stage": 1, "mining_method": 1}


def first_known(*columns: Column) -> Column:
    """The first that is not blank, lower-cased and trimmed; else empty."""
    return F.coalesce(*(F.nullif(norm(c), F.lit("")) for c in columns), F.lit(""))


def peer_score(target: str = "t_", fields: dict[str, int] = POINTS) -> Column:
    return sum((F.when((F.col(f) != "") & (F.col(f) == F.col(target + f)), n).otherwise(0) for f, n in fields.items()), F.lit(0))


def peers(reports: DataFrame, target: str | None = None, filters: dict[str, str] | None = None, limit: int = 8, least: int = 3) -> DataFrame:
    """The `limit` best peers: source_file, score, tier, place. reports has source_file and the fields of POINTS, normalised.

    With a target, filtered candidates come by score; if there are fewer than `least`, the others follow by score. Without
    one, filtered candidates come by name, but filters hold only if commodity, country or deposit_type is among them.
    """
    filters = {k: v for k, v in (filters or {}).items() if v}
    ok = F.lit(True)
    for k, v in filters.items():
        ok = ok & F.contains(F.col(k), F.lit(v.lower()))
    if target is None:
        rows = reports.where(ok) if {"commodity", "country", "deposit_type"} & filters.keys() else reports
        rows = rows.withColumn("score", F.lit(0)).withColumn("tier", F.lit(0))
    else:
        one = reports.where(norm(F.col("source_file")) == target.strip().lower()).limit(1).select(*(F.col(f).alias("t_" + f) for f in POINTS), F.col("source_file").alias("t_source"))
        rows = reports.crossJoin(F.broadcast(one)).where(F.col("source_file") != F.col("t_source"))
        rows = rows.withColumn("score", peer_score()).withColumn("tier", F.when(ok, 0).otherwise(1))
        enough = rows.agg((F.count_if(F.col("tier") == 0) >= least).alias("enough"))
        rows = rows.crossJoin(F.broadcast(enough)).where(~F.col("enough") | (F.col("tier") == 0))
    top = rows.orderBy("tier", F.desc("score"), "source_file").limit(limit)
    return top.select("source_file", "score", "tier", F.row_number().over(Window.orderBy("tier", F.desc("score"), "source_file")).alias("place"))


def benchmark(values: DataFrame, by: str = "field") -> DataFrame:
    """Per field, from rows (field, source_file, value, is_target): count, minimum, maximum, median of peers, and outliers.

    A target value is an outlier if it lies more than a quarter of the spread outside; without a spread if it differs. If
    there are no peer values the count is that of all, without bounds.
    """
    peer = ~F.col("is_target")
    s = values.groupBy(by).agg(F.count_if(peer).alias("peers"), F.count(F.lit(1)).alias("all"), F.min(F.when(peer, F.col("value"))).alias("low"), F.max(F.when(peer, F.col("value"))).alias("high"),
                               F.median(F.when(peer, F.col("value"))).alias("median"), F.collect_list(F.when(~peer, F.col("value"))).alias("targets"))
    spread = F.col("high") - F.col("low")
    outlier = lambda v: F.when(spread > 0, (v < F.col("low") - 0.25 * spread) | (v > F.col("high") + 0.25 * spread)).otherwise(v != F.col("low"))
    return s.select(by, F.when(F.col("peers") > 0, F.col("peers")).otherwise(F.col("all")).alias("count"), "low", "high", "median",
                    F.coalesce(F.size(F.filter("targets", outlier)), F.lit(0)).alias("outliers"))


def short_number(c: Column) -> Column:
    """Four significant figures without trailing zeros; small and large ones with an exponent."""
    text = F.format_string("%.3e", c.cast("double"))
    power = F.split(text, "e")[1].cast("int")
    plain = F.format_number(c, 10)
    fixed = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, ",", ""), r"(\.\d*?)0+$", "$1"), r"\.$", ""), "^$", "0")
    rounded = F.when(c == 0, "0").otherwise(fixed)
    mantissa = F.regexp_replace(F.regexp_replace(F.split(text, "e")[0], r"0+$", ""), r"\.$", "")
    exponent = F.concat(F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    exact = F.round(c / F.pow(F.lit(10.0), power - 3)) * F.pow(F.lit(10.0), power - 3)
    again = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.format_number(exact, 10), ",", ""), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(c == 0, rounded).when((power < -4) | (power >= 4), F.concat(mantissa, F.lit("e"), exponent)).otherwise(again)


# In order, a field and the parts of a question that mean it.
FIELD_PARTS = {"cutoff_grade": ["cut-off", "cutoff", "cut off"], "post_tax_npv": ["npv"], "irr": ["irr"], "initial_capex": ["capex", "capital cost"], "opex": ["opex", "operating cost"],
               "recovery_rate": ["recovery"], "dilution": ["dilution"], "mining_recovery": ["mining recovery"]}


def inferred_field(question: Column) -> Column:
    low = F.lower(question)
    return F.coalesce(*(F.when(has_any(low, parts), name) for name, parts in FIELD_PARTS.items()))


def descriptions(reports: DataFrame) -> DataFrame:
    """source_file and the fields of POINTS, normalised, of report documents: a tag if it isn't blank, else what it sums up."""
    p = F.col("property_info")
    first_good, first_estimate = F.get(p["commodities"], F.lit(0)), F.get("mineral_resources", F.lit(0))["commodity"]
    return reports.select("source_file", first_known(F.col("primary_commodity"), first_good, first_estimate).alias("commodity"), first_known(F.col("deposit_type"), F.col("geology.deposit_type")).alias("deposit_type"),
                          first_known(p["country"]).alias("country"), first_known(F.col("study_stage"), p["project_stage"]).alias("study_stage"), first_known(F.col("mining_method.method")).alias("mining_method"))


def entries(values: DataFrame, by: str = "field") -> DataFrame:
    """Values (field, source_file, value, unit, is_target) with pos: those of peers first, by name, then the target's."""
    order = Window.partitionBy(by).orderBy("is_target", "source_file", "value", "unit")
    return values.withColumn("pos", F.row_number().over(order))


def range_texts(values: DataFrame) -> DataFrame:
    """field, text: how many peers there are and the range and median of their values; of all values if there are no peers."""
    peer = ~F.col("is_target")
    of = lambda f: F.coalesce(f(F.when(peer, F.col("value"))), f("value"))
    s = values.groupBy("field").agg(F.count_if(peer).alias("n"), of(F.min).alias("low"), of(F.max).alias("high"), of(F.median).alias("median"))
    n = lambda c: short_number(F.col(c))
    return s.select("field", F.concat(F.lit("Field '"), "field", F.lit("': peer_n="), F.col("n").cast("string"), F.lit(", peer_range=["), n("low"), F.lit(", "), n("high"), F.lit("], peer_median="), n("median"), F.lit(".")).alias("text"))
