"""Numeric fields of report records, and summaries of benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orelode.operators.peers import short_number


def number(c: Column) -> Column:
    """A bare number; text with units is null."""
    return F.when(F.rlike(F.trim(c.cast("string")), F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), c.try_cast("double"))


# For each field the names it goes by, the paths it is read from, and its unit. Every inner tuple gives a value at
# most, the first that is a number; a path in brackets stands in for the one before it where that is blank, even if it is no number.
FIELDS = {
    ("npv", "post_tax_npv"): ([("economics.post_tax_npv", "economics.pre_tax_npv")], "economics.npv_currency", "USD"),
    ("irr",): ([("economics.irr",)], None, "%"),
    ("capex", "initial_capex"): ([(["economics.initial_capex", "economics.total_capex"],)], None, "USD"),
    ("opex",): ([("economics.opex",)], None, "USD"),
    ("recovery", "recovery_rate"): ([("economics.recovery_rate",), ("processing_method.overall_recovery", "processing.overall_recovery")], None, "%"),
    ("dilution",): ([("mining_method.dilution_pct", "mining_method.dilution")], None, "%"),
    ("mining_recovery",): ([("mining_method.mining_recovery_pct", "mining_method.mine_recovery")], None, "%"),
}
CUTOFF = ("cutoff", "cutoff_grade", "resource_cutoff")


def at_path(reports: DataFrame, path: str, schema: T.DataType | None = None) -> Column:
    """The column at a path as text; null where the schema has none."""
    kind = schema or reports.schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return F.lit(None).cast("string")
        kind = kind[part].dataType
    return F.col(path).cast("string")


def values(reports: DataFrame, field: str) -> DataFrame:
    """source_file, field, value, unit of a numeric field; cut-off grades come from resources, then reserves. Unknown fields give none."""
    name = F.coalesce("source_file", F.lit("unknown"))
    if field in CUTOFF:
        kind = reports.schema["mineral_resources"].dataType.elementType
        both = F.explode(F.concat(F.coalesce("mineral_resources", F.array()), F.coalesce("mineral_reserves", F.array())))
        rows = reports.select(name.alias("source_file"), both.alias("e"))
        pick = lambda *names: F.coalesce(*(F.col(f"e.{n}").cast("string") for n in names if n in kind.names), F.lit(None).cast("string"))
        return rows.select("source_file", F.lit(field).alias("field"), number(pick("cutoff_grade", "cut_off_grade")).alias("value"), F.coalesce(pick("cutoff_unit"), F.lit("")).alias("unit")).where("value is not null")
    groups, unit_path, unit = next((v for k, v in FIELDS.items() if field in k), ([], None, ""))
    read = lambda p: F.coalesce(*(F.nullif(at_path(reports, x), F.lit("")) for x in p)) if isinstance(p, list) else at_path(reports, p)
    out = [F.coalesce(*(number(read(p)) for p in group)) for group in groups]
    unit = F.coalesce(F.nullif(at_path(reports, unit_path), F.lit("")), F.lit(unit)) if unit_path else F.lit(unit)
    rows = reports.select(name.alias("source_file"), unit.alias("unit"), F.explode(F.array(*out) if out else F.array().cast("array<double>")).alias("value"))
    return rows.where("value is not null").select("source_file", F.lit(field).alias("field"), "value", "unit")


def summaries(entries: DataFrame, most: int = 8) -> DataFrame:
    """field, summary: the first entries (field, pos, source_file, value, unit) and how many more there are."""
    rows = entries.withColumn("r", F.row_number().over(Window.partitionBy("field").orderBy("pos")))
    one = F.concat("source_file", F.lit(": "), short_number(F.col("value")), F.when(F.coalesce("unit", F.lit("")) == "", "").otherwise(F.concat(F.lit(" "), "unit")))
    texts = F.transform(F.sort_array(F.collect_list(F.when(F.col("r") <= most, F.struct("r", one.alias("t"))))), lambda x: x.t)
    more = F.count(F.lit(1)) - most
    return rows.groupBy("field").agg(F.concat(F.array_join(texts, "; "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise("")).alias("summary"))


# The fields of a nested value that stand for it, in order.
SCALAR_FIELDS = ["method", "name", "text", "value", "type", "deposit_type", "commodity"]


def scalar(c: Column, kind: T.DataType) -> Column:
    """A value as trimmed text, null if blank; a struct by the first of its named text fields that isn't blank."""
    if isinstance(kind, T.StructType):
        texts = [c[f] for f in SCALAR_FIELDS if f in kind.names and isinstance(kind[f].dataType, T.StringType)]
        return F.coalesce(*(F.nullif(F.trim(t), F.lit("")) for t in texts), F.lit(None).cast("string"))
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def slim(reports: DataFrame) -> DataFrame:
    """source_file and the record as JSON without nulls and empty lists at its top."""
    columns = [F.when(F.size(f.name) > 0, F.col(f.name)).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in reports.schema.fields]
    return reports.select("source_file", F.to_json(F.struct(*columns)).alias("document"))


def orientation_of(text: str) -> tuple[float, float, str | None]:
    """Dip, direction and perhaps a surface from text with commas."""
    parts = [p.strip() for p in text.split(",")]
    if len(parts) not in (2, 3):
        raise ValueError("an orientation is DIP,DIRECTION or DIP,DIRECTION,SURFACE")
    return float(parts[0]), float(parts[1]), parts[2] if len(parts) == 3 else None


def default_surface(pile: DataFrame, intervals: DataFrame) -> DataFrame:
    """One row, surface: the first unit of the pile (ord, unit), else the first by name of intervals (unit), else null."""
    top = pile.where("unit <> ''").agg(F.min_by("unit", "ord").alias("a"))
    other = intervals.where("trim(unit) <> ''").agg(F.min(F.trim("unit")).alias("b"))
    return top.crossJoin(other).select(F.coalesce("a", "b").alias("surface"))


def default_orientation(collars: DataFrame, surface: str, dip: float, direction: float, polarity: int = 1) -> DataFrame:
    """One orientation at the mean of all collars with an x; a missing z is 0."""
    mean = collars.where(F.col("x").isNotNull()).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg(F.coalesce("z", F.lit(0.0))).alias("z"))
    return mean.select(F.lit(surface).alias("surface_name"), "x", "y", "z", F.lit(dip).alias("dip"), F.lit(direction).alias("dip_direction"), F.lit(polarity).alias("polarity"), F.lit("assumed by the user").alias("source"))


def unit_names(pile: DataFrame, intervals: DataFrame, faults: DataFrame) -> DataFrame:
    """name, place: pile units as they come, then units of intervals and faults that are not there yet (ord, name)."""
    rows = pile.select(F.lit(0).alias("k"), "ord", "name").unionByName(intervals.select(F.lit(1).alias("k"), "ord", "name")).unionByName(faults.select(F.lit(2).alias("k"), "ord", "name")).where("trim(name) <> ''")
    seen = F.row_number().over(Window.partitionBy("name").orderBy("k", "ord"))
    rows = rows.withColumn("seen", seen).where((F.col("k") == 0) | (F.col("seen") == 1))
    return rows.select("name", F.row_number().over(Window.orderBy("k", "ord")).alias("place"))


def modeller_tables(points: DataFrame, orientations: DataFrame, folder: str) -> None:
    """Points and orientations as CSV for a modelling program."""
    points.select(F.col("x").alias("X"), F.col("y").alias("Y"), F.col("z").alias("Z"), "surface").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/points")
    orientations.select(F.col("x").alias("X"), F.col("y").alias("Y"), F.col("z").alias("Z"), F.col("dip_direction").alias("azimuth"), "dip", "polarity", F.col("surface_name").alias("surface")).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/orientations")


def decoded_events(streams: DataFrame) -> DataFrame:
    """id, pos, type, body of server-sent events (id, text); lines that are not JSON are left out."""
    rows = streams.select("id", F.posexplode(F.split("text", "\n\n")).alias("pos", "block"))
    rows = rows.where(F.startswith("block", F.lit("data: "))).select("id", "pos", F.expr("substring(block, 7)").alias("body"))
    return rows.select("id", "pos", F.get_json_object("body", "$.type").alias("type"), "body").where("type is not null")
