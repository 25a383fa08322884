"""Inputs of a geological model from a spatial document: points, orientations, series, extent and what was left out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orelode.operators import drill

SERIES = "Strat_Series"


@dataclass
class Spatial:
    """The tables of one spatial document."""

    collars: DataFrame  # hole_id, ord, x, y, z, azimuth, dip, total_depth
    surveys: DataFrame  # hole_id, ord, depth_m, azimuth, dip
    intervals: DataFrame  # hole_id, ord, from_m, to_m, unit
    pile: DataFrame  # unit, series, order_top_down
    orientations: DataFrame  # surface_name, x, y, z, dip, dip_direction, source
    digitised: DataFrame  # surface_name, x, y, z, source
    faults: DataFrame  # fault_name


def tables_of(documents: DataFrame) -> Spatial:
    """The tables of documents with the spatial schema (one document as a rule)."""
    each = lambda c: documents.select(F.posexplode(c).alias("ord", "e"))
    holes = each("boreholes")
    surveys = holes.select(F.col("e.hole_id").alias("hole_id"), F.posexplode("e.survey_points").alias("ord", "s")).select("hole_id", "ord", "s.depth_m", "s.azimuth", "s.dip")
    return Spatial(holes.select("e.hole_id", "ord", "e.x", "e.y", F.col("e.z_collar").alias("z"), "e.azimuth", "e.dip", F.col("e.total_depth_m").alias("total_depth")), surveys,
                   each("lithology_intervals").select("e.hole_id", "ord", "e.from_m", "e.to_m", F.col("e.unit_name").alias("unit")),
                   each("stratigraphic_pile").where("e.unit_name <> ''").select(F.col("e.unit_name").alias("unit"), F.col("e.series_name").alias("series"), "e.order_top_down"),
                   each("orientations").select("e.surface_name", "e.x", "e.y", "e.z", "e.dip", "e.dip_direction", "e.source"),
                   each("cross_section_points").select("e.surface_name", "e.x", "e.y", "e.z", "e.source"), each("faults").select("e.fault_name"))


@dataclass
class ModelInputs:
    points: DataFrame  # x, y, z, surface, hole_id, source
    orientations: DataFrame  # x, y, z, dip, dip_direction, surface, polarity, source
    series: DataFrame  # surface, series, place
    extent: DataFrame  # one row
    traces: DataFrame  # stations
    notes: DataFrame  # kind, subject, n


def matched(rows: DataFrame, collars: DataFrame, traces: DataFrame) -> DataFrame:
    """rows (hole_id, md, surface) with `hole`, the hole with a trace that their id means, or null."""
    known = collars.join(traces.select("hole_id").distinct(), "hole_id", "left_semi")
    return drill.match_holes(rows, known.select("hole_id", "ord"))


def placed(rows: DataFrame, traces: DataFrame) -> DataFrame:
    """matched() rows on the traces of their holes."""
    return drill.positions(rows.where("hole is not null").select(F.col("hole").alias("hole_id"), "md", "surface"), traces)


def surface_points(spatial: Spatial, contacts: DataFrame, traces: DataFrame, envelope_units: list[str] = ()) -> DataFrame:
    """x, y, z, surface, hole_id, source: matched contacts, tops and bases of the wanted units, and digitised points."""
    found = placed(contacts, traces).withColumn("source", F.lit("contact"))
    if envelope_units:
        ends = matched(drill.envelopes(spatial.intervals, list(envelope_units)), spatial.collars, traces)
        found = found.unionByName(placed(ends, traces).withColumn("source", F.lit("envelope")))
    d = spatial.digitised.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull() & (F.coalesce("surface_name", F.lit("")) != ""))
    d = d.select("x", "y", "z", F.trim("surface_name").alias("surface"), F.lit(None).cast("string").alias("hole_id"), F.coalesce(F.nullif("source", F.lit("")), F.lit("digitized cross-section")).alias("source"))
    return found.select("x", "y", "z", "surface", "hole_id", "source").unionByName(d)


def given_orientations(orientations: DataFrame, series: DataFrame) -> DataFrame:
    """Orientations on modelled surfaces, whatever the case of their names; those without a place or a dip are left out."""
    s = series.select("surface", F.lower("surface").alias("low_"))
    rows = orientations.join(s, F.lower(F.trim("surface_name")) == F.col("low_"))
    rows = rows.where(" and ".join(f"{c} is not null" for c in ("x", "y", "z", "dip", "dip_direction")))
    return rows.select("x", "y", "z", "dip", "dip_direction", "surface", F.lit(1).alias("polarity"), F.coalesce(F.nullif("source", F.lit("")), F.lit("extracted")).alias("source"))


def derived_orientations(points: DataFrame, series: DataFrame, given: DataFrame) -> DataFrame:
    """For each series without an orientation the plane through its surface with most points, of those that have a plane."""
    open_series = series.join(series.join(given.select("surface").distinct(), "surface", "left_semi").select("series").distinct(), "series", "left_anti")
    mean = points.groupBy("surface").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in "xyz"))
    fits = open_series.join(drill.planes(points), "surface").where("dip is not null").join(mean, "surface")
    best = fits.withColumn("r_", F.row_number().over(Window.partitionBy("series").orderBy(F.desc("n"), "place"))).where("r_ = 1")
    told = F.concat(F.lit("derived: plane fit through "), F.col("n").cast("string"), F.lit(" contact points"))
    return best.select("x", "y", "z", F.round("dip", 2).alias("dip"), F.round("dip_direction", 2).alias("dip_direction"), "surface", F.lit(1).alias("polarity"), told.alias("source"))


def notes(spatial: Spatial, points: DataFrame, series: DataFrame, contacts: DataFrame) -> DataFrame:
    """kind, subject, n of what was left out: few points, pile units and orientations without a surface, unmatched holes, faults."""
    note = lambda rows, kind, subject, n=F.lit(None): rows.select(F.lit(kind).alias("kind"), subject.cast("string").alias("subject"), n.cast("bigint").alias("n"))
    counted = points.groupBy("surface").agg(F.count(F.lit(1)).alias("n"))
    low = series.select(F.lower("surface").alias("low_"))
    unit = F.trim("unit")
    missed = contacts.where("hole is null and hole_id is not null").select("hole_id").distinct()
    first = missed.orderBy("hole_id").limit(8).agg(F.array_join(F.array_sort(F.collect_list("hole_id")), ", ").alias("ids"))
    ids = first.crossJoin(missed.agg(F.count(F.lit(1)).alias("n"))).where("n > 0")
    named = spatial.orientations.where(F.trim("surface_name") != "").join(low, F.lower(F.trim("surface_name")) == F.col("low_"), "left_anti")
    placeless = spatial.orientations.join(low, F.lower(F.trim("surface_name")) == F.col("low_"), "left_semi").where(" or ".join(f"{c} is null" for c in ("x", "y", "z", "dip", "dip_direction")))
    orphans = series.join(spatial.pile.select(F.lower(unit).alias("low_")), F.lower("surface") == F.col("low_"), "left_anti")
    parts = [note(counted.where("n < 2"), "surface with one point", F.col("surface"), F.col("n")), note(spatial.pile.join(low, F.lower(unit) == F.col("low_"), "left_anti"), "pile unit without points", unit),
             note(orphans, "not in the pile, placed by height", F.col("surface")), note(ids, "contacts of unknown holes", F.col("ids"), F.col("n")), note(named, "orientation without a surface", F.trim("surface_name")),
             note(placeless, "orientation without place or dip", F.trim("surface_name")), note(spatial.faults, "fault, not modelled", F.coalesce("fault_name", F.lit("?")))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def assemble(spatial: Spatial, envelope_units: list[str] = (), check: bool = True) -> ModelInputs:
    """All inputs of a model. With check, two points for no surface, or a series without an orientation, are errors.

    Traces, matched contacts and points are kept, as everything else is made of them; what is lost is computed again.
    """
    traces = drill.stations(spatial.surveys, spatial.collars).persist()
    contacts = matched(drill.contacts(spatial.intervals), spatial.collars, traces).persist()
    found = surface_points(spatial, contacts, traces, envelope_units).persist()
    points = drill.supported(found)
    means = points.groupBy("surface").agg(F.avg("z").alias("mean_z"))
    series = drill.series_order(spatial.pile, means)
    given = given_orientations(spatial.orientations, series)
    derived = derived_orientations(points, series, given)
    both = given.unionByName(derived)
    if check:
        if points.isEmpty():
            raise ValueError("no surface has two contact points: there is nothing to model")
        bare = series.join(series.join(both.select("surface"), "surface", "left_semi").select("series").distinct(), "series", "left_anti")
        names = sorted({r.series for r in bare.select("series").distinct().limit(8).collect()})
        if names:
            raise ValueError(f"series without an orientation or a plane: {', '.join(names)}; give a default orientation")
    around = points.select("x", "y", "z").unionByName(traces.select("x", "y", "z"))
    return ModelInputs(points, both, series, drill.extent(around), traces, notes(spatial, found, series, contacts))


def meta(inputs: ModelInputs, document: DataFrame, resolution: int) -> DataFrame:
    """One row about a model: its source, extent, series, sources of orientations, notes and counts."""
    e = inputs.extent.select(F.array(*(f"{c}_{b}" for c in "xyz" for b in ("min", "max"))).alias("extent"))
    lists = inputs.series.groupBy("series").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "surface"))), lambda x: x["surface"]).alias("surfaces"), F.min("place").alias("place"))
    mapping = lists.agg(F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("place", "series", "surfaces"))), lambda x: F.struct(x["series"], x["surfaces"]))).alias("series_mapping"))
    sources = inputs.orientations.agg(F.sort_array(F.collect_list("source")).alias("orientation_sources"), F.count(F.lit(1)).alias("orientations"))
    told = inputs.notes.agg(F.sort_array(F.collect_list(F.concat_ws(": ", "kind", "subject"))).alias("notes"))
    counts = inputs.points.agg(F.count(F.lit(1)).alias("surface_points")).crossJoin(inputs.traces.agg(F.countDistinct("hole_id").alias("holes")))
    one = document.limit(1).select("source_file", F.coalesce("confirmed", F.lit(False)).alias("confirmed"), "coordinate_system", F.lit(resolution).alias("resolution"))
    for part in (e, mapping, sources, told, counts):
        one = one.crossJoin(F.broadcast(part))
    return one.select("source_file", "confirmed", "coordinate_system", "resolution", "extent", "series_mapping", "orientation_sources", "notes", F.struct("surface_points", "orientations", "holes").alias("counts"))
