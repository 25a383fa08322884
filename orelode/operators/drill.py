"""Drill-hole geometry: desurveying by minimum curvature, positions at depth, contacts, planes and extents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orelode.functions.text import canonical_hole_id, hole_id


def lerp_angle(a: Column, b: Column, t: Column) -> Column:
    """Along the shorter arc, in 0 to 360."""
    return F.pmod(a + (F.pmod(b - a + 180.0, F.lit(360.0)) - 180.0) * t, F.lit(360.0))


def step(length: Column, az1: Column, dip1: Column, az2: Column, dip2: Column) -> dict[str, Column]:
    """East, north and up displacement of a minimum-curvature step."""
    i1, i2 = F.radians(90.0 - F.abs(dip1)), F.radians(90.0 - F.abs(dip2))
    a1, a2 = F.radians(az1), F.radians(az2)
    cosine = F.cos(i2 - i1) - F.sin(i1) * F.sin(i2) * (1.0 - F.cos(a2 - a1))
    bend = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    factor = F.when(bend < 1e-9, 1.0).otherwise(2.0 / bend * F.tan(bend / 2.0))
    half = length / 2.0 * factor
    return {"de": half * (F.sin(i1) * F.sin(a1) + F.sin(i2) * F.sin(a2)), "dn": half * (F.sin(i1) * F.cos(a1) + F.sin(i2) * F.cos(a2)), "dz": -half * (F.cos(i1) + F.cos(i2))}


def stations(surveys: DataFrame, collars: DataFrame) -> DataFrame:
    """hole_id, ord, md, azimuth, dip, x, y, z from surveys (hole_id, ord, depth_m, azimuth, dip) and collars.

    Rows without depth or dip are left out; a missing azimuth is carried on, or that of the collar. A station at depth 0
    and one at total depth are added where missing. Holes need an id, x and y; a missing z is 0, a missing dip vertical.
    Of collars with one id the last counts, by their column `ord` if they have it: a hole has one trace. Surveys and
    collars meet in one shuffle by hole.
    """
    c = collars.where((F.trim("hole_id") != "") & F.col("x").isNotNull() & F.col("y").isNotNull())
    collar = F.struct("x", "y", F.coalesce("z", F.lit(0.0)).alias("z"), F.coalesce("azimuth", F.lit(0.0)).alias("caz"), F.coalesce("dip", F.lit(-90.0)).alias("cdip"), "total_depth")
    place = F.struct(*([F.col("ord").cast("bigint")] if "ord" in c.columns else []), "x", "y", collar.alias("rest"))
    c = c.groupBy("hole_id").agg(F.max_by(collar, place).alias("c"))
    s = surveys.where(F.col("depth_m").isNotNull() & F.col("dip").isNotNull()).select("hole_id", F.col("ord").cast("int").alias("ord"), F.col("depth_m").alias("md"), "azimuth", "dip", F.lit(False).alias("is_collar"))
    both = s.unionByName(c.select("hole_id", "c", F.lit(True).alias("is_collar")), allowMissingColumns=True)
    every = Window.partitionBy("hole_id")
    both = both.select("hole_id", "ord", "md", "azimuth", "dip", "is_collar", F.max("c").over(every).alias("c"), F.min("md").over(every).alias("first"), F.max("md").over(every).alias("last"),
                       F.max_by("dip", F.when(~F.col("is_collar"), F.struct("md", "ord"))).over(every).alias("ldip")).where("c is not null")
    station = lambda ord_, md, azimuth, dip: F.struct(F.lit(ord_).cast("int").alias("ord"), md.cast("double").alias("md"), azimuth.cast("double").alias("azimuth"), dip.cast("double").alias("dip"))
    top = F.when(F.col("first").isNull() | (F.col("first") > 1e-9), station(-1, F.lit(0.0), F.col("c.caz"), F.col("c.cdip")))
    tail = F.when(F.col("c.total_depth") > F.coalesce("last", F.lit(0.0)) + 1e-9, station(2**30, F.col("c.total_depth"), F.lit(None), F.coalesce("ldip", "c.cdip")))
    own = F.array(F.struct(F.col("ord"), F.col("md").cast("double").alias("md"), F.col("azimuth").cast("double").alias("azimuth"), F.col("dip").cast("double").alias("dip")))
    rows = both.select("hole_id", "c.*", F.explode(F.when(F.col("is_collar"), F.array_compact(F.array(top, tail))).otherwise(own)).alias("s")).select("hole_id", "x", "y", "z", "caz", "s.*")
    w = Window.partitionBy("hole_id").orderBy("md", "ord")
    rows = rows.withColumn("azimuth", F.coalesce(F.last("azimuth", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("caz")))
    rows = rows.select("*", F.lag("md").over(w).alias("m0"), F.lag("azimuth").over(w).alias("a0"), F.lag("dip").over(w).alias("d0"))
    moved = step(F.col("md") - F.col("m0"), F.col("a0"), F.col("d0"), F.col("azimuth"), F.col("dip"))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    at = {k: F.coalesce(F.sum(v).over(run), F.lit(0.0)) for k, v in moved.items()}
    return rows.select("hole_id", F.row_number().over(w).alias("ord"), "md", "azimuth", "dip", (F.col("x") + at["de"]).alias("x"), (F.col("y") + at["dn"]).alias("y"), (F.col("z") + at["dz"]).alias("z"))


def positions(points: DataFrame, trace: DataFrame) -> DataFrame:
    """points (hole_id, md, ...) with x, y, z on the trace; depths outside count as the nearer end. Points off any hole go.

    Of a trace's segments the first that reaches the depth is joined, so each point finds one, and repeated points stay.
    """
    w = Window.partitionBy("hole_id").orderBy("ord")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = trace.select("hole_id", F.row_number().over(w).alias("n_"), *(F.col(c).alias(c + "1") for c in ("md", "azimuth", "dip", "x", "y", "z")), *(F.lead(c).over(w).alias(c + "2") for c in ("md", "azimuth", "dip")),
                         F.min("md").over(every).alias("lo"), F.max("md").over(every).alias("hi"))
    parts = parts.where(F.col("md2").isNotNull() | (F.col("n_") == 1))
    names = {"p_" + str(i): c for i, c in enumerate(points.columns)}
    p = points.select(*(F.col(c).alias(k) for k, c in names.items()), F.col("hole_id"), F.col("md"))
    at = F.greatest(F.col("lo"), F.least(F.col("hi"), F.col("md")))
    both = p.join(parts, "hole_id").where((F.coalesce("md2", F.col("md1")) >= at - 1e-9) & ((F.col("n_") == 1) | (F.col("md1") < at - 1e-9)))
    length = at - F.col("md1")
    t = F.when(F.coalesce("md2", F.col("md1")) > F.col("md1"), length / (F.col("md2") - F.col("md1"))).otherwise(0.0)
    moved = step(length, F.col("azimuth1"), F.col("dip1"), lerp_angle(F.col("azimuth1"), F.coalesce("azimuth2", "azimuth1"), t), F.col("dip1") + (F.coalesce("dip2", "dip1") - F.col("dip1")) * t)
    return both.select(*(F.col(k).alias(c) for k, c in names.items()), (F.col("x1") + moved["de"]).alias("x"), (F.col("y1") + moved["dn"]).alias("y"), (F.col("z1") + moved["dz"]).alias("z"))


def total_depths(trace: DataFrame) -> DataFrame:
    """hole_id, total_md: the depth of the last station, or 0."""
    return trace.groupBy("hole_id").agg(F.coalesce(F.max_by("md", "ord"), F.lit(0.0)).alias("total_md"))


def contacts(intervals: DataFrame) -> DataFrame:
    """hole_id, md, surface: where the unit changes along a hole, named by the unit below. intervals (hole_id, ord, from_m, unit)."""
    rows = intervals.where(F.col("from_m").isNotNull() & (F.trim("unit") != "")).withColumn("unit", F.trim("unit"))
    w = Window.partitionBy("hole_id").orderBy("from_m", "ord")
    rows = rows.withColumn("above", F.lag("unit").over(w))
    return rows.where(F.lower("above") != F.lower("unit")).select("hole_id", F.col("from_m").alias("md"), F.col("unit").alias("surface"))


def envelopes(intervals: DataFrame, units: list[str]) -> DataFrame:
    """Top and base of every interval of the wanted units."""
    wanted = intervals.where(F.lower(F.trim("unit")).isin([u.lower() for u in units]))
    ends = F.explode(F.array(F.struct(F.col("from_m").alias("md"), F.concat(F.trim("unit"), F.lit(" (top)")).alias("surface")), F.struct(F.col("to_m").alias("md"), F.concat(F.trim("unit"), F.lit(" (base)")).alias("surface"))))
    return wanted.select("hole_id", ends.alias("e")).select("hole_id", "e.md", "e.surface").where("md is not null")


def match_holes(rows: DataFrame, holes: DataFrame) -> DataFrame:
    """rows with `hole`, the id of holes (hole_id, ord) that theirs means: equal ids first (the last), else canonical ones (the first)."""
    exact = holes.groupBy(hole_id(F.col("hole_id")).alias("e_")).agg(F.max_by("hole_id", "ord").alias("exact_"))
    canon = holes.groupBy(canonical_hole_id(F.col("hole_id")).alias("c_")).agg(F.min_by("hole_id", "ord").alias("canon_"))
    # Keys are columns, as a sort by an expression would compute it at every comparison.
    out = rows.withColumn("re_", hole_id(F.col("hole_id"))).withColumn("rc_", canonical_hole_id(F.col("hole_id")))
    out = out.join(exact, F.col("re_") == F.col("e_"), "left").join(canon, F.col("rc_") == F.col("c_"), "left")
    return out.select(*rows.columns, F.coalesce("exact_", "canon_").alias("hole"))


def supported(points: DataFrame, least: int = 2) -> DataFrame:
    few = points.groupBy("surface").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("surface")
    return points.join(few, "surface", "left_semi")


def series_order(pile: DataFrame, surfaces: DataFrame, default: str = "Strat_Series") -> DataFrame:
    """surface, series, place: surfaces in pile order from the top, those not in the pile after them from the highest down."""
    p = pile.select(F.lower(F.trim("unit")).alias("u_"), F.coalesce(F.nullif(F.trim("series"), F.lit("")), F.lit(default)).alias("series"), F.col("order_top_down").alias("o_"))
    rows = surfaces.join(p, F.lower("surface") == F.col("u_"), "left")
    w = Window.orderBy(F.col("u_").isNull(), F.col("o_").asc_nulls_last(), F.when(F.col("u_").isNull(), -F.col("mean_z")), "surface")
    return rows.select("surface", F.coalesce("series", F.lit(default)).alias("series"), F.row_number().over(w).alias("place"))


def extent(points: DataFrame) -> DataFrame:
    """Padded bounds: 15 % of the wider side in plan (of 100 at least), 25 % in height (of 50 at least)."""
    b = points.agg(*(f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))))
    wide = F.greatest(F.col("hix") - F.col("lox"), F.col("hiy") - F.col("loy"), F.lit(100.0)) * 0.15
    high = F.greatest(F.col("hiz") - F.col("loz"), F.lit(50.0)) * 0.25
    pad = {"x": wide, "y": wide, "z": high}
    return b.select(*((F.col(f"lo{c}") - pad[c]).alias(f"{c}_min") for c in "xyz"), *((F.col(f"hi{c}") + pad[c]).alias(f"{c}_max") for c in "xyz"))


def plane(x: np.ndarray) -> tuple[float, float] | None:
    """Dip and dip direction of the plane that fits points best; None if they are fewer than three, in line, or it stands upright."""
    if len(x) < 3:
        return None
    _, s, v = np.linalg.svd(x - x.mean(0))
    n = v[2]
    if s[1] < 1e-9 or abs(n[2]) < 1e-9:
        return None
    n = n * np.sign(n[2])
    dip = float(np.degrees(np.arccos(min(1.0, n[2]))))
    return dip, float(np.degrees(np.arctan2(n[0], n[1])) % 360.0) if dip > 1e-9 else 0.0


def planes(points: DataFrame, by: str = "surface") -> DataFrame:
    """Per surface: dip and dip_direction from the 3 x 3 covariance of its points, which is what is gathered of each."""
    c = points.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *(F.covar_pop(a, b).alias(a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                m = np.array([[r.xx, r.xy, r.xz], [r.xy, r.yy, r.yz], [r.xz, r.yz, r.zz]])
                value, vector = np.linalg.eigh(m)
                n = vector[:, 0] * (np.sign(vector[2, 0]) or 1)
                bad = r.n < 3 or np.sqrt(max(0.0, value[1] * r.n)) < 1e-9 or abs(n[2]) < 1e-9
                dip = float(np.degrees(np.arccos(min(1.0, n[2]))))
                out.append((r[0], None if bad else dip, None if bad else float(np.degrees(np.arctan2(n[0], n[1])) % 360.0) if dip > 1e-9 else 0.0))
            yield pd.DataFrame(out, columns=[by, "dip", "dip_direction"])

    return c.mapInPandas(run, f"{by} string, dip double, dip_direction double")


def anchor_error(a1: Column, a2: Column) -> Column:
    """Why two anchors struct(px, py, x, y, z) don't define a section; null if they do."""
    same = lambda f: F.abs(a2.getField(f) - a1.getField(f)) < 1e-9
    return (F.when(same("px") | same("py"), "anchors share a pixel row or column").when(same("z"), "anchors share an elevation")
            .when(same("x") & same("y"), "anchors share a place in plan"))


def pixel_to_world(px: Column, py: Column, a1: Column, a2: Column, strict: bool = False) -> Column:
    """struct(x, y, z) of a pixel between two anchors: columns go along the section, rows in elevation.

    Anchors with an anchor_error() give null, or end the query if strict.
    """
    error = anchor_error(a1, a2)
    t, u = F.try_divide(px - a1.px, a2.px - a1.px), F.try_divide(py - a1.py, a2.py - a1.py)
    at = F.struct((a1.x + t * (a2.x - a1.x)).alias("x"), (a1.y + t * (a2.y - a1.y)).alias("y"), (a1.z + u * (a2.z - a1.z)).alias("z"))
    return F.when(error.isNull(), at).otherwise(F.raise_error(error).cast("struct<x:double,y:double,z:double>")) if strict else F.when(error.isNull(), at)
