import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from orelode.operators import assembly, drill, estimates
from orelode.schema import SPATIAL
from orelode.sources import files, sinks


def spatial(**more):
    holes = [{"hole_id": h, "x": float(x), "y": float(y), "z_collar": 300.0, "dip": -90.0, "total_depth_m": 100.0, "survey_points": []} for h, x, y in (("HX06-01", 0, 0), ("HX06-02", 100, 0), ("HX06-03", 0, 100))]
    depth = {"HX-06-1": 40.0, "HX06-02": 50.0, "HX06-03": 40.0, "lost": 5.0}
    rows = [{"hole_id": h, "from_m": a, "to_m": b, "unit_name": u} for h, m in depth.items() for a, b, u in ((0.0, m, "Till"), (m, 100.0, "Ore "))]
    return {"source_file": "a.pdf", "coordinate_system": "UTM", "boreholes": holes, "lithology_intervals": rows, "stratigraphic_pile": [{"unit_name": "ore", "series_name": "S", "order_top_down": 1}, {"unit_name": "Till"}],
            "orientations": [], "faults": [{"fault_name": "F1"}], "cross_section_points": [], "confirmed": True} | more


def frame(spark, doc):
    return spark.read.schema(SPATIAL).json(spark.sparkContext.parallelize([json.dumps(doc)]))


def test_points_series_and_a_plane_of_a_document(spark):
    doc = frame(spark, spatial())
    m = assembly.assemble(assembly.tables_of(doc))
    assert sorted((r.x, r.y, round(r.z, 6), r.surface, r.hole_id) for r in m.points.collect()) == [(0.0, 0.0, 260.0, "Ore", "HX06-01"), (0.0, 100.0, 260.0, "Ore", "HX06-03"), (100.0, 0.0, 250.0, "Ore", "HX06-02")]
    assert [tuple(r) for r in m.series.collect()] == [("Ore", "S", 1)]
    o = m.orientations.first()
    assert (o.surface, o.dip, o.dip_direction, o.source) == ("Ore", 5.71, 90.0, "derived: plane fit through 3 contact points")
    e = m.extent.first()
    assert (e.x_min, e.x_max, e.z_min, e.z_max) == (-15.0, 115.0, 175.0, 325.0)
    assert sorted((r.kind, r.subject, r.n) for r in m.notes.collect()) == [("contacts of unknown holes", "lost", 1), ("fault, not modelled", "F1", None), ("pile unit without points", "Till", None)]
    row = assembly.meta(m, doc, 50).first()
    assert (row.resolution, row.confirmed, row.series_mapping, tuple(row["counts"])) == (50, True, {"S": ["Ore"]}, (3, 1, 3)) and row.extent[:2] == [-15.0, 115.0]


def test_envelopes_and_given_orientations(spark):
    given = {"surface_name": "ORE (base)", "x": 1.0, "y": 2.0, "z": 3.0, "dip": 10.0, "dip_direction": 20.0}
    t = assembly.tables_of(frame(spark, spatial(orientations=[given, {"surface_name": "ore"}, {"surface_name": "none", "x": 1.0}], cross_section_points=[{"surface_name": " Vein ", "x": 1.0, "y": 1.0, "z": 1.0}])))
    m = assembly.assemble(t, ["ore"], check=False)
    assert {r.surface: r.n for r in m.points.groupBy("surface").agg(F.count(F.lit(1)).alias("n")).collect()} == {"Ore": 3, "Ore (top)": 3, "Ore (base)": 3}
    assert {(r.surface, r.source.split(":")[0]) for r in m.orientations.collect()} == {("Ore (base)", "extracted"), ("Ore", "derived")}
    assert {(r.kind, r.subject) for r in m.notes.collect()} >= {("surface with one point", "Vein"), ("orientation without a surface", "none"), ("orientation without place or dip", "ore")}


def test_what_cannot_be_modelled_is_an_error(spark):
    t = assembly.tables_of(frame(spark, spatial()))
    with pytest.raises(ValueError, match="nothing to model"):
        assembly.assemble(replace(t, intervals=t.intervals.limit(0)))
    flat = replace(t, intervals=t.intervals.where("hole_id <> 'HX06-03'"))
    with pytest.raises(ValueError, match="series without an orientation"):
        assembly.assemble(flat)
    surface = estimates.default_surface(t.pile.withColumn("ord", F.lit(0)).limit(0), t.intervals).first().surface
    assert surface == "Ore" and estimates.orientation_of("30, 90, Till") == (30.0, 90.0, "Till") and estimates.orientation_of("30,90")[2] is None
    with pytest.raises(ValueError):
        estimates.orientation_of("30")
    assumed = estimates.default_orientation(t.collars, surface, 30.0, 90.0)
    m = assembly.assemble(replace(flat, orientations=t.orientations.unionByName(assumed.drop("polarity"))))
    assert [(r.dip, r.source) for r in m.orientations.collect()] == [(30.0, "assumed by the user")]


def test_only_confirmed_documents_are_loaded(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(spatial()))
    (tmp_path / "b.json").write_text(json.dumps(spatial(confirmed=False)))
    folder = str(tmp_path)
    assert files.confirmed(spark, folder, "x/a.pdf").first().source_file == "a.pdf" and files.confirmed(spark, folder, "b.pdf", allow_unconfirmed=True).first().confirmed is False
    with pytest.raises(ValueError, match="not confirmed"):
        files.confirmed(spark, folder, "b.pdf")
    with pytest.raises(FileNotFoundError):
        files.confirmed(spark, folder, "c.pdf")


CLICKS = "section_id string, datum string, a1 struct<px:double,py:double,x:double,y:double,z:double>, a2 struct<px:double,py:double,x:double,y:double,z:double>, px double, py double, surface_name string"
A1, A2 = (0.0, 0.0, 100.0, 200.0, 50.0), (10.0, 20.0, 200.0, 200.0, -50.0)


def test_digitised_points(spark, tmp_path):
    rows = [("S1", "amsl", A1, A2, 0.0, 0.0, "Vein"), ("S1", None, A1, A2, 5.0, 30.0, " Vein "), ("S1", "", A1, A2, 1.0, 1.0, "  ")]
    clicks = spark.createDataFrame(rows, CLICKS)
    folder = str(tmp_path / "points")
    assert sinks.append_points(clicks.limit(0), folder) == 0 and not files.exists(spark, folder)
    assert sinks.append_points(clicks, folder) == 2 and sinks.append_points(clicks, folder) == 2
    found = spark.read.parquet(folder)
    assert sorted({(r.surface_name, r.x, r.y, r.z) for r in found.collect()}) == [("Vein", 100.0, 200.0, 50.0), ("Vein", 150.0, 200.0, -100.0)] and found.count() == 4
    assert found.where("x = 100").first().source == "digitized S1 [amsl] px(0.0,0.0); anchors (100.0,200.0,50.0)@px(0.0,0.0) / (200.0,200.0,-50.0)@px(10.0,20.0)"
    for bad in ((0.0, 20.0, 200.0, 200.0, -50.0), (10.0, 0.0, 200.0, 200.0, -50.0), (10.0, 20.0, 200.0, 200.0, 50.0), (10.0, 20.0, 100.0, 200.0, -50.0)):
        frame_ = spark.createDataFrame([("S", None, A1, bad, 1.0, 1.0, "v")], CLICKS)
        assert frame_.select(drill.pixel_to_world(F.col("px"), F.col("py"), F.col("a1"), F.col("a2")).alias("w")).first().w is None
        with pytest.raises(Exception, match="anchors share"):
            sinks.digitised(frame_).collect()
