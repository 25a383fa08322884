import json
import math
import random
import re
from html import unescape
from html.entities import html5

import numpy as np
from pyspark.sql import functions as F

from orelode.functions import html, text
from orelode.operators import chapters, chunks, drill, merge, peers, portfolio, retrieval, routing
from orelode.sources import files
from orelode.streaming import ingest


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


def expected_chunks(paragraphs, size, overlap, before=""):
    """As many paragraphs as fit, then those of the rest, whose first has the end of this chunk before it."""
    if not paragraphs:
        return []
    head = "\n\n".join(x for x in (before, paragraphs[0]) if x)[:size]
    taken = max(k for k in range(1, len(paragraphs) + 1) if k == 1 or len("\n\n".join([head, *paragraphs[1:k]])) <= size)
    chunk = "\n\n".join([head, *paragraphs[1:taken]])
    return [chunk, *expected_chunks(paragraphs[taken:], size, overlap, chunk[len(chunk) - overlap if overlap < len(chunk) else 0 :].strip() if overlap else "")]


def plain_chunks(t, size, overlap):
    return expected_chunks([p.strip() for p in re.split(r"\n\s*\n", t.strip()) if p.strip()], size, overlap)


def test_chunks_match_a_plain_loop(spark):
    r = random.Random(1)
    texts = ["", "  ", "one"] + ["".join(r.choice(["ab ", "c\n", "\n\n", "\n \n", "word "]) for _ in range(r.randint(1, 60))) for _ in range(120)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for size, overlap in ((20, 0), (30, 7)):
        found = {r.i: r.c for r in df.select("i", chunks.chunks(F.col("t"), size, overlap).alias("c")).collect()}
        assert found == {i: plain_chunks(t, size, overlap) for i, t in enumerate(texts)}


def test_ranges_match_a_plain_loop(spark):
    r = random.Random(2)
    rows = [(s, p, f"{r.randint(1, 5)}. Heading" if r.random() < 0.3 else "text") for s in "abc" for p in range(1, 40)]
    pages = spark.createDataFrame(rows, "source string, page int, text string")
    found = chapters.chapter_ranges(pages)
    tags = {(t.source, t.page): t.ni_item for t in chapters.tag_pages(pages.select("source", "page"), found).collect()}
    for s in "abc":
        heads = [(p, int(t[0])) for q, p, t in rows if q == s and t != "text"]
        spans = [(p, n, max(p, heads[i + 1][0] - 1) if i + 1 < len(heads) else None) for i, (p, n) in enumerate(heads)]
        for p in range(1, 40):
            inside = [n for a, n, b in spans if a <= p and (b is None or p <= b)]
            assert tags[s, p] == (inside[0] if inside else 0)


def test_repeated_rows_stay(spark):
    pages = spark.createDataFrame([("a", 2, "x"), ("a", 2, "x"), ("a", 1, "3. Head"), ("b", 9, "Item 4\nx"), ("b", None, "x"), ("b", 0, "7. Zero")], "source string, page int, text string")
    tagged = chapters.tag_pages(pages, chapters.chapter_ranges(pages.where("source = 'a'")), "text", {4: "Property"})
    assert tagged.columns == ["source", "page", "text", "ni_item", "section_title"]
    assert sorted((r.source, str(r.page), r.ni_item, r.section_title) for r in tagged.collect()) == [("a", "1", 3, "Head"), ("a", "2", 3, "Head"), ("a", "2", 3, "Head"), ("b", "0", 7, "Zero"), ("b", "9", 4, "Property"), ("b", "None", 0, "")]
    old = pages.where("page = 2").withColumn("ni_item", F.lit(9)).withColumn("section_title", F.lit("old")).withColumn("chunk_id", F.lit("k"))
    again = chapters.retagged(old.unionByName(old.withColumn("source", F.lit("other"))), pages.where("source = 'a'"))
    assert sorted((r.source, r.ni_item, r.section_title, r.chunk_id) for r in again.collect()) == [("a", 3, "Head", "k")] * 2 + [("other", 9, "old", "k")] * 2


def test_headings(spark):
    for t, expected in (("Item 14 — Mineral Resources", (14, "Mineral Resources")), ("14.1 Foo bar", (14, "1 Foo bar")), ("see item 9 here", (None, None)), ("Item 9\nx", (9, "Item 9")), ("99. Nothing", (None, None))):
        found = one(spark, chapters.heading(F.col("t")), t=t)
        assert (found.item, found.title) == expected


def test_text_helpers(spark):
    assert one(spark, text.canonical_hole_id(F.col("t")), t=" hx06-01 ") == one(spark, text.canonical_hole_id(F.col("t")), t="HX-06-1") != one(spark, text.canonical_hole_id(F.col("t")), t="HX-06-10")
    assert one(spark, text.canonical_hole_id(F.col("t")), t="DH-000") == "DH0"
    assert one(spark, text.item_list(F.col("t")), t="14, 3;x 28 3") == [14, 3, 3]
    for t, value, currency in (("US$1.2 billion", 1200.0, "USD"), ("C$1,250 million", 1250.0, "CAD"), ("A$500 k", 0.5, "AUD"), ("€3 bn", 3000.0, "EUR"), ("n/a", None, "USD"), ("", None, None)):
        m = one(spark, text.money(F.col("t")), t=t)
        assert m.value == value and m.currency == currency
    assert [one(spark, text.stage(F.col("t")), t=t) for t in ("Pre-feasibility study", "Producing", "Prefeasibility", "PEA", "")] == ["Pre-Feasibility", "Operating", "Pre-Feasibility", "PEA", "Other"]
    assert [one(spark, text.commodity(F.col("t")), t=t) for t in ("Au", "Coal", "Limestone", "Zirconium")] == ["Gold", "Cobalt", "Lithium", "Zirconium"]
    assert one(spark, text.truncated(F.col("t"), 3, "…"), t="abcdef") == "abc…"
    assert one(spark, text.assessment(F.col("q"), F.col("a"), F.lit(2)), q="Invest?", a="Unclear.") == "Conditional Go"
    assert one(spark, text.assessment(F.col("q"), F.col("a"), F.lit(9)), q="Where is it?", a="Yes") is None
    assert one(spark, text.assessment(F.col("q"), F.col("a"), F.lit(0)), q="Is it a go?", a="Conditional  go") == "Conditional Go"
    assert one(spark, text.with_assessment(F.col("a"), F.lit("Go")), a="Yes. \n") == "Yes.\n\n**Assessment:** Go"
    assert [one(spark, text.is_greeting(F.col("t")), t=t) for t in ("Bye!", " thank you ?", "hello there", "ok" + "!" * 60)] == [True, True, False, False]
    blocks = "array(named_struct('text', 'a', 'content', 'z'), named_struct('text', '', 'content', 'b'), named_struct('text', null, 'content', null))"
    assert spark.range(1).select(text.joined_content(F.expr(blocks))).first()[0] == "ab"
    assert spark.range(1).select(text.history_text(F.expr("array(named_struct('question', 'q', 'answer', 'a'))")), text.history_text(F.expr("slice(array(named_struct('question', 'q', 'answer', 'a')), 1, 0)"))).first()[:] == ("User: q\nAssistant: a", "None")
    prompt = one(spark, text.chat_prompt(F.lit("i"), F.lit("c"), F.col("q")), q='say "x"')
    assert json.loads(prompt.split("\n\n", 1)[1]) == {"instruction": "i", "context": "c", "question": 'say "x"'}
    grades = "array(named_struct('commodity', 'Au', 'grade_value', 1.5D, 'grade_unit', 'g/t'), named_struct('commodity', null, 'grade_value', 2D, 'grade_unit', null), named_struct('commodity', 'Ag', 'grade_value', null, 'grade_unit', 'x'))"
    assert spark.range(1).select(text.grades_text(F.expr(grades)), text.grades_text(F.expr(f"slice({grades}, 3, 1)"))).first()[:] == ("Au: 1.50 g/t • 2.00", "—")
    assert [one(spark, text.short_tonnes_text(F.col("t")), t=t) for t in (2.5e6, 1500.0, 12.0)] == ["2.50 Mt", "1.5 kt", "12 t"]
    assert [one(spark, text.amount_text(F.col("t"), F.lit("oz")), t=t) for t in (2.5e6, 1500.0, 12.0)] == ["2.500M oz", "1.5K oz", "12 oz"]
    assert [one(spark, text.commodity_colour(F.col("t")), t=t) for t in ("Gold", "Tin", "")] == ["#F59E0B", "#9CA3AF", "#9CA3AF"]
    assert one(spark, text.escaped(F.col("t")), t="a<b>&") == "a&lt;b&gt;&amp;"
    assert one(spark, text.answer_event("meta", n=F.col("t")), t=1) == 'data: {"type":"meta","n":1}\n\n'
    for v in (0.2, 12345.678, 0.00001234, 1.0, 999.96, 0.0, 123.456):
        assert one(spark, peers.short_number(F.col("v")), v=v) == f"{v:.4g}"


def test_tables(spark):
    t = "intro <TABLE><tr><th>a</th><th>b|c</th></tr><tr><td>1 &lt; 2</td></tr></TABLE> end ![f](x.png)"
    found = one(spark, html.split_tables(F.col("t")), t=t)
    assert found.body == "intro  end" and found.tables == "| a | b\\|c |\n| --- | --- |\n| 1 < 2 |  |"
    assert one(spark, html.split_tables(F.col("t")), t="<table>no rows</table>") == (None, "no rows")


def test_all_entities_are_decoded(spark):
    """Against html.unescape: every named reference, with and without its semicolon, and numeric ones."""
    names = [f"&{n}" for n in html5] + ["&copy;", "&middot", "&#169;", "&#xA9", "&#128;", "&#0;", "&unknown;", "&amp;lt;", "&notit;"]
    pages = [f"<p>a{n}\tb</p> {n}" for n in names] + [None]
    plain = lambda t: re.sub(r"[ \t]+", " ", unescape(re.sub(r"<[^>]+>", " ", t.replace("</p>", "\n")))).strip()
    cell = lambda t: re.sub(r"\s+", " ", unescape(t)).strip().replace("|", "\\|")
    df = spark.createDataFrame([(i, p, None if p is None else f"<table><tr><td>x{n}y</td></tr></table>") for i, (p, n) in enumerate(zip(pages, [*names, ""], strict=True))], "i int, p string, t string")
    found = {r.i: r for r in df.select("i", html.html_text(F.col("p")).alias("p"), html.split_tables(F.col("t")).alias("t")).collect()}
    assert [found[i].p for i in range(len(pages))] == [None if p is None else plain(p) for p in pages]
    assert [found[i].t.tables for i in range(len(names))] == [f"| {cell(f'x{n}y')} |\n| --- |" for n in names]


def test_benchmark_outliers(spark):
    df = spark.createDataFrame([("f", "a", 0.2, False), ("f", "b", 0.3, False), ("f", "t", 0.5, True), ("g", "a", 1.0, False), ("g", "t", 1.0, True), ("h", "t", 4.0, True)], "field string, source_file string, value double, is_target boolean")
    found = {r.field: (r["count"], r.low, r.high, r.outliers) for r in peers.benchmark(df).collect()}
    assert found == {"f": (2, 0.2, 0.3, 1), "g": (1, 1.0, 1.0, 0), "h": (1, None, None, 0)}


def test_merges(spark):
    parts = spark.createDataFrame([("a", 1, None, [], "n1"), ("a", 2, "x", ["p"], "n2"), ("a", 3, "y", ["q"], "n1")], "source_file string, pass int, s string, l array<string>, notes string")
    assert merge.first_known(parts).select("s", "l").first() == ("x", ["p"])
    r = merge.concatenated(parts, ["l"], ["s"]).first()
    assert (r.l, r.s, r.notes, r.confirmed) == (["p", "q"], "x", "n1 | n2", False)
    assert [one(spark, merge.as_list(F.col("t")), t=t) for t in ("", " NULL ", " a ")] == [[], [], ["a"]]


def test_routing_and_pairs(spark):
    rules = spark.createDataFrame([(1, "resource", [14], [25, 14]), (2, "risk", [25], [3])], "ord int, pattern string, primary array<int>, cross array<int>")
    found = {r.id: r for r in routing.routed(spark.createDataFrame([(1, "What RESOURCE  risk?"), (2, "none")], "id int, text string"), rules).collect()}
    assert (found[1].primary_items, found[1].cross_items, found[1].matched) == ([14, 25], [3], ["resource", "risk"])
    assert found[2].primary_items == [1, 25] and found[2].matched == []
    turns = spark.createDataFrame([(1, i, r, f"{r}{i}") for i, r in enumerate(["user", "user", "system", "assistant", "assistant", "user", "assistant"])], "conv_id int, turn int, role string, text string")
    assert sorted((r.question, r.answer) for r in routing.turn_pairs(turns).collect()) == [("user1", "assistant3"), ("user5", "assistant6")]
    assert one(spark, routing.playbook_flags(F.lit("High strip ratio; Thin data; x"), F.col("t")), t="A risk: high strip ratios") == ["High strip ratio"]


def test_drill_geometry(spark):
    collars = spark.createDataFrame([("V", 0.0, 0.0, 300.0, None, None, 100.0), ("D", 0.0, 0.0, 0.0, 90.0, -60.0, 100.0), ("", 1.0, 1.0, 1.0, None, None, 5.0)], "hole_id string, x double, y double, z double, azimuth double, dip double, total_depth double")
    surveys = spark.createDataFrame([], "hole_id string, ord int, depth_m double, azimuth double, dip double")
    trace = drill.stations(surveys, collars)
    ends = {r.hole_id: (r.x, r.y, r.z) for r in trace.where("md = 100").collect()}
    assert ends["V"][2] == 200 and math.isclose(ends["D"][0], 50, abs_tol=1e-9) and math.isclose(ends["D"][2], -100 * math.sin(math.pi / 3), abs_tol=1e-9)
    points = spark.createDataFrame([("V", 50.0), ("V", 900.0), ("V", -5.0)], "hole_id string, md double")
    assert {r.md: round(r.z, 6) for r in drill.positions(points, trace).collect()} == {50.0: 250.0, 900.0: 200.0, -5.0: 300.0}
    assert drill.positions(points.union(points), trace).count() == 6
    assert {r.hole_id: r.total_md for r in drill.total_depths(trace).collect()} == {"V": 100.0, "D": 100.0}
    assert one(spark, drill.lerp_angle(F.lit(350.0), F.lit(10.0), F.lit(0.5))) == 0.0
    p = [(float(x), float(y), -float(x)) for x in range(3) for y in range(3)]
    assert np.allclose(drill.plane(np.array(p)), (45.0, 90.0))
    rows = [("a", *q) for q in p] + [("line", float(i), float(i), float(i)) for i in range(5)] + [("two", 0.0, 0.0, 0.0), ("two", 1.0, 0.0, 0.0)]
    found = {r.surface: (r.dip, r.dip_direction) for r in drill.planes(spark.createDataFrame(rows, "surface string, x double, y double, z double")).collect()}
    assert np.allclose(found["a"], (45.0, 90.0)) and found["two"] == (None, None)
    assert {r.surface for r in drill.supported(spark.createDataFrame(rows + [("solo", 0.0, 0.0, 0.0)], "surface string, x double, y double, z double")).collect()} == {"a", "line", "two"}


def test_filters_and_fallback(spark):
    assert retrieval.metadata_filter([], [0, -3], None) is None
    assert retrieval.over_fetch(8, 1000) == 32 and retrieval.over_fetch(2, 5) == 5
    strict = spark.createDataFrame([(1, 10)], "query_id int, id int")
    loose = spark.createDataFrame([(1, 11), (2, 12)], "query_id int, id int")
    assert sorted(tuple(r) for r in retrieval.relaxed(strict, loose).collect()) == [(1, 10), (2, 12)]
    rows = portfolio.with_totals(spark.createDataFrame([(1, 1, "A", 10.0, 1.0, 5.0, "g"), (1, 2, "A", 30.0, None, 0.0, "g"), (1, 3, None, 5.0, 2.0, 0.0, "g")], "report int, ord int, category string, tonnes double, grade double, metal double, grade_unit string"), ["report"])
    assert [(r.category, r.tonnes, r.grade, r.metal) for r in rows.where("kind = 'total'").collect()] == [("A", 40.0, 0.25, 5.0)]


def test_report_scan_and_ingest(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"source_file": "a.pdf", "mineral_resources": [{"category": "Measured", "tonnes": 5.0}]}))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "a_chapters.json").write_text("[]")
    assert [(r.stem, r.source_file) for r in files.reports(spark, str(tmp_path)).collect()] == [("a", "a.pdf")]
    folder, table = tmp_path / "pages", ingest.ChunkTable(spark, str(tmp_path / "chunks"))
    schema = "source string, page int, text string"
    spark.createDataFrame([("x", 1, "one\n\ntwo"), ("y", 1, "three")], schema).write.parquet(str(folder / "1"))
    for _ in range(2):
        ingest.ingest_stream(spark, str(folder / "*"), schema, table, str(tmp_path / "ck"))
        assert table.read().count() == 2
    spark.createDataFrame([("x", 1, "changed")], schema).write.parquet(str(folder / "2"))
    ingest.ingest_stream(spark, str(folder / "*"), schema, table, str(tmp_path / "ck"))
    assert sorted((r.source, r.text) for r in table.read().collect()) == [("x", "changed"), ("y", "three")]
    docs = spark.createDataFrame([("x", "1"), ("y", "2")], "source string, text string")
    known = ingest.manifest_of(docs)
    assert [r.source for r in ingest.changed(ingest.manifest_of(docs.withColumn("text", F.when(F.col("source") == "y", "3").otherwise(F.col("text")))), known).collect()] == ["y"]
    spark.createDataFrame([("x", 2, "second page"), ("y", 1, " "), ("a=b/c", 1, "odd name")], schema).write.parquet(str(folder / "3"))
    ingest.ingest_stream(spark, str(folder / "*"), schema, table, str(tmp_path / "ck"))
    assert sorted((r.source, r.page, r.text) for r in table.read().collect()) == [("a=b/c", 1, "odd name"), ("x", 1, "changed"), ("x", 2, "second page")]
    table.delete(["a=b/c", "nowhere"])
    assert sorted(r.page for r in table.read().collect()) == [1, 2] and table.read().columns == ["source", "page", "chunk", "text", "type", "chunk_id"]
