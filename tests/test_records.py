import json

import pytest
from pyspark.sql import functions as F

from orelode.operators import chunks, estimates, extraction, gather, peers, routing, views
from orelode.operators.ask import Tools, ask, stream
from orelode.schema import REPORT
from orelode.sources import files, sinks

REPORTS = [
    {"source_file": "a.pdf", "report_title": "A", "issuer": "I, Inc", "report_date": "2020", "primary_commodity": "Gold", "property_info": {"country": "usa", "commodities": ["au", "Cu"], "project_stage": "PEA", "latitude": 1.0, "longitude": 2.0},
     "mineral_resources": [{"category": "Measured", "tonnes": 4e6, "grades": [{"commodity": "Au", "grade_value": 1.25, "grade_unit": "g/t"}]}, {"category": "Inferred", "tonnes": 1.0}], "economics": {"post_tax_npv": "", "pre_tax_npv": "US$2 billion", "initial_capex": "5"}, "qualified_persons": [{"name": "x"}]},
    {"source_file": "b.pdf", "property_info": {"country": "Peru", "commodities": ["gold"]}, "economics": {"initial_capex": "10"}, "mining_method": {"method": "Open Pit"}},
    {"source_file": "c.pdf", "report_date": "2021", "property_info": {"country": "Peru"}, "economics": {"initial_capex": "12"}},
]


def reports(spark):
    return spark.read.schema(REPORT).json(spark.sparkContext.parallelize([json.dumps(r) for r in REPORTS]))


def test_views(spark):
    r = reports(spark)
    row = views.portfolio(r).where("source_file = 'a.pdf'").first()
    assert (row.country, row.stage, row.commodities, row.mi_tonnes, row.npv_raw, row.npv_millions, row.irr) == ("United States", "PEA", "Gold; Copper", 4e6, "US$2 billion", 2000.0, None)
    assert [x.source_file for x in views.recent(r).collect()] == ["c.pdf", "a.pdf", "b.pdf"]
    assert views.searched(r, "  ").count() == 0 and views.searched(r, "B.PDF").first().source_file == "b.pdf"
    assert [tuple(x) for x in views.map_marks(r, "copp").collect()] == [("a.pdf", 1.0, 2.0, "A", 11.0, "#F59E0B")]
    compared = {x.label: (x.r1, x.r2) for x in views.compared(r, ["b.pdf", "a.pdf", "b.pdf"]).collect()}
    assert compared["M+I Tonnes"] == ("—", "4.00 Mt") and compared["Qualified Persons"] == ("0", "1") and len(compared) == 11
    assert {x.label: x.value for x in views.overview(r.where("source_file = 'a.pdf'")).collect()}["Resource rows"] == "2"
    assert views.exploration(r).count() == 0 and views.property_and_geology(r).count() == 39
    assert [(x.grade, x.grades) for x in views.estimates(r).orderBy("ord").collect()] == [("1.25 g/t", "Au: 1.25 g/t"), ("—", "—")]


def test_documents_are_saved_and_found(spark, tmp_path):
    folder = str(tmp_path / "docs")
    sinks.save_documents(reports(spark), folder)
    sinks.save_documents(reports(spark).where("source_file = 'b.pdf'").withColumn("issuer", F.lit("new")), folder)
    table = sinks.read_documents(spark, folder, REPORT)
    assert {(x.stem, x.issuer) for x in table.collect()} == {("a", "I, Inc"), ("b", "new"), ("c", None)}
    assert files.document(table, "x/b.pdf").first().issuer == "new" and files.document(table, "z.pdf").count() == 0
    assert files.resolved(table.withColumn("stem", F.lit("other")), " A.PDF ").first().source_file == "a.pdf"
    chapters = spark.createDataFrame([("r.pdf", 2, 5, "Five", 9, None), ("r.pdf", 1, 4, "Four", 3, 8)], "source string, ord int, item int, title string, page_start int, page_end int")
    sinks.save_chapters(chapters, folder)
    assert sinks.read_documents(spark, folder, REPORT).where("stem = 'r_chapters'").count() == 1
    flat = tmp_path / "flat"
    flat.mkdir()
    (flat / "r_chapters.json").write_text('[{"item": 4, "title": "Four", "page_start": 3, "page_end": 8}, {"item": 5, "title": "Five", "page_start": 9, "page_end": null}]')
    (flat / "s_chapters.json").write_text("{broken")
    assert [(x.source, x.item, x.page_end) for x in files.chapter_index(spark, str(flat)).orderBy("ord").collect()] == [("r", 4, 8), ("r", 5, None)]
    assert files.chapter_index(spark, str(tmp_path / "none")).count() == 0
    kept = str(tmp_path / "manifest")
    for prints in (["1"], ["2", "3"]):
        sinks.save_manifest(spark.createDataFrame([(f"s{i}", p) for i, p in enumerate(prints)], "source string, fingerprint string"), kept)
    assert sorted(x.fingerprint for x in files.manifest(spark, kept).collect()) == ["2", "3"] and files.manifest(spark, kept + "x").count() == 0
    sinks.portfolio_csv(views.portfolio(reports(spark)).orderBy("source_file"), str(tmp_path / "csv"))
    lines = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()
    assert lines[0].split(",")[:3] == ["source_file", "report_title", "issuer"] and '"I, Inc"' in lines[1] and len(lines) == 4


def test_landing_and_listing(spark, tmp_path):
    folder = str(tmp_path / "in")
    with pytest.raises(ValueError):
        sinks.land(spark, {"a.pdf": b"1", "b.txt": b"2"}, folder)
    sinks.land(spark, {"b.pdf": b"12", "a.PDF": b"1"}, folder)
    assert [(x.name, x.length) for x in files.listing(spark, folder, "*.{pdf,PDF}", [folder, str(tmp_path / "no")]).collect()] == [("a.PDF", 1), ("b.pdf", 2)]
    with pytest.raises(FileNotFoundError):
        files.listing(spark, str(tmp_path / "no"), "*")
    with pytest.raises(FileNotFoundError):
        sinks.delete_documents(spark, folder, ["b.pdf", "z.pdf"])
    sinks.delete_documents(spark, folder, ["b.pdf"])
    assert files.listing(spark, folder, "*").count() == 1
    assert spark.createDataFrame([("reid-zone__2.html",)], "n string").select(files.model_label(F.col("n")).alias("x")).first().x == ("reid zone 2", "reid_zone_2")
    pages = files.pages_of(spark, folder, lambda data: [(1, data.decode()), (2, "  ")], "*.PDF")
    assert [tuple(x) for x in pages.collect()] == [("a.PDF", 1, "1")]
    assert files.pages_of(spark, folder, lambda data: 1 / 0, "*.PDF").count() == 0


def test_page_responses(spark):
    good = "primary_language: en\nis_rotation_valid: true\nrotation_correction: 90\nis_table: false\nis_diagram: true\nnatural_text: |\n  one\n  two"
    rows = [good, f"```yaml\n{good}\n```", f"```\n{good}\n``` ", "", "a: [", "- 1\n- 2", "scalar", None, "natural_text:"]
    found = [x.r for x in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").orderBy("i").select(files.page_response(F.col("t")).alias("r")).collect()]
    assert found[0] == found[1] == found[2] == ("en", True, 90, False, True, "one\ntwo") and found[3:8] == [None] * 5 and found[8].natural_text is None


RULES = {"items": [{"number": 14, "title": "Resources", "gather_fields": ["t"], "dd_question": "How much?"}], "query_lookup": [{"question_pattern": "grade", "primary_items": [14], "cross_check_items": [10]}],
         "routing_matrices": {"15 - 14": {"search": "s", "cross_check": [3, 4], "extract": [], "compare": ["c"], "flag": ["Thin data.", "Old data"]}, "14": {"search": "never"}},
         "benchmark_templates": [{"name": "B", "keywords": ["typical", "usual"], "search_criteria": ["x"]}], "core_dd_questions": ["q1", "q2"]}


def test_rule_tables(spark, tmp_path):
    (tmp_path / "rules.json").write_text(json.dumps(RULES))
    t = files.rule_tables(spark, str(tmp_path / "rules.json"))
    wanted = spark.createDataFrame([(0, 0, 14)], "id int, pos int, item int")
    assert routing.playbooks(wanted, t["items"], t["matrices"]).first().playbook == "## Item 14: Resources\nDD question: How much?\nGather: t\nSearch: s\nCross-check Items: 3, 4\nCompare: c\nFlag: Thin data.; Old data"
    assert files.template(t["templates"], "B").first().search_criteria == ["x"] and files.template(t["templates"], "C").count() == 0
    assert [x.question for x in t["questions"].orderBy("ord").collect()] == ["q1", "q2"]


def test_settings(monkeypatch):
    monkeypatch.setenv("ORELODE_TOP_K", "3")
    assert (files.Settings.from_env().top_k, files.Settings.from_env().chunk_size) == (3, 1400)


def table_of_chunks(spark):
    rows = [(i, [float(i), 0.0], "a.pdf" if i < 30 else "b.pdf", i % 3 * 7, "table" if i % 10 == 0 else "text", f"gold text {i}", i, 0, "T") for i in range(60)]
    return spark.createDataFrame(rows, "id long, embedding array<float>, source string, ni_item int, type string, text string, page int, chunk int, section_title string")


def test_gathering(spark):
    queries = [(1, 0, "Location", None, 0, "where", [0.0, 0.0]), (2, 0, "Location", None, 1, "where", [1.0, 0.0]), (3, 1, None, 7, 0, "what", [5.0, 0.0])]
    catalogue = spark.createDataFrame(queries, "query_id int, block_ord int, topic string, item int, query_ord int, question string, query array<float>")
    found = {x.file: x.context for x in gather.for_topics(table_of_chunks(spark), catalogue, 6).collect()}
    assert set(found) == {"a.pdf", "b.pdf"}
    heads = [line for line in found["a.pdf"].splitlines() if line.startswith("###")]
    assert heads == ["### Context for: Location", "### Context for: Item 7"]
    labels = [line.split(" page ")[1] for line in found["a.pdf"].splitlines() if line.startswith("[")]
    assert len(labels) == len(set(labels)) and set(labels[:3]) == {"0", "10", "20"}
    found = gather.with_variants(table_of_chunks(spark), catalogue.where("query_id = 1").select("query_id", "block_ord", "question", "query"), 2, types=["table"], most=60)
    assert all(x.context.startswith("### Context for: where\n[1] ") and x.context.endswith("\n… [context truncated]") for x in found.collect())
    once = gather.distinct_queries(catalogue.select("query_id", "question"))
    assert {x.question: x.query_ids for x in once.collect()} == {"where": [1, 2], "what": [3]}
    sources = spark.createDataFrame([(0, i, "a", i - 1) for i in range(12)], "id int, pos int, source string, page int")
    assert [x.page for x in gather.gallery(sources).orderBy("pos").collect()] == list(range(1, 9))
    assert routing.sources_once(sources.union(sources), ["source", "page"]).count() == 12


def test_extraction_by_passes(spark):
    catalogue = spark.createDataFrame([(1, 0, "Location", None, 0, "where", [0.0, 0.0])], "query_id int, block_ord int, topic string, item int, query_ord int, question string, query array<float>")
    prompts = extraction.contexts(table_of_chunks(spark), [extraction.Pass("identity", catalogue), extraction.Pass("money", catalogue)], 2)
    assert prompts.count() == 4 and "FOCUS FOR THIS PASS: identity" in prompts.where("pass = 0").first().prompt

    def model(prompt):
        if "b.pdf" in prompt:
            raise ValueError("no answer")
        return json.dumps({"issuer": "I"} if "identity" in prompt else {"issuer": "late", "report_title": "T", "authors": ["x"]})

    parts = extraction.read_by(prompts, model, REPORT, 1)
    assert {(x.source_file, x.error) for x in parts.collect()} == {("a.pdf", None), ("b.pdf", "no answer")}
    rows = {x.source_file: x for x in extraction.records(prompts, parts).collect()}
    assert (rows["a.pdf"].issuer, rows["a.pdf"].report_title, rows["a.pdf"].authors) == ("I", "T", ["x"]) and rows["b.pdf"].issuer is None
    assert [x.source_file for x in extraction.not_yet(prompts.select("source_file").distinct(), spark.createDataFrame([("a",)], "stem string")).collect()] == ["b.pdf"]
    waits, tries = [], iter([RuntimeError("Error 429"), RuntimeError("rate limit"), RuntimeError("request timed out"), None])

    def call():
        if error := next(tries):
            raise error
        return "done"

    assert extraction.patiently(call, sleep=waits.append) == "done" and waits == [60, 120, 15]
    with pytest.raises(KeyError):
        extraction.patiently(lambda: {}["x"], sleep=waits.append)


def test_benchmarks_of_records(spark):
    r = reports(spark)
    v = estimates.values(r, "initial_capex").withColumn("is_target", F.col("source_file") == "a.pdf")
    assert [(e.source_file, e.value, e.unit, e.pos) for e in peers.entries(v).orderBy("pos").collect()] == [("b.pdf", 10.0, "USD", 1), ("c.pdf", 12.0, "USD", 2), ("a.pdf", 5.0, "USD", 3)]
    assert peers.range_texts(v).first().text == "Field 'initial_capex': peer_n=2, peer_range=[10, 12], peer_median=11."
    assert peers.benchmark(v).first().outliers == 1
    d = {x.source_file: (x.commodity, x.country, x.mining_method) for x in peers.descriptions(r).collect()}
    assert d == {"a.pdf": ("gold", "usa", ""), "b.pdf": ("gold", "peru", "open pit"), "c.pdf": ("", "peru", "")}
    kind = REPORT["mining_method"].dataType
    assert [x[0] for x in r.orderBy("source_file").select(estimates.scalar(F.col("mining_method"), kind)).collect()] == [None, "Open Pit", None]


def corpus(spark):
    from orelode.operators.ask import Corpus

    items = spark.createDataFrame([(14, "Resources", "How much?", ["t"])], "item int, title string, question string, gather array<string>")
    rules = spark.createDataFrame([(1, "capex", [14], [7])], "ord int, pattern string, primary array<int>, cross array<int>")
    matrices = spark.createDataFrame([(1, "14", ["Flag: High strip ratio; Thin data."])], "ord int, key string, lines array<string>")
    templates = spark.createDataFrame([(1, "B", "typical")], "ord int, name string, keyword string")
    r = reports(spark).withColumn("stem", F.regexp_replace("source_file", ".pdf", ""))
    return Corpus(table_of_chunks(spark), rules, items, matrices, peers.descriptions(r), [], r, templates)


def test_chain_of_tools(spark):
    prompts = []
    a = ask(spark, corpus(spark), "Is the capex typical, should we invest?", [3.0, 0.0], 4, "a.pdf", lambda p: prompts.append(p) or "There is a risk: high strip ratio.", [("before", "told")])
    assert a.tools == ["route_question", "get_routing_playbook", "search_by_items", "search_by_items", "get_extraction", "find_peer_reports", "benchmark_field"]
    assert (a.primary, a.cross, a.template, a.peers) == ([14], [7], "B", ["b.pdf", "c.pdf"])
    assert {s for s, _ in a.sources} == {"a.pdf"} and "### Structured extraction: a.pdf" in prompts[0] and "User: before" in prompts[0] and "peer_range=[10, 12]" in a.peer_text
    assert a.flags == ["High strip ratio", "Target value 5 is outside the peers' range [10, 12]"] and a.assessment == "Conditional Go" and a.text.endswith("**Assessment:** Conditional Go")
    b = ask(spark, corpus(spark), "Where is it?", lambda text: [1.0, 0.0])
    assert "Tools called: route_question -> get_routing_playbook -> search_by_items" in b.text and b.assessment is None
    t = Tools(spark, corpus(spark), "x", lambda text: [1.0, 0.0])
    assert json.loads(t.record())["error"] and set(t.all()) == {"route_question", "search_by_items", "get_extraction", "find_peer_reports", "benchmark_field", "get_routing_playbook"}
    assert t.benchmark("opex")["count"] == 0 and t.search("14", "gold")["items_searched"] == [14]


def test_events_of_an_answer(spark):
    def tokens(prompt):
        yield "a"
        raise ValueError("lost")

    kinds = [e["type"] for e in stream(spark, corpus(spark), "Where?", [1.0, 0.0], tokens)]
    assert kinds == ["status", "status", "meta", "token", "done"]

    def none(prompt):
        raise ValueError("lost")

    assert [e["type"] for e in stream(spark, corpus(spark), "Where?", [1.0, 0.0], none)][-1] == "error"


def test_page_parts(spark):
    table = "<table><tr><td>1</td></tr></table>"
    pages = spark.createDataFrame([("s", 2, f"x {table}", False), ("s", 1, table, False), ("s", 3, f"d {table}", True), ("s", 4, "", False)], "source string, page int, text string, is_diagram boolean")
    assert sorted((x.page, x.chunk, x.type, x.text) for x in chunks.page_parts(pages).collect()) == [(1, 1000, "table", "| 1 |\n| --- |"), (2, 0, "text", "x"), (2, 1001, "table", "| 1 |\n| --- |"), (3, 1002, "table", "| 1 |\n| --- |")]
