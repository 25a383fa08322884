from pyspark.sql import functions as F

from orelode.operators import estimates, routing
from orelode.operators.ask import Corpus, ask
from orelode.schema import REPORT


def corpus(spark):
    chunks = spark.createDataFrame([(i, [float(i), 1.0], "a.pdf", i % 30, "table" if i == 3 else "text", f"gold text {i}", i, "T") for i in range(40)], "id long, embedding array<float>, source string, ni_item int, type string, text string, page int, section_title string")
    rules = spark.createDataFrame([(1, "gold grade", [14], [10])], "ord int, pattern string, primary array<int>, cross array<int>")
    items = spark.createDataFrame([(14, "Resources", "How much?", ["tonnes", "grade"]), (10, "Drilling", "Where?", [])], "item int, title string, question string, gather array<string>")
    matrices = spark.createDataFrame([(1, "14 - 15", ["Search: estimate", "Flag: x; y"])], "ord int, key string, lines array<string>")
    reports = spark.createDataFrame([("a.pdf", "gold", "vein", "peru", "pea", "open pit"), ("b.pdf", "gold", "vein", "chile", "pea", ""), ("c.pdf", "iron", "", "", "", "")], "source_file string, commodity string, deposit_type string, country string, study_stage string, mining_method string")
    return Corpus(chunks, rules, items, matrices, reports)


def test_offline_answer(spark):
    a = ask(spark, corpus(spark), "Which gold grade do peers have?", [10.0, 1.0], k=3, target="a.pdf")
    assert (a.primary, a.cross) == ([14], [10]) and a.playbook == "## Item 14: Resources\nDD question: How much?\nGather: tonnes; grade\nSearch: estimate\nFlag: x; y"
    assert {p for _, p in a.sources} <= {10, 14} and a.peers == ["b.pdf", "c.pdf"] and "Routed items: [14]" in a.text
    assert ask(spark, corpus(spark), "Which gold grade?", [1.0, 1.0], model=lambda p: "yes").text == "yes\n\n**Assessment:** Go"
    b = ask(spark, corpus(spark), "What permits?", [1.0, 1.0], k=2, model=lambda p: 1 / 0)
    assert b.primary == [20] and b.text.startswith("Model failed")


def test_playbook_names_a_matrix_once(spark):
    c = corpus(spark)
    matrices = spark.createDataFrame([(1, "10-14", ["Search: s"])], "ord int, key string, lines array<string>")
    wanted = spark.createDataFrame([(0, 0, 14), (0, 1, 10), (0, 2, 3)], "id int, pos int, item int")
    assert routing.playbooks(wanted, c.items, matrices).first().playbook == "## Item 14: Resources\nDD question: How much?\nGather: tonnes; grade\nSearch: s\n\n## Item 10: Drilling\nDD question: Where?"


def test_estimates(spark):
    rows = [("a", {"economics": {"post_tax_npv": "US$5 M", "pre_tax_npv": "12.5"}}), ("b", {"economics": {"post_tax_npv": "1_000"}}), ("c", {"mineral_resources": [{"cut_off_grade": "0.3"}, {"cut_off_grade": "0.3 g/t"}]})]
    df = spark.createDataFrame([tuple({"source_file": s, **v}.get(f.name) for f in REPORT.fields) for s, v in rows], REPORT)
    assert [(r.source_file, r.value) for r in estimates.values(df, "npv").collect()] == [("a", 12.5)]
    assert [(r.source_file, r.value) for r in estimates.values(df, "cutoff").collect()] == [("c", 0.3)]
    assert estimates.values(df, "nothing").count() == 0
    many = spark.createDataFrame([("f", i, f"r{i}", i / 4, "") for i in range(10)], "field string, pos int, source_file string, value double, unit string")
    assert estimates.summaries(many).first().summary == "r0: 0; r1: 0.25; r2: 0.5; r3: 0.75; r4: 1; r5: 1.25; r6: 1.5; r7: 1.75 (+2 more)"
    names = estimates.unit_names(*(spark.createDataFrame(x, "ord int, name string") for x in ([(1, "A"), (2, "A")], [(1, "B"), (2, "A")], [(1, "F"), (2, "B")])))
    assert [r.name for r in names.orderBy("place").collect()] == ["A", "A", "B", "F"]
    sse = spark.createDataFrame([(1, 'data: {"type": "meta"}\n\ndata: broken\n\ndata: {"type": "done", "x": 1}\n\n')], "id int, text string")
    assert [r.type for r in estimates.decoded_events(sse).orderBy("pos").collect()] == ["meta", "done"]
    assert '"authors"' not in estimates.slim(df).first().document
    assert estimates.default_orientation(spark.createDataFrame([(1.0, 2.0, None), (3.0, 4.0, 6.0)], "x double, y double, z double"), "s", 30.0, 90.0).first().z == 3.0
    assert estimates.values(df, "recovery").count() == 0 and estimates.values(df, "cutoff_grade").first().unit == ""
