"""Smaller queries, each for one rule: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from orelode.functions import text
from orelode.operators import chapters, chunks, peers, routing
from orelode.plans import relations as rel
from orelode.plans.text_queries import HEAD_CTE, TURNS, turns
from orelode.sources.files import section_pages
from orelode.streaming import ingest


def read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def manifest(spark, d):
    return ingest.manifest_of(read(spark, d, "documents"))


MANIFEST = "SELECT source, count(text) || ':' || sum(CAST('0x' || substr(md5(text), 1, 15) AS HUGEINT)) AS fingerprint FROM documents GROUP BY source"


def changed_sources(spark, d):
    docs = read(spark, d, "documents")
    later = docs.withColumn("text", F.when(F.col("doc_id") % 97 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return ingest.changed(ingest.manifest_of(later), ingest.manifest_of(docs)).select("source")


CHANGED = "SELECT DISTINCT source FROM documents WHERE doc_id % 97 = 5"


def assessed(spark, d):
    t = read(spark, d, "conversations")
    q = F.when(F.col("turn") % 2 == 0, "Is it a go?").otherwise("Where does it lie?")
    a = F.element_at(F.array(*(F.lit(x) for x in ("a clear No-Go", "Conditional  go on permits", "further work", "go", "open"))), (F.col("conv_id") % 5 + 1).cast("int"))
    return t.select("conv_id", "turn", text.assessment(q, a, (F.col("conv_id") % 7).cast("int")).alias("assessment"))


ASSESSED = r"""
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN CASE conv_id % 5 WHEN 0 THEN 'No-Go' WHEN 1 THEN 'Conditional Go' WHEN 2 THEN 'Further Work' WHEN 3 THEN 'Go'
  ELSE CASE WHEN conv_id % 7 >= 4 THEN 'No-Go' WHEN conv_id % 7 >= 2 THEN 'Conditional Go' WHEN conv_id % 7 = 1 THEN 'Further Work' ELSE 'Go' END END END AS assessment
FROM conversations
"""
TEMPLATES = [(1, "first", "thth"), (2, "second", "ou"), (3, "second", "er"), (4, "third", "a")]


def templates(spark, d):
    return routing.first_template(turns(spark, d), spark.createDataFrame(TEMPLATES, "ord int, name string, keyword string"))


TEMPLATE_SQL = f"""
WITH q AS (SELECT id, lower(text) AS t FROM ({TURNS}))
SELECT id, CASE WHEN contains(t, 'thth') THEN 'first' WHEN contains(t, 'ou') OR contains(t, 'er') THEN 'second' WHEN contains(t, 'a') THEN 'third' END AS template FROM q
"""


def topic_items(spark, d):
    q = read(spark, d, "part").select("p_partkey", F.concat_ws(" ", F.lit("On"), "p_name", F.when(F.col("p_partkey") % 3 == 0, "Tonnage and NPV").when(F.col("p_partkey") % 3 == 1, "Closure   permits")).alias("t"))
    return q.select("p_partkey", F.array_join(routing.topic_items(F.col("t")).cast("array<string>"), ",").alias("items"))


TOPIC_SQL = """
SELECT p_partkey, array_to_string(list_sort(list_distinct(CASE WHEN p_partkey % 3 = 0 THEN [14, 10, 22, 21, 19] WHEN p_partkey % 3 = 1 THEN [20] ELSE [] END || CASE WHEN contains(lower(p_name), 'go') THEN [25, 26, 1] ELSE [] END
  || CASE WHEN p_partkey % 3 = 2 AND NOT contains(lower(p_name), 'go') THEN [1, 25] ELSE [] END)), ',') AS items FROM part
"""


def keyword_scores(spark, d):
    words = text.keywords(F.lit("What are THE house-rules of den thor, and thor?"), ["what", "are", "the", "and"])
    return read(spark, d, "documents").select("doc_id", text.overlap(F.col("text"), words).alias("score"))


KEYWORD_SQL = "SELECT doc_id, CAST(contains(lower(text), 'house-rules') AS INT) + CAST(contains(lower(text), 'den') AS INT) + CAST(contains(lower(text), 'thor') AS INT) AS score FROM documents"


def figure_pages(spark, d):
    pages = rel.load(spark, d, rel.PAGES).withColumn("text", F.concat(F.col("text"), F.when(F.col("page") % 5 == 0, F.concat(F.lit("\n Figure 3-"), "page", F.lit(" Plan looking north\nFigure 9 Long section"))).otherwise("")))
    return section_pages(pages)


FIGURE_SQL = f"WITH {HEAD_CTE} SELECT source, page, 'Figure 3-' || page || ' Plan looking north' AS caption FROM h WHERE page % 5 = 0"


def tagged_chunks(spark, d):
    """Chunks of all pages with the chapter that their page is in."""
    pages = rel.load(spark, d, rel.PAGES)
    tags = chapters.tag_pages(pages.select("source", "page"), chapters.chapter_ranges(pages))
    rows = chunks.page_chunks(pages.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n"))))
    return rows.join(tags, ["source", "page"]).select("chunk_id", "source", "page", "chunk", "ni_item", "section_title")


def number_texts(spark, d):
    return read(spark, d, "part").select("p_partkey", peers.short_number(F.floor("p_retailprice") / 8).alias("t"))


NUMBER_SQL = """
SELECT p_partkey, regexp_replace(regexp_replace(printf('%.3f', v), '0+$', ''), '\\.$', '') AS t
FROM (SELECT p_partkey, round(floor(p_retailprice) / 8, CASE WHEN floor(p_retailprice) / 8 >= 100 THEN 1 WHEN floor(p_retailprice) / 8 >= 10 THEN 2 ELSE 3 END) AS v FROM part)
"""

def inferred(spark, d):
    """The field that a question means, for questions made of two words."""
    words = ["cut-off", "NPV", "irr", "capital cost", "capex", "Operating cost", "recovery", "dilution", "mining recovery", "structure"]
    w = F.element_at(F.array(*(F.lit(x) for x in words)), (F.col("p_partkey") % 10 + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", peers.inferred_field(F.concat(F.lit("What about the "), w, F.lit("?"))).alias("field"))


INFERRED = "SELECT p_partkey, ['cutoff_grade', 'post_tax_npv', 'irr', 'initial_capex', 'initial_capex', 'opex', 'recovery_rate', 'dilution', 'recovery_rate', NULL][p_partkey % 10 + 1] AS field FROM part"


def histories(spark, d):
    """The last ten pairs of each dialog as text."""
    pairs = routing.turn_pairs(read(spark, d, "conversations"))
    listed = pairs.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "question", "answer"))), lambda x: F.struct(x["question"].alias("question"), x["answer"].alias("answer"))).alias("p"))
    return listed.select("conv_id", text.history_text(F.col("p")).alias("history"))


HISTORIES = """
WITH u AS (SELECT *, lag(role) OVER w AS br, lag(text) OVER w AS bt FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, turn, bt AS q, text AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM u WHERE role = 'assistant' AND br = 'user')
SELECT conv_id, string_agg('User: ' || q || chr(10) || 'Assistant: ' || a, chr(10) || chr(10) ORDER BY turn) AS history FROM p WHERE r <= 10 GROUP BY conv_id
"""

QUERIES = {
    "manifest": (manifest, MANIFEST), "changed_sources": (changed_sources, CHANGED), "assessments": (assessed, ASSESSED), "template_match": (templates, TEMPLATE_SQL), "topic_items": (topic_items, TOPIC_SQL),
    "keyword_scores": (keyword_scores, KEYWORD_SQL), "section_captions": (figure_pages, FIGURE_SQL), "tagged_chunks": (tagged_chunks, None), "short_numbers": (number_texts, NUMBER_SQL), "inferred_fields": (inferred, INFERRED), "histories": (histories, HISTORIES),
}
