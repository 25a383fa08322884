"""Queries over pages, chunks, vectors and dialogs: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from orelode.functions import html, text
from orelode.operators import chapters, chunks, gather, retrieval, routing
from orelode.plans import relations as rel

P = rel.duck(rel.PAGES)


def read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def html_text(spark, d):
    return read(spark, d, "pages").select("page_id", html.html_text(F.col("html")).alias("body"))


# DuckDB has no table of entities; these are all that the given pages have, and the commonest others.
ENTITIES = {"&nbsp;": "\u00a0", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "''", "&apos;": "''", "&copy;": "©", "&middot;": "·", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&eacute;": "é", "&uuml;": "ü", "&amp;": "&"}


def _decoded(sql: str) -> str:
    for k, v in ENTITIES.items():
        sql = f"replace({sql}, '{k}', '{v}')"
    return sql


HTML_TEXT = rf"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?i)<br */?>|</(p|div|li|h1|h2|h3|h4|h5|h6|tr|table)>', chr(10), 'g'), '<[^>]+>', ' ', 'g') AS t FROM pages)
SELECT page_id, regexp_replace(regexp_replace({_decoded('t')}, '[ \t]+', ' ', 'g'), '^[\s ]+|[\s ]+$', '', 'g') AS body FROM a
"""


def table_markdown(spark, d):
    t = read(spark, d, "part").select("p_partkey", F.concat(
        F.lit("before ![x](a.png)\n<TABLE class='a'><tr><th>name</th><th>size | unit</th></tr><tr><td>"), "p_name", F.lit(" &amp; <b>"), "p_brand", F.lit("</b></td></tr><tr><td></td></tr></TABLE> after")).alias("t"))
    return t.select("p_partkey", html.split_tables(F.col("t")).alias("s")).select("p_partkey", "s.body", F.col("s.tables").alias("tables"))


TABLE_MARKDOWN = r"""
SELECT p_partkey, 'before ' || chr(10) || ' after' AS body,
       '| name | size \| unit |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_name || ' & ' || p_brand || ' |  |' AS tables
FROM part
"""


def chunk_ids(spark, d):
    return read(spark, d, "documents").select("doc_id", text.chunk_id(F.col("source"), (F.col("doc_id") % 50).cast("int"), F.lit(3), F.col("text")).alias("chunk_id"))


CHUNK_IDS = "SELECT doc_id, source || ':p' || (doc_id % 50) || ':c3:' || substr(md5(text), 1, 12) AS chunk_id FROM documents"


def page_chunks(spark, d):
    pages = rel.load(spark, d, rel.PAGES).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return chunks.page_chunks(pages)


# The packing is a recursion over the paragraphs of each page.
PAGE_CHUNKS = rf"""
WITH RECURSIVE pages0 AS ({P}), q AS (SELECT source, page, list_filter(list_transform(regexp_split_to_array(replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps FROM pages0),
r AS (SELECT source, page, ps, 0 AS i, 0 AS chunk, CAST(NULL AS VARCHAR) AS done, '' AS buf FROM q
  UNION ALL
  SELECT source, page, ps, i + 1, CASE WHEN i = len(ps) OR fits OR buf = '' THEN chunk ELSE chunk + 1 END, CASE WHEN i = len(ps) THEN nullif(buf, '') WHEN fits OR buf = '' THEN NULL ELSE buf END,
    CASE WHEN i = len(ps) THEN '' WHEN fits THEN joined ELSE substr(CASE WHEN buf = '' OR tail = '' THEN p ELSE tail || chr(10) || chr(10) || p END, 1, 1400) END
  FROM (SELECT *, CASE WHEN buf = '' THEN p ELSE buf || chr(10) || chr(10) || p END AS joined, length(CASE WHEN buf = '' THEN p ELSE buf || chr(10) || chr(10) || p END) <= 1400 AS fits, regexp_replace(right(buf, 150), '^\s+|\s+$', '', 'g') AS tail
        FROM (SELECT *, coalesce(ps[i + 1], '') AS p FROM r WHERE i <= len(ps))))
SELECT source, page, CAST(chunk - CASE WHEN i > len(ps) THEN 0 ELSE 1 END AS INT) AS chunk, done AS text, 'text' AS type,
  source || ':p' || page || ':c' || CAST(chunk - CASE WHEN i > len(ps) THEN 0 ELSE 1 END AS INT) || ':' || substr(md5(done), 1, 12) AS chunk_id
FROM r WHERE done IS NOT NULL
"""


def headings(spark, d):
    return rel.load(spark, d, rel.PAGES).select("source", "page", chapters.heading(F.col("text")).alias("h")).select("source", "page", "h.item", "h.title")


# Every seventh page begins with a heading, and no other page has one.
HEAD_CTE = f"""
n AS (SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS page FROM documents),
h AS (SELECT source, page, CASE WHEN page % 7 = 1 THEN CAST(floor((page - 1) / 7) AS INT) % 27 + 1 END AS item, CASE WHEN page % 7 = 1 THEN 'Section ' || page END AS title FROM n)
"""
HEADINGS = f"WITH {HEAD_CTE} SELECT source, page, item, title FROM h"


def chapter_ranges(spark, d):
    return chapters.chapter_ranges(rel.load(spark, d, rel.PAGES))


RANGES = f"""WITH {HEAD_CTE}, l AS (SELECT source, max(page) AS last FROM h WHERE item IS NOT NULL GROUP BY source)
SELECT source, CAST((page - 1) / 7 AS INT) + 1 AS ord, item, title, page AS page_start, CASE WHEN page < last THEN page + 6 END AS page_end FROM h JOIN l USING (source) WHERE item IS NOT NULL"""


def tagged_pages(spark, d):
    pages = rel.load(spark, d, rel.PAGES)
    return chapters.tag_pages(pages.select("source", "page"), chapters.chapter_ranges(pages))


TAGGED = f"WITH {HEAD_CTE} SELECT source, page, CAST(floor((page - 1) / 7) AS INT) % 27 + 1 AS ni_item, 'Section ' || (page - (page - 1) % 7) AS section_title FROM h"


def inline_tags(spark, d):
    """Pages tagged by chapters that begin on page 40 only; earlier pages by a heading of their own, a bare one by the catalogue."""
    titles = {9: "Exploration", 13: "Mineral Processing"}
    p = rel.load(spark, d, rel.PAGES)
    bare = F.when(F.col("page") % 5 == 2, F.concat(F.lit("Item "), (F.col("page") % 27 + 1).cast("string"), F.lit("\nsome text"))).otherwise(F.col("text"))
    p = p.withColumn("text", bare)
    found = chapters.chapter_ranges(p.where("page % 7 = 1 and page % 5 <> 2")).where("page_start >= 40")
    return chapters.tag_pages(p, found, "text", titles).select("source", "page", "ni_item", "section_title")


INLINE = f"""WITH {HEAD_CTE}, s AS (SELECT source, page AS start, item, title FROM h WHERE item IS NOT NULL AND page % 5 <> 2 AND page >= 40), a AS (SELECT h.source, h.page, max(start) AS start FROM h LEFT JOIN s ON s.source = h.source AND start <= page GROUP BY 1, 2)
SELECT a.source, a.page, coalesce(s.item, CASE WHEN a.page % 5 = 2 THEN a.page % 27 + 1 WHEN a.page % 7 = 1 THEN CAST(floor((a.page - 1) / 7) AS INT) % 27 + 1 END, 0) AS ni_item,
  coalesce(s.title, CASE WHEN a.page % 5 = 2 THEN CASE a.page % 27 + 1 WHEN 9 THEN 'Exploration' WHEN 13 THEN 'Mineral Processing' ELSE 'Item ' || (a.page % 27 + 1) END WHEN a.page % 7 = 1 THEN 'Section ' || a.page END, '') AS section_title
FROM a LEFT JOIN s ON s.source = a.source AND s.start = a.start"""


def page_parts(spark, d):
    """Two tables on every tenth page, and every fourth page a diagram: what becomes of each page."""
    p = rel.load(spark, d, rel.PAGES).withColumn("text", F.when(F.col("page") % 10 == 3, F.lit("body<table><tr><td>a</td></tr></table><TABLE>no cells</TABLE>")).otherwise("plain"))
    found = chunks.page_parts(p.withColumn("is_diagram", F.col("page") % 4 == 0))
    return found.select("source", "page", "chunk", "type", "text")


PARTS = f"""WITH {HEAD_CTE}
SELECT source, page, 0 AS chunk, 'text' AS type, CASE WHEN page % 10 = 3 THEN 'body' ELSE 'plain' END AS text FROM h WHERE page % 4 > 0
UNION ALL SELECT source, page, CAST(999 + row_number() OVER (PARTITION BY source ORDER BY page) AS INT), 'table', '| a |' || chr(10) || '| --- |' || chr(10) || chr(10) || 'no cells' FROM h WHERE page % 10 = 3"""


def vector_chunks(spark, d):
    e = read(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "embedding", F.concat(F.lit("file"), (F.col("label") % 5).cast("string")).alias("source"), (F.col("vec_id") % 28).cast("int").alias("ni_item"),
                    F.when(F.col("vec_id") % 6 == 0, "table").otherwise("text").alias("type"), F.concat(F.lit("drill core assay "), F.when(F.col("vec_id") % 3 == 0, "gold grade ").otherwise(""), F.when(F.col("vec_id") % 4 == 0, "tonnage").otherwise("map")).alias("text"),
                    F.col("vec_id").cast("int").alias("page"), F.lit("Drilling").alias("section_title"))


def vector_queries(spark, d):
    return read(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def knn(spark, d):
    return retrieval.nearest(vector_chunks(spark, d), vector_queries(spark, d), 8).select("query_id", "id", F.col("fetch_rank").alias("place"), F.floor(F.col("dist") * 1e6 + 0.5).cast("bigint").alias("dist6"))


V = """
v AS (SELECT vec_id AS id, embedding, 'file' || (label % 5) AS source, vec_id % 28 AS ni_item, CASE WHEN vec_id % 6 = 0 THEN 'table' ELSE 'text' END AS type,
       'drill core assay ' || CASE WHEN vec_id % 3 = 0 THEN 'gold grade ' ELSE '' END || CASE WHEN vec_id % 4 = 0 THEN 'tonnage' ELSE 'map' END AS text FROM embeddings),
q AS (SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % 50 = 0),
x AS (SELECT q.query_id, v.*, list_sum(list_transform(list_zip(embedding, query), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2]))) AS dist FROM v, q)
"""
KNN = f"""
WITH {V} SELECT query_id, id, CAST(row_number() OVER w AS INT) AS place, CAST(floor(dist * 1e6 + 0.5) AS BIGINT) AS dist6 FROM x
WINDOW w AS (PARTITION BY query_id ORDER BY dist, id) QUALIFY row_number() OVER w <= 8
"""


def hybrid(spark, d):
    """Filtered nearest neighbours, reranked by keywords."""
    kept = vector_chunks(spark, d).where(retrieval.metadata_filter(["file0", "file1", "file2"], [3, 4, 5, 6, 7, 8, 9, 0, -1], None))
    hits = retrieval.nearest(kept, vector_queries(spark, d), 32)
    words = text.keywords(F.lit("What is the Gold grade and the tonnage?"), ["what", "the", "and"])
    return retrieval.reranked(hits, words, 8).select("query_id", "id", "rank", "score")


HYBRID = f"""
WITH {V}, f AS (SELECT *, row_number() OVER w AS fr, CASE WHEN text LIKE '%gold%' THEN 1 ELSE 0 END + CASE WHEN text LIKE '%grade%' THEN 1 ELSE 0 END + CASE WHEN text LIKE '%tonnage%' THEN 1 ELSE 0 END
     + CASE WHEN type = 'table' THEN 2 ELSE 0 END AS score FROM x WHERE source IN ('file0', 'file1', 'file2') AND ni_item BETWEEN 3 AND 9 WINDOW w AS (PARTITION BY query_id ORDER BY dist, id) QUALIFY row_number() OVER w <= 32)
SELECT query_id, id, CAST(row_number() OVER w AS INT) AS rank, CAST(score AS INT) AS score FROM f WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, dist, fr) QUALIFY row_number() OVER w <= 8
"""


def gathered(spark, d):
    """The first query that finds each chunk, over the whole set of queries."""
    hits = retrieval.nearest(vector_chunks(spark, d), vector_queries(spark, d), 12)
    return retrieval.first_seen(hits, ["id"], ["query_id", "fetch_rank"]).select("id", "query_id", F.col("fetch_rank").alias("place"))


GATHERED = f"""
WITH {V}, f AS (SELECT query_id, id, CAST(row_number() OVER w AS INT) AS place FROM x WINDOW w AS (PARTITION BY query_id ORDER BY dist, id) QUALIFY row_number() OVER w <= 12)
SELECT id, query_id, place FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY query_id, place) = 1
"""


def query_context(spark, d):
    hits = retrieval.reranked(retrieval.nearest(vector_chunks(spark, d), vector_queries(spark, d), 20), text.keywords(F.lit("gold tonnage"), []), 3)
    return retrieval.context(hits)


CONTEXT = f"""
WITH {V}, f AS (SELECT *, row_number() OVER w AS fr, CASE WHEN text LIKE '%gold%' THEN 1 ELSE 0 END + CASE WHEN text LIKE '%tonnage%' THEN 1 ELSE 0 END + CASE WHEN type = 'table' THEN 2 ELSE 0 END AS score
     FROM x WINDOW w AS (PARTITION BY query_id ORDER BY dist, id) QUALIFY row_number() OVER w <= 20),
r AS (SELECT *, row_number() OVER w AS rank FROM f WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, dist, fr) QUALIFY row_number() OVER w <= 3)
SELECT query_id, string_agg('[' || rank || '] ' || source || ' ' || CASE WHEN ni_item > 0 THEN 'Item ' || ni_item || ' (Drilling)' ELSE 'section unknown' END || ' page ' || id || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM r GROUP BY query_id
"""


def fallback(spark, d):
    """The nearest chunks of the same item and type as a query's, and those of all for queries whose item has none."""
    v = vector_chunks(spark, d)
    queries = vector_queries(spark, d)
    strict = retrieval.nearest(v.where(retrieval.metadata_filter(items=[5], types=["table"])), queries.where("query_id % 100 = 0"), 3)
    return retrieval.relaxed(strict, retrieval.nearest(v, queries, 2)).select("query_id", "id")


FALLBACK = f"""
WITH {V}, s AS (SELECT query_id, id FROM x WHERE ni_item = 5 AND type = 'table' AND query_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, id) <= 3),
l AS (SELECT query_id, id FROM x QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, id) <= 2)
SELECT query_id, id FROM s UNION ALL SELECT query_id, id FROM l WHERE query_id NOT IN (SELECT query_id FROM s)
"""


def catalogue(spark, d):
    q = vector_queries(spark, d).where("query_id < 500").withColumn("n", (F.col("query_id") / 50).cast("int"))
    return q.select("query_id", (F.col("n") % 3).alias("block_ord"), F.concat(F.lit("topic "), (F.col("n") % 3).cast("string")).alias("topic"), F.when(F.col("n") % 3 == 2, 5).alias("item"), F.col("n").alias("query_ord"), F.lit("gold tonnage").alias("question"), "query")


def topic_context(spark, d):
    """Context of a catalogue of topics and an item for each file: its length, its blocks and how many chunks it has."""
    found = gather.for_topics(vector_chunks(spark, d).withColumn("chunk", F.lit(0)), catalogue(spark, d), 4)
    return found.select("file", F.regexp_extract_all("context", F.lit("### Context for: ([^\n]+)"), F.lit(1)).alias("b"), F.size(F.regexp_extract_all("context", F.lit(r"(\[\d+\] file)"), F.lit(1))).alias("chunks")).select("file", F.array_join("b", ",").alias("blocks"), "chunks")


TOPICS = f"""
WITH {V}, y AS (SELECT *, CAST(query_id / 50 AS INT) % 3 AS b, CASE WHEN text LIKE '%gold%' THEN 1 ELSE 0 END + CASE WHEN text LIKE '%tonnage%' THEN 1 ELSE 0 END + CASE WHEN type = 'table' THEN 2 ELSE 0 END AS score FROM x WHERE query_id < 500),
f AS (SELECT *, row_number() OVER w AS fr FROM y WINDOW w AS (PARTITION BY source, query_id ORDER BY dist, id) QUALIFY row_number() OVER w <= 16),
r AS (SELECT *, row_number() OVER w AS rank FROM f WINDOW w AS (PARTITION BY source, query_id ORDER BY score DESC, dist, fr) QUALIFY row_number() OVER w <= 4),
k AS (SELECT * FROM r WHERE b < 2 OR ni_item IN (0, 5) QUALIFY row_number() OVER (PARTITION BY source, id ORDER BY b, query_id, rank) = 1)
SELECT source AS file, string_agg(CASE WHEN b = 2 THEN 'Item 5' ELSE 'topic ' || b END, ',' ORDER BY b) AS blocks, CAST(sum(n) AS INT) AS chunks FROM (SELECT source, b, count(*) AS n FROM k GROUP BY source, b) GROUP BY source
"""


def variant_context(spark, d):
    """Tables first, then all chunks, for one query: which pages each file's context has, in order."""
    q = catalogue(spark, d).where("query_ord = 0").select("query_id", "block_ord", "question", "query")
    found = gather.with_variants(vector_chunks(spark, d).withColumn("chunk", F.lit(0)), q, 3, types=["table"])
    return found.select("file", F.array_join(F.regexp_extract_all("context", F.lit(r"page (\d+)"), F.lit(1)), ",").alias("pages"))


VARIANTS = f"""
WITH {V}, y AS (SELECT *, CASE WHEN text LIKE '%gold%' THEN 1 ELSE 0 END + CASE WHEN text LIKE '%tonnage%' THEN 1 ELSE 0 END + CASE WHEN type = 'table' THEN 2 ELSE 0 END AS score FROM x WHERE query_id = 0),
z AS (SELECT *, 0 AS turn FROM y WHERE type = 'table' UNION ALL SELECT *, 1 FROM y), f AS (SELECT *, row_number() OVER w AS fr FROM z WINDOW w AS (PARTITION BY source, turn ORDER BY dist, id) QUALIFY row_number() OVER w <= 15),
r AS (SELECT *, row_number() OVER w AS rank FROM f WINDOW w AS (PARTITION BY source, turn ORDER BY score DESC, dist, fr) QUALIFY row_number() OVER w <= 3),
k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY source, id ORDER BY turn, rank) = 1)
SELECT source AS file, string_agg(CAST(id AS VARCHAR), ',' ORDER BY turn, rank) AS pages FROM k GROUP BY source
"""


def turn_pairs(spark, d):
    return routing.turn_pairs(read(spark, d, "conversations"), 20, 10)


TURN_PAIRS = """
WITH t AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 20),
u AS (SELECT *, lag(role) OVER w AS br, lag(text) OVER w AS bt FROM t WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, bt AS question, text AS answer FROM u WHERE role = 'assistant' AND br = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10
"""
RULES = [(1, "th", [1, 25], [3]), (2, "ou", [14, 1], [25, 7]), (3, "der ", [21], [22]), (4, "ación", [16], [])]


def turns(spark, d):
    """Every different turn with a text; its id holds the text's digest, as numbers of turns repeat."""
    t = read(spark, d, "conversations").where("text is not null").select("conv_id", "turn", "role", "text").distinct()
    return t.select(F.concat_ws("-", "conv_id", "turn", "role", F.md5("text")).alias("id"), "text")


TURNS = "SELECT DISTINCT conv_id || '-' || turn || '-' || role || '-' || md5(text) AS id, text FROM conversations WHERE text IS NOT NULL"


def route(spark, d):
    return routing.routed(turns(spark, d), spark.createDataFrame(RULES, "ord int, pattern string, primary array<int>, cross array<int>")).select(
        "id", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("primary_items", "cross_items", "matched")))


ROUTE = f"""
WITH r(ord, pattern, p, c) AS (VALUES (1, 'th', [1, 25], [3]), (2, 'ou', [14, 1], [25, 7]), (3, 'der ', [21], [22]), (4, 'ación', [16], CAST([] AS INT[]))),
q AS (SELECT id, regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS t FROM ({TURNS})),
h AS (SELECT id, list(pattern ORDER BY ord) FILTER (WHERE pattern IS NOT NULL) AS m, list_sort(list_distinct(flatten(list(p) FILTER (WHERE p IS NOT NULL)))) AS p, list_sort(list_distinct(flatten(list(c) FILTER (WHERE c IS NOT NULL)))) AS c FROM q LEFT JOIN r ON contains(t, pattern) GROUP BY id),
z AS (SELECT id, coalesce(m, []) AS m, CASE WHEN m IS NULL THEN [1, 25] ELSE p END AS p, coalesce(c, []) AS c FROM h)
SELECT id, array_to_string(p, ',') AS primary_items, array_to_string(list_filter(c, lambda x: NOT list_contains(p, x)), ',') AS cross_items, array_to_string(m, ',') AS matched FROM z
"""


def greetings(spark, d):
    t = F.when(F.col("turn") % 3 == 0, "Thanks!").when(F.col("turn") % 3 == 1, " Goodbye ?! ").otherwise(F.col("text"))
    return read(spark, d, "conversations").select("conv_id", "turn", text.is_greeting(t).alias("greeting"))


GREETINGS = r"""
SELECT conv_id, turn, turn % 3 < 2 OR coalesce(length(trim(text)) <= 50 AND regexp_full_match(lower(trim(text)), '(hi|hello|hey|thanks|thank you|bye|goodbye|ok|okay)[\s!.?]*'), false) AS greeting FROM conversations
"""

QUERIES = {
    "html_text": (html_text, HTML_TEXT), "table_markdown": (table_markdown, TABLE_MARKDOWN), "chunk_ids": (chunk_ids, CHUNK_IDS), "page_chunks": (page_chunks, PAGE_CHUNKS), "chapter_headings": (headings, HEADINGS),
    "chapter_ranges": (chapter_ranges, RANGES), "tagged_pages": (tagged_pages, TAGGED), "knn": (knn, KNN), "hybrid_rerank": (hybrid, HYBRID), "query_set_gather": (gathered, GATHERED), "query_context": (query_context, CONTEXT),
    "inline_tags": (inline_tags, INLINE), "page_parts": (page_parts, PARTS), "topic_context": (topic_context, TOPICS), "variant_context": (variant_context, VARIANTS), "filter_fallback": (fallback, FALLBACK), "turn_pairs": (turn_pairs, TURN_PAIRS), "route_questions": (route, ROUTE), "greetings": (greetings, GREETINGS),
}
