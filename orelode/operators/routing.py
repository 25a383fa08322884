"""Routing of questions by rule tables: rows (ord, pattern, primary, cross), and pairing of dialog turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orelode.functions.text import normalise


def routed(questions: DataFrame, rules: DataFrame, default: list[int] = (1, 25)) -> DataFrame:
    """id, primary_items, cross_items, matched from questions (id, text): all rules whose pattern the text contains.

    Both item sets are sorted; cross items leave out primary ones; without a match the default items are primary.
    """
    q = questions.select("id", normalise(F.col("text")).alias("q"))
    hits = q.join(rules, F.contains(F.col("q"), F.lower("pattern")), "left")
    out = hits.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("primary")))).alias("p"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("cross")))).alias("c"),
                                 F.transform(F.sort_array(F.collect_list(F.when(F.col("pattern").isNotNull(), F.struct("ord", "pattern")))), lambda x: x.pattern).alias("matched"))
    fallback = F.array(*(F.lit(i) for i in default))
    primary = F.when(F.size("matched") == 0, fallback).otherwise(F.col("p"))
    return out.select("id", primary.alias("primary_items"), F.array_except("c", primary).alias("cross_items"), "matched")


def first_template(questions: DataFrame, templates: DataFrame) -> DataFrame:
    """id, template: of templates (ord, name, keyword) the first in order with a keyword that the text contains, or null."""
    hits = questions.select("id", F.lower("text").alias("q")).join(templates, F.contains(F.col("q"), F.lower("keyword")), "left")
    return hits.groupBy("id").agg(F.min_by("name", "ord").alias("template"))


def wants_peers(text: Column, words: list[str]) -> Column:
    low = F.lower(text)
    return F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(low, w))


def turn_pairs(turns: DataFrame, last_turns: int | None = None, last_pairs: int | None = None) -> DataFrame:
    """conv_id, turn, question, answer: each assistant turn right after a user turn, other roles left out.

    Of users in a row the last counts; an assistant turn without one is ignored. last_turns counts all roles.
    """
    rows = turns
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    if last_turns:
        rows = rows.withColumn("r_", F.row_number().over(newest)).where(F.col("r_") <= last_turns).drop("r_")
    rows = rows.where(F.col("role").isin("user", "assistant"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = rows.withColumn("before", F.lag(F.struct("role", "text")).over(w))
    pairs = rows.where((F.col("role") == "assistant") & (F.col("before.role") == "user")).select("conv_id", "turn", F.col("before.text").alias("question"), F.col("text").alias("answer"))
    if last_pairs:
        pairs = pairs.withColumn("r_", F.row_number().over(newest)).where(F.col("r_") <= last_pairs).drop("r_")
    return pairs


def playbook_flags(flags: Column, answer: Column, most: int = 8) -> Column:
    """Of flags between semicolons, those whose first eight letters the answer has, if it speaks of risks at all."""
    low = F.lower(answer)
    speaks = F.rlike(low, F.lit("flag|concern|risk|issue"))
    parts = F.transform(F.split(flags, ";"), lambda x: F.regexp_replace(F.trim(x), r"\.+$", ""))
    told = F.filter(parts, lambda f: (f != "") & F.contains(low, F.lower(F.substring(F.substring_index(f, ".", 1), 1, 8))))
    return F.when(speaks, F.slice(told, 1, most)).otherwise(F.array().cast("array<string>"))


def sources_once(sources: DataFrame, keys: list[str]) -> DataFrame:
    """The first of each key by pos."""
    return sources.withColumn("r_", F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))).where("r_ = 1").drop("r_")


# Where no rule matches, the items of each topic whose words the question contains.
TOPICS = [
    (["resource", "tonnage", "measured", "indicated", "inferred"], [14, 10]),
    (["reserve", "proven", "probable"], [15, 16]),
    (["geolog", "deposit", "mineralization", "mineralisation"], [7, 8]),
    (["economic", "npv", "irr", "payback"], [22, 21, 19]),
    (["environment", "permit", "esg", "closure"], [20]),
    (["conclusion", "recommendation", "go", "no-go", "no go"], [25, 26, 1]),
]


def topic_items(text: Column, topics=TOPICS, default: list[int] = (1, 25)) -> Column:
    """Sorted items of all topics that the text touches, by parts of words; else the default."""
    low = normalise(text)
    none = F.array().cast("array<int>")
    found = F.flatten(F.array(*(F.when(F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(low, w)), F.array(*(F.lit(i) for i in items))).otherwise(none) for words, items in topics)))
    return F.array_sort(F.array_distinct(F.when(F.size(found) == 0, F.array(*(F.lit(i) for i in default))).otherwise(found)))


def with_topics(routed_questions: DataFrame, questions: DataFrame) -> DataFrame:
    """Routed questions in which topics stand in for rules where none that matched has primary items."""
    q = questions.select("id", topic_items(F.col("text")).alias("topics"))
    primary = F.when((F.size("matched") == 0) | (F.size("primary_items") == 0), F.col("topics")).otherwise(F.col("primary_items"))
    return routed_questions.join(q, "id").select("id", primary.alias("primary_items"), F.array_except("cross_items", primary).alias("cross_items"), "matched")


def matrix_of_items(matrices: DataFrame) -> DataFrame:
    """item, ord: the first matrix (ord, key like "14-15", ...) whose key names an item."""
    numbers = F.filter(F.transform(F.split(F.replace("key", F.lit(" "), F.lit("")), "-"), lambda x: x.try_cast("int")), lambda n: n.isNotNull())
    return matrices.select("ord", F.explode(numbers).alias("item")).groupBy("item").agg(F.min("ord").alias("ord"))


def playbooks(wanted: DataFrame, items: DataFrame, matrices: DataFrame) -> DataFrame:
    """id, playbook from wanted (id, pos, item), items (item, title, question, gather) and matrices (ord, key, lines).

    Each item has its head lines; its matrix's lines follow where the matrix comes first, and an item whose matrix has come
    already has no blank line after it.
    """
    rows = wanted.join(items, "item", "left").join(matrix_of_items(matrices), "item", "left").join(matrices.select("ord", "lines"), "ord", "left")
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("id", "ord").orderBy("pos")))
    head = F.when(F.col("title").isNotNull(), F.filter(F.array(
        F.concat(F.lit("## Item "), F.col("item").cast("string"), F.lit(": "), "title"), F.concat(F.lit("DD question: "), F.coalesce("question", F.lit(""))),
        F.when(F.size("gather") > 0, F.concat(F.lit("Gather: "), F.array_join("gather", "; ")))), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))
    body = F.when(F.col("ord").isNull(), F.array(F.lit(""))).when(F.col("turn") == 1, F.concat("lines", F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
    rows = rows.select("id", "pos", F.concat(head, body).alias("part"))
    joined = F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "part"))), lambda x: x.part)), "\n")
    return rows.groupBy("id").agg(F.regexp_replace(joined, r"^\s+|\s+$", "").alias("playbook"))
