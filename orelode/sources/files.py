"""Scans of report documents, page files and listings."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from orelode.functions.text import norm
from orelode.schema import REPORT, SPATIAL


def stem(path: str = "path"):
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]+$", "")


def reports(spark: SparkSession, folder: str, schema: StructType = REPORT) -> DataFrame:
    """One row for each readable JSON document, with its stem; chapter lists and broken files are left out.

    Spark can't count the rows alone of such a reading: select a column first.
    """
    rows = (spark.read.schema(StructType([*schema.fields, StructField("_corrupt", StringType())])).option("multiLine", True)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(f"{folder}/*.json"))
    rows = rows.withColumn("stem", stem("_metadata.file_path"))
    return rows.where(F.col("_corrupt").isNull() & ~F.endswith("stem", F.lit("_chapters"))).drop("_corrupt")


def pages_of(spark: SparkSession, folder: str, split, glob: str = "*.pdf", schema: str = "page int, text string") -> DataFrame:
    """source, page, text of files: `split` makes (page, text) pairs of a file's bytes. Blank pages and files it fails on give none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)

    def run(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    out += [(path.rsplit("/", 1)[-1], page, text.strip()) for page, text in split(content) if text and text.strip()]
                except Exception:  # a broken file is an empty one
                    continue
            yield pd.DataFrame(out, columns=["source", "page", "text"])

    return files.select("path", "content").mapInPandas(run, "source string, page int, text string")


def listing(spark: SparkSession, folder: str, glob: str, more: list[str] = ()) -> DataFrame:
    """path, name, length and fingerprint of files, by name; equal paths once. A missing folder is an error, missing ones of `more` are none."""
    if not exists(spark, folder):
        raise FileNotFoundError(folder)
    folders = [folder, *(m for m in more if exists(spark, m))]
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folders)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    found = files.select("path", name.alias("name"), "length", F.concat_ws(":", F.unix_micros("modificationTime"), "length").alias("fingerprint"))
    return found.dropDuplicates(["path"]).orderBy("name", "path")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def document(reports_table: DataFrame, filename: str) -> DataFrame:
    """The document whose stem is that of a file name; none if there is none."""
    wanted = re.sub(r"\.[^.]+$", "", filename.rsplit("/", 1)[-1])
    return reports_table.where(F.col("stem") == wanted).limit(1)


def resolved(reports_table: DataFrame, filename: str) -> DataFrame:
    """The document by its stem, or else by source_file, whatever its case."""
    wanted = re.sub(r"\.[^.]+$", "", filename.rsplit("/", 1)[-1])
    rank = F.when(F.col("stem") == wanted, 0).when(norm(F.col("source_file")) == filename.strip().lower(), 1)
    return reports_table.withColumn("rank_", rank).where("rank_ is not null").orderBy("rank_", "stem").limit(1).drop("rank_")


def confirmed(spark: SparkSession, folder: str, filename: str, allow_unconfirmed: bool = False) -> DataFrame:
    """The spatial document of a file; an error if there is none, or if nobody has confirmed it."""
    if not exists(spark, folder):
        raise FileNotFoundError(folder)
    found = document(reports(spark, folder, SPATIAL), filename)
    rows = found.select("confirmed").collect()
    if not rows:
        raise FileNotFoundError(f"no spatial document of {filename} in {folder}")
    if not rows[0].confirmed and not allow_unconfirmed:
        raise ValueError(f"the spatial document of {filename} is not confirmed; it has to be reviewed first")
    return found


def chapter_index(spark: SparkSession, folder: str) -> DataFrame:
    """source (the stem), ord, item, title, page_start, page_end of chapter lists; missing and broken ones give none."""
    schema = "item int, title string, page_start int, page_end int"
    if not exists(spark, folder):
        return spark.createDataFrame([], f"source string, ord int, {schema}")
    rows = spark.read.text(f"{folder}/*_chapters.json", wholetext=True).withColumn("source", F.regexp_replace(stem("_metadata.file_path"), "_chapters$", ""))
    return rows.select("source", F.posexplode(F.from_json("value", f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")).alias("ord", "c")).select("source", "ord", "c.*")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """source, fingerprint as save_manifest() wrote them; none if there is no manifest."""
    return spark.read.parquet(folder) if exists(spark, folder) else spark.createDataFrame([], "source string, fingerprint string")


RULES = """items array<struct<number:int,title:string,gather_fields:array<string>,dd_question:string>>,
query_lookup array<struct<question_pattern:string,primary_items:array<int>,cross_check_items:array<int>>>,
routing_matrices map<string,struct<search:string,cross_check:array<int>,extract:array<string>,compare:array<string>,flag:array<string>>>,
benchmark_templates array<struct<name:string,keywords:array<string>,search_criteria:array<string>,extract_fields:array<string>,output_format:string>>, core_dd_questions array<string>"""


def rule_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables items, rules, matrices, templates and questions from one JSON document of rules; each keeps the document's order."""
    doc = spark.read.schema(RULES).option("multiLine", True).json(path)
    each = lambda c: doc.select(F.posexplode(c).alias("ord", "x"))
    m = F.col("value")
    joined = lambda head, c, by: F.when(F.size(c) > 0, F.concat(F.lit(head), F.array_join(c, by)))
    lines = F.array_compact(F.array(F.when(m["search"] != "", F.concat(F.lit("Search: "), m["search"])), joined("Cross-check Items: ", m["cross_check"].cast("array<string>"), ", "), joined("Extract: ", m["extract"], "; "),
                                    joined("Compare: ", m["compare"], "; "), joined("Flag: ", m["flag"], "; ")))
    return {
        "items": each("items").select(F.col("x.number").alias("item"), "x.title", F.col("x.dd_question").alias("question"), F.col("x.gather_fields").alias("gather")),
        "rules": each("query_lookup").select("ord", F.col("x.question_pattern").alias("pattern"), F.col("x.primary_items").alias("primary"), F.col("x.cross_check_items").alias("cross")),
        "matrices": doc.select(F.posexplode("routing_matrices").alias("ord", "key", "value")).select("ord", "key", lines.alias("lines")),
        "templates": each("benchmark_templates").select("ord", "x.name", F.explode("x.keywords").alias("keyword"), "x.search_criteria", "x.extract_fields", "x.output_format"),
        "questions": each("core_dd_questions").select("ord", F.col("x").alias("question")),
    }


def template(templates: DataFrame, name: str) -> DataFrame:
    """The benchmark template of a name, the first in order, without its keywords."""
    return templates.where(F.col("name") == name).drop("keyword").dropDuplicates().orderBy("ord").limit(1)


def page_response(c):
    """struct(primary_language, is_rotation_valid, rotation_correction, is_table, is_diagram, natural_text) of a page reader's answer.

    The answer is YAML, perhaps between fences; one that is no mapping, or broken, is null. Parsed by Python workers.
    """
    kinds = {"primary_language": str, "is_rotation_valid": bool, "rotation_correction": int, "is_table": bool, "is_diagram": bool, "natural_text": str}
    ddl = ", ".join(f"{k} {'string' if v is str else 'boolean' if v is bool else 'int'}" for k, v in kinds.items())
    fence = re.compile(r"\A\s*```[a-z]*[ \t]*\n?|\n?```\s*\Z", re.I)

    @F.udf(ddl)
    def parsed(raw):
        import yaml

        try:
            found = yaml.safe_load(fence.sub("", raw)) if raw else None
        except yaml.YAMLError:
            return None
        if not isinstance(found, dict):
            return None
        return tuple(None if found.get(k) is None else t(found[k]) for k, t in kinds.items())

    return parsed(c)


def model_label(name):
    """struct(label, id): marks as spaces, and lower-case letters and digits joined by lines."""
    s = F.regexp_replace(name, r"\.[^.]+$", "")
    return F.struct(F.regexp_replace(s, "[-_]+", " ").alias("label"), F.regexp_replace(F.lower(F.regexp_replace(s, "[^A-Za-z0-9]+", "_")), "^_+|_+$", "").alias("id"))


# What a caption of a section begins with, and what it speaks of.
CAPTION, SECTION = r"(?i)^\s*figure\s+\S+", r"(?i)cross[\s-]?section|long[\s-]?section|\bsection\s+[A-Z0-9]|looking\s+(north|south|east|west)"


def section_pages(pages: DataFrame, caption: str = CAPTION, wanted: str = SECTION, most: int = 120) -> DataFrame:
    """source, page, caption: the first line of a page that is a figure's caption and speaks of a section."""
    lines = pages.select("source", "page", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.rlike("line", F.lit(caption)) & F.rlike("line", F.lit(wanted)))
    return lines.groupBy("source", "page").agg(F.substring(F.min_by(F.trim("line"), "at"), 1, most).alias("caption"))


@dataclass
class Settings:
    """What a run needs; from_env() takes each from the environment where it is set there."""

    folder: str = "knowledge"
    extracted: str = "extracted_data"
    chunk_size: int = 1400
    overlap: int = 150
    top_k: int = 8
    extract_top_k: int = 12
    workers: int = 4

    @classmethod
    def from_env(cls, prefix: str = "ORELODE_") -> Settings:
        set_there = {f.name: os.environ.get(prefix + f.name.upper()) for f in fields(cls)}
        return cls(**{f.name: type(f.default)(set_there[f.name]) for f in fields(cls) if set_there[f.name]})
