"""Writing of records, chapter lists, manifests, model tables and landed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.operators import drill
from orelode.sources.files import exists, stem


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def save_documents(records: DataFrame, folder: str, blank: str = "report") -> None:
    """A folder {stem}.json for each record (source_file, ...), as one JSON document; records of equal stems replace what was there.

    A blank source_file has the stem `blank`. Every task writes its own records; nothing is gathered.
    """
    name = F.coalesce(F.nullif(stem("source_file"), F.lit("")), F.lit(blank))
    rows = records.select(F.concat(name, F.lit(".json")).alias("document"), F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("value"))
    rows.write.option("partitionOverwriteMode", "dynamic").partitionBy("document").mode("overwrite").text(folder)


def read_documents(spark: SparkSession, folder: str, schema) -> DataFrame:
    """What save_documents() wrote, with the stem of each."""
    rows = spark.read.option("basePath", folder).text(folder)
    return rows.select(F.regexp_replace("document", r"\.json$", "").alias("stem"), F.from_json("value", schema).alias("r")).select("stem", "r.*")


def save_chapters(chapters: DataFrame, folder: str) -> None:
    """{source}_chapters.json for each source: its list of item, title, page_start and page_end, in order."""
    one = F.struct("ord", F.struct("item", "title", "page_start", "page_end").alias("c"))
    lists = chapters.groupBy(F.regexp_replace("source", r"\.[^.]+$", "").alias("s")).agg(F.to_json(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["c"]), {"ignoreNullFields": "false"}).alias("value"))
    lists.select(F.concat("s", F.lit("_chapters.json")).alias("document"), "value").write.option("partitionOverwriteMode", "dynamic").partitionBy("document").mode("overwrite").text(folder)


def save_manifest(manifest: DataFrame, folder: str) -> None:
    """source, fingerprint of what has been taken in; the old manifest stays until the new one is whole."""
    spark = manifest.sparkSession
    fresh, (old, fs) = f"{folder}.new", _path(spark, folder)
    manifest.select("source", "fingerprint").write.mode("overwrite").parquet(fresh)
    fs.delete(old, True)
    fs.rename(_path(spark, fresh)[0], old)


def land(spark: SparkSession, files: dict[str, bytes], folder: str, suffix: str = ".pdf") -> list[str]:
    """Put uploaded files into the folder that a stream reads; other suffixes are an error, before any is written."""
    wrong = [n for n in files if not n.lower().endswith(suffix)]
    if wrong:
        raise ValueError(f"only {suffix} files are taken: {', '.join(wrong)}")
    for name, data in files.items():
        at, fs = _path(spark, f"{folder}/{name}")
        out = fs.create(at, True)
        out.write(bytearray(data))
        out.close()
    return list(files)


def rebuild(chunks: DataFrame, folder: str) -> None:
    """Replace the whole chunk table."""
    chunks.write.partitionBy("source").mode("overwrite").parquet(folder)


def digitised(clicks: DataFrame) -> DataFrame:
    """Points (section_id, surface_name, x, y, z, source) from clicks (section_id, datum, a1, a2, px, py, surface_name).

    Blank surfaces are left out; places are rounded to two decimals; anchors that define no section end the query.
    """
    rows = clicks.where(F.trim("surface_name") != "").withColumn("w", drill.pixel_to_world(F.col("px"), F.col("py"), F.col("a1"), F.col("a2"), strict=True))
    number = lambda c: F.format_string("%s", c)
    anchor = lambda a: F.concat(F.lit("("), F.concat_ws(",", *(number(F.col(f"{a}.{c}")) for c in "xyz")), F.lit(")@px("), number(F.col(f"{a}.px")), F.lit(","), number(F.col(f"{a}.py")), F.lit(")"))
    section, datum = F.trim(F.coalesce("section_id", F.lit(""))), F.trim(F.coalesce("datum", F.lit("")))
    told = F.concat(F.lit("digitized "), section, F.when(datum == "", "").otherwise(F.concat(F.lit(" ["), datum, F.lit("]"))), F.lit(" px("), number(F.col("px")), F.lit(","), number(F.col("py")), F.lit("); anchors "), anchor("a1"), F.lit(" / "), anchor("a2"))
    return rows.select(section.alias("section_id"), F.trim("surface_name").alias("surface_name"), *(F.round(f"w.{c}", 2).alias(c) for c in "xyz"), told.alias("source"))


def append_points(clicks: DataFrame, folder: str) -> int:
    """Add digitised points to a table of points; nothing is written if there are none. How many there were."""
    found = digitised(clicks).persist()
    n = found.count()
    if n:
        found.write.mode("append").parquet(folder)
    found.unpersist()
    return n


def portfolio_csv(table: DataFrame, folder: str) -> None:
    """One CSV file with a header; only values with commas, quotes or line feeds are quoted, quotes doubled."""
    table.coalesce(1).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(folder)


def save_model_meta(meta: DataFrame, path: str) -> None:
    """The one row that describes a model, as a JSON document."""
    meta.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def delete_documents(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Remove files by name; one that isn't there is an error, before any is removed."""
    missing = [n for n in names if not exists(spark, f"{folder}/{n}")]
    if missing:
        raise FileNotFoundError(", ".join(missing))
    for n in names:
        at, fs = _path(spark, f"{folder}/{n}")
        fs.delete(at, True)
