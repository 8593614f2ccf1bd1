"""From a manifest of works and their pages to text units: decode, clean, cut out the work, segment, number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import clean_html, normalize_text
from lexloom.sources import pages

VERSION, SOURCE = "1.0.0", "Project Madurai"
COUPLET_START = "அகர முதல"


def load_pages(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """The works with ``text``, ``checksum_sha256`` and ``error`` of their files; a file that is missing is an error of its work, not of the build."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.url_decode(F.regexp_extract("path", "([^/]+)$", 1))
    f = f.select(name.alias("file_name"), F.sha2("content", 256).alias("checksum_sha256"), F.make_valid_utf8(F.col("content").cast("string")).alias("text")).dropDuplicates(["file_name"])
    x = manifest.dropDuplicates(["work_id"]).join(f, "file_name", "left")
    return x.withColumn("error", F.when(F.col("text").isNull(), F.concat(F.lit("no file "), F.coalesce("file_name", F.lit("named")))))


def build_units(works: DataFrame, couplet_start: str = COUPLET_START) -> DataFrame:
    """Units (the columns of ``chunks`` but the time) of (work_id, work, text, ...) rows, by the work's strategy."""
    spark = works.sparkSession
    columns = set(works.columns)
    for c in ("release_no", "author", "period", "genre", "source_url", "file_name", "chunk_strategy"):
        works = works if c in columns else works.withColumn(c, F.lit(None).cast("string"))
    x = works.where("text is not null").join(F.broadcast(pages.markers(spark)), "work_id", "left")  # a fixed table
    x = x.withColumn("text", pages.section(clean_html("text"), "start", "end"))
    pair = F.coalesce(F.col("chunk_strategy") == "couplet", F.lit(False))
    a = pages.couplets(x.where(pair), "work_id", "text", couplet_start).withColumns({"verse_number": F.col("stanza_number").cast("string"), "poet": F.lit(None).cast("string")})
    b = pages.stanzas(x.where(~pair), "work_id", "text", title_col="work").withColumns({"chapter": F.lit(None).cast("string"), "line_range": F.lit(None).cast("string")})
    cols = ["id", "stanza_number", "verse_number", "poet", "canto", "chapter", "line_range", "original_text"]
    u = a.select(*cols).unionByName(b.select(*cols)).join(x.drop("text", "start", "end").withColumnRenamed("work_id", "id"), "id")
    return u.select(
        F.format_string("PM-%s-%04d", "id", "stanza_number").alias("chunk_id"), F.lit(VERSION).alias("corpus_version"), F.lit(SOURCE).alias("source"), "release_no", "work",
        F.coalesce("poet", "author").alias("author"), "period", "genre", "canto", "chapter", "stanza_number", "verse_number", "line_range", "original_text",
        normalize_text(F.regexp_replace("original_text", "\n", " ")).alias("normalized_text"), "source_url", F.concat(F.lit("data/raw/project_madurai/"), F.coalesce("file_name", F.lit(""))).alias("file_path"),
    )


def build_status(works: DataFrame, units: DataFrame) -> DataFrame:
    """(work_id, n_units, status, error): OK, or FAILED for a work without units; the build is PARTIAL if any failed."""
    n = units.groupBy(F.regexp_extract("chunk_id", "^PM-(.*)-[0-9]+$", 1).alias("work_id")).agg(F.count("*").alias("n_units"))
    x = works.select("work_id", *[c for c in ("error",) if c in works.columns]).join(n, "work_id", "left").withColumn("n_units", F.coalesce("n_units", F.lit(0)))
    error = F.when(F.col("n_units") == 0, F.coalesce(F.col("error") if "error" in works.columns else F.lit(None).cast("string"), F.lit("no units")))
    return x.select("work_id", "n_units", F.when(F.col("n_units") > 0, "OK").otherwise("FAILED").alias("status"), error.alias("error"))
