"""Dictionary sources: one file a headword, marked blocks, lines, JSON maps, XML and SQL dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions.text import clean_wikitext, strip

MAP = "struct<headword_index:map<string,array<struct<headword:string,meaning:string,source_file:string,source_name:string,entry_format:string,raw_entry:string,source_id:string>>>>"


def _whole(spark: SparkSession, path: str) -> DataFrame:
    x = spark.read.text(path, wholetext=True)
    return x.select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def _stripped(t: Column) -> Column:
    return F.filter(F.transform(F.split(t, "\n"), strip), lambda x: x != "")


def headword_files(spark: SparkSession, path: str, heads: str = "பெயர்|வினை|பண்பு|இடை|உரி", title: str = "# இசையினி தமிழ் அகராதி", see: str = "பார்.") -> DataFrame:
    """(headword, meaning, raw_entry): the file's name is the headword, its lines after clean-up the meaning."""
    x = _whole(spark, path)
    t = F.replace(F.regexp_replace("text", rf"##\s*({heads})", "\n[$1]\n"), F.lit("##"), F.lit(""))
    lines = F.filter(_stripped(t), lambda s: (s != ".") & ~F.startswith(s, F.lit(title)) & ~(F.startswith(s, F.lit("[")) & F.endswith(s, F.lit("]"))))
    lines = F.transform(lines, lambda s: F.when(F.startswith(s, F.lit(". ")), F.substr(s, F.lit(3))).otherwise(s))
    lines = F.filter(lines, lambda s: ~F.startswith(s, F.lit(see)))
    lines = F.transform(lines, lambda s: strip(F.regexp_replace(s, r"\([^)]+\)", "")))
    lines = F.filter(lines, lambda s: (s != "") & ~s.rlike(r"^[^a-zA-Z0-9\s]{1,4}\.$"))
    n = F.size(lines)
    joined = F.array_join(F.transform(lines, lambda s, i: F.concat(s, F.when(i == n - 1, "").when(s.rlike(r"[.;)]$"), "\n").otherwise(", "))), "")
    return x.select(F.col("file").alias("headword"), strip(joined).alias("meaning"), t.alias("raw_entry")).where("meaning <> ''")


def marked_blocks(spark: SparkSession, path: str, mark: str = "==", skip: str = "///") -> DataFrame:
    """(file, n, headword, meaning): the last line before a mark and the first line after it."""
    parts = _whole(spark, path).select("file", F.posexplode(F.split("text", mark)).alias("n", "part"))
    parts = parts.select("file", "n", _stripped(F.col("part")).alias("l"))
    w = Window.partitionBy("file").orderBy("n")
    x = parts.select("file", "n", F.element_at(F.when(F.size("l") > 0, F.col("l")), -1).alias("headword"), F.get(F.lead("l").over(w), F.lit(0)).alias("meaning"))
    return x.where(F.col("headword").isNotNull() & F.col("meaning").isNotNull() & ~F.startswith("headword", F.lit(skip)))


def head_lines(spark: SparkSession, path: str) -> DataFrame:
    """(headword, meaning): lines ``H1, H2 - MEANING``, one row a headword."""
    x = spark.read.text(path).select(strip("value").alias("l")).where("l <> '' and not startswith(l, '#') and contains(l, '-')")
    p = F.split("l", "-", 2)
    return x.select(F.explode(F.split(p[0], ",")).alias("headword"), strip(p[1]).alias("meaning")).select(strip("headword").alias("headword"), "meaning").where("headword <> '' and meaning <> ''")


def headword_map(spark: SparkSession, path: str) -> DataFrame:
    """The flat entries of a JSON map from headword to entries."""
    x = spark.read.text(path, wholetext=True).select(F.from_json("value", MAP).alias("j"))
    return x.select(F.explode("j.headword_index").alias("key", "entries")).select("key", F.explode("entries").alias("e")).select("key", "e.*")


def wiki_dump(spark: SparkSession, path: str) -> DataFrame:
    """(headword, pos, meaning): the numbered senses of every page of an XML dump, compressed or not."""
    p = spark.read.format("xml").option("rowTag", "page").schema("title string, revision struct<text: struct<_VALUE: string>>").load(path)
    x = p.select("title", F.explode(F.split("revision.text._VALUE", "\n")).alias("l")).where("title is not null and not contains(title, ':')")
    x = x.where("startswith(l, '#') and length(l) > 2 and not contains(l, '{{')")
    x = x.select(F.col("title").alias("headword"), F.lit(None).cast("string").alias("pos"), clean_wikitext(F.regexp_replace("l", r"^[#*: ]+", "")).alias("meaning"))
    return x.where(F.length("meaning") > 2)


def sql_inserts(spark: SparkSession, path: str, table: str, columns: list[str], ints: tuple[str, ...] = (), least: int = 1) -> DataFrame:
    """The value tuples of ``INSERT INTO table`` lines of a dump, any number on a line; NULL is null.

    Tuples of fewer than ``least`` values are left out; of the columns named in
    ``ints`` what is no number is 0.
    """
    x = spark.read.text(path).where(F.col("value").rlike(rf"(?i)^\s*INSERT\s+INTO\s+[`\"]?{table}[`\"]?\s"))
    # a tuple ends at a bracket that is not inside quotes
    tuples = F.regexp_extract_all(F.regexp_extract("value", r"(?is)VALUES\s*(.*)$", 1), F.lit(r"\(((?:'(?:[^'\\]|\\.|'')*'|[^'()])*)\)"), F.lit(1))
    values = lambda t: F.regexp_extract_all(t, F.lit(r"\s*('(?:[^'\\]|\\.|'')*'|[^',]*)\s*(?:,|$)"), F.lit(1))
    v = x.select(F.explode(tuples).alias("t")).select("t", values(F.col("t")).alias("v"), (F.size(F.filter(F.split(F.regexp_replace("t", r"'(?:[^'\\]|\\.|'')*'", "q"), ","), lambda z: F.lit(True)))).alias("n"))
    bare = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "^'|'$", ""), r"\\(.)", "$1"), "''", "'")

    def one(i: int, name: str) -> Column:
        c = F.when(F.col("n") > i, F.trim(F.get("v", F.lit(i))))
        c = F.when(F.upper(c) != "NULL", bare(c))
        return (F.coalesce(c.try_cast("int"), F.lit(0)) if name in ints else c).alias(name)

    return v.where(F.col("n") >= least).select(*[one(i, c) for i, c in enumerate(columns)])


def gold_set(spark: SparkSession, path: str) -> DataFrame:
    """(query, category, gold_chunk_ids, relevance_rationale) of a JSON array."""
    return spark.read.schema("query string, category string, gold_chunk_ids array<string>, relevance_rationale string").json(path, multiLine=True).where("query is not null")


def verse_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """Verses of JSON arrays; keys that are missing are null."""
    return spark.read.schema(schema).json(path, multiLine=True).where("verse_id is not null")


def benchmark_table(spark: SparkSession, path: str, first: str = "L|M") -> DataFrame:
    """(id, word, category, rest): rows of Markdown tables under running ``### n.n`` headings; the first of an id wins."""
    x = _whole(spark, path).select("file", F.posexplode(F.split("text", "\n")).alias("n", "l"))
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("category", F.last(F.when(F.col("l").rlike(r"^###\s+\d+\.\d+"), strip(F.regexp_replace("l", r"^###\s+\d+\.\d+\s*", ""))), True).over(w))
    cells = F.transform(F.filter(F.split("l", r"\|"), lambda c: strip(c) != ""), strip)
    x = x.where(F.col("l").rlike(rf"^\|\s*(?:{first})\d+\s*\|")).select("file", "n", "category", cells.alias("c"))
    x = x.select(F.col("c")[0].alias("id"), F.get("c", F.lit(1)).alias("word"), "category", F.slice("c", 3, 20).alias("rest"), "file", "n")
    first_row = Window.partitionBy("id").orderBy("file", "n")
    return x.withColumn("r", F.row_number().over(first_row)).where("r = 1").drop("r", "file", "n")


def manifest(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The works of a manifest in their order, the first ``limit`` if it is given."""
    x = spark.read.json(path, multiLine=True).select(F.posexplode("works").alias("pos", "w"))
    return (x if limit is None else x.where(F.col("pos") < limit)).select("pos", "w.*")


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, digest, text): bytes decoded with replacement, and their SHA-256."""
    x = spark.read.format("binaryFile").load(path)
    return x.select("path", F.sha2("content", 256).alias("digest"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
