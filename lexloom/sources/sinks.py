"""What a build leaves behind: units, their index, dictionaries, vectors, the manifest and reports; each write replaces what was there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.index import positions

ENTRY = ("headword", "meaning", "source_file", "source_name", "entry_format", "raw_entry", "source_id")


def write_units(units: DataFrame, path: str) -> None:
    """Units sorted by id inside their files, so that lookups by id skip row groups."""
    units.repartitionByRange("chunk_id").sortWithinPartitions("chunk_id").write.mode("overwrite").parquet(path)


def write_index(units: DataFrame, path: str, id_col: str = "chunk_id", text_col: str = "normalized_text") -> None:
    """Postings by token: (token, id, pos), parted and sorted by token."""
    positions(units, id_col, text_col).repartitionByRange("token").sortWithinPartitions("token", "id", "pos").write.mode("overwrite").parquet(path)


def concat_dictionaries(parts: list[DataFrame], names: list[str]) -> DataFrame:
    """The entries of several dictionaries in their order under one running number, which is part of the id.

    A part has (headword, meaning) and may have source_file, entry_format, raw_entry
    and ``pos``, its order (else the headword's).
    """
    out = None
    for k, (p, name) in enumerate(zip(parts, names)):
        have = lambda c, p=p: F.col(c).cast("string") if c in p.columns else F.lit(None).cast("string")
        order = F.col("pos").cast("string") if "pos" in p.columns else F.col("headword")
        x = p.select(F.lit(k).alias("part"), order.alias("at"), "headword", "meaning", F.coalesce(have("source_file"), F.lit(name)).alias("source_file"), F.lit(name).alias("source_name"), have("entry_format").alias("entry_format"), have("raw_entry").alias("raw_entry"))
        out = x if out is None else out.unionByName(x)
    # the number is that of the sorted order without a window over everything: sorted parts, and the sums of the parts before
    s = out.sort("part", "at", "headword", "meaning").select("*", F.monotonically_increasing_id().alias("m"))  # type: ignore[union-attr]
    n = s.select(F.shiftright("m", 33).alias("p")).groupBy("p").count().collect()  # a row a partition
    before, total = {}, 0
    for r in sorted(n, key=lambda r: r["p"]):
        before[r["p"]] = total
        total += r["count"]
    start = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else None
    at = F.element_at(start, F.shiftright("m", 33)) + F.col("m").bitwiseAND(F.lit((1 << 33) - 1)) if start is not None else F.lit(0)
    return s.withColumn("n", at.cast("long")).withColumn("source_id", F.concat_ws(":", "source_name", "source_file", "headword", F.col("n").cast("string"))).select("n", *ENTRY)


def write_dictionary(entries: DataFrame, path: str) -> None:
    """JSON lines, a headword each with its entries in order, beside a line of totals in ``<path>/metadata``."""
    e = F.struct("n", *ENTRY)
    by = entries.groupBy("headword").agg(F.transform(F.array_sort(F.collect_list(e)), lambda z: F.struct(*[z[c].alias(c) for c in ENTRY])).alias("entries"))
    by.write.mode("overwrite").json(f"{path}/headword_index")
    entries.agg(F.count("*").alias("total_entries"), F.countDistinct("headword").alias("unique_headwords")).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def write_vectors(vectors: DataFrame, items: DataFrame, path: str, model_id: str, revision: str, fingerprint: str, dim: int) -> None:
    """Vectors and their items as tables, and one line of metadata that the validation reads."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    items.write.mode("overwrite").parquet(f"{path}/items")
    meta = vectors.agg(F.count("*").alias("vector_count")).select(
        F.lit("1.0").alias("schema_version"), F.lit(fingerprint).alias("corpus_fingerprint"), F.lit(model_id).alias("model_id"), F.lit(revision).alias("model_revision"), F.lit(dim).alias("dimension"), "vector_count",
        F.sha2(F.concat_ws("_", F.lit(fingerprint), F.lit(model_id), F.lit(revision), F.col("vector_count").cast("string"), F.lit(str(dim))), 256).alias("index_fingerprint"),
    )
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def write_manifest(works: DataFrame, path: str) -> None:
    """The manifest with the checksums of the files that were read."""
    works.drop("text", "error").write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)

