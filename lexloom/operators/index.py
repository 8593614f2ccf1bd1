"""Token and position index over text units, with term and phrase lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import index_tokens

CAP = 25  #: hits a lookup returns, by ascending id


def positions(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, token) of every token; repeated units count once."""
    x = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t is not null").dropDuplicates(["id"])
    return x.select("id", F.posexplode(index_tokens("t")).alias("pos", "token"))


def token_stats(pos: DataFrame) -> DataFrame:
    """(token, n_tokens, n_units); two levels of map-side combine, so a frequent token is no hot task."""
    return pos.groupBy("token", "id").count().groupBy("token").agg(F.sum("count").alias("n_tokens"), F.count("*").alias("n_units"))


def first_ids(hits: DataFrame, cap: int = CAP) -> DataFrame:
    """The ``cap`` smallest ids of every query; the limit is applied before the shuffle as well."""
    w = Window.partitionBy("query_id").orderBy("id")
    return hits.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= cap)


def term_lookup(pos: DataFrame, terms: DataFrame, cap: int = CAP) -> DataFrame:
    """(query_id, id, rank) of the units that hold a term (query_id, term)."""
    hits = pos.join(terms.select("query_id", F.lower("term").alias("token")).distinct(), "token").select("query_id", "id").distinct()
    return first_ids(hits, cap)


def phrase_lookup(pos: DataFrame, phrases: DataFrame, cap: int = CAP) -> DataFrame:
    """(query_id, id, rank) of the units that hold all tokens of a phrase in a row.

    Relational division: every token of the phrase must stand at the same start.
    """
    q = phrases.select("query_id", index_tokens("phrase").alias("q")).where(F.size("q") > 0).select("query_id", F.size("q").alias("n"), F.posexplode("q").alias("i", "token"))
    at = pos.join(q, "token").groupBy("query_id", "n", "id", (F.col("pos") - F.col("i")).alias("start")).agg(F.count("*").alias("k"))
    return first_ids(at.where("k = n").select("query_id", "id").distinct(), cap)


def parity(units: DataFrame, pos: DataFrame, id_col: str) -> DataFrame:
    """Whether the index covers as many units as the table has units with tokens."""
    a = units.select(F.countDistinct(id_col).alias("n_units"))
    b = pos.select(F.countDistinct("id").alias("n_indexed"))
    return a.crossJoin(b)  # one row each


def refresh(old: DataFrame, batch: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The index after a batch of new or changed units: their old postings go, their new ones come."""
    keys = batch.select(F.col(id_col).alias("id")).distinct()
    return old.join(keys, "id", "left_anti").unionByName(positions(batch, id_col, text_col))
