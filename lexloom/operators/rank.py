"""Order-dependent operators as windows: first-wins dedupe, priority order, diverse selection, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of every key; ``order`` must be a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def last_wins(df: DataFrame, keys: list, order: list) -> DataFrame:
    """Upsert: the last row of every key."""
    return first_wins(df, keys, [F.desc(c) if isinstance(c, str) else c.desc() for c in order])


def priority(status: Column, analysis: Column, surface: Column, lemma: Column, query: Column, kind: Column) -> list[Column]:
    """The three descending keys of the evidence order; what was not found comes last."""
    found = status == "FOUND"
    a = F.when(~found, 0).when(analysis == "guesser", 5).otherwise(10)
    m = F.when(~found, 0).when(surface.eqNullSafe(query), 8).when(lemma == query, 6).otherwise(4)
    t = F.when(~found, 0).when(kind == "frequency", 2).otherwise(8)
    return [a, m, t]


def quality(lemma: Column, passage: Column, query: Column, is_candidate: Column, work: Column, period: Column, verse: Column, meaning: Column) -> Column:
    """Additive score of an item: 10 surface, 8 lemma, 5 passage, 3 work, 2 period, 1 verse, 2 meaning."""
    full = lambda c: F.coalesce(c != "", F.lit(False))
    hit = F.coalesce(lemma == query, F.lit(False)) | F.coalesce(F.contains(passage, query), F.lit(False))
    long = F.coalesce(F.length(F.trim(passage)) > 10, F.lit(False))
    return sum((F.when(c, v).otherwise(0) for c, v in ((hit, 10), (F.coalesce(is_candidate, F.lit(False)), 8), (long, 5), (full(work), 3), (full(period), 2), (full(verse), 1), (full(meaning), 2))), F.lit(0))


def diverse(df: DataFrame, query: str, group: str, score: str, order: str, n: int = 5, per_group: int = 1) -> DataFrame:
    """The best ``n`` of every query, one a group before any group gets more."""
    inner = Window.partitionBy(query, group).orderBy(F.desc(score), order)
    x = df.withColumn("__g", F.row_number().over(inner))
    outer = Window.partitionBy(query).orderBy((F.col("__g") > per_group).cast("int"), F.desc(score), order)
    return x.withColumn("rank", F.row_number().over(outer).cast("bigint")).where(F.col("rank") <= n).drop("__g")


def morphology_order(analysis: Column, model: Column, morphology: Column) -> Column:
    """0 core analyses, 1 guesses, 2 maps without a model, 3 the rest."""
    a, m = F.lower(F.coalesce(analysis, F.lit(""))), F.coalesce(model, F.lit("")) != ""
    has = F.coalesce(morphology, F.lit("")) != ""
    return F.when((a == "core") & m & has, 0).when((a == "guesser") & has, 1).when((a != "guesser") & ~m, 2).otherwise(3)
