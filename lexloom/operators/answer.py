"""From ranked evidence to one answer a query: routing, packing, literary items, meanings, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.functions.udfs import highlight_offsets
from lexloom.operators.evidence import RESOURCES
from lexloom.operators.rank import diverse, quality

LITERARY_TYPES = ("literary", "corpus", "citation", "literary_context")


def route(evidence: DataFrame) -> DataFrame:
    """``part``: morphology, literary or lexical, by resource and type in that order; rows with another status than FOUND go."""
    kind = F.coalesce("evidence_type", F.lit(""))
    part = F.when((F.col("resource") == "morphology") | (kind == "morphology"), "morphology").when(kind.isin(*LITERARY_TYPES), "literary").otherwise("lexical")
    return evidence.where("status = 'FOUND' or status is null").withColumn("part", part)


def counts(evidence: DataFrame) -> DataFrame:
    """Counters of every query with evidence: in all, by part, and the number of resources."""
    return route(evidence).groupBy("query_id").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("part") == p).alias(p) for p in ("morphology", "lexical", "literary")], F.countDistinct("resource").alias("resources"),
    )


def literary(evidence: DataFrame, n: int = 5) -> DataFrame:
    """The best literary rows of every query, diverse by work, with the line that holds the word, its window and spans."""
    x = route(evidence).where("part = 'literary'").withColumn("work", F.coalesce("work", F.lit("")))
    no = F.lit(None).cast("string")
    s = quality(F.col("lemma"), F.col("passage"), F.col("query"), F.lit(False), F.col("work"), F.col("period"), no, F.col("meaning"))
    x = diverse(x.withColumn("score", s), "query_id", "work", "score", "source_id", n)
    keys = F.array_distinct(F.array_compact(F.array("query", "lemma")))
    x = x.withColumn("keys", keys).withColumn("line", T.relevant_line("passage", F.col("keys"))).withColumn("snippet", T.context_window("line", F.col("keys")))
    long = (F.length("passage") > F.length("snippet") + 10) | F.contains("passage", F.lit("\n"))
    return x.select("query_id", "rank", "resource", "source_id", "work", "verse", "line", "snippet", highlight_offsets("snippet", "keys").alias("spans"), (F.col("rank") == 1).alias("is_featured"), F.coalesce(long, F.lit(False)).alias("can_expand"))


def runs(text: Column | str, spans: Column | str) -> Column:
    """``array<struct<text, marked>>``: the text cut at its spans; what overlaps is shown once."""
    t, s = (F.col(x) if isinstance(x, str) else x for x in (text, spans))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,marked:boolean>>").alias("out"))

    def step(z, x):
        a, b = F.greatest(x["start"], z["at"]), F.greatest(x["end"], z["at"])
        plain = F.when(a > z["at"], F.array(F.struct(F.substr(t, z["at"] + 1, a - z["at"]).alias("text"), F.lit(False).alias("marked"))))
        marked = F.when(b > a, F.array(F.struct(F.substr(t, a + 1, b - a).alias("text"), F.lit(True).alias("marked"))))
        none = F.array().cast("array<struct<text:string,marked:boolean>>")
        return F.struct(b.alias("at"), F.concat(z["out"], F.coalesce(plain, none), F.coalesce(marked, none)).alias("out"))

    def end(z):
        rest = F.when(z["at"] < F.length(t), F.array(F.struct(F.substr(t, z["at"] + 1).alias("text"), F.lit(False).alias("marked"))))
        return F.concat(z["out"], F.coalesce(rest, F.array().cast("array<struct<text:string,marked:boolean>>")))

    return F.aggregate(F.array_sort(s), zero, step, end)


def meanings(evidence: DataFrame) -> DataFrame:
    """(query_id, meaning): the distinct meanings of lexical rows in their order, joined by semicolons."""
    x = route(evidence).where("part = 'lexical' and trim(meaning) <> ''").withColumn("meaning", F.trim("meaning"))
    first = x.groupBy("query_id", "meaning").agg(F.min("rank").alias("r"))
    return first.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "meaning"))), lambda z: z["meaning"]), "; ").alias("meaning"))


def found_sources(summary: DataFrame) -> DataFrame:
    """(query_id, sources): resources with status FOUND in the order of lookup."""
    at = F.array_position(F.array(*[F.lit(r) for r in RESOURCES]), F.col("resource"))
    x = summary.where("status = 'FOUND'").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(at.alias("n"), "resource"))).alias("s"))
    return x.select("query_id", F.array_join(F.transform("s", lambda z: z["resource"]), ",").alias("sources"))


def conflicts(evidence: DataFrame) -> DataFrame:
    """(query_id, lemmas): queries with more than one candidate lemma, sorted."""
    x = route(evidence).where("trim(lemma) <> ''").groupBy("query_id").agg(F.array_sort(F.collect_set(F.trim("lemma"))).alias("l"))
    return x.where(F.size("l") > 1).select("query_id", F.array_join("l", ",").alias("lemmas"))


def answers(queries: DataFrame, ranked: DataFrame, summary: DataFrame) -> DataFrame:
    """(query_id, answer): one JSON answer a query; a query without evidence, lemma and meaning is ``unknown``."""
    w = Window.partitionBy("query_id").orderBy(F.when(F.col("part") == "morphology", 0).when(F.col("part") == "lexical", 1).otherwise(2), "rank")
    lemma = route(ranked).where("trim(lemma) <> ''").withColumn("r", F.row_number().over(w)).where("r = 1").select("query_id", F.trim("lemma").alias("lemma"))
    lit = literary(ranked).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source_id", "work", "snippet", "is_featured", "can_expand"))).alias("literary"))
    x = queries.select("query_id", "query").distinct()
    for part in (lemma, meanings(ranked), found_sources(summary), counts(ranked).select("query_id", "total"), lit, conflicts(ranked)):
        x = x.join(part, "query_id", "left")
    unknown = F.col("total").isNull() & F.col("lemma").isNull() & F.col("meaning").isNull()
    doubt = F.when(unknown, "no evidence").when(F.col("lemmas").isNotNull(), F.concat(F.lit("several lemmas: "), "lemmas"))
    cols = ["query", "lemma", "meaning", "sources", "total", "literary"]
    return x.select("query_id", F.to_json(F.struct(*cols, unknown.alias("unknown"), doubt.alias("uncertainty"))).alias("answer"))


def cached_answer(query: Column, saved: DataFrame, recent: DataFrame, queries: DataFrame) -> DataFrame:
    """The stored answer of every query: a saved one before a recent one, only where it has morphology."""
    pick = lambda d, n: d.where("morphology is not null").select(F.col("query").alias("q"), F.col("answer").alias(n))
    x = queries.join(pick(saved, "a"), query == F.col("q"), "left").drop("q").join(pick(recent, "b"), query == F.col("q"), "left").drop("q")
    return x.withColumn("answer", F.coalesce("a", "b")).drop("a", "b")
