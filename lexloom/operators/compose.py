"""The whole pipeline for a batch of queries: evidence, sense choice, answer fields, the prompt's text, what clients show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import lexicons as L
from lexloom.functions import text as T
from lexloom.operators import answer, wsd
from lexloom.operators.evidence import Engine, ranked, summary
from lexloom.session import cut

SHOWN = 5  #: rows of a part that are packed
QUOTE = 80  #: characters of a header's quote


def validate(requests: DataFrame) -> DataFrame:
    """Requests (request_id, method, body) with ``status`` and ``error``, and the query, context and provider of good ones.

    405 for another method than POST; 400 for an empty body, for what is no JSON
    object, and for a missing or blank query; else 200.
    """
    b = F.trim(F.coalesce("body", F.lit("")))
    x = requests.withColumn("j", F.from_json(b, "query string, context string, provider string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = F.startswith(b, F.lit("{")) & F.col("j._bad").isNull()
    blank = F.trim(F.coalesce("j.query", F.lit(""))) == ""
    error = (
        F.when(F.col("method") != "POST", "method not allowed").when(b == "", "missing body").when(~good, "invalid JSON").when(blank, "query is required")
    )
    status = F.when(F.col("method") != "POST", 405).when(error.isNotNull(), 400).otherwise(200)
    ok = lambda c: F.when(status == 200, c)
    return x.select("request_id", status.alias("status"), error.alias("error"), ok(F.trim("j.query")).alias("query"), ok(F.col("j.context")).alias("context"), ok(F.col("j.provider")).alias("provider"))


def sense_candidates(evidence: DataFrame) -> DataFrame:
    """(query_id, query, source, headword, cand, definition): lexical rows with a meaning, each (source, meaning) once, in their order."""
    x = answer.route(evidence).where("part = 'lexical' and trim(meaning) <> ''").withColumn("definition", F.trim("meaning"))
    first = Window.partitionBy("query_id", "resource", "definition").orderBy("rank")
    x = x.withColumn("r", F.row_number().over(first)).where("r = 1")
    head = F.coalesce(*[F.when(F.trim(c) != "", F.col(c)) for c in ("lemma", "surface", "query")])
    return x.select("query_id", "query", F.col("resource").alias("source"), head.alias("headword"), F.col("rank").alias("cand"), "definition")


def filter_literary(items: DataFrame, period: str | None = None, category: str | None = None, everything: str = "All") -> DataFrame:
    """Items whose period holds the words asked for, whatever the case, and whose resource is of the category; ``All`` passes."""
    if period not in (None, "", everything):
        items = items.where(F.contains(F.lower(F.coalesce("period", F.lit(""))), F.lit(period.lower())))
    return items if category in (None, "", everything) else items.where(F.col("resource") == category)


def header_quote(items: DataFrame, works: tuple[str, ...] = L.COUPLET_WORKS, most: int = QUOTE) -> DataFrame:
    """(query_id, quote): of the first item of a couplet work, else of the first item, the line with the query or lemma, else its first line, cut short."""
    preferred = F.exists(F.array(*map(F.lit, works)), lambda w: F.contains(F.coalesce("work", F.lit("")), w)) | F.contains(F.lower(F.coalesce("work", F.lit(""))), F.lit("thirukkural"))
    w = Window.partitionBy("query_id").orderBy(F.when(preferred, 0).otherwise(1), "rank")
    x = items.where("passage <> ''").withColumn("r", F.row_number().over(w)).where("r = 1")
    lines = F.split("passage", "\n")
    hit = F.filter(lines, lambda y: F.contains(y, F.col("query")) | F.coalesce(F.contains(y, F.col("lemma")), F.lit(False)))
    line = F.trim(F.coalesce(F.get(hit, F.lit(0)), lines[0]))
    return x.select("query_id", F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("..."))).otherwise(line).alias("quote"))


def shown(df: DataFrame, senses: int = 2, related: int = 3) -> DataFrame:
    """What small clients show: the first senses and related words."""
    return df.withColumn("senses", F.slice("senses", 1, senses)).withColumn("related_words", F.slice("related_words", 1, related))


def _clauses(*parts: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*parts)), " ")


def responses(queries: DataFrame, evidence: DataFrame, resources: DataFrame, senses: DataFrame) -> DataFrame:
    """One row a query with the fields of the answer.

    ``queries`` has (query_id, query, context), ``evidence`` is ranked, ``resources``
    the summary, ``senses`` what ``wsd.decide`` chose.  The chosen sense is binding;
    where none was chosen although a context was given, the reason is an
    uncertainty, and so are missing evidence, guesses alone and several lemmas.
    """
    routed = answer.route(evidence)
    part = F.when(F.col("part") == "morphology", 0).when(F.col("part") == "lexical", 1).otherwise(2)
    lead = Window.partitionBy("query_id").orderBy(part, "rank")
    lemma = routed.where("trim(lemma) <> ''").withColumn("r", F.row_number().over(lead)).where("r = 1").select("query_id", F.trim("lemma").alias("lemma"))
    morph = routed.where("part = 'morphology'").groupBy("query_id").agg(F.max((F.col("analysis_type") == "core").cast("int")).alias("core"), F.max((F.col("analysis_type") == "guesser").cast("int")).alias("guess"))
    lit = cut(answer.literary(evidence, SHOWN), "literary")
    works = lit.groupBy("query_id").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("work") != "", F.col("work")))), ", ").alias("works"))
    sense = senses.select("query_id", F.col("status").alias("sense_status"), F.col("confidence").alias("sense_confidence"), F.col("sense").alias("contextual_meaning"))
    x = queries.select("query_id", "query", F.trim(F.coalesce("context", F.lit(""))).alias("context")).dropDuplicates(["query_id"])
    for y in (lemma, answer.meanings(evidence), answer.found_sources(resources), answer.counts(evidence).select("query_id", "total"), answer.conflicts(evidence), morph, works, sense.dropDuplicates(["query_id"])):
        x = x.join(y, "query_id", "left")
    none = F.coalesce("total", F.lit(0)) == 0
    unsure = F.col("contextual_meaning").isNull() & (F.col("context") != "") & F.col("sense_status").isin("ambiguous", "insufficient_evidence", "conflicting_signals")
    doubts = F.array_compact(F.array(
        F.when(none, F.lit("no evidence found")), F.when((F.coalesce("core", F.lit(0)) == 0) & (F.col("guess") == 1), F.lit("morphology is guessed")),
        F.when(F.col("lemmas").isNotNull(), F.concat(F.lit("several lemmas: "), "lemmas")), F.when(unsure, F.concat(F.lit("context decides no sense: "), "sense_status")),
    ))
    says = _clauses(
        F.when(F.col("lemma").isNotNull(), F.concat(F.lit("'"), "query", F.lit("' is a form of '"), "lemma", F.lit("'."))),
        F.when(F.col("contextual_meaning").isNotNull(), F.concat(F.lit("In its context it means: "), "contextual_meaning", F.lit(".")))
        .when(F.col("meaning").isNotNull(), F.concat(F.lit("Dictionaries give: "), "meaning", F.lit("."))),
        F.when(F.col("n_items") > 0, F.concat(F.col("n_items").cast("string"), F.lit(" passages are shown"), F.when(F.col("works") != "", F.concat(F.lit(", from "), "works")).otherwise(""), F.lit("."))),
    )
    return x.select(
        "query_id", "query", "context", "lemma", "meaning", T.sense_items("meaning").alias("senses"), "contextual_meaning", "sense_status", "sense_confidence",
        F.when(none, F.lit("nothing was found for this query")).otherwise(says).alias("interpretation"), F.coalesce(T.related_words("meaning", "query"), F.array()).alias("related_words"),
        F.coalesce("sources", F.lit("")).alias("sources"), F.coalesce("total", F.lit(0)).alias("total"), doubts.alias("uncertainties"), (none & F.col("lemma").isNull() & F.col("meaning").isNull()).alias("unknown"),
    )


def prompts(queries: DataFrame, evidence: DataFrame, resources: DataFrame, senses: DataFrame, most: int = SHOWN) -> DataFrame:
    """(query_id, prompt): the evidence as text in fixed sections, the first rows of every part in their order."""
    w = Window.partitionBy("query_id", "part").orderBy("rank")
    x = answer.route(evidence).withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    no = lambda c: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit("-"))
    row = (
        F.when(F.col("part") == "morphology", F.concat_ws(" | ", "resource", no("analysis_type"), no("lemma"))).when(F.col("part") == "lexical", F.concat_ws(" | ", "resource", no("lemma"), no("meaning")))
        .otherwise(F.concat_ws(" | ", "resource", no("work"), no("verse"), no("passage")))
    )
    said = x.groupBy("query_id").pivot("part", ["morphology", "lexical", "literary"]).agg(F.array_sort(F.collect_list(F.struct("k", row.alias("row")))))
    lines = lambda c: F.coalesce(F.nullif(F.array_join(F.transform(c, lambda z: F.concat(F.lit("["), z["k"].cast("string"), F.lit("] "), z["row"])), "\n"), F.lit("")), F.lit("none"))
    found = resources.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "resource", "status", F.col("total_entries").cast("string")))), "\n").alias("found"))
    y = queries.select("query_id", "query", F.coalesce("context", F.lit("")).alias("context")).dropDuplicates(["query_id"])
    for z in (said, found, senses.select("query_id", "status", "sense").dropDuplicates(["query_id"]), answer.conflicts(evidence)):
        y = y.join(z, "query_id", "left")
    sections = [
        ("QUERY", F.col("query")), ("CONTEXT", F.nullif("context", F.lit(""))), ("SENSE", F.concat_ws(": ", "status", "sense")), ("MORPHOLOGY", lines("morphology")), ("LEXICAL EVIDENCE", lines("lexical")),
        ("LITERARY EVIDENCE", lines("literary")), ("CONFLICTS", F.coalesce("lemmas", F.lit("none"))), ("SOURCES", F.coalesce("found", F.lit("none"))),
    ]
    return y.select("query_id", F.array_join(F.array(*[F.concat(F.lit(f"== {h} ==\n"), F.coalesce(v, F.lit("none"))) for h, v in sections]), "\n\n").alias("prompt"))


def process(engine: Engine, queries: DataFrame, dictionary: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Answers of (query_id, query, context): search, rank, sense choice, answer fields."""
    queries = queries.withColumn("query", T.normalize_query("query")).where("query <> ''")
    evidence = cut(ranked(engine.search(queries, force)), "ranked")
    cands = cut(sense_candidates(evidence), "senses")
    senses = wsd.decide(queries.select("query_id", "query", "context"), cands, None if dictionary is None else wsd.synonyms(dictionary))
    return responses(queries, evidence, summary(evidence, queries), cut(senses, "chosen"))
