"""Word-sense choice from a context, with abstention; every intermediate is a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import lexicons as L
from lexloom.functions.text import clean_sense, fraction_gloss, script_tokens, stem, strip
from lexloom.session import cut

FAR = 999


def _in(c: Column, words) -> Column:
    return c.isin(*words)


def context_tokens(contexts: DataFrame, first: str = "0B80", last: str = "0BFA") -> DataFrame:
    """(query_id, query, pos, tok, stem, dist) of every content token of (query_id, query, context).

    The distance is to the nearest occurrence of the query: an equal token or
    stem, or if there is none a token that holds it; 999 without any.
    """
    t = cut(contexts.select("query_id", "query", F.posexplode(script_tokens("context", first, last)).alias("pos", "tok")), "tokens")
    w = cut(t.select(F.col("tok").alias("word")).union(t.select("query")).distinct().withColumn("stem", stem("word")), "stems")  # each word is stemmed once
    t = t.join(w.withColumnRenamed("word", "tok"), "tok").join(w.select(F.col("word").alias("query"), F.col("stem").alias("qstem")), "query")
    same = (F.col("tok") == F.col("query")) | (F.col("stem") == F.col("qstem"))
    whole = Window.partitionBy("query_id", "query")
    t = t.withColumn("same", same).withColumn("any", F.max("same").over(whole))
    t = t.withColumn("hit", F.when(F.col("any"), F.col("same")).otherwise(F.contains(F.col("tok"), F.col("query"))))
    near = F.last(F.when(F.col("hit"), F.col("pos")), True).over(whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(F.when(F.col("hit"), F.col("pos")), True).over(whole.orderBy("pos").rowsBetween(0, Window.unboundedFollowing))
    d = F.least(F.coalesce(F.col("pos") - near, F.lit(FAR)), F.coalesce(after - F.col("pos"), F.lit(FAR)))
    t = t.withColumn("d", d)
    t = t.where(~F.col("hit") & ~_in(F.col("tok"), L.STOPWORDS) & (F.length("tok") > 1))
    least = F.min("d").over(Window.partitionBy("query_id", "query", "tok"))  # repeated tokens share the least distance
    return t.select("query_id", "query", "pos", "tok", "stem", least.alias("dist"))


def signals(ctx: DataFrame) -> DataFrame:
    """(query_id, query, quantity, somatic, structural, unit): the least distance of a word of each domain, or null, and the nearest quantity's word.

    A word belongs to a domain if it or its stem is in the domain's list; of equal
    distances the first counts.
    """
    d = lambda words: F.min(F.when(_in(F.col("tok"), words) | _in(F.col("stem"), words), F.col("dist")))
    root = F.when(_in(F.col("tok"), L.QUANTITY), F.col("tok")).when(_in(F.col("stem"), L.QUANTITY), F.col("stem"))
    unit = F.min(F.when(root.isNotNull(), F.struct("dist", "pos", root.alias("root"))))["root"]
    return ctx.groupBy("query_id", "query").agg(d(L.QUANTITY).alias("quantity"), d(L.SOMATIC).alias("somatic"), d(L.FURNITURE).alias("structural"), unit.alias("unit"))


def gloss(query: Column, definition: Column, flags: Column, quantity: Column, somatic: Column, structural: Column, unit: Column) -> Column:
    """The chosen sense as it is shown: a fraction beside a near unit, a part of the body or of furniture beside such a word, else as it is."""
    clean = clean_sense(definition)
    prefixed = lambda start, prefix: F.when(F.startswith(clean, F.lit(start)), clean).otherwise(F.concat(F.lit(prefix), clean))
    return (
        F.when(flags["fraction"] & (quantity <= 2), fraction_gloss(query, unit, definition)).when(flags["anatomy"] & (somatic <= 3), prefixed(L.BODY_START, L.BODY_PREFIX))
        .when(flags["furniture"] & (structural <= 3), prefixed(L.SUPPORT_START, L.SUPPORT_START + " — ")).otherwise(clean)
    )


def domain_flags(definition: str) -> Column:
    """``struct<fraction, anatomy, furniture>``: whether a definition holds a word of a domain (a token or stem that is one is held too)."""
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.col(definition), w))
    return F.struct(has((*L.FRACTION_SENSE, "1/4", "1/2", "3/4", "1/8", "\\frac")).alias("fraction"), has(L.ANATOMY_SENSE).alias("anatomy"), has(L.FURNITURE_SENSE).alias("furniture"))


def candidate_terms(cands: DataFrame) -> DataFrame:
    """(query_id, query, cand, kind, term): content tokens and their stems of every definition, each once."""
    t = cands.select("query_id", "query", "cand", F.explode(F.array_distinct(script_tokens("definition"))).alias("tok"))
    t = t.where((F.col("tok") != F.col("query")) & ~_in(F.col("tok"), L.STOPWORDS) & (F.length("tok") > 1))
    s = t.select("query_id", "query", "cand", F.lit("stem").alias("kind"), stem("tok").alias("term")).distinct()
    return t.select("query_id", "query", "cand", F.lit("token").alias("kind"), F.col("tok").alias("term")).unionByName(s)


def synonyms(dictionary: DataFrame) -> DataFrame:
    """(word, syn): content tokens of a meaning's first clause, and their stems."""
    clause = F.split(F.split("meaning", r"\.")[0], ";")[0]
    t = dictionary.where("meaning is not null").select(F.col("headword").alias("word"), F.explode(script_tokens(clause)).alias("syn"))
    t = t.where(~_in(F.col("syn"), L.STOPWORDS) & (F.col("syn") != F.col("word")) & (F.length("syn") > 1)).distinct()
    return t.unionByName(t.select("word", stem("syn").alias("syn"))).distinct()


def prepare(contexts: DataFrame) -> DataFrame:
    """The context tokens as a written table, for the several uses scoring makes of them."""
    return cut(context_tokens(contexts), "context")


def overlap(ctx: DataFrame, cands: DataFrame, syn: DataFrame | None = None) -> DataFrame:
    """(query_id, query, cand, overlap): weighted matches, the first of four kinds for every context token."""
    terms = cut(candidate_terms(cands), "terms")
    n = cands.groupBy("query_id", "query").agg(F.countDistinct("cand").alias("n"))
    df = terms.groupBy("query_id", "query", "kind", "term").agg(F.countDistinct("cand").alias("df"))
    t = terms.join(df, ["query_id", "query", "kind", "term"]).join(n, ["query_id", "query"]).withColumn("idf", F.log((F.col("n") + 1.0) / F.col("df")) + 1.0)
    keys = [("token", "tok", 1), ("stem", "stem", 2)]
    x = None
    for kind, col, prio in keys:
        y = ctx.select("query_id", "query", "pos", "tok", "dist", F.col(col).alias("term")).join(t.where(F.col("kind") == kind), ["query_id", "query", "term"]).withColumn("prio", F.lit(prio))
        x = y if x is None else x.unionByName(y)
    if syn is not None:
        both = ctx.select("query_id", "query", "pos", "tok", "dist", F.explode(F.array_distinct(F.array("tok", "stem"))).alias("word")).join(syn, "word")
        for kind, prio in (("token", 3), ("stem", 4)):
            y = both.select("query_id", "query", "pos", "tok", "dist", F.col("syn").alias("term")).distinct().join(t.where(F.col("kind") == kind), ["query_id", "query", "term"]).withColumn("prio", F.lit(prio))
            x = x.unionByName(y)
    best = Window.partitionBy("query_id", "query", "cand", "pos").orderBy("prio", F.desc("idf"), "term")
    x = x.withColumn("r", F.row_number().over(best)).where("r = 1")
    base = F.element_at(F.array(F.lit(4.0), F.lit(2.5), F.lit(2.0), F.lit(1.5)), F.col("prio"))
    near = F.when(F.col("dist") == 1, 2.5).when(F.col("dist") <= 3, 1.5).otherwise(1.0)
    genus = F.when((F.col("prio") <= 2) & _in(F.col("tok"), L.GENUS), 0.4).otherwise(1.0)
    return x.groupBy("query_id", "query", "cand").agg(F.sum(base * F.col("idf") * near * genus).alias("overlap"))


def scores(contexts: DataFrame, cands: DataFrame, syn: DataFrame | None = None, ctx: DataFrame | None = None) -> DataFrame:
    """(query_id, query, cand, definition, score, domain) of the candidates (query_id, query, cand, definition)."""
    c = cut(cands.withColumn("definition", strip("definition")).where("definition <> ''"), "senses")
    ctx = prepare(contexts) if ctx is None else ctx
    x = c.join(overlap(ctx, c, syn), ["query_id", "query", "cand"], "left").join(signals(ctx), ["query_id", "query"], "left").withColumn("flags", domain_flags("definition"))
    boost = lambda ok, d: F.when(ok & d.isNotNull(), F.when(d == 1, 35.0).when(d <= 3, 20.0 / d).otherwise(5.0 / d)).otherwise(0.0)
    q, a, f = boost(F.col("flags.fraction"), F.col("quantity")), boost(F.col("flags.anatomy"), F.col("somatic")), boost(F.col("flags.furniture"), F.col("structural"))
    s = q + a + f + F.coalesce("overlap", F.lit(0.0))
    s = F.when(s > 0, s + 0.05 / (1 + F.log(F.greatest(F.length("definition"), F.lit(1)).cast("double")))).otherwise(s)
    domain = F.when((q > 0) & (q >= a) & (q >= f), "fraction").when((a > 0) & (a >= f), "anatomy").when(f > 0, "furniture").otherwise("")
    return x.select("query_id", "query", "cand", "definition", F.round(s, 6).alias("score"), domain.alias("domain"))


def decide(contexts: DataFrame, cands: DataFrame, syn: DataFrame | None = None) -> DataFrame:
    """(query_id, query, status, confidence, cand, score, sense): the chosen sense or why there is none."""
    c = cands.withColumn("definition", strip("definition")).where("definition <> ''")
    first = Window.partitionBy("query_id", "query", "source", "definition").orderBy("cand") if "source" in c.columns else Window.partitionBy("query_id", "query", "definition").orderBy("cand")
    c = c.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    ctx = prepare(contexts)
    s = scores(contexts, c, syn, ctx)
    w = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "cand")
    whole = Window.partitionBy("query_id", "query")
    s = s.withColumn("r", F.row_number().over(w)).withColumn("second", F.lead("score").over(w)).withColumn("second_domain", F.lead("domain").over(w)).withColumn("n", F.count("*").over(whole)).where("r = 1")
    n = ctx.groupBy("query_id", "query").agg(F.count("*").alias("tokens"))
    x = contexts.select("query_id", "query", "context").join(s, ["query_id", "query"], "left").join(n, ["query_id", "query"], "left")
    top, gap = F.col("score"), F.col("score") - F.coalesce("second", F.lit(0.0))
    two = F.col("second").isNotNull()
    clash = two & (F.col("second") >= 10) & (top >= 10) & (gap < 3) & (F.col("domain") != F.col("second_domain"))
    status = (
        F.when(F.col("cand").isNull(), "insufficient_evidence").when(F.trim(F.coalesce("context", F.lit(""))) == "", "no_context").when(F.coalesce("tokens", F.lit(0)) == 0, "insufficient_evidence")
        .when(F.col("n") == 1, "single_sense").when(top < 1.0, "insufficient_evidence").when(two & (gap < 0.2) & (top < 3.0), "ambiguous").when(clash, "conflicting_signals").otherwise("selected")
    )
    x = x.withColumn("status", status)
    chosen = F.col("status").isin("selected", "single_sense")
    conf = F.when(F.col("status") == "single_sense", "medium").when(F.col("status") == "selected", F.when(top >= 20, "high").when(top >= 5, "medium").otherwise("low")).when(F.col("cand").isNull() | F.col("status").isin("no_context"), "none").otherwise("low")
    x = x.join(signals(ctx), ["query_id", "query"], "left").withColumn("flags", domain_flags("definition"))
    shown = gloss(F.col("query"), F.col("definition"), F.col("flags"), F.col("quantity"), F.col("somatic"), F.col("structural"), F.col("unit"))
    sense = F.when(F.col("status") == "selected", shown).when(chosen, clean_sense("definition"))
    score = F.when(F.col("status") == "single_sense", 1.0).otherwise(F.coalesce(top, F.lit(0.0)))
    return x.select("query_id", "query", "status", conf.alias("confidence"), F.when(chosen, F.col("cand")).alias("cand"), score.alias("score"), sense.alias("sense"))
