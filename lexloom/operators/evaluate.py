"""Retrieval and coverage measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import cut


def relevance(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """Ranked hits (query_id, id, rank, score) with ``rel`` and the number of gold ids of the query."""
    g = gold.select("query_id", "id").distinct()
    n = g.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    x = ranked.join(g.withColumn("rel", F.lit(1)), ["query_id", "id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    return x.join(n, "query_id")


def k_sweep(rel: DataFrame, ks: list[int]) -> DataFrame:
    """Macro recall and precision and the mean reciprocal rank at every cut-off."""
    k = F.explode(F.array(*[F.lit(x) for x in ks])).alias("k")
    x = rel.select("query_id", "rank", "rel", "n_gold", k)
    q = x.groupBy("k", "query_id", "n_gold").agg(F.sum(F.when(F.col("rank") <= F.col("k"), F.col("rel")).otherwise(0)).alias("hits"), F.min(F.when((F.col("rel") == 1) & (F.col("rank") <= F.col("k")), F.col("rank"))).alias("first"))
    return q.groupBy("k").agg(F.round(F.avg(F.col("hits") / F.col("n_gold")), 6).alias("recall"), F.round(F.avg(F.col("hits") / F.col("k")), 6).alias("precision"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def threshold_sweep(rel: DataFrame, taus: list[float], k: int = 25) -> DataFrame:
    """Recall, precision (0 if nothing passes), gold and query retention at every threshold over the first k."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in taus])).alias("tau")
    x = rel.where(F.col("rank") <= k).select("query_id", "score", "rel", "n_gold", t)
    ok = F.col("score") >= F.col("tau")
    q = x.groupBy("tau", "query_id", "n_gold").agg(F.sum(F.when(ok, F.col("rel")).otherwise(0)).alias("hits"), F.count_if(ok).alias("kept"))
    return q.groupBy("tau").agg(
        F.round(F.avg(F.col("hits") / F.col("n_gold")), 6).alias("recall"), F.round(F.avg(F.when(F.col("kept") > 0, F.col("hits") / F.col("kept")).otherwise(0.0)), 6).alias("precision"),
        F.round(F.sum("hits") / F.sum("n_gold"), 6).alias("gold_retention"), F.round(F.avg((F.col("hits") > 0).cast("double")), 6).alias("query_retention"), F.round(F.avg((F.col("kept") == 0).cast("double")), 6).alias("rejected"),
    )


def quantiles(df: DataFrame, value: str, by: list[str], qs: dict[str, float]) -> DataFrame:
    """(by..., n, min, mean, max, one column a quantile), exact with linear interpolation; nulls are left out.

    Equal values are combined first; the distinct ones are spread by range, so no
    task holds a group: ranks are sums inside a range plus the sums of the ranges
    before.
    """
    keys = [F.col(c) for c in by]
    c = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    c = cut(c.repartitionByRange(*keys, "__v").withColumn("__p", F.spark_partition_id()), "ranges")
    part = c.groupBy(*by, "__p").agg(F.sum("__c").alias("__s"))  # a row a range and group
    before = part.select(*by, "__p", (F.sum("__s").over(Window.partitionBy(*by).orderBy("__p")) - F.col("__s")).alias("__b"))
    mean = F.sum(F.col("__v") * F.col("__c")) / F.sum("__c")
    total = c.groupBy(*by).agg(F.sum("__c").alias("n"), F.min("__v").alias("min"), mean.alias("mean"), F.max("__v").alias("max"))
    up = F.sum("__c").over(Window.partitionBy(*by, "__p").orderBy("__v")) + F.col("__b")
    x = _with(c, before, [*by, "__p"]).withColumn("__up", up)
    x = _with(x, total.select(*by, F.col("n").alias("__n")), by)
    at = lambda q: q * (F.col("__n") - 1)
    ends = [F.min(F.when(F.col("__up") > f(at(q)), F.col("__v"))).alias(f"__{side}{i}") for i, q in enumerate(qs.values()) for side, f in (("lo", F.floor), ("hi", F.ceil))]
    g = x.groupBy(*by).agg(F.first("__n").alias("__n"), *ends)
    out = [(F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * (at(q) - F.floor(at(q)))).alias(name) for i, (name, q) in enumerate(qs.items())]
    return _with(total, g.select(*by, *out), by).select(*by, "n", "min", "mean", *qs, "max")


def _with(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the columns of ``right`` of the same keys; null keys are equal."""
    right = right.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return left.join(right, on).drop(*[f"__k{i}" for i in range(len(keys))])


def _rounded(df: DataFrame, by: list[str]) -> DataFrame:
    return df.select(*[c if c in (*by, "n") else F.round(c, 6).alias(c) for c in df.columns])


def distribution(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count, least, median, mean and greatest value by group."""
    return _rounded(quantiles(df, value, by, {"median": 0.5}), by).select(*by, "n", "min", "median", "mean", "max")


def percentiles(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return _rounded(quantiles(df, value, by, {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}), by)


def coverage(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """By category: cases, and the shares found in any, two or three resources; ``hits`` has (case_id, resource)."""
    n = hits.select("case_id", "resource").distinct().groupBy("case_id").agg(F.count("*").alias("n"))
    x = cases.select("case_id", "category").distinct().join(n, "case_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = lambda k: F.round(100 * F.avg((F.col("n") >= k).cast("double")), 2)
    return x.groupBy("category").agg(F.count("*").alias("n_cases"), share(1).alias("any_pct"), share(2).alias("two_pct"), share(3).alias("three_pct"))


def resource_coverage(hits: DataFrame, cases: DataFrame, families: dict[str, str]) -> DataFrame:
    """By category and over all ('all'): cases, shares found in one to four resources, by family, and by agreement of lemmas.

    ``hits`` has (case_id, resource, lemma, guessed); ``families`` gives the family
    of a resource (morphological, lexical, literary).
    """
    kind = F.create_map(*[F.lit(x) for kv in families.items() for x in kv])
    h = hits.withColumn("family", F.element_at(kind, F.col("resource")))
    g = h.groupBy("case_id").agg(
        F.countDistinct("resource").alias("n"), F.collect_set("family").alias("f"), F.array_size(F.collect_set(F.trim("lemma"))).alias("lemmas"),
        F.countDistinct(F.when(F.trim("lemma") != "", F.col("resource"))).alias("named"), F.min(F.coalesce("guessed", F.lit(False))).alias("guessed"),
    )
    x = cases.select("case_id", "category").distinct().join(g, "case_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    x = x.unionByName(x.withColumn("category", F.lit("all")))
    pct = lambda c: F.round(100 * F.avg(F.coalesce(c, F.lit(False)).cast("double")), 2)
    least = [pct(F.col("n") >= k).alias(f"in_{k}_pct") for k in (1, 2, 3, 4)]
    by = [pct(F.array_contains("f", f)).alias(f"{f}_pct") for f in sorted(set(families.values()))]
    agree = pct((F.col("named") >= 2) & (F.col("lemmas") == 1)).alias("agreement_pct")
    clash = pct((F.col("named") >= 2) & (F.col("lemmas") > 1)).alias("conflict_pct")
    return x.groupBy("category").agg(F.count("*").alias("n_cases"), *least, *by, agree, clash, pct(F.col("guessed")).alias("guesser_only_pct"))


def lemma_match(expected: DataFrame, returned: DataFrame) -> DataFrame:
    """(case_id, found, matched): whether a returned lemma is the expected one, or one of the two holds the other."""
    e, r = F.trim("expected_lemma"), F.trim("lemma")
    x = expected.join(returned.where(r != ""), "case_id", "left")
    same = (e == r) | F.contains(e, r) | F.contains(r, e)
    return x.groupBy("case_id").agg((F.count("lemma") > 0).alias("found"), F.coalesce(F.max(same), F.lit(False)).alias("matched"))


def single_coverage(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """By resource and category: cases, cases found and their share; a resource without hits is a row of zeros."""
    c = cases.select("case_id", "category").distinct()
    r = hits.select("resource").distinct()
    n = c.groupBy("category").agg(F.count("*").alias("n_cases"))
    f = hits.select("case_id", "resource").distinct().join(c, "case_id").groupBy("resource", "category").agg(F.count("*").alias("n_found"))
    x = n.crossJoin(F.broadcast(r)).join(f, ["resource", "category"], "left")  # resources by categories
    return x.select("resource", "category", "n_cases", F.coalesce("n_found", F.lit(0)).alias("n_found"), F.round(100 * F.coalesce("n_found", F.lit(0)) / F.col("n_cases"), 2).alias("found_pct"))
