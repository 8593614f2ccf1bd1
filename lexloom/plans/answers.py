"""Queries of answers, requests, coverage and artefacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import lexicons as L
from lexloom.functions import text as T
from lexloom.operators import compose, evaluate, vectors
from lexloom.operators.evidence import ranked, summary
from lexloom.plans.catalogue import _EV, _engine, _list, _made, _strip, _terms, query
from lexloom.session import cut, read, spread

_RANKED = """, rk as materialized (select *, row_number() over (partition by query order by (status = 'FOUND') desc, case when surface = query then 8 when lemma = query then 6 else 4 end * (status = 'FOUND')::int desc, pass, n, row_key, surface) rank from ded),
fo as (select *, case when kind = 'morphology' then 0 when kind = 'literary_context' then 2 else 1 end part from rk where status = 'FOUND'),
lem as (select query, trim(lemma) lemma from fo where trim(lemma) <> '' qualify row_number() over (partition by query order by part, rank) = 1),
mea as (select query, trim(meaning) meaning, min(rank) r from fo join (select distinct def_id::varchar row_key, headword, meaning from definitions where trim(meaning) <> '') d on d.row_key = fo.row_key and d.headword = fo.surface where resource = 'definitions' group by all),
men as (select query, string_agg(meaning, '; ' order by r) meaning from mea group by 1),
sou as (select query, string_agg(resource, ',' order by n) sources from (select distinct query, resource, n from fo) group by 1),
con as (select query, string_agg(l, ',' order by l) lemmas from (select distinct query, trim(lemma) l from fo where trim(lemma) <> '') group by 1 having count(*) > 1),
tot as (select query, count(*) total from fo group by 1)"""


@query(_EV + _RANKED + """
select q.query as query_id, lemma, meaning, coalesce(sources, '') as sources, coalesce(total, 0) as total, lemmas is not null as several, coalesce(total, 0) = 0 and lemma is null and meaning is null as unknown
from q left join lem using (query) left join men using (query) left join sou using (query) left join tot using (query) left join con using (query)""")
def answer_fields(spark, d):
    """The fields of the answer of every word of the held-out queries, without contexts."""
    q, e = _engine(spark, d)
    e = cut(ranked(e), "ranked")
    q = q.withColumn("context", F.lit(None).cast("string"))
    none = spark.createDataFrame([], "query_id string, status string, confidence string, sense string")
    r = compose.responses(q, e, summary(e, q), none)
    return r.select("query_id", "lemma", "meaning", "sources", "total", F.exists("uncertainties", lambda u: F.startswith(u, F.lit("several"))).alias("several"), "unknown")


@query()
def answers_in_context(spark, d):
    """The whole pipeline: every word of a held-out query in the context of its passage."""
    e = read(spark, d, "eval_items").select("item_id", "query", "passage").distinct()
    q = e.select(F.explode(F.array_distinct(T.index_tokens("query"))).alias("query"), F.col("passage").alias("context"), "item_id")
    q = q.select(F.concat_ws("/", F.col("item_id").cast("string"), "query").alias("query_id"), "query", "context")
    r = compose.process(_made(spark, d), q, read(spark, d, "definitions"))
    return r.select("query_id", "lemma", "meaning", "contextual_meaning", "sense_status", "interpretation", F.array_join("related_words", ",").alias("related_words"), "sources", "total", F.array_join("uncertainties", "; ").alias("uncertainties"), "unknown")


_KINDS = {"definitions": "lexical", "verse_tokens": "literary", "chunks": "literary", "frequency_index": "lexical", "stems": "morphological"}
_WORDS = "(select distinct item_id || '/' || w case_id, category, w from (select item_id, category, unnest(list_filter(string_split(query, ' '), lambda x: x <> '')) w from eval_items))"


def _cases(spark, d):
    """Every word of the held-out queries as a case of its item's category."""
    x = read(spark, d, "eval_items").select("item_id", "category", F.explode(F.filter(F.split("query", " "), lambda w: w != "")).alias("w"))
    return x.select(F.concat_ws("/", F.col("item_id").cast("string"), "w").alias("case_id"), "category", "w").distinct()


def _hits(spark, d):
    c = _cases(spark, d)
    out = None
    for t, col in (("definitions", "headword"), ("verse_tokens", "token"), ("frequency_index", "word_unicode")):
        k = read(spark, d, t).select(F.col(col).alias("w")).join(c.select("w").distinct(), "w", "left_semi").distinct()
        x = c.join(k, "w").select("case_id", F.lit(t).alias("resource"), F.col("w").alias("lemma"), F.lit(False).alias("guessed"))
        out = x if out is None else out.unionByName(x)
    s = c.withColumn("lemma", T.stem("w")).where("lemma <> w").select("case_id", F.lit("stems").alias("resource"), "lemma", F.lit(True).alias("guessed"))
    return c, out.unionByName(s)


_HITS = f"""c as materialized (select * from {_WORDS}),
h as materialized (select case_id, 'definitions' resource, w lemma, false guessed from c where w in (select headword from definitions) union all select case_id, 'verse_tokens', w, false from c where w in (select token from verse_tokens)
  union all select case_id, 'frequency_index', w, false from c where w in (select word_unicode from frequency_index) union all select case_id, 'stems', s, true from (select case_id, w, {{stem}} s from c) where s <> w)"""


def _stemmed(x: str) -> str:
    from lexloom.plans.catalogue import _stem

    return _stem(x)


@query(f"""with {_HITS.format(stem=_stemmed('w'))},
g as (select case_id, count(distinct resource) n, list(distinct case resource when 'stems' then 'morphological' when 'verse_tokens' then 'literary' else 'lexical' end) f, count(distinct trim(lemma)) ls, count(distinct case when trim(lemma) <> '' then resource end) nm, bool_and(guessed) gu from h group by 1),
x as (select c.case_id, category, coalesce(n, 0) n, f, ls, nm, gu from c left join g using (case_id)), y as (select * from x union all select * replace ('all' as category) from x)
select category, count(*) as n_cases, round(100 * avg((n >= 1)::int::double), 2) as in_1_pct, round(100 * avg((n >= 2)::int::double), 2) as in_2_pct, round(100 * avg((n >= 3)::int::double), 2) as in_3_pct, round(100 * avg((n >= 4)::int::double), 2) as in_4_pct,
  round(100 * avg(coalesce(list_contains(f, 'lexical'), false)::int::double), 2) as lexical_pct, round(100 * avg(coalesce(list_contains(f, 'literary'), false)::int::double), 2) as literary_pct, round(100 * avg(coalesce(list_contains(f, 'morphological'), false)::int::double), 2) as morphological_pct,
  round(100 * avg(coalesce(nm >= 2 and ls = 1, false)::int::double), 2) as agreement_pct, round(100 * avg(coalesce(nm >= 2 and ls > 1, false)::int::double), 2) as conflict_pct, round(100 * avg(coalesce(gu, false)::int::double), 2) as guesser_only_pct from y group by 1""")
def coverage_unified(spark, d):
    c, h = _hits(spark, d)
    return evaluate.resource_coverage(h, c, _KINDS)


@query(f"""with {_HITS.format(stem=_stemmed('w'))}, r as (select distinct resource from h), n as (select category, count(*) n_cases from c group by 1), f as (select resource, category, count(distinct case_id) n_found from h join c using (case_id) group by all)
select resource, category, n_cases, coalesce(n_found, 0) as n_found, round(100 * coalesce(n_found, 0)::double / n_cases, 2) as found_pct from n cross join r left join f using (resource, category)""")
def coverage_by_resource(spark, d):
    c, h = _hits(spark, d)
    return evaluate.single_coverage(h, c)


@query(f"""with c as (select * from {_WORDS}), s as (select case_id, w, {_stemmed('w')} s from c)
select case_id, s.w in (select headword from definitions) or s.s in (select headword from definitions) as found, coalesce((select bool_or(contains(s.w, x) or contains(x, s.w)) from (select unnest([s.w, s.s]) x) where x in (select headword from definitions)), false) as matched from s""")
def lemma_matches(spark, d):
    """Whether the headwords found for a word or its stem agree with the word."""
    c = _cases(spark, d)
    heads = read(spark, d, "definitions").select(F.col("headword").alias("lemma")).distinct()
    got = c.select("case_id", F.explode(F.array_distinct(F.array("w", T.stem("w")))).alias("lemma")).join(heads, "lemma")
    return evaluate.lemma_match(c.select("case_id", F.col("w").alias("expected_lemma")), got)


_BODIES = [("a", "GET", "{}"), ("b", "POST", ""), ("c", "POST", "nope"), ("d", "POST", "[1]"), ("e", "POST", '{"query": " "}'), ("f", "POST", '{"context": "x"}'), ("g", "POST", '{"query": " அகம் ", "context": "y"}')]


@query("""select item_id::varchar as request_id, case when trim(query) = '' then 400 else 200 end as status, case when trim(query) = '' then 'query is required' end as error, case when trim(query) <> '' then trim(query) end as query from (select distinct item_id, query from eval_items)
union all select * from (values ('a', 405, 'method not allowed', null), ('b', 400, 'missing body', null), ('c', 400, 'invalid JSON', null), ('d', 400, 'invalid JSON', null), ('e', 400, 'query is required', null), ('f', 400, 'query is required', null), ('g', 200, null, 'அகம்')) t""")
def request_validation(spark, d):
    r = spark.createDataFrame(_BODIES, "request_id string, method string, body string")
    e = read(spark, d, "eval_items").select("item_id", "query").distinct().select(F.col("item_id").cast("string").alias("request_id"), F.lit("POST").alias("method"), F.to_json(F.struct("query")).alias("body"))
    return compose.validate(r.unionByName(e)).select("request_id", "status", "error", "query")


_BOILER = f"""(len(list_filter({_list(L.BOILERPLATE_LOWER)}, lambda w: contains(lower(b), w))) > 0 or len(list_filter({_list(L.BOILERPLATE)}, lambda w: contains(b, w))) > 0 or b in (select unnest({_list(L.BOILERPLATE_WHOLE)}))
  or regexp_matches(b, '{L.BOILERPLATE_PLACE}') or (length(b) < 120 and len(list_filter({_list(L.BOILERPLATE_SHORT)}, lambda w: contains(b, w))) > 0) or (b = coalesce(work, '') and b <> ''))"""


@query(f"select distinct chunk_id, {_BOILER} as boilerplate from (select chunk_id, work, {_strip('regexp_replace(original_text, $$[\\x{200B}-\\x{200D}\\x{FEFF}]$$, $$$$, $$g$$)')} b from chunks)")
def boilerplate_units(spark, d):
    """Which units are the source's own notices."""
    return spread(read(spark, d, "chunks").select("chunk_id", "work", "original_text")).select("chunk_id", T.is_boilerplate("original_text", "work").alias("boilerplate")).distinct()


@query("""with v as (select vector_index, vector, len(list_filter(vector, lambda x: x is null or isnan(x) or isinf(x))) > 0 b, sqrt(list_dot_product(vector::double[], vector::double[])) n from madurai_vectors),
w as (select count(*) c, count_if(vector is null)::bigint nu, count_if(vector is not null and len(vector) <> 384)::bigint le, count_if(len(vector) = 384 and b)::bigint nf, count_if(len(vector) = 384 and not b and n = 0)::bigint ze, count_if(len(vector) = 384 and not b and n > 0 and abs(n - 1) > 0.001)::bigint un, count(*) - count(distinct vector_index) re from v),
i as (select count(*) c, count_if(coalesce(chunk_id, '') = '')::bigint no, count(chunk_id) - count(distinct chunk_id) re, count(distinct vector_index) d, min(vector_index) lo, max(vector_index) hi from madurai_semantic_meta)
select 0::bigint as no_metadata, 0::bigint as no_schema_version, 0::bigint as wrong_model, 1::bigint as wrong_revision, 0::bigint as wrong_dimension, (i.c <> w.c)::bigint as items_not_vectors, 0::bigint as count_not_vectors, (not (lo = 0 and hi = i.c - 1 and d = i.c))::bigint as not_contiguous,
  no as no_chunk_id, i.re as repeated_chunk_id, nu as n_null, le as n_wrong_length, nf as n_not_finite, ze as n_zero, un as n_not_unit, w.re as n_repeated from w, i""")
def artifact_validation(spark, d):
    """The stored vectors and items against a description that names another revision of the model."""
    v = read(spark, d, "madurai_vectors")
    meta = v.agg(F.count("*").alias("vector_count")).select(F.lit("1.0").alias("schema_version"), F.lit("m").alias("model_id"), F.lit("r1").alias("model_revision"), F.lit(384).alias("dimension"), "vector_count")
    return vectors.validate_artifacts(spread(v), read(spark, d, "madurai_semantic_meta"), meta, "m", "r2", 384)
