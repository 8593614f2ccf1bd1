"""Queries of the core operators and the SQL that must give the same rows.

Every query runs over its whole tables.  SQL is written from the operator's
definition, not from its plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import lexicons as L
from lexloom.functions import text as T
from lexloom.functions.udfs import highlight_offsets, transliterate
from lexloom.operators import answer, evaluate, index, rank, vectors, wsd
from lexloom.operators.evidence import Engine, gate, lookup_definitions, lookup_wordnet, ranked, summary, support
from lexloom.session import cut, read, spread

TOPK, TAU = 25, 0.25
KS, TAUS = [5, 10, 15, 20, 25], [round(0.1 + 0.05 * i, 2) for i in range(8)]
_Q: dict = {}
_S: dict[str, str] = {}

_SPACE, _LINE = T.SPACE, T.LINE
_TOKENS = rf"[\p{{L}}\p{{N}}\p{{Co}}{L.TOKEN_SIGNS}]+"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _normal(x: str) -> str:
    t = rf"regexp_replace(nfc_normalize({x}), '[\x{{200B}}-\x{{200D}}\x{{FEFF}}]', '', 'g')"
    line = _strip("regexp_replace(y, '[ \\t]+', ' ', 'g')")
    return f"array_to_string(list_filter(list_transform(regexp_split_to_array({t}, '{_LINE}'), lambda y: {line}), lambda y: y <> ''), chr(10))"


def _stem(x: str) -> str:
    w = _strip(x)
    fit = f"list_filter({_list(L.SUFFIXES)}, lambda s: ends_with({w}, s) and length({w}) - length(s) >= 2)"
    return f"case when length({w}) <= 3 or len({fit}) = 0 then {w} else left({w}, length({w}) - length({fit}[1])) end"


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _S[f.__name__] = sql
        return f

    return add


# ---- text functions -------------------------------------------------------


@query(f"select distinct chunk_id, {_normal('original_text')} as text from chunks")
def normalize_text(spark, d):
    return spread(read(spark, d, "chunks").select("chunk_id", "original_text")).select("chunk_id", T.normalize_text("original_text").alias("text")).distinct()


_BACK = rf"regexp_replace(n, '(?i)\s+\[?Back\]?\.?\s*$', '')"
_CLEAN = f"select distinct chunk_id, work, period, chapter, canto, original_text, {_normal('original_text')} as n from chunks"
_CLEANED = f"(select *, case when lower({_strip(_BACK)}) in ('back', '[back]', 'back.', '[back].') then '' else {_strip(_BACK)} end as cleaned from ({_CLEAN}))"


@query(f"select distinct chunk_id, cleaned from {_CLEANED}")
def clean_passage(spark, d):
    return spread(read(spark, d, "chunks").select("chunk_id", "original_text")).select("chunk_id", T.clean_passage("original_text").alias("cleaned")).distinct()


def _html_sql(t: str) -> str:
    for a, b in (("&nbsp;", " "), ("&copy;", "(c)"), ("&amp;", "&"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">")):
        t = f"replace({t}, '{a}', '{b}')"
    t = f"regexp_replace({t}, '<!--.*?-->', '', 'gs')"
    return f"regexp_replace(regexp_replace({t}, '<style[^>]*>.*?</style>', '', 'gis'), '<script[^>]*>.*?</script>', '', 'gis')"


_HTML = f"""
with a as (select distinct chunk_id, {_html_sql('original_text')} t from chunks),
b as (select chunk_id, case when regexp_matches(t, '<(?:br|p|div|h[1-6]|tr|center)[^>]*>', 'i') then
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[\\r\\n]+', ' ', 'g'), '(?:<br\\s*/?>\\s*){{2,}}', chr(10) || chr(10), 'gi'),
    '</?(?:p|h[1-6]|tr|div|center|font|ul|li|hr|table|blockquote)[^>]*>', chr(10) || chr(10), 'gi'), '<br\\s*/?>', chr(10), 'gi')
  else regexp_replace(t, '\\r\\n|\\r', chr(10), 'g') end t from a)
select chunk_id, {_strip("regexp_replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '\\n[ \\t]*\\n+', chr(10) || chr(10), 'g')")} as text from b
"""


@query(_HTML)
def html_clean(spark, d):
    return spread(read(spark, d, "chunks").select("chunk_id", "original_text")).select("chunk_id", T.clean_html("original_text").alias("text")).distinct()


_WIKI = r"regexp_replace(regexp_replace(meaning, '\[\[(?:[^|\]]*\|)?([^\]]+)\]\]', '\1', 'g'), '\[http[^\s]+ ([^\]]+)\]', '\1', 'g')"
for _p in (r"\[http[^\]]+\]", r"\{\{[^\}]+\}\}", r"<[^>]+>", "''''''?"):
    _WIKI = f"regexp_replace({_WIKI}, '{_p}', '', 'g')"
_WIKI = rf"regexp_replace({_WIKI}, '\.([a-zA-Z\x{{0B80}}-\x{{0BFF}}])', '. \1', 'g')"


@query(f"select distinct def_id, {_strip(_WIKI)} as text from definitions where meaning is not null")
def wikitext_clean(spark, d):
    return read(spark, d, "definitions").where("meaning is not null").select("def_id", T.clean_wikitext("meaning").alias("text")).distinct()


@query(f"select distinct def_id, {_strip(rf'''regexp_replace(regexp_replace(meaning, '\\frac\{{([^}}]*)\}}\{{([^}}]*)\}}', '\1/\2', 'g'), '{_SPACE}+', ' ', 'g')''')} as text from definitions where meaning is not null")
def sense_text_clean(spark, d):
    return read(spark, d, "definitions").where("meaning is not null").select("def_id", T.clean_sense("meaning").alias("text")).distinct()


_SAN = _strip(r"regexp_replace(regexp_replace(t, '[*^:{}()\[\]+\-~]', ' ', 'g'), '" + _SPACE + "+', ' ', 'g')")


@query(f"""select item_id, '"' || coalesce(replace({_SAN}, '"', '""'), '') || '"' as phrase from (select distinct item_id, {_strip('query')} t from eval_items)""")
def sanitize_query(spark, d):
    return read(spark, d, "eval_items").select("item_id", T.sanitize_query("query").alias("phrase")).distinct()


@query(f"select token, {_stem('token')} as stem from (select distinct token from verse_tokens where token <> '')")
def stem_words(spark, d):
    return read(spark, d, "verse_tokens").select("token").where("token <> ''").distinct().select("token", T.stem("token").alias("stem"))


@query(f"""
with t as (select distinct doc_id, text from documents where text is not null)
select doc_id, array_to_string(regexp_extract_all(text, '[\\x{{0B80}}-\\x{{0BFA}}]+'), ' ') as narrow, array_to_string(regexp_extract_all(text, '[\\x{{0B80}}-\\x{{0BFF}}]+'), ' ') as wide from t
""")
def script_tokens(spark, d):
    t = read(spark, d, "documents").where("text is not null").select("doc_id", "text")
    return spread(t).select("doc_id", F.array_join(T.script_tokens("text"), " ").alias("narrow"), F.array_join(T.script_tokens("text", last="0BFF"), " ").alias("wide")).distinct()


_ELIG = f"""case when cleaned = '' and regexp_matches(coalesce(original_text, ''), '\\bback\\b', 'i') then 'navigation_artifact' when cleaned = '' then 'empty_passage'
  when chunk_id in {tuple([*L.CONTACT_IDS, ''])} or regexp_matches(original_text, '[\\p{{L}}\\p{{M}}\\p{{N}}_.-]+@[\\p{{L}}\\p{{M}}\\p{{N}}_.-]+\\.[\\p{{L}}\\p{{M}}\\p{{N}}_]+') then 'webmaster_contact'
  when chunk_id in {tuple([*L.HEADER_IDS, ''])} or (starts_with(trimmed, 'Source:') and (contains(trimmed, 'Published by:') or contains(trimmed, 'பதிப்புக் கழகம்') or contains(trimmed, '[Copy-right]'))) then 'publication_source_header'
  {" ".join(f"when regexp_matches(cleaned, '{p}') then '{r}'" for r, p in L.ELIGIBILITY)} end"""
_ELIGIBLE = f"(select *, {_ELIG} as reason from (select *, {_strip('original_text')} as trimmed from {_CLEANED}))"


def _prepared(spark, d) -> DataFrame:
    c = spread(read(spark, d, "chunks").select("chunk_id", "work", "period", "chapter", "canto", "original_text"))
    # written once: the rules below name the cleaned text many times, and a filter on them would clean it again for each
    c = cut(c.withColumn("cleaned", T.clean_passage("original_text")).distinct(), "cleaned")
    return c.withColumn("reason", T.eligibility("chunk_id", "original_text", "cleaned"))


@query(f"select coalesce(reason, 'eligible') as reason, count(distinct chunk_id) as n from {_ELIGIBLE} group by 1")
def eligibility_reasons(spark, d):
    return _prepared(spark, d).groupBy(F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(F.countDistinct("chunk_id").alias("n"))


_BUCKET = "case when length({0}) < 25 then '1 under 25' when length({0}) <= 50 then '2 to 50' when length({0}) <= 100 then '3 to 100' when length({0}) <= 200 then '4 to 200' when length({0}) <= 500 then '5 to 500' else '6 over 500' end"


@query(f"""
with c as (select distinct chunk_id, original_text, cleaned from {_CLEANED}),
b as (select unnest(['1 under 25', '2 to 50', '3 to 100', '4 to 200', '5 to 500', '6 over 500']) bucket),
o as (select {_BUCKET.format('original_text')} bucket, count(*) n from c group by 1), k as (select {_BUCKET.format('cleaned')} bucket, count(*) n from c group by 1)
select b.bucket, coalesce(o.n, 0) as n_original, coalesce(k.n, 0) as n_cleaned from b left join o using (bucket) left join k using (bucket)
""")
def length_histogram(spark, d):
    c = _prepared(spark, d).select("chunk_id", "original_text", "cleaned").distinct()
    b = c.select(F.explode(F.array(F.struct(F.expr(_BUCKET.format("original_text")).alias("bucket"), F.lit(1).alias("o"), F.lit(0).alias("k")), F.struct(F.expr(_BUCKET.format("cleaned")).alias("bucket"), F.lit(0).alias("o"), F.lit(1).alias("k")))).alias("x")).select("x.*")
    all_ = spark.createDataFrame([(x,) for x in ("1 under 25", "2 to 50", "3 to 100", "4 to 200", "5 to 500", "6 over 500")], "bucket string")
    got = b.groupBy("bucket").agg(F.sum("o").alias("n_original"), F.sum("k").alias("n_cleaned"))
    return all_.join(got, "bucket", "left").select("bucket", F.coalesce("n_original", F.lit(0)).alias("n_original"), F.coalesce("n_cleaned", F.lit(0)).alias("n_cleaned"))


_TRIM = lambda c: _strip(f"coalesce({c}, '')")
_OLD = " or ".join(["coalesce(period, '') in ('Sangam', 'Epic')", *[f"contains(coalesce(work, ''), '{w}')" for w in L.CLASSICAL_WORKS]])


@query(f"""select distinct chunk_id, case
  when (starts_with(chunk_id, '{L.COUPLET_PREFIX}') or work = '{L.COUPLET_WORKS[0]}') and {_TRIM('chapter')} <> '' then 'passage: அதிகாரம்: ' || {_TRIM('chapter')} || '. ' || replace(cleaned, chr(10), ' ')
  when (starts_with(chunk_id, '{L.COUPLET_PREFIX}') or work = '{L.COUPLET_WORKS[0]}') then 'passage: ' || replace(cleaned, chr(10), ' ')
  when starts_with(chunk_id, '{L.APHORISM_PREFIXES[0]}') or starts_with(chunk_id, '{L.APHORISM_PREFIXES[1]}') or coalesce(work, '') in {L.APHORISM_WORKS} then 'passage: ' || cleaned
  when ({_OLD}) and {_TRIM('canto')} <> '' then 'passage: ' || {_TRIM('canto')} || ': ' || cleaned else 'passage: ' || cleaned end as passage
from {_ELIGIBLE} where reason is null""")
def canonical_passage(spark, d):
    return _prepared(spark, d).where("reason is null").select("chunk_id", T.embedding_text("chunk_id", "work", "period", "chapter", "canto", "cleaned").alias("passage")).distinct()


_KEYS = "list_filter(string_split(query, ' '), lambda w: w <> '')"
_PARTS = f"list_filter(list_transform(regexp_split_to_array(regexp_replace(passage, '([.!?|])\\s+', '\\1' || chr(10), 'g'), '[\\r\\n]+'), lambda x: {_strip('x')}), lambda x: x <> '')"
_LINES = f"""(select item_id, query, keys, coalesce(list_filter(parts, lambda x: len(list_filter(keys, lambda k: contains(lower(x), lower(k)))) > 0)[1], parts[1]) line
  from (select distinct item_id, query, {_KEYS} keys, {_PARTS} parts from eval_items))"""


def _lines(spark, d) -> DataFrame:
    e = read(spark, d, "eval_items").select("item_id", "query", "passage").distinct()
    return e.withColumn("keys", F.filter(F.split("query", " "), lambda w: w != "")).withColumn("line", T.relevant_line("passage", F.col("keys")))


@query(f"select item_id, line from {_LINES}")
def relevant_line(spark, d):
    return _lines(spark, d).select("item_id", "line")


@query(f"""with a as (select *, list_sort(list_transform(list_filter(keys, lambda k: contains(lower(line), lower(k))), lambda k: [instr(lower(line), lower(k)), length(k)]))[1] f from {_LINES}),
b as (select *, greatest(f[1] - 41, 0) x, least(f[1] - 1 + f[2] + 60, length(line)) y from a)
select item_id, case when length(line) <= 120 then line when f is null then left(line, 120) || '...' else
  (case when x > 0 then '... ' else '' end) || {_strip('substring(line, x::bigint + 1, (y - x)::bigint)')} || (case when y < length(line) then ' ...' else '' end) end as shown from b""")
def context_window(spark, d):
    return _lines(spark, d).select("item_id", T.context_window("line", F.col("keys")).alias("shown"))


_SPANS = f"""with recursive l as (select item_id, line, list_filter(keys, lambda k: trim(k) <> '') keys from {_LINES}),
h as materialized (select item_id, p - 1 s, max(p - 1 + length(k)) e from (select item_id, line, unnest(keys) k from l), unnest(generate_series(1, length(line))) u(p) where substring(lower(line), p::bigint, length(k)) = lower(k) group by item_id, p),
n as materialized (select a.item_id, a.s, a.e, min(b.s) nx from h a left join h b on b.item_id = a.item_id and b.s >= a.e group by all),
r as (select item_id, s, e, nx from (select * from n qualify row_number() over (partition by item_id order by s) = 1) union all select n.item_id, n.s, n.e, n.nx from r join n on n.item_id = r.item_id and n.s = r.nx)
select item_id, s::int as start, e::int as end from r"""


@query(_SPANS)
def highlight_spans(spark, d):
    """Spans of the query's words in the passage."""
    x = _lines(spark, d).withColumn("passage", F.col("line"))
    return x.select("item_id", F.explode(highlight_offsets("line", "keys")).alias("s")).select("item_id", "s.start", "s.end")


_VERSE_LINES = f"""(select verse_id, token, keys, coalesce(list_filter(parts, lambda x: len(list_filter(keys, lambda k: contains(lower(x), lower(k)))) > 0)[1], parts[1]) line
  from (select verse_id, token, [token] keys, {_PARTS} parts from (select distinct verse_id, classical_tamil passage from verses where classical_tamil is not null)
    join (select distinct verse_id, token from verse_tokens where token <> '') using (verse_id)))"""
_OF_VERSES = lambda q: _S[q].replace(_LINES, _VERSE_LINES).replace("item_id", "verse_id, token")


def _verse_lines(spark, d) -> DataFrame:
    v = read(spark, d, "verses").select("verse_id", F.col("classical_tamil").alias("passage")).where("passage is not null").distinct()
    t = read(spark, d, "verse_tokens").select("verse_id", "token").where("token <> ''").distinct()
    return v.join(t, "verse_id").withColumn("keys", F.array("token")).withColumn("line", T.relevant_line("passage", F.col("keys")))


@query(_OF_VERSES("relevant_line"))
def relevant_line_verses(spark, d):
    """The line of every verse for each of its words."""
    return _verse_lines(spark, d).select("verse_id", "token", "line")


@query(_OF_VERSES("context_window"))
def context_window_verses(spark, d):
    return _verse_lines(spark, d).select("verse_id", "token", T.context_window("line", F.col("keys")).alias("shown"))


_PAIRED = f"(select struct_pack(v := verse_id, t := token) item_id, line, keys from {_VERSE_LINES})"


@query(_SPANS.replace(_LINES, _PAIRED).replace("select item_id, s::int as start", "select item_id.v as verse_id, item_id.t as token, s::int as start"))
def highlight_spans_verses(spark, d):
    """Spans of every word of a verse in its line."""
    x = _verse_lines(spark, d)
    return x.select("verse_id", "token", F.explode(highlight_offsets("line", "keys")).alias("s")).select("verse_id", "token", "s.start", "s.end")


_SEL = "string_split(query, ' ')[1]"
_SENT = "regexp_extract_all(passage, '[^.?!]+[.?!]*')"


@query(f"""select distinct item_id, coalesce({_strip(f"coalesce(list_filter({_SENT}, lambda p: contains(p, {_SEL}))[1], list_filter({_SENT}, lambda p: contains(lower(p), lower({_SEL})))[1], case when passage <> '' then left(passage, 200) end)")}, '') as sentence from eval_items""")
def sentence_context(spark, d):
    return read(spark, d, "eval_items").select("item_id", T.sentence_of("passage", F.split("query", " ")[0]).alias("sentence")).distinct()


@query(f"""
with p as (select distinct def_id, meaning, string_split(meaning, ';') parts from definitions where meaning is not null),
s as (select def_id, i as number, {_strip('parts[i]')} t from p, unnest(generate_series(1, len(parts))) u(i))
select distinct def_id, number, regexp_split_to_array(t, '\\s*[—\\-:]\\s*')[1] as title,
  case when regexp_matches(t, '[—\\-:]') then regexp_replace(t, '^.*?\\s*[—\\-:]\\s*', '', 's') end as description from s where t <> ''
""")
def sense_parse(spark, d):
    x = read(spark, d, "definitions").where("meaning is not null").select("def_id", F.explode(T.sense_items("meaning")).alias("s")).distinct()
    return x.select("def_id", F.col("s.number").cast("bigint").alias("number"), "s.title", "s.description")


_REL = r"^[\x{0B80}-\x{0BFF}]+(?: [\x{0B80}-\x{0BFF}]+)?$"


@query(f"""
with p as (select distinct def_id, headword, regexp_split_to_array(meaning, '[,;]\\s*') parts from definitions where meaning is not null),
s as (select def_id, headword, regexp_replace(unnest(parts), '^[ .]+|[ .]+$', '', 'g') word from p)
select distinct def_id, word from s where regexp_matches(word, '{_REL}') and length(word) > 2 and word <> headword
""")
def related_words(spark, d):
    x = read(spark, d, "definitions").where("meaning is not null").select("def_id", F.explode(T.related_words("meaning", "headword")).alias("word"))
    return x.distinct()


_TAGS = [("a+noun+dat+pl", None, "noun.fst"), ("b+verb+past=x+sg", None, "verb-guess.fst"), ("c+NOUN+loc", "n", None), ("d", None, None), ("e+fut+acc+gen", None, "x"), ("f+plural", "v", "")]


@query("select * from (values (1, 'a', 'Dative', 'Plural', null, 'core'), (2, 'b', null, 'Singular', 'Past', 'guesser'), (3, 'n', 'Locative', null, null, 'lexical_mapping'), (4, 'd', null, null, null, 'lexical_mapping'), (5, 'e', 'Accusative', null, 'Future', 'core'), (6, 'v', null, 'Plural', null, 'lexical_mapping')) t(n, pos, \"case\", number, tense, analysis_type)")
def morph_tags(spark, d):
    x = spark.createDataFrame([(i, *r) for i, r in enumerate(_TAGS, 1)], "n int, raw string, pos string, model string")
    return x.select("n", T.morphology("raw", "pos", "model").alias("m")).select("n", "m.pos", "m.case", "m.number", "m.tense", "m.analysis_type")


_PICK = lambda words, at: f"list_filter({_list(words)}, lambda x: starts_with(substring(w, {at}), x))[1]"
_OF = lambda table, key: f"{_list(table.values())}[list_position({_list(table)}, {key})]"


@query(f"""with recursive r as (select distinct word_raw w, 1::bigint i, '' o from frequency_index where word_raw is not null
  union all select w, i + greatest(length(coalesce(c, '')) + length(coalesce(v, '')), 1), o || case when c is not null then {_OF(L.CONSONANTS, 'c')} || coalesce({_OF(L.SIGNS, 'v')}, '{L.VIRAMA}') when v is not null then {_OF(L.VOWELS, 'v')} else substring(w, i, 1) end
  from (select *, {_PICK(L.VOWELS, "i + length(coalesce(c, ''))")} v from (select *, {_PICK(L.CONSONANTS, 'i')} c from r where i <= length(w))))
select w as word_raw, o as word from r where i > length(w)""")
def transliterate_words(spark, d):
    """Romanised words of the published frequency list in the script."""
    return read(spark, d, "frequency_index").where("word_raw is not null").select("word_raw").distinct().select("word_raw", transliterate("word_raw").alias("word"))


@query("select distinct doc_id, sha256(text) as digest from documents where text is not null")
def fingerprint(spark, d):
    return spread(read(spark, d, "documents").where("text is not null").select("doc_id", "text")).select("doc_id", F.sha2("text", 256).alias("digest")).distinct()


# ---- index and lookups ----------------------------------------------------

_POS = f"(select id, unnest(generate_series(0, len(ts) - 1)) pos, unnest(ts) token from (select chunk_id id, regexp_extract_all(lower(any_value(normalized_text)), '{_TOKENS}') ts from chunks group by chunk_id))"
_TERMS = f"(select distinct unnest(regexp_extract_all(lower(query), '{_TOKENS}')) term from eval_items)"


def _pos(spark, d) -> DataFrame:
    return index.positions(read(spark, d, "chunks"), "chunk_id", "normalized_text")


def _terms(spark, d) -> DataFrame:
    t = read(spark, d, "eval_items").select(F.explode(T.index_tokens("query")).alias("term")).distinct()
    return t.select(F.col("term").alias("query_id"), "term")


@query(f"select token, count(*) as n_tokens, count(distinct doc_id) as n_units from (select doc_id, unnest(regexp_extract_all(lower(text), '{_TOKENS}')) token from (select distinct doc_id, text from documents)) group by 1")
def token_stats(spark, d):
    return index.token_stats(index.positions(read(spark, d, "documents"), "doc_id", "text"))


@query(f"""select * from (select term as query_id, id, row_number() over (partition by term order by id) as rank from (select distinct term, id from {_POS} p join {_TERMS} t on p.token = t.term)) where rank <= 25""")
def term_lookup_top25(spark, d):
    return index.term_lookup(_pos(spark, d), _terms(spark, d))


@query(f"""
with q as (select distinct item_id query_id, regexp_extract_all(lower(query), '{_TOKENS}') q from eval_items),
c as (select doc_id id, ' ' || array_to_string(regexp_extract_all(lower(text), '{_TOKENS}'), ' ') || ' ' t from documents where text is not null),
h as (select query_id, id from q join c on contains(t, ' ' || array_to_string(q, ' ') || ' ') where len(q) > 0)
select * from (select query_id, id, row_number() over (partition by query_id order by id) as rank from h) where rank <= 25
""")
def phrase_lookup_top25(spark, d):
    q = read(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("query").alias("phrase")).distinct()
    return index.phrase_lookup(index.positions(read(spark, d, "documents"), "doc_id", "text"), q)


@query("select distinct verse_id, layer from verses where verse_id in (select verse_id from verse_tokens where token in (select headword from definitions))")
def token_distinct_verses(spark, d):
    heads = read(spark, d, "definitions").select(F.col("headword").alias("token")).distinct()
    ids = read(spark, d, "verse_tokens").select("token", "verse_id").join(heads, "token", "left_semi").select("verse_id").distinct()
    return read(spark, d, "verses").select("verse_id", "layer").join(ids, "verse_id", "left_semi").distinct()


@query("select headword, count(distinct verse_id) as n_verses from (select distinct headword from definitions) d join verse_tokens t on t.token = d.headword or t.normalized_token = d.headword group by 1")
def or_key_lookup(spark, d):
    heads = read(spark, d, "definitions").select(F.col("headword").alias("key")).distinct()
    t = read(spark, d, "verse_tokens").select("verse_id", F.explode(F.array_distinct(F.array("token", "normalized_token"))).alias("key")).distinct()
    return t.join(heads, "key").groupBy(F.col("key").alias("headword")).agg(F.count("*").alias("n_verses"))


@query("select o_orderkey, l_linenumber, l_partkey from orders left join (select * from lineitem qualify row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) = 1) on o_orderkey = l_orderkey")
def left_first_match(spark, d):
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    first = li.groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("x"))
    return read(spark, d, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "x.l_linenumber", "x.l_partkey")


@query("with f as (select * from frequency_index qualify row_number() over (partition by word_unicode order by freq desc nulls last, word_raw nulls last) = 1) select token, freq::bigint as freq, word_raw from (select distinct token from verse_tokens where token <> '') left join f on token = word_unicode")
def frequency_attach(spark, d):
    f = rank.first_wins(read(spark, d, "frequency_index"), ["word_unicode"], [F.desc_nulls_last("freq"), F.asc_nulls_last("word_raw")])
    t = read(spark, d, "verse_tokens").select("token").where("token <> ''").distinct()
    return t.join(f, F.col("token") == F.col("word_unicode"), "left").select("token", F.col("freq").cast("bigint").alias("freq"), "word_raw")


@query(f"select (select count(distinct chunk_id) from chunks) as n_units, (select count(distinct id) from {_POS}) as n_indexed")
def index_parity(spark, d):
    return index.parity(read(spark, d, "chunks"), _pos(spark, d), "chunk_id")


# ---- the evidence engine --------------------------------------------------


def _analyses(spark, d) -> DataFrame:
    """Lemmas come from the stemmer."""
    words = read(spark, d, "verse_tokens").select("token").where("token <> ''").distinct().withColumn("lemma", T.stem("token"))
    return words.where("lemma <> token").select(F.col("token").alias("surface"), "lemma", F.lit("suffix").alias("model"), F.lit(None).cast("string").alias("tags"))


def _made(spark, d, **more) -> Engine:
    t = {n: read(spark, d, n) for n in ("definitions", "verse_tokens", "verses", "chunks")}
    return Engine(t["definitions"], t["verse_tokens"], t["verses"], t["chunks"], _analyses(spark, d), **more)


def _engine(spark, d) -> tuple[DataFrame, DataFrame]:
    """Evidence for every token of the held-out queries."""
    q = _terms(spark, d).withColumnRenamed("term", "query")
    return q, _made(spark, d).search(q)


_EV = f"""
with pos as materialized (select distinct id, token from {_POS}), q as (select term query from {_TERMS}),
an as materialized (select token surface, stem lemma from (select token, {_stem('token')} stem from (select distinct token from verse_tokens where token <> '')) where stem <> token),
de as materialized (select distinct headword k, def_id::varchar row_key from definitions where meaning is not null and meaning <> ''),
vt as materialized (select distinct k, verse_id from (select verse_id, unnest([token, normalized_token]) k from verse_tokens) where k <> ''),
ve as materialized (select verse_id, any_value(classical_tamil) passage from verses group by 1), ch as materialized (select chunk_id, any_value(normalized_text) passage from chunks group by 1),
k1 as (select query, 1 pass, query k from q),
m1 as (select query, pass, 'morphology' resource, 'core|suffix|' || lemma || '|' row_key, k surface, lemma, null passage, 'morphology:suffix' source_id, 'morphology' kind from k1 join an on k = surface),
lk as (select * from k1 union select query, 2, lemma from m1),
co as (select k, id from (select k, id, row_number() over (partition by k order by id) r from (select distinct k from lk) join pos on lower(k) = token) where r <= 25),
f as (
  select * from m1
  union all select query, pass, 'definitions', row_key, k, k, null, 'definitions:' || row_key, 'lexical' from lk join de using (k)
  union all select query, pass, 'verses', verse_id, k, null, passage, 'verses:' || verse_id, 'literary_context' from lk join vt using (k) join ve using (verse_id)
  union all select query, pass, 'corpus', chunk_id, k, null, passage, chunk_id, 'literary_context' from lk join co using (k) join ch on chunk_id = id),
res as (select unnest(['morphology', 'definitions', 'verses', 'corpus']) resource, unnest([1, 2, 5, 6]) n),
al as (select query, pass, resource, row_key, surface, lemma, passage, source_id, kind, 'FOUND' status from f
  union all select query, 1, resource, '', query, null, null, null, 'lexical', 'NOT_FOUND' from q, res where not exists (select 1 from f where f.query = q.query and f.resource = res.resource and f.pass = 1)),
ev as (select al.*, n from al join res using (resource)
  qualify row_number() over (partition by query, resource, status, case when resource = 'corpus' and status = 'FOUND' then source_id else pass || kind || coalesce(surface, '') || row_key end order by pass, surface, n, row_key) = 1),
ded as materialized (select * from ev qualify row_number() over (partition by query, resource, kind, coalesce(surface, ''), coalesce(lemma, ''), coalesce(passage, ''), coalesce(source_id, '') order by pass, surface, n, row_key) = 1)
"""


@query(_EV + """select query as query_id, resource, status, surface, source_id, row_number() over (partition by query order by (status = 'FOUND') desc, case when surface = query then 8 when lemma = query then 6 else 4 end * (status = 'FOUND')::int desc, pass, n, row_key, surface) as rank from ded""")
def evidence_ranked(spark, d):
    _, e = _engine(spark, d)
    return ranked(e).select("query_id", "resource", "status", "surface", "source_id", "rank")


@query(_EV + "select query as query_id, resource from ded where status = 'NOT_FOUND'")
def miss_sentinels(spark, d):
    _, e = _engine(spark, d)
    return e.where("status = 'NOT_FOUND'").select("query_id", "resource")


@query(_EV + "select query as query_id, lemma, count(*) as n_rows from (select query, surface lemma, source_id from ded where pass = 2 and status = 'FOUND') group by all")
def lemma_expansion(spark, d):
    _, e = _engine(spark, d)
    return e.where("pass = 2 and status = 'FOUND'").groupBy("query_id", F.col("surface").alias("lemma")).agg(F.count("*").alias("n_rows"))


@query(_EV + """, tg as (select distinct query, t from (select query, unnest([query, lemma]) t from ded where status = 'FOUND') where trim(t) <> ''), hs as (select distinct query, resource, t from (select query, resource, unnest([surface, lemma]) t from ded where status = 'FOUND') where t is not null)
select query as query_id, t as target, string_agg(resource, ',' order by resource) as sources from tg join hs using (query, t) group by 1, 2""")
def cross_source_support(spark, d):
    _, e = _engine(spark, d)
    return support(e)


@query(_EV + """, r6 as (select unnest(['morphology', 'definitions', 'dictionary', 'wordnet', 'verses', 'corpus']) resource), g as (select query, resource, count(*) n from ded where status = 'FOUND' group by all)
select q.query as query_id, r6.resource, case when g.n > 0 then 'FOUND' else 'NOT_FOUND' end as status, coalesce(g.n, 0) as total_entries, case when r6.resource = 'morphology' then coalesce(g.n, 0) end as core_analyses, case when r6.resource = 'morphology' then 0::bigint end as guesser_analyses
from q cross join r6 left join g on g.query = q.query and g.resource = r6.resource""")
def resource_summary(spark, d):
    q, e = _engine(spark, d)
    return summary(e, q)


@query(_EV + """, g as (select query, count_if(resource = 'corpus')::bigint c, count_if(resource in ('verses', 'corpus'))::bigint l, count_if(resource = 'definitions')::bigint x, count_if(resource = 'morphology')::bigint m from ded where status = 'FOUND' group by 1)
select q.query as query_id, coalesce(c, 0) as n_corpus, coalesce(l, 0) as n_literary, coalesce(x, 0) as n_lexical, coalesce(m, 0) as n_morphology, (coalesce(c, 0) >= 25 or (coalesce(l, 0) >= 10 and (coalesce(x, 0) > 0 or coalesce(m, 0) > 0))) as skip from q left join g using (query)""")
def short_circuit_decision(spark, d):
    q, e = _engine(spark, d)
    return gate(e, q)


_GATE = """g as (select query, count_if(resource = 'corpus')::bigint c, count_if(resource in ('verses', 'corpus'))::bigint l, count_if(resource = 'definitions')::bigint x, count_if(resource = 'morphology')::bigint m
  from ded where status = 'FOUND' group by 1),
go as (select q.query from q left join g using (query) where not (coalesce(c, 0) >= 25 or (coalesce(l, 0) >= 10 and (coalesce(x, 0) > 0 or coalesce(m, 0) > 0))))"""
_UNIT = "list_transform(vector, lambda x: x::double / sqrt(list_dot_product(vector::double[], vector::double[])))"


def _query_vectors(spark, d, q: DataFrame) -> DataFrame:
    """(query_id, vec): the vector of the first unit that holds the query's word stands for a model's."""
    hits = index.term_lookup(_pos(spark, d), q.select("query_id", F.col("query").alias("term")), 1).select("query_id", F.col("id").alias("chunk_id"))
    meta = read(spark, d, "madurai_semantic_meta").select("chunk_id", "vector_index").join(hits, "chunk_id").groupBy("query_id").agg(F.min("vector_index").alias("vector_index"))
    v = _good_vectors(spark, d).groupBy("vector_index").agg(F.max("vector").alias("vec"))
    return meta.join(v, "vector_index").select("query_id", "vec")


def _good_vectors(spark, d) -> DataFrame:
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x))
    return spread(read(spark, d, "madurai_vectors")).where(F.size("vector") == 384).where(~bad).where(F.exists("vector", lambda x: x != 0))


@query(_EV + f""", {_GATE},
gv as materialized (select vector_index, max(vector) vector from madurai_vectors where len(vector) = 384 and len(list_filter(vector, lambda x: x is null or isnan(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0 group by 1),
me as materialized (select vector_index, unnest(min({{'chunk_id': chunk_id, 'work_name': work_name, 'author': author, 'period': period, 'genre': genre, 'stanza_number': stanza_number}})) from madurai_semantic_meta where chunk_id is not null group by 1),
cv as materialized (select chunk_id, max(vector) vector from gv join me using (vector_index) group by 1), cn as materialized (select chunk_id, {_UNIT} e from cv),
fu as (select query, min(id) chunk_id from q join pos on query = token group by 1),
qv as (select query, min(vector_index) vector_index from fu join madurai_semantic_meta using (chunk_id) group by 1),
qe as materialized (select query, {_UNIT} e from qv join gv using (vector_index) join go using (query)),
sc as (select query, chunk_id, round(list_dot_product(qe.e, cn.e), 6) score from qe, cn),
tk as (select * from sc qualify row_number() over (partition by query order by score desc, chunk_id) <= 25),
hi as (select * from tk where score >= 0.845), ex as (select query, source_id chunk_id from ded where resource = 'corpus' and status = 'FOUND')
select hi.query as query_id, hi.chunk_id as source_id, case when ex.query is null then 'semantic' else 'exact' end as retrieval, score from hi left join ex on ex.query = hi.query and ex.chunk_id = hi.chunk_id""")
def engine_semantic(spark, d):
    """What the third pass adds: new units, and the scores of units that were there."""
    q = _terms(spark, d).withColumnRenamed("term", "query")
    e = _made(spark, d, semantic=(_good_vectors(spark, d), read(spark, d, "madurai_semantic_meta"), _query_vectors(spark, d, q)))
    return e.search(q).where("score is not null").select("query_id", "source_id", "retrieval", "score")


@query("""with q as (select distinct unnest(regexp_extract_all(lower(query), '""" + _TOKENS + """')) query from eval_items), h as (select distinct headword from definitions where meaning is not null and meaning <> '')
select query as query_id, 'broken' as resource, 'ERROR' as status from q union all select query, 'definitions', case when headword is null then 'NOT_FOUND' else 'FOUND' end from q left join h on query = headword""")
def engine_errors(spark, d):
    """A resource that fails gives an error row a query, and the others go on."""

    def broken(keys: DataFrame) -> DataFrame:
        return lookup_definitions(keys.withColumn("key", F.raise_error(F.lit("out of order")).cast("string")), read(spark, d, "definitions"), "broken")

    q = _terms(spark, d).withColumnRenamed("term", "query")
    e = Engine(read(spark, d, "definitions"), resources={"broken": broken}).search(q)
    return e.select("query_id", "resource", "status").distinct()


def _wordnet(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four tables, made of those that are here: entries with their romanised label, first clauses as hypernyms, stems as roots."""
    f = read(spark, d, "frequency_index").groupBy("word_unicode").agg(F.min("word_raw").alias("raw_label"))
    x = read(spark, d, "definitions").groupBy("def_id").agg(F.min("headword").alias("headword"), F.min("pos").alias("pos"), F.min("meaning").alias("meaning"))
    x = x.join(f, F.col("headword") == F.col("word_unicode"), "left")
    twn = x.select(F.col("def_id").alias("nodeindex"), F.col("headword").alias("unicode_label"), "raw_label", "pos")
    senses = x.where("meaning <> ''").select(F.col("def_id").alias("id"), F.col("headword").alias("unicode_label"), F.lit(None).cast("string").alias("raw_label"), "pos", F.split("meaning", ";")[0].alias("hypernym"))
    morph = _analyses(spark, d).select(F.col("surface").alias("inflated_unicode"), F.lit(None).cast("string").alias("inflated_raw"), F.col("lemma").alias("root_unicode"))
    return twn, senses, morph, read(spark, d, "frequency_index")


def _word_keys(spark, d) -> DataFrame:
    """Words of the held-out queries and the romanised words of the frequency list."""
    raw = read(spark, d, "frequency_index").select(F.col("word_raw").alias("key")).where("key is not null")
    q = _terms(spark, d).select(F.col("term").alias("key")).union(raw).distinct()
    return q.select(F.col("key").alias("query_id"), F.col("key").alias("query"), F.lit(1).alias("pass"), "key")


@query(f"""
with f as (select word_unicode, min(word_raw) raw from frequency_index group by 1), x as (select def_id, min(headword) headword, min(pos) pos, min(meaning) meaning from definitions group by 1),
tw as (select x.*, raw from x left join f on headword = word_unicode), se as (select def_id id, headword, pos spos, string_split(meaning, ';')[1] hyper from x where meaning <> ''),
k as (select distinct k from (select unnest(regexp_extract_all(lower(query), '{_TOKENS}')) k from eval_items union all select word_raw from frequency_index where word_raw is not null)),
lx as (select distinct k, def_id, headword, pos from k join (select unnest(list_distinct([headword, raw])) key, * from tw) on k = key where key is not null),
l1 as (select k, def_id, lx.headword, hyper from lx left join se on se.headword = k and (coalesce(lx.pos, '') = '' or spos = lx.pos) qualify row_number() over (partition by k, def_id order by id nulls last) = 1),
mo as (select distinct k, r from k join (select token, {_stem('token')} r from (select distinct token from verse_tokens where token <> '')) on k = token and r <> token),
al as (select k, headword lemma, hyper meaning, 'wordnet:twn:' || def_id source_id, 'lexical' kind from l1 union all select k, r, null, 'wordnet:morph:' || r, 'morphology' from mo)
select k as query_id, lemma, meaning, source_id, kind as evidence_type from al union all select k, k, null, 'wordnet:freq:' || k, 'frequency' from k join (select distinct word_unicode from frequency_index) on k = word_unicode where k not in (select k from al)
""")
def wordnet_lookup(spark, d):
    return lookup_wordnet(_word_keys(spark, d), *_wordnet(spark, d)).select("query_id", "lemma", "meaning", "source_id", "evidence_type")


@query(f"""with q as (select term k from {_TERMS}), d as (select distinct word_unicode, word_raw from frequency_index where word_raw <> '')
select k as query_id, word_raw as meaning, 'dictionary:' || k as source_id from q join d on k = word_unicode""")
def dictionary_lookup(spark, d):
    """A second dictionary under the same contract: here the romanised forms of the words."""
    f = read(spark, d, "frequency_index").select(F.col("word_unicode").alias("headword"), F.col("word_raw").alias("meaning"), F.col("word_unicode").alias("def_id"))
    keys = _terms(spark, d).select("query_id", F.col("term").alias("query"), F.lit(1).alias("pass"), F.col("term").alias("key"))
    return lookup_definitions(keys, f, "dictionary").select("query_id", "meaning", "source_id")


@query(_EV + """, s as (select query, surface, source_id, resource, coalesce(work, '') work, n, row_key, (case when contains(ded.passage, query) then 10 else 0 end) + (case when length(trim(ded.passage)) > 10 then 5 else 0 end) + (case when coalesce(work, '') <> '' then 3 else 0 end) + (case when coalesce(period, '') <> '' then 2 else 0 end) score
  from ded join (select chunk_id, any_value(work) work, any_value(period) period from chunks group by 1) c on ded.source_id = c.chunk_id where resource = 'corpus' and status = 'FOUND'),
w as (select *, row_number() over (partition by query, work order by score desc, source_id) g from s)
select * from (select query as query_id, source_id, work, score::bigint as score, row_number() over (partition by query order by (g > 1)::int, score desc, source_id) as rank from w) where rank <= 5""")
def context_selector(spark, d):
    _, e = _engine(spark, d)
    c = e.where("resource = 'corpus' and status = 'FOUND'").withColumn("work", F.coalesce("work", F.lit("")))
    no = F.lit(None).cast("string")
    s = rank.quality(no, F.col("passage"), F.col("query"), F.lit(False), F.col("work"), F.col("period"), no, no)
    return rank.diverse(c.withColumn("score", s.cast("bigint")), "query_id", "work", "score", "source_id").select("query_id", "source_id", "work", "score", "rank")


@query("select category, count(distinct item_id) as n_cases, round(100 * avg((n >= 1)::int::double), 2) as any_pct, round(100 * avg((n >= 2)::int::double), 2) as two_pct, round(100 * avg((n >= 3)::int::double), 2) as three_pct from (select item_id, category, (exists (select 1 from definitions where headword = w))::int + (exists (select 1 from verse_tokens where token = w))::int + (exists (select 1 from frequency_index where word_unicode = w))::int n from (select distinct item_id, category, string_split(query, ' ')[1] w from eval_items)) group by 1")
def coverage_by_category(spark, d):
    cases = read(spark, d, "eval_items").select(F.col("item_id").alias("case_id"), "category", F.split("query", " ")[0].alias("w")).distinct()
    keys = [("definitions", "headword"), ("verse_tokens", "token"), ("frequency_index", "word_unicode")]
    hits = None
    for t, c in keys:
        x = cases.join(read(spark, d, t).select(F.col(c).alias("w")).distinct(), "w", "left_semi").select("case_id", F.lit(t).alias("resource"))
        hits = x if hits is None else hits.unionByName(x)
    return evaluate.coverage(hits, cases)


@query(_EV + "select query as query_id, count(*) as total, count_if(kind = 'morphology')::bigint as morphology, count_if(kind = 'lexical')::bigint as lexical, count_if(kind = 'literary_context')::bigint as literary, count(distinct resource) as resources from ded where status = 'FOUND' group by 1")
def evidence_counts(spark, d):
    _, e = _engine(spark, d)
    return answer.counts(e)


@query(_EV + ", l as (select query, unnest([lemma]) l from ded where status = 'FOUND') select query as query_id, array_to_string(list_sort(list(distinct l)), ',') as lemmas from l where trim(l) <> '' group by 1 having count(distinct l) > 1")
def lemma_conflicts(spark, d):
    _, e = _engine(spark, d)
    return answer.conflicts(e)


@query()
def answer_json(spark, d):
    """One JSON answer for every word of the held-out queries."""
    q, e = _engine(spark, d)
    q = q.withColumn("query", F.col("query"))
    return answer.answers(q, cut(ranked(e), "ranked"), summary(e, q))


# ---- dedupe, upserts, histories -------------------------------------------


@query("select doc_id, text_key from (select doc_id, sha256(text) text_key from documents where text is not null qualify row_number() over (partition by text order by doc_id) = 1)")
def dedupe_first_wins(spark, d):
    x = read(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("text_key"))
    return rank.first_wins(x, ["text_key"], ["doc_id"])


@query("select chunk_id, work, loaded_at from chunks qualify row_number() over (partition by chunk_id order by loaded_at desc, work desc) = 1")
def upsert_last_wins(spark, d):
    return rank.last_wins(read(spark, d, "chunks").select("chunk_id", "work", "loaded_at"), ["chunk_id"], ["loaded_at", "work"])


@query("select user_id, event_type, ts from (select *, row_number() over (partition by user_id order by ts desc, event_type) r from (select user_id, event_type, max(ts) ts from events group by 1, 2)) where r <= 50")
def recent_top50(spark, d):
    last = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("ts"))
    return rank.diverse(last.withColumn("one", F.col("ts")), "user_id", "event_type", "ts", "event_type", 50).select("user_id", "event_type", "ts")


@query("select user_id, event_type, count(*) % 2 = 1 as saved from events group by 1, 2")
def saved_toggle(spark, d):
    return read(spark, d, "events").groupBy("user_id", "event_type").agg((F.count("*") % 2 == 1).alias("saved"))


@query("select event_type, count(value) as n, round(min(value), 6) as min, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.9), 6) as p90, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99, round(max(value), 6) as max from events group by 1")
def latency_percentiles(spark, d):
    return evaluate.percentiles(read(spark, d, "events"), "value", ["event_type"])


# ---- vectors --------------------------------------------------------------

_TOP = f"""
with v as materialized (select vec_id, label, list_transform(embedding, lambda x: x::double / sqrt(list_dot_product(embedding::double[], embedding::double[]))) e from embeddings),
s as (select q.vec_id query_id, v.vec_id id, q.label = v.label same, round(list_dot_product(q.e, v.e), 6) score from v q, v where q.vec_id % 50 = 0 and q.vec_id <> v.vec_id),
top as (select * from (select *, row_number() over (partition by query_id order by score desc, id) rank from s) where rank <= {TOPK}),
gold as (select q.vec_id query_id, v.vec_id id from embeddings q join embeddings v on q.label = v.label and q.vec_id <> v.vec_id where q.vec_id % 50 = 0),
ng as (select query_id, count(*) n_gold from gold group by 1), rel as (select top.query_id, rank, score, same::int rel, n_gold from top join ng using (query_id))
"""


def _top(spark, d) -> DataFrame:
    e = read(spark, d, "embeddings")
    return vectors.topk(spread(e), "vec_id", "embedding", e.where("vec_id % 50 = 0"), "vec_id", TOPK)


def _rel(spark, d) -> DataFrame:
    e = read(spark, d, "embeddings").select("vec_id", "label")
    gold = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label").join(e.select(F.col("vec_id").alias("id"), "label"), "label").where("query_id <> id").select("query_id", "id")
    return evaluate.relevance(_top(spark, d), gold)


@query(_TOP + "select query_id, id, score, rank from top")
def semantic_topk(spark, d):
    return _top(spark, d).select("query_id", "id", "score", "rank")


@query(_TOP + f"select query_id, id, score from top where score >= {TAU}")
def semantic_threshold(spark, d):
    return _top(spark, d).where(F.col("score") >= TAU).select("query_id", "id", "score")


@query(_TOP + """select query_id, id, score, 'exact' as retrieval from gold left join (select query_id, id, score from top) using (query_id, id) union all select query_id, id, score, 'semantic' from top where not same""")
def semantic_merge(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "label")
    gold = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label").join(e.select(F.col("vec_id").alias("id"), "label"), "label").where("query_id <> id").select("query_id", "id")
    return vectors.merge(gold, _top(spark, d)).select("query_id", "id", "score", "retrieval")


@query(_TOP + f"""select k, round(avg(hits / n_gold), 6) as recall, round(avg(hits / k), 6) as precision, round(avg(coalesce(1 / f, 0)), 6) as mrr from (select k, query_id, n_gold, sum(case when rank <= k then rel else 0 end)::double hits, min(case when rel = 1 and rank <= k then rank end)::double f from rel, (select unnest({KS}) k) group by all) group by 1""")
def eval_k_sweep(spark, d):
    return evaluate.k_sweep(_rel(spark, d), KS)


@query(_TOP + f"""select tau, round(avg(hits / n_gold), 6) as recall, round(avg(case when kept > 0 then hits / kept else 0 end), 6) as precision, round(sum(hits) / sum(n_gold), 6) as gold_retention, round(avg((hits > 0)::int::double), 6) as query_retention, round(avg((kept = 0)::int::double), 6) as rejected
from (select tau, query_id, n_gold, sum(case when score >= tau then rel else 0 end)::double hits, count_if(score >= tau)::double kept from rel, (select unnest({TAUS})::double tau) group by all) group by 1""")
def eval_threshold_sweep(spark, d):
    return evaluate.threshold_sweep(_rel(spark, d), TAUS)


@query(_TOP + "select rel, count(score) as n, round(min(score), 6) as min, round(quantile_cont(score, 0.5), 6) as median, round(avg(score), 6) as mean, round(max(score), 6) as max from rel group by 1")
def score_distribution(spark, d):
    return evaluate.distribution(_rel(spark, d), "score", ["rel"])


def _norm(v: str) -> str:
    return f"sqrt(list_dot_product({v}::double[], {v}::double[]))"


_BAD = "len(list_filter(vector, lambda x: x is null or isnan(x) or isinf(x))) > 0"


@query(f"""with a as (select vector_index, vector is null z, len(vector) <> 384 l, {_BAD} b, case when vector is not null and not ({_BAD}) then {_norm('vector')} end n from madurai_vectors)
select count(*) as n_rows, count_if(z)::bigint as n_null, count_if(not z and l)::bigint as n_wrong_length, count_if(not z and not l and b)::bigint as n_not_finite, count_if(not z and not l and not b and n = 0)::bigint as n_zero, count_if(not z and not l and not b and n > 0 and abs(n - 1) > 0.001)::bigint as n_not_unit,
  count(*) - count(distinct vector_index) as n_repeated, round(min(case when not l and not b then n end), 6) as min_norm, round(max(case when not l and not b then n end), 6) as max_norm from a""")
def vector_validation(spark, d):
    return vectors.validate(spread(read(spark, d, "madurai_vectors")), "vector_index", "vector", 384)


# ---- sense choice ---------------------------------------------------------


def _wsd(spark, d) -> tuple[DataFrame, DataFrame]:
    """Headwords that occur in a held-out passage, with the passage as context and their meanings as senses."""
    d_ = read(spark, d, "definitions").where("meaning is not null and trim(meaning) <> ''").select("headword", "def_id", "meaning").distinct()
    e = spread(read(spark, d, "eval_items").select("item_id", "passage")).distinct().withColumn("query", F.explode(F.array_distinct(T.script_tokens("passage"))))
    x = e.join(d_, F.col("query") == F.col("headword"))
    x = cut(x, "words")
    q = x.select(F.col("item_id").alias("query_id"), "query", F.col("passage").alias("context")).distinct()
    senses = x.select(F.col("item_id").alias("query_id"), "query", F.explode(F.transform(F.split("meaning", ";"), lambda s, i: F.struct((F.col("def_id") * 100 + i).alias("cand"), s.alias("definition")))).alias("s"))
    return q, senses.select("query_id", "query", "s.cand", "s.definition").where("trim(definition) <> ''").distinct()


_WSD = f"""
with de as (select distinct headword, def_id, meaning from definitions where meaning is not null and trim(meaning) <> ''),
e as (select distinct item_id, passage, unnest(list_distinct(regexp_extract_all(passage, '[\\x{{0B80}}-\\x{{0BFA}}]+'))) query from eval_items),
q as (select distinct item_id query_id, query, passage context from e join de on query = headword),
t as (select query_id, query, unnest(generate_series(0, len(ts) - 1)) pos, unnest(ts) tok from (select query_id, query, regexp_extract_all(context, '[\\x{{0B80}}-\\x{{0BFA}}]+') ts from q)),
st as materialized (select w, {_stem('w')} s from (select distinct tok w from t union select query from q)),
u as (select t.*, a.s stem, (tok = query or a.s = b.s) same from t join st a on a.w = tok join st b on b.w = query),
h as (select *, case when max(same::int) over (partition by query_id, query) = 1 then same else contains(tok, query) end hit from u),
c as (select query_id, query, pos, tok, stem from h where not hit and tok not in (select unnest({_list(L.STOPWORDS)})) and length(tok) > 1),
ctx as (select c.query_id, c.query, c.pos, c.tok, c.stem, min(coalesce(abs(c.pos - h.pos), 999)) over (partition by c.query_id, c.query, c.tok) dist from c left join h on h.query_id = c.query_id and h.query = c.query and h.hit)
"""


@query(_WSD + "select distinct query_id, query, tok, dist::bigint as dist from ctx")
def context_distance(spark, d):
    q, _ = _wsd(spark, d)
    return wsd.context_tokens(q).select("query_id", "query", "tok", F.col("dist").cast("bigint").alias("dist")).distinct()


_HOLDS = lambda words: f"len(list_filter({_list(words)}, lambda w: contains(definition, w))) > 0"
_BOOST = lambda ok, d: f"case when {ok} and {d} is not null then case when {d} = 1 then 35.0 when {d} <= 3 then 20.0 / {d} else 5.0 / {d} end else 0.0 end"
_LEAST = lambda words: f"min(case when tok in (select unnest({_list(words)})) or stem in (select unnest({_list(words)})) then dist end)"
_CLAUSE = "string_split(regexp_split_to_array(meaning, '\\.')[1], ';')[1]"
_SCORES = _WSD + f""",
se as (select query_id, query, def_id * 100 + i - 1 cand, {_strip('parts[i]')} definition from (select q.query_id, q.query, def_id, string_split(meaning, ';') parts from q join de on q.query = de.headword), unnest(generate_series(1, len(parts))) u(i)),
sn as materialized (select distinct * from se where definition <> ''),
tk as materialized (select distinct query_id, query, cand, unnest(regexp_extract_all(definition, '[\\x{{0B80}}-\\x{{0BFA}}]+')) term from sn),
tc as (select * from tk where term <> query and term not in (select unnest({_list(L.STOPWORDS)})) and length(term) > 1),
te as materialized (select query_id, query, cand, 'token' kind, term from tc union all select distinct query_id, query, cand, 'stem', {_stem('term')} from tc),
cn as (select query_id, query, count(distinct cand) n from sn group by all), cf as (select query_id, query, kind, term, count(distinct cand) df from te group by all),
ti as materialized (select te.*, ln((n + 1.0) / df) + 1.0 idf from te join cf using (query_id, query, kind, term) join cn using (query_id, query)),
s0 as materialized (select distinct headword word, syn from (select headword, unnest(regexp_extract_all({_CLAUSE}, '[\\x{{0B80}}-\\x{{0BFA}}]+')) syn from definitions where meaning is not null) where syn not in (select unnest({_list(L.STOPWORDS)})) and syn <> headword and length(syn) > 1),
sy as materialized (select * from s0 union select word, {_stem('syn')} from s0),
cs as (select distinct c.query_id, c.query, c.pos, c.tok, c.dist, syn from ctx c join sy on sy.word = c.tok or sy.word = c.stem),
mt as (select c.query_id, c.query, pos, tok, dist, cand, idf, 1 prio, t.term from ctx c join ti t on t.query_id = c.query_id and t.query = c.query and kind = 'token' and t.term = c.tok
  union all select c.query_id, c.query, pos, tok, dist, cand, idf, 2, t.term from ctx c join ti t on t.query_id = c.query_id and t.query = c.query and kind = 'stem' and t.term = c.stem
  union all select c.query_id, c.query, pos, tok, dist, cand, idf, case kind when 'token' then 3 else 4 end, t.term from cs c join ti t on t.query_id = c.query_id and t.query = c.query and t.term = c.syn),
bm as (select * from mt qualify row_number() over (partition by query_id, query, cand, pos order by prio, idf desc, term) = 1),
ov as (select query_id, query, cand, sum([4.0, 2.5, 2.0, 1.5][prio] * idf * case when dist = 1 then 2.5 when dist <= 3 then 1.5 else 1.0 end * case when prio <= 2 and tok in (select unnest({_list(L.GENUS)})) then 0.4 else 1.0 end) overlap from bm group by all),
sg as (select query_id, query, count(*) tokens, {_LEAST(L.QUANTITY)} qd, {_LEAST(L.SOMATIC)} sd, {_LEAST(L.FURNITURE)} fd from ctx group by all),
b1 as (select sn.*, coalesce(overlap, 0) overlap, {_BOOST(_HOLDS((*L.FRACTION_SENSE, '1/4', '1/2', '3/4', '1/8', chr(92) + 'frac')), 'qd')} bq, {_BOOST(_HOLDS(L.ANATOMY_SENSE), 'sd')} ba, {_BOOST(_HOLDS(L.FURNITURE_SENSE), 'fd')} bf
  from sn left join ov using (query_id, query, cand) left join sg using (query_id, query)),
sc as materialized (select *, round(case when bq + ba + bf + overlap > 0 then bq + ba + bf + overlap + 0.05 / (1 + ln(greatest(length(definition), 1))) else bq + ba + bf + overlap end, 6) score,
  case when bq > 0 and bq >= ba and bq >= bf then 'fraction' when ba > 0 and ba >= bf then 'anatomy' when bf > 0 then 'furniture' else '' end dom from b1)
"""


@query(_SCORES + "select query_id, query, cand, score, dom as domain from sc")
def idf_overlap_score(spark, d):
    """The score of every sense."""
    q, c = _wsd(spark, d)
    return wsd.scores(q, c, wsd.synonyms(read(spark, d, "definitions"))).select("query_id", "query", "cand", "score", "domain")


@query(_SCORES + """, f1 as (select query_id, query, min(cand) cand from sn group by query_id, query, definition),
s1 as (select sc.* from sc join f1 using (query_id, query, cand)), rk as (select *, row_number() over w r, lead(score) over w s2, lead(dom) over w d2, count(*) over (partition by query_id, query) n from s1 window w as (partition by query_id, query order by score desc, cand)),
p as (select q.query_id, q.query, context, cand, score, s2, n, coalesce(tokens, 0) tokens, score - coalesce(s2, 0) gap, dom, d2 from q left join (select * from rk where r = 1) k using (query_id, query) left join sg using (query_id, query)),
dc as (select *, case when cand is null then 'insufficient_evidence' when trim(coalesce(context, '')) = '' then 'no_context' when tokens = 0 then 'insufficient_evidence' when n = 1 then 'single_sense' when score < 1.0 then 'insufficient_evidence'
  when s2 is not null and gap < 0.2 and score < 3.0 then 'ambiguous' when s2 is not null and s2 >= 10 and score >= 10 and gap < 3 and dom <> d2 then 'conflicting_signals' else 'selected' end status from p)
select query_id, query, status, case when status = 'single_sense' then 'medium' when status = 'selected' then case when score >= 20 then 'high' when score >= 5 then 'medium' else 'low' end when cand is null or status = 'no_context' then 'none' else 'low' end as confidence,
  case when status in ('selected', 'single_sense') then cand end as cand, case when status = 'single_sense' then 1.0 else coalesce(score, 0.0) end as score from dc""")
def wsd_decision(spark, d):
    """The sense chosen for every word in context, or why there is none."""
    q, c = _wsd(spark, d)
    return wsd.decide(q, c, wsd.synonyms(read(spark, d, "definitions"))).select("query_id", "query", "status", "confidence", "cand", "score")


@query()
def wsd_gloss(spark, d):
    """The sense of every word in context as it is shown."""
    q, c = _wsd(spark, d)
    return wsd.decide(q, c, wsd.synonyms(read(spark, d, "definitions"))).where("sense is not null").select("query_id", "query", "sense")


def queries() -> dict:
    from lexloom.plans import answers, pages  # noqa: F401  add the queries of answers and of the build pipeline

    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    from lexloom.plans import answers, pages  # noqa: F401

    return dict(_S)
