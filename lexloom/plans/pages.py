"""Queries of the build pipeline: blocks, headings, units, and the index kept by a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import lexicons as L
from lexloom.operators import index
from lexloom.plans.catalogue import _TOKENS, _list, _strip, query
from lexloom.session import read, scratch, spread
from lexloom.sources import pages
from lexloom.streaming.refresh import maintain

_BLOCKS = f"list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n\\s*\\n+'), lambda x: {_strip('x')}), lambda x: x <> '')"


@query(f"select doc_id, count(*) as n_blocks, sum(length(b))::bigint as n_chars from (select doc_id, unnest({_BLOCKS}) b from (select distinct doc_id, text from documents where text is not null)) group by 1")
def unit_segmenter(spark, d):
    b = pages.blocks(spread(read(spark, d, "documents").select("doc_id", "text")).distinct(), "doc_id", "text")
    return b.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n_blocks"), F.sum(F.length("block")).alias("n_chars"))


@query("""
with l as (select doc_id, unnest(generate_series(1, len(p))) n, unnest(p) line from (select distinct doc_id, string_split(text, chr(10)) p from documents where text is not null)),
h as (select *, regexp_matches(line, '^#{1,6}\\s') hd, last_value(case when regexp_matches(line, '^#{1,6}\\s') then trim(line) end ignore nulls) over (partition by doc_id order by n) heading from l)
select doc_id, n, heading, sha256(line) as line_key from h where not hd
""")
def heading_carry_forward(spark, d):
    x = spread(read(spark, d, "documents").where("text is not null").select("doc_id", "text")).distinct()
    x = x.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    y = pages.carry(x, "doc_id", "p", "line", F.col("line").rlike(r"^#{1,6}\s"))
    return y.select("doc_id", (F.col("p") + 1).cast("bigint").alias("n"), "heading", F.sha2("line", 256).alias("line_key"))


_IS_HEADING = "length({0}) <= 60 and not regexp_matches({0}, '" + L.NO_HEADING + "') and (" + " or ".join(f"regexp_matches({{0}}, '{p}')" for p in L.HEADING_PATTERNS).replace("{3,15}", "{{3,15}}").replace("{0B80}", "{{0B80}}").replace("{0BFF}", "{{0BFF}}") + ")"
_NOTICE = f"""(len(list_filter({_list(L.BOILERPLATE_LOWER)}, lambda w: contains(lower(b), w))) > 0 or len(list_filter({_list(L.BOILERPLATE)}, lambda w: contains(b, w))) > 0 or b in (select unnest({_list(L.BOILERPLATE_WHOLE)}))
  or regexp_matches(b, '{L.BOILERPLATE_PLACE}') or (length(b) < 120 and len(list_filter({_list(L.BOILERPLATE_SHORT)}, lambda w: contains(b, w))) > 0))"""
_NORM = "length(array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(nfc_normalize({0}), '[\\x{{200B}}-\\x{{200D}}\\x{{FEFF}}]', '', 'g'), '[\\r\\n]+'), lambda y: trim(regexp_replace(y, '[ \\t]+', ' ', 'g'))), lambda y: y <> ''), ' '))"
_TITLES, _LANDS = _list(L.COLLECTION_TITLES), _list(L.LAND_DIVISIONS)
_STANZAS = f"""
with d as (select distinct doc_id id, text from documents where text is not null),
b0 as (select id, unnest(generate_series(0, len(p) - 1)) pos, unnest(p) block from (select id, {_BLOCKS} p from d)),
b1 as (select id, pos, list_filter(list_transform(string_split(block, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') l from (select *, {_strip("regexp_replace(block, '[\\x{200B}-\\x{200D}\\x{FEFF}]', '', 'g')")} b from b0)
  where length(regexp_replace(block, '[^\\x{{0B80}}-\\x{{0BFF}}]', '', 'g')) >= 6 and not {_NOTICE}),
b2 as (select *, l[1] f, len(l) = 1 and length(l[1]) < 60 and {_IS_HEADING.format('l[1]')} alone from b1), b3 as (select *, not alone and ends_with(f, '{L.DIVISION_END}') over_ from b2),
b4 as (select *, last_value(case when (alone and not regexp_matches(f, '^\\d+\\.\\s*(?:{"|".join(L.COLLECTION_TITLES)})$')) or over_ then f end ignore nulls) over (partition by id order by pos) canto from b3),
b5 as (select id, pos, canto, case when over_ then l[2:] else l end l from b4 where not alone), b6 as (select *, len(l) > 1 and starts_with(l[-1], '-') and length(l[-1]) < 50 poet from b5 where len(l) > 0),
b7 as (select id, pos, canto, case when poet then l[:-2] else l end l from b6),
b8 as (select *, len(list_filter(l, lambda x: regexp_matches(x, '^\\d+\\.\\s*[\\x{{0B80}}-\\x{{0BFF}}]'))) n, regexp_extract(l[1], '^(\\d+)\\.', 1) lead, {_strip("regexp_replace(l[1], '^\\d+\\.\\s*', '')")} label from b7),
b9 as (select *, n >= 2 or (len(l) = 1 and n = 1) many, lead <> '' and (label = '' or label in (select unnest({_list(L.OPENING_LABELS)})) or label in (select unnest({_LANDS})) or (not regexp_matches(label, '[,;?!]')
  and ((len(list_filter({_list(L.SCENE_LABELS)}, lambda w: contains(label, w))) > 0 and length(label) <= 30) or (len(l) >= 4 and length(label) <= 20 and not contains(label, ' '))))) pure from b8),
ba as (select *, case when not many and pure and label in (select unnest({_LANDS})) then coalesce(canto, label) else canto end c2 from b9 where many or not (lead <> '' and label in (select unnest({_list((*L.COLLECTION_TITLES, *L.COUPLET_SECTIONS))})))),
r as (select id, pos, i k, c2 canto, many, regexp_extract(l[i], '^(\\d+)\\.\\s*(.*)', 1) verse, {_strip("regexp_extract(l[i], '^(\\d+)\\.\\s*(.*)', 2)")} t from ba, unnest(generate_series(1, len(l))) u(i) where many
  union all select id, pos, 0, c2, many, nullif(lead, ''), array_to_string(case when lead = '' then l when pure then l[2:] else list_concat([label], l[2:]) end, chr(10)) from ba where not many),
r1 as (select *, regexp_extract(t, '\\s(\\d{{1,4}})\\s*$', 1) tail, {_strip("regexp_replace(t, '\\s*\\d{1,4}\\s*$', '')")} bare from r where not many or (verse <> '' and t not in (select unnest({_TITLES})))),
r2 as (select *, not many and tail <> '' opn from r1), r3 as (select *, case when opn and verse is null then bare else t end kept from r2),
r4 as (select *, row_number() over (partition by id order by pos, k) stanza_number from r3 where {_NORM.format('kept')} >= 4), r5 as (select *, opn and (verse is null or verse = stanza_number::varchar) o2 from r4)
select id as doc_id, stanza_number::int as stanza_number, case when o2 then tail else coalesce(verse, stanza_number::varchar) end as verse_number, canto, case when o2 then bare else t end as original_text from r5
"""


@query(_STANZAS)
def stanza_units(spark, d):
    """The units the stanza segmenter makes of the documents."""
    t = spread(read(spark, d, "documents").select("doc_id", "text")).distinct()
    return pages.stanzas(t, "doc_id", "text").select(F.col("id").alias("doc_id"), "stanza_number", "verse_number", "canto", "original_text")


_NEWEST = "(select * from chunks qualify row_number() over (partition by chunk_id order by loaded_at desc, normalized_text desc) = 1)"


@query(f"select token, count(*) as n_tokens, count(distinct chunk_id) as n_units from (select chunk_id, unnest(regexp_extract_all(lower(normalized_text), '{_TOKENS}')) token from {_NEWEST}) group by 1")
def index_refresh_stream(spark, d):
    """The units arrive in three micro-batches, the newest first, so rows that come later must not replace newer ones."""
    units = spread(read(spark, d, "chunks").select("chunk_id", "normalized_text", "loaded_at"))
    a, b = units.agg(F.percentile_approx("loaded_at", F.array(F.lit(0.33), F.lit(0.66)))).first()[0]
    source, files = scratch(spark, "arriving"), spark.sparkContext.defaultParallelism
    for part in (F.col("loaded_at") > b, (F.col("loaded_at") > a) & (F.col("loaded_at") <= b), F.col("loaded_at") <= a):
        units.where(part).repartition(files).write.mode("append").parquet(source)
    return index.token_stats(maintain(spark, source, scratch(spark, "index"), "chunk_id", "normalized_text", "loaded_at", files))
