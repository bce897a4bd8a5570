"""Queries over the corpora: search, autocomplete, references, merges, index."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.functions import lexical as L
from linkloom.operators import corpora as C
from linkloom.sources import tables as T

QUERIES: dict = {}
SQL: dict[str, str] = {}

FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"list_filter(string_split_regex({}, '[ \t\n\r]+'), lambda t: t <> '')"
NOTES = f"""notes as (select cast(doc_id as varchar) as id, 'doc' || doc_id as stem, source || '/doc' || doc_id || '.md' as path,
array_to_string({WORDS.format('text')}[1:6], ' ') as title, [lang, source] as tags, trim(text, ' ') as trimmed, case when doc_id % 7 = 0 then 'skill' else 'note' end as doc_type,
len({WORDS.format('text')}) as word_count, text as search_text, case when doc_id % 11 <> 0 then 1600000000 + doc_id * 3600 end as created_ts, 1650000000 + doc_id * 60 as modified_ts, doc_id as doc_no from documents)"""
LINES = r"(select doc_id, lang, source, unnest(range(0, len(string_split(text, chr(10))))) as ord, unnest(string_split(text, chr(10))) as line from documents)"
SECTIONS = rf"""sections as (select cast(doc_id as varchar) as doc_id, ord, w[1:4] as head, array_to_string(w[1:4], ' ') as heading_title, 1 + ord % 6 as heading_level, line as section_text, len(w) as words,
case when ord % 6 = 0 then array_to_string(w[1:4], ' ') else 'Part ' || (ord // 6) || ' / ' || array_to_string(w[1:4], ' ') end as heading_path
from (select *, list_filter(string_split_regex(line, '[ \t\r]+'), lambda t: t <> '') as w from {LINES}))"""
CHUNKS = f"""chunks as (select source as repo_id, 'src/doc' || doc_id || '.txt' as path, lang as language, ord + 1 as line_number, trim(line, ' ') as line_text, {FOLD.format("trim(line, ' ')")} as line_text_folded from {LINES} where trim(line, ' ') <> '')"""
SYMBOLS = f"""symbols as (select 'sym:' || p_partkey as id, p_name as name, {FOLD.format('p_name')} as name_folded, case when p_partkey % 2 = 0 then 'rust' else 'python' end as language,
case when p_size > 25 then 'function' else 'struct' end as kind, p_type as signature, p_brand as owner_title, 'lib/' || p_brand || '/' || p_partkey || '.rs' as path, p_size as line_start from part)"""
TIER = f"""case when name_folded = 'steel' then 1.0 when starts_with(name_folded, 'steel') then 0.97 when contains(name_folded, 'steel') then 0.93 when contains({FOLD.format('signature')}, 'steel') then 0.86 when contains({FOLD.format('owner_title')}, 'steel') then 0.81 else 0.0 end::double"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def tier_sql(q: str) -> str:
    return TIER.replace("'steel'", f"'{q}'")


@query(f"""with {NOTES}, {SECTIONS}, rows_ as (
select path || ':_doc' as id, path, stem, title, null as best_section, concat_ws(' ', title, stem, doc_type, array_to_string(tags, ' '), search_text) as search_text from notes
union all select n.path || ':' || s.ord, n.path, n.stem, n.title, s.heading_title, s.section_text from sections s join notes n on n.id = s.doc_id),
h as (select *, case when title = 'the' then 1.0 when contains({FOLD.format('title')}, 'the') then 0.95 when contains({FOLD.format("coalesce(best_section, '')")}, 'the') then 0.9 when contains({FOLD.format('stem')}, 'the') then 0.88 when contains({FOLD.format('search_text')}, 'the') then 0.82 else 0.0 end::double as score from rows_),
b as (select *, row_number() over (partition by path order by score desc, id) as nth from h where score > 0)
select id, path, stem, title, best_section, score from b where nth = 1 order by score desc, path, stem limit 50""")
def search_knowledge_sections(spark, sf):
    n = T.notes(spark, sf)
    return C.search_knowledge(C.knowledge_rows(n, T.sections(n)), "the", 50)


SYMBOL_QUERY = "red"


@query(f"with {SYMBOLS}, h as (select id, name, path, line_start, {tier_sql(SYMBOL_QUERY)} as score from symbols where language in ('rust')) select * from h where score > 0 order by score desc, name, path, line_start, id limit 30")
def search_local_symbols(spark, sf):
    return C.search_symbols(T.symbols(spark, sf), SYMBOL_QUERY, 30, languages=["rust"])


@query(f"""with {SYMBOLS}, h as (select *, case when starts_with(name_folded, 'wi') then true else false end as p from symbols),
b as (select name as suggestion, kind, row_number() over (partition by name_folded order by kind, name, id) as nth from h where p or len(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda w: starts_with(w, 'wi'))) > 0)
select suggestion, kind from b where nth = 1 order by kind, suggestion limit 20""")
def autocomplete_symbols(spark, sf):
    return C.autocomplete(T.symbols(spark, sf), "wi", 20)


@query(f"""with {CHUNKS}, r as (select path, line_number as line, line_text, unnest(regexp_extract_all(line_text, '[A-Za-z_][A-Za-z0-9_]*')) as name, unnest(range(0, len(regexp_extract_all(line_text, '[A-Za-z_][A-Za-z0-9_]*')))) as nth from chunks),
f as (select path, line, lower(name) as name_folded, arg_min(name, nth) as name, any_value(line_text) as line_text from r group by 1, 2, 3)
select name_folded, path, line, strpos(line_text, name) as "column", case when contains(line_text, 'that') then 0.9 when contains({FOLD.format('line_text')}, 'that') then 0.82 else 0.7 end::double as score from f where name_folded = 'that' order by score desc, path, line, "column" limit 40""")
def search_reference_occurrences(spark, sf):
    return C.search_references(C.reference_occurrences(T.content_chunks(spark, sf)), "that", 40)


@query(f"""with {CHUNKS}, h as (select path, line_number, line_text, case when contains(line_text, 'The') then 0.73 when contains(line_text_folded, 'the') then 0.72 else 0.0 end::double as score from chunks where language in ('en', 'de')),
b as (select *, row_number() over (partition by path order by score desc, line_number) as nth from h where score > 0)
select path, line_number, score, case when length(line_number || ': ' || line_text) > 140 then left(line_number || ': ' || line_text, 140) || '...' else line_number || ': ' || line_text end as snippet from b where nth = 1 order by score desc, path, line_number limit 60""")
def search_repo_content(spark, sf):
    return C.search_content(T.content_chunks(spark, sf), "The", 60, languages=["en", "de"])


@query(r"""with a as (select distinct page_id, url as source_path, target as attachment_path, string_split(target, '/')[-1] as attachment_name from (select page_id, url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) as target from pages)),
h as (select attachment_path, source_path, 0.5 * (lower(attachment_name) = 'the')::int + 0.3 * contains(lower(attachment_path), 'the')::int + 0.2 * contains(concat_ws(' ', lower(attachment_path), lower(attachment_name), lower(source_path)), 'the')::int as score from a)
select attachment_path, source_path, round(score, 6)::double as score from h where score > 0 order by score desc, attachment_path, source_path limit 40""")
def search_attachments(spark, sf):
    return C.search_attachments(T.attachments(spark, sf), "the", 40).withColumn("score", F.round("score", 6))


BUCKET = "case when lower(name) = '{0}' then 0 when lower(owner_title) = '{0}' then 1 when starts_with(lower(name), '{0}') then 2 when starts_with(lower(owner_title), '{0}') then 3 when contains(lower(name), '{0}') then 4 when contains(lower(owner_title), '{0}') then 5 when contains(lower(path), '{0}') then 6 when contains(lower(signature), '{0}') then 7 end"


@query(f"""with {SYMBOLS}, e as (select id, 'symbol' as entity_kind, name, path, language, signature, owner_title, line_start / 100.0 as s from symbols
union all select 'mod:' || owner_title, 'module', owner_title, min(path), min(language), '', owner_title, 0 from symbols group by owner_title),
h as (select *, {BUCKET.format('brand#1')} as bucket from e)
select id, entity_kind, name, path, round(greatest((8 - bucket) / 8.0, s), 6)::double as score from h where bucket is not null
order by score desc, case entity_kind when 'symbol' then 3 when 'module' then 2 else 1 end desc, path, name, id limit 40""")
def search_repo_entities(spark, sf):
    s = T.symbols(spark, sf)
    rows = C.entity_rows(s, s.select("id", (F.col("line_start") / 100).alias("saliency_score")))
    return C.search_entities(rows, "brand#1", 40).withColumn("score", F.round("score", 6))


@query(f"with {SYMBOLS}, h as (select 'lib' as repo, *, {BUCKET.format('brand#12')} as bucket from symbols) select id, path, (8 - bucket) / 8.0::double as score from h where bucket is not null and contains(path, 'Brand#12') and (8 - bucket) / 8.0 >= 0.5 order by score desc, id limit 25")
def column_mask(spark, sf):
    s = T.symbols(spark, sf).withColumn("score", L.bucket_score(L.symbol_bucket("brand#12"), 7)).withColumn("repo", F.lit("lib"))
    rows = C.column_mask(s, repo="lib", path="Brand#12", least=0.5, order=[F.desc("score"), F.asc("id")], limit=25)
    return rows.select("id", "path", "score")


@query(f"with {SYMBOLS} select id, name, signature from symbols where id in (select id from symbols where line_start = 7)")
def payload_fetch(spark, sf):
    s = T.symbols(spark, sf)
    return C.payload_fetch(s, ["id", "name", "signature"], s.filter("line_start = 7"))


@query(f"with {SYMBOLS}, h as (select id, name, path, line_start, {tier_sql('bolt')} as score from symbols), t as (select * from h where score > 0 order by score desc, name, path, line_start, id limit 10) select t.*, s.signature, s.kind from t join symbols s using (id)")
def late_materialization(spark, sf):
    s = T.symbols(spark, sf)
    return C.hydrate(C.search_symbols(s, "bolt", 10), s, ["signature", "kind"])


@query(f"""with {NOTES}, {SECTIONS}, {SYMBOLS}, {CHUNKS},
k as (select id, path, max(case when contains(lower(title), 'the') then 0.95 else 0.0 end) as score from notes group by 1, 2),
s as (select id, path, {tier_sql('gear')} as score from symbols), c as (select path || ':' || line_number as id, path, 0.73 as score from chunks where contains(line_text, 'Then')),
m as (select 'knowledge' as source, id, path, score::double as score, 1 as p from k where score > 0 union all select 'symbol', id, path, least(score + 0.02, greatest(score, 1.0))::double, 0 from s where score > 0 union all select 'content', id, path, least(score + 0.04, greatest(score, 0.9))::double, 2 from c)
select source, id, path, round(score, 6) as score from m order by m.score desc, p, path, id limit 60""")
def intent_merge(spark, sf):
    n = T.notes(spark, sf)
    k = n.select("id", "path", F.when(L.has(F.lower("title"), "the"), 0.95).otherwise(0.0).alias("score")).filter("score > 0")
    s = T.symbols(spark, sf).select("id", "path", L.symbol_tier("gear").alias("score")).filter("score > 0")
    c = T.content_chunks(spark, sf).filter(F.contains("line_text", F.lit("Then"))).select("id", "path", F.lit(0.73).alias("score"))
    return C.intent_merge(k, s, c, 60, True).withColumn("score", F.round("score", 6))


@query(f"""with {CHUNKS}, h as (select repo_id, path, line_number from chunks where contains(line_text, 'The')), w as (select *, row_number() over (partition by repo_id order by path, line_number) as n from h)
select repo_id, path, line_number from w where n <= 3 order by path, line_number limit 40""")
def multi_repo_search(spark, sf):
    hit = T.content_chunks(spark, sf).filter(F.contains("line_text", F.lit("The"))).select("repo_id", "path", "line_number")
    return C.per_repo(hit, "repo_id", [F.asc("path"), F.asc("line_number")], 3, 40)


@query(f"""with {SYMBOLS}, d as (select id, name, path, line_start, case when name = 'hot gear' then 0 when name_folded = 'hot gear' then 1 when contains(name_folded, 'hot gear') then 2 end as tier from symbols)
select id, name, path, line_start, tier, case tier when 0 then 1.0 when 1 then 0.98 when 2 then 0.8 end::double as score from d where tier = (select min(tier) from d) order by score desc, path, line_start, id limit 1""")
def resolve_definition(spark, sf):
    name = "hot gear"
    d = C.resolve_definition(T.symbols(spark, sf), name)
    return d.select("id", "name", "path", "line_start", "tier", "score")


@query(f"""with {SYMBOLS}, h as (select id, name, levenshtein(name_folded, 'red bolt') as distance, greatest(length(name), 8) as n from symbols)
select id, name, distance, round(1 - distance / n::double, 6) as score from h where distance <= 2 order by 1 - distance / n::double desc, distance, length(name), name, id limit 50""")
def fuzzy_symbols(spark, sf):
    return C.fuzzy_search(T.symbols(spark, sf), "red bolt", 50).withColumn("score", F.round("score", 6))


@query(f"""with {SYMBOLS}, t as (select id, name, signature, 0 as tier from symbols where name_folded = 'blue bolt' union all select id, name, signature, 1 from symbols where levenshtein(name_folded, 'blue bolt') <= 1 union all select id, name, signature, 2 from symbols where starts_with(name_folded, 'blue bolt')),
b as (select *, row_number() over (partition by id order by tier) as nth from t)
select id, name, tier from b where nth = 1 order by tier, name, id limit 30""")
def unified_symbol_waterfall(spark, sf):
    s = T.symbols(spark, sf).select("id", "name", "name_folded")
    tiers = [s.filter("name_folded = 'blue bolt'"), s.filter(F.levenshtein("name_folded", F.lit("blue bolt")) <= 1), s.filter(F.startswith("name_folded", F.lit("blue bolt")))]
    return C.waterfall(tiers, "id", 30, [F.asc("name"), F.asc("id")]).select("id", "name", "tier")


@query(f"""with {SYMBOLS}, t as (select id, 0 as tier from symbols where name = 'none such' union all select id, 1 from symbols where contains(signature, 'ECON') union all select id, 2 from symbols) select id, tier from t where tier = (select min(tier) from t)""")
def first_tier_wins(spark, sf):
    s = T.symbols(spark, sf).select("id", "name", "signature")
    return C.first_tier([s.filter("name = 'none such'"), s.filter("contains(signature, 'ECON')"), s], "id").select("id", "tier")


IDENT = r"list_filter(string_split_regex(lower(regexp_replace(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda t: t <> '')"


@query(f"""with p as (select 'sym:' || p_partkey as id, {IDENT.format('p_type')} as w from part), i as (select id, len(w) as n, unnest(w) as token from p), q as (select id, n, token, count(*) as tf from i where token in ('economy', 'small') group by 1, 2, 3),
df as (select token, count(distinct id) as df from q group by 1), m as (select avg(len(w)) as mean, count(*) as total from p)
select id, round(sum(2.0 * ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6)::double as score from q join df using (token), m group by id""")
def indexed_exact_bm25(spark, sf):
    s = T.symbols(spark, sf)
    index = C.inverted_index(s, {"signature": 2.0})
    size = s.select(F.lit("signature").alias("field"), "id", F.size(L.identifier_words(F.col("signature"))).alias("n"))
    return C.bm25(index, "economy small", s.count(), size).withColumn("score", F.round("score", 6))


@query(f"with p as (select 'sym:' || p_partkey as id, {IDENT.format('p_name')} as w from part) select id from p where len(list_filter(range(1, len(w)), lambda i: w[i] = 'small' and starts_with(w[i + 1], 'g'))) > 0")
def indexed_prefix(spark, sf):
    return C.phrase_prefix(T.symbols(spark, sf), "name", "small g")


@query(f"with {SYMBOLS} select id, {IDENT.format('signature')} as words from symbols")
def identifier_split(spark, sf):
    return T.symbols(spark, sf).select("id", L.identifier_words(F.col("signature")).alias("words"))


@query("select split_part(p_name, ' ', 1) as head, count(*) as n from part where lower(p_name) like '%red%' group by 1")
def dependency_symbols(spark, sf):
    return T.table(spark, sf, "part").filter(L.has(F.lower("p_name"), "red")).groupBy(F.split("p_name", " ")[0].alias("head")).agg(F.count("*").alias("n"))


@query(f"with {SYMBOLS} select id, path from symbols where regexp_matches(path, '^lib/Brand#1[^/]*/[^/]*\\.rs$')")
def scope_glob(spark, sf):
    return T.symbols(spark, sf).filter(F.rlike("path", F.lit(C.glob_pattern("lib/Brand#1*/*.rs")))).select("id", "path")


@query(f"with {CHUNKS} select repo_id, path, line_number, length(line_text) as n from chunks")
def content_chunk_rows(spark, sf):
    return T.content_chunks(spark, sf).select("repo_id", "path", "line_number", F.length("line_text").alias("n"))
