"""Queries over the planned link-graph search, its scores and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.functions import lexical as L
from linkloom.operators import graph as G
from linkloom.plans import search as S
from linkloom.plans.catalog_corpora import NOTES, SECTIONS
from linkloom.plans.catalog_graph import NOTE_EDGES
from linkloom.plans.directives import Options
from linkloom.sources import tables as T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def graph_of(spark, sf, ranks=False):
    n = T.notes(spark, sf)
    e = T.note_links(n, n.count())
    return S.Graph(n, T.sections(n), e, G.degree_rank(e, n.select("id")) if ranks else None)


def has(x, q):
    return f"contains({x}, '{q}')"


def cover(x, words):
    return "(" + " + ".join(f"{has(x, w)}::int" for w in words) + f") / {float(len(words))}::double"


LOW = "low as (select *, lower(id) as i, lower(stem) as s, lower(path) as p, lower(title) as t, [lower(x) for x in tags] as g, lower(search_text) as x from notes), blobs as (select *, concat_ws(' ', i, s, p, t, array_to_string(g, ' '), x) as blob, concat_ws(' ', p, i, s, t) as pb from low)"


def fts_sql(q: str, words: list[str]) -> str:
    tag_has = f"len(list_filter(g, lambda v: {has('v', q)})) > 0"
    occ = f"((length(x) - length(replace(x, '{q}', ''))) // {len(q)})"
    out = f"case when i = '{q}' or s = '{q}' then 1.0 else 0 end, case when t = '{q}' then 0.95 else 0 end, case when list_contains(g, '{q}') then 0.85 else 0 end, case when {has('i', q)} or {has('s', q)} or {has('p', q)} or {has('t', q)} or {tag_has} or {has('x', q)} then 0.7 else 0 end"
    r = cover("blob", words)
    if len(words) >= 2:
        hits = f"(2 * ({has('i', q)} or {has('s', q)} or {has('p', q)})::int + 3 * {has('t', q)}::int + 2 * ({tag_has})::int + least({occ}, 6))"
        out += f", case when {hits} > 0 then least(0.97, 0.70 + least({hits}, 8) * 0.03 + least(greatest({occ} * {len(words)} / greatest(word_count, 1)::double, 0), 0.08)) else 0 end, case when {r} > 0 then 0.33 + 0.42 * {r} else 0 end"
    else:
        out += f", case when {r} > 0 then 0.45 + 0.45 * {r} else 0 end"
    return f"least(1.0, greatest({out}))::double"


def path_sql(q: str, words: list[str]) -> str:
    r = cover("pb", words)
    return f"greatest(case when p = '{q}' or i = '{q}' or s = '{q}' then 1.0 when t = '{q}' then 0.95 else 0 end, case when {has('p', q)} or {has('i', q)} or {has('s', q)} or {has('t', q)} then 0.82 else 0 end, case when {r} > 0 then 0.50 + 0.45 * {r} else 0 end)::double"


def section_sql(q: str, words: list[str]) -> str:
    h, b = "lower(heading_title)", "lower(section_text)"
    base = f"greatest(case when {h} = '{q}' then 1.0 when {has(h, q)} then 0.92 when {has(b, q)} then 0.72 else 0 end, 0.75 * {cover(h, words)} + 0.40 * {cover(b, words)})"
    return f"case when {base} > 0 then least(1.0, {base} + (6 - least(heading_level, 6)) * 0.01) else 0 end::double"


def planned_sql(q: str, where: str = "true", level: int = 6) -> str:
    words = q.split()
    return f"""with {NOTES}, {SECTIONS}, {LOW},
ss as (select *, {section_sql(q, words)} as sc from sections where heading_level <= {level}), sr as (select *, row_number() over (partition by doc_id order by sc desc, heading_path, ord) as place from ss where sc > 0),
best as (select doc_id, sc, heading_title as best_section from sr where place = 1),
scored as (select b.*, {fts_sql(q, words)} as lex, {path_sql(q, words)} as pth, coalesce(best.sc, 0) as sec, best_section from blobs b left join best on best.doc_id = b.id where {where}),
fin as (select *, least(1.0, greatest(lex, 0.62 * lex + 0.23 * sec + 0.15 * pth)) as score from scored)"""


@query(planned_sql("that the", "list_contains(g, 'en') and created_ts >= 1600000000 and modified_ts <= 1650040000") + "select stem, path, title, round(score, 4) as score, best_section, 'fts' as match_reason from fin where score > 0 order by fin.score desc, path, stem limit 25")
def planned_search(spark, sf):
    hit = S.search(graph_of(spark, sf), "tag:en created>=1600000000 modified<=1650040000 limit:25 sort:score that the")
    return hit.withColumn("score", F.round("score", 4))


@query(planned_sql("und", f"true") .replace("with ", f"with {NOTE_EDGES}, ", 1) + """, o as (select src as id, count(distinct dst) as o from note_links group by 1), ic as (select dst as id, count(distinct src) as ic from note_links group by 1),
rk as (select f.id, ln(1 + 2 * coalesce(ic, 0) + coalesce(o, 0)) as raw from fin f left join o on o.id = f.id left join ic on ic.id = f.id),
z as (select fin.*, fin.score + (1 - fin.score) * (raw / (select max(raw) from rk)) * 0.35 as boosted from fin join rk on rk.id = fin.id where score > 0)
select stem, path, title, round(boosted, 6) as score, best_section, 'fts' as match_reason from z order by boosted desc, path, stem limit 15""")
def planned_search_ranked(spark, sf):
    return S.search(graph_of(spark, sf, True), "und", 15).withColumn("score", F.round("score", 6))


@query(f"""with {NOTES}, {LOW} select stem, path, title, case when i = 'doc7' or s = 'doc7' then 1.0 when t = 'doc7' then 0.95 when list_contains(g, 'doc7') then 0.85 when contains(p, 'doc7') then 0.8 when contains(x, 'doc7') then 0.75 end::double as score, 'exact' as match_reason
from low where i = 'doc7' or s = 'doc7' or contains(p, 'doc7') or contains(x, 'doc7') order by score desc, path, stem limit 20""")
def exact_search(spark, sf):
    return S.search(graph_of(spark, sf), "match:exact doc7").drop("best_section")


@query(f"""with {NOTES}, {LOW}, r as (select *, case when regexp_matches(id, '^doc1.$', 'i') or regexp_matches(stem, '^doc1.$', 'i') then 1.0 when regexp_matches(title, '^doc1.$', 'i') then 0.95 when regexp_matches(path, '^doc1.$', 'i') then 0.8 when regexp_matches(search_text, '^doc1.$', 'i') then 0.75 else 0 end as score from low)
select stem, path, title, score::double as score, 're' as match_reason from r where score > 0 order by r.score desc, path, stem limit 20""")
def regex_search(spark, sf):
    return S.search(graph_of(spark, sf), "^doc1.$").drop("best_section")


@query(f"""with {NOTE_EDGES}, {NOTES}, c as (select id, path, stem, title from notes where id in (select dst from note_links where src = '3') and (lower(path) = 'src1' or starts_with(lower(path), 'src') ) and not (starts_with(lower(path), 'src9/')))
select stem, path, title, 1.0::double as score, cast(null as varchar) as best_section, 'no_query' as match_reason from c order by path, stem""")
def filtered_search(spark, sf):
    g = graph_of(spark, sf)
    hit = S.search(g, "from:doc3 -include:src9", base=Options())
    return hit


@query(f"with {NOTES} select stem, path, title, 1.0::double as score, cast(null as varchar) as best_section, 'direct_id' as match_reason from notes where stem = 'doc12'")
def direct_id_lookup(spark, sf):
    return S.search(graph_of(spark, sf), "id:DOC12")


@query(f"""with {NOTES}, {SECTIONS}, ss as (select *, {section_sql('that', ['that'])} as sc from sections where words >= 3 and heading_level <= 4), r as (select *, row_number() over (partition by doc_id order by sc desc, heading_path, ord) as place from ss where sc > 0)
select doc_id, ord, place, round(sc, 6) as section_score from r where place <= 3""")
def section_cap(spark, sf):
    o = Options(scope="mixed", min_section_words=3, max_heading_level=4)
    s = S.ranked_sections(T.sections(T.notes(spark, sf)), "that", o)
    return s.select("doc_id", "ord", "place", F.round("section_score", 6).alias("section_score"))


@query(f"""with {NOTES} select id, path, created_ts, word_count from notes order by created_ts desc nulls first, word_count, path, stem limit 120""")
def multi_term_sort(spark, sf):
    o = Options(sort=(("created", "desc"), ("word_count", "asc")))
    n = T.notes(spark, sf).withColumn("score", F.lit(1.0))
    return n.orderBy(*S.sort_columns(o)).limit(120).select("id", "path", "created_ts", "word_count")


@query(f"with {NOTES}, a as (select id, lower(unnest([id, path, stem])) as alias, path, stem from notes), w as (select *, row_number() over (partition by alias order by path, stem) as nth from a) select alias, id from w where nth = 1")
def alias_resolution(spark, sf):
    from pyspark.sql import Window

    a = T.notes(spark, sf).select("id", F.explode(F.array("id", "path", "stem")).alias("alias"), "path", "stem").withColumn("alias", F.lower("alias"))
    w = Window.partitionBy("alias").orderBy("path", "stem")
    return a.withColumn("nth", F.row_number().over(w)).filter("nth = 1").select("alias", "id")


@query(f"with {NOTES} select id, path from notes where contains(lower(search_text), 'idiot') or contains(lower(search_text), 'moron')")
def mentions_of(spark, sf):
    return T.notes(spark, sf).filter(L.any_of([L.has(F.lower("search_text"), m) for m in ("idiot", "moron")])).select("id", "path")


@query(f"with {NOTES} select id from notes where list_has_any(tags, ['de', 'fr']) and not list_contains(tags, 'src1')")
def tag_filters(spark, sf):
    return T.notes(spark, sf).filter(S.tag_filter(Options(tags_any=("de", "FR"), tags_not=("src1",)))).select("id")


@query(f"with {NOTES}, t as (select stem, path from notes order by path, stem limit 100) select * from t")
def table_of_contents(spark, sf):
    return T.notes(spark, sf).select("stem", "path").orderBy("path", "stem").limit(100)


@query(f"with {NOTES}, {LOW}, h as (select {fts_sql('the', ['the'])} as s from blobs) select count(*) as hits, round(0.45 * least(1.0, count(*) / 2.0) + 0.35 * max(s) + 0.2 * least(1.0, max(s) / 0.25), 6)::double as confidence from h where s > 0")
def graph_confidence(spark, sf):
    h = L.folded(T.notes(spark, sf)).select(L.document_score("the").alias("s")).filter("s > 0").agg(F.count("*").alias("hits"), F.max("s").alias("top"))
    c = 0.45 * F.least(F.lit(1.0), F.col("hits") / 2) + 0.35 * F.col("top") + 0.2 * F.least(F.lit(1.0), F.col("top") / 0.25)
    return h.select("hits", F.round(c, 6).alias("confidence"))
