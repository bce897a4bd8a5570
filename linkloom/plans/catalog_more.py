"""Queries over similarities, rankings, addresses and semantic documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.functions import lexical as L
from linkloom.functions import similarity as M
from linkloom.operators import graph as G
from linkloom.operators import ranking as R
from linkloom.plans.catalog_corpora import NOTES, SECTIONS, SYMBOLS
from linkloom.plans.catalog_graph import EDGES, NOTE_EDGES
from linkloom.sources import files as S
from linkloom.sources import tables as T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""with p as (select p_partkey as id, p_name as t from part), c as (select id, i, ascii(substr(t, i + 1, 1)) / 255.0::double as v from (select id, t, unnest(range(0, length(t))) as i from p)),
s as (select id, i % 128 as k, sum(v) as v from c group by 1, 2), n as (select id, sqrt(sum(v * v)) as n from s group by 1) select s.id, k::int as dim, round(v / n, 6) as value from s join n using (id)""")
def text_byte_vector(spark, sf):
    p = T.table(spark, sf, "part")
    v = p.select(F.col("p_partkey").alias("id"), F.posexplode(M.byte_vector(F.col("p_name"))).alias("dim", "value"))
    return v.filter("value <> 0").withColumn("value", F.round("value", 6))


@query(None)
def transposition_distance(spark, sf):
    p = T.table(spark, sf, "part").select("p_partkey", "p_name")
    return p.select("p_partkey", M.swap_distance(F.col("p_name"), F.concat(F.substring("p_name", 2, 1), F.substring("p_name", 1, 1), F.substring("p_name", 3, 99))).alias("distance"))


@query("""with w as (select p_partkey as id, string_split(lower(p_name), ' ') as w from part), r as (select id, unnest(flatten(list_transform(range(1, len(w) + 1), lambda i: list_transform(range(i, len(w) + 1), lambda j: array_to_string(w[i:j], ' '))))) as fragment from w) select distinct id, fragment from r""")
def candidate_fragments(spark, sf):
    p = T.table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), F.explode(M.fragments(L.identifier_words(F.col("p_name")))).alias("fragment"))


@query(f"with {SYMBOLS} select id, name, levenshtein(name_folded, 'red bot') as d, round(1 - levenshtein(name_folded, 'red bot') / greatest(length(name), 7)::double, 6) as score from symbols where levenshtein(name_folded, 'red bot') <= 2 and starts_with(name_folded, 'r')")
def fuzzy_score(spark, sf):
    s = T.symbols(spark, sf)
    hit = s.select("id", "name", F.levenshtein("name_folded", F.lit("red bot")).alias("d"), F.round(L.fuzzy_score(F.col("name_folded"), F.lit("red bot"), 2, 1), 6).alias("score"))
    return hit.filter("score is not null")


@query(f"with {NOTES}, e as (select id, string_split(search_text, chr(10)) as ev from notes), a as (select id, list_count(list_filter(['the', 'that', 'zzz'], lambda x: len(list_filter(ev, lambda l: contains(lower(l), x))) > 0)) / 3.0::double as share from e) select id, round(share, 6) as share, share >= 0.70 and 0.01 < 0.05 as passed from a")
def ccs_audit(spark, sf):
    n = T.notes(spark, sf)
    share = M.covered_share(F.array(*[F.lit(x) for x in ("the", "that", "zzz")]), F.split("search_text", "\n"))
    return n.select("id", F.round(share, 6).alias("share"), M.passes_audit(share, F.lit(0.01)).alias("passed"))


@query("""with s as (select p_partkey as id, (p_size / 50.0)::double as score, case when p_partkey % 3 = 0 then true when p_partkey % 3 = 1 then false end as valid from part)
select id, round(case when valid is null then score when valid then least(1.0, score + 0.1) else greatest(0.0, score - 0.5) end, 6) as score from s""")
def skeleton_rerank(spark, sf):
    p = T.table(spark, sf, "part")
    valid = F.when(F.col("p_partkey") % 3 == 0, True).when(F.col("p_partkey") % 3 == 1, False)
    return p.select(F.col("p_partkey").alias("id"), F.round(M.skeleton_rerank(F.col("p_size") / 50, valid), 6).alias("score"))


@query("""with a as (select p_partkey as id, list_distinct(string_split(lower(p_name), ' ')) as x from part), b as (select id, x, list_distinct(['red', 'bolt']) as y from a)
select id, round(0.35 * j + 0.25 * 1.0 + 0.30 * j + 0.10 * 1.0, 6)::double as similarity from (select id, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::double as j from b)""")
def pattern_suggestion(spark, sf):
    p = T.table(spark, sf, "part")
    j = M.jaccard(F.array_distinct(L.identifier_words(F.col("p_name"))), F.array(F.lit("red"), F.lit("bolt")))
    return p.select(F.col("p_partkey").alias("id"), F.round(M.pattern_similarity(j, F.lit(1.0), j, F.lit(1.0)), 6).alias("similarity"))


@query("""with h as (select p_partkey as id, (p_size / 100.0)::double as score from part where p_size > 30), b as (select p_partkey as id, 0.2::double as boost from part where p_partkey % 9 = 0),
u as (select h.id, least(1.0, score + (1 - score) * coalesce(boost, 0)) as score from h left join b using (id) union all select id, 0.25 + 0.5 * boost from b where id not in (select id from h)) select id, round(score, 6) as score from u order by u.score desc, id limit 200""")
def boosted_results(spark, sf):
    p = T.table(spark, sf, "part").withColumn("id", F.col("p_partkey"))
    hits = p.filter("p_size > 30").select("id", (F.col("p_size") / 100).alias("score"))
    return R.with_boosts(hits, p.filter("id % 9 = 0").select("id", F.lit(0.2).alias("boost")), 200).withColumn("score", F.round("score", 6))


@query(f"""with {NOTE_EDGES}, s as (select * from (values ('3'), ('4')) v(id)), b as (select src, dst from note_links union select dst, src from note_links), n1 as (select distinct dst as id from b where src in (select id from s) and dst not in (select id from s)),
r as (select n1.id, 1 as distance, source || '/doc' || doc_id || '.md' as path, 'doc' || doc_id as stem from n1 join documents on cast(doc_id as varchar) = n1.id order by path, stem limit 4) select id, distance from r union all select id, 0 from s""")
def horizon_trim(spark, sf):
    n = T.notes(spark, sf)
    seeds = spark.createDataFrame([("3",), ("4",)], "id string")
    near = G.distances(T.note_links(n, n.count()), seeds, "both", 1)
    return R.trim_horizon(near, n.select("id", "path", "stem"), 4)


@query("""with p as (select p_partkey as "left", p_partkey + 1 as "right", p_size as priority from part), t as (select *, row_number() over (order by priority desc, "left", "right") as n from p) select "left", "right", ((n - 1) // 7)::int as worker from t where n <= 28""")
def worker_chunks(spark, sf):
    p = T.table(spark, sf, "part").select(F.col("p_partkey").alias("left"), (F.col("p_partkey") + 1).alias("right"), F.col("p_size").alias("priority"))
    return R.worker_chunks(p, 7, 4).select("left", "right", "worker")


@query("""select vec_id as id, round(vec_id % 10 / 10.0::double, 6) as score, round(case when vec_id % 2 = 0 then 0.5 * (vec_id % 10 / 10.0::double) + 0.5 * (label / 10.0::double) else vec_id % 10 / 10.0::double end, 6) as final_score from embeddings""")
def rerank_blend(spark, sf):
    e = T.embeddings(spark, sf)
    hits = e.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 10 / 10).alias("score"))
    b = R.blend(hits, e.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), (F.col("label") / 10).alias("analyzer_score")))
    return b.select("id", F.round("score", 6).alias("score"), F.round("final_score", 6).alias("final_score"))


@query("with r as (select l_suppkey as anchor, l_partkey as id, max(l_discount) as score from lineitem group by 1, 2), w as (select *, row_number() over (partition by anchor order by score desc, id) as n from r) select anchor, round(least(1.0, sum(score)), 6) as topology_score from w where n <= 4 group by 1")
def topology_score(spark, sf):
    r = T.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("anchor"), F.col("l_partkey").alias("id")).agg(F.max("l_discount").alias("score"))
    return R.topology_score(r, 4).withColumn("topology_score", F.round("topology_score", 6))


@query(None)
def dense_clusters(spark, sf):
    n = T.notes(spark, sf)
    e = T.note_links(n, n.count())
    one = n.select("id", F.floor(F.col("doc_no") / 50).alias("component"))
    inner = e.join(one.select(F.col("id").alias("src"), F.col("component").alias("a")), "src").join(one.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst").filter("a = b").select("src", "dst")
    more = one.alias("x").join(one.select(F.col("id").alias("dst"), F.col("component").alias("c2")), F.col("component") == F.col("c2")).filter("id <> dst and abs(cast(id as int) - cast(dst as int)) <= 2").select(F.col("id").alias("src"), "dst")
    return R.dense_clusters(inner.union(more).distinct(), n.select("id", F.lit(0.9).alias("saliency")), one)


@query("with t as (select p_name as title, 'part/' || p_partkey as path, p_size / 50.0::double as score from part order by 3 desc, 2 limit 25) select string_agg('- ' || title || ' (' || path || ') score ' || printf('%.3f', score), chr(10) order by -score, path, title) as text from t")
def subgraph_narrative(spark, sf):
    p = T.table(spark, sf, "part")
    return R.narrative(p.select(F.col("p_name").alias("title"), F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("path"), (F.col("p_size") / 50).alias("score")), 25)


@query("select page_id, lower(regexp_extract(u, '^([A-Za-z]+://[^/?]*)', 1)) || regexp_replace(regexp_extract(u, '^[A-Za-z]+://[^/?]*(.*)$', 1), '/+$', '') as url from (select page_id, regexp_replace(upper(left(url, 8)) || substr(url, 9) || '/#top', '#.*$', '') as u from pages)")
def canonical_urls(spark, sf):
    p = T.table(spark, sf, "pages")
    return p.select("page_id", S.canonical_url(F.concat(F.upper(F.substring("url", 1, 8)), F.substring("url", 9, 1 << 20), F.lit("/#top"))).alias("url"))


@query(f"""with {NOTES}, {SECTIONS} select id as doc_id, 'summary' as kind, coalesce(nullif(left(trim(search_text, ' '), 180), ''), title) as text from notes union all select doc_id, 'section', section_text from sections where section_text <> ''""")
def semantic_documents(spark, sf):
    n = T.notes(spark, sf)
    lead = n.select(F.col("id").alias("doc_id"), F.lit("summary").alias("kind"), F.coalesce(F.nullif("lead", F.lit("")), "title").alias("text"))
    return lead.unionByName(T.sections(n).filter("section_text <> ''").select("doc_id", F.lit("section").alias("kind"), F.col("section_text").alias("text")))


@query(f"with {NOTES}, {SECTIONS} select doc_id || '#passage-' || ord as passage_id, doc_id as parent_id, words from sections")
def passages(spark, sf):
    s = T.sections(T.notes(spark, sf))
    return s.select(F.concat("doc_id", F.lit("#passage-"), F.col("ord").cast("string")).alias("passage_id"), F.col("doc_id").alias("parent_id"), "words")


@query(f"with {EDGES}, s as (select src as id, min(dst) as home from links group by 1) select home, count(*) as files from s group by 1")
def symbol_usage(spark, sf):
    e = T.web_links(spark, sf)
    return e.groupBy("src").agg(F.min("dst").alias("home")).groupBy("home").agg(F.count("*").alias("files"))


@query("with g as (select source, lang, n_chars from documents) select source, lang, count(*) as n, cast(sum(n_chars) as bigint) as chars from g group by rollup (source, lang)")
def corpus_status(spark, sf):
    d = T.table(spark, sf, "documents")
    return d.rollup("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""with r as (select conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) as word from conversations) select word, count(*) as mentions, count(distinct conv_id) as conversations from r group by 1 having count(*) > 3""")
def conversation_terms(spark, sf):
    c = T.table(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("word"))
    return c.groupBy("word").agg(F.count("*").alias("mentions"), F.count_distinct("conv_id").alias("conversations")).filter("mentions > 3")
