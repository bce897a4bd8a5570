"""Queries over bundle searches, projected trees, merged analyses and decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from linkloom.operators import incremental as I
from linkloom.operators import projection as P
from linkloom.plans.catalog_corpora import NOTES, SECTIONS
from linkloom.plans.catalog_repo import REPO, bundle
from linkloom.sources import tables as T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query(f"""with {REPO}, b as (select module_id, qualified_name, case when lower(qualified_name) = 'lib.brand#1' then 0 when starts_with(lower(qualified_name), 'lib.brand#1') then 1 when contains(lower(qualified_name), 'lib.brand#1') then 2 when contains(lower(path), 'lib.brand#1') then 3 end as bucket, path from modules)
select module_id, bucket, round((4 - bucket) / 4.0::double, 6) as score from b where bucket is not null order by bucket, qualified_name, path limit 20""")
def module_search(spark, sf):
    modules = bundle(spark, sf)[0]
    return P.bundle_search(modules, P.module_bucket("lib.Brand#1"), "module", ["qualified_name", "path"], 20).select("module_id", "bucket", F.round("score", 6).alias("score"))


EXAMPLE_SQL = """ex as (select 's' || s_suppkey as example_id, case when s_suppkey % 9 = 0 then 'red bolt ' || s_suppkey else s_name end as title, 'examples/' || s_name as path, 'nation ' || s_nationkey as summary from supplier),
li as (select distinct 's' || l_suppkey as example_id, l_partkey from lineitem),
rs as (select example_id, list(distinct p_name) as rs, list(distinct 'lib.' || p_brand) as rm from li join part on l_partkey = p_partkey group by 1)"""


def examples(spark, sf):
    s = T.table(spark, sf, "supplier")
    name = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    title = F.when(F.col("s_suppkey") % 9 == 0, F.concat(F.lit("red bolt "), F.col("s_suppkey").cast("string"))).otherwise(F.col("s_name"))
    ex = s.select(name.alias("example_id"), title.alias("title"), F.concat(F.lit("examples/"), "s_name").alias("path"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("summary"))
    modules, symbols = bundle(spark, sf)[:2]
    li = T.table(spark, sf, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_id"), F.concat(F.lit("s:"), F.col("l_partkey").cast("string")).alias("target_id")).distinct()
    of_module = li.join(symbols, li["target_id"] == symbols["symbol_id"]).select("source_id", F.col("module_id").alias("target_id")).distinct()
    return P.with_related(ex, li.union(of_module).withColumn("kind", F.lit("example_of")), symbols, modules)


@query(f"""with {EXAMPLE_SQL}, a as (select ex.*, coalesce(rs, []::varchar[]) as rs, coalesce(rm, []::varchar[]) as rm from ex left join rs using (example_id)),
b as (select example_id, title, path, case when lower(title) = 'red bolt' then 0 when starts_with(lower(title), 'red bolt') then 1 when contains(lower(title), 'red bolt') then 2 when list_contains(list_transform(rs, lambda x: lower(x)), 'red bolt') then 3 when list_contains(list_transform(rm, lambda x: lower(x)), 'red bolt') then 4
when len(list_filter(rs, lambda x: starts_with(lower(x), 'red bolt'))) > 0 then 5 when len(list_filter(rm, lambda x: starts_with(lower(x), 'red bolt'))) > 0 then 6 when contains(lower(path), 'red bolt') then 7 when contains(lower(summary), 'red bolt') then 8 when len(list_filter(rs, lambda x: contains(lower(x), 'red bolt'))) > 0 then 9 when len(list_filter(rm, lambda x: contains(lower(x), 'red bolt'))) > 0 then 10 end as bucket from a)
select example_id, bucket, round((11 - bucket) / 11.0::double, 6) as score from b where bucket is not null order by bucket, title, path limit 100""")
def example_search(spark, sf):
    hit = P.bundle_search(examples(spark, sf), P.example_bucket("red bolt"), "example", ["title", "path"], 100)
    return hit.select("example_id", "bucket", F.round("score", 6).alias("score"))


@query("""with i as (select p_partkey as import_id, lower(p_brand) as target, lower(p_type) as source from part), b as (select import_id, case when target = 'brand#1' then case when source = 's' then 0 when starts_with(source, 's') then 1 end when starts_with(target, 'brand#1') then case when starts_with(source, 's') then 2 end when contains(target, 'brand#1') then 3 end as bucket from i)
select import_id, bucket, round((5 - bucket) / 5.0::double, 6) as score from b where bucket is not null order by bucket, import_id limit 100""")
def import_search(spark, sf):
    p = T.table(spark, sf, "part").select(F.col("p_partkey").alias("import_id"), F.col("p_brand").alias("target_package"), F.col("p_type").alias("source_module"))
    return P.bundle_search(p, P.import_bucket("brand#1", "s"), "import", ["import_id"], 100).select("import_id", "bucket", F.round("score", 6).alias("score"))


NODE_HITS = "nh as (select doc_id as page_id, doc_id || '#' || ord as node_id, heading_title as node_title, case when lower(heading_title) = 'the' then 100 when starts_with(lower(heading_title), 'the') then 90 when contains(lower(heading_title), 'the') then 75 when contains(lower(heading_path), 'the') then 60 when contains(lower(section_text), 'the') then 45 else 0 end as score from sections)"


def page_nodes(notes):
    return T.sections(notes).select(F.col("doc_id").alias("page_id"), F.concat("doc_id", F.lit("#"), F.col("ord").cast("string")).alias("node_id"), F.col("heading_title").alias("node_title"), F.split("heading_path", " / ").alias("structural_path"), F.col("section_text").alias("text"))


@query(f"with {NOTES}, {SECTIONS}, {NODE_HITS} select page_id, node_id, nh.score, node_title, title as page_title from nh join notes on id = page_id where nh.score > 0 order by score desc, title, node_title, node_id limit 60")
def tree_node_search(spark, sf):
    n = T.notes(spark, sf)
    return P.tree_search(page_nodes(n), n.withColumnRenamed("id", "page_id"), "the", 60)


@query(f"""with {NOTES}, {SECTIONS}, {NODE_HITS}, ps as (select id, title, case when lower(title) = 'the' then 100 when starts_with(lower(title), 'the') then 85 when contains(lower(title), 'the') then 70 when len(list_filter(tags, lambda k: contains(lower(k), 'the'))) > 0 then 60 when contains(lower(path), 'the') then 40 else 0 end as score from notes),
h as (select id as page_id, title as page_title, '' as node_id, title as hit_title, score, 'page' as kind from ps union all select page_id, title, node_id, node_title, nh.score, 'page_index_node' from nh join notes on id = page_id)
select * from h where score > 0 order by score desc, page_title, hit_title, kind, page_id, node_id limit 80""")
def mixed_retrieval(spark, sf):
    n = T.notes(spark, sf)
    return P.mixed_search(n.select(F.col("id").alias("page_id"), "title", "path", F.col("tags").alias("keywords")), page_nodes(n), "the", 80)


@query("""with o as (select s_suppkey, case when s_suppkey % 2 = 0 then 'over ' || s_name else '' end as name, case when s_suppkey % 4 = 0 then null else 'u' || s_suppkey end as url from supplier where s_suppkey % 3 = 0), b as (select s_suppkey, s_name as name, 'base' as url from supplier where s_suppkey % 5 <> 0)
select coalesce(b.s_suppkey, o.s_suppkey) as repo_id, coalesce(nullif(o.name, ''), b.name) as name, coalesce(nullif(o.url, ''), b.url) as url from b full join o on b.s_suppkey = o.s_suppkey""")
def analysis_merge(spark, sf):
    s = T.table(spark, sf, "supplier").withColumnRenamed("s_suppkey", "repo_id")
    base = s.filter("repo_id % 5 <> 0").select("repo_id", F.col("s_name").alias("name"), F.lit("base").alias("url"))
    name = F.when(F.col("repo_id") % 2 == 0, F.concat(F.lit("over "), "s_name")).otherwise("")
    over = s.filter("repo_id % 3 = 0").select("repo_id", name.alias("name"), F.when(F.col("repo_id") % 4 != 0, F.concat(F.lit("u"), F.col("repo_id").cast("string"))).alias("url"))
    return P.merge_records(base, over, "repo_id", ["name", "url"])


@query("""with s as (select p_partkey as suggestion_id, case when p_partkey % 5 = 0 then 'promoted' else 'provisional' end as state from part where p_partkey % 7 <> 0), d as (select l_orderkey * 10 + l_linenumber as decision_id, l_partkey as suggestion_id, case l_linenumber % 2 when 0 then 'promoted' else 'rejected' end as target_state, epoch(l_shipdate)::bigint as decided_at from lineitem),
w as (select *, row_number() over (partition by suggestion_id order by decided_at, decision_id) as n from d) select decision_id, w.suggestion_id, s.state as previous_state, target_state, case when s.state is null then 'missing' when s.state = 'provisional' and n = 1 then 'applied' else 'finalized' end as outcome from w left join s on s.suggestion_id = w.suggestion_id""")
def suggestion_decisions(spark, sf):
    p = T.table(spark, sf, "part").filter("p_partkey % 7 <> 0")
    latest = p.select(F.col("p_partkey").alias("suggestion_id"), F.when(F.col("p_partkey") % 5 == 0, "promoted").otherwise("provisional").alias("state"))
    li = T.table(spark, sf, "lineitem")
    d = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("decision_id"), F.col("l_partkey").alias("suggestion_id"), F.when(F.col("l_linenumber") % 2 == 0, "promoted").otherwise("rejected").alias("target_state"), T.epoch(F.col("l_shipdate")).alias("decided_at"))
    return P.decide(latest, d)


@query("""with b as (select source as repo_id, doc_id as path, n_chars as h from documents where doc_id % 10 <> 3), a as (select source as repo_id, doc_id as path, case when doc_id % 50 = 5 and source = (select max(source) from documents) then -1 else n_chars end as h from documents where doc_id % 10 <> 3 or source = (select min(source) from documents)),
d as (select coalesce(a.repo_id, b.repo_id) as repo_id, count(*) filter (a.h is distinct from b.h) as changed from a full join b on a.repo_id = b.repo_id and a.path = b.path group by 1),
r as (select source as repo_id, row_number() over (order by source) as n from (select distinct source from documents))
select r.repo_id, case when n = 2 then 'replace_all' when changed > 0 then 'clone_and_mutate' when n % 2 = 0 then 'noop' else 'refresh_publication' end as action, coalesce(changed, 0) as changed from r left join d on d.repo_id = r.repo_id""")
def staged_mutations(spark, sf):
    d = T.table(spark, sf, "documents").select(F.col("source").alias("repo_id"), F.col("doc_id").alias("path"), F.col("n_chars").alias("hash"))
    first, last = d.agg(F.min("repo_id"), F.max("repo_id")).first()
    before = d.filter("path % 10 <> 3")
    after = d.filter((F.col("path") % 10 != 3) | (F.col("repo_id") == first)).withColumn("hash", F.when((F.col("path") % 50 == 5) & (F.col("repo_id") == last), -1).otherwise(F.col("hash")))
    repos = d.filter("repo_id is not null").select("repo_id").distinct()
    current = repos.withColumn("revision", F.lit("v2"))
    nth = repos.withColumn("n", F.row_number().over(Window.orderBy("repo_id")))  # one row a source
    published = nth.filter("n <> 2").select("repo_id", F.when(F.col("n") % 2 == 0, "v2").otherwise("v1").alias("revision"))
    return I.plan_mutations(current, published, before, after).select("repo_id", "action", "changed")
