"""Queries over the link-graph operators. Graph: parts and suppliers of `lineitem`; notes' ring and hubs."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.operators import graph as G
from linkloom.sources import tables as T

EDGES = """links as (select distinct 'p:' || l_partkey as src, 's:' || l_suppkey as dst from lineitem),
both_ways as (select src, dst from links union select dst, src from links)"""
NOTE_EDGES = """n as (select count(*) as total from documents),
note_links as (select distinct cast(doc_id as varchar) as src, cast(d as varchar) as dst from (
  select doc_id, unnest([(doc_id + 1) % total, (doc_id + 97) % total, doc_id % greatest(1, total // 64)]) as d from documents, n) where doc_id <> d)"""


def _links(spark, sf):
    return T.web_links(spark, sf)


def _note_links(spark, sf):
    docs = T.notes(spark, sf)
    return T.note_links(docs, docs.count())


def _seed(spark, *ids):
    return spark.createDataFrame([(i, 1.0) for i in ids], "id string, weight double")


def _nodes(spark, sf):
    return T.notes(spark, sf).select("id", "doc_no")


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query(f"""with {EDGES}, h1 as (select dst as id, 1 as distance from both_ways where src = 'p:1'),
h2 as (select distinct b.dst as id, 2 as distance from h1 join both_ways b on b.src = h1.id),
a as (select 'p:1' as id, 0 as distance union all select * from h1 union all select * from h2)
select id, min(distance) as distance, case when min(distance) = 0 then 'center' else 'both' end as direction from a group by id""")
def graph_neighbors(spark, sf):
    return G.neighbors(_links(spark, sf), "p:1", "both", 2)


@query(f"""with {EDGES} select dst as id, 1 as distance, 'out' as direction from links where src = 'p:2' union all select 'p:2', 0, 'center'""")
def graph_neighbors_out(spark, sf):
    return G.neighbors(_links(spark, sf), "p:2", "out", 1)


@query(f"""with {EDGES}, near as (select 's:3' as id union select src from links where dst = 's:3')
select src, dst from links where src in (select id from near) and dst in (select id from near)""")
def graph_projection(spark, sf):
    e = _links(spark, sf)
    return G.induced(e, G.neighbors(e, "s:3", "both", 1))


@query(f"""with {EDGES}, o as (select src as id, count(distinct dst) as out_degree from links group by src),
i as (select dst as id, count(distinct src) as in_degree from links group by dst),
b as (select src as id, count(*) as both_degree from both_ways group by src)
select id, coalesce(out_degree, 0) as out_degree, coalesce(in_degree, 0) as in_degree, both_degree from b left join o using (id) left join i using (id)""")
def degree_counts(spark, sf):
    return G.degrees(_links(spark, sf))


@query(f"""with {NOTE_EDGES}, o as (select src as id, count(distinct dst) as o from note_links group by 1), i as (select dst as id, count(distinct src) as i from note_links group by 1),
r as (select cast(doc_id as varchar) as id, ln(1 + 2 * coalesce(i, 0) + coalesce(o, 0)) as raw from documents left join o on o.id = cast(doc_id as varchar) left join i on i.id = cast(doc_id as varchar))
select id, round(raw / (select max(raw) from r), 6) as rank from r""")
def degree_rank(spark, sf):
    return G.degree_rank(_note_links(spark, sf), _nodes(spark, sf)).withColumn("rank", F.round("rank", 6))


@query(f"""with {EDGES}, v as (select 'p:' || p_partkey * 2 as id from part) select id from v where id not in (select src from both_ways)""")
def orphan_nodes(spark, sf):
    nodes = T.table(spark, sf, "part").select(F.concat(F.lit("p:"), (F.col("p_partkey") * 2).cast("string")).alias("id"))
    return G.orphans(nodes, _links(spark, sf))


@query(f"with {NOTE_EDGES} select distinct src as id from note_links e where not exists (select 1 from note_links r where r.src = e.dst and r.dst = e.src)")
def missing_backlinks(spark, sf):
    return G.missing_backlinks(_note_links(spark, sf))


@query(f"""with {EDGES}, v as (select 'p:' || p_partkey as id from part union all select 's:' || s_suppkey from supplier)
select (select count(*) from v) as n_nodes, (select count(*) from links) as n_edges, (select count(*) from v where id not in (select src from both_ways)) as n_orphans""")
def graph_stats(spark, sf):
    nodes = T.table(spark, sf, "part").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("id")).union(T.table(spark, sf, "supplier").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("id")))
    return G.graph_stats(nodes, _links(spark, sf))


@query(f"with {NOTE_EDGES}, a as (select src as id from note_links where dst = '5'), b as (select l.src as id from note_links l join a on l.dst = a.id) select id from (select id from a union select id from b) where id <> '5'")
def link_to_recursive(spark, sf):
    return G.link_filter(_note_links(spark, sf), _seed(spark, "5"), "to", recursive=True, most=2)


@query(f"with {NOTE_EDGES} select dst as id from note_links where src in ('5', '6') and dst not in ('5', '6') group by dst")
def linked_by(spark, sf):
    return G.link_filter(_note_links(spark, sf), _seed(spark, "5", "6"), "from")


@query(f"with {NOTE_EDGES} select cast(doc_id as varchar) as id, doc_id as doc_no from documents where cast(doc_id as varchar) not in (select src from note_links where dst = '5')")
def link_to_negated(spark, sf):
    hit = G.link_filter(_note_links(spark, sf), _seed(spark, "5"), "to")
    return _nodes(spark, sf).join(hit, "id", "left_anti")


def _walk_sql(rounds: int, alpha: float, kept: str = "") -> str:
    """Rounds of a walk; `kept` is `materialized ` where each round has to be worked out once."""
    out = f"r0 as {kept}(select id, w as score from seed)"
    for k in range(rounds):
        out += f""",
m{k} as {kept}(select b.dst as id, sum(r.score / d.degree) as walk from r{k} r join step b on b.src = r.id join deg d on d.id = r.id group by b.dst),
x{k} as {kept}(select coalesce(sum(score), 0) as stuck from r{k} where id not in (select id from deg)),
r{k + 1} as {kept}(select id, {1 - alpha} * coalesce(w, 0) + {alpha} * (coalesce(walk, 0) + stuck * coalesce(w, 0)) as score from m{k} full join seed using (id), x{k})"""
    return out


@query(f"""with {EDGES}, step as materialized (select * from both_ways), deg as materialized (select src as id, count(*) as degree from step group by src),
seed as (select * from (values ('p:1', 0.5::double), ('s:2', 0.5::double)) v(id, w)), {_walk_sql(30, 0.85, "materialized ")}
select id, round(score, 9) as score from r30""")
def personalized_pagerank(spark, sf):
    return G.ppr(_links(spark, sf), _seed(spark, "p:1", "s:2")).withColumn("score", F.round("score", 9))


@query(f"""with {EDGES}, h1 as (select dst as id from both_ways where src = 'p:1'), h as (select 'p:1' as id, 0 as distance union all select id, 1 from h1),
step as (select * from both_ways where src in (select id from h) and dst in (select id from h)), deg as (select src as id, count(*) as degree from step group by src),
seed as (select 'p:1' as id, 1.0::double as w), {_walk_sql(5, 0.85)}
select id, round(score, 9) as score, distance from r5 join h using (id) where distance > 0 order by round(score, 9) desc, distance, id limit 10""")
def related_notes(spark, sf):
    return G.related(_links(spark, sf), _seed(spark, "p:1"), most=1, limit=10, rounds=5)


PART_WALK = """r{k} as (select coalesce(h.part, m.part) as part, coalesce(h.id, m.id) as id, 0.15 * coalesce(restart, 0) + 0.85 * coalesce(walk, 0) as score from home h full join
(select step.part, step.dst as id, sum(score / degree) as walk from r{j} join step on step.part = r{j}.part and step.src = r{j}.id join deg on deg.part = step.part and deg.src = step.src group by 1, 2) m on m.part = h.part and m.id = h.id)"""


@query(f"""with {EDGES}, seed as (select * from (values ('p:1', 1.0::double), ('p:2', 3.0::double), ('s:3', 2.0::double)) v(id, w)), near as (select id as part, id, 0 as distance from seed union select s.id, b.dst, 1 from seed s join both_ways b on b.src = s.id where b.dst <> s.id),
step as (select r.part, b.src, b.dst from both_ways b join near r on r.id = b.src join near q on q.part = r.part and q.id = b.dst), deg as (select part, src, count(*) as degree from step group by 1, 2),
home as (select part, near.id, w / sum(w) over (partition by part) as restart from near join seed on seed.id = near.id), r0 as (select part, id, restart as score from home), {PART_WALK.format(k=1, j=0)}, {PART_WALK.format(k=2, j=1)}, {PART_WALK.format(k=3, j=2)}
select id, round(max(score), 9) as score, min(distance) as distance from r3 join (select id, min(distance) as distance from near group by id having min(distance) > 0) using (id) group by id order by round(max(score), 9) desc, distance, id limit 400""")
def related_partitioned(spark, sf):
    seeds = spark.createDataFrame([("p:1", 1.0), ("p:2", 3.0), ("s:3", 2.0)], "id string, weight double")
    return G.related_partitioned(_links(spark, sf), seeds, most=1, limit=400, rounds=3)


@query(f"""with {EDGES}, w as (select src, dst, 1.0::double / count(*) over (partition by src) as share from links), home as (select 'p:' || p_partkey as id, least(1.0, p_size / 50.0)::double as home from part),
r1 as (select coalesce(h.id, i.id) as id, 0.85 * coalesce(inflow, 0) + 0.15 * coalesce(home, 0) as score from home h full join (select dst as id, sum(home * share) as inflow from home join w on w.src = home.id group by dst) i on i.id = h.id)
select id, round(score, 9) as score from r1""")
def hybrid_pagerank(spark, sf):
    prior = T.table(spark, sf, "part").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("id"), (F.col("p_size") / 50).alias("prior"))
    return G.hybrid_ppr(_links(spark, sf).withColumn("weight", F.lit(1.0)), prior, rounds=1).withColumn("score", F.round("score", 9))


@query(f"""with {NOTE_EDGES}, m as (select cast(doc_id as varchar) as id, doc_id // 10 as cluster, case when doc_id % 3 = 0 then 0.9 end as s from documents),
i as (select a.cluster, count(*) as internal from note_links e join m a on a.id = e.src join m b on b.id = e.dst where a.cluster = b.cluster group by 1)
select cluster, count(*) as n, coalesce(max(internal), 0) as internal, round(case when count(*) > 1 then coalesce(max(internal), 0)::double / (count(*) * (count(*) - 1)) else 0 end, 6) as density, round(coalesce(sum(s), 0)::double / count(*), 6) as mean_saliency from m left join i using (cluster) group by cluster""")
def cluster_density(spark, sf):
    n = _nodes(spark, sf)
    members = n.select("id", F.floor(F.col("doc_no") / 10).alias("cluster"))
    known = n.filter("doc_no % 3 = 0").select("id", F.lit(0.9).alias("saliency"))
    return G.cluster_density(members, _note_links(spark, sf), known).withColumns({"density": F.round("density", 6), "mean_saliency": F.round("mean_saliency", 6)})


@query(f"""with {NOTE_EDGES}, m as (select cast(doc_id as varchar) as id, 'virtual:' || (doc_id // 10) as cluster from documents),
e as (select coalesce(a.cluster, e.src) as src, coalesce(b.cluster, e.dst) as dst from note_links e left join m a on a.id = e.src left join m b on b.id = e.dst)
select src, dst, count(*) as links from e where src <> dst group by 1, 2""")
def cluster_collapse(spark, sf):
    members = _nodes(spark, sf).select("id", F.concat(F.lit("virtual:"), F.floor(F.col("doc_no") / 10).cast("string")).alias("cluster"))
    return G.collapse(_note_links(spark, sf), members)


@query(f"""with {NOTE_EDGES}, s as (select src, dst, max(w) as w from (select src, dst, 1.0::double as w from note_links union all select dst, src, 0.25 from note_links) group by 1, 2),
t as (select src, dst, w / rn as w from (select *, row_number() over (partition by src order by w desc, dst) as rn from s) where rn <= 8),
f as (select dst as id, max(w) as weight from t where src in ('7', '8') group by 1), g as (select dst as id, max(f.weight * t.w * 0.5) as weight from f join t on t.src = f.id group by 1)
select id, round(max(weight), 6) as weight from (select * from f union all select * from g) where id not in ('7', '8') group by id""")
def coactivation(spark, sf):
    return G.coactivation_targets(_note_links(spark, sf), _seed(spark, "7", "8")).withColumn("weight", F.round("weight", 6))


@query(f"""with {NOTE_EDGES}, top as (select cast(doc_id as varchar) as id, (doc_id % 100) / 100.0::double as rank from documents order by 2 desc, 1 limit 40),
own as (select t.id, t.rank, x.tag from top t join documents d on cast(d.doc_id as varchar) = t.id, unnest([d.lang, d.source]) x(tag)),
sz as (select id, count(distinct tag) as n from own group by 1),
b as (select l.id as "left", r.id as "right", l.rank as lr, r.rank as rr, (select count(distinct x.tag) from own x join own y on x.tag = y.tag where x.id = l.id and y.id = r.id) as shared from top l join top r on l.id < r.id)
select "left", "right", round(0.7 * (lr + rr) / 2 + 0.3 * shared / (a.n + c.n - shared), 6) as priority from b join sz a on a.id = "left" join sz c on c.id = "right"
where not exists (select 1 from note_links e where (e.src = "left" and e.dst = "right") or (e.src = "right" and e.dst = "left"))""")
def agentic_pair_priority(spark, sf):
    docs = T.notes(spark, sf)
    ranks = docs.select("id", (F.col("doc_no") % 100 / 100).alias("rank"))
    tags = docs.select("id", F.explode("tags").alias("tag"))
    return G.pair_priority(ranks, tags, _note_links(spark, sf), 40).withColumn("priority", F.round("priority", 6))
