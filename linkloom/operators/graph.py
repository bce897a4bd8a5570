"""Link-graph operators over edges (src, dst): neighbourhoods, ranks, filters, personalised PageRank.

Frontiers and ranks are frames; each loop step ends in a written table, so plans stay short and a lost
executor costs one step. No adjacency list is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.shared import shared_table

#: Rounds of a walk between two written tables; digits that ranks keep, so that the order of sums shows in none; links of a
#: node in a row, some more or less.
CUT, DIGITS, LISTED = 3, 9, 10_000


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every link, once, without links to itself."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select("src", "dst").union(back).filter("src <> dst").distinct()


def _reached(front: DataFrame, edges: DataFrame, direction: str) -> DataFrame:
    """(id): what a step from `front` (id) reaches. The frontier meets the links as they are stored, each way, so a
    small one is sent to the scans and no link is shuffled."""
    way = lambda a, b: front.join(edges.select(F.col(a).alias("id"), F.col(b).alias("_to")), "id").select(F.col("_to").alias("id"))
    out, back = way("src", "dst"), way("dst", "src")
    return {"out": out, "in": back}.get(direction, out.union(back)).distinct()


def distances(edges: DataFrame, seeds: DataFrame, direction: str = "both", most: int = 2) -> DataFrame:
    """(id, distance): fewest steps from any seed (id), up to `most`; seeds have distance 0."""
    seen = seeds.select("id").distinct().withColumn("distance", F.lit(0))
    front = seen
    for d in range(1, most + 1):
        new = _reached(front.select("id"), edges, direction).join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(d))
        if d < most:
            new = shared_table(new, "frontier")
        seen, front = seen.unionByName(new), new
    return seen


def neighbors(edges: DataFrame, center: str, direction: str = "both", most: int = 1, limit: int | None = None) -> DataFrame:
    """(id, distance, direction) by distance, then id, with the center itself at 0."""
    seed = edges.sparkSession.createDataFrame([(center,)], "id string")
    near = distances(edges, seed, direction, most)
    out = near.withColumn("direction", F.when(F.col("distance") == 0, "center").otherwise(direction))
    out = out.orderBy("distance", "id")
    return out.limit(limit + 1) if limit else out


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Links with both ends among `ids` (id)."""
    return edges.join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi").join(ids.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree, both_degree): distinct neighbours."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("in_degree"))
    both = undirected(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("both_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.join(into, "id", "full").join(both, "id", "left").select("id", zero("out_degree"), zero("in_degree"), zero("both_degree"))


def degree_rank(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, rank): ln(1 + 2 in + out) over the largest such value."""
    d = degrees(edges)
    raw = nodes.select("id").join(d, "id", "left").select("id", F.log1p(2 * F.coalesce("in_degree", F.lit(0)) + F.coalesce("out_degree", F.lit(0))).alias("raw"))
    top = raw.agg(F.max("raw").alias("top"))
    return raw.join(F.broadcast(top)).select("id", F.when(F.col("top") > 0, F.col("raw") / F.col("top")).otherwise(0.0).alias("rank"))  # one row


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    return nodes.join(ends, "id", "left_anti")


def missing_backlinks(edges: DataFrame) -> DataFrame:
    """(id): nodes with an outgoing link that has no reverse."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    return edges.join(back, ["src", "dst"], "left_anti").select(F.col("src").alias("id")).distinct()


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, n_orphans."""
    n = nodes.agg(F.count("*").alias("n_nodes"))
    e = edges.agg(F.count("*").alias("n_edges"))
    o = orphans(nodes, edges).agg(F.count("*").alias("n_orphans"))
    return n.join(F.broadcast(e)).join(F.broadcast(o))  # one row each


def link_filter(edges: DataFrame, seeds: DataFrame, kind: str, recursive: bool = False, most: int = 2) -> DataFrame:
    """(id): `to` gives nodes that link to a seed, `from` nodes that a seed links to; one step or `most`."""
    direction = "in" if kind == "to" else "out"
    return distances(edges, seeds, direction, most if recursive else 1).filter("distance > 0").select("id")


def _sized_links(edges: DataFrame, front: DataFrame) -> DataFrame:
    """(src, dst, degree): the links of `front` (id) in both directions, once each."""
    way = lambda a, b: edges.join(front.select(F.col("id").alias(a)), a, "left_semi").select(F.col(a).alias("src"), F.col(b).alias("dst"))
    step = way("src", "dst").union(way("dst", "src")).filter("src <> dst").distinct()
    return step.join(step.groupBy("src").agg(F.count("*").alias("degree")), "src")


def _listed_links(edges: DataFrame, front: DataFrame) -> DataFrame:
    """(src, degree, to): the same as a written table with a row for each node, or for each `LISTED` of its links."""
    links = _sized_links(edges, front)
    piece = F.pmod(F.xxhash64("dst"), F.ceil(F.col("degree") / LISTED)).alias("_piece")
    return shared_table(links.groupBy("src", "degree", piece).agg(F.collect_list("dst").alias("to")).drop("_piece"), "ppr-links")


def ppr(edges: DataFrame, seeds: DataFrame, alpha: float = 0.85, rounds: int = 30, tolerance: float = 0.0) -> DataFrame:
    """(id, score): random walk with restart over the undirected graph. `alpha` is the probability of
    walking on; mass of nodes without links returns to the seeds (id, weight), which are normalised."""
    total = seeds.agg(F.sum("weight")).first()[0] or 1.0
    start = shared_table(seeds.groupBy("id").agg((F.sum("weight") / F.lit(float(total))).alias("restart")), "ppr-seeds")
    front = known = start.select("id")
    links = _listed_links(edges, front)
    # Only seeds can lack links, and all of their mass goes back to the seeds: one number follows it.
    lone = start.join(links.select(F.col("src").alias("id")), "id", "left_anti").agg(F.sum("restart")).first()[0] or 0.0
    rank, stuck = start.select("id", F.col("restart").alias("score")), lone
    more = links
    for k in range(1, rounds + 1):
        if k > 1 and more is not None:  # what the last step met first has its links read; the rest of the graph has no rank yet
            front = shared_table(more.select(F.explode("to").alias("id")).distinct().join(known, "id", "left_anti"), "ppr-front")
            more = None if front.isEmpty() else _listed_links(edges, front)
            if more is not None:
                known, links = known.union(front), links.union(more)
        shares = rank.join(links, F.col("id") == F.col("src")).select((F.col("score") / F.col("degree")).alias("share"), F.explode("to").alias("id"))
        moved = shares.groupBy("id").agg(F.sum("share").alias("walk"))
        new = moved.join(start, "id", "full").select("id", ((1 - alpha + alpha * stuck) * F.coalesce("restart", F.lit(0.0)) + alpha * F.coalesce("walk", F.lit(0.0))).alias("score"))
        stuck = lone * (1 - alpha + alpha * stuck)
        if k % CUT == 0 or k == rounds:  # each round reads the last one once, so a few make one plan
            new = shared_table(new, "ppr-rank")
            if tolerance and k > CUT:
                change = new.withColumnRenamed("score", "now").join(held, "id", "full").agg(F.sum(F.abs(F.coalesce("now", F.lit(0.0)) - F.coalesce("score", F.lit(0.0))))).first()[0]
                if change is not None and change < tolerance:
                    return new
            held = new
        rank = new
    return rank


def related(edges: DataFrame, seeds: DataFrame, most: int = 2, limit: int | None = 20, alpha: float = 0.85, rounds: int = 10, tolerance: float = 0.0) -> DataFrame:
    """(id, score, distance) without the seeds: PageRank inside the seeds' horizon, best first; all without a limit."""
    near = shared_table(distances(edges, seeds, "both", most), "horizon")
    score = ppr(induced(edges, near), seeds, alpha, rounds, tolerance).withColumn("score", F.round("score", DIGITS))
    found = near.filter("distance > 0").join(score, "id")
    return found if limit is None else found.orderBy(F.desc("score"), "distance", "id").limit(limit)


def horizons(edges: DataFrame, seeds: DataFrame, most: int = 2) -> DataFrame:
    """(part, id, distance): every seed's own horizon, named by the seed."""
    near = shared_table(seeds.select(F.col("id").alias("part"), "id").distinct().withColumn("distance", F.lit(0)), "part-near")
    front = near
    for d in range(1, most + 1):
        way = lambda a, b: front.join(edges.select(F.col(a).alias("id"), F.col(b).alias("_to")), "id").select("part", F.col("_to").alias("id"))  # noqa: B023, E731
        met = way("src", "dst").union(way("dst", "src")).distinct()
        front = shared_table(met.join(near, ["part", "id"], "left_anti").withColumn("distance", F.lit(d)), "part-front")
        near = near.unionByName(front)
    return near


def partitioned_ppr(edges: DataFrame, seeds: DataFrame, most: int, alpha: float, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(part, id, score) by PageRank inside each seed's own horizon, restart weights (id, weight) normalised there; and
    the horizons. All walk in the same plans, keyed by (part, id), so many seeds are no loop and a large
    horizon is spread over tasks."""
    weight = seeds.groupBy("id").agg(F.sum("weight").alias("weight"))
    near = horizons(edges, weight, most)
    ends = near.select("id").distinct()
    step = undirected(induced(edges, ends))
    links = step.join(near.select("part", F.col("id").alias("src")), "src").join(near.select("part", F.col("id").alias("dst")), ["part", "dst"])
    links = links.join(links.groupBy("part", "src").agg(F.count("*").alias("degree")), ["part", "src"])
    links = shared_table(links.select("part", "src", "dst", "degree"), "part-links")
    own = near.join(weight, "id").select("part", "id", "weight")
    start = own.join(own.groupBy("part").agg(F.sum("weight").alias("all")), "part").select("part", "id", (F.col("weight") / F.col("all")).alias("restart"))
    start = shared_table(start, "part-start")
    rank = start.select("part", "id", F.col("restart").alias("score"))
    for k in range(1, rounds + 1):  # a node without links is a seed alone in its horizon, which isn't returned
        walk = rank.withColumnRenamed("id", "src").join(links, ["part", "src"]).groupBy("part", F.col("dst").alias("id")).agg(F.sum(F.col("score") / F.col("degree")).alias("walk"))
        rank = walk.join(start, ["part", "id"], "full").select("part", "id", ((1 - alpha) * F.coalesce("restart", F.lit(0.0)) + alpha * F.coalesce("walk", F.lit(0.0))).alias("score"))
        if k % CUT == 0 or k == rounds:
            rank = shared_table(rank, "part-rank")
    return rank, near


def related_partitioned(edges: DataFrame, seeds: DataFrame, most: int = 2, limit: int = 20, alpha: float = 0.85, rounds: int = 10) -> DataFrame:
    """(id, score, distance) without the seeds: a node's best score over the seeds' own horizons."""
    rank, near = partitioned_ppr(edges, seeds, most, alpha, rounds)
    least = near.groupBy("id").agg(F.min("distance").alias("distance")).filter("distance > 0")
    return max_fusion(rank).withColumn("score", F.round("score", DIGITS)).join(least, "id").orderBy(F.desc("score"), "distance", "id").limit(limit)


def hybrid_ppr(edges: DataFrame, prior: DataFrame, alpha: float = 0.15, rounds: int = 10) -> DataFrame:
    """(id, score): weighted directed walk (src, dst, weight) where `alpha` is the weight of going home:
    (1 - alpha) * inflow + alpha * min(1, prior), prior (id, prior) being seed plus saliency over 10."""
    total = edges.groupBy("src").agg(F.sum("weight").alias("all"))
    links = shared_table(edges.join(total, "src").select("src", "dst", (F.col("weight") / F.col("all")).alias("share")), "hybrid-links")
    home = prior.select("id", F.least(F.lit(1.0), F.col("prior")).alias("home"))
    rank = home.select("id", F.col("home").alias("score"))
    for k in range(1, rounds + 1):
        into = rank.join(links, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("share")).alias("inflow"))
        rank = home.join(into, "id", "full").select("id", ((1 - alpha) * F.coalesce("inflow", F.lit(0.0)) + alpha * F.coalesce("home", F.lit(0.0))).alias("score"))
        if k % CUT == 0 or k == rounds:
            rank = shared_table(rank, "hybrid-rank")
    return rank


def max_fusion(scores: DataFrame) -> DataFrame:
    """(id, score): the best of several partitions' scores."""
    return scores.groupBy("id").agg(F.max("score").alias("score"))


def cluster_density(members: DataFrame, edges: DataFrame, saliency: DataFrame) -> DataFrame:
    """(cluster, n, internal, density, mean_saliency) of members (cluster, id). Density is internal links
    over n (n - 1); members without a saliency count in the mean's divisor."""
    inner = edges.join(members.select(F.col("cluster"), F.col("id").alias("src")), "src").join(members.select(F.col("cluster").alias("other"), F.col("id").alias("dst")), "dst").filter("cluster = other")
    inner = inner.groupBy("cluster").agg(F.count("*").alias("internal"))
    size = members.join(saliency, "id", "left").groupBy("cluster").agg(F.count("*").alias("n"), F.coalesce(F.sum("saliency"), F.lit(0.0)).alias("total"))
    n, internal = F.col("n"), F.coalesce("internal", F.lit(0))
    return size.join(inner, "cluster", "left").select("cluster", "n", internal.alias("internal"), F.when(n > 1, internal / (n * (n - 1))).otherwise(0.0).alias("density"), (F.col("total") / n).alias("mean_saliency"))


def collapse(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(src, dst, links): members become their cluster; links inside a cluster go."""
    as_ = lambda end: members.select(F.col("id").alias(end), F.col("cluster").alias(f"{end}_cluster"))
    e = edges.join(as_("src"), "src", "left").join(as_("dst"), "dst", "left")
    e = e.select(F.coalesce("src_cluster", "src").alias("src"), F.coalesce("dst_cluster", "dst").alias("dst"))
    return e.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def coactivation_targets(edges: DataFrame, sources: DataFrame, per_hop: int = 8, inbound: float = 0.25, decay: float = 0.5) -> DataFrame:
    """(id, weight) over two hops from sources (id): 1 / (rank + 1) by neighbour order, times `inbound`
    against the link's direction and `decay` on the second hop; at most `per_hop` neighbours a node; the
    best weight a target."""
    out = edges.select("src", "dst", F.lit(1.0).alias("w"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(inbound).alias("w"))
    order = Window.partitionBy("src").orderBy(F.desc("w"), "dst")
    step = out.union(back).groupBy("src", "dst").agg(F.max("w").alias("w")).filter("src <> dst")
    step = step.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < per_hop).select("src", "dst", (F.col("w") / (F.col("rank") + 1)).alias("w"))
    first = sources.select(F.col("id").alias("src")).distinct().join(step, "src").groupBy(F.col("dst").alias("id")).agg(F.max("w").alias("weight"))
    second = first.withColumnRenamed("id", "src").join(step, "src").groupBy(F.col("dst").alias("id")).agg(F.max(F.col("weight") * F.col("w") * decay).alias("weight"))
    found = first.union(second).groupBy("id").agg(F.max("weight").alias("weight"))
    return found.join(sources.select("id").distinct(), "id", "left_anti")


def pair_priority(ranks: DataFrame, tags: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """(left, right, priority) of pairs of the `limit` best-ranked nodes that aren't linked: .7 the mean rank and .3 the
    tag overlap (Jaccard). `limit` is the pool of candidates that the caller asks for, and bounds what is sent."""
    top = ranks.orderBy(F.desc("rank"), "id").limit(limit)
    own = tags.join(F.broadcast(top.select("id")), "id", "left_semi").groupBy("id").agg(F.collect_set("tag").alias("tags"))
    own = shared_table(top.join(own, "id", "left").select("id", "rank", F.coalesce("tags", F.array().cast("array<string>")).alias("tags")), "pair-pool")
    side = lambda p: own.select(*[F.col(c).alias(f"{p}_{c}") for c in own.columns])
    both = side("l").join(F.broadcast(side("r")), F.col("l_id") < F.col("r_id"))
    linked = undirected(edges).select(F.col("src").alias("l_id"), F.col("dst").alias("r_id"))
    both = both.join(linked, ["l_id", "r_id"], "left_anti")
    shared = F.size(F.array_intersect("l_tags", "r_tags"))
    overlap = shared / F.greatest(F.lit(1), F.size("l_tags") + F.size("r_tags") - shared)
    return both.select(F.col("l_id").alias("left"), F.col("r_id").alias("right"), (0.7 * (F.col("l_rank") + F.col("r_rank")) / 2 + 0.3 * overlap).alias("priority"))
