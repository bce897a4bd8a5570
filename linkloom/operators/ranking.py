"""Ranking helpers over result rows: boosts with injection, horizons, worker chunks, blends, dense clusters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.similarity import boosted


def with_boosts(hits: DataFrame, boosts: DataFrame, limit: int) -> DataFrame:
    """(id, score): hits lifted by their boost, and boosted ids that were no hit at .25 plus half of it."""
    b = boosts.groupBy("id").agg(F.max("boost").alias("boost"))
    lifted = hits.join(b, "id", "left").select("id", boosted(F.col("score"), F.col("boost")).alias("score"))
    more = b.join(hits, "id", "left_anti").select("id", (0.25 + 0.5 * F.col("boost")).alias("score"))
    return lifted.unionByName(more).orderBy(F.desc("score"), "id").limit(limit)


def trim_horizon(near: DataFrame, names: DataFrame, most: int) -> DataFrame:
    """(id, distance): the seeds and the first `most` others by distance, path and stem."""
    met = near.join(names, "id", "left")
    rest = met.filter("distance > 0").orderBy("distance", "path", "stem").limit(most)
    return met.filter("distance = 0").unionByName(rest).select("id", "distance")


def worker_chunks(pairs: DataFrame, size: int, workers: int) -> DataFrame:
    """The best `size` times `workers` pairs by priority, each with its worker."""
    top = pairs.orderBy(F.desc("priority"), "left", "right").limit(size * workers)
    w = Window.orderBy(F.desc("priority"), "left", "right")  # over the limited rows
    return top.withColumn("worker", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def blend(hits: DataFrame, analysed: DataFrame, weight: float = 0.5) -> DataFrame:
    """(id, score, final_score): an analyser's score (id, analyzer_score) blended in where there is one."""
    a = F.col("analyzer_score")
    return hits.join(analysed, "id", "left").select("id", "score", F.coalesce((1 - weight) * F.col("score") + weight * a, "score").alias("final_score"))


def topology_score(contexts: DataFrame, most: int) -> DataFrame:
    """(anchor, topology_score): the sum of an anchor's `most` best scores, at most 1."""
    w = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    top = contexts.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
    return top.groupBy("anchor").agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sum("score"))).alias("topology_score"))


def dense_clusters(edges: DataFrame, saliency: DataFrame, components: DataFrame, least: int = 3, most: int = 15, density: float = 0.4, mean: float = 0.7) -> DataFrame:
    """(cluster, id): greedy growth from the most salient nodes of each component (id, component): a
    neighbour joins while the density holds. Components are dealt out; one is a task's work."""
    e = edges.join(components.select(F.col("id").alias("src"), "component"), "src").select("component", "src", "dst", F.lit(None).cast("double").alias("s"))
    n = saliency.join(components, "id").select("component", F.col("id").alias("src"), F.lit(None).cast("string").alias("dst"), F.col("saliency").alias("s"))

    def grow(key, pdf: pd.DataFrame) -> pd.DataFrame:
        s = dict(zip(pdf[pdf.dst.isna()].src, pdf[pdf.dst.isna()].s, strict=True))
        near: dict[str, set] = {}
        for a, b in pdf[pdf.dst.notna()][["src", "dst"]].itertuples(index=False):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        links = {(a, b) for a, b in pdf[pdf.dst.notna()][["src", "dst"]].itertuples(index=False)}
        used, out = set(), []
        for seed in sorted(s, key=lambda x: (-s[x], x)):
            if seed in used or s[seed] < mean:
                continue
            group = [seed]
            while len(group) < most:
                fit = [x for x in {y for g in group for y in near.get(g, ())} - set(group) - used]
                inside = lambda x: sum(((x, g) in links) + ((g, x) in links) for g in group)
                best = max(sorted(fit), key=lambda x: (inside(x), s.get(x, 0.0)), default=None)
                if best is None:
                    break
                size = len(group) + 1
                total = sum((a, b) in links for a in [*group, best] for b in [*group, best] if a != b)
                if total / (size * (size - 1)) < density:
                    break
                group.append(best)
            if len(group) >= least and sum(s.get(x, 0.0) for x in group) / len(group) >= mean:
                used |= set(group)
                out += [(f"cluster:{min(group)}", x) for x in group]
        return pd.DataFrame(out, columns=["cluster", "id"])

    return e.unionByName(n).groupBy("component").applyInPandas(grow, "cluster string, id string")


def narrative(hits: DataFrame, limit: int) -> DataFrame:
    """One row (text): the best `limit` hits in order, a line each with title, path and score."""
    hits = hits.orderBy(F.desc("score"), "path").limit(limit)
    line = F.format_string("- %s (%s) score %.3f", "title", "path", "score")
    return hits.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "path", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def batches_of(hits: DataFrame) -> Iterator:
    """Arrow batches of a result, for an Arrow client."""
    return iter(hits.toArrow().to_batches())
