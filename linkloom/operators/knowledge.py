"""Entities, relations and knowledge entries: search scores, multi-hop, duplicates, upserts, overlays."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import lexical as L
from linkloom.operators import graph as G
from linkloom.shared import shared_table

#: Queries of a nearest-neighbour search that are sent to the scans at a time.
MOST_QUERIES = 20_000
#: Edits and letters of a name up to which its near names are met by deletions.
DELETED, DELETED_LETTERS = 2, 40


def entity_score(query: str) -> Column:
    """Best of exact, alias, token, substring, partial, fuzzy and description matches, times .8 to 1 by confidence."""
    q = query.strip().lower()
    words = [w for w in L.tokenize(query) if len(w) >= 2]
    n, d = F.lower("name"), F.lower(F.coalesce("description", F.lit("")))
    alias = F.transform("aliases", lambda a: F.lower(a))
    name_words = L.tokens(F.col("name"))
    whole = F.forall(F.array(*[F.lit(w) for w in words]), lambda w: F.array_contains(name_words, w)) if words else F.lit(False)
    shared = sum((F.array_contains(name_words, w).cast("int") for w in words), F.lit(0)) / F.lit(float(max(1, len(words))))
    sim = 1 - F.levenshtein(n, F.lit(q)) / F.greatest(F.length(n), F.lit(len(q)))
    best = F.greatest(
        F.when(n == q, 1.0).otherwise(0.0),
        F.when(F.array_contains(alias, q), 0.95).otherwise(0.0),
        F.when(whole, 0.85).otherwise(0.0),
        F.when(L.has(n, q) | F.contains(F.lit(q), n), 0.7).otherwise(0.0),
        F.when(F.exists(alias, lambda a: F.contains(a, F.lit(q)) | F.contains(F.lit(q), a)), 0.65).otherwise(0.0),
        0.5 * shared,
        F.when(sim >= 0.75, 0.4 * sim).otherwise(0.0),
        F.when(L.has(d, q), 0.3).otherwise(0.0),
    )
    return best * (0.8 + 0.2 * F.col("confidence"))


def search_entities(entities: DataFrame, query: str, limit: int) -> DataFrame:
    hit = entities.select("id", "name", "entity_type", entity_score(query).alias("score")).filter("score > 0")
    return hit.orderBy(F.desc("score"), "name", "id").limit(limit)


def multi_hop(relations: DataFrame, name: str, hops: int) -> DataFrame:
    """(name): entities met in `hops` frontiers of the undirected relations, the start being the first."""
    edges = relations.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    seed = relations.sparkSession.createDataFrame([(name,)], "id string")
    return G.distances(edges, seed, "both", max(0, hops - 1) or 1).select(F.col("id").alias("name"), "distance")


def kg_stats(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(what, kind, n): entities by type and relations by type."""
    e = entities.groupBy(F.col("entity_type").alias("kind")).agg(F.count("*").alias("n")).withColumn("what", F.lit("entity"))
    r = relations.groupBy(F.col("relation_type").alias("kind")).agg(F.count("*").alias("n")).withColumn("what", F.lit("relation"))
    return e.unionByName(r).select("what", "kind", "n")


def tool_relevance(entities: DataFrame, relations: DataFrame, terms: list[str], hops: int = 2, limit: int = 20) -> DataFrame:
    """(name, score): seeds by how terms match their name or aliases, spread over `hops` at 1, .5, .25,
    added up to 2."""
    n = F.lower("name")
    alias = F.transform("aliases", lambda a: F.lower(a))
    one = lambda t: F.when(n == t, 1.0).when(F.array_contains(alias, t), 0.85).when(L.has(n, t), 0.5).otherwise(0.0)
    seeds = entities.select("name", sum((one(t.lower()) for t in terms), F.lit(0.0)).alias("score")).filter("score > 0")
    step = G.undirected(relations.select(F.col("source").alias("src"), F.col("target").alias("dst")))
    every, front = seeds, seeds
    for _ in range(hops):
        front = front.join(step, F.col("name") == F.col("src")).groupBy(F.col("dst").alias("name")).agg((F.max("score") * 0.5).alias("score"))
        every = every.unionByName(front)
    total = every.groupBy("name").agg(F.least(F.lit(2.0), F.sum("score")).alias("score"))
    return total.orderBy(F.desc("score"), "name").limit(limit)


def normal_name(c: Column) -> Column:
    """Lower case, trimmed, without punctuation."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", ""))


def name_similarity(a: Column, b: Column) -> Column:
    """Of normal names: 1.0 equal, .9 containment, else edit similarity and a word bonus."""
    x, y = normal_name(a), normal_name(b)
    wx, wy = (F.array_distinct(F.filter(F.split(c, r"\s+"), lambda t: t != "")) for c in (x, y))
    bonus = F.size(F.array_intersect(wx, wy)) / F.greatest(F.size(wx) + F.size(wy), F.lit(1)) * 0.2
    edit = 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))
    return F.when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.9).otherwise(F.least(F.lit(1.0), edit + bonus))


def _by_segment(names: DataFrame, long: DataFrame, share: float) -> DataFrame:
    """(a, b): pairs of `names` and longer ones of `long` within k = share * length edits of these, and others. Cut into k + 1 segments, the
    longer name has one that no edit touches: the other name holds it, at most k places off."""
    edits = lambda n: F.floor(share * n + 1e-9).cast("int")
    cut = lambda n, k, i: F.floor(i * n / (k + 1)).cast("int")
    n = F.length("name")
    k = edits(n)
    segments = F.transform(F.sequence(F.lit(0), k), lambda i: F.struct(n.alias("long"), i.alias("i"), F.substring("name", cut(n, k, i) + 1, cut(n, k, i + 1) - cut(n, k, i)).alias("part")))
    longer = long.select(F.col("name").alias("b"), F.explode(segments).alias("at")).select("b", "at.*")
    reach = names.select("name", F.explode(F.sequence(n, F.floor(n / (1 - share) + 1e-9).cast("int"))).alias("long"))
    reach = reach.withColumn("k", edits(F.col("long"))).filter(F.col("long") - F.length("name") <= F.col("k"))
    reach = reach.select("name", "long", "k", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
    begin = cut(F.col("long"), F.col("k"), F.col("i"))
    size = cut(F.col("long"), F.col("k"), F.col("i") + 1) - begin
    low, high = F.greatest(F.lit(0), begin - F.col("k")), F.least(n - size, begin + F.col("k"))
    parts = F.when(low <= high, F.array_distinct(F.transform(F.sequence(low, high), lambda p: F.substring(F.col("name"), p + 1, size))))
    shorter = reach.select(F.col("name").alias("a"), "long", "i", F.explode(parts).alias("part"))
    return shorter.join(longer, ["long", "i", "part"]).select("a", "b")


def _by_deletion(names: DataFrame) -> DataFrame:
    """(a, b): pairs of names (name, k) within k edits of either, and others: both are the same text without k letters at most."""
    left = names.select("name", "k", F.col("name").alias("part"))
    out = left
    for _ in range(DELETED):
        cut = F.transform(F.sequence(F.lit(1), F.length("part")), lambda i: F.concat(F.substring(F.col("part"), F.lit(1), i - 1), F.substring(F.col("part"), i + 1, F.length("part"))))
        left = left.filter("k > 0 and part <> ''").select("name", (F.col("k") - 1).alias("k"), F.explode(F.array_distinct(cut)).alias("part"))
        out = out.union(left)
    side = lambda p: out.select(F.col("name").alias(p), "part").distinct()
    return side("a").join(side("b"), "part").filter("a < b").select("a", "b")


def _similar_candidates(names: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of different normal names that can reach `threshold`, none left out.

    Names that share no word have no bonus: they reach it within (1 - threshold) * length edits of the longer name.
    Where those are few and the name is short, deletions meet them, which no common beginning makes hot; longer names are met
    by segments. The bonus is .1 at most, so names with white space are met within (1.1 - threshold) * length edits too (a name
    without, if another shares it as a word, is contained in that). Containment is an equality with a substring."""
    if threshold <= 0.3:
        raise ValueError("at thresholds up to 0.3 names without a common part are similar")
    n = F.length("name")
    k = F.floor((1 - threshold) * F.floor(n / threshold + 1e-9) + 1e-9).cast("int")  # with the longest name in reach
    own = names.select("name", k.alias("k"), ((k <= DELETED) & (n <= DELETED_LETTERS)).alias("few"))
    close = _by_deletion(own.filter("few")).union(_by_segment(own, own.filter("not few"), 1 - threshold))
    several = names.filter(F.rlike("name", F.lit(r"\s")))
    close = close.union(_by_segment(several, several, 1.1 - threshold))
    if threshold <= 0.9:
        lengths = names.select(n.alias("m")).distinct().filter("m > 0")  # a few numbers: how long names are
        inside = F.array_distinct(F.transform(F.sequence(F.lit(1), n - F.col("m") + 1), lambda p: F.substring(F.col("name"), p, F.col("m"))))
        subs = names.join(F.broadcast(lengths), n > F.col("m")).select(F.col("name").alias("b"), F.explode(inside).alias("a"))
        close = close.union(names.select(F.col("name").alias("a")).join(subs, "a").select("a", "b"))
        empty = F.broadcast(names.filter("name = ''").select(F.col("name").alias("a")))  # names differ: one row at most
        close = close.union(names.select(F.lit("").alias("a"), F.col("name").alias("b")).join(empty, "a", "left_semi"))
    return close.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def duplicate_pairs(entities: DataFrame, threshold: float) -> DataFrame:
    """(left_id, right_id, left, right, similarity): every pair of different normal names at or above `threshold`, each
    name by its entity of smallest id; and the other entities of a name with that one, at 1.0. Rows a name
    grow with its own length, not with the number of names, but for a beginning that many long names share."""
    e = entities.select("id", "name", normal_name(F.col("name")).alias("x")).filter("x is not null")
    first = e.groupBy("x").agg(F.min(F.struct("id", "name")).alias("f")).select("x", F.col("f.id").alias("id"), F.col("f.name").alias("name"))
    first = shared_table(first, "names")  # candidates are met in several ways, each from the names
    side = lambda p: first.select(F.col("x").alias(p), F.col("id").alias(f"{p}_id"), F.col("name").alias(f"{p}_name"))
    met = _similar_candidates(first.select(F.col("x").alias("name")), threshold).join(side("a"), "a").join(side("b"), "b")
    met = met.withColumn("similarity", name_similarity(F.col("a"), F.col("b"))).filter(F.col("similarity") >= threshold)
    turn = F.col("a_id") < F.col("b_id")
    pick = lambda c: (F.when(turn, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")), F.when(turn, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")))
    (left_id, right_id), (left, right) = pick("id"), pick("name")
    pairs = met.select(left_id.alias("left_id"), right_id.alias("right_id"), left.alias("left"), right.alias("right"), "similarity")
    own = e.join(first.select("x", F.col("id").alias("left_id"), F.col("name").alias("left")), "x").filter("id <> left_id")
    return pairs.union(own.select("left_id", F.col("id").alias("right_id"), "left", F.col("name").alias("right"), F.lit(1.0).alias("similarity")))


def merge_entities(entities: DataFrame, groups: DataFrame) -> DataFrame:
    """Entities after merging groups (group_id, id): the member with the longest description and most
    aliases gives the name, aliases unite, confidence is the largest."""
    own = entities.join(groups, "id", "left").withColumn("group_id", F.coalesce("group_id", "id"))
    weight = F.length(F.coalesce("description", F.lit(""))) + 10 * F.size("aliases")
    w = Window.partitionBy("group_id").orderBy(F.desc("_w"), "name")
    first = own.withColumn("_w", weight).withColumn("_n", F.row_number().over(w))
    return first.groupBy("group_id").agg(
        F.max(F.when(F.col("_n") == 1, F.col("name"))).alias("name"),
        F.max(F.when(F.col("_n") == 1, F.col("entity_type"))).alias("entity_type"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"),
        F.max("confidence").alias("confidence"),
        F.count("*").alias("members"),
    )


def valid_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations whose both ends are entities' names; one of each (source, target, type)."""
    names = entities.select("name").distinct()
    r = relations.join(names.withColumnRenamed("name", "source"), "source", "left_semi").join(names.withColumnRenamed("name", "target"), "target", "left_semi")
    return r.dropDuplicates(["source", "target", "relation_type"])


def remove_entities(relations: DataFrame, names: DataFrame) -> DataFrame:
    """Relations that touch none of the removed `names` (name)."""
    return relations.join(names.withColumnRenamed("name", "source"), "source", "left_anti").join(names.withColumnRenamed("name", "target"), "target", "left_anti")


def upsert(base: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """`changes` over `base`: a known key keeps created_at and counts its version up, a new one starts at 1."""
    old = base.select(F.col(key), F.col("created_at").alias("_c"), F.col("version").alias("_v"))
    new = changes.join(old, key, "left").withColumns({"created_at": F.coalesce("_c", "created_at"), "version": F.coalesce(F.col("_v") + 1, F.lit(1)).cast("int")}).drop("_c", "_v")
    return base.join(changes.select(key), key, "left_anti").unionByName(new.select(*base.columns))


def text_overlap(query: str) -> Column:
    """Share of the query's words (repeats count) in title, content and tags; 1 more for the id, .1 for the category."""
    words = L.tokenize(query)
    text = F.lower(F.concat_ws(" ", "title", "content", F.array_join("tags", " ")))
    # A word is found as a token without the text being cut into all of its tokens; its letters are looked for first.
    has = lambda w: F.rlike(text, F.lit(rf"{re.escape(w)}(?<![A-Za-z0-9_-]{re.escape(w)})(?![A-Za-z0-9_-])"))
    share = sum((has(w).cast("int") * words.count(w) for w in dict.fromkeys(words)), F.lit(0)) / F.lit(float(max(1, len(words))))
    return share + F.when(F.lower("id") == query.strip().lower(), 1.0).otherwise(0.0) + F.when(F.contains(F.lit(query.lower()), F.lower("category")), 0.1).otherwise(0.0)


def register_skills(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of notes: a skill entity a note of type skill, a keyword entity a tag, linked."""
    s = notes.filter("doc_type = 'skill'")
    tag = s.select("stem", F.explode("tags").alias("tag")).withColumn("keyword", F.concat(F.lit("keyword:"), F.lower("tag")))
    e = s.select(F.col("stem").alias("name"), F.lit("skill").alias("entity_type")).unionByName(tag.select(F.col("keyword").alias("name"), F.lit("concept").alias("entity_type"))).distinct()
    r = tag.select(F.col("stem").alias("source"), F.col("keyword").alias("target"), F.lit("RELATED_TO").alias("relation_type")).distinct()
    return e, r


def recall_boost(docs: DataFrame, links: DataFrame, tags: DataFrame, link_boost: float, tag_boost: float) -> DataFrame:
    """(id, boost): pairs of results that are linked give both `link_boost`, pairs that share a tag
    `tag_boost`; either only among results that the link table knows. `docs` (id) is a result list."""
    known = docs.join(links.select(F.col("src").alias("id")).union(links.select(F.col("dst").alias("id"))).distinct(), "id", "left_semi")
    linked = G.undirected(G.induced(links, known)).select(F.col("src").alias("id"), F.lit(link_boost).alias("b"))
    own = tags.join(known, "id").distinct()
    pair = own.alias("a").join(own.withColumnRenamed("id", "other"), "tag").filter("id <> other").select("id", "other").distinct().select("id", F.lit(tag_boost).alias("b"))
    return linked.union(pair).groupBy("id").agg(F.sum("b").alias("boost"))


def knn(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, nth): the k nearest rows by cosine. `queries` (query_id, query) are sent to the scans in
    counted parts of `MOST_QUERIES`. A task screens its rows by matrix products and gives the rows that may be among a
    query's k best; their cosines are sums in the order of the elements, so equal vectors have equal scores. Vectors of
    other lengths, zero or null ones score 0."""
    queries = queries.select("query_id", F.col("query").cast("array<double>").alias("query"))
    n = queries.count()
    parts = max(1, -(-n // MOST_QUERIES))
    kind = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {vectors.schema['vec_id'].dataType.simpleString()}, score double"
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    out = None
    for p in range(parts):
        own = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p) if parts > 1 else queries
        near = rows.mapInArrow(_nearest(rows.sparkSession.sparkContext.broadcast(own.toArrow()), k), kind)
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        hit = near.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k)
        out = hit if out is None else out.unionByName(hit)
    return out


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """One row a vector; those of another length or with a null element are zero."""
    out = np.zeros((len(column), size))
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    own = np.flatnonzero(lengths == size)
    flat = column.take(pa.array(own)).flatten()
    own_rows = np.asarray(flat.fill_null(0.0)).reshape(len(own), size)
    whole = np.asarray(flat.is_valid()).reshape(len(own), size).all(axis=1)
    out[own[whole]] = own_rows[whole]
    return out


def _dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, element after element."""
    out = np.zeros(len(x))
    for i in range(x.shape[1]):
        out += x[:, i] * y[:, i]
    return out


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one (zero rows stay), and the lengths."""
    norm = np.sqrt(_dot(x, x))
    return np.divide(x, norm[:, None], out=np.zeros_like(x), where=norm[:, None] > 0), norm


def _nearest(sent, k: int):
    """The rows (query_id, vec_id, score) of a task that may be among the k best of a query of the table `sent`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value.combine_chunks()
        ids = table["query_id"].combine_chunks() if table.num_rows else None
        column = table["query"].combine_chunks() if table.num_rows else None
        lengths = np.asarray(column.value_lengths().fill_null(0)) if table.num_rows else np.array([], int)
        groups = []
        for size in np.unique(lengths):
            at = np.flatnonzero(lengths == size)
            q = _matrix(column.take(pa.array(at)), int(size))
            groups.append((int(size), at, q, *_unit(q)))
        least = np.full(len(lengths), -np.inf)  # the k-th best score that the task has met, by query
        for batch in batches:
            for start in range(0, batch.num_rows, 4_096):
                piece = batch.slice(start, 4_096)
                piece = piece.take(pc.sort_indices(piece.column(0), null_placement="at_start"))
                for size, at, q, unit, norm in groups:
                    x = _matrix(piece.column(1), size)
                    # Of equal vectors the k smallest ids are enough: the others come after them for every query.
                    _, same = np.unique(x.view(np.dtype((np.void, 8 * size))).ravel() if size else np.zeros(len(x)), return_inverse=True)
                    order = np.argsort(same, kind="stable")
                    first = np.flatnonzero(np.r_[True, np.diff(same[order]) > 0])
                    nth = np.arange(len(x)) - np.repeat(first, np.diff(np.r_[first, len(x)]))
                    own = np.sort(order[nth < k])
                    x = x[own]
                    xu, xn = _unit(x)
                    for c in range(0, len(at), 512):
                        part = slice(c, c + 512)
                        score = np.nan_to_num(xu @ unit[part].T, nan=np.inf)
                        if len(own) >= k:
                            kth = np.partition(score, len(own) - k, axis=0)[len(own) - k]
                            least[at[part]] = np.maximum(least[at[part]], kth)
                        r, j = np.nonzero(score >= least[at[part]] - 1e-9)
                        j = j + c
                        size_of = xn[r] * norm[j]
                        exact = np.divide(_dot(x[r], q[j]), size_of, out=np.zeros(len(r)), where=(size_of > 0) | np.isnan(size_of))
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(at[j])), piece.column(0).take(pa.array(own[r])), pa.array(exact)], names=["query_id", "vec_id", "score"])

    return run


def fuse(anchors: DataFrame, topology: DataFrame, alpha: float = 0.5, clamped: bool = True) -> DataFrame:
    """(id, vector_score, topology_score, score): alpha times the vector, the rest the graph; both clamped, or as they are."""
    v, t = F.col("vector_score"), F.coalesce("topology_score", F.lit(0.0))
    v, t = (L.clamp(v), L.clamp(t)) if clamped else (v, t)
    return anchors.join(topology, "id", "left").select("id", v.alias("vector_score"), t.alias("topology_score"), (alpha * v + (1 - alpha) * t).alias("score"))


def provisional_boosts(suggestions: DataFrame) -> DataFrame:
    """(id, boost): each provisional link gives both ends .08 + .27 confidence within [.08, .35]; several add
    up as independent chances, .35 at most."""
    ends = suggestions.select(F.explode(F.array("source_id", "target_id")).alias("id"), L.clamp(0.08 + 0.27 * F.col("confidence"), 0.08, 0.35).alias("b"))
    return ends.groupBy("id").agg(F.least(F.lit(0.35), 1 - F.exp(F.sum(F.log1p(-F.col("b"))))).alias("boost"))


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def overlay(edges: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Links with promoted suggestions added."""
    more = suggestions.filter("promotion_state = 'promoted'").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    return edges.select("src", "dst").union(more).distinct()
