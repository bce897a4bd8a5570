"""Repository intelligence over modules, symbols, docs and relations (source_id, target_id, kind)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.shared import drop_shared, freed_shuffles, shared_table

#: Base score of each kind of gap.
GAP_SCORE = {"symbol_unverified": 96, "symbol_without_docs": 92, "module_without_docs": 88, "example_without_anchor": 84, "doc_without_anchor": 72}
#: Pages of a list that are sent in a row; pages up to which a table of them is sent to all tasks; pages of a block, some more or
#: less, and the lowest bit of a page's number that tells its block; numbers of pages that are sent in a step.
PIECE, SENT_PAGES, BLOCK, BITS, STEP = 1_000, 1_000_000, 500, 33, 250_000_000
#: Cells of a table of counts, and pairs that are added to it at a time; cells for each pair above which there is no such table;
#: rows that a task gives at a time.
CELLS, SPARSE, GIVEN = 4_000_000, 32, 100_000
FAMILY_ORDER = ("reference", "how_to", "tutorial", "explanation")


def dedupe_relations(relations: DataFrame) -> DataFrame:
    return relations.dropDuplicates(["repo_id", "source_id", "target_id", "kind"])


def audit(symbols: DataFrame, relations: DataFrame, docs: DataFrame) -> DataFrame:
    """(symbol_id, state): verified if a documenting doc's title holds the name or the reverse, unverified
    if only linked, unknown otherwise."""
    link = relations.filter("kind = 'documents'").select(F.col("source_id").alias("doc_id"), F.col("target_id").alias("symbol_id"))
    met = symbols.select("symbol_id", "name").join(link, "symbol_id", "left").join(docs.select("doc_id", "title"), "doc_id", "left")
    t, n = F.lower("title"), F.lower("name")
    rank = F.when(F.contains(t, n) | F.contains(n, t), 2).when(F.col("doc_id").isNotNull(), 1).otherwise(0)
    best = met.groupBy("symbol_id").agg(F.max(rank).alias("r"))
    return best.select("symbol_id", F.element_at(F.array(F.lit("unknown"), F.lit("unverified"), F.lit("verified")), F.col("r") + 1).alias("state"))


def overview(modules: DataFrame, symbols: DataFrame, docs: DataFrame) -> DataFrame:
    """(repo_id, modules, symbols, docs)."""
    count = lambda df, n: df.groupBy("repo_id").agg(F.count("*").alias(n))
    out = count(modules, "modules").join(count(symbols, "symbols"), "repo_id", "full").join(count(docs, "docs"), "repo_id", "full")
    return out.select("repo_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("modules", "symbols", "docs")])


def coverage(symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """(module_id, covered, uncovered): symbols with and without a documenting doc."""
    has = relations.filter("kind = 'documents'").select(F.col("target_id").alias("symbol_id")).distinct().withColumn("_has", F.lit(1))
    met = symbols.join(has, "symbol_id", "left")
    return met.groupBy("module_id").agg(F.count("_has").alias("covered"), (F.count("*") - F.count("_has")).alias("uncovered"))


def scoped_docs(relations: DataFrame, modules: DataFrame, symbols: DataFrame, selector: str | None) -> DataFrame:
    """(doc_id): docs that document the module (by id, qualified name or path) or one of its symbols."""
    link = relations.filter("kind = 'documents'").select(F.col("source_id").alias("doc_id"), "target_id")
    if selector is None:
        return link.select("doc_id").distinct()
    m = modules.filter((F.col("module_id") == selector) | (F.col("qualified_name") == selector) | (F.col("path") == selector))
    m = m.orderBy(F.when(F.col("module_id") == selector, 0).when(F.col("qualified_name") == selector, 1).otherwise(2)).limit(1).select("module_id")
    ids = m.select(F.col("module_id").alias("target_id")).union(symbols.join(m, "module_id", "left_semi").select("symbol_id"))
    return link.join(ids, "target_id", "left_semi").select("doc_id").distinct()


def backlinks(relations: DataFrame, docs: DataFrame) -> DataFrame:
    """(target_id, sources): the distinct documenting docs by id, with their titles where known."""
    link = relations.filter("kind = 'documents' and trim(source_id) <> ''").select("target_id", F.col("source_id").alias("doc_id")).distinct()
    met = link.join(docs.select("doc_id", "title"), "doc_id", "left")
    return met.groupBy("target_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "title"))), lambda s: F.concat(s["doc_id"], F.lit("="), F.coalesce(s["title"], F.lit("")))), ";").alias("sources"))


def relation_saliency(relations: DataFrame) -> DataFrame:
    """(id, saliency): 2 a link in and .5 a link out, over the largest; repeated links count."""
    w = relations.select(F.col("target_id").alias("id"), F.lit(2.0).alias("w")).union(relations.select("source_id", F.lit(0.5))).groupBy("id").agg(F.sum("w").alias("w"))
    top = w.agg(F.max("w").alias("top"))
    return w.join(F.broadcast(top)).select("id", (F.col("w") / F.col("top")).alias("saliency"))  # top is one row


def _sent(pages: DataFrame) -> DataFrame:
    """A table of pages, marked for broadcast if it is counted to be small enough."""
    return F.broadcast(pages) if pages.count() <= SENT_PAGES else pages


def _numbered(rows: DataFrame, order: list[str], blocks: int) -> DataFrame:
    """`rows` with a number `no` that grows in their order, as a written table; the bits above `BITS` are a block of neighbours."""
    return shared_table(rows.repartitionByRange(blocks, *order).sortWithinPartitions(*order).withColumn("no", F.monotonically_increasing_id()), "page-numbers")


def _page_lists(anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(page_id, no) of all pages, and a row for each anchor with two or more: their numbers in order as `pages`, and as `starts`
    where each block of them begins. Both are written."""
    own = anchors.filter("anchor is not null and page_id is not null")
    found = shared_table(own.select("page_id").distinct(), "page-ids")
    blocks = max(8 * anchors.sparkSession.sparkContext.defaultParallelism, -(-found.count() // BLOCK))
    numbers = _numbered(found, ["page_id"], blocks)
    drop_shared(found)
    lists = own.join(_sent(numbers), "page_id").select("anchor", "no").groupBy("anchor").agg(F.sort_array(F.collect_set("no")).alias("pages"))
    at = F.sequence(F.lit(0), F.size("pages") - 1)
    new = lambda i: (i == 0) | (F.shiftright(F.get("pages", i), BITS) != F.shiftright(F.get("pages", i - 1), BITS))
    return numbers, shared_table(lists.filter(F.size("pages") > 1).select("pages", F.filter(at, new).alias("starts")), "page-lists")


def _counted(both: bool):
    """Counts the pairs of a block's `lefts` and `others` in the same row, some pages at a time against all of the others, as a
    product of matrices; few pairs are sorted instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        flat = lambda c: pc.list_flatten(rows[c]).to_numpy()
        length = lambda c: pc.list_value_length(rows[c]).to_numpy()
        names, left = np.unique(flat("lefts"), return_inverse=True)
        rights, other = np.unique(flat("others"), return_inverse=True)
        order = np.argsort(left, kind="stable")
        left, row, width = left[order], np.repeat(np.arange(rows.num_rows), length("lefts"))[order], len(rights)
        size, begin = length("others").astype(np.int64), np.cumsum(length("others"), dtype=np.int64)
        size, begin = size[row], (begin - size)[row]
        ends = np.cumsum(size)
        step = max(1, CELLS // width)

        def codes(i: int, j: int) -> np.ndarray:
            n = size[i:j]
            at = np.arange(n.sum()) + np.repeat(begin[i:j] - np.cumsum(n) + n, n)
            return np.repeat(left[i:j] % step * width, n) + other[at]

        for a in range(0, len(names), step):
            i, j = np.searchsorted(left, [a, a + step])
            before, cells = ends[i] - size[i], step * width
            if (ends[j - 1] - before) * SPARSE < cells:
                hit, shared = np.unique(codes(i, j), return_counts=True)
            else:
                cuts = [i, *np.unique(np.searchsorted(ends, np.arange(before + CELLS, ends[j - 1], CELLS))), j]
                total = reduce(np.add, (np.bincount(codes(p, q), minlength=cells) for p, q in pairwise(cuts) if p < q))
                hit = np.flatnonzero(total)
                shared = total[hit]
            l, r = names[a + hit // width], rights[hit % width]
            ok = l != r if both else l < r
            found = pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (l, r, shared)], ["left", "right", "shared"])
            yield from (found.slice(k, GIVEN) for k in range(0, found.num_rows, GIVEN))

    return run


def _pairs(lists: DataFrame, both: bool) -> DataFrame:
    """(left, right, shared): numbers of pages and how many lists hold both, all of a left page in one task; each pair once, its
    lower number left, or both ways. A list goes once to each block that it has pages in."""
    one = lists.select("pages", "starts", F.posexplode("starts").alias("_k", "_at"))
    end = F.coalesce(F.get("starts", F.col("_k") + 1), F.size("pages"))
    one = one.select("pages", "_at", F.shiftright(F.get("pages", F.col("_at")), BITS).alias("block"), F.slice("pages", F.col("_at") + 1, end - F.col("_at")).alias("lefts"))
    one = one.select("*", F.explode(F.sequence(F.lit(1) if both else F.col("_at") + 1, F.size("pages"), F.lit(PIECE))).alias("_from"))
    sent = one.select("block", "lefts", F.slice("pages", F.col("_from"), PIECE).alias("others"))
    counted = lambda rows: rows.groupBy("block").applyInArrow(_counted(both), "left long, right long, shared long")
    steps = -(-(lists.agg(F.sum(F.size("pages").cast("long") * F.size("starts"))).first()[0] or 0) // STEP)
    if steps <= 1:
        return counted(sent)
    with freed_shuffles(lists.sparkSession):
        done = [shared_table(counted(sent.filter(F.pmod(F.xxhash64("block"), F.lit(steps)) == k)), "page-pairs") for k in range(steps)]
    return reduce(DataFrame.union, done)


def related_pages(anchors: DataFrame, most_pages: int | None = None) -> DataFrame:
    """(left, right, shared): pages by how many anchors (page_id, anchor) both have. Pages are numbered, and an anchor's list of
    them is sent to the blocks of its pages; a pair is counted once, where its first page is, and given both ways."""
    with freed_shuffles(anchors.sparkSession):
        numbers, lists = _page_lists(anchors)
    once = _pairs(lists, False)
    for end in ("left", "right"):
        once = once.join(_sent(numbers.select(F.col("no").alias(end), F.col("page_id").alias(f"{end}_id"))), end).drop(end)
    ways = F.array(F.struct("left_id", "right_id"), F.struct(F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id")))
    return once.select(F.explode(ways).alias("_p"), "shared").select(F.col("_p.left_id").alias("left"), F.col("_p.right_id").alias("right"), "shared")


def families(anchors: DataFrame, pages: DataFrame, per_kind: int) -> DataFrame:
    """(left, kind, right, shared): the first `per_kind` related pages of each kind. All pairs of a page are counted in one task, so
    they are ranked there and only the first are named."""
    with freed_shuffles(anchors.sparkSession):
        numbers, lists = _page_lists(anchors)
        known = pages.select("page_id", "kind", "title")
        ranks = _numbered(known, ["title", "page_id"], numbers.sparkSession.sparkContext.defaultParallelism).withColumnRenamed("no", "rank")
        rights = shared_table(numbers.join(ranks, "page_id").select(F.col("no").alias("right"), "kind", "rank"), "page-kinds")
    w = Window.partitionBy("left", "kind").orderBy(F.desc("shared"), "rank")
    first = _pairs(lists, True).join(_sent(rights), "right").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_kind)
    for end in ("left", "right"):
        first = first.join(_sent(numbers.select(F.col("no").alias(end), F.col("page_id").alias(f"{end}_id"))), end).drop(end)
    return first.select(F.col("left_id").alias("left"), "kind", F.col("right_id").alias("right"), "shared")


def gaps(modules: DataFrame, symbols: DataFrame, docs: DataFrame, relations: DataFrame) -> DataFrame:
    """(gap_kind, entity_id): modules and symbols without docs, unverified symbols, docs without an anchor; relations may repeat."""
    link = relations.filter("kind = 'documents'")
    has = link.select(F.col("target_id").alias("id")).distinct()
    said = link.select(F.col("source_id").alias("doc_id")).distinct()
    m = modules.select(F.col("module_id").alias("id")).join(has, "id", "left_anti").select(F.lit("module_without_docs").alias("gap_kind"), F.col("id").alias("entity_id"))
    s = symbols.select(F.col("symbol_id").alias("id")).join(has, "id", "left_anti").select(F.lit("symbol_without_docs").alias("gap_kind"), F.col("id").alias("entity_id"))
    u = audit(symbols, relations, docs).filter("state = 'unverified'").select(F.lit("symbol_unverified").alias("gap_kind"), F.col("symbol_id").alias("entity_id"))
    d = docs.select("doc_id").join(said, "doc_id", "left_anti").select(F.lit("doc_without_anchor").alias("gap_kind"), F.col("doc_id").alias("entity_id"))
    return m.unionByName(s).unionByName(u).unionByName(d)


def planner_queue(gap_rows: DataFrame, per_kind: int) -> DataFrame:
    """(gap_kind, entity_id, total, score): the first `per_kind` gaps of each kind, all of them counted."""
    score = F.lit(0)
    for kind, n in GAP_SCORE.items():
        score = F.when(F.col("gap_kind") == kind, n).otherwise(score)
    total = gap_rows.groupBy("gap_kind").agg(F.count("*").alias("total"))
    w = Window.partitionBy("gap_kind").orderBy("entity_id")
    first = gap_rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_kind).drop("_n")
    return first.join(total, "gap_kind").withColumn("score", score)


def balance(counts: DataFrame) -> DataFrame:
    """One row (groups, low, high, spread, balanced) of (group, n): the even band and how far it is missed."""
    a = counts.agg(F.count("*").alias("groups"), F.sum("n").alias("all"), (F.max("n") - F.min("n")).alias("spread"))
    return a.select("groups", F.floor(F.col("all") / F.col("groups")).alias("low"), F.ceil(F.col("all") / F.col("groups")).alias("high"), "spread", (F.col("spread") <= 1).alias("balanced"))


def page_score(query: str):
    """Title 100 / 85 / 70 for equal, prefix, contained; keyword 60; path 40."""
    q = query.strip().lower()
    t = F.lower("title")
    return F.when(t == q, 100).when(F.startswith(t, F.lit(q)), 85).when(F.contains(t, F.lit(q)), 70).when(F.exists("keywords", lambda k: F.contains(F.lower(k), F.lit(q))), 60).when(F.contains(F.lower("path"), F.lit(q)), 40).otherwise(0)


def affected_docs(changes: DataFrame, symbol_docs: DataFrame) -> DataFrame:
    """(path, doc_id, confidence) of changed files (path) by stem, snake or Pascal form against
    (symbol, doc_id): medium up to three docs, else low; files that hit nothing give no signal."""
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    snake = F.lower(F.regexp_replace(stem, r"(?<=[a-z0-9])(?=[A-Z])|-", "_"))
    pascal = F.regexp_replace(F.initcap(F.regexp_replace(stem, "[_-]", " ")), " ", "")
    keys = changes.select("path", F.explode(F.array_distinct(F.array(stem, snake, pascal))).alias("symbol"))
    hit = keys.join(symbol_docs, "symbol").select("path", "doc_id").distinct()
    n = hit.groupBy("path").agg(F.count("*").alias("n"))
    return hit.join(n, "path").select("path", "doc_id", F.when(F.col("n") <= 3, "medium").otherwise("low").alias("confidence"))
