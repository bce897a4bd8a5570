"""Searches over a repository bundle and its projected pages, merged analyses, decided suggestions.

Every search is one pass of built-in expressions over a table and a top-k with a total order; no search
joins more than the hits that it returns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import lexical as L
from linkloom.operators.repo import page_score

#: The worst match bucket of each kind.
WORST = {"module": 3, "example": 10, "import": 4}


def ladder(*tests: Column) -> Column:
    """The position of the first test that holds; null if none does."""
    return reduce(lambda rest, t: F.when(t[1], t[0]).otherwise(rest), reversed(list(enumerate(tests))), F.lit(None).cast("int"))


def _tests(column: Column, q: Column) -> tuple[Column, Column, Column]:
    return column == q, F.startswith(column, q), F.contains(column, q)


def module_bucket(query: str) -> Column:
    """0 to 3 over qualified_name and path; an empty query matches all at 0."""
    q = F.lit(query.strip().lower())
    return F.lit(0) if not query.strip() else ladder(*_tests(F.lower("qualified_name"), q), F.contains(F.lower("path"), q))


def example_bucket(query: str) -> Column:
    """0 to 10 over title, the arrays related_symbols and related_modules, path and summary."""
    if not query.strip():
        return F.lit(0)
    q = F.lit(query.strip().lower())
    equal, prefix, inside = _tests(F.lower("title"), q)
    any_of = lambda c, k: F.exists(c, lambda x: _tests(F.lower(x), q)[k])
    s, m = "related_symbols", "related_modules"
    return ladder(equal, prefix, inside, any_of(s, 0), any_of(m, 0), any_of(s, 1), any_of(m, 1), F.contains(F.lower("path"), q), F.contains(F.lower("summary"), q), any_of(s, 2), any_of(m, 2))


def import_bucket(package: str | None, module: str | None) -> Column:
    """0 to 3 over target_package and source_module; with both filters each has to match."""
    p_equal, p_prefix, p_inside = _tests(F.lower("target_package"), F.lit(package))
    m_equal, m_prefix, m_inside = _tests(F.lower("source_module"), F.lit(module))
    none = F.lit(None).cast("int")
    if package is None and module is None:
        return F.lit(0)
    if package is None:
        return ladder(m_equal, m_prefix, m_inside)
    if module is None:
        return F.when(p_equal, 0).when(p_prefix, 1).when(p_inside, 3)
    return F.when(p_equal, ladder(m_equal, m_prefix)).when(p_prefix, F.when(m_prefix, 2).otherwise(none)).when(p_inside, 3)


def bundle_search(rows: DataFrame, bucket: Column, kind: str, order: list[str], limit: int) -> DataFrame:
    """The first `limit` matches with `bucket` and its `score`, by bucket and then `order`."""
    hit = rows.withColumn("bucket", bucket).filter("bucket is not null")
    return hit.withColumn("score", L.bucket_score(F.col("bucket"), WORST[kind])).orderBy("bucket", *order).limit(max(1, limit))


def with_related(examples: DataFrame, relations: DataFrame, symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """`examples` (example_id, ...) with the names of the symbols and modules that each is an example of."""
    link = relations.filter("kind = 'example_of'").select(F.col("source_id").alias("example_id"), F.col("target_id"))
    of = lambda t, key, name: link.join(t.select(F.col(key).alias("target_id"), F.col(name).alias("_name")), "target_id").groupBy("example_id").agg(F.sort_array(F.collect_set("_name")).alias("_names"))
    empty = F.array().cast("array<string>")
    for column, names in (("related_symbols", of(symbols, "symbol_id", "name")), ("related_modules", of(modules, "module_id", "qualified_name"))):
        examples = examples.join(names, "example_id", "left").withColumn(column, F.coalesce("_names", empty)).drop("_names")
    return examples


def node_score(query: str) -> Column:
    """Title 100 / 90 / 75 for equal, prefix, contained; a segment of the structural path 60; text 45."""
    q = F.lit(query.strip().lower())
    equal, prefix, inside = _tests(F.lower("node_title"), q)
    part = F.exists("structural_path", lambda s: F.contains(F.lower(s), q))
    found = F.when(equal, 100).when(prefix, 90).when(inside, 75).when(part, 60).when(F.contains(F.lower("text"), q), 45).otherwise(0)
    return found if query.strip() else F.lit(0)


def node_hits(nodes: DataFrame, query: str) -> DataFrame:
    """page_id, node_id, node_title and score of matching nodes (page_id, node_id, node_title, structural_path, text)."""
    return nodes.withColumn("score", node_score(query)).filter("score > 0").select("page_id", "node_id", "node_title", "score")


def tree_search(nodes: DataFrame, pages: DataFrame, query: str, limit: int) -> DataFrame:
    """The best nodes with their page's title."""
    met = node_hits(nodes, query).join(pages.select("page_id", F.col("title").alias("page_title")), "page_id")
    return met.orderBy(F.desc("score"), "page_title", "node_title", "node_id").limit(max(1, limit))


def mixed_search(pages: DataFrame, nodes: DataFrame, query: str, limit: int) -> DataFrame:
    """Page hits and node hits in one order; of equal hits the page comes first. `pages` has page_id,
    title, path and keywords."""
    page = pages.withColumn("score", page_score(query)).filter("score > 0").select("page_id", F.col("title").alias("page_title"), F.lit("").alias("node_id"), F.col("title").alias("hit_title"), "score", F.lit("page").alias("kind"))
    node = node_hits(nodes, query).join(pages.select("page_id", F.col("title").alias("page_title")), "page_id")
    node = node.select("page_id", "page_title", "node_id", F.col("node_title").alias("hit_title"), "score", F.lit("page_index_node").alias("kind"))
    first = F.when(F.col("kind") == "page", 0).otherwise(1)
    return page.unionByName(node).orderBy(F.desc("score"), "page_title", "hit_title", first, "page_id", "node_id").limit(max(1, limit))


def merge_records(base: DataFrame, overlay: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One record a key: each field of the overlay that is neither null nor empty, else the base's."""
    over = overlay.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    met = base.select(key, *fields).join(over, key, "full")
    return met.select(key, *[F.coalesce(F.nullif(F.col(f"_{f}"), F.lit("")), F.col(f)).alias(f) for f in fields])


def decide(latest: DataFrame, decisions: DataFrame) -> DataFrame:
    """What becomes of each decision (decision_id, suggestion_id, target_state, decided_at) on the latest
    rows of suggestions (suggestion_id, state): the first on a provisional suggestion is applied, a later
    one or one on a settled suggestion finds it finalized, and one without a suggestion is missing. The
    first decision is an aggregate, so a suggestion with very many decisions is no one task's work."""
    first = decisions.groupBy("suggestion_id").agg(F.min(F.struct("decided_at", "decision_id"))["decision_id"].alias("_first"))
    state = latest.select("suggestion_id", "state").join(first, "suggestion_id")
    met = decisions.join(state, "suggestion_id", "left")
    won = (F.col("state") == "provisional") & (F.col("decision_id") == F.col("_first"))
    outcome = F.when(F.col("state").isNull(), "missing").when(won, "applied").otherwise("finalized")
    return met.select("decision_id", "suggestion_id", F.col("state").alias("previous_state"), "target_state", outcome.alias("outcome"))
