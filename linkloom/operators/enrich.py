"""What notes, entries and repositories get beside their own rows: statistics, inferred relations, slugs, edits,
snapshots, projected pages, and contexts of semantic anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.lexical import clamp
from linkloom.operators import graph as G


def knowledge_stats(entries: DataFrame) -> DataFrame:
    """(what, key, n) of entries (category, tags, updated_at): all, by category, distinct tags in any case, newest."""
    row = lambda df, what, key, n: df.select(F.lit(what).alias("what"), key.alias("key"), n.cast("long").alias("n"))
    nothing = F.lit("")
    total = row(entries.agg(F.count("*").alias("c")), "total", nothing, F.col("c"))
    by = row(entries.groupBy("category").agg(F.count("*").alias("c")), "category", F.col("category"), F.col("c"))
    tags = row(entries.select(F.explode("tags").alias("t")).agg(F.count_distinct(F.lower("t")).alias("c")), "tags", nothing, F.col("c"))
    newest = row(entries.agg(F.max("updated_at").alias("c")), "updated", nothing, F.col("c"))
    return total.union(by).union(tags).union(newest)


def reference_stats(refs: DataFrame) -> DataFrame:
    """(kind, total, entities) of references (name, kind): by kind, and all of them under a null kind."""
    return refs.rollup("kind").agg(F.count("*").alias("total"), F.count_distinct("name").alias("entities"))


def inferred_relations(notes: DataFrame, refs: DataFrame) -> DataFrame:
    """(source, target, relation_type) of notes (id, title, path, name, tags) and references (id, name): a reference is
    documented in its note, a skill file contains its skill, a note is related to its tags."""
    out = lambda df, source, target, kind: df.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("relation_type"))
    known = refs.select("id", F.col("name").alias("ref")).join(notes.select("id", "title"), "id")
    skill = notes.filter(F.contains(F.upper("path"), F.lit("SKILL.MD")) & F.col("name").isNotNull())
    tags = notes.select("title", F.explode("tags").alias("tag"))
    return out(known, F.col("ref"), F.col("title"), "DOCUMENTED_IN").union(out(skill, F.col("name"), F.col("title"), "CONTAINS")).union(out(tags, F.col("title"), F.concat(F.lit("tag:"), "tag"), "RELATED_TO"))


def passage_entity_edges(passages: DataFrame) -> DataFrame:
    """(src, dst): links between passages (passage_id, entities) and their entities, both ways."""
    own = passages.select(F.col("passage_id").alias("src"), F.explode(F.array_distinct("entities")).alias("dst")).distinct()
    return own.union(own.select("dst", "src"))


def symbol_documents(observations: DataFrame) -> DataFrame:
    """(symbol, docs): the sorted documents of each observed symbol (doc_id, symbols)."""
    own = observations.select("doc_id", F.explode("symbols").alias("symbol")).distinct()
    return own.groupBy("symbol").agg(F.sort_array(F.collect_list("doc_id")).alias("docs"))


def section_slugs(section_rows: DataFrame) -> DataFrame:
    """(path, ord, node_id): a section's explicit ID, else the note's path and the heading path as a slug; the n-th
    section of one slug gets -n from the second on."""
    raw = F.lower(F.when(F.trim("heading_path") == "", F.col("heading_title")).otherwise(F.col("heading_path")))
    slug = F.regexp_replace(F.regexp_replace(raw, "[^a-z0-9]", "-"), "^-+|-+$", "")
    rows = section_rows.select("path", "ord", F.nullif(F.trim(F.col("attributes")["ID"]), F.lit("")).alias("own"), F.when(slug == "", "overview").otherwise(slug).alias("slug"))
    nth = F.row_number().over(Window.partitionBy("path", "slug", F.col("own").isNull()).orderBy("ord"))
    numbered = F.concat_ws("-", "slug", F.when(nth > 1, nth.cast("string")))
    return rows.select("path", "ord", F.coalesce("own", F.concat("path", F.lit("#"), numbered)).alias("node_id"))


def apply_edits(notes: DataFrame, edits: DataFrame, least: float = 0.0) -> DataFrame:
    """(path, status, content): notes (path, content) with edits (path, start, end, expected, text, confidence): code
    points [start, end) whose SHA-256 is `expected` become `text`. Edits below `least` are left out. A note is
    changed whole or not at all: 'stale' if a hash differs, 'conflict' if edits overlap, else 'applied'."""
    own = F.sort_array(F.collect_list(F.struct("start", "end", "expected", "text")))  # the edits of one note
    e = edits.filter(F.col("confidence") >= least).groupBy("path").agg(own.alias("edits"))
    met = notes.select("path", "content").join(e, "path")
    part = lambda x: F.substring(F.col("content"), x["start"] + 1, x["end"] - x["start"])
    stale = F.exists("edits", lambda x: F.sha2(part(x), 256) != x["expected"])
    follow = F.slice("edits", 2, F.greatest(F.lit(0), F.size("edits") - 1))
    crossed = F.exists(F.arrays_zip(F.slice("edits", 1, F.size("edits") - 1).alias("a"), follow.alias("b")), lambda z: z["a"]["end"] > z["b"]["start"])
    status = F.when(stale, "stale").when((F.size("edits") > 1) & crossed, "conflict").otherwise("applied")
    step = lambda acc, x: F.struct(F.concat(acc["out"], F.substring(F.col("content"), acc["at"] + 1, x["start"] - acc["at"]), x["text"]).alias("out"), x["end"].alias("at"))
    new = F.aggregate("edits", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("content"), acc["at"] + 1, F.length("content"))))
    return met.select("path", status.alias("status"), F.when(status == "applied", new).otherwise(F.col("content")).alias("content"))


def snapshot_id(*parts: Column) -> Column:
    """Name of a snapshot: SHA-256 of what it was made from."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def live_snapshots(log: DataFrame, now: int) -> DataFrame:
    """(id, version, payload) after a log of (id, version, op, payload, to_version, at, ttl): the newest operation of
    an id counts. `save` gives its payload, `rollback` that of the save it names, `drop` ends it; what is
    older than its ttl seconds is gone."""
    last = log.groupBy("id").agg(F.max_by(F.struct("version", "op", "payload", "to_version", "at", "ttl"), "version").alias("last")).select("id", "last.*")
    saved = log.filter("op = 'save'").select("id", F.col("version").alias("to_version"), F.col("payload").alias("saved"))
    met = last.join(saved, ["id", "to_version"], "left").filter((F.col("op") != "drop") & (F.col("at") + F.col("ttl") >= now))
    payload = F.when(F.col("op") == "save", F.col("payload")).otherwise(F.col("saved"))
    return met.select("id", "version", payload.alias("payload")).filter("payload is not null")


def projected_pages(modules: DataFrame, symbols: DataFrame, docs: DataFrame, relations: DataFrame) -> DataFrame:
    """(page_id, kind, title, doc_ids, keywords, markdown): a reference page for each module, with the docs that
    document it or one of its symbols, and for each symbol; a page for each doc with what it documents."""
    link = relations.filter("kind = 'documents'").select(F.col("source_id").alias("doc_id"), "target_id")
    link = link.join(docs.select("doc_id"), "doc_id", "left_semi")
    of_module = link.join(symbols.select(F.col("symbol_id").alias("target_id"), "module_id"), "target_id").select(F.col("module_id").alias("target_id"), "doc_id")
    found = link.select("target_id", "doc_id").union(of_module).distinct()
    sources = found.groupBy("target_id").agg(F.sort_array(F.collect_list("doc_id")).alias("doc_ids"))
    anchors = link.groupBy("doc_id").agg(F.sort_array(F.collect_set("target_id")).alias("anchors"))
    page = lambda df, kind, key, title, path: df.select(F.concat(F.lit(f"projection:{kind}:"), key).alias("page_id"), F.lit(kind.split(":")[0]).alias("kind"), title.alias("title"), path.alias("path"), key.alias("target_id"))
    none = F.array().cast("array<string>")
    seeds = page(modules, "reference:module", F.col("module_id"), F.col("qualified_name"), F.col("path")).union(page(symbols, "reference:symbol", F.col("symbol_id"), F.col("name"), F.lit("")))
    seeds = seeds.join(sources, "target_id", "left").select("page_id", "kind", "title", "path", F.coalesce("doc_ids", none).alias("doc_ids"), none.alias("anchors"))
    own = page(docs, "explanation:doc", F.col("doc_id"), F.col("title"), F.lit("")).join(anchors, F.col("target_id") == anchors["doc_id"], "left")
    seeds = seeds.union(own.select("page_id", "kind", "title", "path", F.array("target_id"), F.coalesce("anchors", none)))
    keywords = F.array_distinct(F.sort_array(F.filter(F.array("title", "path", F.coalesce(F.try_element_at("doc_ids", F.lit(1)), F.lit(""))), lambda k: k != "")))
    part = lambda name, items: F.when(F.size(items) > 0, F.concat(F.lit(f"\n\n## {name}\n\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"))).otherwise("")
    text = F.concat(F.lit("# "), "title", F.lit("\n\n## Overview\n\n"), "kind", part("Anchors", F.col("anchors")), part("Sources", F.col("doc_ids")))
    return seeds.select("page_id", "kind", "title", "doc_ids", keywords.alias("keywords"), text.alias("markdown"))


def anchor_contexts(anchors: DataFrame, edges: DataFrame, low: float = 0.0, high: float = 1.0, alpha: float = 0.5, most: int = 2, per_anchor: int = 5, rounds: int = 10) -> DataFrame:
    """(anchor, related, vector_score, topology_score, score) of semantic anchors (id, vector_score) whose score lies
    in [low, high]: the `per_anchor` best nodes by PageRank from the anchor inside its horizon, the sum of their
    scores as the anchor's topology, and both scores fused. A repeated anchor counts with its best score."""
    a = anchors.filter(F.col("vector_score").between(low, high)).groupBy(F.col("id").alias("part")).agg(F.max("vector_score").alias("vector_score"))
    rank, near = G.partitioned_ppr(edges, a.select(F.col("part").alias("id"), F.lit(1.0).alias("weight")), most, 0.85, rounds)
    found = rank.withColumn("score", F.round("score", G.DIGITS)).join(near.filter("distance > 0"), ["part", "id"])
    top = found.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("score"), "id"))).filter(F.col("nth") <= per_anchor)
    top = top.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("nth", "id"))).alias("top"), F.sum("score").alias("topology"))
    v, t = clamp(F.col("vector_score")), clamp(F.coalesce("topology", F.lit(0.0)))
    related = F.array_join(F.transform(F.coalesce("top", F.array().cast("array<struct<nth:int,id:string>>")), lambda x: x["id"]), ",")
    return a.join(top, "part", "left").select(F.col("part").alias("anchor"), related.alias("related"), v.alias("vector_score"), t.alias("topology_score"), (alpha * v + (1 - alpha) * t).alias("score"))


def horizon_sizes(edges: DataFrame, seeds: DataFrame, most: int = 2) -> DataFrame:
    """One row (parts, least, most, mean): how many nodes the horizons of seeds (id) hold."""
    near = G.horizons(edges, seeds, most)
    n = near.groupBy("part").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("parts"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"))
