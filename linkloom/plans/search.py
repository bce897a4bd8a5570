"""Planned link-graph search: one plan over notes, sections and links from parsed options."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import lexical as L
from linkloom.operators import graph as G
from linkloom.plans.directives import Options, Parsed, parse

#: Weights of the strategies, the section bonus and the graph boost.
FTS = (0.62, 0.23, 0.15)
PATH_FUZZY = (0.70, 0.30)
SECTION_BETA, RANK_BOOST = 0.15, 0.35


@dataclass(frozen=True)
class Graph:
    """What a search reads: notes, sections, links (src, dst) and ranks (id, rank)."""

    notes: DataFrame
    sections: DataFrame
    edges: DataFrame
    ranks: DataFrame | None = None


def path_filter(include: tuple[str, ...], exclude: tuple[str, ...]) -> Column:
    """Equal to or below an included path, if any is given, and no excluded one."""
    clean = lambda x: re.sub(r"/+", "/", x.replace("\\", "/")).strip().strip("/").lower()
    p = F.lower("path")
    under = lambda fs: L.any_of([(p == clean(f)) | F.startswith(p, F.lit(clean(f) + "/")) for f in fs])
    return (under(include) if include else F.lit(True)) & ~under(exclude)


def tag_filter(o: Options) -> Column:
    case = bool(o.case_sensitive)
    tags = F.col("tags") if case else F.transform("tags", lambda t: F.lower(t))
    arr = lambda xs: F.array(*[F.lit(L.cased(x, case)) for x in xs])
    out = F.lit(True)
    if o.tags_all:
        out &= F.size(F.array_except(arr(o.tags_all), tags)) == 0
    if o.tags_any:
        out &= F.arrays_overlap(tags, arr(o.tags_any))
    if o.tags_not:
        out &= ~F.arrays_overlap(tags, arr(o.tags_not))
    return out


def time_filter(o: Options) -> Column:
    """Inclusive bounds; a note without the time fails an active bound."""
    out = F.lit(True)
    for col, low, high in (("created_ts", o.created_after, o.created_before), ("modified_ts", o.modified_after, o.modified_before)):
        if low is not None:
            out &= F.coalesce(F.col(col) >= low, F.lit(False))
        if high is not None:
            out &= F.coalesce(F.col(col) <= high, F.lit(False))
    return out


def sort_columns(o: Options) -> list[Column]:
    """The asked order, then score, path and stem; null times come last upwards and first downwards."""
    names = {"path": "path", "title": "title", "stem": "stem", "score": "score", "created": "created_ts", "modified": "modified_ts", "word_count": "word_count"}
    out = []
    for name, order in o.sort:
        c = F.xxhash64("stem", "path") if name == "random" else F.col(names[name])
        out.append(c.asc_nulls_last() if order == "asc" else c.desc_nulls_first())
    return [*out, F.desc("score"), F.asc("path"), F.asc("stem")]


def resolve_ids(notes: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(id): notes whose id, path or stem is a given name, any case."""
    low = [n.strip().lower() for n in names]
    return notes.filter(F.lower("id").isin(*low) | F.lower("path").isin(*low) | F.lower("stem").isin(*low)).select("id")


def ambiguous(aliases: DataFrame) -> DataFrame:
    """(alias, n, path): lower-case aliases (alias, id, path) that name several notes, with the first path."""
    own = aliases.groupBy(F.lower("alias").alias("alias")).agg(F.count_distinct("id").alias("n"), F.min("path").alias("path"))
    return own.filter("n > 1")


def graph_candidates(g: Graph, notes: DataFrame, o: Options) -> DataFrame:
    """`notes` narrowed by every link directive in turn; none is left if one asks for links and the edge types given
    leave semantic links out."""
    asked = [f for f in (o.link_to, o.linked_by) if f and f.seeds] or o.related or o.mentioned_by
    if asked and o.edge_types and "semantic" not in o.edge_types:
        return notes.limit(0)
    for f, kind in ((o.link_to, "to"), (o.linked_by, "from")):
        if f and f.seeds:
            hit = G.link_filter(g.edges, resolve_ids(g.notes, f.seeds), kind, f.recursive, f.max_distance or 2)
            notes = notes.join(hit, "id", "left_anti" if f.negate else "left_semi")
    if o.related:
        seeds = resolve_ids(g.notes, o.related).withColumn("weight", F.lit(1.0))
        hit = G.related(g.edges, seeds, o.related_distance or 2, None, o.ppr_alpha or 0.85, o.ppr_max_iter or 10, o.ppr_tol or 0.0)
        notes = notes.join(hit.select("id"), "id", "left_semi")
    if o.mentioned_by:
        notes = notes.join(G.link_filter(g.edges, resolve_ids(g.notes, o.mentioned_by), "from"), "id", "left_semi")
    if o.orphan is not None:
        lone = G.orphans(notes.select("id"), g.edges)
        notes = notes.join(lone, "id", "left_semi" if o.orphan else "left_anti")
    if o.missing_backlink is not None:
        notes = notes.join(G.missing_backlinks(g.edges), "id", "left_semi" if o.missing_backlink else "left_anti")
    return notes


def tree_distance(a: Column, b: Column) -> Column:
    """Steps between two heading paths over their last common heading; null if either is empty."""
    x, y = F.split(a, " / "), F.split(b, " / ")
    n = F.least(F.size(x), F.size(y))
    same = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: F.when((s == i - 1) & (F.element_at(x, i) == F.element_at(y, i)), i).otherwise(s))
    return F.when((a != "") & (b != ""), F.size(x) + F.size(y) - 2 * same)


def _cap(o: Options) -> int:
    return o.per_doc_section_cap or (3 if o.scope in ("section", "mixed") else 1)


def scored_sections(sections: DataFrame, query: str, o: Options) -> DataFrame:
    """Narrow section rows with a score above 0, after level and word rules."""
    words = o.min_section_words if o.min_section_words is not None else (24 if o.scope in ("section", "mixed") else 0)
    s = sections.filter((F.col("heading_level") <= (o.max_heading_level or 6)) & (F.col("words") >= words))
    return s.select("doc_id", "ord", "heading_title", "heading_path", L.section_score(query, bool(o.case_sensitive)).alias("section_score")).filter("section_score > 0")


def best_sections(sections: DataFrame, query: str, o: Options) -> DataFrame:
    """(doc_id, section_score, rest, best_section): a note's best section and the sum of its other capped ones.
    One section a note is a plain aggregate, combined before the shuffle; more need their places."""
    if _cap(o) == 1 and o.max_tree_hops is None:
        order = F.struct(-F.col("section_score"), "heading_path", "ord")
        return scored_sections(sections, query, o).groupBy("doc_id").agg(F.max("section_score").alias("section_score"), F.lit(0.0).alias("rest"), F.min_by("heading_title", order).alias("best_section"))
    top = ranked_sections(sections, query, o)
    return top.groupBy("doc_id").agg(F.max("section_score").alias("section_score"), (F.sum("section_score") - F.max("section_score")).alias("rest"), F.min_by("heading_title", "place").alias("best_section"))


def ranked_sections(sections: DataFrame, query: str, o: Options) -> DataFrame:
    """Sections with their score and place in the note, after level, word, tree and cap rules."""
    s, cap = scored_sections(sections, query, o), _cap(o)
    w = Window.partitionBy("doc_id").orderBy(F.desc("section_score"), "heading_path", "ord")
    if o.max_tree_hops is not None:
        best = F.first("heading_path").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        s = s.withColumn("_best", best).filter(F.coalesce(tree_distance(F.col("heading_path"), F.col("_best")) <= o.max_tree_hops, F.lit(False))).drop("_best")
    return s.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= cap)


NARROW = ("id", "stem", "path", "title", "word_count", "created_ts", "modified_ts")


def text_scores(notes: DataFrame, query: str, o: Options) -> DataFrame:
    """The notes' narrow columns with `own` and `by_path`: what needs their texts, so that no join carries one."""
    keep, case = [c for c in NARROW if c in notes.columns], bool(o.case_sensitive)
    if not query.strip():
        return notes.select(*keep, F.lit(1.0).alias("own"), F.lit(0.0).alias("by_path"))
    if o.strategy == "re":
        try:
            re.compile(query)
        except re.error:
            return notes.limit(0).select(*keep, F.lit(0.0).alias("own"), F.lit(0.0).alias("by_path"))
        own = L.regex_score(query, case)
    else:
        own = {"exact": L.exact_score, "path_fuzzy": L.path_score}.get(o.strategy, L.document_score)(query, case)
    by_path = L.path_score(query, case) if o.strategy == "fts" else F.lit(0.0)
    return L.folded(notes, case).select(*keep, own.alias("own"), by_path.alias("by_path"))


def score_notes(notes: DataFrame, best: DataFrame, query: str, o: Options) -> DataFrame:
    """`text_scores` rows with score and match_reason; best (doc_id, section_score, rest) are their sections."""
    if not query.strip():
        return notes.withColumns({"score": F.col("own"), "match_reason": F.lit("no_query")})
    met = notes.join(best, F.col("id") == F.col("doc_id"), "left").drop("doc_id")
    own, sec = F.col("own"), F.coalesce("section_score", F.lit(0.0))
    if o.strategy in ("exact", "re"):
        score = own
    elif o.strategy == "path_fuzzy":
        score = F.greatest(own, PATH_FUZZY[0] * own + PATH_FUZZY[1] * sec)
    else:
        score = F.greatest(own, FTS[0] * own + FTS[1] * sec + FTS[2] * F.col("by_path"))
    if (o.scope or "doc") == "mixed" and o.collapse_to_doc is not False:
        score = F.greatest(score, L.clamp(sec + SECTION_BETA * F.coalesce("rest", F.lit(0.0))))
    return met.withColumns({"score": L.clamp(score), "match_reason": F.lit(o.strategy)})


def search(g: Graph, line: str | Parsed, limit: int = 20, base: Options = Options(), boosts: DataFrame | None = None) -> DataFrame:
    """(stem, path, title, score, best_section, match_reason) of the best notes."""
    p = parse(line, base) if isinstance(line, str) else line
    o, limit = p.options, max(1, p.limit or limit)
    columns = ["stem", "path", "title", "score", "best_section", "match_reason"]
    if p.direct_id is not None:
        one = g.notes.join(resolve_ids(g.notes, (p.direct_id,)), "id", "left_semi").orderBy("path", "stem").limit(1)
        return one.withColumns({"score": F.lit(1.0), "best_section": F.lit(None).cast("string"), "match_reason": F.lit("direct_id")}).select(columns)
    notes = g.notes.filter(path_filter(o.include, o.exclude)).filter(tag_filter(o)).filter(time_filter(o))
    if o.tagless is not None:
        notes = notes.filter((F.size("tags") == 0) == F.lit(o.tagless))
    if o.mentions_of:
        case = bool(o.case_sensitive)
        text = F.col("search_text") if case else F.lower("search_text")
        notes = notes.filter(L.any_of([L.has(text, L.cased(m, case)) for m in o.mentions_of if m.strip()]))
    # Without structural links sections count for nothing, and a search for sections finds none.
    structural = not o.edge_types or "structural" in o.edge_types
    if o.scope == "section" and not structural:
        notes = notes.limit(0)
    notes = graph_candidates(g, text_scores(notes, p.query, o), o)
    best = best_sections(g.sections if structural else g.sections.limit(0), p.query, o)
    hit = score_notes(notes, best, p.query, o).filter("score > 0")
    if "best_section" not in hit.columns:
        hit = hit.withColumn("best_section", F.lit(None).cast("string"))
    if g.ranks is not None and p.query.strip() and o.strategy in ("fts", "path_fuzzy"):
        hit = hit.join(g.ranks, "id", "left").withColumn("score", F.col("score") + (1 - F.col("score")) * F.coalesce("rank", F.lit(0.0)) * RANK_BOOST)
    if boosts is not None:
        hit = hit.join(boosts, "id", "left").withColumn("score", F.col("score") + (1 - F.col("score")) * F.coalesce("boost", F.lit(0.0)))
    return hit.orderBy(*sort_columns(o)).limit(limit).select(columns)


def confidence(hits: int, top: float, min_hits: int = 2, min_top: float = 0.25) -> tuple[float, str]:
    """Graph confidence and its level."""
    c = 0.45 * min(1.0, hits / min_hits) + 0.35 * top + 0.2 * min(1.0, max(0.0, top / min_top))
    return c, "none" if c <= 0 or not hits else "low" if c < 0.35 else "medium" if c < 0.7 else "high"


def retrieval_mode(asked: str, hits: int, top: float, min_hits: int = 2, min_top: float = 0.25) -> str:
    """Hybrid becomes graph-only if the graph found enough, else vector-only."""
    if asked != "hybrid":
        return asked
    return "graph_only" if hits >= min_hits and top >= min_top else "vector_only"


def budget(base: int, mean_saliency: float) -> int:
    """`base` times one plus the mean normalised saliency, rounded up, within [base, 2 base]."""
    return min(2 * base, max(base, math.ceil(base * (1 + mean_saliency))))
