"""Ranked retrieval over the six corpora: narrow scan, score, best row a key, total order, limit, payload.

Filters on language, kind, extension and folded name are plain predicates, so they reach the scan; only
the top rows meet the payload columns again (late materialisation), by a join on the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import lexical as L

#: Rank of entity kinds, and the worst match bucket of each.
ENTITY_PRIORITY = {"symbol": 3, "module": 2, "example": 1, "import": 1}
WORST_BUCKET = {"module": 3, "symbol": 7, "example": 10, "import": 4}


def column_mask(rows: DataFrame, *, ids: list[str] | None = None, repo: str | None = None, path: str | None = None, least: float | None = None, limit: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """Rows that pass every given predicate, then the first `limit` by `order`; a null score is 0."""
    if ids is not None:
        rows = rows.filter(F.col("id").isin(*ids))
    if repo is not None:
        rows = rows.filter(F.col("repo") == repo)
    if path is not None:
        rows = rows.filter(F.contains("path", F.lit(path)))
    if least is not None:
        rows = rows.filter(F.coalesce("score", F.lit(0.0)) >= least)
    if order:
        rows = rows.orderBy(*order)
    return rows.limit(limit) if limit is not None else rows


def payload_fetch(rows: DataFrame, columns: list[str], ids: DataFrame | None = None) -> DataFrame:
    """The named columns, of all rows or of those in `ids` (id)."""
    if ids is not None:
        rows = rows.join(ids.select("id").distinct(), "id", "left_semi")
    return rows.select(*columns)


def top(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    return rows.orderBy(*order).limit(max(1, limit))


def best_per(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def hydrate(found: DataFrame, stored: DataFrame, columns: list[str]) -> DataFrame:
    """`found` with payload columns from the stored table; an id without a payload is an error."""
    met = found.join(stored.select("id", *columns), "id", "left")
    first = columns[0]
    return met.withColumn(first, F.when(F.col(first).isNotNull(), F.col(first)).otherwise(F.raise_error(F.concat(F.lit("no payload for "), "id"))))


def knowledge_rows(notes: DataFrame, sections: DataFrame) -> DataFrame:
    """id, path, stem, title, best_section, search_text: a `_doc` row a note and a row a section."""
    whole = notes.select(F.concat("path", F.lit(":_doc")).alias("id"), "path", "stem", "title", F.lit(None).cast("string").alias("best_section"), F.concat_ws(" ", "title", "stem", "doc_type", F.array_join("tags", " "), "search_text").alias("search_text"))
    part = sections.join(notes.select(F.col("id").alias("doc_id"), "path", "stem", "title"), "doc_id")
    part = part.select(F.concat_ws(":", "path", "ord").alias("id"), "path", "stem", "title", F.col("heading_title").alias("best_section"), F.col("section_text").alias("search_text"))
    return whole.unionByName(part)


def search_knowledge(rows: DataFrame, query: str, limit: int) -> DataFrame:
    """(id, path, stem, title, best_section, score): the best row a path."""
    if not query.strip():
        return rows.limit(0).select("id", "path", "stem", "title", "best_section", F.lit(0.0).alias("score"))
    hit = rows.select("id", "path", "stem", "title", "best_section", L.knowledge_tier(query).alias("score")).filter("score > 0")
    return top(best_per(hit, "path", [F.desc("score"), F.asc("id")]), [F.desc("score"), F.asc("path"), F.asc("stem")], limit)


def search_symbols(rows: DataFrame, query: str, limit: int, languages: list[str] | None = None, kinds: list[str] | None = None) -> DataFrame:
    if languages:
        rows = rows.filter(F.col("language").isin(*languages))
    if kinds:
        rows = rows.filter(F.col("kind").isin(*kinds))
    hit = rows.select("id", "name", "path", "line_start", L.symbol_tier(query).alias("score")).filter("score > 0")
    return top(hit, [F.desc("score"), F.asc("name"), F.asc("path"), F.asc("line_start"), F.asc("id")], limit)


def autocomplete(rows: DataFrame, prefix: str, limit: int) -> DataFrame:
    """(suggestion, kind): names that begin with the prefix, or hold a word that does; one a folded name."""
    p = prefix.strip().lower()
    hit = rows.filter(F.startswith("name_folded", F.lit(p)) | F.exists(L.identifier_words(F.col("name")), lambda w: F.startswith(w, F.lit(p))))
    one = best_per(hit.select("name_folded", F.col("name").alias("suggestion"), "kind", "id"), "name_folded", [F.asc("kind"), F.asc("suggestion"), F.asc("id")])
    return top(one.select("suggestion", "kind"), [F.asc("kind"), F.asc("suggestion")], limit)


def search_references(rows: DataFrame, name: str, limit: int) -> DataFrame:
    """rows (name_folded, path, line, column, line_text); equality on the folded name reaches the scan."""
    hit = rows.filter(F.col("name_folded") == name.lower()).select("name_folded", "path", "line", "column", L.reference_score(name).alias("score"))
    return top(hit, [F.desc("score"), F.asc("path"), F.asc("line"), F.asc("column")], limit)


def reference_occurrences(chunks: DataFrame, definitions: DataFrame | None = None) -> DataFrame:
    """(name, name_folded, path, line, column, line_text): identifiers, the first of a folded name a line,
    without the lines that define them (name, path, line)."""
    from linkloom.sources.tables import fold_ascii

    rows = chunks.select("path", F.col("line_number").alias("line"), "line_text", F.posexplode(F.regexp_extract_all("line_text", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))).alias("nth", "name"))
    rows = rows.withColumn("name_folded", fold_ascii(F.col("name")))
    first = rows.groupBy("path", "line", "name_folded").agg(F.min_by("name", "nth").alias("name"), F.first("line_text").alias("line_text"))
    first = first.withColumn("column", F.instr("line_text", F.col("name")).cast("long"))
    return first.join(definitions, ["name", "path", "line"], "left_anti") if definitions is not None else first


def search_content(chunks: DataFrame, query: str, limit: int, languages: list[str] | None = None) -> DataFrame:
    """(path, line_number, score, snippet): the best line a path, exact case first."""
    if languages:
        chunks = chunks.filter(F.col("language").isin(*languages))
    hit = chunks.select("path", "line_number", "line_text", L.content_score(query).alias("score")).filter("score > 0")
    best = best_per(hit, "path", [F.desc("score"), F.asc("line_number")])
    best = best.select("path", "line_number", "score", L.snippet(F.concat(F.col("line_number").cast("string"), F.lit(": "), "line_text")).alias("snippet"))
    return top(best, [F.desc("score"), F.asc("path"), F.asc("line_number")], limit)


def search_attachments(rows: DataFrame, query: str, limit: int, exts: list[str] | None = None, kinds: list[str] | None = None) -> DataFrame:
    if not query.strip():
        return rows.limit(0).select("attachment_path", "source_path", F.lit(0.0).alias("score"))
    if exts:
        rows = rows.filter(F.col("attachment_ext").isin(*exts))
    if kinds:
        rows = rows.filter(F.col("kind").isin(*kinds))
    hit = rows.select("attachment_path", "source_path", L.attachment_score(query).alias("score")).filter("score > 0")
    return top(hit, [F.desc("score"), F.asc("attachment_path"), F.asc("source_path")], limit)


def entity_rows(symbols: DataFrame, saliency: DataFrame | None = None) -> DataFrame:
    """(id, entity_kind, name, path, language, saliency_score, ...): a symbol row each, a module row an owner."""
    s = symbols.select("id", F.lit("symbol").alias("entity_kind"), "name", "path", "language", "signature", "owner_title")
    m = symbols.groupBy("owner_title").agg(F.min("path").alias("path"), F.min("language").alias("language"))
    m = m.select(F.concat(F.lit("mod:"), "owner_title").alias("id"), F.lit("module").alias("entity_kind"), F.col("owner_title").alias("name"), "path", "language", F.lit("").alias("signature"), "owner_title")
    rows = s.unionByName(m)
    if saliency is None:
        return rows.withColumn("saliency_score", F.lit(0.0))
    return rows.join(saliency, "id", "left").withColumn("saliency_score", F.coalesce("saliency_score", F.lit(0.0)))


def search_entities(rows: DataFrame, query: str, limit: int, languages: list[str] | None = None, kinds: list[str] | None = None) -> DataFrame:
    """(id, entity_kind, name, path, score): the better of bucket score and saliency, by kind priority."""
    if languages:
        rows = rows.filter(F.col("language").isin(*languages))
    if kinds:
        rows = rows.filter(F.col("entity_kind").isin(*kinds))
    bucket, worst = L.symbol_bucket(query), WORST_BUCKET["symbol"]
    priority = F.lit(0)
    for kind, n in ENTITY_PRIORITY.items():
        priority = F.when(F.col("entity_kind") == kind, n).otherwise(priority)
    hit = rows.withColumn("bucket", bucket).filter("bucket is not null")
    hit = hit.select("id", "entity_kind", "name", "path", L.clamp(F.greatest(L.bucket_score(F.col("bucket"), worst), "saliency_score")).alias("score"), priority.alias("_p"))
    return top(hit, [F.desc("score"), F.desc("_p"), F.asc("path"), F.asc("name"), F.asc("id")], limit).drop("_p")


def intent_merge(knowledge: DataFrame, symbols: DataFrame, content: DataFrame, limit: int, code_biased: bool) -> DataFrame:
    """(source, id, path, score) of three rankings (id, path, score): code bias lifts symbols by .02
    (at most 1) and content by .04 (at most .9); order by score, then symbols, knowledge, content."""
    up = lambda by, most: F.least(F.col("score") + by, F.greatest(F.col("score"), F.lit(most))) if code_biased else F.col("score")
    k = knowledge.select(F.lit("knowledge").alias("source"), "id", "path", "score", F.lit(1).alias("_p"))
    s = symbols.select(F.lit("symbol").alias("source"), "id", "path", up(0.02, 1.0).alias("score"), F.lit(0).alias("_p"))
    c = content.select(F.lit("content").alias("source"), "id", "path", up(0.04, 0.9).alias("score"), F.lit(2).alias("_p"))
    return top(k.unionByName(s).unionByName(c), [F.desc("score"), F.asc("_p"), F.asc("path"), F.asc("id")], limit).drop("_p")


def first_tier(tiers: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first tier that has any, the tier as a column; decided inside one plan."""
    every = tiers[0].withColumn("tier", F.lit(0))
    for n, t in enumerate(tiers[1:], 1):
        every = every.unionByName(t.withColumn("tier", F.lit(n)))
    first = every.agg(F.min("tier").alias("tier"))
    return every.join(F.broadcast(first), "tier")  # one row


def waterfall(tiers: list[DataFrame], key: str, limit: int, order: list[Column]) -> DataFrame:
    """Rows of all tiers, one a key (the earliest tier's), earlier tiers first, up to `limit`."""
    every = tiers[0].withColumn("tier", F.lit(0))
    for n, t in enumerate(tiers[1:], 1):
        every = every.unionByName(t.withColumn("tier", F.lit(n)))
    return top(best_per(every, key, [F.asc("tier"), *order]), [F.asc("tier"), *order], limit)


def per_repo(rows: DataFrame, repo: str, order: list[Column], per: int, limit: int) -> DataFrame:
    """At most `per` rows a repository, then the best `limit` of all."""
    w = Window.partitionBy(repo).orderBy(*order)
    return top(rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per).drop("_n"), order, limit)


def resolve_definition(symbols: DataFrame, name: str, source_dir: str | None = None, scope: str | None = None) -> DataFrame:
    """The best definition: exact 1.0, ASCII-insensitive .98, contains .8, one edit: its fuzzy score; only
    the best tier's rows count; .15 more beside `source_dir`."""
    if scope:
        symbols = symbols.filter(F.rlike("path", F.lit(glob_pattern(scope))))
    q = name.lower()
    fuzzy = L.fuzzy_score(F.col("name_folded"), F.lit(q), 1, 1)
    tier = F.when(F.col("name") == name, 0).when(F.col("name_folded") == q, 1).when(L.has(F.col("name_folded"), q), 2).when(fuzzy.isNotNull(), 3)
    base = F.when(tier == 0, 1.0).when(tier == 1, 0.98).when(tier == 2, 0.8).otherwise(fuzzy)
    near = F.when(F.regexp_extract("path", "^(.*)/", 1) == source_dir, 0.15).otherwise(0.0) if source_dir else F.lit(0.0)
    hit = symbols.select("id", "name", "path", "line_start", tier.alias("tier"), (base + near).alias("score")).filter("tier is not null")
    best = hit.agg(F.min("tier").alias("tier"))
    return top(hit.join(F.broadcast(best), "tier"), [F.desc("score"), F.asc("path"), F.asc("line_start"), F.asc("id")], 1)  # best is one row


def glob_pattern(glob: str) -> str:
    """An anchored regular expression for a path glob with '*', '**' and '?'."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + (glob[i] if glob[i].isalnum() or glob[i] in "/_-" else "\\" + glob[i]), i + 1
    return f"^{out}$"


def fuzzy_search(rows: DataFrame, query: str, limit: int, most: int = 2, prefix: int = 0) -> DataFrame:
    """(id, name, score, distance) within `most` edits of the folded name."""
    q = query.lower()
    hit = rows.select("id", "name", L.fuzzy_score(F.col("name_folded"), F.lit(q), most, prefix).alias("score"), F.levenshtein(F.col("name_folded"), F.lit(q), most).alias("distance"))
    return top(hit.filter("score is not null"), [F.desc("score"), F.asc("distance"), F.length("name").asc(), F.asc("name"), F.asc("id")], limit)


def inverted_index(rows: DataFrame, fields: dict[str, float]) -> DataFrame:
    """(token, field, boost, id, tf, positions) over identifier words of the given fields."""
    out = None
    for f, boost in fields.items():
        t = rows.select("id", F.posexplode(L.identifier_words(F.col(f))).alias("pos", "token")).groupBy("token", "id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
        t = t.select("token", F.lit(f).alias("field"), F.lit(boost).alias("boost"), "id", "tf", "positions")
        out = t if out is None else out.unionByName(t)
    return out


def bm25(index: DataFrame, query: str, documents: int, lengths: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score): BM25 over an inverted index, boosted by field; lengths (field, id, n)."""
    words = L.tokenize(query)
    hit = index.filter(F.col("token").isin(*words))
    df = hit.groupBy("token", "field").agg(F.count_distinct("id").alias("df"))
    mean = lengths.groupBy("field").agg(F.avg("n").alias("mean"))
    met = hit.join(df, ["token", "field"]).join(lengths, ["field", "id"]).join(mean, "field")
    idf = F.log(1 + (documents - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return met.groupBy("id").agg(F.sum(F.col("boost") * idf * tf).alias("score"))


def phrase_prefix(rows: DataFrame, field: str, query: str) -> DataFrame:
    """(id): rows where the query's words follow each other, the last as a prefix; needs two words."""
    words = L.tokenize(query)
    if len(words) < 2:
        return rows.limit(0).select("id")
    t, n = L.identifier_words(F.col(field)), len(words)
    at = lambda i: (F.slice(t, i, n - 1) == F.array(*[F.lit(w) for w in words[:-1]])) & F.startswith(F.get(t, i + n - 2), F.lit(words[-1]))
    ok = F.exists(F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1))), lambda i: F.coalesce(at(i), F.lit(False)))
    return rows.filter(F.size(t) >= n).filter(ok).select("id")
