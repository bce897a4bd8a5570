"""Lexical scores as column expressions: everything here stays inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def any_of(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def cased(text: str, case: bool) -> str:
    return text if case else text.lower()


def tokenize(text: str, case: bool = False) -> list[str]:
    """Query tokens: runs of letters, digits, '_' and '-' (ASCII), lower case unless case counts."""
    out, now = [], ""
    for ch in cased(text, case) + " ":
        if ch.isascii() and (ch.isalnum() or ch in "_-"):
            now += ch
        elif now:
            out.append(now)
            now = ""
    return out


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^A-Za-z0-9_-]+"), lambda t: t != "")


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def has(text: Column, part: str) -> Column:
    return F.contains(text, F.lit(part)) if part else F.lit(False)


def occurrences(text: Column, part: str) -> Column:
    """Non-overlapping occurrences."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int") if part else F.lit(0)


def coverage(text: Column, query: list[str]) -> Column:
    """Share of the query's tokens that occur as substrings."""
    if not query:
        return F.lit(0.0)
    return sum((F.when(has(text, t), 1).otherwise(0) for t in query), F.lit(0)) / F.lit(float(len(query)))


#: Columns that `folded` adds, each computed once a row however many scores read it.
FOLDED = ("id", "stem", "path", "title", "search_text")


def folded(notes: DataFrame, case: bool = False) -> DataFrame:
    """`notes` with lower-case copies of what the scores read (plain ones if case counts), and the two texts that
    tokens are looked up in."""
    low = F.col if case else F.lower
    notes = notes.withColumns({f"low_{c}": low(c) for c in FOLDED} | {"low_tags": F.col("tags") if case else F.transform("tags", lambda x: F.lower(x))})
    whole = F.concat_ws(" ", "low_id", "low_stem", "low_path", "low_title", F.array_join("low_tags", " "), "low_search_text")
    return notes.withColumns({"low_blob": whole, "low_names": F.concat_ws(" ", "low_path", "low_id", "low_stem", "low_title")})


def document_score(query: str, case: bool = False) -> Column:
    """Full-text score of a note with `folded` columns."""
    q, words = cased(query.strip(), case), tokenize(query, case)
    if not q:
        return F.lit(0.0)
    i, s, p, t, text = (F.col(f"low_{c}") for c in FOLDED)
    tags = F.col("low_tags")
    score = F.greatest(
        F.when((i == q) | (s == q), 1.0).otherwise(0.0),
        F.when(t == q, 0.95).otherwise(0.0),
        F.when(F.array_contains(tags, q), 0.85).otherwise(0.0),
        F.when(has(i, q) | has(s, q) | has(p, q) | has(t, q) | F.exists(tags, lambda x: F.contains(x, F.lit(q))) | has(text, q), 0.7).otherwise(0.0),
    )
    if len(words) >= 2:
        occ = occurrences(text, q)
        hits = 2 * (has(i, q) | has(s, q) | has(p, q)).cast("int") + 3 * has(t, q).cast("int") + 2 * F.exists(tags, lambda x: F.contains(x, F.lit(q))).cast("int") + F.least(occ, F.lit(6))
        density = clamp(occ * len(words) / F.greatest(F.col("word_count"), F.lit(1)), 0.0, 0.08)
        score = F.greatest(score, F.when(hits > 0, F.least(F.lit(0.97), 0.70 + F.least(hits, F.lit(8)) * 0.03 + density)).otherwise(0.0))
    r = coverage(F.col("low_blob"), words)
    covered = (0.33 + 0.42 * r) if len(words) >= 2 else (0.45 + 0.45 * r)
    return clamp(F.greatest(score, F.when(r > 0, covered).otherwise(0.0)))


def exact_score(query: str, case: bool = False) -> Column:
    q = cased(query.strip(), case)
    i, s, p, t, text = (F.col(f"low_{c}") for c in FOLDED)
    tags = F.col("low_tags")
    return F.when((i == q) | (s == q), 1.0).when(t == q, 0.95).when(F.array_contains(tags, q), 0.85).when(has(p, q), 0.8).when(has(text, q), 0.75).otherwise(0.0)


def regex_score(pattern: str, case: bool = False) -> Column:
    """The path counts before the tags, as the scorer's order has it."""
    m = lambda c: F.rlike(c, F.lit(pattern if case else f"(?i){pattern}"))
    return F.when(m(F.col("id")) | m(F.col("stem")), 1.0).when(m(F.col("title")), 0.95).when(m(F.col("path")), 0.8).when(F.exists("tags", m), 0.85).when(m(F.col("search_text")), 0.75).otherwise(0.0)


def path_score(query: str, case: bool = False) -> Column:
    q, words = cased(query.strip(), case), tokenize(query, case)
    if not q:
        return F.lit(0.0)
    i, s, p, t = (F.col(f"low_{c}") for c in FOLDED[:4])
    r = coverage(F.col("low_names"), words)
    return clamp(F.greatest(
        F.when((p == q) | (i == q) | (s == q), 1.0).when(t == q, 0.95).otherwise(0.0),
        F.when(has(p, q) | has(i, q) | has(s, q) | has(t, q), 0.82).otherwise(0.0),
        F.when(r > 0, 0.50 + 0.45 * r).otherwise(0.0),
    ))


def section_score(query: str, case: bool = False) -> Column:
    """Score of a section from heading_title, heading_level, section_text."""
    q, words = cased(query.strip(), case), tokenize(query, case)
    if not q:
        return F.lit(1.0)
    h, body = (F.col(c) if case else F.lower(c) for c in ("heading_title", "section_text"))
    base = F.when(h == q, 1.0).when(has(h, q), 0.92).when(has(body, q), 0.72).otherwise(0.0)
    by_token = 0.75 * coverage(h, words) + 0.40 * coverage(body, words)
    score = F.greatest(base, by_token)
    return clamp(F.when(score > 0, score + (6 - F.least(F.col("heading_level"), F.lit(6))) * 0.01).otherwise(0.0))


def knowledge_tier(query: str) -> Column:
    """ASCII-folded tiers of a section row: title exact, then title, section, stem, text containment."""
    from linkloom.sources.tables import fold_ascii

    q = "".join(ch.lower() if ch.isascii() else ch for ch in query.strip())
    f = lambda c: fold_ascii(F.coalesce(F.col(c), F.lit("")))
    return F.when(F.col("title") == query, 1.0).when(has(f("title"), q), 0.95).when(has(f("best_section"), q), 0.9).when(has(f("stem"), q), 0.88).when(has(f("search_text"), q), 0.82).otherwise(0.0)


def symbol_tier(query: str) -> Column:
    from linkloom.sources.tables import fold_ascii

    q = query.strip().lower()
    n = F.col("name_folded")
    return F.when(n == q, 1.0).when(F.startswith(n, F.lit(q)), 0.97).when(has(n, q), 0.93).when(has(fold_ascii(F.col("signature")), q), 0.86).when(has(fold_ascii(F.coalesce("owner_title", F.lit(""))), q), 0.81).otherwise(0.0)


def reference_score(query: str) -> Column:
    from linkloom.sources.tables import fold_ascii

    return F.when(has(F.col("line_text"), query), 0.9).when(has(fold_ascii(F.col("line_text")), query.lower()), 0.82).otherwise(0.7)


def content_score(query: str) -> Column:
    return F.when(has(F.col("line_text"), query), 0.73).when(has(F.col("line_text_folded"), query.lower()), 0.72).otherwise(0.0)


def attachment_score(query: str) -> Column:
    """Half the name, three tenths the path, two tenths the share of tokens."""
    q, words = query.strip().lower(), tokenize(query)
    if not q:
        return F.lit(1.0)
    name, path = F.lower("attachment_name"), F.lower("attachment_path")
    return 0.5 * (name == q).cast("double") + 0.3 * has(path, q).cast("double") + 0.2 * coverage(F.concat_ws(" ", path, name, F.lower("source_path")), words)


def bucket_score(bucket: Column, worst: int) -> Column:
    """Lower buckets are better: 0 gives 1.0, the worst gives 1 / (worst + 1)."""
    return (worst + 1 - bucket) / F.lit(float(worst + 1))


def symbol_bucket(query: str) -> Column:
    """0 exact name .. 7 signature part; null where nothing matches."""
    q = query.strip().lower()
    n, path, sig, own = F.lower("name"), F.lower("path"), F.lower("signature"), F.lower("owner_title")
    return F.when(n == q, 0).when(own == q, 1).when(F.startswith(n, F.lit(q)), 2).when(F.startswith(own, F.lit(q)), 3).when(has(n, q), 4).when(has(own, q), 5).when(has(path, q), 6).when(has(sig, q), 7)


def identifier_words(name: Column) -> Column:
    """Words of an identifier: lower to upper, ACRONYM to Word, letter to digit and back."""
    x = F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", " ")
    return F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda t: t != "")


def fuzzy_score(a: Column, b: Column, most: int, prefix: int = 0) -> Column:
    """1 - distance / longer length; null beyond `most` edits or with a shorter common prefix."""
    d = F.levenshtein(a, b, most)
    n = F.greatest(F.length(a), F.length(b))
    ok = (d >= 0) & (n > 0)
    if prefix:
        ok = ok & (F.substring(a, 1, prefix) == F.substring(b, 1, prefix))
    return F.when(ok, 1 - d / n)


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def saliency(base: Column, decay: Column, days: Column, count: Column, alpha: float = 0.5, low: float = 1.0, high: float = 10.0) -> Column:
    """base * e^(-decay * days) + alpha * ln(1 + count), within [low, high]."""
    return clamp(base * F.exp(-decay * F.greatest(days, F.lit(0.0))) + alpha * F.log1p(F.greatest(count, F.lit(0)).cast("double")), low, high)


def snippet(text: Column, most: int = 140) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)
