"""Similarities that built-in functions lack: transposition distance, byte vectors, fragments, audits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions.lexical import clamp


def alignment_distance(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours (optimal string alignment)."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        before, last = last, now
    return last[-1]


def swap_distance(a: Column, b: Column) -> Column:
    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if u is None or v is None else alignment_distance(u, v) for u, v in zip(x, y, strict=True)], dtype="Int32")

    return run(a, b)


def _held(value: Column, use) -> Column:
    """use(value) with the value computed once a row, though `use` names it inside of lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def byte_vector(text: Column, dims: int = 128) -> Column:
    """Unit vector of byte values, dealt over `dims` by position; zero for an empty text."""
    codes = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.ascii(F.substring(t, i, F.lit(1))).cast("double") / 255)
    some = lambda c, k: F.when(k < F.size(c), F.sequence(k, F.size(c) - 1, F.lit(dims)))
    sums = lambda c: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.coalesce(F.aggregate(some(c, k), F.lit(0.0), lambda s, i: s + F.get(c, i)), F.lit(0.0)))
    unit = lambda v: _held(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), lambda norm: F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v))
    # A byte is a letter of ISO-8859-1. An empty text has one byte 0.
    latin = F.when(F.octet_length(text) > 0, F.decode(text.cast("binary"), "ISO-8859-1")).when(text.isNotNull(), F.lit("\0"))
    return _held(latin, lambda t: _held(codes(t), lambda c: _held(sums(c), unit)))


def fragments(words: Column) -> Column:
    """Every run of neighbouring words, joined: what a fuzzy match may hit."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.greatest(n - i + 1, F.lit(1))), lambda k: F.array_join(F.slice(words, i, k), " ")))
    return F.when(n > 0, F.array_distinct(F.flatten(runs))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; two empty ones are alike."""
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(n, F.lit(1)))


def covered_share(anchors: Column, evidence: Column) -> Column:
    """Share of anchors that some piece of evidence contains; 1 without anchors."""
    hit = F.size(F.filter(anchors, lambda a: F.exists(evidence, lambda e: F.contains(F.lower(e), F.lower(a)))))
    return F.when(F.size(anchors) == 0, 1.0).otherwise(hit / F.greatest(F.size(anchors), F.lit(1)))


def passes_audit(share: Column, drift: Column) -> Column:
    return (share >= 0.70) & (drift < 0.05)


def pattern_similarity(keyword: Column, structure: Column, identifier: Column, metavar: Column) -> Column:
    return 0.35 * keyword + 0.25 * structure + 0.30 * identifier + 0.10 * metavar


def skeleton_rerank(score: Column, valid: Column) -> Column:
    """A hit whose address still exists gains .1, one whose address is gone loses .5, unknown ones stay."""
    return F.when(valid.isNull(), score).when(valid, F.least(F.lit(1.0), score + 0.1)).otherwise(F.greatest(F.lit(0.0), score - 0.5))


def boosted(score: Column, boost: Column) -> Column:
    return clamp(score + (1 - score) * F.coalesce(boost, F.lit(0.0)))
