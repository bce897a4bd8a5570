"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND, verification.

1. Test items become an inverted index. An impact is an item's BM25 weight of a term, divided by the
   item's score against itself: a passage that repeats the whole item scores 1, whatever its length.
   Postings are in item order; blocks of items have the largest impact of each term in them.
2. Documents are cut into passages with half overlap, of a length that depends on the item alone: twice its words,
   rounded up to a power of two times `LEAST_PASSAGE`; so every copy of an item lies whole in one. A
   document's terms bound what any of its passages can score, so block-max WAND runs once a document: cursors over
   the terms' postings, a pivot where the largest impacts reach the threshold, and cursors that skip to the next block
   whose maxima reach it, if the pivot's don't. Items it returns are then scored passage by passage: none at the threshold is missed.
3. A retrieved passage counts if it also holds enough of the item's word triples, in its question and in
   its answer. Without an answer column the last `ANSWER` of an item's words stand for the answer.

The index travels to all tasks in shards of at most `shard_words` words, or of one item that is longer than half of
that; a larger benchmark takes more passes over the documents, not more memory, and gives the same rows. Document
frequencies are over the whole benchmark. Documents are never shuffled, so a passage that a third of them
share costs what any other costs.

Defined results: null and empty texts match nothing; items without words or without an id match nothing; repeated
items and documents each give their rows; empty tables give no rows; other columns are ignored. Words are runs
between ASCII white space and punctuation, lower case.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.shared import shared_table

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP = 0.6, 0.5
LEAST_PASSAGE, ANSWER, GRAM = 128, 1 / 3, 3
BUCKETS = 1_024
SHARD_WORDS = 2_000_000
_PLAIN = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_PLAIN).split() if text else []


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """begin[0], ..., end[0] - 1, begin[1], ..."""
    n = end - begin
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())


def block_items(items: int) -> int:
    """Items of a block: a hundredth of all, so that skipping a block is worth a look at its bound."""
    return min(64, max(2, items // 100))


def passage_words(item_words: int) -> int:
    """Length of the passages that an item of so many words is held against."""
    return LEAST_PASSAGE << max(0, -(-2 * item_words // LEAST_PASSAGE) - 1).bit_length()


@dataclass
class Index:
    """One shard. A posting's key is its term's number times the number of items, plus its item; an entry is a term's
    postings in one block of items, its key the term's number times the number of blocks, plus the block."""

    items: np.ndarray
    number: dict[bytes, int]
    term_at: np.ndarray
    term_most: np.ndarray
    posting: np.ndarray
    impact: np.ndarray
    entry_at: np.ndarray
    entry: np.ndarray
    entry_most: np.ndarray
    words: list[np.ndarray]
    question_size: np.ndarray
    terms: list[np.ndarray]
    weights: list[np.ndarray]

    @staticmethod
    def build(items: list[tuple[int, list[bytes], int]], df: dict[bytes, int], total: int, mean: float) -> Index:
        """items: (item_id, words, words of the question)."""
        number: dict[bytes, int] = {}
        ids = [np.array([number.setdefault(w, len(number)) for w in words], np.int64) for _, words, _ in items]
        idf = np.array([np.log(1 + (total - df[w] + 0.5) / (df[w] + 0.5)) for w in number])
        terms, weights = [], []
        for own in ids:
            t, tf = np.unique(own, return_counts=True)
            weight = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(own) / mean))
            terms.append(t)
            weights.append(weight / max(1e-12, weight.sum()))
        n, block = len(items), block_items(len(items))
        blocks = n // block + 1
        posting = np.concatenate([t * n + i for i, t in enumerate(terms)]) if n else np.empty(0, np.int64)
        by = np.argsort(posting)
        posting, impact = posting[by], (np.concatenate(weights) if n else np.empty(0))[by]
        term = posting // max(1, n)
        code = term * blocks + posting % max(1, n) // block
        begin = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if n else np.empty(0, np.int64)
        term_at = np.searchsorted(term, np.arange(len(number) + 1))
        most = lambda at: np.maximum.reduceat(impact, at) if n else np.empty(0)
        return Index(np.array([i for i, _, _ in items], np.int64), number, term_at, most(term_at[:-1]), posting, impact, np.searchsorted(code[begin] // blocks, np.arange(len(number) + 1)), code[begin], most(begin), ids, np.array([q for _, _, q in items], np.int64), terms, weights)

    def candidates(self, terms: np.ndarray, threshold: float) -> list[int]:
        """Items whose impacts over `terms` (distinct) sum to the threshold, by block-max WAND."""
        n, block, found = len(self.items), block_items(len(self.items)), []
        blocks = n // block + 1
        most = self.term_most[terms]
        if most.sum() < threshold:
            return found
        # Blocks whose largest impacts, over all terms, reach the threshold: cursors stop in no other.
        entry = _ranges(self.entry_at[terms], self.entry_at[terms + 1])
        bound = np.bincount(self.entry[entry] % blocks, self.entry_most[entry], minlength=blocks)
        live = np.append(np.flatnonzero(bound >= threshold), blocks)
        if len(live) == 1:
            return found
        base, end = terms * n, self.term_at[terms + 1]
        last = np.append(self.posting, 0)
        nth, to = 0, int(live[0]) * block
        at = np.searchsorted(self.posting, base + to)
        item = np.where(at < end, last[at] - base, n)
        while True:
            order = np.argsort(item, kind="stable")
            line = item[order]
            p = int(np.searchsorted(np.cumsum(most[order]), threshold))
            if p == len(order) or line[p] >= n:
                return found
            pivot = int(line[p])
            while live[nth] < pivot // block:
                nth += 1
            if live[nth] > pivot // block:
                if live[nth] == blocks:
                    return found
                to = int(live[nth]) * block
            elif line[0] == pivot:
                sub = order[: int(np.searchsorted(line, pivot, "right"))]
                if self.impact[at[sub]].sum() >= threshold:
                    found.append(pivot)
                to = pivot + 1
            else:
                to = pivot
            sub = np.flatnonzero(item < to)
            at[sub] = np.searchsorted(self.posting, base[sub] + min(to, n))
            item[sub] = np.where(at[sub] < end[sub], last[at[sub]] - base[sub], n)

    def matches(self, text: str | None, threshold: float, overlap: float) -> list[tuple[int, float, float, float, int]]:
        """(item_id, score, question overlap, answer overlap, first word of the passage), the best passage an item."""
        words = words_of(text)
        if not words or not len(self.items):
            return []
        ids = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        terms = np.unique(ids)
        out = []
        for i in self.candidates(terms[terms >= 0], threshold - 1e-9):
            own = self.words[i]
            half = passage_words(len(own)) // 2
            where = np.flatnonzero(np.isin(ids, own))
            pair = np.unique(np.concatenate([w * len(self.number) + ids[where] for w in (where // half, where // half - 1)]))
            window, term = pair // len(self.number), pair % len(self.number)
            score = np.bincount(np.maximum(window, 0), np.where(window >= 0, self.weights[i][np.searchsorted(self.terms[i], term)], 0))
            best = None
            for w in np.flatnonzero(score >= threshold - 1e-9):
                passage = ids[w * half : (w + 2) * half]
                cut = self.question_size[i]
                q, a = _held(own[:cut], passage), _held(own[cut:], passage)
                if min(q, a) >= overlap and (best is None or (q + a, score[w]) > (best[2] + best[3], best[1])):
                    best = (int(self.items[i]), float(score[w]), q, a, int(w * half))
            if best:
                out.append(best)
        return out


def _held(part: np.ndarray, passage: np.ndarray) -> float:
    """Share of a part's word runs (triples, or the whole of a shorter part) that the passage holds."""
    n = min(GRAM, len(part))
    if not n:
        return 1.0
    if len(passage) < n:
        return 0.0
    grams = lambda x: {tuple(r) for r in np.lib.stride_tricks.sliding_window_view(x, n).tolist()}
    wanted = grams(part)
    return len(wanted & grams(passage)) / len(wanted)


def build_indexes(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", answer_col: str | None = None, shard_words: int = SHARD_WORDS) -> list[Index]:
    """The benchmark as indexes of at most `shard_words` words each, or of one longer item."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for q, a in zip(b.column(1), b.column(2), strict=True):
                question, answer = words_of(q.as_py()), words_of(a.as_py())
                cut = len(question) if answer_col else len(question) - int(len(question) * ANSWER)
                rows.append((question + answer, cut))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.list_(pa.binary())), pa.array([r[1] for r in rows], pa.int32())], ["item_id", "words", "cut"])

    given = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("q"), (F.col(answer_col) if answer_col else F.lit(None).cast("string")).alias("a"))
    rows = shared_table(given.mapInArrow(tokens, "item_id long, words array<binary>, cut int").filter(F.size("words") > 0), "items")
    total, words = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    df = shared_table(rows.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count("*").alias("df")), "item-terms")
    out = []
    for low, high, placed in shards_of(rows.filter("item_id is not null"), shard_words):
        own = placed.filter(F.col("piece").between(low, high))
        terms = own.select(F.explode("words").alias("w")).distinct()
        freq = {bytes(r[0]): r[1] for r in terms.join(df, "w").collect()}  # a shard's words
        got = [(r[0], [bytes(w) for w in r[1]], r[2]) for r in own.orderBy("item_id", F.xxhash64("words")).select("item_id", "words", "cut").collect()]
        out.append(Index.build(got, freq, total, words / total))
    return out


def shards_of(rows: DataFrame, shard_words: int) -> Iterator[tuple[int, int, DataFrame]]:
    """Ranges of pieces that hold at most `shard_words` words, or one item of more than half of that; and the rows
    with their pieces. A piece is a run of one bucket's items of at most `shard_words` words, or one such item."""
    half = max(1, shard_words // 2)
    n = F.size("words")
    bucket = F.pmod(F.xxhash64("item_id", "words"), F.lit(BUCKETS))
    line = Window.partitionBy("bucket", "lone").orderBy("item_id", F.xxhash64("words")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumns({"bucket": bucket, "lone": (n > half).cast("int")})
    nth = F.when(F.col("lone") == 1, F.count("*").over(line)).otherwise(F.call_function("div", F.sum(n).over(line) - 1, F.lit(half)))
    placed = shared_table(placed.withColumn("piece", ((F.col("bucket") * 2 + F.col("lone")) * F.lit(1 << 40) + nth).cast("long")).drop("bucket", "lone"), "item-pieces")
    low, high, held = None, None, 0
    for piece, size in placed.groupBy("piece").agg(F.sum(n)).orderBy("piece").collect():  # at most two a bucket and two a shard
        if low is not None and held + size > shard_words:
            yield low, high, placed
            low, held = None, 0
        low, high, held = piece if low is None else low, piece, held + size
    if low is not None:
        yield low, high, placed


def _clean(shared: Broadcast, threshold: float, overlap: float):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not shared.value.matches(t, threshold, overlap) for t in texts], dtype=bool)

    return clean


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    answer_col: str | None = None,
    threshold: float = THRESHOLD,
    overlap: float = OVERLAP,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap and word_at: a row for each item that a document holds."""
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, word_at long"
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = docs.sparkSession.createDataFrame([], schema)
    for index in build_indexes(items, id_col=item_id_col, text_col=item_text_col, answer_col=answer_col, shard_words=shard_words):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for m in shared.value.matches(t.as_py(), threshold, overlap)]
                cols = list(zip(*rows, strict=True)) or [()] * 6
                types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "word_at"])

        found = found.union(given.mapInArrow(run, schema))
    return found


def without_contaminated(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None, threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The rows of `docs`, same columns, that hold no item; filtered in place, without a shuffle."""
    for index in build_indexes(items, id_col=item_id_col, text_col=item_text_col, answer_col=answer_col, shard_words=shard_words):
        docs = docs.filter(_clean(docs.sparkSession.sparkContext.broadcast(index), threshold, overlap)(F.col(text_col)))
    return docs
