"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

1. The languages and their counts come from all rows outside the held-out fold (id and language columns
   only). The fit takes at most `MOST_ROWS` of those rows, shared evenly among languages, the first by a
   hash of the id: a documented bound on the fit; every document is predicted from its whole text.
2. Letters, lower case, with everything else as one space between words, give 1- to 3-grams, hashed to
   `BUCKETS` counters; a value is (1 + ln count) * idf, scaled to unit length. Document frequencies are those of
   all rows outside the held-out fold that have a language.
3. Each of `FIT_PARTS` tasks runs follow-the-regularised-leader with elastic-net penalties over its rows;
   the averaged weights are the model. Most weights are exactly zero.
4. A temperature, chosen on rows that the weights never saw, makes the scores probabilities.

Defined results: null texts and texts without a letter are `und` with score 0; null languages teach
nothing; without any usable row everything is `und`; repeated rows are predicted alike; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.shared import shared_table

MOST_ROWS, FIT_PARTS, EPOCHS = 4_000, 4, 3
BITS = 15
BUCKETS = 1 << BITS
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 1e-4
NONE = "und"
_LETTER = np.array([chr(i).isalpha() for i in range(0xD800)] + [False] * 0x800 + [chr(i).isalpha() for i in range(0xE000, 0x10000)])
_MULT = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Bucket numbers, rising, and how often each occurs; None without a letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _LETTER[np.minimum(c, 0xFFFF)]
    if (wide := np.flatnonzero(c > 0xFFFF)).size:
        letter[wide] = [chr(x).isalpha() for x in c[wide]]
    if not letter.any():
        return None
    c = np.where(letter, c, np.uint32(32))
    c = np.concatenate((c[:1] * 0 + np.uint32(32), c, c[:1] * 0 + np.uint32(32)))
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
    one = c * _MULT[0]
    two = (one[:-1] ^ c[1:]) * _MULT[1]
    three = (two[:-1] ^ c[2:]) * _MULT[2]
    shift = np.uint32(32 - BITS)
    n = sum(np.bincount((x ^ x >> np.uint32(15)) * _MULT[0] >> shift, minlength=BUCKETS) for x in (one, two, three))
    at = np.flatnonzero(n)
    return at, n[at]


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def values(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        v = (1 + np.log(n)) * self.idf[at]
        return v / max(1e-12, np.sqrt(v @ v))

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.values(at, n) @ self.weights[at]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or (found := ngrams(text)) is None:
            return NONE, 0.0
        p = _softmax(self.logits(*found) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], model: Model) -> np.ndarray:
    """Weights after `EPOCHS` passes over (buckets, counts, class) rows in a seeded order."""
    z, n = np.zeros_like(model.weights), np.zeros_like(model.weights)
    scale = lambda z, n: np.where(np.abs(z) <= L1, 0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    rng = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at, count, y = rows[i]
            v, w = model.values(at, count), scale(z[at], n[at])
            p = _softmax(v @ w)
            p[y] -= 1
            g = v[:, None] * p
            square = g * g
            z[at] += g - (np.sqrt(n[at] + square) - np.sqrt(n[at])) / ALPHA * w
            n[at] += square
    return scale(z, n)


def fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def _rows(b: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray, int]]:
    return [(np.array(a.as_py(), np.int64), np.array(n.as_py(), np.float64), y.as_py()) for a, n, y in zip(b.column(0), b.column(1), b.column(2), strict=True)]


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """How many of all texts hold each bucket; and, last, how many have a letter. A task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS + 1, np.int64)
        for b in batches:
            for t in b.column(0):
                if (v := ngrams(t.as_py())) is not None:
                    df[v[0]] += 1
                    df[BUCKETS] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["at", "n"])

    seen = texts.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS + 1 rows
    out = np.zeros(BUCKETS + 1)
    out[seen["at"].to_numpy(np.int64)] = seen["n"].to_numpy(float)
    return out


def idf_of(df: np.ndarray) -> np.ndarray:
    return np.where(df[:BUCKETS] > 0, np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 0.1, 0.0)


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 2, most_rows: int = MOST_ROWS) -> Model:
    usable = docs.filter(F.col(lang_col).isNotNull() & (F.coalesce(fold(id_col), F.lit(0)) != held_out))
    counts = {r[0]: r[1] for r in usable.groupBy(lang_col).count().orderBy(lang_col).collect()}  # a row a class, as the model has
    langs = list(counts)
    model = Model(langs, np.zeros(BUCKETS), np.zeros((BUCKETS, len(langs))))
    if not langs:
        return model
    share = {k: min(1.0, most_rows / len(langs) / n) for k, n in counts.items()}
    pick = lambda of: F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, of(k))]), F.col(lang_col))
    place = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30))
    sample = usable.filter(place < pick(lambda k: int(share[k] * (1 << 30))))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(*v, y.as_py(), t.as_py()) for x, y, t in zip(*b.columns, strict=True) if (v := ngrams(x.as_py())) is not None]
            cols = zip(*got, strict=True) if got else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.bool_()), strict=True)], ["at", "n", "y", "test"])

    test = F.pmod(F.xxhash64(F.lit(3), F.col(id_col)), F.lit(5)) == 0
    rows = sample.select(F.col(text_col).alias("text"), pick(langs.index).cast("int").alias("y"), test.alias("test"))
    rows = shared_table(rows.mapInArrow(vectors, "at array<int>, n array<int>, y int, test boolean"), "lang-fit")

    model.idf = idf_of(document_frequencies(usable.select(F.col(text_col).alias("text"))))

    def train(group: pa.Table) -> pa.Table:
        own = [r for b in group.select(["at", "n", "y"]).to_batches() for r in _rows(b)]
        return pa.table({"w": pa.array([pickle.dumps((len(own), ftrl(own, model).astype(np.float32)))])})

    part = F.pmod(F.xxhash64("at", "y"), F.lit(FIT_PARTS)).alias("part")
    parts = [pickle.loads(r[0]) for r in rows.filter("not test").select("at", "n", "y", part).groupBy("part").applyInArrow(train, "w binary").collect()]  # at most FIT_PARTS rows
    if not parts:
        return Model([], model.idf, model.weights)
    model.weights = sum(n * w for n, w in parts).astype(np.float64) / sum(n for n, _ in parts)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(model.logits(a, n).tolist(), y) for a, n, y in _rows(b)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.list_(pa.float64())), pa.array([g[1] for g in got], pa.int32())], ["logit", "y"])

    got = rows.filter("test").select("at", "n", "y").mapInArrow(logits, "logit array<double>, y int").collect()  # a fifth of MOST_ROWS
    if got:
        x, y = np.array([r[0] for r in got]), np.array([r[1] for r in got])
        loss = lambda t: -np.log(np.maximum(1e-12, _softmax(x / t)[np.arange(len(y)), y])).mean()
        model.temperature = min(np.geomspace(0.05, 5, 60), key=loss)
    return model


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 2, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    model = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, held_out=held_out, most_rows=most_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, "doc_id long, lang_pred string, score double").select("doc_id", F.coalesce(fold() == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
