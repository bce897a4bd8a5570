"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration.

1. Statistics of every whole text (length, word shapes, shares of character classes, repetition) are
   made once, in Arrow batches, into a small table. Labels, language, source and id are never among them.
2. Labelled rows outside the held-out fold fit the model: at most `MOST_ROWS` of them, the first by a
   hash of the id (a documented bound on the fit; every document is scored). Three quarters fit the
   ridge weights, one quarter the calibration.
3. Features cos(W x + b), with seeded W, approximate a Gaussian kernel over standardised statistics.
   Each of `FIT_PARTS` parts sums Z'Z and Z'y; only those sums reach the driver.
4. Raw scores of the calibration part, counted per thousandth, are pooled to a rising curve.
5. Scoring is a pass over the statistics with no shuffle.

Defined results: null and empty texts have all-zero statistics and get the score of those; labels with
a null id or value are ignored, repeated labels of an id are averaged; without any usable label every
score is 0.5; repeated rows are scored alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import keys_to_send
from linkloom.shared import shared_table

MOST_ROWS, FIT_PARTS = 100_000, 16
FEATURES, RIDGE, SEED, STEPS = 300, 1e-3, 11, 1_000
#: Kernel width as a share of the root of the number of statistics; standard deviations at most.
WIDTH, FAR = 1.6, 4.0
ACCEPT = 0.7
#: Character classes whose shares are statistics.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>", b"|", b"!?", b".", b",", b"\n", b" \t", b"{}[]()=;:/\\_\"'`~^@+-")
_KIND = np.zeros((256, len(CLASSES) + 1))
for _k, _c in enumerate(CLASSES):
    _KIND[list(_c), _k] = 1
_KIND[128:, -1] = 1
SIZE = 10 + _KIND.shape[1]


def statistics(text: str | None) -> np.ndarray:
    """`SIZE` numbers; shares are given as square roots, which spreads small ones."""
    out = np.zeros(SIZE)
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return out
    n = len(words)
    size = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x]
    share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _KIND / len(raw)
    out[:10] = (
        np.log1p(n),
        size.mean(),
        np.log1p(size.std()),
        np.log1p(size.max()),
        len(set(words)) / n,
        np.log1p(len(set(words))),
        np.sqrt(sum(map(eq, words, words[1:])) / n),
        np.sqrt(1 - len(set(lines)) / len(lines)),
        len(zlib.compress(raw, 1)) / (len(raw) + 20),
        np.sqrt((size <= 2).mean()),
    )
    out[10:] = np.sqrt(share)
    return out


@dataclass
class Model:
    """Plain arrays: small whatever the input."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(np.clip((x - self.mean) / self.scale, -FAR, FAR) @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return np.concatenate([z, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.value), 0, 1) if len(self.at) else np.full(len(x), 0.5)


def fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def table_of_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x (array of floats) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([statistics(t.as_py()).astype(np.float32) for t in b.column(1)], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column(0), x], ["doc_id", "x"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, "doc_id long, x array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1) if len(column) else np.empty((0, SIZE))


def _pool(at: np.ndarray, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; the middle and the mean of each pool."""
    pools: list[list[float]] = []
    for a, t, m in zip(at, total, n, strict=True):
        pools.append([a * m, t, m])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    p = np.array(pools)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


def chosen_labels(labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", held_out: int = 2, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id and mean label y of the rows for the fit: fold not `held_out`, about `most_rows` of them at most."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.avg(label_col).alias("y"))
    known = known.filter(fold() != held_out)
    share = min(1.0, most_rows / max(1, known.count()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    return shared_table(known.filter(place < int(share * (1 << 30))), "quality-labels")


def fit(stats: DataFrame, known: DataFrame) -> Model:
    """A model from `stats` (`table_of_statistics`) of the rows in `known` (`chosen_labels`)."""
    rows = stats.join(known, "doc_id")
    rows = shared_table(rows.select("x", "y", F.pmod(F.xxhash64("doc_id"), F.lit(FIT_PARTS)).alias("part"), (F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(4)) == 0).alias("calibrate")), "quality-fit")

    one = rows.select(*[F.col("x")[i].cast("double").alias(f"s{i}") for i in range(SIZE)])
    got = one.agg(F.count("*").alias("n"), *[f(f"s{i}").alias(f"{f.__name__}{i}") for i in range(SIZE) for f in (F.avg, F.stddev_pop)]).first()
    rng = np.random.default_rng(SEED)
    w, b = rng.normal(0, 1 / (WIDTH * np.sqrt(SIZE)), (SIZE, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    none = np.empty(0)
    if not got["n"]:
        return Model(np.zeros(SIZE), np.ones(SIZE), w, b, np.zeros(FEATURES + 1), none, none)
    mean, scale = (np.array([got[f"{f}{i}"] for i in range(SIZE)]) for f in ("avg", "stddev_pop"))
    model = Model(mean, np.where(scale > 1e-9, scale, 1), w, b, np.zeros(FEATURES + 1), none, none)

    def sums(group: pa.Table) -> pa.Table:
        zz, zy = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in group.select(["x", "y"]).to_batches():
            z, y = model.features(_matrix(batch.column(0))), np.asarray(batch.column(1), dtype=np.float64)
            zz, zy = zz + z.T @ z, zy + z.T @ y
        return pa.table({"sums": pa.array([pickle.dumps((zz, zy))])})

    parts = [pickle.loads(r[0]) for r in rows.filter("not calibrate").select("x", "y", "part").groupBy("part").applyInArrow(sums, "sums binary").collect()]  # at most FIT_PARTS rows
    if not parts:
        return model
    zz, zy = sum(p[0] for p in parts), sum(p[1] for p in parts)
    model.weights = np.linalg.solve(zz + RIDGE * max(1.0, zz[-1, -1]) / FEATURES * np.eye(FEATURES + 1), zy)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.round(np.clip(model.raw(_matrix(batch.column(0))), -1, 2) * STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], ["at", "y"])

    points = rows.filter("calibrate").select("x", "y").mapInArrow(bins, "at long, y double").groupBy("at").agg(F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("at").toPandas()  # at most 3 * STEPS + 1 rows
    if len(points):
        model.at, model.value = _pool(points["at"].to_numpy() / STEPS, points["y"].to_numpy(), points["n"].to_numpy(float))
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of `table_of_statistics`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b.column(1))), pa.float64())], ["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: int = 2, accept: float = ACCEPT, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    stats = shared_table(table_of_statistics(docs, id_col, text_col), "quality-stats")
    model = fit(stats, chosen_labels(labels, id_col=id_col, label_col=label_col, held_out=held_out, most_rows=most_rows))
    scored = score(stats, model)
    return scored.select("doc_id", F.coalesce(fold() == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: int = 2, accept: float = ACCEPT, most_rows: int = MOST_ROWS) -> DataFrame:
    """The rows of `docs`, same columns, that the classifier accepts. Texts are never shuffled: those of the
    chosen labels give statistics for the fit, then a second pass scores and filters in place."""
    known = chosen_labels(labels, id_col=id_col, label_col=label_col, held_out=held_out, most_rows=most_rows)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = fit(table_of_statistics(own.join(keys_to_send(known), "doc_id")), known)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t) for t in texts]).reshape(-1, SIZE).astype(np.float32)))

    return docs.filter(scored(F.col(text_col)) >= accept)
