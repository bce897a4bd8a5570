"""Quality rules whose cut-offs come from mergeable quantile sketches per language and source.

1. One pass over the whole texts (Arrow batches) gives counts per document.
2. Each rate goes to a logarithmic bucket of 2 % relative width; a sketch is the table of bucket counts
   of a group. Sketches merge by adding counts, so tasks pre-aggregate, a hot source costs no more than
   its buckets, reruns agree, and a language's sketch is the sum of its sources'. A rate has at most
   `MOST_BUCKETS` buckets, whatever the number of documents.
3. A group's fences are its quartiles moved out by `SPREAD` times their distance plus a small slack;
   groups under `LEAST_DOCS` documents use their language's sketch, then the whole corpus's.
4. The fences join the counts; a document is kept if it passes the base rule and all fences.

Defined results: null and empty texts have zero counts and fail the base rule; null language or source is
a group of its own; repeated rows count each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.shared import shared_table

#: Fixed values of the base rule.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
WINDOW = 8

#: Rate, slack above the upper fence, slack below the lower one (None: no lower fence).
RATES = (("symbols", 0.1, None), ("marks", 0.2, None), ("upper", 0.2, None), ("dup_lines", 0.4, None), ("stutter", 0.2, None), ("word_len", 1.5, 1.0))
WIDTH, FLOOR, SPREAD, LEAST_DOCS = 1.02, 1e-4, 3.0, 50
MOST_BUCKETS = 1_500
#: Groups whose fences may be broadcast (about 150 bytes each); more are joined by shuffle.
BROADCAST_GROUPS = 50_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper", "n_stutter")
UPPER = bytes(range(65, 91))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of `window` words (a power of two) that occur twice or more in the list."""
    if len(words) <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    span = 1
    while span < window:  # equal ids: equal runs of `span` words
        _, ids = np.unique(ids[:-span] * (int(ids.max()) + 1) + ids[span:], return_inverse=True)
        span *= 2
    twice = np.bincount(ids)[ids] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The values of `COUNTS`."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode()
    words = raw.split()
    lines, seen, dup = 0, set(), 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            dup += line in seen
            seen.add(line)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        dup,
        repeated_words(words),
        lines,
        text.count("!") + text.count("?"),
        len(raw) - len(raw.translate(None, UPPER)),
        sum(map(eq, words, words[1:])),
    )


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, group keys and `COUNTS` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [counts(t.as_py()) for t in b.column(3)]
            cols = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *cols], ["doc_id", "lang_key", "source_key", *COUNTS])

    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), key(lang_col).alias("lang_key"), key(source_col).alias("source_key"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, "doc_id long, lang_key string, source_key string, " + ", ".join(f"{c} long" for c in COUNTS))


def with_rates(docs: DataFrame) -> DataFrame:
    """Add the columns of `RATES`; 0 where there is nothing to divide by."""
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return docs.withColumns(
        {"symbols": over("n_symbols", "n_words"), "marks": over("n_marks", "n_words"), "upper": over("n_upper", "word_chars"), "dup_lines": over("n_dup_lines", "n_lines"), "stutter": over("n_stutter", "n_words"), "word_len": over("word_chars", "n_words")}
    )


def sketches(rated: DataFrame) -> DataFrame:
    """(lang_key, source_key, rate, bucket, n): the bucket counts of every group's rates."""
    long = rated.select(
        "lang_key",
        "source_key",
        F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), F.col(r).alias("x")) for r, _, _ in RATES])).alias("r"),
    )
    bucket = F.when(F.col("r.x") <= FLOOR, 0).otherwise(F.least(F.lit(MOST_BUCKETS), F.ceil(F.log(F.col("r.x") / FLOOR) / F.log(F.lit(WIDTH)))))
    return long.groupBy("lang_key", "source_key", "r.rate", bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rate, docs, q1, q3) after merging sketches that share `keys`: the upper edge of the first
    bucket that holds the quantile."""
    merged = sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "rate")
    upto = F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = merged.withColumns({"upto": upto, "docs": F.sum("n").over(w)})
    value = F.when(F.col("bucket") == 0, 0.0).otherwise(F.lit(FLOOR) * F.pow(F.lit(WIDTH), F.col("bucket")))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("docs"), value))
    return ranked.groupBy(*keys, "rate").agg(F.first("docs").alias("docs"), at(0.25).alias("q1"), at(0.75).alias("q3"))


def fences(sketch: DataFrame) -> DataFrame:
    """One row a group: `<rate>_most` of every rate and `<rate>_least` of those with a lower fence."""
    own, lang, every = quartiles(sketch, ["lang_key", "source_key"]), quartiles(sketch, ["lang_key"]), quartiles(sketch, [])
    rename = lambda df, p: df.select(*[F.col(c).alias(c if c in ("lang_key", "rate") else p + c) for c in df.columns])
    met = own.join(rename(lang, "l_"), ["lang_key", "rate"]).join(rename(every, "a_"), "rate")
    pick = lambda q: F.when(F.col("docs") >= LEAST_DOCS, F.col(q)).when(F.col("l_docs") >= LEAST_DOCS, F.col("l_" + q)).otherwise(F.col("a_" + q))
    met = met.select("lang_key", "source_key", "rate", pick("q1").alias("q1"), pick("q3").alias("q3"))
    far = SPREAD * (F.col("q3") - F.col("q1"))
    out = []
    for r, above, below in RATES:
        out.append(F.max(F.when(F.col("rate") == r, F.col("q3") + far + above)).alias(f"{r}_most"))
        if below is not None:
            out.append(F.max(F.when(F.col("rate") == r, F.col("q1") - far - below)).alias(f"{r}_least"))
    return met.groupBy("lang_key", "source_key").agg(*out)


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, counts, base_failed and kept of every row."""
    rated = with_rates(shared_table(document_counts(docs, id_col, text_col, lang_col, source_col), "rule-counts"))
    limits = shared_table(fences(sketches(rated)), "rule-fences")
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    met = rated.join(limits, ["lang_key", "source_key"])
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    passed = F.lit(True)
    for r, _, below in RATES:
        passed &= F.col(r) <= F.col(f"{r}_most")
        if below is not None:
            passed &= F.col(r) >= F.col(f"{r}_least")
    return met.select("doc_id", *COUNTS, base.alias("base_failed"), (~base & passed).alias("kept"))
