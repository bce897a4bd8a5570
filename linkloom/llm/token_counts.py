"""Token counts as delta-maintained rollups.

A change is a signed row: an insert counts +1 document, a delete -1, a revision is both. Changes of one
batch are counted (whole texts, Arrow batches), added up by source, language and tokenizer version before
anything is stored, and committed as one folder of the ledger named by the batch. Totals are the sum of
all committed batches, so they are additive, need no old texts, and a hot source costs one row a task.

Commits are idempotent: a folder with Spark's success marker is final, and committing its name again
does nothing; a folder without it (an executor or driver lost on the way) is written anew. Two tokenizer
versions live side by side; a batch under a new version never touches the old totals.

Defined results: null and empty texts have 0 tokens and count as documents; null source or language is a
group of its own; repeated rows count each; a group whose documents all went keeps a row of zeros in the
ledger and none in the totals; an empty batch commits and adds nothing; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer_version")
SUMS = ("n_docs", "n_tokens", "n_chars")
#: Fixed value: the splitting pattern that the byte-level vocabularies were made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of a vocabulary file that may travel to every task.
MOST_VOCABULARY = 16 << 20
_made: dict[str, object] = {}


@dataclass(frozen=True)
class Tokenizer:
    """A rank file read once on the driver (its size is checked); tasks rebuild it once a process."""

    version: str
    ranks: bytes
    pattern: str = PATTERN

    @staticmethod
    def read(path: str, name: str, pattern: str = PATTERN) -> Tokenizer:
        with open(path, "rb") as f:
            ranks = f.read(MOST_VOCABULARY + 1)
        if len(ranks) > MOST_VOCABULARY:
            raise ValueError(f"{path} has more than {MOST_VOCABULARY} bytes")
        return Tokenizer(f"{name}@{hashlib.sha256(ranks + pattern.encode()).hexdigest()[:8]}", ranks, pattern)

    def encoding(self):
        if self.version not in _made:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines())}
            _made[self.version] = tiktoken.Encoding(self.version, pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return _made[self.version]


def counted(docs: DataFrame, tokenizer: Tokenizer, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", sign_col: str | None = None) -> DataFrame:
    """doc_id, keys, sign and the token and character count of every row."""
    whole = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = whole.value.encoding().encode_ordinary
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(4)]
            n = pa.array([len(encode(t)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], n, pa.array(map(len, texts), pa.int64())], ["doc_id", "source", "lang", "sign", "tokens", "chars"])

    sign = F.col(sign_col).cast("long") if sign_col else F.lit(1).cast("long")
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), sign.alias("sign"), F.col(text_col).alias("text"))
    rows = given.mapInArrow(run, "doc_id long, source string, lang string, sign long, tokens long, chars long")
    return rows.withColumn("tokenizer_version", F.lit(tokenizer.version))


def delta(rows: DataFrame) -> DataFrame:
    """One row a group: signed sums of `counted` rows."""
    return rows.groupBy(*KEYS).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("tokens")).alias("n_tokens"), F.sum(F.col("sign") * F.col("chars")).alias("n_chars"))


def revision(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed rows of a revision: the old version of each document leaves, the new one comes. Either
    side may be empty (a pure insert or delete); both carry the columns of documents."""
    names = [c for c in after.columns if c in before.columns]
    return before.select(*names, F.lit(-1).alias("sign")).unionByName(after.select(*names, F.lit(1).alias("sign")))


class Rollup:
    """The ledger in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, path: str) -> bool:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf).exists(p)

    def committed(self, batch: str) -> bool:
        return self._exists(f"{self.folder}/batch={batch}/_SUCCESS")

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Commit `counted` rows as `batch`; False if it had been committed. `batch` names a folder:
        letters, digits, '-' and '_'."""
        if not batch or not all(c.isalnum() or c in "-_" for c in batch):
            raise ValueError(f"not a batch name: {batch!r}")
        if self.committed(batch):
            return False
        delta(rows).write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """Keys and sums over all committed batches, groups without documents left out."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        top = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = top.getFileSystem(conf)
        found = [f"{self.folder}/{s.getPath().getName()}" for s in fs.listStatus(top)] if fs.exists(top) else []
        found = sorted(p for p in found if self._exists(f"{p}/_SUCCESS"))
        schema = ", ".join(f"{k} string" for k in KEYS) + ", " + ", ".join(f"{k} long" for k in SUMS)
        every = self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)
        return every.groupBy(*KEYS).agg(*[F.sum(s).alias(s) for s in SUMS]).filter("n_docs != 0 or n_tokens != 0")
