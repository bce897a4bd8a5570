"""SimHash near-duplicates with bit-sliced comparison.

1. One fingerprint a document, from all its word shingles with repeats (whole text, Arrow batches).
2. Equal fingerprints become one node, named by its smallest doc_id.
3. Nodes within `radius` bits agree on at least two of radius + 2 bands, so they meet in a block under
   one of the pairs of bands. Blocks above `BLOCK` rows are cut into sub-blocks and every pair of
   sub-blocks becomes a block: still every pair is compared, on many tasks.
4. Inside a block, `bitslice` finds what is within the radius and gives one link a row, to the first row
   it reaches: a spanning forest, never all pairs. The forests of all blocks keep every connection.
5. `components` names each connected group by its smallest doc_id.

Defined results: null and empty texts have fingerprint zero and link like any other; repeated rows are
rows of their own in the result; a null doc_id links nothing but takes the component of its equal
fingerprints; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm import bitslice
from linkloom.llm.components import components
from linkloom.shared import salt_mask, salt_of, salts_in, shared_table

BLOCK = 32_768
SEED = 42


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of every run of `words` words, lower case, joined by spaces; of all words if fewer."""
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    line, h = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([h(line, SEED)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in found))
    begins = [0, *ends]
    return np.array([h(line[a : b - 1], SEED) for a, b in zip(begins, ends[words - 1 :])], np.uint64)  # noqa: B905


def fingerprint(text: bytes | None, words: int) -> int:
    """64 bits, signed: a bit is 1 if it is set in over half the shingle hashes."""
    hashes = shingle_hashes(text, words)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for part in np.array_split(hashes, -(-len(hashes) // 65_536)):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id and fp (long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array((fingerprint(t.as_py(), words) for t in b.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], ["doc_id", "fp"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return given.mapInArrow(run, "doc_id long, fp long")


def _keys(radius: int, bits: int = 64) -> list:
    """One key a pair of bands: the pair's number and the bits of both bands."""
    bands = radius + 2
    cuts = [bits * i // bands for i in range(bands + 1)]
    mask = [((1 << cuts[i + 1]) - (1 << cuts[i])) for i in range(bands)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [F.struct(F.lit(k).cast("byte").alias("pair"), F.col("fp").bitwiseAND(F.lit(signed(mask[i] | mask[j]))).alias("part")) for k, (i, j) in enumerate(combinations(range(bands), 2))]


def link_blocks(blocks: DataFrame, keys: list[str], fp_cols: list[str], radius: int) -> DataFrame:
    """(node, to): a spanning forest of the links inside each block. Blocks are the groups of equal
    `keys` (the last being a long); rows come sorted, and whole blocks are compared a batch at a time."""
    schema = pa.schema([("node", pa.int64()), ("to", pa.int64())])

    def solve(key: np.ndarray, node: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        root = bitslice.roots(key, fps, 64 * len(fp_cols), radius)
        own = root != np.arange(len(root))
        return pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[root[own]])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in bitslice.whole_blocks(batches):
            yield solve(*whole)

    one = F.xxhash64(*keys).alias("key") if len(keys) > 1 else F.col(keys[0]).alias("key")
    rows = blocks.select(one, "node", *fp_cols)
    rows = rows.repartition("key").sortWithinPartitions("key", *fp_cols, "node")
    return rows.mapInArrow(run, "node long, to long")


def cut_blocks(rows: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Add `sub`: 0 for a block of at most `block` rows; else each row goes to every pair of sub-blocks
    that has its own, so any two rows of the block still meet in one of them."""
    big = rows.groupBy(*keys).count().filter(F.col("count") > block).withColumn("parts", F.ceil(F.col("count") / block).cast("int")).drop("count")
    met = rows.join(big, keys, "left")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    pairs = F.transform(
        F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: i != own),
        lambda i: (F.least(i, own) * F.col("parts") + F.greatest(i, own)).cast("int"),
    )
    return met.withColumn("sub", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(pairs))).drop("parts")


def near_links(nodes: DataFrame, radius: int = 2, block: int = BLOCK) -> DataFrame:
    """(node, to) between nodes (node, fp) whose fingerprints differ in at most `radius` bits."""
    keyed = nodes.select("node", "fp", F.explode(F.array(*_keys(radius))).alias("key")).select("node", "fp", "key.*")
    return link_blocks(cut_blocks(keyed, ["pair", "part"], block), ["pair", "part", "sub"], ["fp"], radius)


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, block: int = BLOCK) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    prints = shared_table(fingerprints(docs, id_col, text_col, words), "simhash").withColumn("salt", salt_of("doc_id"))
    nodes = shared_table(prints.groupBy("fp").agg(F.min("doc_id").alias("node"), salt_mask(F.col("salt")).alias("mask")), "simhash-nodes")
    found = components(near_links(nodes.filter("node is not null"), radius, block), "node", "to")
    named = nodes.join(found, "node", "left").select("fp", "mask", F.coalesce("root", "node").alias("component_id"))
    spread = named.select("fp", "component_id", F.explode(salts_in(F.col("mask"))).alias("salt"))
    return prints.join(spread, ["fp", "salt"]).select("doc_id", "fp", "component_id")
