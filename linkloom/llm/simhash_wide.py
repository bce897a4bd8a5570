"""SimHash near-duplicates by similarity: wide fingerprints, banded blocks, bit-sliced screening.

64 bits at a radius of 2 (module `simhash`) find texts that are all but equal. Texts whose sets of
five-word shingles have a Jaccard similarity of 0.8 differ in about 15 % of a SimHash's bits, so this
form takes `BITS` bits: the signs of a randomised Hadamard transform of a count sketch of the shingles.

1. Equal sets of shingles, by SHA-256, become one numbered node. Fingerprints of few shingles
   hold little: pairs with a text of less than `SHORT` are found exactly, by their first shingles in the
   order of hashes and then their whole sets. What follows is for the other nodes.
2. Nodes meet in blocks: `BANDS` bands of 16 bits, one row a band. At a similarity of 0.8 two texts share
   at least one band with a probability of 0.99, and of more than 0.9999 from 0.87 on.
3. In a block the first `SCREEN` bits are compared bit-sliced within `NEAR` bits (three standard
   deviations beyond what 0.8 gives). A row with at most `FEW` near rows makes a pair with each. Crowded
   rows, which have more, meet again with all their bits. Blocks above `BLOCK` rows are compared by pairs of
   sub-blocks.
4. All bits and both sizes give an estimate of the similarity with a standard deviation of 0.02. Pairs down
   to `SLACK` below the wanted similarity close to loose groups, of crowded rows by a spanning forest. In a group
   every pair is compared: those `SLACK` above hold, and rows that have a pair between the two in another tree
   meet once more with their whole sets of shingles. What leaves a block is a forest, never its pairs.
5. `components` closes the links; the smallest doc_id of a group stays.

Defined results: texts without a word are one group; rows with a null id are left alone; rows that repeat an
id and a text are one document, of which one row stays; rows that repeat an id with other texts are documents
of their own; an empty table gives an empty table; columns of any name stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm import bitslice
from linkloom.llm.common import free_names, keys_to_send
from linkloom.llm.components import components
from linkloom.llm.simhash import cut_blocks, shingle_hashes
from linkloom.shared import salt_mask, salt_of, salts_in, shared_table

WORDS, SIMILARITY, SLACK = 5, 0.8, 0.06
SKETCH, BITS, BANDS, SCREEN, NEAR = 4_096, 2_048, 64, 128, 32
#: Distinct shingles below which a text is compared by its whole set alone.
SHORT = 64
BLOCK = 8_192
TOGETHER = 256
#: Near rows in a block up to which a row's pairs are made one by one, and rows that meet the others of a block at a time.
FEW, QUERIES = 4, 8
_rng = np.random.default_rng(17)
PICK = np.sort(_rng.permutation(SKETCH)[:BITS])
PICK = PICK[_rng.permutation(BITS)]


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the row length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        v = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x


def wide_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """Bytes of the fingerprint of each set of shingle hashes (rows of BITS / 8)."""
    sketch = np.zeros((len(sets), SKETCH), np.float32)
    for i, h in enumerate(sets):
        sign = (h >> np.uint64(40) & np.uint64(1)).astype(np.float32) * 2 - 1
        sketch[i] = np.bincount((h & np.uint64(SKETCH - 1)).astype(np.int64), weights=sign, minlength=SKETCH)
    return np.packbits(hadamard(sketch)[:, PICK] > 0, axis=1, bitorder="little")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, tag (a hash of the text), fp, number and digest of the distinct shingles; and all of them if a
    text of less than SHORT can be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, TOGETHER):
                part = b.slice(a, TOGETHER)
                sets = [np.unique(shingle_hashes(t.as_py(), words)) for t in part.column(2)]
                fp = [r.tobytes() for r in wide_fingerprints(sets)]
                digest = [hashlib.sha256(h.tobytes()).digest() for h in sets]
                short = [h.view(np.int64) if len(h) * similarity < SHORT else None for h in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(fp, pa.binary()), pa.array([len(h) for h in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(short, pa.list_(pa.int64()))],
                    ["doc_id", "tag", "fp", "size", "digest", "short"],
                )

    return _rows(docs, id_col, text_col).filter("doc_id is not null").mapInArrow(run, "doc_id long, tag long, fp binary, size long, digest binary, short array<long>")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("binary")).alias("tag"), F.col(text_col).cast("binary").alias("text"))


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a in range(0, b.num_rows, 1_000):
            part = b.slice(a, 1_000)
            fp = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, -1)
            key = fp[:, : 2 * BANDS].copy().view(np.uint16).astype(np.int64) | np.arange(BANDS) << 16
            screen = np.repeat(fp[:, :16].copy().view(np.int64), BANDS, axis=0)
            node = np.repeat(part.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.ravel(), node, screen[:, 0].copy(), screen[:, 1].copy())], ["key", "node", "s0", "s1"])


def neighbours(key: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows sorted by key: (row, other), every other row of its block within NEAR of a row that has at
    most FEW of them; and the crowded rows, which have more."""
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(edge, len(key)))
    out: list[np.ndarray] = []
    crowded: list[np.ndarray] = []

    def sort_out(row: np.ndarray, first: np.ndarray, near: np.ndarray) -> None:
        n = near.sum(1, dtype=np.int64)
        at, lane = np.nonzero(near[few := (n > 0) & (n <= FEW)])
        out.append(np.stack([row[few][at], first[few][at] + lane]))
        crowded.append(row[n > FEW])

    for most in (2, 4, 8, 16, 32, 64):
        own = np.flatnonzero((sizes <= most) & (sizes > max(1, most // 2)))
        for part in np.array_split(own, max(1, len(own) // 2_000)):
            if not len(part):
                continue
            planes, filled = bitslice.word_blocks(fps, edge[part], sizes[part], most, SCREEN)
            for k in range(most):
                near = bitslice.near_own_word(planes, k, NEAR) & filled & ~(bitslice.ONE << np.uint64(k))
                near &= np.uint64(0) - (filled >> np.uint64(k) & bitslice.ONE)
                hit = np.flatnonzero(near)
                if len(hit):
                    sort_out(edge[part][hit] + k, edge[part][hit], np.unpackbits(near[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    for a, n in zip(edge[sizes > 64], sizes[sizes > 64], strict=True):
        block = fps[a : a + n]
        planes = bitslice.to_planes(block, SCREEN)
        masks = bitslice.query_masks(block, SCREEN)
        for b in range(0, n, bitslice.TOGETHER):
            q = np.arange(b, min(n, b + bitslice.TOGETHER))
            near = np.unpackbits(bitslice.near(planes, masks[:, q, None], NEAR).view(np.uint8), axis=1, bitorder="little")[:, :n]
            near[np.arange(len(q)), q] = 0
            sort_out(a + q, np.full(len(q), a), near)
    got = np.concatenate(out, axis=1) if out else np.empty((2, 0), np.int64)
    return got[0], got[1], np.concatenate(crowded) if crowded else np.empty(0, np.int64)


def candidates(nodes: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Of the near pairs in the blocks of nodes (node, fp): (a, b), a < b, those with a row that isn't
    crowded; and (key, node), the crowded rows of each block, between which the others are."""
    rows = nodes.select("node", "fp").mapInArrow(_band_rows, "key long, node long, s0 long, s1 long")
    if rows.groupBy("key").count().filter(F.col("count") > block).head(1):
        rows = cut_blocks(rows, ["key"], block).withColumn("key", F.xxhash64("key", "sub")).drop("sub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, fps in bitslice.whole_blocks(batches):
            i, j, crowded = neighbours(key, fps)
            pair = np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])]), axis=1)
            pair = pair[:, pair[0] < pair[1]]
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), pa.nulls(pair.shape[1], pa.int64())], ["a", "b", "key"])
            yield pa.RecordBatch.from_arrays([pa.array(node[crowded]), pa.nulls(len(crowded), pa.int64()), pa.array(key[crowded])], ["a", "b", "key"])

    met = shared_table(rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long, key long"), "wide-met")
    return met.filter("key is null").select("a", "b").distinct(), met.filter("key is not null").select("key", F.col("a").alias("node"))


def estimate(fp: tuple[np.ndarray, np.ndarray], size: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The similarity that all bits (words in the last axis) and both sizes give."""
    share = np.bitwise_count(fp[0] ^ fp[1]).sum(-1, dtype=np.int64) / BITS
    both = np.minimum(np.cos(np.pi * share) * np.sqrt(size[0] * size[1]), np.minimum(*size))
    return both / np.maximum(1e-9, size[0] + size[1] - both)


def block_links(test: Callable[[np.ndarray, np.ndarray], np.ndarray], n: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, other, score): a spanning forest of the pairs from `least` on in a block of `n` rows that `test` scores,
    rows against rows. Breadth first, each row once: a row that is linked is never tried again."""
    left = np.arange(n)
    while len(left) > 1:
        todo, left = [left[:1]], left[1:]
        while todo and len(left):
            rows = todo.pop()
            for a in range(0, len(rows), QUERIES):
                q = rows[a : a + QUERIES]
                if not len(left):
                    break
                score = test(q, left)
                best = score.argmax(0)
                top = score[best, np.arange(len(left))]
                hit = top >= least
                if hit.any():
                    yield q[best[hit]], left[hit], top[hit]
                    todo.append(left[hit])
                    left = left[~hit]


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """From batches sorted by their first column: the rows of each of its values that has more than one."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        key = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, z in pairwise(cuts):
            if kept and kept[-1].column(0)[0].as_py() != key[a]:
                if len(kept) > 1 or kept[0].num_rows > 1:
                    yield pa.Table.from_batches(kept)
                kept = []
            if z - a > 1 or a == 0 or z == len(key):  # a lone row inside a batch meets no other
                kept.append(b.slice(a, z - a))
    if kept and (len(kept) > 1 or kept[0].num_rows > 1):
        yield pa.Table.from_batches(kept)


def _prints_of(x: pa.Table) -> tuple[np.ndarray, Callable[[np.ndarray, np.ndarray], np.ndarray]]:
    """A block's nodes, and the estimate of rows against rows."""
    size = x["size"].to_numpy().astype(float)
    fp = np.frombuffer(b"".join(x["fp"].to_pylist()), np.uint64).reshape(len(size), -1)
    return x["node"].to_numpy(), lambda q, o: estimate((fp[q, None], fp[None, o]), (size[q, None], size[None, o]))


def crowded_links(crowd: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(a, b): `block_links` of each block's crowded rows by all bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in blocks_of(batches):
            node, test = _prints_of(x)
            for i, j, _ in block_links(test, len(node), least):
                yield pa.RecordBatch.from_arrays([pa.array(f(node[i], node[j])) for f in (np.minimum, np.maximum)], ["a", "b"])

    rows = crowd.distinct().join(nodes.select("node", "fp", "size"), "node").select("key", "node", "fp", "size")
    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long")


def loose_links(nodes: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(a, b): near pairs whose estimate is at least `least`, or of crowded rows of a block a spanning forest of them."""
    links, crowd = candidates(nodes, block)
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("fp").alias(f"{c}_fp"), F.col("size").alias(f"{c}_size"))
    met = links.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            fp = [np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint64).reshape(x.num_rows, BITS // 64) for c in (2, 3)]
            size = [x.column(c).to_numpy().astype(float) for c in (4, 5)]
            held = np.flatnonzero(estimate(fp, size) >= least)
            yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(held)), x.column(1).take(pa.array(held))], ["a", "b"])

    few = met.select("a", "b", "a_fp", "b_fp", "a_size", "b_size").mapInArrow(run, "a long, b long")
    return few.union(crowded_links(crowd, nodes, least)).distinct()


def sure_links(members: DataFrame, least: float, sure: float) -> DataFrame:
    """Of the groups (key) of members (key, node, fp, size): links (a, b), a spanning forest of the pairs estimated at
    `sure` or more; and (key, node, tree) of the rows that have a pair between `least` and `sure` in another tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in blocks_of(batches):
            node, test = _prints_of(x)
            tree = np.arange(len(node))
            for i, j, _ in block_links(test, len(node), sure):
                tree[j] = tree[i]
                yield _links_and_rows(np.minimum(node[i], node[j]), np.maximum(node[i], node[j]))
            if (tree == 0).all():
                continue
            open_ = np.zeros(len(node), bool)
            for q in range(len(node)):
                other = np.flatnonzero(tree[q + 1 :] != tree[q]) + q + 1
                near = other[test(np.array([q]), other)[0] >= least] if len(other) else other
                open_[near] = True
                open_[q] |= len(near) > 0
            yield _links_and_rows(key=x["key"].to_numpy()[open_], node=node[open_], tree=node[tree[open_]])

    return members.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long, key long, node long, tree long")


def _links_and_rows(a: np.ndarray | None = None, b: np.ndarray | None = None, key: np.ndarray | None = None, node: np.ndarray | None = None, tree: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(a if a is not None else key)
    cols = [pa.nulls(n, pa.int64()) if c is None else pa.array(c.astype(np.int64)) for c in (a, b, key, node, tree)]
    return pa.RecordBatch.from_arrays(cols, ["a", "b", "key", "node", "tree"])


def exact_links(rows: DataFrame, similarity: float, least: float) -> DataFrame:
    """(a, b): of rows (key, node, tree, fp, size, shingles), a spanning forest of each key's pairs that share a
    tree or, estimated at `least` or more, have whole sets of that similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in blocks_of(batches):
            node, guess = _prints_of(x)
            tree = x["tree"].to_numpy()
            sets = [s.view(np.uint64) for c in x["shingles"].chunks for s in c.to_numpy(zero_copy_only=False)]

            def test(q: np.ndarray, o: np.ndarray) -> np.ndarray:
                score = (tree[q, None] == tree[None, o]).astype(float)  # noqa: B023
                for k, r in zip(*np.nonzero((score == 0) & (guess(q, o) >= least)), strict=True):  # noqa: B023
                    own, other = sets[q[k]], sets[o[r]]  # noqa: B023
                    both = (other[np.minimum(np.searchsorted(other, own), len(other) - 1)] == own).sum()
                    score[k, r] = both >= similarity * (len(own) + len(other) - both)
                return score

            for i, j, _ in block_links(test, len(node), 1):
                yield pa.RecordBatch.from_arrays([pa.array(f(node[i], node[j])) for f in (np.minimum, np.maximum)], ["a", "b"])

    return rows.select("key", "node", "tree", "fp", "size", "shingles").repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long")


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """node and its distinct shingle hashes, from the documents in `wanted` (node, doc_id, tag)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), words)).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    own = _rows(docs, id_col, text_col).join(keys_to_send(wanted), ["doc_id", "tag"]).select("node", "text").mapInArrow(run, "node long, shingles array<long>")
    return own.groupBy("node").agg(F.first("shingles").alias("shingles"))


def similar_links(docs: DataFrame, prints: DataFrame, nodes: DataFrame, similarity: float, slack: float, id_col: str, text_col: str, words: int, block: int = BLOCK) -> DataFrame:
    """(a, b): links of at least `similarity`, all that connect them. Estimates further than `slack` from it decide; the
    others are settled by the whole shingle sets of a document of each node."""
    least, sure = similarity - slack, similarity + slack
    groups = components(loose_links(nodes, least, block), "a", "b")
    members = shared_table(groups.union(groups.select("root", "root")).distinct(), "wide-groups").withColumnRenamed("root", "key")
    rows = nodes.join(members, "node").select("key", "node", "fp", "size")
    if members.groupBy("key").count().filter(F.col("count") > block).head(1):
        rows = cut_blocks(rows, ["key"], block).withColumn("key", F.xxhash64("key", "sub")).drop("sub")
    found = shared_table(sure_links(rows, least, sure), "wide-sure")
    open_ = found.filter("node is not null").select("key", "node", "tree")
    own = open_.select("node").distinct().join(nodes.select("node", "digest", F.col("first").alias("doc_id")), "node").join(prints.select("digest", "doc_id", "tag"), ["digest", "doc_id"])
    wanted = shared_table(own.groupBy("node", "doc_id").agg(F.min("tag").alias("tag")), "wide-wanted")
    sets = shared_table(shingle_sets(docs, wanted, id_col, text_col, words), "wide-sets")
    exact = exact_links(open_.join(nodes.select("node", "fp", "size"), "node").join(sets, "node"), similarity, least)
    return found.filter("a is not null").select("a", "b").union(exact)


def short_links(nodes: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """(a, b): links of nodes (node, short), all that connect them, by their whole sets. Similar sets share one
    of their first shingles by hash: of n, all but the similarity's share of n, and one more."""
    first = F.size("short") - F.ceil(F.size("short") * similarity - 1e-9).cast("int") + 1
    rows = nodes.select("node", "short", F.explode(F.slice("short", F.lit(1), first)).alias("key"))
    if rows.groupBy("key").count().filter(F.col("count") > block).head(1):
        rows = cut_blocks(rows, ["key"], block).withColumn("key", F.xxhash64("key", "sub")).drop("sub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in blocks_of(batches):
            node = x["node"].to_numpy()
            sets = [s for c in x["short"].chunks for s in c.to_numpy(zero_copy_only=False)]
            size = np.array([len(s) for s in sets])
            row = np.repeat(np.arange(len(sets)), size)
            _, number = np.unique(np.concatenate(sets), return_inverse=True)
            order = np.argsort(number, kind="stable")
            having, begin = row[order], np.searchsorted(number[order], np.arange(number.max() + 2))
            own = np.split(number, np.cumsum(size)[:-1])

            def test(q: np.ndarray, o: np.ndarray) -> np.ndarray:
                both = np.stack([np.bincount(np.concatenate([having[begin[k] : begin[k + 1]] for k in own[i]]), minlength=len(node))[o] for i in q])  # noqa: B023
                return both >= similarity * (size[q, None] + size[None, o] - both)  # noqa: B023

            for i, j, _ in block_links(test, len(node), 1):
                yield pa.RecordBatch.from_arrays([pa.array(f(node[i], node[j])) for f in (np.minimum, np.maximum)], ["a", "b"])

    rows = rows.select("key", "node", "short").repartition("key").sortWithinPartitions("key", "node")
    return rows.mapInArrow(run, "a long, b long").filter("a < b").distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, slack: float, block: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of every document; and every node with its group: digest, first (its smallest doc_id) and root."""
    prints = shared_table(fingerprints(docs, id_col, text_col, words, similarity), "wide").withColumn("salt", salt_of("doc_id", "tag"))
    nodes = prints.groupBy("digest", "fp", "size", "short").agg(F.min("doc_id").alias("first"), salt_mask(F.col("salt")).alias("mask"))
    nodes = shared_table(nodes.withColumn("node", F.monotonically_increasing_id()), "wide-nodes")  # numbered once, when written
    long = similar_links(docs, prints, nodes.filter(F.col("size") >= SHORT), similarity, slack, id_col, text_col, words, block)
    found = components(long.union(short_links(nodes.filter("size > 0 and short is not null"), similarity, block)), "a", "b")
    return prints, nodes.join(found, "node", "left").select("digest", "first", "mask", F.coalesce("root", "node").alias("root"))


def near_duplicate_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, slack: float = SLACK, block: int = BLOCK) -> DataFrame:
    """doc_id and component_id, the smallest doc_id of its group, of every row with an id."""
    prints, nodes = _grouped(docs, id_col, text_col, words, similarity, slack, block)
    nodes = shared_table(nodes, "wide-grouped")
    named = nodes.withColumn("salt", salt_of("digest"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"), salt_mask(F.col("salt")).alias("salts"))
    named = named.join(least.select("root", "component_id", F.explode(salts_in(F.col("salts"))).alias("salt")), ["root", "salt"])
    spread = named.select("digest", "component_id", F.explode(salts_in(F.col("mask"))).alias("salt"))
    return prints.select("doc_id", "digest", "salt").join(spread, ["digest", "salt"]).select("doc_id", "component_id")


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, slack: float = SLACK, block: int = BLOCK) -> DataFrame:
    """`docs`, same columns, with one document of each group: that of smallest id, then by hashes of its text.
    What goes is decided on narrow tables of (id, text hash); texts are only shuffled when the table of
    those that go is too large to be sent to the scans."""
    prints, nodes = _grouped(docs, id_col, text_col, words, similarity, slack, block)
    rows = prints.groupBy("doc_id", "tag", "digest").agg(F.count("*").alias("n"))
    stay = nodes.groupBy("root").agg(F.min(F.struct("first", "digest")).alias("best")).select(F.col("best.first").alias("doc_id"), F.col("best.digest").alias("digest"))
    rows = shared_table(rows.join(stay.withColumn("best", F.lit(True)), ["doc_id", "digest"], "left"), "wide-rows")
    kept = rows.filter("best").groupBy("doc_id", "digest").agg(F.min("tag").alias("tag"))
    gone = rows.join(kept, ["doc_id", "digest", "tag"], "left_anti")

    id_, tag, key, text = free_names(docs, "id", "tag", "key", "text_hash")
    named = lambda df: df.select(F.col("doc_id").alias(id_), F.col("tag").alias(tag))
    gone = keys_to_send(shared_table(named(gone), "wide-gone"))
    again = shared_table(named(rows.filter("n > 1").join(kept, ["doc_id", "digest", "tag"])), "wide-again")
    whole = docs.withColumns({key: F.col(id_col).cast("long"), text: F.xxhash64(F.col(text_col).cast("binary"))})
    left = whole.join(gone, (F.col(key) == gone[id_]) & (F.col(text) == gone[tag]), "left_anti")
    if not again.head(1):
        return left.select(docs.columns)
    met = (F.col(key) == again[id_]) & (F.col(text) == again[tag])
    own = Window.partitionBy(key, text).orderBy(F.xxhash64(*docs.columns))
    one = left.join(again, met, "left_semi").withColumn(id_, F.row_number().over(own)).filter(F.col(id_) == 1)
    return left.join(again, met, "left_anti").select(docs.columns).union(one.select(docs.columns))
