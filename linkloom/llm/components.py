"""Connected components of a link table: contraction inside tasks, then alternating large and small stars.

A task closes up to `TASK` links at a time by itself and gives their forest, each node with the smallest it
reaches. Links are dealt to as many tasks as that takes; if they fill no more than one, the forest is the result.
More links go on in rounds of stars.

Every round is a few shuffles over links only; a node that a third of all links touch is met through
the salts its links use, so its links never sit in one task. Rounds end when no link changes; the
number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.shared import drop_shared, salt_mask, salt_of, salts_in, shared_table

#: Links that a task closes at a time, 16 bytes each.
TASK = 250_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of links: every node that reaches a smaller one, and the smallest it reaches."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(names))
    while len(a):
        one, other = root[a], root[b]
        least = np.minimum(one, other)
        np.minimum.at(root, one, least)
        np.minimum.at(root, other, least)
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    own = root != np.arange(len(names))
    return names[own], names[root[own]]


def contracted(links: DataFrame, task: int) -> DataFrame:
    """Links (u, v) with the same components, at most a row for each node of every `task` links that a task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def closed() -> pa.RecordBatch:
            cols = [np.concatenate([b.column(i).to_numpy() for b in kept]) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*cols)], ["u", "v"])

        for b in batches:
            if kept and sum(x.num_rows for x in kept) + b.num_rows > task:
                yield closed()
                kept = []
            kept.append(b)
        if kept:
            yield closed()

    return links.select("u", "v").mapInArrow(run, "u long, v long")


def _least(links: DataFrame) -> DataFrame:
    """Each link (u, v) with the smallest of u and all that u links to."""
    salted = links.withColumn("salt", salt_of("v"))
    least = salted.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), salt_mask(F.col("salt")).alias("mask"))
    spread = least.select("u", "m", F.explode(salts_in(F.col("mask"))).alias("salt"))
    return salted.join(spread, ["u", "salt"]).select("u", "v", "m")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u"))
    met = _least(both).filter("v > u")
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    met = _least(links)
    own = met.select("u", F.col("m").alias("v"))
    return met.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own).distinct()


def components(links: DataFrame, a: str, b: str, task: int | None = None) -> DataFrame:
    """(node, root): every node that reaches a smaller one, and the smallest it reaches; a node without a
    row is its own root. Links to itself and with a null end count for nothing; an empty table gives no rows."""
    task = task or TASK
    links = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(f"{a} is not null and {b} is not null and u > v")
    links = shared_table(contracted(links, task), "links")
    tasks = -(-links.count() // task)
    new = shared_table(contracted(links.coalesce(max(1, tasks)), task), "links")
    drop_shared(links)
    links, mark = new, None
    while tasks > 1:
        new = shared_table(_small_star(_large_star(links)), "links")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        drop_shared(links)
        links = new
        if now == mark or now[0] == 0:
            break
        mark = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
