"""Usage-based saliency: touches fold into a decaying state a node, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import lexical as L

#: Fixed values of the curve.
BASE, DECAY, ALPHA, LOW, HIGH = 5.0, 0.05, 0.5, 1.0, 10.0
DAY = 86_400.0


def fold(touches: DataFrame) -> DataFrame:
    """(node_id, current, activations, last_seen) after all touches (node_id, at seconds, delta) in time
    order: a touch first decays the state by the days since the last, then adds what its count gives.
    Touches of one second are one touch, so a busy node folds its seconds, not its events."""
    once = touches.groupBy("node_id", "at").agg(F.sum("delta").alias("delta"))
    steps = once.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("at", "delta"))).alias("steps"))
    start = F.struct(F.lit(BASE).alias("s"), F.lit(None).cast("long").alias("at"), F.lit(0).cast("long").alias("n"))

    def step(acc, t):
        days = F.greatest(F.lit(0.0), (t["at"] - F.coalesce(acc["at"], t["at"])) / DAY)
        s = L.clamp(acc["s"] * F.exp(-DECAY * days) + ALPHA * F.log1p(t["delta"].cast("double")), LOW, HIGH)
        return F.struct(s.alias("s"), t["at"].alias("at"), (acc["n"] + t["delta"]).alias("n"))

    end = F.aggregate("steps", start, step)
    return steps.select("node_id", end.alias("e")).select("node_id", F.col("e.s").alias("current"), F.col("e.n").alias("activations"), F.col("e.at").alias("last_seen"))


def decay(states: DataFrame, now: int) -> DataFrame:
    """States as of `now`: those older decay with a count of zero, newer ones stay."""
    days = F.greatest(F.lit(0.0), (F.lit(now) - F.col("last_seen")) / DAY)
    new = L.saliency(F.col("current"), F.lit(DECAY), days, F.lit(0), ALPHA, LOW, HIGH)
    return states.withColumn("current", F.when(F.col("last_seen") < now, new).otherwise(F.col("current")))


def snapshot_stats(states: DataFrame, least: float = 0.7, activations: int = 3) -> DataFrame:
    """One row: nodes, their mean, and how many pass the high mark with enough activations."""
    high = (F.col("current") >= least) & (F.col("activations") >= activations)
    return states.agg(F.count("*").alias("nodes"), F.avg("current").alias("mean"), F.sum(high.cast("long")).alias("high"))


def edge_scores(states: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, score): a node's saliency on every link that points to it."""
    return edges.join(states.select(F.col("node_id").alias("dst"), F.col("current").alias("score")), "dst").select("src", "dst", "score")


def stream_fold(touches: DataFrame) -> DataFrame:
    """`fold` over a stream of (node_id, at, delta): the state of each touched node after each batch."""
    import math

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        s, at, n = state.get if state.exists else (BASE, -1, 0)
        rows = pd.concat(list(batches)).groupby("at", as_index=False)["delta"].sum().sort_values("at")
        for t, d in zip(rows["at"], rows["delta"], strict=True):
            days = max(0.0, (t - at) / DAY) if at >= 0 else 0.0
            s = min(HIGH, max(LOW, s * math.exp(-DECAY * days) + ALPHA * math.log1p(d)))
            at, n = int(max(at, t)), int(n + d)
        state.update((float(s), at, n))
        yield pd.DataFrame({"node_id": [key[0]], "current": [float(s)], "activations": [n], "last_seen": [at]})

    return touches.groupBy("node_id").applyInPandasWithState(run, "node_id string, current double, activations long, last_seen long", "s double, at long, n long", "update", "NoTimeout")
