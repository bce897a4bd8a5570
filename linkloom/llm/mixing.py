"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

1. Every document gets a size in words; sizes (not texts) are written once to the shared folder.
2. Sources, ordered by code point with null last, get the repeating `weights`; together they share
   `share` times all words. A target stops at `max_repeat` times its source's size and the excess is
   reshared by weight, which is a water level over the sorted ratio of cap to weight.
3. Targets become whole blocks of `block_words` words: seats go to the highest quotients
   target / (2k - 1). A divisor that cannot hand out too many seats settles all but at most one seat a
   source; only the quotients around the last seat are listed and ranked.
4. A source's blocks go to its shards the same way, with shard sizes as votes.
5. In a shard, documents lie on a line in seeded order, cut into equal blocks; the quota takes every
   block q div n times and a seeded, evenly spread set of q mod n blocks once more.

Defined results: null text has size 0; null source is a source of its own; empty tables give no rows;
repeated rows are documents of their own; a source without words has target 0. Other columns are
ignored. Only one table of sources and one of (source, shard) pairs pass through windows; documents
meet their quota by a join on (source, shard), of which no pair is hot while rows differ in id or, without an
id, in text: a row's place on the line comes from those. One id that very many rows repeat is one shard's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import WORD
from linkloom.shared import shared_table

#: Words a shard holds on average, and the number of shards at most (a grain of work, not a cut).
SHARD_WORDS, MAX_SHARDS = 65_536, 4_096


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """doc_id, source key, size and the seeded place of each document."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(source_col), F.lit("")).alias("src"),
        F.col(source_col).isNull().alias("no_src"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))))).alias("place"),
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, max_repeat: float) -> DataFrame:
    """One row a source: its size and the words it should give."""
    per = sizes.groupBy("no_src", "src").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy("no_src", "src")
    whole = Window.partitionBy(F.lit(1))
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"),
    )
    per = per.withColumns({"nth": F.row_number().over(order), "weight": weight})
    per = per.withColumns({"cap": F.lit(float(max_repeat)) * F.col("source_size"), "wanted": F.lit(float(share)) * F.sum("source_size").over(whole)})
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "nth").rowsBetween(Window.unboundedPreceding, -1)
    # The level if all sources before this one are full; the first that it doesn't fill sets the level.
    level = (F.col("wanted") - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))
    )
    per = per.withColumn("level", level)
    fits = F.col("level") <= F.col("cap") / F.col("weight")
    # Later sources' levels only fall, so the first level that fits is the largest of those that do.
    per = per.withColumn("level", F.max(F.when(fits, F.col("level"))).over(whole))
    return per.select("no_src", "src", "nth", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def sainte_lague(votes: DataFrame, party: list[str], district: list[str], vote: str, seats: str, order: list[str]) -> DataFrame:
    """Add `won`: the seats of each row by highest quotients of vote / (2k - 1) in its district.

    With divisor V / (N - P/2), rounding each vote cannot pass N seats; with V / (N + P/2) it cannot
    fall short. Quotients between the two, two a row on average, decide the rest; ties go by `order`.
    """
    w = Window.partitionBy(*district) if district else Window.partitionBy(F.lit(1))
    v, n = F.col(vote).cast("double"), F.col(seats)
    total, rows = F.sum(v).over(w), F.sum(F.when(v > 0, 1.0).otherwise(0.0)).over(w)
    sure = F.when(n > rows / 2, F.floor(v * (n - rows / 2) / total + 0.5)).otherwise(0)
    most = F.floor(v * (n + rows / 2) / total + 0.5) + 1
    known = votes.withColumns({"_sure": F.when(v > 0, F.greatest(sure - 1, F.lit(0))).otherwise(0).cast("long"), "_most": F.when((v > 0) & (n > 0), most).otherwise(0).cast("long")})
    known = known.withColumn("_left", n - F.sum("_sure").over(w))
    few = known.withColumn("_k", F.explode(F.sequence(F.col("_sure") + 1, F.greatest("_most", F.col("_sure") + 1))))
    rank = F.row_number().over(w.orderBy((v / (2 * F.col("_k") - 1)).desc(), *order))
    few = few.withColumn("_in", ((rank <= F.col("_left")) & (v > 0)).cast("long"))
    keep = [c for c in votes.columns if c not in {*party, *district}]
    keys = list(dict.fromkeys([*district, *party]))
    return few.groupBy(*keys).agg(*[F.first(c).alias(c) for c in keep], (F.first("_sure") + F.sum("_in")).alias("won"))


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    max_repeat: float = 2.0,
    block_words: int = 32,
    seed: int = 7,
) -> DataFrame:
    """doc_id, size, source, source_size, target and taken words of every document (see the module)."""
    sizes = shared_table(sized(docs, id_col, text_col, source_col, seed), "mix-sizes")
    words = sizes.agg(F.sum("size")).first()[0] or 0
    shards = min(MAX_SHARDS, max(1, -(-words // SHARD_WORDS)))
    sizes = sizes.withColumn("shard", F.pmod(F.conv(F.substring("place", 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int"))

    targets = source_targets(sizes, weights, share, max_repeat)
    seats = targets.withColumn("seats", F.round(F.sum("target").over(Window.partitionBy(F.lit(1))) / block_words).cast("long"))
    quotas = sainte_lague(seats, ["no_src", "src"], [], "target", "seats", ["nth"]).withColumnRenamed("won", "quota")

    key = ["no_src", "src", "shard"]
    parts = sizes.groupBy(*key).agg(F.sum("size").alias("part"))
    parts = parts.join(quotas, ["no_src", "src"])
    parts = sainte_lague(parts, ["shard"], ["no_src", "src"], "part", "quota", ["shard"])
    blocks = F.greatest(F.lit(1), F.round(F.col("part") / block_words)).cast("long")
    parts = parts.withColumn("blocks", blocks).withColumn("won", F.least("won", (F.lit(float(max_repeat)) * F.col("blocks")).cast("long")))
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "no_src", "src", "shard")), 1, 8), 16, 10).cast("long")
    parts = parts.select(*key, "source_size", "target", "part", "blocks", "won", F.pmod(start, F.col("blocks")).alias("start"))

    line = Window.partitionBy(*key).orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sizes.withColumn("end", F.sum("size").over(line)).withColumn("begin", F.col("end") - F.col("size"))
    met = placed.join(parts, key)
    # Block j covers words [j * part div blocks, (j + 1) * part div blocks) of the shard's line.
    edge = lambda j: F.call_function("div", j * F.col("part"), F.col("blocks"))
    turn = lambda j: F.call_function("div", (j + F.col("start")) * (F.col("won") % F.col("blocks")), F.col("blocks"))
    times = lambda j: F.call_function("div", F.col("won"), F.col("blocks")) + turn(j + 1) - turn(j)
    first = F.greatest(F.lit(0), F.call_function("div", F.col("begin") * F.col("blocks"), F.col("part")) - 1)
    last = F.least(F.col("blocks") - 1, F.call_function("div", F.col("end") * F.col("blocks"), F.col("part")) + 1)
    overlap = lambda j: F.greatest(F.lit(0), F.least(F.col("end"), edge(j + 1)) - F.greatest(F.col("begin"), edge(j)))
    taken = F.when(
        (F.col("size") > 0) & (F.col("won") > 0),
        F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), lambda a, j: a + overlap(j) * times(j)),
    ).otherwise(F.lit(0).cast("long"))
    return met.select(
        "doc_id",
        "size",
        F.when(~F.col("no_src"), F.col("src")).alias("source"),
        "source_size",
        "target",
        taken.alias("taken"),
    )
