"""Incremental maintenance: diffs, publications, epochs, refresh, dedup, bounded logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def diff(before: DataFrame, after: DataFrame, key: str = "path", mark: str = "hash") -> DataFrame:
    """(key, change): added, modified, deleted or unchanged, from two manifests (key, mark)."""
    b, a = before.select(key, F.col(mark).alias("_b")), after.select(key, F.col(mark).alias("_a"))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "deleted").when(F.col("_a") == F.col("_b"), "unchanged").otherwise("modified")
    return b.join(a, key, "full").select(key, change.alias("change"))


def rewrite(base: DataFrame, replaced: DataFrame, changed: DataFrame, key: str = "path") -> DataFrame:
    """Base rows whose key isn't replaced (null keys stay), and the changed rows."""
    return base.join(replaced.select(key).distinct(), key, "left_anti").unionByName(changed)


def plan_mutations(current: DataFrame, published: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """What each repository's publication needs, from one row a repository (repo_id, revision), the same of
    what is published, and the fingerprints (repo_id, path, hash) then and now: `replace_all` without a
    publication, `clone_and_mutate` if files changed, else `noop` or, at another revision,
    `refresh_publication`; and how many files changed. All repositories are planned in one pass."""
    side = lambda df, c: df.select("repo_id", "path", F.struct("hash").alias(c))
    met = side(before, "_b").join(side(after, "_a"), ["repo_id", "path"], "full")
    changed = met.groupBy("repo_id").agg(F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("_changed"))
    out = current.select("repo_id", "revision").join(published.select("repo_id", F.struct("revision").alias("_old")), "repo_id", "left").join(changed, "repo_id", "left")
    n = F.coalesce("_changed", F.lit(0))
    same = F.when(F.col("_old.revision").eqNullSafe(F.col("revision")), "noop").otherwise("refresh_publication")
    action = F.when(F.col("_old").isNull(), "replace_all").when(n > 0, "clone_and_mutate").otherwise(same)
    return out.select("repo_id", "revision", action.alias("action"), n.alias("changed"))


def versioned_names(current: DataFrame, files: DataFrame, schema: int) -> DataFrame:
    """(repo_id, table_name): names that change with the revision, the schema or any file's fingerprint.
    Fingerprints are added up, so the order of files is of no matter and a large repository is no one
    task's work."""
    h = lambda seed: F.xxhash64(F.lit(seed), "path", "hash")
    marks = files.groupBy("repo_id").agg(F.count("*").alias("_n"), F.bit_xor(h(1)).alias("_x"), F.sum(h(2).cast("decimal(38,0)")).alias("_s"))
    body = F.concat_ws("|", "repo_id", F.coalesce("revision", F.lit("")), F.lit(str(schema)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("_n", "_x", "_s")])
    return current.join(marks, "repo_id", "left").select("repo_id", F.concat(F.lit("repo_"), F.substring(F.sha2(body, 256), 1, 24)).alias("table_name"))


def fingerprint(files: DataFrame) -> DataFrame:
    """One row (files, latest, bytes) over (path, mtime, size): equal rows need no rebuild."""
    return files.agg(F.count("*").alias("files"), F.max("mtime").alias("latest"), F.sum("size").alias("bytes"))


def seen_once(rows: DataFrame, text: str, order: list[Column]) -> DataFrame:
    """The first row of each content, whatever its address: identical content under a new URL is dropped."""
    w = Window.partitionBy("content_hash").orderBy(*order)
    return rows.withColumn("content_hash", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def refresh_edges(edges: DataFrame, changed: DataFrame, new_edges: DataFrame) -> DataFrame:
    """Links after notes (id) changed: theirs go, in both directions only if the other end changed too,
    and the new notes' links come: the result equals a rebuild."""
    kept = edges.join(changed.select(F.col("id").alias("src")), "src", "left_anti")
    return kept.select("src", "dst").union(new_edges.select("src", "dst")).distinct()


def bounded_log(rows: DataFrame, most: int, ttl: int, now: Column, order: list[Column], at: str) -> DataFrame:
    """The newest `most` rows not older than `ttl` seconds."""
    return rows.filter(F.col(at) >= now - ttl).orderBy(*order).limit(most)


class Epochs:
    """Published epochs of a corpus in a folder: `epoch=N` data folders, a manifest row a publication.
    A publication counts once its manifest is written; a lease with another fingerprint is refused."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.lease = spark, folder.rstrip("/"), {}

    def _manifest(self) -> DataFrame | None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return None
        return self.spark.read.schema("epoch int, fingerprint string, rows long").parquet(f"{self.folder}/manifest")

    def active(self) -> tuple[int, str] | None:
        m = self._manifest()
        row = m.orderBy(F.desc("epoch")).first() if m is not None else None
        return (row["epoch"], row["fingerprint"]) if row else None

    def begin(self, fingerprint: str) -> str:
        now = self.active()
        if now and now[1] == fingerprint:
            return "already_ready"
        if fingerprint in self.lease.values():
            return "already_indexing"
        self.lease = {(now[0] if now else 0) + 1: fingerprint}
        return "started"

    def publish(self, rows: DataFrame, fingerprint: str) -> int:
        epoch = next((e for e, f in self.lease.items() if f == fingerprint), None)
        if epoch is None:
            raise ValueError("stale lease")
        rows.write.mode("overwrite").parquet(f"{self.folder}/epoch={epoch}")
        n = self.spark.read.parquet(f"{self.folder}/epoch={epoch}").count()
        self.spark.createDataFrame([(epoch, fingerprint, n)], "epoch int, fingerprint string, rows long").coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        self.lease = {}
        return epoch

    def read(self) -> DataFrame:
        now = self.active()
        if now is None:
            raise LookupError("no epoch is published")
        return self.spark.read.parquet(f"{self.folder}/epoch={now[0]}")
