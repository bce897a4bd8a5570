"""Shared-folder tables and skew-safe lookups."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Salts a lookup key can be spread over; one bit each in a LONG mask.
SALTS = 64


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, if they see that folder; a
    cluster that doesn't share it installs the package or gets it by `--py-files`."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment
    paths = known.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([p for p in paths if p] + [root])


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; a temporary one only where none is set and Spark is local (tests)."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="linkloom-"))
        found = sc.getCheckpointDir()
    return found


#: Folders that `shared_table` has written in this session.
_written: list[str] = []


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back: lineage ends there, and a
    lost executor costs only the tasks it was running."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What `make` gives as a shared table, when the tables that were written on the way are deleted."""
    before = len(_written)
    out = shared_table(make(), name)
    for folder in _written[before:-1]:
        _delete(spark, folder)
    _written[before:-1] = []
    return out


def drop_shared(df: DataFrame) -> None:
    """Delete the files behind a frame made by `shared_table` that nothing will read again."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/part-" not in folder:
            _delete(df.sparkSession, folder)


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def freed_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """Within, a query's shuffle files are deleted when it has ended, and not when the driver collects its garbage. For
    queries that end in a shared table; each reads its inputs anew."""
    return _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small_batches(spark: SparkSession, rows: int) -> AbstractContextManager[None]:
    """Within, Python workers get at most `rows` rows at a time, so that rows with long arrays or texts take little memory
    on either side. As `freed_shuffles`, for queries that end in a shared table."""
    return _set(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def salt_of(*cols: str) -> Column:
    """A row's salt, 0 to 63, from columns that differ between the rows of a hot key."""
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS)).cast("int")


def salt_mask(salt: Column) -> Column:
    """Aggregate: the set of salts that a key's rows use, as a bit mask."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), salt))


def salts_in(mask: Column) -> Column:
    """The salts of a mask, as an array: one element for a key with one row, 64 at most."""
    return F.filter(
        F.sequence(F.lit(0), F.lit(SALTS - 1)),
        lambda i: F.call_function("getbit", mask, i) == 1,
    )
