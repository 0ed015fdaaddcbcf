"""What the operators need of the session: shared folders, degrees of parallelism, written tables."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where spark.checkpoint.dir is unset and the session is local, as in tests.
DEFAULT_SHARED = "/tmp/checkpoints"
#: Bytes of a query's input for which one shuffle partition is planned.
PART_BYTES = 16 << 20
#: Bytes of a batch of rows for a Python worker, and of a row group of a written table.
ARROW_BYTES, GROUP_BYTES = 8 << 20, 16 << 20
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see; see remove()."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        base = DEFAULT_SHARED
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def session(df: DataFrame) -> SparkSession:
    """The session of df, with batches for Python of at most ARROW_BYTES (a longer row is a batch of its own)."""
    spark = df.sparkSession
    if spark.conf.get(_ARROW) in ("64MB", "64m", str(64 << 20)):  # unless the user says otherwise
        spark.conf.set(_ARROW, str(ARROW_BYTES))
    return spark


def saved(df: DataFrame, folder: str) -> None:
    """Writes df in row groups of GROUP_BYTES, measured every few rows: a task holds one of them, and rows may be megabytes."""
    out = df.write.option("compression", "zstd").option("parquet.block.size", str(GROUP_BYTES))
    out.option("parquet.page.size.row.check.min", "4").parquet(folder)


def written(df: DataFrame, folder: str) -> DataFrame:
    """df as a written table: its lineage ends there, and a lost executor costs no recomputation."""
    with freed_shuffles(df.sparkSession):
        saved(df, folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of df, for scanned tables that of their files; 0 if it knows none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def parallelism(df: DataFrame) -> int:
    """Shuffle partitions for what is derived from df: the session's, or more if the input is large."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(df) // PART_BYTES)


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions inside go when each action ends."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


#: Keys that are joined by broadcast in `split_join`, at most.
HOT_KEYS = 100_000


def split_join(rows: DataFrame, about: DataFrame, key: list[str], size: str, how: str = "inner") -> DataFrame:
    """rows joined with about, a row a key whose column `size` counts the rows of that key.

    Keys of more than a HOT_KEYS-th of all rows are HOT_KEYS at most, whatever the input: their rows stay where they are
    and meet a broadcast of that bound; the rows of all other keys move to their keys."""
    total = about.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) > F.lit(max(1000, total // HOT_KEYS))
    few = F.broadcast(about.where(hot))
    rest = rows.join(F.broadcast(about.where(hot).select(*key)), key, "left_anti")
    return rows.join(few, key).unionByName(rest.join(about.where(~hot), key, how))


def remove(spark: SparkSession, *folders: str) -> None:
    """Deletes tables that nothing reads any more."""
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
