"""Tables kept between jobs: on executors with their lineage, or written to the folder that all executors share."""

from __future__ import annotations

import contextlib
import math
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Links or labels in a file of a table that loops write.
ROWS_PER_FILE = 1 << 20
_scopes: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where that is unset, a folder of our own on a local master (tests); an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = spark.sparkContext.getCheckpointDir()
        found = kept.rsplit("/", 1)[0] if kept else None
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docaudit-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _owned(df: DataFrame) -> DataFrame:
    if _scopes.get():
        _scopes.get()[-1].append(df)
    return df


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Tables that operators keep inside go at its end: written ones are deleted, persisted ones released.

    What an operator returns reads its tables lazily, so write the result inside the scope with materialize(.., keep=True).
    Without a scope the tables belong to the caller, who clears the shared folder and spark.catalog.clearCache().
    """
    mine: list[DataFrame] = []
    token = _scopes.set((*_scopes.get(), mine))
    try:
        yield
    finally:
        _scopes.reset(token)
        for df in mine:
            discard(df)


#: How rows of a megabyte are written: sizes are looked at after each row, and nothing is compressed twice.
BLOBS = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size": str(1 << 24), "parquet.enable.dictionary": "false", "compression": "none"}
#: What lets the engine delete the shuffle files of a query once it has ended.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, rows: int | None = None, keep: bool = False, blobs: bool = False, clean: bool = False) -> DataFrame:
    """Writes df once as Parquet in the shared folder and returns the table read back from there.

    Where about how many rows there are is known, they are dealt to files of ROWS_PER_FILE; the stages before run in all their tasks.
    clean: what was shuffled for them is deleted as soon as they are written. blobs: so it is, and rows are large and compressed.
    """
    path, spark = new_path(df.sparkSession, name), df.sparkSession
    before = spark.conf.get(FILE_CLEANUP, "false")
    spark.conf.set(FILE_CLEANUP, "true" if clean or blobs else before)
    try:
        (df if rows is None else df.repartition(blocks(rows, ROWS_PER_FILE))).write.options(**(BLOBS if blobs else {})).parquet(path)
    finally:
        spark.conf.set(FILE_CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out if keep else _owned(out)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Computes df once and keeps it on the executors' disks, with its lineage: what a lost executor held is computed again.

    For tables that one call reads several times, outside loops (whose plans would grow). A write of a table costs a file and
    its commit a partition, which for many small tables is dearer than the tables.
    """
    spark = df.sparkSession
    spark.sparkContext.setJobDescription(name)
    out = df.persist(StorageLevel.DISK_ONLY)
    out.count()
    spark.sparkContext.setJobDescription(None)
    return _owned(out)


def discard(df: DataFrame) -> None:
    """Deletes a table of materialize(), or releases one of stored(), that nothing will read any more."""
    spark, path = df.sparkSession, getattr(df, "_written_at", None)
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    else:
        df.unpersist()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks(rows: int, per_block: int) -> int:
    return max(1, math.ceil(rows / per_block))


def join_apart(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined with right, which has been grouped by the long column key.

    The key is complemented and complemented again, so that the join does not take over the grouping's partitions: it gets an
    exchange of its own on either side, which the engine can split for a hot key.
    """
    other = free_name(left, f"not_{key}")
    flipped = right.select(F.bitwise_not(F.col(key)).alias(other), *[c for c in right.columns if c != key])
    return left.join(flipped.hint("merge"), F.col(key) == F.bitwise_not(F.col(other)), how).drop(other)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name in df.columns:
        name += "_"
    return name
