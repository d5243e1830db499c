"""What several operators need: materialised tables, batches, settings."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: A key of more than one row in HOT, and of more than LEAST_HOT rows, is joined by broadcast.
HOT, LEAST_HOT = 1000, 1000


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir, else the context's checkpoint folder).

    Where neither is set, a local session, as in tests, gets a temporary folder; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pathloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/pathloom-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[list[str]] = []


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """Shuffle files of what is executed inside go when it ends; otherwise they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def written(df: DataFrame) -> DataFrame:
    """df, computed once and kept as a Parquet table in the shared folder, until discard() or the end of the application."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    with _shuffles_removed(spark):
        df.write.parquet(path)
    files, where = _files(spark, path)
    files.deleteOnExit(where)
    for made in _made:
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.held = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that written() made; nothing may read them any more."""
    for t in tables:
        _delete(t.sparkSession, t.held)


def _delete(spark: SparkSession, path: str) -> None:
    files, where = _files(spark, path)
    files.delete(where, True)
    files.cancelDeleteOnExit(where)


@contextmanager
def passing(spark: SparkSession):
    """Tables written inside are deleted at the end, but for those taken out of the list that it gives."""
    made: list[str] = []
    _made.append(made)
    try:
        yield made
    finally:
        _made.remove(made)
        for path in made:
            _delete(spark, path)


def join_counted(left: DataFrame, right: DataFrame, key: str, n: str = "n") -> DataFrame:
    """left joined with right, a written table with a row for each key and how many rows of left (n) have it.

    Keys that very many rows have are few, and are joined by broadcast, so that no task gathers one.
    """
    limit = max(LEAST_HOT, (right.agg(F.sum(n)).first()[0] or 0) // HOT)
    hot = right.filter(F.col(n) > limit)
    if hot.isEmpty():
        return left.join(right, key)
    marked = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    rest = marked.filter("_hot IS NULL").select(*left.columns).join(right.filter(F.col(n) <= limit), key)
    return marked.filter("_hot").drop("_hot").unionByName(rest)


def release() -> None:
    """Give memory that is free in this process back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def lean(run):
    """run, a function for mapInArrow, that leaves no free memory behind.

    Spark's Python workers go on to other tasks; what one task needed would otherwise stay with each of them for good.
    """

    def released(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return released


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def kept(keep: tuple[str, ...], made: list[str]) -> tuple[str, ...]:
    """keep without the names in made: a kept column gives way to a result of its name, in any case of letters."""
    taken = {m.lower() for m in made}
    return tuple(c for c in keep if c.lower() not in taken)


def packed(df: DataFrame) -> Column:
    """The whole row as one struct, so that no column of it can meet another of its name."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def by_text(docs: DataFrame, *more: str, text_col: str = "text") -> DataFrame:
    """The text (null: empty) as _text with a 96-bit key (_t, _u) of it, and the columns in more.

    Equal texts have equal keys: results that depend on the text alone are joined on it, which
    needs no unique ids and meets repeated rows and null ids.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(*more, text.alias("_text"), F.xxhash64(text).alias("_t"), F.hash(text).alias("_u"))


def arrow_schema(df_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df_schema)
