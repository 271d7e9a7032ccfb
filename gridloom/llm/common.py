"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import ctypes.util
import gc
import operator
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the corpus contracts: space, tab, newline, \v, \f, \r.
WORD = r"[^\x20\x09-\x0D]+"

_OWN: dict[str, str] = {}
#: The folder of the scratch block that is running.
_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is
    unset (tests on one machine), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="gridloom-")
    return _OWN[app]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, as texts take several times their size as Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    trim()


def trim() -> None:
    """Give back memory that a worker's allocators hold, as the worker waits for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    if libc and hasattr(found := ctypes.CDLL(libc), "malloc_trim"):
        found.malloc_trim(0)


def store(df: DataFrame, name: str, keep: bool = False) -> str:
    """Write df as Parquet to the shared folder; the path. keep: outside of a scratch block."""
    folder = None if keep else _SCRATCH.get()
    path = f"{folder or shared_dir(df.sparkSession)}/gridloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: the lineage ends there, and a
    lost executor costs a re-read."""
    return df.sparkSession.read.schema(df.schema).parquet(store(df, name, keep))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stored within is deleted at the end, but for what is marked to be kept."""
    folder = f"{_SCRATCH.get() or shared_dir(spark)}/gridloom-scratch-{uuid.uuid4().hex}"
    before = _SCRATCH.set(folder)
    try:
        yield
    finally:
        _SCRATCH.reset(before)
        remove(spark, folder)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def rekeyed(key: Column | str) -> Column:
    """The same key as an expression of its own. Where an aggregate's result is joined on its key, Spark
    joins it as it lies; only a join that shuffles both sides is split at run time where a key is hot, and
    for a new expression it shuffles this (small) side too."""
    return F.greatest(key, key)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once; in a lambda, expressions are worked out at every mention."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine: Callable[[Column, Column], Column] = operator.add, chunk: int = 256) -> Column:
    """Of an array of non-negative ints, what all that come before each combine to (sum or maximum), as
    longs; 0 for the first.

    A plain fold copies its result at every step; in chunks the cost stays close to linear."""
    zero = F.lit(0).cast("long")

    def before(parts: Column) -> Column:
        start = F.struct(zero.alias("sum"), F.expr("cast(array() as array<bigint>)").alias("out"))
        return F.aggregate(parts, start, lambda acc, v: F.struct(combine(acc["sum"], v).alias("sum"), F.array_append(acc["out"], acc["sum"]).alias("out")), lambda acc: acc["out"])

    def in_chunks(all_values: Column) -> Column:
        last = F.greatest(F.ceil(F.size(all_values) / chunk) - 1, F.lit(0)).cast("int")
        return let(F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(all_values, k * chunk + 1, F.lit(chunk))), from_parts)

    def from_parts(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, zero, lambda a, v: combine(a, v)))
        return let(before(sums), lambda at: F.flatten(F.transform(parts, lambda p, k: let(F.get(at, k), lambda start: F.transform(before(p), lambda v: combine(v, start))))))

    return let(values, in_chunks)


def remainder(doc_id: Column | str, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % divisor


def hash_sample(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """At most `limit` rows, those with the smallest hashes of the key.

    A threshold on the hash leaves about twice as many before any are sorted, so that what meets in one
    task is bounded as well, however many rows there are."""
    share = min(1.0, 2 * limit / max(rows.count(), 1))
    below = F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30))
    return rows.where(below).orderBy(F.xxhash64(F.lit(1), key), key, *[c for c in rows.columns if c != key]).limit(limit)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, divisor: int, held_out: int, limit: int) -> DataFrame:
    """At most `limit` rows (doc_id, text, label) to learn from: those whose remainder isn't
    `held_out`, with a label of 0 or 1, in the order of a hash of their ids.

    The ids are bounded by `limit`, so they are broadcast; the texts are read where they lie."""
    usable = labels.where(F.col(label).isin(0, 1) & (remainder("doc_id", divisor) != held_out) & F.col("doc_id").isNotNull())
    chosen = hash_sample(usable.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label")), "_id", limit)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label")
