"""Shared plumbing: shared-storage tables, size-checked broadcasts, graph components, word scanning."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

#: Rows and bytes up to which a side may be broadcast; beyond them the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16_000_000
#: Folders that go when the application ends.
_folders: set[str] = set()


#: What Python workers remember between tasks, by the operator that fills it: how to forget it.
_memories: dict[str, Callable[[], None]] = {}


def remember(operator: str, forget: Callable[[], None]) -> None:
    """Register what an operator keeps in a worker between tasks."""
    _memories[operator] = forget


_last: list[str] = []


def focus(operator: str) -> None:
    """A worker that begins a task of one operator forgets what others kept in it, so their memory does not add up."""
    if _last != [operator]:
        powers.cache_clear()
        _last[:] = [operator]
    for name, forget in _memories.items():
        if name != operator:
            forget()


def give_back() -> None:
    """Freed memory of this process goes back to the system, where that is known how."""
    gc.collect()
    release()


def release() -> None:
    """What Arrow and the allocator keep of freed memory goes back to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


@lru_cache(maxsize=1)
def _trim():
    """glibc's way to give freed memory back, where there is one."""
    import ctypes

    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def trimmed(run):
    """A mapInArrow function whose worker gives memory back before and after the task, its tables of powers too."""

    def task(batches):
        release()
        yield from run(batches)
        powers.cache_clear()
        release()

    return task


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application under the one that all executors see: spark.checkpoint.dir, or where that is unset
    and all runs on one machine, one of our own. It goes when the application ends."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        at = f"file:///tmp/checkpoints/docmill-{os.getuid()}"
        spark.sparkContext.setCheckpointDir(at)
    at = f"{at.rstrip('/')}/docmill-{spark.sparkContext.applicationId}"
    if at not in _folders:
        _folders.add(at)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder: later stages survive lost executors without recomputing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _width(name: str, kind) -> Column:
    """Bytes of a column's value, about."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        return F.coalesce(F.octet_length(F.to_json(F.col(f"`{name}`"))), F.lit(0)) + 16
    return F.lit(8)


def small_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it is measured to have at most `rows` rows and BROADCAST_BYTES bytes, else df itself."""
    most = BROADCAST_ROWS if rows is None else rows
    width = sum((_width(f.name, f.dataType) for f in df.schema.fields), F.lit(0))
    got = df.limit(most + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("size")).first()
    return F.broadcast(df) if got.n <= most and got.size <= BROADCAST_BYTES else df


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of each node that has an edge: edges (a, b) -> (id, component); nodes that are their
    own component's smallest id are not listed.

    Alternates large-star and small-star steps, each an aggregate and a join (no node's neighbours meet in one
    task), until the edges no longer change, however many rounds that takes (about the square of the logarithm of the
    longest chain). An empty input gives an empty result; loops and repeats do not matter.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = now


# Word scanning over Arrow string buffers -------------------------------------------------------------------------

#: Bytes of text that one vectorised step handles (a longer document is handled alone).
STEP_BYTES = 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the result."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=3)
def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base, and of its inverse."""
    base = np.uint64(int(_BASE) + 8 * which)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    ones = np.ones(n, np.uint64)
    up, down = ones.copy(), ones.copy()
    up[1:], down[1:] = base, inverse
    return np.cumprod(up), np.cumprod(down)


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column; nulls are empty."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def steps(offsets: np.ndarray, size: int = STEP_BYTES):
    """Row ranges of about size bytes."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the white-space-delimited, A-Z-lowered words of some rows, and each row's first word's index."""
    base = int(offsets[0])
    raw = _LOWER[data[base : int(offsets[-1])]]
    rows = offsets - base
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(rows), np.int64)
    solid = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[rows] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | edge[1:-1]
    first, last = np.flatnonzero(start), np.flatnonzero(stop) + 1
    size = 1 << max(20, int(len(raw)).bit_length())
    up, down = powers(size)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    words = mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64) * _ODD)
    return words, np.searchsorted(first, rows)
