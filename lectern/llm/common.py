"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Bytes that separate words, ``[\\x20\\x09-\\x0D]``. Bytes of multi-byte characters never fall in this range.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Lower-casing of A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame``, with its equivalent SQL if there is one."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return wrap


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a folder, by whatever path Spark's readers understand."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct ``row``, so that names used on the way can't clash with theirs."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")


def texts_of(column: pa.Array) -> list[str]:
    """A string column as Python strings; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one byte array and its n + 1 offsets; null is the empty text."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of about ``most`` bytes (a longer row is a run of its own)."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijective scrambling of unsigned 64-bit integers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random64(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit integers."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(n, dtype=np.uint64) + np.uint64(seed + 1)) * np.uint64(0x9E3779B97F4A7C15))


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of rows with equal first ``keys`` columns (null-free) of a sorted stream, one run in memory at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_pylist() for i in range(keys)]
        own = list(zip(*columns))
        start = 0
        for i, key in enumerate(own):
            if key != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, last, start = [], key, i
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


class Learnt(dict):
    """Values by key as a worker learns them: two generations, the newer of at most ``most`` bytes.

    When the newer one is full it becomes the older one, whose keys come back as they are asked for again, so what is
    frequent stays. Keys beyond 200 bytes are not kept.
    """

    def __init__(self, learn: Callable, most: int = 32 << 20):
        self.learn, self.most, self.used, self.old = learn, most, 0, {}
        super().__init__()

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.learn(key)
        cost = sys.getsizeof(key) + sys.getsizeof(value) + 100
        if cost <= 2_000:
            if self.used + cost > self.most:
                self.old = dict(self)
                self.clear()
                self.used = 0
            self.used += cost
            self[key] = value
        return value


_worker: dict[str, object] = {}


def give_back() -> None:
    """Return memory that this worker no longer uses to the system, since workers outlive tasks and stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the C library of Linux has it
        ctypes.CDLL(None).malloc_trim(0)


def worker_held(name: str, make: Callable):
    """What a worker process keeps between the tasks of one operator; another operator's takes its place, and the memory
    that the former one had goes back to the system."""
    if name not in _worker:
        if _worker:
            _worker.clear()
            give_back()
        _worker[name] = make()
    return _worker[name]


def keeping_nothing(run: Callable) -> Callable:
    """``run`` over the batches of a task, for operators that keep nothing in their workers: what a former one kept goes
    before, what the task took goes after it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_held("nothing", dict)
        try:
            yield from run(batches)
        finally:
            give_back()

    return task
