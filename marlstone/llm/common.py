"""What the operators of this subpackage share: Arrow plumbing and hashing."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python task works on at once, and the bytes that they have together; a longer row is a slice of its own.
SLICE, SLICE_BYTES = 256, 1 << 19
#: Bytes of an Arrow batch between Spark and Python, where the session leaves Spark's own default of 64 MB.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors that start outside its folder; the second time, that is left as it is.

    A session whose Arrow batches have Spark's default size gets batches of BATCH_BYTES: texts are long.
    """
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if (spark.conf.get(size, None) or "").rstrip("b") == str(64 << 20):
        spark.conf.set(size, str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_marlstone_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.join(os.path.realpath(tempfile.mkdtemp()), "marlstone_code.zip")
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(name)
    sc._marlstone_shipped = True


def slices(batch: pa.RecordBatch, rows: int, limit: int) -> Iterator[pa.RecordBatch]:
    """`batch` in consecutive slices of at most `rows` rows and `limit` bytes of variable width, or of one row."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        kind = column.type
        if pa.types.is_string(kind) or pa.types.is_binary(kind):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(kind):
            size += 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + limit, "right"))))
        yield batch.slice(at, end - at)
        at = end


def hand_back() -> None:
    """Give memory that is free but kept back to the system: a worker that is used again starts its next task small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, rows: int = SLICE, limit: int = SLICE_BYTES) -> DataFrame:
    """df.mapInArrow over slices of at most `rows` rows and `limit` bytes. `make` runs once a task and returns the function of a slice."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in slices(batch, rows, limit):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out
        hand_back()

    return df.mapInArrow(run, schema)


def fresh(name: str, taken: list[str]) -> str:
    """`name`, with underscores before it until no column of `taken` is called so."""
    while name.lower() in {t.lower() for t in taken}:
        name = "_" + name
    return name


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n. Null for a null doc_id."""
    return F.crc32(doc_id.cast("string")) % n


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, all else kept."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@functools.cache
def mixer(seed: int) -> np.ndarray:
    """256 odd random 64-bit values, one a byte."""
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined_utf8(texts: list[str | None], end: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each followed by `end`, and the offset at which each begins (one more at the end)."""
    parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + len(end) for p in parts], out=starts[1:])
    return np.frombuffer(end.join(parts) + end if parts else b"", np.uint8), starts


def ngram_hashes(data: np.ndarray, n: int, seed: int) -> np.ndarray:
    """64-bit hash of the n bytes from each position on; len(data) - n + 1 of them."""
    if len(data) < n:
        return np.zeros(0, np.uint64)
    table = mixer(seed)
    out = table[data[: len(data) - n + 1]]
    for j in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + table[data[j : len(data) - n + 1 + j]]
    return mix64(out)
