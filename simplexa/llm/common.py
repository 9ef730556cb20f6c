"""What the corpus operators share: word scanning over Arrow buffers, hashes, shared-folder tables."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised pass takes at a time (a longer text is one pass).
CHUNK_BYTES = 1 << 20

#: Byte classes: True where a byte separates words.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

#: bytes.translate table that lower-cases A-Z only.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_rng = np.random.Generator(np.random.PCG64(20_240_601))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _GRAM = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_pow: dict[str, np.ndarray] = {}
#: Masks of the lowest 0 to 8 bytes.
_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
LONG_WORD = 128

#: Spark's setting that deletes an execution's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names, or a temporary one of this machine where none is named (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="simplexa-"))
        held = spark.sparkContext.getCheckpointDir()
    return held


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # the session may be gone by then; the folder is the cluster's to clean
        return


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 2000, short: bool = False) -> Iterator[None]:
    """Arrow batches of so many whole texts in what is run inside: both sides of the pipe hold a batch of each task.

    ``short`` rows, of a few numbers each, go in batches of exactly so many.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows if short or int(before) <= 0 else min(rows, int(before)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialise(df: DataFrame, name: str, hashes: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation. The
    shuffle files of the write go as soon as it has ended. The table is deleted
    by ``discard`` or when the driver's Python ends. Tables that are mostly ``hashes``
    are written without trying dictionaries of values.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/simplexa/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**{"parquet.enable.dictionary": "false"} if hashes else {}).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def materialise_hashes(df: DataFrame, name: str) -> DataFrame:
    return materialise(df, name, hashes=True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` from which nothing is still to be read."""
    for x in tables:
        _delete(x.sparkSession, x.scratch_path)


#: What operators keep in a Python worker between their tasks; workers are used again by other operators' tasks.
_kept: list[dict] = []


def kept_between_tasks() -> dict:
    """An empty table of large objects that stays in this worker until a task of another operator calls ``released``."""
    _kept.append({})
    return _kept[-1]


def released(own: dict | None = None) -> None:
    """Free what other operators' tasks keep in this worker, and give its freed memory back to the system."""
    others = [x for x in _kept if x and x is not own]
    for x in others:
        x.clear()
    if others:
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def parts(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """A batch in slices, for what holds a Python object for each row: the session sets how large batches are."""
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes (bijective), on a uint64 array."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling base and of its inverse, 0..n."""
    if "p" not in _pow or len(_pow["p"]) <= n:
        size = max(n + 1, CHUNK_BYTES * 2)
        for key, base in (("p", _BASE), ("i", _BASE_INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _pow[key] = np.multiply.accumulate(x)
    return _pow["p"], _pow["i"]


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, row offsets into them) of an Arrow string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield at, end, raw[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time; words of up to eight bytes never share one with each other.

    Words of over LONG_WORD bytes are hashed one by one (XXH3).
    """
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))
    size = ends - starts
    out = mix(eight[starts] & _LOW[np.minimum(size, 8)])
    at = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    done = 8
    while len(at):
        left = size[at] - done
        out[at] = mix(out[at] * _GRAM + (eight[starts[at] + done] & _LOW[np.minimum(left, 8)]) + left.astype(np.uint64))
        at, done = at[left > 8], done + 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes())
    return out


class Words:
    """The words of a chunk of texts: byte starts and ends, row bounds, and a 64-bit hash each."""

    __slots__ = ("buf", "starts", "ends", "first", "hashes")

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray, fold: bytes | None = None) -> None:
        raw = buf.tobytes()
        inside = np.frombuffer(raw.translate((~separators).tobytes()), bool)
        if fold is not None:
            buf = np.frombuffer(raw.translate(fold), np.uint8)
        self.buf = buf
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cuts = offsets[(offsets > 0) & (offsets < len(buf))]
        begins[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = word_hashes(buf, self.starts, self.ends)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on (those that run over a row's end are there, but mean nothing)."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        return gram_hash(self.hashes, k)


def gram_hash(hashes: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hash of every k consecutive entries."""
    n = len(hashes) - k + 1
    out = hashes[:n].copy()
    for i in range(1, k):
        out *= _GRAM
        out += hashes[i : i + n]
    return mix(out)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of length n that is True inside any [start, end)."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d)[:n] > 0


def by_id(docs: DataFrame) -> DataFrame:
    """doc_id as long and text only: other columns, whatever their names, don't travel."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
