"""Shared kernels of the subpackage: Arrow batches, word hashes, shingle sets, written tables.

Everything here works on whole texts.  Text is cut into segments of whole documents only to bound
the memory of the numpy kernels; a document longer than a segment is a segment of its own.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SEGMENT_BYTES = 1 << 19

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240229)
#: One random odd 64-bit value for each byte; a word's hash is a polynomial in BASE over them.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE[_LOWER]
_BASE = 0x9E3779B97F4A7C13 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_PLACE = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** (0 .. n-1) modulo 2**64, kept and doubled on demand."""
    have = _powers.get(base)
    if have is None:
        have = np.ones(1, dtype=np.uint64)
    while len(have) < n:
        step = np.uint64(pow(base, len(have), 2**64))
        have = np.concatenate([have, have * step])
    _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets of a string column, without a copy; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def segments(data: np.ndarray, offs: np.ndarray, limit: int = SEGMENT_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, of one row at least."""
    at, n = 0, len(offs) - 1
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


def word_hashes(data: np.ndarray, offs: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words ``[^\\x20\\x09-\\x0D]+`` of a segment, and each row's word offsets."""
    n_rows = len(offs) - 1
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(n_rows + 1, np.int64)
    solid = ~_WHITE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offs[(offs > 0) & (offs < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * _power(_BASE, len(data)), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _power(_BASE_INV, len(data))[starts]
    return mix(hashes), np.searchsorted(starts, offs).astype(np.int64)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of one row's shingles in text order; fewer words than ``size`` make one shingle."""
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    n = max(len(words) - size + 1, 1)
    size = min(size, len(words))
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total += words[k : k + n] * _PLACE[k]
    return mix(total)


class Permutations:
    """Universal hash functions ``(a * x + b) >> 32`` over 64-bit shingle hashes."""

    def __init__(self, count: int, seed: int):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
        self.b = rng.integers(0, 2**63, count, dtype=np.uint64)[:, None]
        self.count = count

    def minima(self, shingles: np.ndarray, block: int = 2048) -> np.ndarray:
        """The least value of each function over the shingles (uint32); all ones for no shingle."""
        least = np.full(self.count, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(shingles), block):
            part = (shingles[None, at : at + block] * self.a + self.b) >> np.uint64(32)
            np.minimum(least, part.min(axis=1).astype(np.uint32), out=least)
        return least


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 modulo 4; such rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


BATCH_BYTES = "4m"  # of an Arrow batch, of one row at least
_WHOLE = "67108864b"


def frugal(spark: SparkSession) -> None:
    """Bounds Arrow batches of the session by bytes, unless the session has a bound of its own: rows hold whole texts and sets, which may be long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, _WHOLE) == _WHOLE:
        spark.conf.set(key, BATCH_BYTES)


def release() -> None:
    """Gives freed memory back to the system: a worker waits for its next task as small as it can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def arrow_map(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes, after which the worker gives its memory back."""
    frugal(df.sparkSession)

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(tidy, schema)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names.  Only a session within one machine (``local``) may lack the setting; it gets a folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class Workspace:
    """Written tables in the shared folder, which cut the lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        frugal(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
        self.count = 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._written_at = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Deletes written tables that nothing refers to any more."""
        for t in tables:
            if t is not None and (path := getattr(t, "_written_at", None)):
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(doc_id, text, y) of at most ``limit`` labelled rows that may be learned from.

    The rows are those with the least hash of the id, so the choice does not depend on the order or
    the partitions of the input.  A document with several labels has the greatest; of a repeated id the text that
    sorts first is taken, so that there are never more rows than ``limit``.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y is not null and doc_id is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(known), "doc_id")  # ``limit`` rows of two numbers at most
    # of an id that is repeated the least text counts; a partial aggregate leaves a row an id and task before the shuffle
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))
