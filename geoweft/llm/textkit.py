"""Vectorised text primitives on Arrow string buffers: words, lines and 64-bit hashes.

Everything works on whole texts. Texts are taken in blocks of a few MB, so the memory of a
task depends on the block size and on its longest text only.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Bytes of text handled at a time.
BLOCK_BYTES = 2 << 20
#: Rows with texts that cross to Python at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Spans of up to so many bytes are hashed by lanes of eight bytes, longer ones one by one.
_SHORT = 64
#: Spans hashed at a time, so that scratch memory stays in the processor's cache.
_STEP = 1 << 14
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """The same frame; whole texts, whose size is open, cross to Python in batches of BATCH_ROWS rows and BATCH_BYTES at most."""
    conf = df.sparkSession.conf
    for key, most in (("Records", BATCH_ROWS), ("Bytes", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.max{key}PerBatch"
        if not 0 < int(conf.get(key).rstrip("bB")) <= most:
            conf.set(key, most)
    return df


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    def _trim(_):
        return 0


def give_back() -> None:
    """Return freed scratch memory to the system; workers are reused by later stages."""
    _trim(0)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of an Arrow string column; null is empty."""
    give_back()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or one row."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; makes a copy."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of any byte ranges; they depend on the bytes alone.

    Every lane passes the finaliser before the next one enters, so no structure of the bytes
    (as in Thue-Morse strings) makes different ranges meet.
    """
    padded = np.zeros((len(data) + 16 + 7) // 8 * 8, np.uint8)
    padded[: len(data)] = data
    lanes = padded.view("<u8")
    size = ends - starts
    out = np.empty(len(starts), U64)
    for a in range(0, len(starts), _STEP):
        s, n = starts[a : a + _STEP], size[a : a + _STEP]
        h = n.astype(U64) * U64(0x9E3779B97F4A7C15)
        for k in range(0, min(_SHORT, int(n.max(initial=0))), 8):
            at = slice(None) if k == 0 else np.flatnonzero(n > k)
            place, left = s[at] + k, n[at] - k
            word, turn = place >> 3, ((place & 7) << 3).astype(U64)
            v = lanes[word] >> turn
            v |= (lanes[word + 1] << U64(1)) << (U64(63) - turn)
            v &= _MASKS[np.minimum(left, 8)]
            v ^= h[at]
            h[at] = mix(v)
        out[a : a + _STEP] = h
    long = np.flatnonzero(size > _SHORT)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        out[long] = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)), U64, len(long))
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words [^\\x20\\x09-\\x0D]+ of each text of a block."""
    n = len(data)
    if n == 0:
        e = np.zeros(0, np.int64)
        return e, e, e
    inside = ~_IS_SPACE[data]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:] = ~inside[:-1]
    after[:-1] = ~inside[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[first] = True
    after[first[1:] - 1] = True
    starts = np.flatnonzero(inside & before)
    ends = np.flatnonzero(inside & after) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def run_spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of True."""
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def ngram_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive word hashes: entry i covers i .. i + k - 1."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out *= U64(0xD6E8FEB86659FD93)
        out += words[j : j + n]
    return mix(out)


def per_row(rows: np.ndarray, n: int, weights=None) -> np.ndarray:
    return np.bincount(rows, weights, n).astype(np.int64) if len(rows) else np.zeros(n, np.int64)


def pick(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))
