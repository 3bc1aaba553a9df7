"""Word tokens of Arrow text columns as numpy arrays.

A word is ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text, optionally with A-Z
lower-cased.  A batch's text is handled as one byte array: words are found by
a byte table and hashed with a polynomial over random byte values modulo 2**64
(prefix sums, so the cost is per byte, not per Python object).  Texts are cut
into slices of whole documents, so that memory follows the slice, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import SparkSession

U64 = np.uint64
#: Text bytes handled at once (a longer document is a slice of its own).
SLICE_BYTES = 1 << 19
#: Rows of an Arrow batch sent to a worker.
BATCH_ROWS = 500

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: For words without signs: all ASCII but letters and digits.
IS_SIGN = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds: documents can be very long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a finaliser of multiply and xor-shift steps)."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


class Hasher:
    """Polynomial hash of byte ranges; ``seed`` gives independent functions."""

    def __init__(self, seed: int = 0):
        rng = np.random.Generator(np.random.PCG64(7919 + seed))
        self.table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
        self.base = int(rng.integers(1 << 40, 1 << 60)) * 8 + 3
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                a = np.full(n, b, np.uint64)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=np.uint64))

    def ranges(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._powers(len(buf) + 1)
        c = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.table[buf] * self.up[: len(buf)], out=c[1:])
        h = (c[ends] - c[starts]) * self.down[starts]
        return mix(h + (ends - starts).astype(np.uint64))


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null text is an empty one."""
    a = batch.column(batch.schema.get_field_index(name))
    if a.null_count:
        a = a.fill_null("")
    wide = pa.types.is_large_string(a.type)
    if not wide and not pa.types.is_string(a.type):
        a = a.cast(pa.string())
    off = np.frombuffer(a.buffers()[1], np.int64 if wide else np.int32, len(a) + 1, a.offset * (8 if wide else 4)).astype(np.int64) if len(a) else np.zeros(1, np.int64)
    data = a.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about ``limit`` bytes."""
    buf, off = column(batch, name)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def spans(buf: np.ndarray, off: np.ndarray, gap: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of the first word of each row (one more at the end)."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    word = ~gap[buf]
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(word[:-1], out=first[1:])
    cuts = off[:-1][off[:-1] < off[1:]]
    first[cuts] = True
    first &= word
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(word[1:], out=last[:-1])
    last[cuts[1:] - 1] = True
    last &= word
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off).astype(np.int64)


_HASHERS: dict[int, Hasher] = {}


def hasher(seed: int = 0) -> Hasher:
    if seed not in _HASHERS:
        _HASHERS[seed] = Hasher(seed)
    return _HASHERS[seed]


def words(buf: np.ndarray, off: np.ndarray, lower: bool, seed: int = 0, gap: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the number of the first word of each row."""
    if lower:
        buf = LOWER[buf]
    starts, ends, first = spans(buf, off, gap)
    return hasher(seed).ranges(buf, starts, ends), first


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``k`` consecutive values (runs over row ends are the caller's to leave out)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    q = hasher(seed).base
    out, p = np.zeros(n, np.uint64), 1
    for j in range(k):
        out += h[j : j + n] * U64(p)
        p = p * q % (1 << 64)
    return mix(out)


def gram_rows(first: np.ndarray, k: int) -> np.ndarray:
    """Starts of the runs of ``k`` words that lie within a row."""
    n = int(first[-1])
    if n < k:
        return np.zeros(0, np.int64)
    last = np.repeat(first[1:], np.diff(first))  # of each word, the end of its row
    ok = np.arange(n) + k <= last
    return np.flatnonzero(ok)


def unsigned(a: np.ndarray) -> np.ndarray:
    """64-bit hashes as the signed integers Spark keeps."""
    return a.view(np.int64)
