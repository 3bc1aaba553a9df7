"""Counting 64-bit keys over a whole corpus: sorted arrays, merged in tasks, shuffled as packed shards.

A task sums its keys and emits, for each shard, one row of packed keys and
counts.  A key therefore crosses the shuffle about once for each HELD keys of a
task, however frequent it is.  The number of shards follows the session's
shuffle partitions, so a shard is what one task of that session is meant to hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

COUNTED = "shard int, keys binary, counts binary"
#: Keys a task holds before it emits them.
HELD = 6 << 20


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at)


def tallied(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.diff(np.append(at, len(keys)))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def packed(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys: differences, byte by byte, compressed."""
    d = np.diff(keys.astype("<u8"), prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def packed_counts(counts: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpacked_counts(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class Tally:
    """Collects keys by shard; ``rows()`` gives out each shard's distinct keys and their counts."""

    def __init__(self, shards: int):
        self.shards, self.parts, self.held = shards, {}, 0

    def add(self, keys: np.ndarray, shard: np.ndarray | None = None):
        shard = shard_of(keys, self.shards) if shard is None else shard
        order = np.argsort(shard.astype(np.uint16 if self.shards <= 1 << 16 else np.uint32), kind="stable")
        keys, cuts = keys[order], np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            self.parts.setdefault(int(s), []).append(keys[cuts[s] : cuts[s + 1]])
        self.held += len(keys)
        if self.held > HELD:
            yield from self.rows()

    def rows(self):
        """Record batches of what is held."""
        held, self.parts, self.held = self.parts, {}, 0
        if held:
            got = {s: tallied(np.concatenate(parts)) for s, parts in sorted(held.items())}
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(got), pa.int32()), pa.array([packed(k) for k, _ in got.values()], pa.binary()), pa.array([packed_counts(c) for _, c in got.values()], pa.binary())],
                names=["shard", "keys", "counts"],
            )


def merged(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A shard's sorted keys and total counts."""
    keys = np.concatenate([unpacked(x) for x in group.column("keys").to_pylist()])
    counts = np.concatenate([unpacked_counts(x) for x in group.column("counts").to_pylist()])
    return summed(keys, counts)
