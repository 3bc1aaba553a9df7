"""Substring dedup: words in windows that an earlier document also has.

Every window of WINDOW words has an anchor, the least hash among its runs of
ANCHOR words: equal windows have equal anchors.  Only anchors that occur in two
documents can belong to a repeated window, and they are found first from their
hashes alone.  Runs of windows with one such anchor are segments.  The segments of
an anchor meet in one shard, which holds them as a compressed FM-index; backward
search over its wavelet matrix finds where each window of the streamed segments
occurs, and the least document there.  A document's words under windows with a
lower least document than itself go.

What a hot passage needs is bounded: a bucket of documents sends each distinct
segment once, with its least document, however many of its documents share it.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import partitions, register, stored, table, texts
from .counts import packed, shard_of, unpacked
from .fm_index import FMIndex

WINDOW, ANCHOR = 13, 4
#: Buckets of documents, and indexes, for each shuffle partition: what one of them holds is that much smaller.
BUCKETS_EACH, INDEXES_EACH = 2, 4
#: Windows searched at once.
PATTERNS = 1 << 16
#: Anchors a task holds before it gives them out.
HELD = 2 << 20
NEVER = np.iinfo(np.int64).max


def anchors(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one row, and their anchors."""
    at = W.gram_rows(first, WINDOW)
    low = W.grams(h, ANCHOR)
    need = WINDOW - ANCHOR + 1  # runs in a window
    width = 1
    while 2 * width <= need:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    if width < need:
        low = np.minimum(low[: len(low) - (need - width)], low[need - width :])
    return at, low[at]


def runs(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of consecutive windows with one anchor: first window, number of windows, anchor."""
    at, low = anchors(h, first)
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64)
    row = np.searchsorted(first, at, "right")
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (row[1:] != row[:-1])])
    begin = np.flatnonzero(new)
    return at[begin], np.diff(np.append(begin, len(at))), low[begin]


def segment_keys(h: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64-bit hash of each run's word sequence."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    q = W.hasher(1)
    q._powers(len(h) + 1)
    c = np.concatenate([[np.uint64(0)], np.cumsum(h * q.up[: len(h)], dtype=np.uint64)])
    end = begin + n + WINDOW - 1
    return W.mix((c[end] - c[begin]) * q.down[begin] + n.astype(np.uint64))


def spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], ..., begin[0] + n[0] - 1, begin[1], ..."""
    total = np.concatenate([[0], np.cumsum(n)])
    return np.repeat(begin - total[:-1], n) + np.arange(total[-1])


def _pack(data: bytes) -> bytes:
    return zstandard.compress(data, 1)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def shared_anchors(docs: DataFrame, shards: int, buckets: int) -> DataFrame:
    """Anchors that occur in two documents, for each bucket of documents that has them: bucket, anchors."""

    def find(batches):
        held: list = []
        size = 0

        def rows():
            ids, low = (np.concatenate(x) for x in zip(*held, strict=True))
            shard = shard_of(low, shards)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            full = np.flatnonzero(np.diff(cuts))
            part = [order[cuts[s] : cuts[s + 1]] for s in full]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([low[p].astype("<u4").tobytes() for p in part], pa.binary()), pa.array([packed(ids[p].view(np.uint64)) for p in part], pa.binary())], names=["shard", "low", "ids"])

        for batch in batches:
            own = batch.column(0).to_numpy()
            for lo, hi, buf, off in W.slices(batch, "text"):
                h, first = W.words(buf, off, lower=False)
                begin, _, low = runs(h, first)
                held.append((own[lo:hi][np.searchsorted(first, begin, "right") - 1], low))
                size += len(low)
                if size > HELD:
                    yield rows()
                    held, size = [], 0
        if size:
            yield rows()

    def repeated(group: pa.Table) -> pa.Table:
        low = np.frombuffer(b"".join(group.column("low").to_pylist()), "<u4")
        ids = np.concatenate([unpacked(x).view(np.int64) for x in group.column("ids").to_pylist()])
        order = np.argsort(low, kind="stable")
        low, ids = low[order], ids[order]
        at = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        two = np.minimum.reduceat(ids, at) != np.maximum.reduceat(ids, at)
        keep = np.repeat(two, np.diff(np.append(at, len(low))))
        low, to = low[keep], bucket_of(ids[keep], buckets)
        pair = np.unique(to.astype(np.uint64) << np.uint64(32) | low)
        to, low = (pair >> np.uint64(32)).astype(np.int64), pair.astype(np.uint32)
        cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
        shard = group.column("shard")[0].as_py()
        ends = np.append(cuts[1:], len(to))[: len(cuts)]
        return pa.table(
            {"bucket": pa.array(to[cuts], pa.int32()), "shard": pa.array([shard] * len(cuts), pa.int32()), "low": pa.array([low[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())}
        )

    seen = texts(docs).where("doc_id is not null").mapInArrow(find, "shard int, low binary, ids binary")
    return seen.groupBy("shard").applyInArrow(repeated, "bucket int, shard int, low binary")


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (W.mix(ids.view(np.uint64).copy()) >> np.uint64(33)).astype(np.int64) % buckets


def search(group: pa.Table) -> pa.Table:
    """A shard's segments against its FM-index.

    For each bucket the segments whose windows do not all have the bucket's own
    least document: their keys, numbers of windows, and the windows' least documents.
    """
    buckets = group.column("bucket").to_pylist()
    keys, least, n, words = ([_unpack(x, kind) for x in group.column(name).to_pylist()] for name, kind in (("keys", "<u8"), ("least", "<i8"), ("windows", "<u4"), ("words", "<u4")))
    source = np.repeat(buckets, [len(k) for k in keys])
    keys, least, n, words = (np.concatenate(x) for x in (keys, least, n, words))
    n = n.astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(n + WINDOW - 1)[:-1]])
    _, one, back = np.unique(keys, return_index=True, return_inverse=True)
    lowest = np.full(len(one), NEVER, np.int64)
    np.minimum.at(lowest, back, least)

    # the distinct segments, each closed by symbol 0
    size = n[one] + WINDOW - 1
    alphabet, code = np.unique(words, return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.zeros(start[-1], np.int64)
    text[spread(start[:-1], size)] = code[spread(begin[one], size)] + 1
    index = FMIndex(text, len(alphabet) + 1)

    # each distinct window once, neighbours in the index together
    at = spread(start[:-1], n[one])
    mark = W.grams(text.view(np.uint64), WINDOW)[at]
    _, some, of = np.unique(mark, return_index=True, return_inverse=True)
    where = at[some]
    order = np.lexsort(tuple(text[where + WINDOW - k] for k in (3, 2, 1)))
    low, high = np.empty(len(some), np.int64), np.empty(len(some), np.int64)
    for k in range(0, len(order), PATTERNS):
        part = order[k : k + PATTERNS]
        low[part], high[part] = index.search(text[where[part][:, None] + np.arange(WINDOW)])

    # a window's suffixes lie in no other window's range: least document by range
    owner = np.repeat(np.append(lowest, NEVER), np.append(size + 1, 1))[np.append(index.order, len(text))]
    by = np.argsort(low)
    bounds = np.empty(2 * len(by), np.int64)
    bounds[::2], bounds[1::2] = low[by], high[by]
    found = np.empty(len(by), np.int64)
    found[by] = np.minimum.reduceat(owner, bounds)[::2]
    found = found[of]

    first = np.concatenate([[0], np.cumsum(n[one])])
    lowest_window, highest_window = np.minimum.reduceat(found, first[:-1]), np.maximum.reduceat(found, first[:-1])
    send = np.flatnonzero((lowest_window[back] != least) | (highest_window[back] != least))
    send = send[np.argsort(source[send], kind="stable")]
    cuts = np.flatnonzero(np.concatenate([[True], source[send][1:] != source[send][:-1]])) if len(send) else np.zeros(0, np.int64)
    out = []
    for a, b in zip(cuts, np.append(cuts[1:], len(send)), strict=False):
        part = send[a:b]
        got = found[spread(first[back[part]], n[part])]
        out.append((int(source[part[0]]), _pack(keys[part].tobytes()), _pack(n[part].astype("<u4").tobytes()), _pack(got.astype("<i8").tobytes())))
    cols = list(zip(*out, strict=True)) or [(), (), (), ()]
    return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "keys", "windows", "least"])


class Bucket:
    """A bucket's documents, their words and runs."""

    def __init__(self, docs: pa.Table):
        unpack = zstandard.ZstdDecompressor()
        self.raw = [unpack.decompress(x) for x in docs.column("packed").to_pylist()]
        self.null = np.array(docs.column("doc_id").is_null())
        self.ids = docs.column("doc_id").combine_chunks().fill_null(0).to_numpy()

    def slices(self):
        """(first document, word hashes, first words, begin, windows, anchor of the runs)"""
        batch = pa.RecordBatch.from_arrays([pa.array(self.raw, pa.large_binary()).view(pa.large_string())], names=["text"])
        for lo, hi, buf, off in W.slices(batch, "text"):
            h, first = W.words(buf, off, lower=False)
            begin, n, low = runs(h, first)
            ok = ~self.null[lo:hi][np.searchsorted(first, begin, "right") - 1]
            yield lo, h, first, begin[ok], n[ok], low[ok]


def segments(shards: int):
    def cut(docs: pa.Table, shared: pa.Table) -> pa.Table:
        """The distinct segments of a bucket that have shared anchors, by shard."""
        bucket = None
        known: dict[int, np.ndarray] = {}
        for b, s, low in zip(*(shared.column(c).to_pylist() for c in ("bucket", "shard", "low")), strict=True):
            bucket, known[s] = b, np.frombuffer(low, "<u4")
        keys, least, n, words, shard = [], [], [], [], []
        if known and docs.num_rows:
            there = np.sort(np.concatenate([k.astype(np.uint64) | np.uint64(s << 32) for s, k in known.items()]))
            own = Bucket(docs)
            for lo, h, first, begin, count, low in own.slices():
                s = shard_of(low, shards)
                mark = s.astype(np.uint64) << np.uint64(32) | low & np.uint64(0xFFFFFFFF)
                hit = there[np.minimum(np.searchsorted(there, mark), len(there) - 1)] == mark
                begin, count, s = begin[hit], count[hit], shard_of(low[hit], INDEXES_EACH * shards)
                keys.append(segment_keys(h, begin, count))
                least.append(own.ids[lo + np.searchsorted(first, begin, "right") - 1])
                n.append(count)
                shard.append(s)
                words.append(h[spread(begin, count + WINDOW - 1)].astype("<u4"))
        out = []
        if keys and sum(map(len, keys)):
            keys, least, n, shard, words = (np.concatenate(x) for x in (keys, least, n, shard, words))
            begin = np.concatenate([[0], np.cumsum(n + WINDOW - 1)[:-1]])
            order = np.lexsort((least, keys, shard))
            order = order[np.concatenate([[True], keys[order][1:] != keys[order][:-1]])]
            cuts = np.flatnonzero(np.concatenate([[True], shard[order][1:] != shard[order][:-1]]))
            for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
                p = order[a:b]
                out.append((int(shard[p[0]]), bucket, _pack(keys[p].tobytes()), _pack(least[p].astype("<i8").tobytes()), _pack(n[p].astype("<u4").tobytes()), _pack(words[spread(begin[p], n[p] + WINDOW - 1)].tobytes())))
        cols = list(zip(*out, strict=True)) or [()] * 6
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["shard", "bucket", "keys", "least", "windows", "words"])

    return cut


def remove(with_text: bool):
    def apply(docs: pa.Table, found: pa.Table) -> pa.Table:
        """A bucket's documents without the words of windows that an earlier document has."""
        if not docs.num_rows:
            return pa.table([pa.array([], f.type) for f in _out(docs, with_text)], names=[f.name for f in _out(docs, with_text)])
        own = Bucket(docs)
        parts = list(own.slices())
        # the least document of this bucket that has a segment, unless the index knows better
        key = np.concatenate([segment_keys(h, begin, n) for _, h, _, begin, n, _ in parts])
        row = np.concatenate([lo + np.searchsorted(first, begin, "right") - 1 for lo, _, first, begin, _, _ in parts])
        distinct, back = np.unique(key, return_inverse=True)
        least = np.full(len(distinct), NEVER, np.int64)
        np.minimum.at(least, back, own.ids[row])
        known = [[_unpack(x, kind) for x in found.column(name).to_pylist()] for name, kind in (("keys", "<u8"), ("windows", "<u4"), ("least", "<i8"))]
        known = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in known]
        order = np.argsort(known[0], kind="stable")
        sorted_keys, start = known[0][order], (np.cumsum(known[1], dtype=np.int64) - known[1])[order]

        n_words, n_removed, digest, text = [], [], [], []
        done = 0
        for lo, h, first, begin, n, _ in parts:
            k = slice(done, done + len(begin))
            done += len(begin)
            values = np.repeat(least[back[k]], n)
            if len(sorted_keys) and len(begin):
                at = np.minimum(np.searchsorted(sorted_keys, key[k]), len(sorted_keys) - 1)
                better = np.flatnonzero(sorted_keys[at] == key[k])
                total = np.concatenate([[0], np.cumsum(n)])
                values[spread(total[better], n[better])] = known[2][spread(start[at[better]], n[better])]
            go = spread(begin, n)[values < np.repeat(own.ids[row[k]], n)]
            depth = np.zeros(len(h) + 1, np.int64)
            np.add.at(depth, go, 1)
            np.add.at(depth, go + WINDOW, -1)
            gone = np.cumsum(depth[:-1]) > 0
            for r in range(len(first) - 1):
                out = gone[first[r] : first[r + 1]]
                raw = own.raw[lo + r]
                words = raw.split()
                some = int(out.sum())
                kept = b" ".join([w for w, g in zip(words, out.tolist(), strict=True) if not g] if some else words)
                n_words.append(len(words))
                n_removed.append(some)
                digest.append(hashlib.sha256(kept).hexdigest())
                text.append(kept if some else raw)
        cols = [docs.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest)]
        if with_text:
            cols.append(pa.array(text, pa.binary()).cast(pa.string()))
            cols.append(docs.column("row"))
        return pa.table(cols, names=[f.name for f in _out(docs, with_text)])

    return apply


def _out(docs: pa.Table, with_text: bool) -> list[pa.Field]:
    out = [pa.field("doc_id", pa.int64()), pa.field("n_words", pa.int64()), pa.field("n_removed", pa.int64()), pa.field("kept_sha256", pa.string())]
    return out + [pa.field("text", pa.string()), pa.field("row", docs.schema.field("row").type)] if with_text else out


def remove_repeats(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256.

    With ``keep`` also the text that is left (unchanged where nothing goes, else
    the kept words joined by one space) and ``row``, a struct of those columns.
    A null text has no words.  A row without id neither loses words nor removes
    any.  Rows of one doc_id don't remove each other's words.
    """
    spark = docs.sparkSession
    W.small_batches(spark)
    shards = partitions(spark)
    buckets = BUCKETS_EACH * shards
    # a few bytes for each bucket and shard that have to do with each other
    shared = stored(shared_anchors(docs, shards, buckets), "anchors")

    def pack(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids, raw = batch.column(0), [press.compress(t.encode()) for t in batch.column(1).to_pylist()]
            to = bucket_of(ids.fill_null(0).to_numpy(), buckets)
            none = np.flatnonzero(np.array(ids.is_null()))
            to[none] = [zlib.crc32(raw[i]) % buckets for i in none]  # rows without id go anywhere
            yield pa.RecordBatch.from_arrays([ids, pa.array(raw, pa.binary()), pa.array(to, pa.int32()), *batch.columns[2:]], names=["doc_id", "packed", "bucket", *batch.schema.names[2:]])

    rest = [F.struct(*keep).alias("row")] if keep else []
    rows = texts(docs, *rest)
    kind = f", row {rows.schema['row'].dataType.simpleString()}" if keep else ""
    dealt = rows.mapInArrow(pack, f"doc_id long, packed binary, bucket int{kind}")
    by = dealt.groupBy("bucket")
    cut = by.cogroup(shared.groupBy("bucket")).applyInArrow(segments(shards), "shard int, bucket int, keys binary, least binary, windows binary, words binary")
    found = cut.groupBy("shard").applyInArrow(search, "bucket int, keys binary, windows binary, least binary")
    more = f", text string{kind}" if keep else ""
    return by.cogroup(found.groupBy("bucket")).applyInArrow(remove(bool(keep)), f"doc_id long, n_words long, n_removed long, kept_sha256 string{more}")


SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 12, 0) + 1)) AS i FROM w)),
m AS (SELECT g, min(doc_id) AS low FROM g GROUP BY g),
c AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS i FROM g JOIN m USING (g) WHERE low < doc_id),
p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
k AS (SELECT p.doc_id, count(*) AS n_words, count(c.i) AS n_removed,
        coalesce(string_agg(CASE WHEN c.i IS NULL THEN word END, ' ' ORDER BY p.i), '') AS kept
      FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.i = p.i GROUP BY p.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)
"""


@register("op5_substring_dedup", SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
