"""Document fingerprints: I-Match over several randomised lexicons.

The lexicon holds the terms whose inverse document frequency lies within a
band.  A document's terms in it are sorted without repeats, and for each of
several random subsets of the lexicon those that fall in the subset are hashed.
A change of the text changes only the hashes of subsets that have one of the
changed terms.  Subsets keep from a quarter to a thousandth of the terms, so that
texts of any length have some with a term or two; two fingerprints' likeness
counts the sparse ones more, in which equal hashes are as frequent as common terms.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import partitions, register, table, texts
from .counts import COUNTED, Tally, merged
from .ordered import cut_points, in_order, range_of

#: Band of idf = ln(documents / document frequency).  The upper end bounds the lexicon by
#: e**IDF_MOST times the mean number of distinct terms in a document, however many documents.
IDF_LEAST, IDF_MOST = 1.5, 7.0
#: Subsets keep one term in 2**e, EACH of them for each e.
RATES, EACH = range(2, 11), 6
#: Most lexicon terms that are sent to the workers (8 bytes each).
MOST_TERMS = 1 << 23
DIGITS = 6
EMPTY = "-" * DIGITS

_rates = np.repeat(np.array(list(RATES), np.uint64), EACH)
_seeds = W.mix(np.arange(1, len(_rates) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def distinct_terms(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def in_lexicon(lexicon: np.ndarray, terms: np.ndarray) -> np.ndarray:
    if not len(lexicon):
        return terms[:0]
    return terms[lexicon[np.minimum(np.searchsorted(lexicon, terms), len(lexicon) - 1)] == terms]


def fingerprint(terms: np.ndarray, lexicon: np.ndarray) -> str:
    """Hex digits for each subset; dashes where it has no term.

    A text none of whose terms is in the lexicon is fingerprinted by all its
    terms; a text without words has dashes only.
    """
    own = in_lexicon(lexicon, terms)
    own = own if len(own) else terms
    if not len(own):
        return EMPTY * len(_rates)
    m = W.mix(own[None, :] ^ _seeds[:, None])
    chosen = m >> (np.uint64(64) - _rates)[:, None] == 0
    total = W.mix(np.where(chosen, m * np.uint64(0xD6E8FEB86659FD93) + own[None, :], np.uint64(0)).sum(axis=1, dtype=np.uint64))
    some = chosen.any(axis=1)
    return "".join(f"{int(v) & (16**DIGITS - 1):0{DIGITS}x}" if s else EMPTY for v, s in zip(total, some, strict=True))


def likeness(a: str, b: str) -> float:
    """Weighted share of equal hashes among the subsets in which either text has a term; 1 if neither has any."""
    if a == b:
        return 1.0
    same = some = 0
    for i, e in enumerate(_rates.tolist()):
        x, y = a[i * DIGITS : (i + 1) * DIGITS], b[i * DIGITS : (i + 1) * DIGITS]
        if x != EMPTY or y != EMPTY:
            some += 1 << e
            same += (x == y) << e
    return same / some if some else 1.0


def lexicon(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the terms in the idf band, from the document frequencies of all rows."""
    spark = docs.sparkSession
    W.small_batches(spark)
    shards = partitions(spark)
    n = docs.count()
    least, most = n * math.exp(-IDF_MOST), n * math.exp(-IDF_LEAST)

    def count(batches):
        tally = Tally(shards)
        for batch in batches:
            for lo, hi, buf, off in W.slices(batch, "text"):
                h, first = W.words(buf, off, lower=True)
                yield from tally.add(np.concatenate([distinct_terms(h[first[r] : first[r + 1]]) for r in range(hi - lo)]))
        yield from tally.rows()

    def band(group: pa.Table) -> pa.Table:
        keys, df = merged(group)
        return pa.table({"term": keys[(df >= least) & (df <= most)].view(np.int64)})

    terms = texts(docs).select("text").mapInArrow(count, COUNTED).groupBy("shard").applyInArrow(band, "term long")
    got = terms.limit(MOST_TERMS + 1).toArrow().column("term").to_numpy()
    if len(got) > MOST_TERMS:
        raise ValueError(f"over {MOST_TERMS} terms in the idf band; lower IDF_MOST")
    return np.sort(got.view(np.uint64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A text's edited form has its last floor(n_chars / 4) code points replaced by
    as many first ones of the next document (fewer if that is shorter), in
    ascending doc_id; the first follows the last, and a single document itself.
    Rows of one doc_id are ordered by a hash of their text.  Null ids come last.
    A null text is empty.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    W.small_batches(spark)
    cuts = cut_points(docs)
    words = spark.sparkContext.broadcast(lexicon(docs))

    def deal(batches):
        """Rows to their range; the first document of a range also to the range before."""
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids, raw = batch.column(0), [t.encode() for t in batch.column(1).to_pylist()]
            no_id = np.array(ids.is_null())
            key = ids.fill_null(0).to_numpy()
            to = np.where(no_id, max(len(cuts) - 1, 0), range_of(cuts, key)) if len(cuts) else np.zeros(len(key), np.int64)
            tie = [int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "big", signed=True) for t in raw]
            packed = [pack.compress(t) for t in raw]
            head = np.flatnonzero(~no_id & (cuts[to] == key)) if len(cuts) else np.zeros(0, np.int64)
            rows = np.concatenate([np.arange(len(raw)), head])
            lent = np.arange(len(rows)) >= len(raw)
            goes = np.concatenate([to, (to[head] - 1) % max(len(cuts), 1)])
            yield pa.RecordBatch.from_arrays([pa.array(goes, pa.int32()), pa.array(lent), ids.take(pa.array(rows)), pa.array([tie[r] for r in rows], pa.int64()), pa.array([packed[r] for r in rows], pa.binary())], names=["range", "lent", "doc_id", "tie", "packed"])

    def follow(batches):
        open_ = zstandard.ZstdDecompressor()

        def emit(pairs):
            """Rows of (id, text, next text)."""
            out = []
            own = [p[1] for p in pairs]
            following = [p[2] for p in pairs]
            edited = []
            for t, nxt in zip(own, following, strict=True):
                k = len(t) // 4
                edited.append(t[: len(t) - k] + nxt[:k])
            marks = [prints(own), prints(edited), prints(following)]
            for (i, t, _), e, a, b, c in zip(pairs, edited, *marks, strict=True):
                out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, c)))
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=NAMES)

        seen: dict[str, str] = {}

        def prints(own):
            todo = [t for t in dict.fromkeys(own) if t not in seen]
            batch = pa.RecordBatch.from_arrays([pa.array(todo, pa.string())], names=["text"])
            for lo, hi, buf, off in W.slices(batch, "text"):
                h, first = W.words(buf, off, lower=True)
                for r in range(hi - lo):
                    seen[todo[lo + r]] = fingerprint(distinct_terms(h[first[r] : first[r + 1]]), words.value)
            return [seen[t] for t in own]

        at = first = last = None
        lent = False
        pairs: list = []
        size = 0
        for batch in batches:
            for where, borrowed, i, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4), strict=True):
                if where != at:
                    if last is not None:  # the only range of a table without ids
                        pairs.append((*last, first))
                    at, last, lent, first = where, None, False, None
                if lent:
                    continue  # further rows lent, of the same id
                text = open_.decompress(packed.as_py()).decode()
                if last is not None:
                    pairs.append((*last, text))
                    size += len(text)
                first = text if first is None else first
                last, lent = (None, True) if borrowed else ((i, text), False)
                if size > W.SLICE_BYTES:
                    yield emit(pairs)
                    pairs, size = [], 0
                    seen.clear()
        if last is not None:
            pairs.append((*last, first))
        if pairs:
            yield emit(pairs)

    # lent rows sort behind a range's own; a null id behind all other own rows
    dealt = texts(docs).mapInArrow(deal, "range int, lent boolean, doc_id long, tie long, packed binary")
    sorted_ = in_order(dealt, "lent", F.col("doc_id").asc_nulls_last(), "tie")
    return sorted_.mapInArrow(follow, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


@register("op2_document_fingerprints")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
