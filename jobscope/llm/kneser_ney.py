"""LM scoring: interpolated modified Kneser-Ney bigrams, counted in Spark.

Words are 64-bit hashes, cut into shards by hash range; a word's id is its
place in the sorted hashes of all shards.  A bigram is kept with the shard of
its first word, as one 64-bit key (place of the first word in its shard, id of
the second).  First words with so many tokens that they would fill a shard are
"busy": their bigrams are spread over the shards by the second word.  Each
shard is a few sorted arrays in the shared folder that workers map into memory
to look up a slice's distinct words and bigrams at once.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .arrays import mapped, put
from .common import doc_crc, partitions, register, shared_dir, stored, table, texts
from .counts import COUNTED, Tally, merged, packed, packed_counts, shard_of, summed

#: The end token's hash, and the place that stands for "busy" in a bigram's key.
END = np.uint64(0x454E442D4F46542E)
ID_BITS = np.uint64(40)
BUSY = np.uint64(1 << 23)
#: First words with more than the tokens' share 1 / (BUSY_SHARE * shards) are busy.
BUSY_SHARE = 4
#: Discounts where the counts of counts don't give them (tiny corpora).
PLAIN = (0.5, 1.0, 1.5)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ of modified Kneser-Ney from the numbers of things seen 1, 2, 3 and 4 times."""
    if min(n) <= 0:
        return PLAIN
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) for k in (1, 2, 3))


class Model:
    """The shards of a model as mapped arrays."""

    def __init__(self, path: str, sizes: list[int], busy: list[int]):
        self.path, self.sizes = path, np.array(sizes, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.busy = np.array(busy, np.int64)  # ids, ascending; place 0 of the busy is a text's start
        self.kept: dict[str, np.ndarray] = {}

    def array(self, name: str, shard: int, kind: str) -> np.ndarray:
        key = f"{name}-{shard}"
        if key not in self.kept:
            self.kept[key] = mapped(f"{self.path}/{key}", kind)
        return self.kept[key]

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Ids of word hashes, -1 for unknown ones."""
        u, back = np.unique(h, return_inverse=True)
        out = np.full(len(u), -1, np.int64)
        cuts = np.searchsorted(shard_of(u, len(self.sizes)), np.arange(len(self.sizes) + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            if self.sizes[s]:
                part, there = u[cuts[s] : cuts[s + 1]], self.array("words", s, "<u8")
                at = np.minimum(np.searchsorted(there, part), len(there) - 1)
                out[cuts[s] : cuts[s + 1]] = np.where(there[at] == part, at + self.starts[s], -1)
        return out[back]

    def values(self, name: str, kind: str, ids: np.ndarray, width: int = 1) -> np.ndarray:
        """Rows of ``name`` by word id; zero for -1."""
        u, back = np.unique(ids, return_inverse=True)
        out = np.zeros((len(u), width), np.float64)
        cuts = np.searchsorted(u, self.starts)
        for s in np.flatnonzero(np.diff(cuts)):
            part = u[cuts[s] : cuts[s + 1]] - self.starts[s]
            there = self.array(name, s, kind).reshape(-1, width)
            if len(there):
                out[cuts[s] : cuts[s + 1]] = there[part]
        return out[back]

    def place(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shard and key of bigrams of known ids; a first of -1 is a text's start."""
        rank = np.searchsorted(self.busy, first)
        hot = (first < 0) | ((self.busy[np.minimum(rank, len(self.busy) - 1)] == first) if len(self.busy) else False)
        shard = np.searchsorted(self.starts, np.where(hot, second, first), "right") - 1
        local = np.where(hot, int(BUSY) + np.where(first < 0, 0, rank + 1), first - self.starts[shard])
        return shard, local.astype(np.uint64) << ID_BITS | second.astype(np.uint64)

    def counts(self, shard: np.ndarray, key: np.ndarray) -> np.ndarray:
        order = np.lexsort((key, shard))
        shard, key = shard[order], key[order]
        got = np.zeros(len(key), np.float64)
        cuts = np.searchsorted(shard, np.arange(len(self.sizes) + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            there = self.array("pairs", s, "<u8")
            if len(there):
                part = key[cuts[s] : cuts[s + 1]]
                at = np.minimum(np.searchsorted(there, part), len(there) - 1)
                got[cuts[s] : cuts[s + 1]] = np.where(there[at] == part, self.array("pair_counts", s, "<u4")[at], 0)
        out = np.empty(len(got))
        out[order] = got
        return out


@lru_cache(maxsize=1)
def _open(path: str, sizes: tuple, busy: tuple) -> Model:
    return Model(path, list(sizes), list(busy))


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each row, an END behind each row's last, and where the rows begin."""
    h, first = W.words(buf, off, lower=True)
    rows = len(off) - 1
    out = np.full(len(h) + rows, END, np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(rows), np.diff(first))] = h
    return out, first[:-1] + np.arange(rows)


def _before(ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The token before each; -1 at the start of a text and behind an unknown one."""
    out = np.concatenate([[-1], ids[:-1]])
    out[begin] = -1
    return out


def train(docs: DataFrame) -> dict:
    """Count all rows' texts; the model's description (its arrays stay in the shared folder)."""
    spark = docs.sparkSession
    W.small_batches(spark)
    shards = partitions(spark)
    path = f"{shared_dir(spark)}/lm-{uuid.uuid4().hex}"
    words = texts(docs).select("text")

    def count_words(batches):
        tally = Tally(shards)
        for batch in batches:
            for _, _, buf, off in W.slices(batch, "text"):
                yield from tally.add(tokens(buf, off)[0])
        yield from tally.rows()

    def keep_words(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        keys, counts = merged(group)
        put(f"{path}/words-{shard}", keys)
        put(f"{path}/word_counts-{shard}", counts.astype("<u8"))
        for name in ("pairs", "pair_counts", "contexts"):  # a shard of busy words only has no bigrams
            put(f"{path}/{name}-{shard}", np.zeros(0, np.uint8))
        return pa.table({"shard": pa.array([shard], pa.int32()), "size": [len(keys)], "total": [int(counts.sum())]})

    rows = words.mapInArrow(count_words, COUNTED).groupBy("shard").applyInArrow(keep_words, "shard int, size long, total long").collect()
    sizes = [0] * shards
    for r in rows:
        sizes[r.shard] = r.size
    total = sum(r.total for r in rows)
    if max(sizes) >= 1 << 23:
        raise ValueError("a shard has over 8 million words: raise spark.sql.shuffle.partitions")
    starts = np.concatenate([[0], np.cumsum(sizes)])
    spark_shards = spark.createDataFrame([(s,) for s in range(shards) if sizes[s]], "shard int").repartition(shards, "shard")

    def find_busy(batches):
        for batch in batches:
            for s in batch.column(0).to_pylist():
                at = np.flatnonzero(mapped(f"{path}/word_counts-{s}", "<u8") > total / (BUSY_SHARE * shards))
                yield pa.RecordBatch.from_arrays([pa.array(at + starts[s])], names=["id"])

    # at most BUSY_SHARE * shards of them
    busy = tuple(sorted(r.id for r in spark_shards.mapInArrow(find_busy, "id long").collect()))
    shape = tuple(sizes)

    def count_pairs(batches):
        model, tally = _open(path, shape, busy), Tally(shards)
        for batch in batches:
            for _, _, buf, off in W.slices(batch, "text"):
                h, begin = tokens(buf, off)
                ids = model.ids(h)
                shard, key = model.place(_before(ids, begin), ids)
                yield from tally.add(key, shard)
        yield from tally.rows()

    def keep_pairs(group: pa.Table) -> pa.Table:
        """Writes a shard's bigrams and what its first words sum to; gives out, by word shard, how many first words each second word follows."""
        shard = group.column("shard")[0].as_py()
        keys, counts = merged(group)
        put(f"{path}/pairs-{shard}", keys)
        put(f"{path}/pair_counts-{shard}", counts.astype("<u4"))
        first, second = (keys >> ID_BITS).astype(np.int64), (keys & np.uint64((1 << 40) - 1)).astype(np.int64)
        sums = np.stack([counts, counts == 1, counts == 2, counts >= 3], axis=1).astype(np.float64)
        own = first < int(BUSY)
        at = np.zeros((sizes[shard], 4))
        some = first[own]
        cuts = np.flatnonzero(np.diff(some, prepend=-1))
        if len(cuts):
            at[some[cuts]] = np.add.reduceat(sums[own], cuts, axis=0)
        put(f"{path}/contexts-{shard}", at)
        out = {"kind": ["seen"], "shard": [shard], "keys": [b""], "counts": [np.array([(counts == k).sum() for k in (1, 2, 3, 4)], "<i8").tobytes()]}
        for b in np.unique(first[~own]):
            total_of = sums[first == b].sum(axis=0)
            for k, v in (("kind", "busy"), ("shard", int(b - int(BUSY))), ("keys", b""), ("counts", total_of.tobytes())):
                out[k].append(v)
        ids, follows = summed(second.astype(np.uint64), np.ones(len(second), np.int64))
        cuts = np.searchsorted(ids, starts.astype(np.uint64))
        for s in np.flatnonzero(np.diff(cuts)):
            for k, v in (("kind", "follows"), ("shard", int(s)), ("keys", packed(ids[cuts[s] : cuts[s + 1]])), ("counts", packed_counts(follows[cuts[s] : cuts[s + 1]]))):
                out[k].append(v)
        return pa.table(out, schema=pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))

    def keep_follows(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        ids, n = merged(group)
        at = np.zeros(sizes[shard], "<u8")
        at[ids.astype(np.int64) - starts[shard]] = n
        put(f"{path}/follows-{shard}", at)
        return pa.table({"n": [[int((n == k).sum()) for k in (1, 2, 3, 4)] + [int(n.sum()), int((n >= 3).sum())]]}, schema=pa.schema([("n", pa.list_(pa.int64()))]))

    pairs = stored(words.mapInArrow(count_pairs, COUNTED).groupBy("shard").applyInArrow(keep_pairs, f"kind string, {COUNTED}"), "pairs")
    # one row of four numbers for each shard, and for each shard and busy word
    seen, contexts = np.zeros(4, np.int64), np.zeros((len(busy) + 1, 4))
    for r in pairs.where("kind <> 'follows'").select("kind", "shard", "counts").collect():
        if r.kind == "seen":
            seen += np.frombuffer(r.counts, "<i8")
        else:
            contexts[r.shard] += np.frombuffer(r.counts, "<f8")
    n = np.zeros(6, np.int64)
    for r in pairs.where("kind = 'follows'").select("shard", "keys", "counts").groupBy("shard").applyInArrow(keep_follows, "n array<long>").collect():
        n += np.array(r.n)
    return {"path": path, "sizes": shape, "busy": busy, "contexts": contexts, "tokens": total, "words": sum(sizes), "discounts": discounts(seen.tolist()), "lower_discounts": discounts(n[:4].tolist()), "lower": n}


def discounted(c: np.ndarray, d: tuple) -> np.ndarray:
    return np.maximum(c - np.select([c == 0, c == 1, c == 2], [0.0, d[0], d[1]], d[2]), 0.0)


def scorer(m: dict):
    """A mapInArrow function over (doc_id, held_out, text)."""

    def score(batches):
        model = _open(m["path"], m["sizes"], m["busy"])
        d, low, n = np.array(m["discounts"]), m["lower_discounts"], m["lower"]
        all_follows = max(int(n[4]), 1)
        uniform = 1 / (m["words"] + 1)
        spare = (low[0] * n[0] + low[1] * n[1] + low[2] * n[5]) / all_follows if n[4] else 1.0
        for batch in batches:
            for lo, hi, buf, off in W.slices(batch, "text"):
                h, begin = tokens(buf, off)
                ids = model.ids(h)
                known = ids >= 0
                c = model.values("word_counts", "<u8", ids)[:, 0]
                base = np.log10((c + 0.1) / (m["tokens"] + 0.1 * (m["words"] + 1)))
                lower = discounted(model.values("follows", "<u8", ids)[:, 0], low) / all_follows + spare * uniform
                prev = _before(ids, begin)
                start = np.zeros(len(ids), bool)
                start[begin] = True
                context = model.values("contexts", "<f8", prev, 4)
                if len(m["busy"]):
                    rank = np.minimum(np.searchsorted(model.busy, prev), len(model.busy) - 1)
                    hot = model.busy[rank] == prev
                    context[hot] = m["contexts"][rank[hot] + 1]
                context[start] = m["contexts"][0]
                seen = np.zeros(len(ids))
                can = known & (start | (prev >= 0))
                seen[can] = model.counts(*model.place(prev[can], ids[can]))
                some = context[:, 0] > 0
                whole = np.where(some, context[:, 0], 1)
                p = np.where(some, discounted(seen, tuple(d)) / whole + (context[:, 1:] @ d) / whole * lower, lower)
                sums = [np.add.reduceat(x, begin) for x in (known.astype(np.int64), base, np.log10(p))]
                rows = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(np.diff(np.append(begin, len(h)))), pa.array(sums[0]), pa.array(np.full(rows, m["tokens"], np.int64)), pa.array(sums[1]), pa.array(sums[2])],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return score


def score(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trains on the rows whose crc32(doc_id as text) mod 10 is not 0.  A null or
    empty text has its end token only.  With no training rows every token has
    probability 1, as there is nothing but the unknown word.
    """
    docs = docs.withColumn("_held", doc_crc() % 10 == 0)
    model = train(docs.where("not _held"))
    rows = texts(docs, F.col("_held").alias("held_out")).select("doc_id", "held_out", "text")
    return rows.mapInArrow(scorer(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


@register("op3_lm_scoring")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
