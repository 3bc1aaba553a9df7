"""Benchmark decontamination by latent semantic retrieval.

Documents become the sequences of those of their terms that the benchmark has.
Passages of PASSAGE words are TF-IDF vectors over these terms, but for those that
are in many passages, which say nothing about a passage; a randomised SVD
of all passages, whose one pass over them is summed in Spark, gives the latent
space.  Windows of every document are compared there with every benchmark item
by cosine, and what is near is verified: by the longest common subsequence of
terms, and by the item's last sentence, its answer, where the rest is
paraphrased.  The cosine misses some of what verifies; an inverted index of each
item's rarer terms finds all of it: a document that shares too few of them
within an item's span can't have enough of its terms.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import zstandard

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import register, stored, table, texts

PASSAGE = 64
RANK, OVERSAMPLE = 144, 16
#: A term weighs idf ** POWER if its idf is at least this share of the largest possible one, else nothing.
POWER, STRONG = 1.5, 0.4
#: An item with fewer strong terms than this keeps the weight of all its terms.
FEW = 5
#: Windows that are compared with the items: (words, step).
WINDOWS = ((24, 12), (64, 32))
COSINE = 0.7
#: Of an item's terms, in order: enough by themselves, and enough if the answer's are there too.
COVERED, PARAPHRASED, ANSWERED = 0.75, 0.5, 0.8
#: Of the fewest terms with which an item verifies, the share that the index asks for; it holds the rarest terms that make this sure.
SHARED = 0.35
#: Places of indexed terms that are looked at together, about.
HITS = 2_000_000
#: What the benchmark may have at most; it is sent to every worker.
MOST_ITEMS, MOST_TERMS = 1_000_000, 500_000
#: Items compared at once, and tasks whose sums are added at once.
ITEM_BLOCK, TOGETHER = 4096, 64


class Benchmark:
    """The items as sequences of term numbers."""

    def __init__(self, rows: list):
        rows = sorted((r for r in rows if r.text), key=lambda r: (r.item_id is None, r.item_id or 0, r.text))
        self.ids = [r.item_id for r in rows]
        hashes = [self._words(r.text) for r in rows]
        answers = [self._words(([s for s in re.split(r"(?<=[.!?])\s+", r.text.strip()) if re.search(r"\w", s)] or [""])[-1]) for r in rows]
        self.vocabulary = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]))
        self.terms = [np.searchsorted(self.vocabulary, h) for h in hashes]
        self.answers = [np.searchsorted(self.vocabulary, h) for h in answers]
        keep = [i for i, t in enumerate(self.terms) if len(t)]
        self.ids, self.terms, self.answers = ([x[i] for i in keep] for x in (self.ids, self.terms, self.answers))

    @staticmethod
    def _words(text: str) -> np.ndarray:
        buf = np.frombuffer(text.encode(), np.uint8)
        return W.words(buf, np.array([0, len(buf)]), lower=True, gap=W.IS_SIGN)[0]


def _encode(vocabulary: np.ndarray):
    def encode(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for lo, hi, buf, off in W.slices(batch, "text"):
                h, first = W.words(buf, off, lower=True, gap=W.IS_SIGN)
                term = np.searchsorted(vocabulary, h)
                known = np.flatnonzero(vocabulary[np.minimum(term, len(vocabulary) - 1)] == h)
                term = term[known].astype("<u4")
                cuts = np.searchsorted(known, first)
                pack = lambda a: press.compress(a.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[lo:hi],
                        pa.array(np.diff(first), pa.int64()),
                        pa.array([pack((known[a:b] - f).astype("<u4")) for a, b, f in zip(cuts[:-1], cuts[1:], first, strict=False)], pa.binary()),
                        pa.array([pack(term[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "n_words", "places", "terms"],
                )

    return encode


def _opened(batches):
    """(ids, numbers of words, first term of each document, places, terms) of parts of each batch."""
    open_ = zstandard.ZstdDecompressor()
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            part = batch.slice(at, 100)
            places = [np.frombuffer(open_.decompress(x), "<u4") for x in part.column(2).to_pylist()]
            terms = [np.frombuffer(open_.decompress(x), "<u4") for x in part.column(3).to_pylist()]
            first = np.concatenate([[0], np.cumsum([len(t) for t in terms])])
            yield part.column(0).to_pylist(), part.column(1).to_numpy(), first, np.concatenate(places).astype(np.int64), np.concatenate(terms).astype(np.int64)


def _passages(n_words, first, places):
    """Number of the passage of each term, and how many passages there are."""
    n = -(-n_words // PASSAGE)
    base = np.concatenate([[0], np.cumsum(n)])
    return np.repeat(base[:-1], np.diff(first)) + places // PASSAGE, int(base[-1])


def _frequency(size: int):
    def count(batches):
        df, n = np.zeros(size + 1, np.int64), 0
        for _, n_words, first, places, terms in _opened(batches):
            passage, some = _passages(n_words, first, places)
            n += some
            df[:-1] += np.bincount(np.unique(passage * size + terms) % size, minlength=size)
        df[-1] = n  # the last row counts the passages
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "n"])

    return count


def _accumulate(total, omega, idf, passage, terms):
    """Adds (A^T A) omega of the passages' TF-IDF rows A to ``total``."""
    if not len(terms):
        return
    weighted = omega[terms] * idf[terms, None]
    begin = np.flatnonzero(np.diff(passage, prepend=-1))
    rows = np.add.reduceat(weighted, begin, axis=0)
    of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(terms))))
    order = np.argsort(terms, kind="stable")
    sorted_ = terms[order]
    at = np.flatnonzero(np.diff(sorted_, prepend=-1))
    total[sorted_[at]] += np.add.reduceat(rows[of[order]] * idf[sorted_, None], at, axis=0)


def _sketch(omega, idf, block: int = 64):
    def sketch(batches):
        total = np.zeros(omega.shape)
        for _, n_words, first, places, terms in _opened(batches):
            heavy = np.flatnonzero(idf[terms])
            _accumulate(total, omega, idf, _passages(n_words, first, places)[0][heavy], terms[heavy])
        parts = [(i, total[i : i + block]) for i in range(0, len(total), block)]
        parts = [(i, p.tobytes()) for i, p in parts if p.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int64()), pa.array([p for _, p in parts], pa.binary())], names=["block", "part"])

    return sketch


def _add(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in group.column("part"))
    return pa.table({"block": group.column("block")[:1], "part": pa.array([total.tobytes()], pa.binary())})


def _summed(parts: DataFrame) -> DataFrame:
    """The blocks' sums: of TOGETHER tasks' parts each, then of those."""
    group = F.floor(F.spark_partition_id() / TOGETHER)
    some = parts.withColumn("tasks", group).groupBy("block", "tasks").applyInArrow(_add, "block long, part binary")
    return some.groupBy("block").applyInArrow(_add, "block long, part binary")


def latent(sketch: np.ndarray, omega: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors of A from (A^T A) omega (Nystroem)."""
    core = omega.astype(np.float64).T @ sketch
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > max(values.max(initial=0), 1e-300) * 1e-10
    u, _, _ = np.linalg.svd(sketch @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    return u[:, :rank]


def common(pattern: np.ndarray, masks: dict, seq) -> int:
    """Length of the longest common subsequence, by bits."""
    full = (1 << len(pattern)) - 1
    v = full
    for t in seq:
        u = v & masks.get(t, 0)
        v = (v + u | v - u) & full
    return len(pattern) - v.bit_count()


def _masks(pattern) -> dict:
    out: dict[int, int] = {}
    for i, t in enumerate(pattern.tolist()):
        out[t] = out.get(t, 0) | 1 << i
    return out


def _unit(z: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(z, axis=1, keepdims=True)
    return (z / np.where(n > 0, n, 1)).astype(np.float32)


def weights(counts: np.ndarray, items: list) -> np.ndarray:
    """Weight of each term, from the passages that have it and, last, their number."""
    idf = np.log((1 + counts[-1]) / (1 + counts[:-1]))
    strong = idf >= STRONG * np.log(1 + counts[-1])
    for terms in items:
        if strong[terms].sum() < FEW:
            strong[terms] = True
    return (np.where(strong, idf, 0.0) ** POWER).astype(np.float32)


def span(n: int) -> int:
    """Words of a document among which an item of n terms has to be."""
    return n * 3 // 2 + 4


def least(n: int, n_answer: int) -> int:
    """Fewest of an item's n terms, in order, with which it can verify: enough by themselves, or with the answer's."""
    covered = math.ceil(COVERED * n)
    return min(covered, max(math.ceil(PARAPHRASED * n), next(c for c in range(n_answer + 1) if c / n_answer >= ANSWERED))) if n_answer else covered


def index(bench: Benchmark, counts: np.ndarray) -> tuple:
    """Items by their rarest terms: (first posting of each term, items, how many terms are asked for, spans).

    Whatever has ``least`` of an item's n terms has at least k of any n - least + k.
    """
    enough, found = [], []
    for i, (terms, answer) in enumerate(zip(bench.terms, bench.answers, strict=True)):
        fewest = least(len(terms), len(answer))
        enough.append(max(round(SHARED * fewest), 1))
        rare = np.unique(terms[np.lexsort((terms, counts[terms]))][: len(terms) - fewest + enough[-1]])
        found.append(np.stack([rare, np.full(len(rare), i)]))
    term, item = np.concatenate(found, axis=1)
    order = np.argsort(term, kind="stable")
    begin = np.searchsorted(term[order], np.arange(len(bench.vocabulary) + 1))
    return begin, item[order], np.array(enough), np.array([span(len(t)) for t in bench.terms])


def sharing(index: tuple, n_words, first, places, terms) -> set:
    """(document, item) where enough of the item's indexed terms are within its span: all that verify, and some more."""
    begin, postings, enough, spans = index
    n, widest = np.diff(begin)[terms], int(spans.max())
    base = np.concatenate([[0], np.cumsum(n_words + widest)])  # no span reaches two documents, nor two items below
    at = np.repeat(base[:-1], np.diff(first)) + places
    ends, out, lo = np.cumsum(n), set(), 0
    while lo < len(terms):
        hi = max(int(np.searchsorted(ends, ends[lo] - n[lo] + HITS, side="right")), lo + 1)
        stop = int(np.searchsorted(at, at[hi - 1] + widest))
        some, total = n[lo:stop], int(n[lo:stop].sum())
        posting = np.repeat(begin[terms[lo:stop]] - (np.cumsum(some) - some), some) + np.arange(total)
        key = postings[posting] * (base[-1] + 1) + np.repeat(at[lo:stop], some)
        key.sort()
        item = key // (base[-1] + 1)
        last = np.arange(total) + enough[item] - 1
        yes = np.flatnonzero(last < total)
        yes = yes[key[last[yes]] - key[yes] < spans[item[yes]]]
        doc = np.searchsorted(base, key[yes] % (base[-1] + 1), side="right") - 1
        pairs = np.unique(doc * len(spans) + item[yes])
        out.update(zip((pairs // len(spans)).tolist(), (pairs % len(spans)).tolist(), strict=True))
        lo = hi
    return out


def _windows(n_words, size: int, step: int):
    """Document, start and end of each window of documents of so many words."""
    n = np.maximum(-(-(n_words - size) // step) + 1, (n_words > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), n)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * step
    return doc, start, np.minimum(start + size, n_words[doc])


class Verifier:
    """Whether a document has an item, tried from every one of its words that the item has too."""

    def __init__(self, terms: np.ndarray, answer: np.ndarray):
        self.terms, self.answer, self.known = terms, answer, np.unique(terms)
        self.masks, self.fewest, self.span = (_masks(terms), _masks(answer)), least(len(terms), len(answer)), span(len(terms))

    def __call__(self, places: np.ndarray, terms: np.ndarray) -> tuple:
        """Whether it does; its best coverage, and its answer's there."""
        best = (False, 0.0, 0.0)
        hits = np.flatnonzero(self.known[np.minimum(np.searchsorted(self.known, terms), len(self.known) - 1)] == terms)
        at, seq = places[hits], terms[hits].tolist()
        start = np.flatnonzero(at[self.fewest - 1 :] - at[: max(len(at) - self.fewest + 1, 0)] < self.span)
        stop = np.searchsorted(at, at[start] + self.span)
        i = 0
        while i < len(start):
            # windows that start within the first one's span; what they have together is at least what each has
            j = int(np.searchsorted(at[start], at[start[i]] + self.span))
            if common(self.terms, self.masks[0], seq[start[i] : stop[j - 1]]) >= self.fewest:
                for a, b in zip(start[i:j].tolist(), stop[i:j].tolist(), strict=True):
                    cover = common(self.terms, self.masks[0], seq[a:b]) / len(self.terms)
                    if cover >= PARAPHRASED:
                        answer = common(self.answer, self.masks[1], seq[a:b]) / len(self.answer) if len(self.answer) else 0.0
                        best = max(best, (cover >= COVERED or answer >= ANSWERED, cover, answer))
            i = j
        return best


def _search(model):
    def search(batches):
        bench, weighs, vectors, items, rare = model.value
        verifiers: dict[int, Verifier] = {}
        for ids, n_words, first, places, terms in _opened(batches):
            out = []
            base = np.concatenate([[0], np.cumsum(n_words)])
            heavy = np.flatnonzero(weighs[terms])
            where = (np.repeat(base[:-1], np.diff(first)) + places)[heavy]
            sums = np.zeros((len(heavy) + 1, vectors.shape[1]), np.float32)
            np.cumsum(vectors[terms[heavy]], axis=0, out=sums[1:])
            near: dict[tuple, float] = {}
            for size, step in WINDOWS:
                doc, start, stop = _windows(n_words, size, step)
                a, b = np.searchsorted(where, base[doc] + start), np.searchsorted(where, base[doc] + stop)
                some = np.flatnonzero(b > a)
                for at in range(0, len(some), 20_000):
                    w = some[at : at + 20_000]
                    z = _unit(sums[b[w]] - sums[a[w]])
                    for block in range(0, len(items), ITEM_BLOCK):
                        cos = z @ items[block : block + ITEM_BLOCK].T
                        for i, j in zip(*np.nonzero(cos >= COSINE), strict=True):
                            pair = (int(doc[w[i]]), block + int(j))
                            near[pair] = max(near.get(pair, -1.0), float(cos[i, j]))

            def cosine(d, item):
                """The best of any window of document d."""
                best = []
                for size, step in WINDOWS:
                    _, start, stop = _windows(n_words[d : d + 1], size, step)
                    a, b = np.searchsorted(where, base[d] + start), np.searchsorted(where, base[d] + stop)
                    best.append(float((_unit(sums[b] - sums[a]) @ items[item]).max()))
                return max(best)

            for d, item in sorted(sharing(rare, n_words, first, places, terms).union(near)):
                own = slice(first[d], first[d + 1])
                if item not in verifiers:
                    verifiers[item] = Verifier(bench.terms[item], bench.answers[item])
                yes, cover, answer = verifiers[item](places[own], terms[own])
                if yes:
                    out.append((ids[d], bench.ids[item], near[d, item] if (d, item) in near else cosine(d, item), cover, answer))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "cosine", "covered", "answer_covered"])

    return search


RESULT = "doc_id long, item_id long, cosine double, covered double, answer_covered double"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and benchmark item that it contains: doc_id, item_id, cosine, covered, answer_covered.

    ``covered`` is the share of the item's terms that the document has in their
    order, ``cosine`` the best of any window, under COSINE too.  Null and empty texts contain nothing, and are contained in nothing;
    so are items without letters or digits.  Repeated rows are reported each.
    """
    spark = docs.sparkSession
    W.small_batches(spark)
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).limit(MOST_ITEMS + 1).collect()
    bench = Benchmark(rows)
    size = len(bench.vocabulary)
    if len(rows) > MOST_ITEMS or size > MOST_TERMS:
        raise ValueError(f"the benchmark has over {MOST_ITEMS} items or {MOST_TERMS} terms")
    if not size:
        return spark.createDataFrame([], RESULT)
    coded = stored(texts(docs).mapInArrow(_encode(bench.vocabulary), "doc_id long, n_words long, places binary, terms binary"), "terms")
    # one row for each benchmark term
    counts = np.zeros(size + 1, np.int64)
    for r in coded.mapInArrow(_frequency(size), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        counts[r.term] = r.n
    idf = weights(counts, bench.terms)
    omega = np.random.Generator(np.random.PCG64(11)).standard_normal((size, min(size, RANK + OVERSAMPLE)), np.float32)
    total = np.zeros(omega.shape)
    for r in _summed(coded.mapInArrow(_sketch(omega, idf), "block long, part binary")).toLocalIterator():
        part = np.frombuffer(r.part, np.float64).reshape(-1, omega.shape[1])
        total[r.block : r.block + len(part)] = part
    lengths = [len(t) for t in bench.terms]
    _accumulate(total, omega, idf, np.repeat(np.arange(len(lengths)), lengths), np.concatenate(bench.terms))
    vectors = (latent(total, omega, RANK) * idf[:, None]).astype(np.float32)
    items = _unit(np.stack([vectors[t].sum(axis=0) for t in bench.terms]))
    model = spark.sparkContext.broadcast((bench, idf > 0, vectors, items, index(bench, counts)))
    return coded.mapInArrow(_search(model), RESULT)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item; rows without id stay."""
    found = contaminated(docs, benchmark).where("doc_id is not null").select(F.col("doc_id").alias("_found")).distinct()
    return docs.join(found, docs["doc_id"] == found["_found"], "left_anti")


@register("op10_benchmark_decontamination")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
