"""MinHash near-dedup with SetSketch registers.

Each document's set of 5-word shingles gives ``REGISTERS`` SetSketch registers:
register i is ``floor(1 - log_b(x_i))`` cut to [0, q + 1], where x_i is the
least of the exponential variables of rate ``a`` that hashing gives each
shingle.  Registers are mergeable (maximum) and equal with about the Jaccard
similarity.  Banded registers propose pairs, the joint likelihood of the two
register vectors estimates the similarity, and pairs that may reach the
threshold are verified on the full sets.

Groups of copies are never expanded.  Documents with equal sets form one class
first.  In a band's bucket every class is compared with the bucket's smallest
class only (a star), and components are made of the verified stars.  What the
stars may have missed lies across components in the buckets that still hold
several: those classes are joined by the prefix filter for set similarity.
Shingles are ordered from rare to frequent; two sets can only reach the
threshold if they share a shingle in their first parts, and the places of the
shingle in both bound the intersection.  Heavily edited copies begin with
shingles of their own, so this join leaves few pairs where a group has many
members just under the threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import register, stored, table, texts

#: Counters by which shingles are ordered from rare to frequent (any order is right).
COUNTERS = 1 << 20

SHINGLE = 5
#: Link where 100 * intersection >= SHARE * union.
SHARE = 75
ROWS, BANDS = 4, 40
REGISTERS = ROWS * BANDS
#: SetSketch parameters: base, rate, largest register value less one.
BASE, RATE, Q = 1.001, 20.0, (1 << 16) - 2
#: A pair is verified unless its likelihood estimate is this far below the threshold
#: (six standard errors of the estimate at REGISTERS registers).
MARGIN = 6 * (0.75 * 0.25 / REGISTERS) ** 0.5

_rng = np.random.Generator(np.random.PCG64(20240607))
MUL = _rng.integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)


def shingles(h: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of one document's word hashes."""
    n = len(h)
    if not n:
        return h
    g = W.grams(h, min(n, SHINGLE))
    if n < SHINGLE:
        g = g + np.uint64(n)  # a whole short sequence
    g.sort()
    keep = np.empty(len(g), bool)
    keep[0] = True
    np.not_equal(g[1:], g[:-1], out=keep[1:])
    return g[keep]


def minima(s: np.ndarray) -> np.ndarray:
    """Least hash of the set for each register."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 1024):
        part = s[at : at + 1024]
        np.minimum(low, (part[None, :] * MUL[:, None] + ADD[:, None]).min(axis=1), out=low)
    return low


def registers(low: np.ndarray) -> np.ndarray:
    u = (low.astype(np.float64) + 0.5) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, Q + 1).astype("<u2")


def likelihood(k1: np.ndarray, k2: np.ndarray, n1: float, n2: float) -> float:
    """Maximum-likelihood Jaccard similarity of two register vectors of sets of known sizes."""
    more, less = int((k1 > k2).sum()), int((k1 < k2).sum())
    same = len(k1) - more - less
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    top = min(u / v, v / u)
    j = np.linspace(0, top, 201)
    p = lambda x: np.clip(-np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)
    a, b = p(u - v * j), p(v - u * j)
    return float(j[np.argmax(more * np.log(a) + less * np.log(b) + same * np.log(np.clip(1 - a - b, 1e-12, 1)))])


def _features(batches):
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, buf, off in W.slices(batch, "text"):
            h, first = W.words(buf, off, lower=True)
            n, keys, sketches = [], [], []
            for r in range(hi - lo):
                s = shingles(h[first[r] : first[r + 1]])
                n.append(len(s))
                keys.append(b"" if not len(s) else np.array([W.mix(s).sum(dtype=np.uint64), W.mix(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)]).tobytes())
                sketches.append(registers(minima(s)).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([ids[lo:hi], pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())], names=["doc_id", "n_shingles", "set_key", "sketch"])


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits that equal sets share), sketch: SetSketch registers."""
    W.small_batches(docs.sparkSession)
    return texts(docs).mapInArrow(_features, "doc_id long, n_shingles long, set_key binary, sketch binary")


def _bands(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = (k * (np.uint64(1) << (np.uint64(16) * np.arange(ROWS, dtype=np.uint64)))).sum(axis=2, dtype=np.uint64)
        key = W.mix(key + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], names=["bucket", "rep"])


def _likely(batches):
    for batch in batches:
        a, b, na, nb, ka, kb = (batch.column(i).to_pylist() for i in range(6))
        keep = [likelihood(np.frombuffer(x, "<u2"), np.frombuffer(y, "<u2"), n, m) >= SHARE / 100 - MARGIN for n, m, x, y in zip(na, nb, ka, kb, strict=True)]
        yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sets(batches):
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, buf, off in W.slices(batch, "text"):
            h, first = W.words(buf, off, lower=True)
            sets = [shingles(h[first[r] : first[r + 1]]) for r in range(hi - lo)]
            keys = [np.array([W.mix(s).sum(dtype=np.uint64), W.mix(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)]).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([ids[lo:hi], pa.array(keys, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "set_key", "members"])


def _verify(batches):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            at = np.searchsorted(t, s)
            both = int((t[np.minimum(at, len(t) - 1)] == s).sum()) if len(t) else 0
            keep.append(100 * both >= SHARE * (len(s) + len(t) - both) > 0)
        yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _tokens(counts):
    def emit(batches):
        for batch in batches:
            ids, parts, sets = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            rows = []
            for i, c, x in zip(ids, parts, sets, strict=True):
                s = np.frombuffer(x.as_buffer(), np.uint64)
                n = len(s)
                first = n + 1 - -(-SHARE * n // 100)  # the longest part that a similar set must meet
                s = s[np.lexsort((s, counts.value[s >> np.uint64(44)]))][:first]
                rows.append((s, np.full(len(s), i), np.full(len(s), c), np.full(len(s), n), np.arange(len(s))))
            token, rep, component, n, place = (np.concatenate(c) for c in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(rep), pa.array(component), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32))], names=["token", "rep", "component", "n", "place"])

    return emit


def _frequency(batches):
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            part = np.frombuffer(b"".join(batch.column(0)[at : at + 100].to_pylist()), np.uint64)
            total += np.bincount((part >> np.uint64(44)).astype(np.int64), minlength=COUNTERS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["counter", "n"])


def prefix_pairs(open_: DataFrame) -> DataFrame:
    """(a, b) of different components whose sets (rep, component, members) may reach the threshold."""
    counted = open_.select("members").mapInArrow(_frequency, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)  # fixed size, whatever the input's
    counts[counted.column("counter").to_numpy()] = counted.column("n").to_numpy()
    tokens = open_.select("rep", "component", "members").mapInArrow(_tokens(open_.sparkSession.sparkContext.broadcast(counts)), "token long, rep long, component long, n int, place int")
    tokens = stored(tokens, "tokens")
    x, y = tokens.alias("x"), tokens.alias("y")
    larger = "(x.n > y.n or x.n = y.n and x.rep > y.rep)"
    could = f"{SHARE} * x.n <= 100 * y.n and {100 + SHARE} * (x.n - x.place) >= {SHARE} * (x.n + y.n) and {100 + SHARE} * (y.n - y.place) >= {SHARE} * (x.n + y.n)"
    pairs = x.join(y, F.expr(f"x.token = y.token and x.component <> y.component and {larger} and {could}"))
    return pairs.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def components(edges: DataFrame, name: str = "component") -> DataFrame:
    """Connected components of undirected edges (a, b): columns id and ``name``, the least id reachable.

    Alternates large-star and small-star steps, each a minimum by vertex and a
    join back; the edges of each round are a table in the shared folder.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    was = state(edges)
    while was[0]:
        near = both(edges)
        low = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = near.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: every edge points from the larger to the smaller end
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = stored(small.where("a <> b").distinct(), "edges")
        now = state(edges)
        if now == was:
            break
        was = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias(name))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest doc_id linked to it through documents with
    100 * intersection >= 75 * union of their 5-word shingles; ``kept`` says
    that it is the document's own id.  A null text has no shingles and, like an
    empty one, no links.  Rows that repeat a doc_id are one document.  A null
    doc_id gets a null component and is kept; it links nothing.
    """
    feats = stored(features(docs), "features")
    classes = feats.where("n_shingles > 0 and doc_id is not null").groupBy("set_key", "n_shingles").agg(F.min("doc_id").alias("rep"))
    reps = stored(feats.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "set_key", "n_shingles"], "left_semi").groupBy("set_key").agg(F.first("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "classes")
    bands = reps.select("rep", "sketch").mapInArrow(_bands, "bucket long, rep long")
    shared = bands.groupBy("bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high")
    members = stored(bands.join(shared.select("bucket", "low"), "bucket"), "members")

    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = texts(docs).join(wanted, "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, set_key binary, members binary")
    sets = stored(sets.join(reps.select(F.col("rep").alias("doc_id"), "set_key"), ["doc_id", "set_key"], "left_semi").dropDuplicates(["doc_id", "set_key"]).select(F.col("doc_id").alias("rep"), "members"), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        """Of (a, b), those linked by their full sets."""
        full = pairs.join(sets.select(F.col("rep").alias("a"), F.col("members").alias("sa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("members").alias("sb")), "b")
        return stored(full.select("a", "b", "sa", "sb").mapInArrow(_verify, "a long, b long").distinct(), "links")

    stars = members.where("rep <> low").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct()
    side = lambda p: reps.select(F.col("rep").alias(p), F.col("n").alias(f"n{p}"), F.col("sketch").alias(f"k{p}"))
    likely = stars.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ka", "kb").mapInArrow(_likely, "a long, b long")
    found = components(verified(stored(likely, "likely")))

    label = members.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = label.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
    open_ = stored(label.join(mixed, "bucket", "left_semi").select("rep", "component").distinct().join(sets, "rep"), "open")
    across = verified(prefix_pairs(open_))
    links = found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(across)
    repeated = feats.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.isEmpty():  # rows of one document link their classes
        own = feats.join(repeated, "doc_id", "left_semi").join(classes, ["set_key", "n_shingles"]).select("doc_id", "rep")
        links = links.union(own.join(own.groupBy("doc_id").agg(F.min("rep").alias("low")), "doc_id").select(F.col("low").alias("a"), F.col("rep").alias("b")))
    found = components(links)

    labels = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("set_key", "n_shingles", F.coalesce("component", "rep").alias("component"))
    out = feats.select("doc_id", "n_shingles", "set_key").join(labels, ["set_key", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS sh
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.a = d.doc_id
"""


@register("op6_minhash_near_dedup", SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
