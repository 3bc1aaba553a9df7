"""Phrase collocation mining by SON partitioning, per language.

Phrases of 2 and then 3 words are mined level by level.  At a level the corpus
is in PARTS shards (a task's documents are of one shard).  A shard is mined
completely: its tasks emit all phrases whose parts are frequent, as packed keys
and counts by key range, so its counts are exact.  A phrase is locally frequent
from ceil(support / PARTS) occurrences in a shard on; one that is below this in
every shard has fewer than ``support`` in all, so the union of the locally
frequent phrases lacks none that is frequent.  The union of a key range is then
counted in the tables of all shards, which is its exact count over the corpus.

Words are counted as text.  A frequent word's id is its place among the sorted
hashes of its language's frequent words; a pair's key is the ids of its words, a
pair's id its place among the frequent pairs' mixed keys, a triple's key the id
of its first pair and of its last word.  So keys of pairs and triples are exact
and can be read back.  The sorted arrays lie in the shared folder, in key
ranges, and workers map them into memory.  (Two words whose 64-bit hashes are
the same would be counted as one.)

Scores are integers, computed from decimals of 38 digits.  Of each language the
best are taken by Spark's group limit before the windows' shuffle.

Defined cases: a null language is ``und``; a null text is an empty one; repeated
rows count each time; doc_id and further columns are not read; a language
without candidates, or an empty table, gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words as W
from .arrays import mapped, put
from .common import partitions, register, shared_dir, stored, table
from .counts import Tally, merged, shard_of

#: Least occurrences of a phrase; the share (in percent) of a phrase's occurrences inside a longer one that drops it.
SUPPORT, INSIDE = 10, 50
#: Phrases given for each language.
TOP = 2000
#: Shards of the corpus.
PARTS = 4
#: Bits of a word's id, and so of a language's frequent words; the other 36 are a pair's.
ID_BITS = 28
#: Keys or words that a task holds before it emits them, and bytes of text handled at once.
HELD, SLICE = 6 << 20, 4 << 20
#: Arrays that a worker keeps mapped.
MAPPED = 20_000

GAP = np.zeros(256, bool)
GAP[[9, 32, *b".,;:!?", 10, 11, 12, 13]] = True
BREAK = GAP.copy()
BREAK[[9, 32]] = False

U64 = np.uint64
ID_MASK = U64((1 << ID_BITS) - 1)
MULTIPLIER = 0xD6E8FEB86659FD93  # of words.mix
INVERSE = U64(pow(MULTIPLIER, -1, 1 << 64))


def unmix(h: np.ndarray) -> np.ndarray:
    """What ``words.mix`` made ``h`` of."""
    h = h ^ (h >> U64(32))
    h = h * INVERSE
    h = h ^ (h >> U64(32))
    h = h * INVERSE
    return h ^ (h >> U64(32))


def folder(path: str, name: str, lang: str) -> str:
    return f"{path}/{name}/{hashlib.md5(lang.encode()).hexdigest()}"


class Frequent:
    """The frequent words or pairs of all languages, as mapped arrays in key order."""

    def __init__(self, path: str, name: str, sizes: dict[str, np.ndarray]):
        self.path, self.name, self.sizes = path, name, sizes
        self.kept: dict[str, np.ndarray] = {}

    def array(self, lang: str, shard: int, what: str, kind: str) -> np.ndarray:
        at = f"{folder(self.path, self.name, lang)}/{what}-{shard}"
        if at not in self.kept:
            if len(self.kept) >= MAPPED:
                self.kept.clear()
            self.kept[at] = mapped(at, kind)
        return self.kept[at]

    def starts(self, lang: str) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes[lang])])

    def places(self, lang: str, keys: np.ndarray) -> np.ndarray:
        """The ids of keys, -1 of those that are not frequent."""
        u, back = np.unique(keys, return_inverse=True)
        out = np.full(len(u), -1, np.int64)
        if lang in self.sizes:
            sizes, starts = self.sizes[lang], self.starts(lang)
            cuts = np.searchsorted(shard_of(u, len(sizes)), np.arange(len(sizes) + 1))
            for s in np.flatnonzero(np.diff(cuts)):
                if sizes[s]:
                    part, there = u[cuts[s] : cuts[s + 1]], self.array(lang, s, "keys", "<u8")
                    at = np.minimum(np.searchsorted(there, part), len(there) - 1)
                    out[cuts[s] : cuts[s + 1]] = np.where(there[at] == part, at + starts[s], -1)
        return out[back]

    def values(self, lang: str, places: np.ndarray, what: str, kind: str) -> np.ndarray:
        """Of each id its key (``keys``) or its count (``counts``)."""
        starts = self.starts(lang)
        u, back = np.unique(places, return_inverse=True)
        out = np.zeros(len(u), kind)
        cuts = np.searchsorted(u, starts)
        for s in np.flatnonzero(np.diff(cuts)):
            out[cuts[s] : cuts[s + 1]] = self.array(lang, s, what, kind)[u[cuts[s] : cuts[s + 1]] - starts[s]]
        return out[back]

    def counts(self, lang: str, places: np.ndarray) -> np.ndarray:
        return self.values(lang, places, "counts", "<i8")

    def keys(self, lang: str, places: np.ndarray) -> np.ndarray:
        return self.values(lang, places, "keys", "<u8")


def sizes_of(rows: list, shards: int) -> dict[str, np.ndarray]:
    """Numbers of keys by language and range (one row each, so languages times shuffle partitions)."""
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r["lang"], np.zeros(shards, np.int64))[r["range"]] = r["n"]
    return out


def word_runs(batch: pa.RecordBatch):
    """Of slices of (lang, text) rows: language, bytes, starts, ends, hashes of its words, and whether the next word follows in the piece."""
    langs = batch.column(0).to_pylist()
    for lo, hi, buf, off in W.slices(batch, "text", SLICE):
        buf = W.LOWER[buf]
        starts, ends, first = W.spans(buf, off, GAP)
        if not len(starts):
            continue
        hashes = W.hasher().ranges(buf, starts, ends)
        breaks = np.concatenate([[0], np.cumsum(BREAK[buf])])
        row = np.repeat(np.arange(hi - lo), np.diff(first))
        follows = np.zeros(len(starts), bool)
        follows[:-1] = (breaks[ends[:-1]] == breaks[starts[1:]]) & (row[:-1] == row[1:])
        names, code = np.unique(np.array([str(x) for x in langs[lo:hi]], object).astype(str), return_inverse=True)
        code = code[row]
        for i, lang in enumerate(names):
            mine = code == i
            if mine.any():
                yield str(lang), buf, starts[mine], ends[mine], hashes[mine], follows[mine]


def strings(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    size = ends - starts
    off = np.concatenate([[0], np.cumsum(size)])
    data = buf[np.repeat(starts - off[:-1], size) + np.arange(off[-1])]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())).cast(pa.string())


def word_counts(rows: DataFrame) -> DataFrame:
    """lang, word, hash, n of all words, and of the null word the number of all occurrences."""

    def count(batches):
        held: dict[str, list] = {}
        totals: dict[str, int] = {}
        size = 0

        def summed(parts):
            h = np.concatenate([p[0] for p in parts])
            n = np.concatenate([p[1] for p in parts])
            u, at, back = np.unique(h, return_index=True, return_inverse=True)
            return u, np.bincount(back, n, len(u)).astype(np.int64), pa.concat_arrays([p[2] for p in parts]).take(pa.array(at))

        def out():
            for lang, parts in held.items():
                u, n, word = summed(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), word, pa.array(W.unsigned(u)), pa.array(n)], names=["lang", "word", "hash", "n"])

        for batch in batches:
            for lang, buf, starts, ends, h, _ in word_runs(batch):
                u, at, n = np.unique(h, return_index=True, return_counts=True)
                parts = held.setdefault(lang, [])
                parts.append((u, n, strings(buf, starts[at], ends[at])))
                totals[lang] = totals.get(lang, 0) + len(h)
                size += len(u)
            if size > HELD // 8:
                held = {lang: [summed(parts)] for lang, parts in held.items()}
                size = sum(len(p[0][0]) for p in held.values())
                if size > HELD // 16:
                    yield from out()
                    held, size = {}, 0
        yield from out()
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array([None] * len(totals), pa.string()), pa.array([0] * len(totals), pa.int64()), pa.array(list(totals.values()), pa.int64())], names=["lang", "word", "hash", "n"])

    return rows.mapInArrow(count, "lang string, word string, hash long, n long").groupBy("lang", "word").agg(F.first("hash").alias("hash"), F.sum("n").alias("n"))


def write_words(vocabulary: DataFrame, path: str, shards: int) -> Frequent:
    """The arrays of the frequent words."""

    def write(group: pa.Table) -> pa.Table:
        lang, shard = group.column("lang")[0].as_py(), group.column("range")[0].as_py()
        keys, counts = group.column("hash").to_numpy().view(np.uint64), group.column("n").to_numpy()
        order = np.argsort(keys, kind="stable")
        at = folder(path, "words", lang)
        put(f"{at}/keys-{shard}", keys[order].astype("<u8"))
        put(f"{at}/counts-{shard}", counts[order].astype("<i8"))
        return pa.table({"lang": [lang], "range": pa.array([shard], pa.int32()), "n": [len(keys)]})

    shard = F.shiftright(F.shiftrightunsigned("hash", 32) * shards, 32).cast("int")  # as counts.shard_of
    rows = vocabulary.select("lang", shard.alias("range"), "hash", "n").groupBy("lang", "range").applyInArrow(write, "lang string, range int, n long")
    sizes = sizes_of(rows.collect(), shards)
    if max((int(s.sum()) for s in sizes.values()), default=0) >> ID_BITS:
        raise ValueError(f"a language has 2**{ID_BITS} frequent words or more")
    return Frequent(path, "words", sizes)


def pair_keys(known: tuple[Frequent, ...], lang: str, h: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words' ids, and where pairs of frequent words begin and the pairs' keys."""
    ids = known[0].places(lang, h)
    at = np.flatnonzero(follows[:-1] & (ids[:-1] >= 0) & (ids[1:] >= 0))
    return ids, at, W.mix(ids[at].astype(np.uint64) << U64(ID_BITS) | ids[at + 1].astype(np.uint64))


def triple_keys(known: tuple[Frequent, ...], lang: str, h: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, at, keys = pair_keys(known, lang, h, follows)
    pairs = np.full(len(h) + 1, -1, np.int64)
    pairs[at] = known[1].places(lang, keys)
    at = at[(pairs[at] >= 0) & (pairs[at + 1] >= 0)]
    return ids, at, W.mix(pairs[at].astype(np.uint64) << U64(ID_BITS) | ids[at + 2].astype(np.uint64))


LEVELS = {2: pair_keys, 3: triple_keys}
MINED = "lang string, part int, shard int, keys binary, counts binary"


def mined(rows: DataFrame, size: int, known: tuple[Frequent, ...], shards: int) -> DataFrame:
    """Every shard's phrases of ``size`` words with frequent parts: packed keys and counts by key range."""

    def mine(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() % PARTS
        held: dict[str, Tally] = {}

        def out():
            for lang, tally in held.items():
                for b in tally.rows():
                    n = b.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([part] * n, pa.int32()), *b.columns], names=["lang", "part", *b.schema.names])

        for batch in batches:
            for lang, _, _, _, h, follows in word_runs(batch):
                keys = LEVELS[size](known, lang, h, follows)[2]
                tally = held.setdefault(lang, Tally(shards))
                for start in range(0, len(keys), HELD // 2):
                    if sum(t.held for t in held.values()) > HELD // 2:
                        yield from out()
                    list(tally.add(keys[start : start + HELD // 2]))  # holds them: never full here
        yield from out()

    return rows.mapInArrow(mine, MINED)


def frequent(group: pa.Table, support: int, parts: int = PARTS) -> tuple[np.ndarray, np.ndarray]:
    """Keys and exact counts of a key range's frequent phrases from the tables of all shards."""
    number = group.column("part").to_numpy()
    tables = [merged(group.filter(pa.array(number == p))) for p in np.unique(number)]
    local = -(-support // parts)
    union = np.unique(np.concatenate([keys[counts >= local] for keys, counts in tables]))
    total = np.zeros(len(union), np.int64)
    for keys, counts in tables:
        at = np.minimum(np.searchsorted(keys, union), len(keys) - 1)
        total += np.where(keys[at] == union, counts[at], 0)
    return union[total >= support], total[total >= support]


PHRASES = "lang string, size int, range int, key long, a long, l1 long, r1 long, l2 long, r2 long, pair1 long, pair2 long"


def counted(rows: DataFrame, size: int, known: tuple[Frequent, ...], shards: int, path: str, support: int) -> DataFrame:
    """The frequent phrases of ``size`` words with the counts of their parts at each cut.

    ``key`` is the mixed key; ``pair1`` and ``pair2`` are the keys of a triple's pairs.
    """

    def count(group: pa.Table) -> pa.Table:
        lang, shard = group.column("lang")[0].as_py(), group.column("shard")[0].as_py()
        keys, a = frequent(group, support)
        plain = unmix(keys)
        left, right = (plain >> U64(ID_BITS)).astype(np.int64), (plain & ID_MASK).astype(np.int64)
        none = pa.nulls(len(keys), pa.int64())
        if size == 2:
            at = folder(path, "pairs", lang)
            put(f"{at}/keys-{shard}", keys.astype("<u8"))
            put(f"{at}/counts-{shard}", a.astype("<i8"))
            cuts = [pa.array(known[0].counts(lang, left)), pa.array(known[0].counts(lang, right)), none, none, none, none]
        else:
            first = known[1].keys(lang, left)
            ids = unmix(first)
            one, two = ids >> U64(ID_BITS), ids & ID_MASK
            second = W.mix(two << U64(ID_BITS) | right.astype(np.uint64))
            cuts = [pa.array(x) for x in (known[0].counts(lang, one.astype(np.int64)), known[1].counts(lang, known[1].places(lang, second)), known[1].counts(lang, left), known[0].counts(lang, right), W.unsigned(first), W.unsigned(second))]
        n = len(keys)
        columns = [pa.array([lang] * n, pa.string()), pa.array([size] * n, pa.int32()), pa.array([shard] * n, pa.int32()), pa.array(W.unsigned(keys)), pa.array(a), *cuts]
        return pa.Table.from_arrays(columns, names=[x.split()[0] for x in PHRASES.split(", ")])

    return stored(mined(rows, size, known, shards).groupBy("lang", "shard").applyInArrow(count, PHRASES), f"phrases-{size}")


def _score(left: str, right: str) -> Column:
    return F.expr(f"cast(cast(a as decimal(19,0)) * a * 1000000 div (cast({left} as decimal(19,0)) * {right}) as bigint)")


def collocations(docs: DataFrame, support: int = SUPPORT, inside: int = INSIDE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    spark = docs.sparkSession
    W.small_batches(spark)
    shards = partitions(spark)
    path = f"{shared_dir(spark)}/collocations-{uuid.uuid4().hex}"
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    vocabulary = stored(word_counts(rows).where((F.col("n") >= support) | F.col("word").isNull()), "vocabulary")
    word_rows = vocabulary.where("word is not null")
    words = write_words(word_rows, path, shards)
    pair_rows = counted(rows, 2, (words,), shards, path, support)
    pairs = Frequent(path, "pairs", sizes_of(pair_rows.groupBy("lang", "range").agg(F.count(F.lit(1)).alias("n")).collect(), shards))
    if max((int(s.sum()) for s in pairs.sizes.values()), default=0) >> (64 - ID_BITS):
        raise ValueError(f"a language has 2**{64 - ID_BITS} frequent pairs or more")
    triple_rows = counted(rows, 3, (words, pairs), shards, path, support)

    # A pair falls to the triple that holds the most of its occurrences.
    longer = triple_rows.select("lang", F.explode(F.array("pair1", "pair2")).alias("key"), F.col("a").alias("longer")).groupBy("lang", "key").agg(F.max("longer").alias("longer"))
    kept = pair_rows.join(longer, ["lang", "key"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    kept = kept.select("lang", "size", "key", "a", F.col("l1").alias("l"), F.col("r1").alias("r"), _score("l1", "r1").alias("score"))
    one, two = _score("l1", "r1"), _score("l2", "r2")
    best = F.when(two < one, F.struct(F.col("l2").alias("l"), F.col("r2").alias("r"), two.alias("score"))).otherwise(F.struct(F.col("l1").alias("l"), F.col("r1").alias("r"), one.alias("score")))
    triples = triple_rows.select("lang", "size", "key", "a", best.alias("best")).select("lang", "size", "key", "a", "best.*")
    # The last that counts may tie with others, which the phrase decides.
    ahead = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    leading = kept.unionByName(triples).withColumn("place", F.rank().over(ahead)).where(F.col("place") <= top).drop("place")

    def spelled(batches):
        for batch in batches:
            keys, langs, sizes = batch.column(2).to_numpy().view(np.uint64), np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy()
            out = [[] for _ in keys]
            for lang in set(langs):
                for size in (2, 3):
                    at = np.flatnonzero((langs == lang) & (sizes == size))
                    if not len(at):
                        continue
                    plain = unmix(keys[at])
                    ids = [(plain >> U64(ID_BITS)).astype(np.int64), (plain & ID_MASK).astype(np.int64)]
                    if size == 3:
                        first = unmix(pairs.keys(lang, ids[0]))
                        ids = [(first >> U64(ID_BITS)).astype(np.int64), (first & ID_MASK).astype(np.int64), ids[1]]
                    for i, found in zip(at, np.column_stack([words.keys(lang, x).view(np.int64) for x in ids]), strict=True):
                        out[i] = found.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], names=[*batch.schema.names, "hashes"])

    leading = leading.select("lang", "size", "key", "a", "l", "r", "score")
    spelt = leading.mapInArrow(spelled, "lang string, size int, key long, a long, l long, r long, score long, hashes array<long>")
    same = ["lang", "size", "key", "a", "l", "r", "score"]
    parts = spelt.select(*same, F.posexplode("hashes").alias("at", "hash")).join(word_rows.select("lang", "hash", "word"), ["lang", "hash"])
    phrases = parts.groupBy(*same).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    totals = vocabulary.where("word is null").select("lang", F.col("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = phrases.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = f"""
with piece as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) as p from documents),
ws as (select lang, regexp_extract_all(p, '[^\\x20\\x09]+') as w from piece),
pos as (select lang, w, unnest(range(1, len(w) + 1)) as i from ws),
gram as (
  select lang, 1 as k, w[i] as phrase from pos
  union all select lang, 2, w[i] || ' ' || w[i + 1] from pos where i + 1 <= len(w)
  union all select lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] from pos where i + 2 <= len(w)),
f as materialized (select lang, k, phrase, string_split(phrase, ' ') as ws, count(*) as c from gram group by 1, 2, 3),
total as (select lang, sum(c) as n from f where k = 1 group by 1),
cand as (select * from f where k > 1 and c >= {SUPPORT}),
often as (select lang, k, phrase, c from f where c >= {SUPPORT}),
halves as (
  select lang, k, phrase, c as a, j, array_to_string(ws[1 : j], ' ') as lp, array_to_string(ws[j + 1 : k], ' ') as rp
  from (select *, unnest(range(1, k)) as j from cand)),
cut as (
  select h.lang, h.k, h.phrase, h.a, h.j, fl.c as l, fr.c as r, (1000000::hugeint * h.a * h.a) // (fl.c::hugeint * fr.c) as score
  from halves h join often fl on fl.lang = h.lang and fl.phrase = h.lp join often fr on fr.lang = h.lang and fr.phrase = h.rp),
best as (select * from cut qualify row_number() over (partition by lang, phrase order by score, j) = 1),
inside as (
  select lang, array_to_string(ws[j : j + 1], ' ') as phrase, max(c) as longer
  from cand, (values (1), (2)) as t(j) where k = 3 group by 1, 2),
kept as (
  select b.* from best b left join inside i on i.lang = b.lang and i.phrase = b.phrase and b.k = 2
  where i.longer is null or 100 * i.longer < {INSIDE} * b.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score
from ranked join total using (lang) where rank <= {TOP}
"""


@register("op12_phrase_collocations", SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
