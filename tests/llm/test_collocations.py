"""Collocations against brute force on a small corpus with every odd case."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from jobscope.llm import collocations as C
from jobscope.llm.counts import packed, packed_counts
from tests.llm.fixtures import CLASHING, clashing

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, support=C.SUPPORT, inside=C.INSIDE, top=C.TOP):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII_LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    cand = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= support}
    dropped = set()
    for (lang, p), c in cand.items():
        if len(p) == 3:
            dropped |= {(lang, q) for q in (p[:2], p[1:]) if 100 * c >= inside * f[lang, q]}
    out = []
    for lang in n:
        rows_ = []
        for (g, p), a in cand.items():
            if g != lang or (g, p) in dropped:
                continue
            cuts = [(1000000 * a * a // (f[g, p[:k]] * f[g, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows_.append((-score, -a, " ".join(p).encode(), f[g, p[:k]], f[g, p[k:]]))
        for rank, (s, a, phrase, l, r) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def corpus(seed=4):
    rng = random.Random(seed)
    vocab = ["alpha", "Beta", "gamma", "d", "É", "straße", "日本", "x-y", "\x00z", "it's"]
    rows = []
    for i in range(160):
        words = []
        for _ in range(rng.randint(0, 60)):
            words.append(rng.choice(vocab) if rng.random() < 0.7 else "new york city")
            words.append(rng.choice([" ", "  ", "\t", "\n", ". ", ",", "!? ", "\r\n", " \x0b", "\x0c", "   "]))
        rows.append((i, "".join(words), ["en", "de", None, "und", ""][i % 5], "s"))
    rows += [(200, None, "en", "s"), (201, "", "en", "s"), (None, None, None, None), (203, " .,;\n", "xx", None), (204, "lonely", "yy", None)]
    rows += [(300, "same words here. " * 12, "rep", "s")] * 3
    rows += [(301, " ".join(f"p{i} q{i}" for i in range(6) for _ in range(10)), "ties", "s")]
    rows.append((400, "the LONG text goes on and " * 40_000, "long", "s"))  # over a slice
    rows.append((401, "a" * 70_000 + " " + "a" * 70_000, "long", "s"))
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


def collected(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(clashing(corpus()), CLASHING).repartition(7).cache()


def test_against_brute_force(docs):
    assert collected(C.collocations(docs)) == brute(corpus())


def test_first_of_each_language_with_ties(docs):
    got = collected(C.collocations(docs, support=3, inside=90, top=4))
    assert got == brute(corpus(), 3, 90, 4)
    assert len([r for r in got if r[0] == "ties"]) == 4


def test_whatever_the_slices_and_batches(docs, monkeypatch, spark):
    small = C.collocations(docs.where("doc_id < 160 or doc_id is null").coalesce(1))
    assert collected(small) == brute([r for r in corpus() if r[0] is None or r[0] < 160])


def test_an_empty_table_and_one_without_candidates(spark):
    schema = "doc_id long, text string, lang string"
    assert C.collocations(spark.createDataFrame([], schema)).count() == 0
    assert C.collocations(spark.createDataFrame([(1, "one two three", "en")], schema)).count() == 0


def test_counts_beyond_64_bit_products(spark):
    a, l, r = 3 * 10**14, 5 * 10**14, 10**15
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(C._score("l", "r").alias("s")).first()
    assert row.s == 1000000 * a * a // (l * r)


@pytest.mark.parametrize("seed", range(5))
def test_no_frequent_phrase_is_lost_between_shards(seed):
    """A phrase of just the support, dealt out in any way, is in the union and counted exactly."""
    rng = np.random.default_rng(seed)
    tables = [Counter() for _ in range(C.PARTS)]
    want = Counter()
    for key in range(1, 400):
        for _ in range(int(rng.integers(1, 20))):
            tables[int(rng.integers(C.PARTS)) if key % 2 else key % C.PARTS][key] += 1
            want[key] += 1
    part, keys, counts = [], [], []
    for p, t in enumerate(tables):
        for half in (sorted(t)[::2], sorted(t)[1::2], sorted(t)):  # several rows of a shard, keys in several of them
            part.append(p)
            keys.append(packed(np.array(half, np.uint64)))
            counts.append(packed_counts(np.array([t[k] for k in half], np.int64)))
    got, n = C.frequent(pa.table({"part": pa.array(part, pa.int32()), "keys": keys, "counts": counts}), 20)
    assert dict(zip(got.tolist(), n.tolist(), strict=True)) == {k: 2 * c for k, c in want.items() if 2 * c >= 20}


def test_mixing_is_undone():
    x = np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64)
    assert (C.unmix(C.W.mix(x)) == x).all()
