"""Stages over whole rows against brute force, with repeated and null ids."""

import re

import pytest

from jobscope.llm import stages
from tests.llm.fixtures import CLASHING, SCHEMA, clashing, odd_documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def rows():
    own = odd_documents()
    passage = " ".join(f"shared{i}" for i in range(20))
    more = [
        (70, "one id with two quite different texts, of which this is the first one of them all here", "en", "s0"),
        (70, "while the other text of the same id tells of something else that nobody else has written down", "en", "s0"),
        (None, "a text without id that stands alone in this table and is not like any other text of it", "en", "s0"),
        (None, "a text without id that stands alone in this table and is not like any other text of it", "de", "s0"),
        (None, f"null one {passage} end", "en", "s0"), (71, f"has an id {passage} too", "en", "s0"), (None, f"null two and more {passage}", "en", "s0"),
        (72, "", "en", "s0"), (72, "", "en", "s0"), (72, None, "en", "s0"),
    ]
    return own + [(*r, None if r[1] is None else len(r[1])) for r in more]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(clashing(rows), CLASHING).repartition(3).cache()


def keys(docs):
    """{(id, text): key} as the stage gives them."""
    out = {(r.rest.own.doc_id, r.text): r.doc_id for r in stages.keyed(docs).collect()}
    ids = [r[0] for r in out]
    for (i, _), k in out.items():
        assert (k == i) == (i is not None and ids.count(i) == 1 and k < stages.BEYOND)
    return out


def plain(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_near_duplicates_go_by_row(docs, rows):
    key, sets = {}, {}
    for i, t, *_ in rows:
        k = (i, t)
        w = words((t or "").translate(LOWER))
        sets[k] = {tuple(w[a : a + 5]) for a in range(max(len(w) - 4, 1))} if w else set()
    key = keys(docs) | {(i, t): i for i, t, *_ in rows if [r[0] for r in rows].count(i) == 1}
    names = sorted(sets, key=lambda k: key[k])
    group = {k: k for k in names}

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(names)):
        for b in range(a):
            x, y = sets[names[a]], sets[names[b]]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                group[root(names[a])] = root(names[b]) if key[root(names[b])] < key[root(names[a])] else root(names[a])
                group[root(names[b])] = root(names[a])
    smallest = {}
    for k in names:
        r = root(k)
        smallest[r] = min(smallest.get(r, k), k, key=lambda n: key[n])
    want = []
    for i, t, *_ in rows:
        k = (i, t)
        if not sets[k]:
            want.append(k)
    want += [k for k in names if sets[k] and smallest[root(k)] == k]
    out = stages.without_near_duplicates(docs)
    assert out.dtypes == docs.dtypes
    assert plain(out) == sorted(want, key=repr)
    assert len([k for k in want if k[0] == 70]) == 2  # both texts of one id stay


def test_repeated_passages_go_by_row(docs, rows):
    key = keys(docs) | {(i, t): i for i, t, *_ in rows if [r[0] for r in rows].count(i) == 1}
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for a in range(len(w) - 12):
            g = tuple(w[a : a + 13])
            first[g] = min(first.get(g, key[i, t]), key[i, t])
    want = []
    for i, t, *_ in rows:
        w = words(t)
        gone = {b for a in range(len(w) - 12) if first[tuple(w[a : a + 13])] < key[i, t] for b in range(a, a + 13)}
        want.append((i, " ".join(x for b, x in enumerate(w) if b not in gone) if gone else t))
    out = stages.without_repeats(docs)
    assert out.dtypes == docs.dtypes and plain(out) == sorted(want, key=repr)
    assert any(i is None and "shared1" not in (t or "") and "null" in (t or "") for i, t in want)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())


def test_benchmark_items_go_whatever_the_id(spark, docs):
    item = "the quick brown fox jumps over the lazy dog while seventeen purple engineers calculate orbital trajectories near saturn"
    bad = [(None, f"before {item} after", "en", "s", 1), (500, item, "en", "s", 1), (501, item + " again", "en", "s", 1), (501, "clean text of the same id about nothing in particular", "en", "s", 1)]
    more = spark.createDataFrame(clashing(bad), CLASHING)
    bench = spark.createDataFrame([(1, item, "x")], "item_id long, text string, doc_id string")
    out = stages.without_benchmark(docs.unionByName(more), bench)
    assert plain(out) == sorted([*plain(docs), (501, bad[3][1])], key=repr) and out.dtypes == docs.dtypes


@pytest.mark.parametrize("stage", [stages.without_near_duplicates, stages.without_repeats])
def test_empty_tables(spark, stage):
    assert stage(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_repeated_ids_are_joined(docs, monkeypatch):
    few = {(r.doc_id, r.text) for r in stages.keyed(docs).collect()}
    monkeypatch.setattr(stages, "FEW", 1)
    assert {(r.doc_id, r.text) for r in stages.keyed(docs).collect()} == few
