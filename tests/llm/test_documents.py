"""The operators on documents against brute force, on a table with every odd case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from jobscope.llm import decontaminate, id_files, imatch, kneser_ney, language_id, license_scan, near_dedup, sampled_pieces, substring_dedup
from tests.llm.fixtures import CLASHING, SCHEMA, clashing, odd_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def rows():
    return odd_documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(clashing(rows), CLASHING).repartition(3).cache()


def crc(i):
    return zlib.crc32(("null" if i is None else str(i)).encode())


OPERATORS = {
    "language": language_id.identify,
    "accepted": language_id.accepted,
    "fingerprints": imatch.fingerprints,
    "lm": kneser_ney.score,
    "substrings": substring_dedup.remove_repeats,
    "near": near_dedup.near_duplicates,
    "licenses": license_scan.scan,
    "samples": lambda d: sampled_pieces.samples(d, sampled_pieces.default_model()),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_an_empty_table_gives_an_empty_result(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).count() == 0


def test_language_id(docs, rows):
    counts = defaultdict(Counter)

    def grams(text):
        padded = re.sub(r"[^\w]|[\d_]", " ", (text or "").lower())
        padded = "".join(c if c.isalpha() else " " for c in padded)
        out = Counter()
        for w in padded.split():
            out.update(w)
            w = f" {w} "
            for n in (2, 3):
                out.update(w[i : i + n] for i in range(len(w) - n + 1))
        return out

    for i, text, lang, *_ in rows:
        if crc(i) % 4 != 2 and lang is not None:
            counts[lang].update(grams(text))
    key = lambda g: sum((1 if c == " " else ord(c) + 2) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    top = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], key(x[0])))[: language_id.PROFILE]]
    profiles = {lang: {g: r for r, g in enumerate(top(c))} for lang, c in counts.items()}
    want = []
    for i, text, *_ in rows:
        own = top(grams(text))
        if not own:
            want.append((i, crc(i) % 4 == 2, "und", 0.0))
            continue
        apart = {lang: sum(abs(p[g] - r) if g in p else language_id.PROFILE for r, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(apart), key=apart.get)
        want.append((i, crc(i) % 4 == 2, best, round(1 - apart[best] / (len(own) * language_id.PROFILE), 9)))
    got = [(r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in language_id.identify(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = language_id.accepted(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(w[2] != "und" for w in want)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None, None, 9)], SCHEMA)
    assert language_id.identify(docs).first().lang_pred == "und"


def test_fingerprints(docs, rows):
    got = imatch.fingerprints(docs).collect()
    tie = lambda t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big", signed=True)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, tie(r[1] or "")))
    want = []
    for r, nxt in zip(order, order[1:] + order[:1], strict=True):
        text, n = r[1] or "", len(r[1] or "")
        want.append((r[0], n, hashlib.sha256((text[: n - n // 4] + (nxt[1] or "")[: n // 4]).encode()).hexdigest()))
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=str) == sorted(want, key=str)
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    by_text = defaultdict(set)
    texts = {r[0]: r[1] for r in rows if r[0] is not None and r[0] < 63}
    for r in got:
        if r.doc_id in texts:
            by_text[texts[r.doc_id] or ""].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert np.mean([r.near_edited for r in got]) > np.mean([r.near_next for r in got]) + 0.1
    df = Counter(w for r in rows for w in set(WORD.findall((r[1] or "").translate(ASCII_LOWER))))
    band = sum(len(rows) * math.exp(-imatch.IDF_MOST) <= c <= len(rows) * math.exp(-imatch.IDF_LEAST) for c in df.values())
    assert len(imatch.lexicon(docs)) == band


def test_fingerprint_of_a_single_document(spark):
    docs = spark.createDataFrame([(5, "one two three four", None, None, 18)], SCHEMA)
    r = imatch.fingerprints(docs).first()
    assert r.edited_sha256 == hashlib.sha256(b"one two three one ").hexdigest() or r.n_chars == 18
    assert r.near_next == 1.0
    none = spark.createDataFrame([(None, "a b", None, None, 3), (None, "c d", None, None, 3)], SCHEMA)
    assert imatch.fingerprints(none).count() == 2


def brute_kneser_ney(train, texts):
    tokens = lambda t: WORD.findall((t or "").translate(ASCII_LOWER)) + ["</s>"]
    uni, pairs = Counter(), Counter()
    for t in train:
        ts = tokens(t)
        uni.update(ts)
        pairs.update(zip(["<s>"] + ts[:-1], ts, strict=True))

    def discounts(values):
        n = [sum(v == k for v in values) for k in (1, 2, 3, 4)]
        return kneser_ney.discounts(n)

    d, follows = discounts(pairs.values()), Counter(w for _, w in pairs)
    low, total = discounts(follows.values()), max(len(pairs), 1)
    off = lambda c, d: 0 if c == 0 else d[min(c, 3) - 1]
    spare = sum(off(c, low) for c in follows.values()) / total if pairs else 1.0
    v, n = len(uni), sum(uni.values())
    lower = lambda w: max(follows[w] - off(follows[w], low), 0) / total + spare / (v + 1)
    context = defaultdict(list)
    for (a, _), c in pairs.items():
        context[a].append(c)
    out = []
    for t in texts:
        ts = tokens(t)
        score = base = 0.0
        for a, w in zip(["<s>"] + ts[:-1], ts, strict=True):
            base += math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1)))
            p, cs = lower(w), context.get(a)
            if cs:
                c = pairs[a, w]
                p = max(c - off(c, d), 0) / sum(cs) + sum(off(c, d) for c in cs) / sum(cs) * p
            score += math.log10(p)
        out.append((len(ts), sum(w in uni for w in ts), n, base, score))
    return out


def test_kneser_ney(docs, rows):
    want = [(r[0], crc(r[0]) % 10 == 0, *x) for r, x in zip(rows, brute_kneser_ney([r[1] for r in rows if crc(r[0]) % 10], [r[1] for r in rows]), strict=True)]
    got = kneser_ney.score(docs).collect()
    order = lambda x: (str(x[0]), x[2], round(x[5], 4))
    for a, b in zip(sorted(map(tuple, got), key=order), sorted(want, key=order), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], abs=1e-6)


def test_kneser_ney_without_training_rows(spark):
    held = next(i for i in range(100) if crc(i) % 10 == 0)
    r = kneser_ney.score(spark.createDataFrame([(held, "a b", None, None, 3)], SCHEMA)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0)


def brute_removal(rows):
    first = {}
    words = [WORD.findall(r[1] or "") for r in rows]
    for r, ws in zip(rows, words, strict=True):
        if r[0] is not None:
            for i in range(len(ws) - 12):
                k = tuple(ws[i : i + 13])
                first[k] = min(first.get(k, r[0]), r[0])
    out = []
    for r, ws in zip(rows, words, strict=True):
        gone = set()
        if r[0] is not None:
            for i in range(len(ws) - 12):
                if first[tuple(ws[i : i + 13])] < r[0]:
                    gone.update(range(i, i + 13))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((r[0], len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup(docs, rows):
    got = substring_dedup.remove_repeats(docs)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_removal(rows)


def test_substring_dedup_of_few_words(spark):
    """Few distinct words: windows repeat inside documents and across many."""
    rng = random.Random(4)
    rows = [(rng.randrange(60), " ".join(rng.choice("ab") for _ in range(rng.randrange(200))), None, None, 0) for _ in range(60)]
    rows += [(100 + i, "x y z " * 20, None, None, 0) for i in range(20)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_removal(rows)


def brute_components(rows):
    sets = {}
    for r in rows:
        ws = WORD.findall((r[1] or "").translate(ASCII_LOWER))
        sets.setdefault(r[0], []).append({tuple(ws[i : i + 5]) for i in range(max(len(ws) - 4, 1))} if ws else set())
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if any(s and t and 100 * len(s & t) >= 75 * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_near_duplicates(docs, rows):
    root = brute_components(rows)
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == root.get(r.doc_id)
        assert r.kept == (r.doc_id is None or r.component_id == r.doc_id)


def test_near_duplicates_of_a_family_under_the_threshold(spark):
    """Copies of one text with many edits: some linked, most not, several components in a bucket."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        ws = list(base)
        for _ in range(rng.randrange(1, 12)):
            ws[rng.randrange(len(ws))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(ws), None, None, 0))
    root = brute_components(rows)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert got == root


def test_likelihood_is_near_the_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 1200, dtype=np.uint64)
    a, b = x[:1000], x[200:]
    k1, k2 = (near_dedup.registers(near_dedup.minima(s)) for s in (a, b))
    assert abs(near_dedup.likelihood(k1, k2, 1000, 1000) - 2 / 3) < near_dedup.MARGIN
    both = near_dedup.registers(near_dedup.minima(x))
    assert (np.maximum(k1, k2) == both).all()  # mergeable


def test_license_scan(spark):
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n"
    rows = [
        (1, "Some text here.\nReleased under the MIT License.\nMore text.", "MIT", ""),
        (2, "no end |\nLicensed under CC BY-NC 4.0.", "CC-BY-NC-4.0", ""),
        (3, "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n", "BSD-2-Clause", ""),
        (4, "The software license of nobody.", "", ""),
        (5, None, "", ""),
        (6, "", "", ""),
        (7, "Released under the MIT License.\nLicensed under CC BY 4.0.\nReleased under the MIT License.", "MIT,CC-BY-4.0", ""),
        (8, "See the GNU General Public License for more details.", "", "gpl-details"),
        (9, apache.split("\nYou may")[0], "Apache-2.0", "apache2-use"),
    ]
    docs = spark.createDataFrame([(r[0], r[1], None, None, 0) for r in rows], SCHEMA)
    out = license_scan.scan(docs)
    assert {r.doc_id: (r.licenses, r.unmatched) for r in out.collect()} == {r[0]: r[2:] for r in rows}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_license_scan_of_wrapped_notices(spark):
    gaps = ["\n", "\n  ", "  ", "\t", "\u00a0", "-"]
    docs = spark.createDataFrame([(i, f"Some text.\nAll rights{g}reserved.\nMore text.", None, None, 0) for i, g in enumerate(gaps)], SCHEMA)
    assert {r.doc_id: (r.sentence_ids, r.licenses) for r in license_scan.scan(docs).collect()} == {i: ("<reserved>", "All-rights-reserved") for i in range(len(gaps))}


def test_license_hints_are_within_words_of_every_known_sentence():
    assert all(h.isalnum() for h in license_scan.HINTS)
    assert all(any(h in s for h in license_scan.HINTS) for s in license_scan.KNOWN)


def test_license_scan_of_odd_rows(docs, rows):
    assert license_scan.scan(docs).count() == len(rows)


def test_id_files(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(id_files.default_tokenizer())
    more = [(200, "it's 'twas I'll  we've\n\n 're x'y 's\t\tz ", None, None, 0), (201, "<|endoftext|> end", None, None, 0), (202, " \n", None, None, 0)]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(more, SCHEMA).select("doc_id", "text"))
    path = str(tmp_path / "ids")
    id_files.write(table, id_files.default_tokenizer(), path)
    got = [tuple(r) for r in id_files.read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    tie = lambda t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big", signed=True)
    start, want = 0, []
    for r in sorted([*rows, *more], key=lambda r: (r[0] is None, r[0] or 0, tie(r[1] or ""))):
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda x: x[1]) == want


def test_id_files_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    id_files.write(spark.createDataFrame([], SCHEMA), id_files.default_tokenizer(), path)
    assert id_files.read(spark, path).count() == 0


def test_samples(docs, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sampled_pieces.default_model())
    got = sampled_pieces.samples(docs, sampled_pieces.default_model(), k=3).collect()
    by = defaultdict(list)
    texts = {r[0]: r[1] for r in rows if r[0] is not None and r[0] < 63}
    for r in got:
        if r.doc_id in texts:
            by[r.doc_id].append(r)
            assert r.round_trip and sp.decode(r.ids) == (texts[r.doc_id] or "")
            assert r.n_tokens == len(r.ids) and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    for rs in by.values():
        rs.sort(key=lambda r: r.sample)
        assert len({tuple(r.ids) for r in rs}) == len(rs)
        assert all(a.perturbed >= b.perturbed for a, b in zip(rs[:-1], rs[1:], strict=True))
        assert all(0 <= r.inclusion <= 1 for r in rs)
    assert len(by) == len(texts)
    again = sampled_pieces.samples(docs.repartition(5), sampled_pieces.default_model(), k=3)
    key = lambda rs: sorted((str(r.doc_id), r.sample, r.ids_crc32) for r in rs)
    assert key(got) == key(again.collect())


def test_samples_of_the_query_can_be_read(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sampled_pieces.default_model())
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = sampled_pieces.op9(spark, sf).collect()
    assert {r.doc_id for r in got} == set(texts)
    assert all(sp.decode(r.ids) == texts[r.doc_id] for r in got if r.round_trip)


def test_inclusion_is_that_of_sampling_without_replacement():
    model = sampled_pieces.pieces(sampled_pieces.default_model())
    keys = sampled_pieces.W.mix(np.arange(3000, dtype=np.uint64) + np.uint64(17))
    everything = {tuple(x[0].tolist()): x[1] for x in sampled_pieces.sample_slice(model, ["then"], keys[:1], 50)[0]}
    p = {s: math.exp(v) for s, v in everything.items()}
    assert sum(p.values()) == pytest.approx(1, abs=1e-9)
    want = {s: p[s] + sum(p[t] * p[s] / (1 - p[t]) for t in p if t != s) for s in p}
    seen, weighted = Counter(), Counter()
    for got in sampled_pieces.sample_slice(model, ["then"] * len(keys), keys, 2):
        for ids, _, _, q in got:
            seen[tuple(ids.tolist())] += 1
            weighted[tuple(ids.tolist())] += 1 / q
    for s in p:
        assert seen[s] / len(keys) == pytest.approx(want[s], abs=0.03)
    top = max(p, key=p.get)
    assert weighted[top] / len(keys) == pytest.approx(1, abs=0.1)  # Horvitz-Thompson


def test_decontamination(spark, rows):
    rng = random.Random(2)
    item = [f"q{rng.randrange(900)}" for _ in range(40)]
    answer = "the answer is forty two"
    bench = spark.createDataFrame([(1, " ".join(item) + ". " + answer + "."), (2, None), (3, ""), (4, "!!"), (None, "zz yy xx ww vv uu")], "item_id long, text string")
    words = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    changed = [w if i % 4 else f"r{i}" for i, w in enumerate(item)]
    docs = [
        (300, " ".join(words(200) + item + answer.split() + words(100))),
        (301, " ".join(words(150) + changed + ["and"] + answer.split() + words(80))),
        (302, " ".join(words(300))),
        (303, " ".join(rng.sample(item, 40))),
        (304, " ".join(item[:10] + words(60))),
        (305, " ".join(words(50) + "zz yy xx ww vv uu".split() + words(50))),
    ]
    table = spark.createDataFrame([*[(r[0], r[1]) for r in rows], *docs], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table, bench).collect()}
    assert got == {(300, 1), (301, 1), (305, None)}
    left = decontaminate.clean(table, bench)
    assert left.count() == len(rows) + 3
    assert decontaminate.contaminated(table, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(table.limit(0), bench).count() == 0


def test_decontamination_finds_all_that_verifies(spark):
    rng = random.Random(5)
    vocabulary = [f"t{i}" for i in range(400)]
    words = lambda n: rng.choices(vocabulary, [1 / (i + 3) for i in range(400)], k=n)
    items = [words(rng.randint(14, 50)) + ["."] + words(rng.randint(2, 9)) for _ in range(10)]
    bench = [(i, " ".join(x).replace(" .", ".") + ".") for i, x in enumerate(items)]
    docs = []
    for i, item in enumerate(items):
        for lost in (0, 0.25, 0.45):
            cut = item.index(".")
            copy = [rng.choice(vocabulary) if rng.random() < lost else w for w in item[:cut]] + item[cut + 1 :]
            docs.append((len(docs), words(rng.randint(0, 200)) + copy + words(rng.randint(0, 200))))
    docs += [(len(docs) + i, words(300)) for i in range(5)]

    def table(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    want = set()
    for d, text in docs:
        for i, item in enumerate(items):
            flat, answer = [w for w in item if w != "."], item[item.index(".") + 1 :]
            size = len(flat) * 3 // 2 + 4
            for s in range(len(text)):
                part = text[s : s + size]
                if text[s] not in flat or sum(w in flat for w in part) < len(flat) / 2:
                    continue
                cover = table(flat, part) / len(flat)
                if cover >= 0.75 or (cover >= 0.5 and table(answer, part) / len(answer) >= 0.8):
                    want.add((d, i))
                    break
    assert len(want) > 20
    got = decontaminate.contaminated(spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_longest_common_subsequence():
    rng = random.Random(6)
    for _ in range(50):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 20))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        a = np.array(a)
        assert decontaminate.common(a, decontaminate._masks(a), b) == table[-1][-1]
