import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from jobscope.llm import counts, words as W
from jobscope.llm.fm_index import FMIndex
from jobscope.llm.range_coder import decode, encode

TEXT = st.text(alphabet="aB é日\t\n\x0b\x1f ", max_size=30)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_words_are_the_patterns(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    for _, _, buf, off in W.slices(batch, "text", 1 << 20):
        starts, ends, first = W.spans(buf, off)
        got = [bytes(buf[a:b]).decode() for a, b in zip(starts, ends, strict=True)]
        rows = [got[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        assert rows == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
        h, _ = W.words(buf, off, lower=False)
        seen = {}
        for w, v in zip(got, h.tolist(), strict=True):
            assert seen.setdefault(w, v) == v
        assert len(set(seen.values())) == len(seen)


def test_gram_rows_stay_in_their_row():
    first = np.array([0, 3, 3, 4, 9])
    assert W.gram_rows(first, 3).tolist() == [0, 4, 5, 6]
    assert W.gram_rows(np.array([0, 1, 2]), 3).tolist() == []


def test_slices_of_a_sliced_batch():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 10, None, "", "y z"])], names=["text"]).slice(1)
    (lo, hi, buf, off), = W.slices(batch, "text")
    assert (lo, hi, bytes(buf), off.tolist()) == (0, 3, b"y z", [0, 0, 0, 3])


def test_packed_keys_and_tally():
    rng = np.random.default_rng(3)
    keys = np.sort(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))
    assert (counts.unpacked(counts.packed(keys)) == keys).all()
    tally = counts.Tally(7)
    raw = rng.integers(0, 1 << 63, 50, dtype=np.uint64)[rng.integers(0, 50, 500)]
    batches = [*tally.add(raw[:200]), *tally.add(raw[200:]), *tally.rows()]
    got = {}
    for b in batches:
        for k, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            for x, n in zip(counts.unpacked(k).tolist(), counts.unpacked_counts(c).tolist(), strict=True):
                got[x] = got.get(x, 0) + n
    want = {int(k): int(n) for k, n in zip(*np.unique(raw, return_counts=True), strict=True)}
    assert got == want


def test_fm_index_counts_patterns():
    rng = np.random.default_rng(5)
    text = np.append(rng.integers(1, 5, 800), 0)
    index = FMIndex(text, 5)
    patterns = np.stack([text[i : i + 6] for i in rng.integers(0, 790, 60)] + [rng.integers(1, 5, 6) for _ in range(60)])
    low, high = index.search(patterns)
    raw = bytes(text.astype(np.uint8))
    for p, a, b in zip(patterns, low, high, strict=True):
        p = bytes(p.astype(np.uint8))
        assert b - a == sum(raw.startswith(p, i) for i in range(len(raw)))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0, 1, 2, 7, 300, 50256, 65535]), max_size=90), min_size=1, max_size=5))
def test_range_coder_round_trip(blocks):
    arrays = [np.array(b, np.uint32) for b in blocks]
    assert [x.tolist() for x in decode(encode(arrays))] == blocks


def test_a_damaged_block_is_found():
    block = bytearray(encode([np.arange(500, dtype=np.uint32) * 7 % 101])[0])
    block[40] ^= 255
    try:
        decode([bytes(block)])
    except ValueError as e:
        assert "checksum" in str(e)
    else:
        raise AssertionError("damage was not found")
