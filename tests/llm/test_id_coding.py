"""Ids by the tokenizers library, many pre-tokens a call, and the coder of their blocks."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from jobscope.llm import byte_bpe
from jobscope.llm import range_coder as R
from jobscope.llm.id_files import default_tokenizer
from tests.llm.fixtures import prose


class Counted:
    """The library's tokenizer, counting the strings that it is given."""

    def __init__(self, inner):
        self.inner, self.strings = inner, 0

    def encode_batch(self, raw, **more):
        self.strings += len(raw)
        return self.inner.encode_batch(raw, **more)

    def encode_batch_fast(self, raw, **more):
        self.strings += len(raw)
        return self.inner.encode_batch_fast(raw, **more)


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(n))


def test_new_pre_tokens_go_to_the_library_together():
    enc = byte_bpe.Encoder(default_tokenizer())
    enc.tokenizer = Counted(enc.tokenizer)
    own = [words(s, 2000) for s in range(4)]
    ids, first = enc.encode([t.encode() for t in own])
    tok = Tokenizer.from_file(default_tokenizer())
    for i, t in enumerate(own):
        assert ids[first[i] : first[i + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids
    assert len({w for t in own for w in t.split()}) > 4000 and enc.tokenizer.strings < 40


@pytest.mark.parametrize("chunk", [1, 3, 512])
def test_texts_of_all_kinds_have_the_librarys_ids(monkeypatch, chunk):
    monkeypatch.setattr(byte_bpe, "CHUNK", chunk)
    rng = random.Random(chunk)
    kinds = ["a", "'s", "'", "''", " '", "'ll", "'r", "re", " ", "  ", "\n", "\t", "\r\n", " ", "9", "²", "½", "Ⅷ", "é", "ß", "世", "\U0001f600", "!?", "-", "_", "<|endoftext|>", "<|", "endoftext", "|>", "x1", "́", "\x00"]
    own = ["".join(rng.choice(kinds) for _ in range(rng.randint(0, 40))) for _ in range(400)] + [prose(rng, "de", 50), "", " ", "\n"]
    tok = Tokenizer.from_file(default_tokenizer())
    enc = byte_bpe.Encoder(default_tokenizer())
    for _ in range(2):  # unknown, then known
        ids, first = enc.encode([t.encode() for t in own])
        for i, t in enumerate(own):
            assert ids[first[i] : first[i + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_pre_tokens_that_share_a_slot_or_are_forgotten(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MOST", 500)
    enc, tok = byte_bpe.Encoder(default_tokenizer()), Tokenizer.from_file(default_tokenizer())
    for s in range(6):
        t = words(s % 4, 400)
        assert enc.encode([t.encode()])[0].tolist() == tok.encode(t, add_special_tokens=False).ids
        enc.near[0][:] = 7  # every slot is another's


def blocks(seed):
    rng = np.random.default_rng(seed)
    yield np.zeros(0, np.uint32)
    yield np.zeros(3000, np.uint32)
    yield np.full(70, R.LARGEST, np.uint32)
    yield np.arange(0, R.LARGEST + 1, 37, dtype=np.uint32)
    yield rng.integers(0, R.LARGEST + 1, 2500).astype(np.uint32)
    yield (1 << rng.integers(0, 16, 2500)).astype(np.uint32)
    yield (2 ** (rng.random(5000) * 15)).astype(np.uint32) // 8
    yield np.tile(rng.integers(0, 50257, 40), 60).astype(np.uint32)
    for n in (1, 2, 15, 16, 17, 63, 64, 65):
        yield rng.zipf(1.3, n).clip(0, R.LARGEST).astype(np.uint32)


def test_blocks_of_all_kinds_come_back_alone_and_together():
    own = list(blocks(1))
    coded = R.encode(own)
    for a, b in zip(own, R.decode(coded), strict=True):
        assert a.tolist() == b.tolist()
    for a, c in zip(own, coded, strict=True):
        if len(a) < 2000:
            assert R.encode([a]) == [c] and R.decode([c])[0].tolist() == a.tolist()


def test_classes_hold_every_id():
    ids = np.arange(R.LARGEST + 1)
    kind = R.CLASS[ids]
    assert ((ids - R.LEAD[kind]) >> R.BELOW[kind] == 0).all() and (ids >= R.LEAD[kind]).all() and kind.max() == R.CLASSES - 1


def test_a_damaged_block_is_an_error():
    rng = np.random.default_rng(4)
    own = (2 ** (rng.random(60) * 15)).astype(np.uint32)
    good = R.encode([own])[0]
    for at in range(len(good)):
        bad = bytearray(good)
        bad[at] ^= 1 << int(rng.integers(8))
        if 4 <= at < 8 and int.from_bytes(bad[4:8], "little") > 5000:
            continue
        try:
            assert R.decode([bytes(bad)])[0].tolist() == own.tolist()  # a bit behind the last that counts
        except ValueError:
            continue
        assert at >= R.HEAD
    with pytest.raises(ValueError):
        R.decode([good[: R.HEAD + 4]])


def test_ids_of_falling_frequency_are_coded_by_their_class():
    """Order 0 tells an id's two leading bits, and few others are spent: log2 n a bit more than the entropy."""
    rng = np.random.default_rng(9)
    own = [(2 ** (rng.random(R.BLOCK) * 12)).astype(np.uint32) for _ in range(20)]
    size = sum(map(len, R.encode(own))) / (20 * R.BLOCK)
    p = np.diff(np.log2(np.arange(1, 4097))) / 12
    assert 8 * size < -(p * np.log2(p)).sum() * 1.09
