"""Lattices kept from slice to slice: the same samples, built once."""

import random

import numpy as np
import pyarrow as pa
import pytest

from jobscope.llm import sampled_pieces as S
from tests.llm.fixtures import prose


def rows(texts, monkeypatch, chars, states=S.KNOWN_STATES):
    monkeypatch.setattr(S, "SLICE_CHARS", chars)
    monkeypatch.setattr(S, "KNOWN_STATES", states)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    return [r for b in S.sampler(S.default_model(), 2, True)(iter([batch])) for r in b.to_pylist()]


@pytest.mark.parametrize("states", [0, 300, S.KNOWN_STATES])
def test_slices_and_kept_lattices_do_not_change_the_samples(monkeypatch, states):
    rng = random.Random(5)
    texts = [prose(rng, "en", rng.randint(1, 60)) for _ in range(40)] + ["", "a  b", "na na 世 xé\U0001f600"] + [prose(rng, "de", 200)]
    whole = rows(texts, monkeypatch, 1 << 24)
    assert rows(texts, monkeypatch, 500, states) == whole


def test_a_unit_is_built_once_for_many_slices(monkeypatch):
    built, init = [], S.Lattices.__init__

    def counted(self, model, chars, begin, size):
        built.append(int(size.sum()))
        init(self, model, chars, begin, size)

    monkeypatch.setattr(S.Lattices, "__init__", counted)
    text = prose(random.Random(2), "en", 80)
    rows([text] * 30, monkeypatch, 1000)
    assert sum(built) <= len(text) + 1


def test_every_piece_is_found_and_no_other_string():
    model = S.pieces(S.default_model())
    some = [i for i in range(0, len(model.text), 7) if not model.special[i]]
    for i in some:
        chars = np.frombuffer(model.text[i].encode("utf-32-le"), "<u4")
        lat = S.Lattices(model, chars, np.array([0]), np.array([len(chars)]))
        spans = {(a, b) for a in range(len(chars)) for b in range(a + 1, len(chars) + 1) if model.text[i][a:b] in PLACE}
        got = {(s, int(lat.to[e])) for s in range(len(chars)) for e in range(int(lat.first[s]), int(lat.first[s] + lat.count[s])) if lat.piece[e] >= 0}
        assert got == spans and all(model.text[lat.piece[e]] == model.text[i][s : int(lat.to[e])] for s in range(len(chars)) for e in range(int(lat.first[s]), int(lat.first[s] + lat.count[s])) if lat.piece[e] >= 0)


def _place():
    model = S.pieces(S.default_model())
    return {t for t, special in zip(model.text, model.special, strict=True) if not special}


PLACE = _place()


def test_a_tasks_lattices_stay_small():
    """However many distinct units a task meets: two workers beside an executor's heap have little room."""
    model, known = S.pieces(S.default_model()), S.Known()
    rng = np.random.default_rng(3)
    for _ in range(12):  # 1.5 million code points of units that no other slice has
        chars = rng.choice(np.frombuffer("etaoinshrdlu".encode("utf-32-le"), "<u4"), 1 << 17)
        known.units(model, chars, np.arange(0, 1 << 17, 16), np.full(1 << 13, 16))
    assert sum(getattr(known, name).nbytes for name in known.ARRAYS) < 100e6


def test_a_number_is_mixed_as_an_array_is():
    some = np.random.default_rng(8).integers(0, 1 << 64, 200, dtype=np.uint64)
    assert [S.spread(int(x)) for x in some] == S.W.mix(some).tolist()
    for k in (0, 1, 77, 1_000_003, S.ALL):
        drawn = [((S.step_key(int(x), k) >> 11) + 0.5) * 2.0**-53 for x in some]
        assert drawn == S.uniform(some, np.uint64(k)).tolist()
        assert S.uniform(some, np.uint64(k), 5).tolist() == S.uniform(np.array([S.step_key(int(x), k) for x in some], np.uint64), 5).tolist()


def test_a_texts_own_draws_need_few_arrays(monkeypatch):
    calls, mix = [], S.W.mix
    monkeypatch.setattr(S.W, "mix", lambda h: calls.append(len(h)) or mix(h))
    own = [prose(random.Random(s), "en", 12) for s in range(300)]
    S.sample_slice(S.pieces(S.default_model()), own, np.arange(300, dtype=np.uint64), 2)
    assert len(calls) < 3 * len(own)
