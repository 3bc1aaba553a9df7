"""Samples without replacement of more than two, on texts of several units."""

import math
import random

import numpy as np
import pytest

from jobscope.llm import sampled_pieces as S
from tests.llm.fixtures import prose

KEYS = lambda n: S.W.mix(np.arange(n, dtype=np.uint64) + np.uint64(11))


@pytest.fixture(scope="module")
def model():
    return S.pieces(S.default_model())


@pytest.mark.parametrize("k", [1, 2, 3, 6, 10])
def test_no_region_that_counts_is_left_out(model, k, monkeypatch):
    rng = random.Random(k)
    own = [prose(rng, "en", rng.randint(1, 14)) for _ in range(60)] + ["a", "", "na na"]
    got = S.sample_slice(model, own, KEYS(len(own)), k)
    init = S.Search.__init__
    monkeypatch.setattr(S.Search, "__init__", lambda self, key, units, k=0: init(self, key, units, 10**6))
    whole = S.sample_slice(model, own, KEYS(len(own)), k)
    for a, b in zip(got, whole, strict=True):
        assert [x[0].tolist() for x in a] == [x[0].tolist() for x in b]
        assert [x[1:] for x in a] == [x[1:] for x in b]


def test_ten_samples_are_distinct_fall_and_decode(model):
    own = [prose(random.Random(3), "de", 12)] * 40
    for got in S.sample_slice(model, own, KEYS(40), 10):
        assert len(got) == 10 and len({x[0].tobytes() for x in got}) == 10
        assert all(a[2] >= b[2] for a, b in zip(got, got[1:], strict=False))
        assert all(model.decode(x[0].tolist()) == own[0] for x in got) and all(0 < x[3] <= 1 for x in got)


def test_the_best_ten_of_all_segmentations(model):
    """Gumbel top-k of an enumerated set has the distribution of the samples: mean perturbed scores by rank agree."""
    text, k, runs = "the cat", 5, 1500
    every = []

    def spell(at, ids, logp, lat):
        if at == lat.end[0]:
            every.append(logp)
            return
        for e in range(int(lat.first[at]), int(lat.first[at]) + int(lat.count[at])):
            spell(int(lat.to[e]), [*ids, e], logp + float(lat.logp[e]), lat)

    joined = S.SPACE + text.replace(" ", S.SPACE)
    total = [0.0]
    for unit in [S.SPACE + w for w in text.split()]:
        chars = np.frombuffer(unit.encode("utf-32-le"), "<u4")
        every.clear()
        lat = S.Lattices(model, chars, np.array([0]), np.array([len(chars)]))
        spell(int(lat.start[0]), [], 0.0, lat)
        total = [a + b for a in total for b in every]
    assert abs(sum(math.exp(t) for t in total) - 1) < 1e-9 and joined
    rng = np.random.default_rng(5)
    noise = np.array(total) + rng.gumbel(size=(runs, len(total)))
    want = -np.sort(-noise, axis=1)[:, :k].mean(axis=0)
    got = S.sample_slice(model, [text] * runs, KEYS(runs), k)
    mean = np.array([[x[2] for x in g] for g in got]).mean(axis=0)
    assert np.abs(mean - want).max() < 0.15
