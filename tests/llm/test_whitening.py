"""Whitening against numpy's dense eigensolver, exact integers, and every odd case of a vector table."""

import math

import numpy as np
import pytest

from jobscope.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component string, n int, x string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, "c", 2, "x") for i, v in rows], SCHEMA).repartition(parts)


def expected(rows, k=32):
    """{(row number, component): (deviation, |whitened|)}, explained, n by a dense solver on exact integers."""
    good = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * c) + 1000000 for c in v] for _, v in good], object)
    n, s = len(x), x.sum(axis=0)
    dev = n * x - s
    y = dev.astype(float) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return [i for i, _ in good], [int((r**2).sum()) for r in dev], y @ v / np.sqrt(e), e / ((y**2).sum() / n), n


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 40)) * np.exp(-np.arange(40) / 15) @ np.linalg.qr(rng.standard_normal((40, 40)))[0]
    out = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    out += [(1000, None), (1001, [None] + [1.0] * 39), (1002, [math.nan] + [1.0] * 39), (1003, [math.inf] * 40), (1004, [-math.inf] + [0.0] * 39)]
    out += [(None, out[0][1]), (5, out[5][1]), (5, out[6][1])]
    return out


def test_against_a_dense_solver(spark, rows):
    got = whitening.whiten(frame(spark, rows)).collect()
    ids, deviation, w, explained, n = expected(rows)
    assert len(got) == 32 * n and {r.n for r in got} == {n}
    assert {r.component for r in got} == set(range(1, 33))
    assert all(abs(r.explained - explained[r.component - 1]) < 1e-10 for r in got)
    assert all(r.identity_error < 1e-9 for r in got) and len({r.identity_error for r in got}) == 1
    want = sorted(((-1 if i is None else i, d, c + 1, abs(w[j, c])) for j, (i, d) in enumerate(zip(ids, deviation, strict=True)) for c in range(32)), key=lambda t: t[:3])
    have = sorted(((-1 if r.vec_id is None else r.vec_id, r.deviation, r.component, abs(r.whitened)) for r in got), key=lambda t: t[:3])
    assert [t[:3] for t in want] == [t[:3] for t in have]
    assert max(abs(a[3] - b[3]) for a, b in zip(want, have, strict=True)) < 1e-7
    # one sign for all rows
    by = {(r.vec_id, r.deviation, r.component): r.whitened for r in got if r.vec_id is not None}
    for c in range(32):
        signs = {np.sign(by[i, d, c + 1] * w[j, c]) for j, (i, d) in enumerate(zip(ids, deviation, strict=True)) if i is not None and abs(w[j, c]) > 1e-3}
        assert len(signs) == 1


def test_fewer_dimensions_and_lower_rank(spark):
    rng = np.random.default_rng(5)
    flat = rng.standard_normal((50, 3))
    rows = [(i, [float(a), float(b), float(c), 7.0, 0.0]) for i, (a, b, c) in enumerate(flat)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2, 3} and len(got) == 150
    assert abs(sum({r.component: r.explained for r in got}.values()) - 1) < 1e-12


def test_equal_eigenvalues(spark):
    rows = [(i, [16.0 * (i % 8 == j) for j in range(8)]) for i in range(64)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r.component for r in got} == set(range(1, 8)) and got[0].identity_error < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [math.nan])]])
def test_tables_without_variance(spark, rows):
    df = whitening.whiten(frame(spark, rows, 1) if rows else spark.createDataFrame([], SCHEMA))
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and df.count() == 0


def test_the_query_gives_64_bits(spark, tmp_path):
    frame(spark, [(i, [float(i), float(i * i)]) for i in range(9)]).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = whitening.op13(spark, str(tmp_path))
    assert dict(got.dtypes)["deviation"] == "bigint" and got.count() == 18


def test_other_lengths_and_huge_entries(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.standard_normal((30, 4)) * 1e6)]
    got = whitening.whiten(frame(spark, [*rows, (90, [1.0]), (91, []), (92, [1e30, 0.0, 0.0, 0.0])])).collect()
    ids, deviation, w, _, n = expected(rows)
    assert n == 30 and {r.vec_id for r in got} == set(range(30))
    assert {(r.vec_id, r.deviation) for r in got} == set(zip(ids, deviation, strict=True))


def test_many_partial_products_are_summed_in_buckets(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.standard_normal((300, 6)))]
    there = whitening.blocks(whitening.usable(frame(spark, rows)), 6).repartition(90)
    sums = whitening.Rows(there, 6)
    x = np.floor(64 * np.array([v for _, v in rows], np.float32).astype(float)).astype(np.int64) + 1000000
    assert sums.n == 300 and (sums.sums == x.sum(axis=0)).all()
    q = rng.standard_normal((6, 3))
    assert np.allclose(sums.product(q), np.cov(x.T, bias=True) @ q, rtol=1e-12)


@pytest.mark.parametrize("d,kind", [(64, "random"), (120, "decay"), (120, "pairs"), (60, "low rank")])
def test_solver(d, kind):
    rng = np.random.default_rng(d)
    x = rng.standard_normal((500, d)) * (np.exp(-np.arange(d) / 20) if kind == "decay" else 1)
    if kind == "low rank":
        x = rng.standard_normal((500, 5)) @ rng.standard_normal((5, d))
    if kind == "pairs":
        x = np.linalg.qr(x)[0] * np.repeat(np.linspace(10, 1, d // 2), 2)
    v = x.T @ x / 500
    e, q = whitening.jacobi_davidson(lambda b: v @ b, d, 32)
    want = np.linalg.eigvalsh(v)[::-1][:32]
    assert np.abs(e - want).max() < 1e-13 * want[0]
    assert np.abs(v @ q - q * e).max() < 1e-13 * want[0]
    assert np.abs(q.T @ q - np.eye(32)).max() < 1e-13


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    b = rng.standard_normal((30, 4))
    z = whitening.minres(lambda v, alive: a @ v, b, 60, 1e-12)
    assert np.abs(a @ z - b).max() < 1e-6
