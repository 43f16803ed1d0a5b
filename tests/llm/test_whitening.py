import sys
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
import compare

from noticeflow.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>, component string, n string"


def exact(rows):
    """(n, sums, covariance as fractions) in Python's own numbers, of the x of rows."""
    n, dim = len(rows), len(rows[0])
    sums = [sum(r[i] for r in rows) for i in range(dim)]
    centred = [[n * r[i] - sums[i] for i in range(dim)] for r in rows]
    return n, sums, centred, [[Fraction(sum(c[i] * c[j] for c in centred), n**3) for j in range(dim)] for i in range(dim)]


def whole(v):
    return [int(np.floor(64 * float(c))) + 1_000_000 for c in v]


def check(result, rows, components=32):
    """The query's rows against the definition."""
    xs = {i: whole(v) for i, v in rows}
    n, sums, centred, v = exact(list(xs.values()))
    by_id = dict(zip(xs, centred, strict=True))
    k = min(components, len(sums))
    assert len(result) == len(xs) * k and {r["n"] for r in result} == {n}
    assert all(r["deviation"] == sum(c * c for c in by_id[r["vec_id"]]) for r in result)
    v = np.array([[float(c) for c in row] for row in v])
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    got = {(r["vec_id"], r["component"]): r for r in result}
    ids = list(xs)
    want = np.array([by_id[i] for i in ids], float) / n @ q / np.sqrt(e)
    have = np.array([[got[i, j + 1]["whitened"] for j in range(k)] for i in ids])
    for j in range(k):
        apart = min(abs(e[j] - e[m]) for m in range(k) if m != j) / e[j] if k > 1 else 1
        if apart > 1e-6:
            sign = np.sign((have[:, j] * want[:, j]).sum())
            assert np.allclose(have[:, j] * sign, want[:, j], atol=1e-7 / apart)
        assert abs(got[ids[0], j + 1]["explained"] - e[j] / np.trace(v)) <= 1e-9 * e[j] / np.trace(v)
    cov = (have - have.mean(axis=0)).T @ (have - have.mean(axis=0)) / n
    assert np.abs(cov - np.eye(k)).max() < 1e-6
    errors = {r["identity_error"] for r in result}
    assert len(errors) == 1 and abs(errors.pop() - np.abs(cov - np.eye(k)).max()) < 1e-9


@pytest.mark.skipif(not compare.present, reason="no test tables")
def test_query_against_its_definition(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{compare.SMALL}/embeddings.parquet").collect()]
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    check(queries.op12_whitening(spark, compare.SMALL).collect(), rows)


def whitened(spark, rows, **more):
    return whitening.whiten(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3), **more).collect()


def test_odd_rows_take_no_part(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=5).tolist()) for k in range(200)]
    odd = [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0]), (903, [float("nan")] * 5), (904, [float("-inf")] * 5), (905, [1e300] * 5), (906, [1.0] * 4)]
    check(whitened(spark, rows + odd), rows)
    assert whitened(spark, []) == [] and whitened(spark, odd[:5]) == []


def test_repeats_and_null_ids(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=3).tolist()) for k in range(30)]
    got = whitened(spark, rows * 2 + [(None, [1.0, 2.0, 3.0])])
    assert len(got) == 61 * 3 and {r["n"] for r in got} == {61} and sum(r["vec_id"] is None for r in got) == 3


def test_scales_that_lie_far_apart(spark):
    rng = np.random.default_rng(3)
    mix = np.eye(4) + 0.2 * rng.normal(size=(4, 4))
    rows = [(k, (rng.normal(size=4) @ mix * [1e12, 1e6, 1e3, 1.0]).tolist()) for k in range(300)]
    got = whitened(spark, rows)
    n, sums, centred, v = exact([whole(v) for _, v in rows])
    assert got[0]["identity_error"] < 1e-4 and {r["deviation"] for r in got} == {min(2**63 - 1, sum(c * c for c in row)) for row in centred}
    # the product of the eigenvalues is the determinant, which fractions give exactly
    m, det = [row[:] for row in v], Fraction(1)
    for i in range(4):
        det *= m[i][i]
        for j in range(i + 1, 4):
            f = m[j][i] / m[i][i]
            m[j] = [x - f * y for x, y in zip(m[j], m[i], strict=True)]
    trace = float(sum(v[i][i] for i in range(4)))
    product = np.prod([r["explained"] * trace for r in got if r["vec_id"] == 0])
    assert abs(product / float(det) - 1) < 1e-6


def test_components_without_spread_are_null(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [*(p := rng.integers(-9, 9, 2).astype(float).tolist()), p[0], 7.0]) for k in range(50)]  # one dimension twice, one constant
    got = whitened(spark, rows)
    by = {c: {r["whitened"] is None for r in got if r["component"] == c} for c in range(1, 5)}
    assert by == {1: {False}, 2: {False}, 3: {True}, 4: {True}} and got[0]["identity_error"] < 1e-9
    one = whitened(spark, [(1, [1.0, 2.0])])
    assert [r["whitened"] for r in one] == [None, None] and one[0]["identity_error"] is None and one[0]["deviation"] == 0


@pytest.mark.parametrize("span", [1, 1 << 8, 1 << 40, 1 << 62])
def test_scatter_is_exact(span):
    x = np.random.default_rng(5).integers(-span, span + 1, (150, 4))
    n, sums, products = whitening.scatter(x)
    rows = x.tolist()
    assert n == 150 and sums == [sum(r[i] for r in rows) for i in range(4)]
    assert all(products[i][j] == sum(r[i] * r[j] for r in rows) for i in range(4) for j in range(i, 4))
    assert all(whitening.joined(whitening.parted(v)) == v for row in products for v in (*row, *(-w for w in row)))


def test_tasks_and_slices_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(500)]
    monkeypatch.setattr(whitening, "NUMBERS", 600)
    check(whitened(spark, rows, components=4), rows, 4)
