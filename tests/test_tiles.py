"""Products and elimination by tiles, against NumPy, with tiles so small that there are many."""

import numpy as np
import pytest
from latticeframe.operators import linalg, tiles
from latticeframe.operators.creation import fromarray, toarray
from latticeframe.operators.tiles import Elimination, pivoted
from latticeframe.tensor import Tensor


@pytest.fixture(autouse=True, params=[3, 8])
def small(request, monkeypatch):
    monkeypatch.setattr(tiles, "TILE", request.param)
    monkeypatch.setattr(tiles, "COMPARED", 2)


def random(*shape, seed=1):
    return np.random.default_rng(seed).normal(size=shape)


@pytest.mark.parametrize("held", [1, 64 << 20])
def test_products(spark, monkeypatch, held):
    monkeypatch.setattr(tiles, "HELD_BYTES", held)
    a, b = random(10, 17), random(17, 5, seed=2)
    np.testing.assert_allclose(toarray(linalg.matmul(fromarray(spark, a), fromarray(spark, b))), a @ b, atol=1e-12)
    c = random(10, 17, seed=3) + 1j * random(10, 17, seed=4)
    np.testing.assert_allclose(toarray(linalg.matmul(fromarray(spark, c), fromarray(spark, b))), c @ b, atol=1e-12)
    np.testing.assert_allclose(toarray(linalg.inner(fromarray(spark, a), fromarray(spark, c))), a @ c.T, atol=1e-12)


def test_batches_and_higher_ranks(spark):
    a, b = random(2, 4, 7), random(2, 7, 5, seed=2)
    np.testing.assert_allclose(toarray(linalg.matmul(fromarray(spark, a), fromarray(spark, b))), a @ b, atol=1e-12)
    np.testing.assert_allclose(toarray(linalg.matmul(fromarray(spark, a), fromarray(spark, b[:1]))), a @ b[:1], atol=1e-12)
    np.testing.assert_allclose(toarray(linalg.matmul(fromarray(spark, a), fromarray(spark, b[0]))), a @ b[0], atol=1e-12)
    x, y = random(2, 3, 7), random(4, 2, 7, seed=5)
    np.testing.assert_allclose(toarray(linalg.inner(fromarray(spark, x), fromarray(spark, y))), np.inner(x, y), atol=1e-12)
    np.testing.assert_allclose(toarray(linalg.inner(fromarray(spark, x), fromarray(spark, y[0, 0]))), np.inner(x, y[0, 0]), atol=1e-12)


def test_arrays_of_unequal_shapes(spark):
    """Each key's own extents: no cell of a longer array's place."""
    sizes = {"a": (4, 9, 2), "b": (7, 5, 6), None: (1, 1, 1)}
    left = {k: random(n, m, seed=n) for k, (n, m, _) in sizes.items()}
    right = {k: random(m, p, seed=p) for k, (_, m, p) in sizes.items()}
    frame = lambda arrays: Tensor(spark.createDataFrame([(k, *at, float(v)) for k, x in arrays.items() for at, v in np.ndenumerate(x)], "key string, i0 long, i1 long, v double"), 2, ("key",))
    got = linalg.matmul(frame(left), frame(right)).df.collect()
    want = {(k, *at): v for k in sizes for at, v in np.ndenumerate(left[k] @ right[k])}
    assert len(got) == len(want) and all(abs(want[r.key, r.i0, r.i1] - r.v) < 1e-12 for r in got)


def test_inner_extents_differ(spark):
    with pytest.raises(ValueError, match="differ"):
        linalg.matmul(fromarray(spark, random(2, 3)), fromarray(spark, random(2, 3)))


def test_pivots_are_the_largest():
    x = random(9, 4)
    order, pivots = pivoted(x)
    assert order[0] == np.abs(x[:, 0]).argmax() and len(set(order.tolist())) == 4
    assert np.isclose(abs(np.prod(pivots)), abs(np.linalg.det(x[order])))


@pytest.mark.parametrize("n", [1, 8, 11])
def test_systems(spark, n):
    a = random(n, n, seed=n)
    t = fromarray(spark, a)
    np.testing.assert_allclose(linalg.det(t).df.first().v, np.linalg.det(a), rtol=1e-9)
    np.testing.assert_allclose(toarray(linalg.inv(t)), np.linalg.inv(a), rtol=1e-7, atol=1e-9)
    b = random(n, 4, seed=7)
    np.testing.assert_allclose(toarray(linalg.solve(t, fromarray(spark, b))), np.linalg.solve(a, b), rtol=1e-7, atol=1e-9)
    if n == 8:
        np.testing.assert_allclose(toarray(linalg.solve(t, fromarray(spark, b[:, 0]))), np.linalg.solve(a, b[:, 0]), rtol=1e-7, atol=1e-9)


def test_pivots_in_other_tiles(spark):
    """Zeros on the diagonal and in whole tiles; cells that are zero have no row."""
    n = 12
    a = np.zeros((n, n))
    a[np.arange(n), (np.arange(n) + 5) % n] = np.arange(1, n + 1)
    a[0, 0] = 1e-3
    cells = [(i, j, float(a[i, j])) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(a)), strict=True)]
    t = Tensor(spark.createDataFrame(cells, "i0 long, i1 long, v double"), 2, (), (n, n))
    np.testing.assert_allclose(linalg.det(t).df.first().v, np.linalg.det(a), rtol=1e-9)
    np.testing.assert_allclose(toarray(linalg.inv(t)), np.linalg.inv(a), atol=1e-9)


def test_singular_matrices(spark):
    a = random(7, 7)
    a[5] = a[1] - 2 * a[3]
    t = fromarray(spark, a)
    assert linalg.det(t).df.first().v == 0 and linalg.det(fromarray(spark, np.zeros((4, 4)))).df.first().v == 0
    for f in (lambda: linalg.inv(t), lambda: linalg.solve(t, fromarray(spark, np.ones(7)))):
        with pytest.raises(ValueError, match="singular"):
            f()
    with pytest.raises(ValueError, match="square"):
        linalg.det(fromarray(spark, random(3, 4)))


def test_determinants_beyond_doubles(spark):
    assert linalg.det(fromarray(spark, np.diag([1e200, -1e200, 1e200, 1e200]))).df.first().v == -np.inf
    own = Elimination(fromarray(spark, np.diag([1e200, 1e-200, 1e200, -1e-200, 3.0])))
    own.least = 0
    assert own.run() and abs(own.determinant() + 3) < 1e-9
