"""Queries over a matrix of more than 64 rows, against NumPy."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from latticeframe.plans.queries import QUERIES

N = 80


def analytic(x, axis):
    keep = np.zeros(x.shape[axis])
    keep[[0, len(keep) // 2]] = 1
    keep[1 : len(keep) // 2] = 2
    return np.fft.ifft(np.fft.fft(x, axis=axis) * np.expand_dims(keep, 1 - axis), axis=axis)


def median(x):
    p = np.pad(x, 1)
    return np.median([p[i : i + N, j : j + 64] for i in range(3) for j in range(3)], axis=0)


EXPECTED = {
    "hilbert2": lambda x: analytic(np.pad(analytic(x, 1), ((0, 128 - N), (0, 0))), 0),
    "fft2_spectrum": lambda x: np.fft.fft2(x, (128, 64)),
    "rfft2_spectrum": lambda x: np.fft.rfft2(x, (128, 64)),
    "hilbert1d_signal": lambda x: analytic(x, 1),
    "medfilt_whole": median,
    "matmul_whole": lambda x: x.T @ x,
    "inner_whole": lambda x: x.T @ x,
}


@pytest.fixture(scope="module")
def matrix(tmp_path_factory):
    x = np.random.default_rng(1).normal(size=(N, 64))
    folder = tmp_path_factory.mktemp("matrix")
    pq.write_table(pa.table({"vec_id": pa.array(range(N), pa.int64()), "embedding": pa.array(x.tolist(), pa.list_(pa.float64()))}), folder / "embeddings.parquet")
    return str(folder), x


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_all_rows(spark, matrix, name):
    folder, x = matrix
    want = EXPECTED[name](x)
    got = np.full(want.shape, np.nan, want.dtype)
    rows = QUERIES[name](spark, folder).collect()
    for r in rows:
        got[r.i0, r.i1] = r.v if "v" in r else complex(r.re, r.im)
    assert len(rows) == want.size and np.allclose(got, want, atol=6e-5)
