import math

import numpy as np
import pytest
from latticeframe.llm import norm_search
from latticeframe.llm.norm_search import Bucket, Search, top_products
from latticeframe.llm.vectors import whole_vectors


def whole(v, scale):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(x * scale) for x in v]


def brute(queries, vectors, k, scale):
    """Query by query over all rows, in whole numbers."""
    asked = {(i, tuple(w)) for i, v in queries if i is not None and (w := whole(v, scale)) is not None}
    kept = [(i, w) for i, v in vectors if i is not None and (w := whole(v, scale)) is not None]
    out = []
    for q in {i for i, _ in asked}:
        scored = [(-sum(a * b for a, b in zip(x, w, strict=False)), i) for j, x in asked if j == q for i, w in kept if i != q]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def clustered(n, dims, seed, spread, lengths=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    x = centres[rng.integers(0, 5, n)] + spread * rng.normal(size=(n, dims))
    return x * np.exp(lengths * rng.normal(size=(n, 1)))


@pytest.mark.parametrize(("spread", "lengths"), [(0.05, 1.0), (0.05, 0.02), (0.2, 0.02), (3.0, 0.02), (3.0, 1.0)])
@pytest.mark.parametrize("rows", [7, 64, 512])
def test_search_equals_brute_force(monkeypatch, spread, lengths, rows):
    """Close clusters of like lengths are searched by coordinates, others by lengths."""
    seen = []
    near = Bucket.near
    monkeypatch.setattr(Bucket, "near", lambda self, *a: seen.append(1) or near(self, *a))
    x = clustered(500, 12, 3, spread, lengths)
    w = np.floor(256 * x)
    order = np.argsort(-np.sqrt((w * w).sum(1)), kind="stable")
    ids = order.astype("<i8")
    search = Search(np.arange(0, 500, 50), w[::50], 5)
    made = [Bucket(ids[k : k + rows].tobytes(), w[ids[k : k + rows]].tobytes(), 12) for k in range(0, 500, rows)]
    search.learn(made[0])
    for b in made:
        search.visit(b)
    who, scores, found = search.found
    got = {(int(50 * q), int(i), int(s)) for q, s, i in zip(who, scores, found, strict=True) if s >= search.floor[q]}
    want = brute([(i, x[i].tolist()) for i in range(0, 500, 50)], list(enumerate(x.tolist())), 5, 256)
    assert {(q, i, s) for q, _, i, s in want} <= got
    assert seen or spread > 1 or lengths == 1  # coordinates were used


def test_table_equals_brute_force(spark):
    """Ties, one vector that a third of the rows hold, nulls, repeats, lengths, clashing names."""
    x = clustered(300, 8, 5, 0.2)
    x[::3] = x[0]
    rows = [(i, [float(np.float32(c)) for c in v], "a") for i, v in enumerate(x)]
    rows += [(50, rows[50][1], "b"), (7, rows[7][1], "b"), (100, [1.0, 2.0], "b"), (400, [], "b"), (401, None, "b"), (450, [math.nan] * 8, "b"), (451, [1.0, None], "b"), (None, [9.0] * 8, "b"), (500, [math.inf] * 8, "b"), (550, [-1.0] * 9, "b"), (600, [0.0] * 8, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, SCORE string").repartition(5)
    asked = df.filter("vec_id % 50 = 0")
    plain = [(i, v) for i, v, _ in rows]
    got = sorted(tuple(r) for r in top_products(asked, df, 5, 256).collect())
    assert got == brute([(i, v) for i, v in plain if i is not None and i % 50 == 0], plain, 5, 256)
    assert {q for q, *_ in got} == {0, 50, 100, 150, 200, 250, 400, 550, 600}


def test_many_passes_give_the_same(spark, monkeypatch):
    x = clustered(200, 6, 9, 0.5)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    whole_ = sorted(map(tuple, top_products(df, df, 3, 256).collect()))
    monkeypatch.setattr(norm_search, "BLOCK_BYTES", 3000)
    assert sorted(map(tuple, top_products(df, df, 3, 256).collect())) == whole_ and len(whole_) == 600


def test_few_rows_large_numbers_and_empty_tables(spark):
    kinds = "vec_id long, embedding array<double>"
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-3.0])], kinds)
    assert sorted(map(tuple, top_products(df.filter("vec_id = 0"), df, 5, 256).collect())) == [(0, 1, 1, 256 * 512), (0, 2, 2, -256 * 768)]
    large = spark.createDataFrame([(0, [3e6, 1.0]), (1, [2e6, 7.0]), (2, [2e6, 6.0])], kinds)
    want = [(0, 1, 1, 768000000 * 512000000 + 256 * 1792), (0, 2, 2, 768000000 * 512000000 + 256 * 1536)]
    assert sorted(map(tuple, top_products(large.filter("vec_id = 0"), large, 5, 256).collect())) == want
    assert top_products(df.limit(0), df, 5, 256).count() == 0 and top_products(df, df.limit(0), 5, 256).count() == 0


def test_whole_vectors(spark):
    rows = [(1, [0.5, -0.001]), (2, None), (3, [1.0, None]), (4, []), (5, [math.inf])]
    got = whole_vectors(spark.createDataFrame(rows, "i int, v array<float>"), "v", 256, "i").collect()
    assert [(r.i, r.dims, np.frombuffer(r.x).tolist() if r.x else []) for r in got] == [(1, 2, [128.0, -1.0]), (4, 0, [])]
