import math
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from latticeframe.llm.vector_codes import CellFile, vector_codes


def brute_nearest(y, entries):
    best = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(entries)) for v in y]
    return [k for _, k in best], [d for d, _ in best]


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 300), st.integers(1, 6), st.integers(1, 1000), st.integers(0, 10**6))
def test_nearest_equals_brute_force(count, width, size, seed):
    """Small numbers make ties and equal entries."""
    rng = np.random.default_rng(seed)
    entries, y = rng.integers(-size, size + 1, (count, width)), rng.integers(-2 * size, 2 * size + 1, (20, width))
    found, errors = CellFile(entries).nearest(y)
    assert (found.tolist(), errors.tolist()) == brute_nearest(y, entries)
    low, high = CellFile(entries).bounds(y)
    exact = ((y[None] - entries[:, None]) ** 2).sum(-1)
    assert (low <= exact).all() and (exact <= high).all()


def test_bounds_leave_few_entries():
    rng = np.random.default_rng(1)
    entries, y = rng.integers(-300, 300, (256, 16)), rng.integers(-300, 300, (200, 16))
    low, high = CellFile(entries).bounds(y)
    assert (low <= high.min(axis=0)).sum() < 200 * 64


def brute_codes(rows):
    kept = [(i, v, g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v, _ in kept) // 4) * 4
    part = width // 4
    whole = [[math.floor(1024 * x) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0))[:256]
    books = [[whole[k][p * part : (p + 1) * part] for k in order] for p in range(4)]
    for final in [False] * 4 + [True]:
        near = [brute_nearest([w[p * part : (p + 1) * part] for w in whole], books[p]) for p in range(4)]
        if final:
            break
        for p in range(4):
            for e in range(len(order)):
                own = [w[p * part : (p + 1) * part] for w, c in zip(whole, near[p][0], strict=True) if c == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    errors = [sum(near[p][1][k] for p in range(4)) for k in range(len(kept))]
    by = {}
    for (_, _, g), e in zip(kept, errors, strict=True):
        by[g] = by.get(g, 0) + e
    digest = sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(i, "".join(f"{near[p][0][k]:02x}" for p in range(4)), errors[k], by[g], digest) for k, (i, _, g) in enumerate(kept)]


@pytest.mark.parametrize(("n", "dims"), [(700, 8), (40, 12), (300, 6)])
def test_rows_equal_brute_force(spark, n, dims):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, dims)) / 4
    x[n // 2 :: 3] = x[1]  # one vector that many rows hold
    rows = [(i, [float(np.float32(c)) for c in v], None if i % 5 == 0 else i % 3) for i, v in enumerate(x)]
    rows += [(n, None, 1), (n + 1, [math.nan] * dims, 1), (n + 2, [0.1, None], 1), (None, [0.25] * dims, None), (n + 3, [], 2), (n + 4, [0.5], 2), (5000, rows[9][1], 1), (5000, rows[9][1], 1)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<float>, label int, Error string").repartition(4)
    got = sorted(map(tuple, vector_codes(df).collect()), key=repr)
    assert got == sorted(brute_codes(rows), key=repr)


def test_empty_tables_and_large_numbers(spark):
    df = spark.createDataFrame([(1, [1e6], 1)], "vec_id long, embedding array<double>, label int")
    assert vector_codes(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="don't fit a long"):
        vector_codes(df).collect()
    got = vector_codes(df.selectExpr("vec_id", "array(0.5d) embedding", "label")).collect()
    assert [tuple(r)[:4] for r in got] == [(1, "00000000", 0, 0)]
