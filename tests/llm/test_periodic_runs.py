import zlib
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from latticeframe.llm.periodic_runs import Names, kept, periodic_runs, repeating, runs


def brute_runs(words):
    """By the definition: for each period all longest stretches, whose smallest period it is."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            k = i
            while k + q < n and words[k] == words[k + q]:
                k += 1
            s, size = i, k + q - i
            if size >= max(24, 3 * q) and not any(all(words[x] == words[x + r] for x in range(s, s + size - r)) for r in range(1, q)):
                out.append((s, size, q))
            i = k
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text or "") if w]
    n = len(words)
    if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0 and n:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    collapsed = " ".join(w for i, w in enumerate(words) if i not in gone)
    return len(found), *top, sha256(listed.encode()).hexdigest(), sha256(collapsed.encode()).hexdigest(), collapsed


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_runs_equal_brute_force(data):
    """Sequences made of repeated blocks, with a word changed here and there."""
    words = []
    for _ in range(data.draw(st.integers(1, 4))):
        block = data.draw(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=14))
        words += block * data.draw(st.integers(1, 9)) + data.draw(st.lists(st.sampled_from([b"a", b"x"]), max_size=2))
    assert [tuple(r) for r in runs(words).tolist()] == brute_runs(words)


@pytest.mark.parametrize("period", [1, 2, 7, 8, 9, 11, 12, 13, 16, 17, 31, 32, 33, 63, 64, 65, 200])
def test_shortest_runs_of_each_period(period):
    """At each place of the grid, and one word too short."""
    block = [b"%d" % i for i in range(period)]
    size = max(24, 3 * period)
    for at in (0, 1, 5, 7, 8, 15, 40):
        head = [b"h%d" % i for i in range(at)]
        body = (block * 24)[:size]
        assert runs([*head, *body, b"z", b"y"]).tolist() == [[at, size, period]]
        assert runs([*head, *body[:-1], b"z", b"y"]).tolist() == []


def test_long_texts_of_one_word_and_of_a_long_period():
    assert runs([b"w"] * 40_000).tolist() == [[0, 40_000, 1]]
    block = [b"%d" % i for i in range(10_000)]
    assert runs(block * 3 + block[:7]).tolist() == [[0, 30_007, 10_000]]
    assert kept(10, np.array([[1, 6, 2]])).tolist() == [True] * 3 + [False] * 4 + [True] * 3


def test_nested_and_overlapping_runs():
    inner = [b"a"] * 24
    words = [*inner, b"x"] * 4
    found = [tuple(r) for r in runs(words).tolist()]
    assert found == brute_runs(words) and (0, 100, 25) in found and found.count((0, 24, 1)) == 1


def test_names_tell_equal_stretches():
    words = [b"%d" % (i * i % 7) for i in range(60)]
    names = Names(words)
    for j, level in enumerate(names.levels):
        size = 1 << j
        for a in range(len(level)):
            for b in range(a + 1, len(level)):
                assert (level[a] == level[b]) == (words[a : a + size] == words[b : b + size])
    a, b = np.array([0, 3, 10]), np.array([7, 10, 12])
    want = [next((k for k in range(60 - y) if words[x + k] != words[y + k]), 60 - y) for x, y in zip(a, b, strict=True)]
    assert names.forward(a, b).tolist() == want


def test_a_tenth_repeats():
    words = [b"%d" % i for i in range(100)]
    touched = [i for i in range(2000) if repeating(words, i) != words]
    assert 120 < len(touched) < 280 and repeating(words, None) == words and repeating([], 1) == []


def test_rows_equal_brute_force(spark):
    base = " ".join(f"w{i * i % 91}" for i in range(400))
    hot = [i for i in range(300) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, base, "x") for i in (*hot, -7, 1, 2)]
    rows += [(1, None, "x"), (2, "", "x"), (3, " \t\n\x0b\x0c\r ", "x"), (None, "a b " * 60, None), (None, None, None), (5, "a b " * 30, "x"), (5, "a b " * 30, "x")]
    rows += [(6, "one two three " * 8 + "é " * 24, "x"), (8, "p " * 23, "x"), (9, "p " * 24, "x"), (hot[0], "", "x"), (hot[1], "single", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_RUNS string")
    got = sorted((tuple(r) for r in periodic_runs(docs).collect()), key=repr)
    assert got == sorted(((i, *brute_row(i, t)) for i, t, _ in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 20
    assert periodic_runs(docs.limit(0)).count() == 0 and "collapsed" not in periodic_runs(docs, keep=False).columns
